"""What a search field is, and the fields of a catalog."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import fold, fold_all

#: The kinds of fields, by canonical name.
KINDS = {
    "title": "text",
    "author_sort": "text",
    "series": "text",
    "publisher": "text",
    "comments": "text",
    "uuid": "text",
    "authors": "multi",
    "formats": "multi",
    "languages": "multi",
    "tags": "tree",
    "rating": "rating",
    "series_index": "float",
    "id": "int",
    "pubdate": "date",
    "timestamp": "date",
    "last_modified": "date",
    "identifiers": "identifiers",
    "cover": "bool",
}
#: Other names of fields.
ALIASES = {
    "author": "authors",
    "tag": "tags",
    "format": "formats",
    "language": "languages",
    "lang": "languages",
    "comment": "comments",
    "date": "timestamp",
    "identifier": "identifiers",
    "ids": "identifiers",
    "isbn": "identifiers",
}
#: The fields that a term without a field name looks at.
ALL_FIELDS = ("title", "authors", "author_sort", "series", "publisher", "tags", "comments")
#: Kinds of custom columns by their declared type; a rating there stays on its scale of ten.
CUSTOM_KINDS = {"text": "text", "comments": "text", "enumeration": "text", "series": "text", "int": "int", "float": "float", "rating": "float", "bool": "bool", "datetime": "date"}


@dataclass
class FieldRegistry:
    """Binds search fields to columns. columns: the column of a field, where it is not named like it; a field whose column the
    table lacks never has a value. custom: more fields (#name) with their kinds. views: named expressions for vl:."""

    columns: dict[str, str] = field(default_factory=dict)
    custom: dict[str, str] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)

    def names(self) -> set[str]:
        return {*KINDS, *ALIASES, "all", "vl", *self.custom}

    def kind(self, name: str) -> str | None:
        return KINDS.get(name) or self.custom.get(name)

    def column(self, name: str) -> str:
        return self.columns.get(name, name)


def custom_kind(datatype: str, is_multiple: bool) -> str | None:
    """The kind of a custom column, or None if it can't be searched."""
    kind = CUSTOM_KINDS.get(datatype)
    return "multi" if kind == "text" and datatype == "text" and is_multiple else kind


def with_folded(items: DataFrame, registry: FieldRegistry, fields: tuple[str, ...] | None = None) -> DataFrame:
    """items with a folded copy (<column>_f) of the columns behind the text fields, or behind those named. Folding once keeps
    Python out of every search that follows; write the table, or cache it."""
    made = {}
    for name in fields or (*KINDS, *registry.custom):
        column = registry.column(name)
        if column not in items.columns or f"{column}_f" in items.columns:
            continue
        if registry.kind(name) == "text":
            made[f"{column}_f"] = fold(F.col(column))
        elif registry.kind(name) in ("multi", "tree"):
            made[f"{column}_f"] = fold_all(F.col(column))
        elif registry.kind(name) == "identifiers":
            made[f"{column}_f"] = F.arrays_zip(fold_all(F.map_keys(column)).alias("k"), fold_all(F.map_values(column)).alias("v"))
    return items.withColumns(made)
