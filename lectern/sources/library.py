"""Normalised catalog tables as items."""

from __future__ import annotations

import json
import warnings
from collections.abc import Collection

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.display import stars
from lectern.plans.fields import FieldRegistry, custom_kind
from lectern.plans.predicates import fields_of, search

#: The tables of a catalog that need not be there.
OPTIONAL = ("comments", "preferences", "custom_columns", "books_pages_link")


class Library:
    """The tables of one catalog. read(name) gives a table, and raises AnalysisException, KeyError or LookupError if it is not there."""

    def __init__(self, spark: SparkSession, read):
        self.spark, self._read = spark, read

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str) -> Library:
        return cls(spark, lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))

    @classmethod
    def frames(cls, spark: SparkSession, tables: dict[str, DataFrame]) -> Library:
        return cls(spark, tables.__getitem__)

    @classmethod
    def sqlite(cls, spark: SparkSession, path: str) -> Library:
        from lectern.sources.sqlite import read_table

        return cls(spark, lambda name: read_table(spark, path, name))

    def table(self, name: str) -> DataFrame | None:
        try:
            return self._read(name)
        except (AnalysisException, LookupError):
            return None

    def _linked(self, link: str, entity: str, ref: str, value: str, order: str | None) -> DataFrame:
        """(book, values): the linked names of each book as an array, by the link's own order or by name."""
        links, entities = self._read(link), self._read(entity)
        first = F.col(f"l.{order}") if order else F.lit(0)
        rows = links.alias("l").join(entities.alias("e"), F.col(f"l.{ref}") == F.col("e.id"))
        return rows.groupBy(F.col("l.book").alias("__book")).agg(F.transform(F.array_sort(F.collect_list(F.struct(first.alias("o"), F.col(f"e.{value}").alias("v")))), lambda x: x["v"]).alias(f"__{entity}"))

    def _one(self, link: str, entity: str, ref: str, value: str, name: str) -> DataFrame:
        """(book, value): the linked value of each book, that of the last link if there are several."""
        rows = self._read(link).alias("l").join(self._read(entity).alias("e"), F.col(f"l.{ref}") == F.col("e.id"))
        return rows.groupBy(F.col("l.book").alias("__book")).agg(F.max_by(F.col(f"e.{value}"), F.col("l.id")).alias(name))

    def find(self, text: str, as_of=None) -> DataFrame:
        """The items that a search finds, with the columns of books and of what the search looks at: nothing else is joined."""
        registry = self.registry()
        return search(self.items(only=fields_of(text, registry)), text, registry, as_of)

    def items(self, split_commas: bool = True, custom: bool = True, only: Collection[str] | None = None) -> DataFrame:
        """One row for each book, with everything that searches and reports use. Every side is gathered by book before it is
        joined. split_commas: names with commas become several values, as in joined lists. only: of what lies in other tables
        these columns (#label for custom ones); each column less is a join less."""
        wants = lambda name: only is None or name in only
        books, none = self._read("books"), F.array().cast("array<string>")
        out = books.select(
            F.col("id").cast("long").alias("id"), "title", F.col("sort").alias("title_sort"), "author_sort", F.col("timestamp").cast("string").alias("timestamp"), F.col("pubdate").cast("string").alias("pubdate"),
            (F.col("last_modified").cast("string") if "last_modified" in books.columns else F.lit(None).cast("string")).alias("last_modified"), (F.col("has_cover").cast("int") != 0).alias("cover"),
            F.col("series_index").cast("double").alias("series_index"), "path", (F.col("uuid") if "uuid" in books.columns else F.lit(None).cast("string")).alias("uuid"),
        )
        lists = (("authors", "books_authors_link", "author", "name", "id"), ("tags", "books_tags_link", "tag", "name", None), ("languages", "books_languages_link", "lang_code", "lang_code", None))
        for entity, link, ref, value, order in (side for side in lists if wants(side[0])):
            values = F.coalesce(f"__{entity}", none)
            if split_commas:
                values = F.filter(F.flatten(F.transform(values, lambda x: F.transform(F.split(x, ","), lambda v: F.trim(v)))), lambda x: x != "")
            out = out.join(self._linked(link, entity, ref, value, order), F.col("id") == F.col("__book"), "left").withColumn(entity, values).drop("__book", f"__{entity}")
        if wants("formats"):
            data = self._read("data").groupBy(F.col("book").alias("__book")).agg(F.array_sort(F.collect_list("format")).alias("__f"))
            out = out.join(data, F.col("id") == F.col("__book"), "left").withColumn("formats", F.coalesce("__f", none)).drop("__book", "__f")
        for name, link, entity, ref, value in (("series", "books_series_link", "series", "series", "name"), ("publisher", "books_publishers_link", "publishers", "publisher", "name"), ("rating_raw", "books_ratings_link", "ratings", "rating", "rating")):
            if wants(name.removesuffix("_raw")):
                out = out.join(self._one(link, entity, ref, value, name), F.col("id") == F.col("__book"), "left").drop("__book")
        if wants("rating"):
            out = out.withColumns({"rating_raw": F.col("rating_raw").cast("int"), "rating": stars(F.col("rating_raw").cast("int"))})
        if wants("identifiers"):
            ids = self._read("identifiers").groupBy(F.col("book").alias("__book"), "type").agg(F.max("val").alias("val")).groupBy("__book").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "val")))).alias("__ids"))
            out = out.join(ids, F.col("id") == F.col("__book"), "left").withColumn("identifiers", F.coalesce("__ids", F.create_map().cast("map<string,string>"))).drop("__book", "__ids")
        if wants("comments") and (comments := self.table("comments")) is not None:
            out = out.join(comments.groupBy(F.col("book").alias("__book")).agg(F.max("text").alias("comments")), F.col("id") == F.col("__book"), "left").drop("__book")
        elif wants("comments"):
            out = out.withColumn("comments", F.lit(None).cast("string"))
        for column in self.custom_columns() if custom else ():
            if not wants(f"#{column['label']}".lower()):
                continue
            out = out.join(self.custom_values(column["name"]).select(F.col("book").alias("__book"), F.col("value").alias(f"#{column['label']}")), F.col("id") == F.col("__book"), "left").drop("__book")
        return out

    def book_files(self, root: str = "") -> DataFrame:
        """(id, format, path): the files of each book below root."""
        books = self._read("books").select(F.col("id").cast("long").alias("id"), "path")
        data = self._read("data").select(F.col("book").cast("long").alias("book"), "format", "name")
        path = F.concat_ws("/", F.nullif(F.lit(root.rstrip("/")), F.lit("")), "path", F.concat("name", F.lit("."), F.lower("format")))
        return data.join(books, F.col("book") == F.col("id")).select("id", "format", path.alias("path"))

    def identifiers_of(self, book: int) -> DataFrame:
        return self._read("identifiers").where(F.col("book") == book).select("type", "val")

    def all_tags(self) -> DataFrame:
        """Tag names, used or not, in order."""
        return self._read("tags").select("name").distinct().orderBy("name")

    def ids(self) -> DataFrame:
        return self._read("books").select(F.col("id").cast("long").alias("id"))

    def identified(self, kind: str = "isbn") -> DataFrame:
        """(id, title, path, val): the books with an identifier of a kind; the largest if there are several."""
        own = self._read("identifiers").where(F.col("type") == kind).groupBy(F.col("book").alias("__book")).agg(F.max("val").alias("val"))
        return self._read("books").join(own, F.col("id") == F.col("__book")).select(F.col("id").cast("long").alias("id"), "title", "path", "val")

    def count(self) -> int:
        return self._read("books").count()

    def views(self) -> dict[str, str]:
        """Named expressions, out of the preferences."""
        prefs = self.table("preferences")
        row = prefs.where(F.col("key") == "virtual_libraries").select("val").first() if prefs is not None else None
        try:
            found = json.loads(row["val"]) if row and row["val"] else {}
        except ValueError:
            warnings.warn("the named views can't be read", stacklevel=2)
            return {}
        return found if isinstance(found, dict) else {}

    def custom_columns(self) -> list[dict]:
        """id, label, name, datatype and is_multiple of each custom column; the list is as short as the catalog's schema."""
        table = self.table("custom_columns")
        return [r.asDict() for r in table.orderBy("id").collect()] if table is not None else []

    def custom_values(self, name: str) -> DataFrame:
        """(book, value) of a custom column by display name: an array where several values are allowed, else one value."""
        known = {c["name"]: c for c in self.custom_columns()}
        if name not in known:
            raise ValueError(f"no custom column {name!r}; there are: {', '.join(sorted(known)) or 'none'}")
        column = known[name]
        values, links = self.table(f"custom_column_{column['id']}"), self.table(f"books_custom_column_{column['id']}_link")
        if values is None:
            return self.spark.createDataFrame([], "book long, value string")
        rows = values.select("book", "value") if links is None else links.alias("l").join(values.alias("v"), F.col("l.value") == F.col("v.id")).select(F.col("l.book").alias("book"), F.col("v.value").alias("value"))
        gathered = F.array_sort(F.collect_list("value")) if column["is_multiple"] else F.min("value")
        return rows.groupBy("book").agg(gathered.alias("value"))

    def registry(self) -> FieldRegistry:
        """The fields that a search over items() has, with custom columns and views."""
        kinds = {f"#{c['label']}".lower(): custom_kind(c["datatype"], bool(c["is_multiple"])) for c in self.custom_columns()}
        columns = {f"#{c['label']}".lower(): f"#{c['label']}" for c in self.custom_columns()}
        return FieldRegistry(columns=columns, custom={k: v for k, v in kinds.items() if v}, views=self.views())
