"""Which items a report is about: branches of tags, ids, named views, and what a search found."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.fields import FieldRegistry
from lectern.plans.predicates import Compiler

#: So many ids stand in the filter itself; more are joined.
MOST_LISTED = 1000


def under(tag: Column, branches: Iterable[str]) -> Column:
    """Whether a dotted tag is one of the branches or below it, in this very spelling."""
    found = F.lit(False)
    for branch in branches:
        found = found | (tag == branch) | tag.startswith(f"{branch}.")
    return found


def in_branches(items: DataFrame, branches: Iterable[str], tags: str = "tags") -> DataFrame:
    """Items with some tag in some of the branches; all items if none is named. Null tags are in none."""
    named = tuple(branches)
    return items.where(F.coalesce(F.exists(tags, lambda t: F.coalesce(under(t, named), F.lit(False))), F.lit(False))) if named else items


def with_ids(items: DataFrame, ids: Iterable[int] | DataFrame, key: str = "id") -> DataFrame:
    """Items with one of the ids: a list, or a table whose first column holds them. Ids that no item has are passed over."""
    if not isinstance(ids, DataFrame):
        listed = sorted(set(ids))
        if len(listed) <= MOST_LISTED:
            return items.where(F.col(key).isin(listed))
        ids = SparkSession.active().createDataFrame([(i,) for i in listed], "__id long")
    return items.join(ids.select(F.col(ids.columns[0]).alias("__id")), F.col(key) == F.col("__id"), "left_semi")


def in_view(items: DataFrame, view: str, registry: FieldRegistry, as_of=None) -> DataFrame:
    """The items of a named view; a name that there is not is a ValueError with those that there are."""
    if view not in registry.views:
        raise ValueError(f"no view {view!r}; there are: {', '.join(sorted(registry.views)) or 'none'}")
    return items.where(Compiler(items, registry, as_of).predicate(registry.views[view]))


def display_tag(tags: Column, branches: Iterable[str] = ()) -> Column:
    """The first tag in the branches, else the first one; blank without tags."""
    named = tuple(branches)
    chosen = [F.get(F.filter(tags, lambda t: under(t, named)), F.lit(0))] if named else []
    return F.coalesce(*chosen, F.get(tags, F.lit(0)), F.lit(""))
