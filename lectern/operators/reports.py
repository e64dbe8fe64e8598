"""Statistics, breakdowns and listings of a catalog.

Library order is author_sort, title_sort (binary, nulls first), then id. Where equal counts rank by first appearance, that is
the smallest (author_sort, title_sort, id, place in the list): it comes out of the same aggregate as the count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.display import primary_author
from lectern.plans.fields import FieldRegistry
from lectern.plans.predicates import Compiler
from lectern.plans.syntax import SearchError

ORDER = ("author_sort", "title_sort", "id")


def library_order(items: DataFrame) -> DataFrame:
    return items.orderBy(*ORDER)


def recent(items: DataFrame, n: int = 20) -> DataFrame:
    """The n latest by their raw time stamp; equal ones in library order."""
    return items.orderBy(F.coalesce("timestamp", F.lit("")).desc(), *ORDER).limit(n)


def value_counts(items: DataFrame, column: str, name: str = "value", top: int | None = None) -> DataFrame:
    """(name, n, first): how many items have each value of a column, or of a list column; most frequent first, equal counts by
    first appearance. Null and empty values don't count."""
    listed = items.schema[column].dataType.typeName() == "array"
    values = F.posexplode(column) if listed else F.posexplode(F.array(column))
    rows = items.select(F.struct(*(F.coalesce(c, F.lit("")).alias(c) if c != "id" else F.col(c) for c in ORDER)).alias("o"), values.alias("pos", name)).where(F.col(name).isNotNull() & (F.col(name) != ""))
    found = rows.groupBy(name).agg(F.count("*").alias("n"), F.min(F.struct("o", "pos")).alias("first")).orderBy(F.desc("n"), "first")
    return found.limit(top) if top else found


def format_counts(items: DataFrame) -> DataFrame:
    return value_counts(items, "formats", "format").select("format", "n")


def rating_histogram(items: DataFrame) -> DataFrame:
    """(stars, n), lowest first; unrated items don't count."""
    return items.where("rating is not null").groupBy(F.col("rating").alias("stars")).agg(F.count("*").alias("n")).orderBy("stars")


def rating_summary(items: DataFrame) -> DataFrame:
    """(rated, unrated, share): one row; share of rated items in percent, null without items."""
    return items.agg(F.count("rating").alias("rated"), F.count_if(F.col("rating").isNull()).alias("unrated"), F.try_divide(100.0 * F.count("rating"), F.count("*")).alias("share"))


def distinct_counts(items: DataFrame) -> DataFrame:
    """One row: distinct primary authors, tags, series and publishers, and items without a cover."""
    own = items.withColumns({"author": primary_author(F.col("authors")), "missing": (~F.coalesce("cover", F.lit(False))).cast("int")})
    tags = items.select(F.explode("tags").alias("t")).agg(F.countDistinct("t").alias("tags"))
    rest = own.agg(F.count("*").alias("items"), F.countDistinct("author").alias("authors"), F.countDistinct("series").alias("series"), F.countDistinct("publisher").alias("publishers"), F.sum("missing").alias("no_cover"))
    return rest.withColumn("one", F.lit(1)).join(tags.withColumn("one", F.lit(1)), "one").drop("one")


def taxonomy_roots(tags: DataFrame, column: str = "name") -> DataFrame:
    """(root, n): distinct tags under each root, used or not."""
    return tags.select(column).distinct().groupBy(F.substring_index(column, ".", 1).alias("root")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root")


def tag_counts(tags: DataFrame, links: DataFrame, tag_id: str = "id", name: str = "name", link_tag: str = "tag") -> DataFrame:
    """(id, name, n): how many links each tag has; tags without any count 0."""
    n = links.groupBy(F.col(link_tag).alias("__tag")).agg(F.count("*").alias("n"))
    return tags.join(n, F.col(tag_id) == F.col("__tag"), "left").select(F.col(tag_id).alias("id"), F.col(name).alias("name"), F.coalesce("n", F.lit(0)).alias("n"))


def tag_totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count("*").alias("tags"), F.sum("n").alias("links"))


def series_rollup(items: DataFrame, series: str = "series", index: str = "series_index", title: str = "title") -> DataFrame:
    """(series, n, last, indices, titles): each series' size, largest index, whole and broken indices in order, and titles by
    index (those without one last), then title."""
    rows = items.where(F.col(series).isNotNull() & (F.col(series) != "")).select(F.col(series).alias("series"), F.col(index).cast("double").alias("i"), F.col(title).alias("t"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("i").isNull().alias("none"), "i", "t")))
    return rows.groupBy("series").agg(F.count("*").alias("n"), F.max("i").alias("last"), F.array_sort(F.collect_set("i")).alias("indices"), F.transform(ordered, lambda x: x["t"]).alias("titles"))


def series_by(rollup: DataFrame, order: str = "name") -> DataFrame:
    """series_rollup() by name, by name whatever the case (fold), or by size, largest first (size)."""
    return rollup.orderBy(*{"name": ("series",), "fold": (F.lower("series"), "series"), "size": (F.desc("n"), "series")}[order])


def top_series(items: DataFrame, n: int = 10) -> DataFrame:
    """(series, n): the largest series, equal ones by name; counted without their titles."""
    rows = items.where(F.col("series").isNotNull() & (F.col("series") != ""))
    return rows.groupBy("series").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "series").limit(n)


def largest(files: DataFrame, n: int | None = None, size: str = "size", key: str = "path") -> DataFrame:
    """Files by size, largest first, equal ones by path."""
    found = files.orderBy(F.desc(size), key)
    return found.limit(n) if n is not None else found


def gaps(indices: Column, last: Column) -> Column:
    """The whole numbers from 1 to last that are not among the indices; broken ones count for nothing."""
    whole = F.transform(F.filter(indices, lambda x: x == F.floor(x)), lambda x: x.cast("int"))
    top = F.floor(last).cast("int")
    return F.when(top >= 1, F.array_except(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), whole)).otherwise(F.array().cast("array<int>"))


def series_status(rollup: DataFrame) -> DataFrame:
    """series_rollup() with gaps and status: incomplete with gaps, complete if a last index is known, else unknown."""
    found = rollup.withColumn("gaps", gaps(F.col("indices"), F.col("last")))
    status = F.when(F.size("gaps") > 0, "incomplete").when(F.col("last").isNotNull(), "complete").otherwise("unknown")
    return found.withColumn("status", status).orderBy(F.lower("series"), "series")


def author_stats(items: DataFrame) -> DataFrame:
    """(author, items, rated, mean_rating, formats, series): by primary author, most items first."""
    rows = items.select(primary_author(F.col("authors")).alias("author"), "rating", "formats", "series")
    found = rows.groupBy("author").agg(
        F.count("*").alias("items"), F.count("rating").alias("rated"), F.avg("rating").alias("mean_rating"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("formats")))).alias("formats"), F.countDistinct(F.nullif("series", F.lit(""))).alias("series"),
    )
    return found.orderBy(F.desc("items"), "author")


def pace(items: DataFrame, column: str = "timestamp") -> DataFrame:
    """(month, n): how many items came in each month, in order. Items without a date don't count."""
    month = F.substring(F.col(column).cast("string"), 1, 7)
    return items.where(F.coalesce(month, F.lit("")) != "").groupBy(month.alias("month")).agg(F.count("*").alias("n")).orderBy("month")


def tag_tree(tags: DataFrame, column: str = "name") -> DataFrame:
    """(path, depth, label): every tag and all that is above it once, each under its parent in order."""
    parts = F.filter(F.split(column, r"\."), lambda x: x != "")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.slice("parts", F.lit(1), i))).alias("p")
    paths = tags.select(parts.alias("parts")).where(F.size("parts") > 0).distinct().select(above).distinct()
    return paths.orderBy("p").select(F.array_join("p", ".").alias("path"), (F.size("p") - 1).alias("depth"), F.element_at("p", -1).alias("label"))


def compression_summary(advised: DataFrame, verdicts: tuple[str, ...] = ("ebook", "printer", "skip-already-low-dpi", "skip-optimized", "skip-small", "manual")) -> DataFrame:
    """(advice, files, bytes, saved): what functions.files.compression_advice() says of all files, in a fixed order, without what
    does not occur. saved: bytes that the two ways of shrinking are thought to save, of which images make up a part."""
    dpi = F.col("avg_dpi")
    share = F.when(F.col("advice") == "ebook", F.floor(100 * (1 - F.pow(150 / dpi, F.lit(2)))) * 0.85)
    share = share.when(F.col("advice") == "printer", F.when(dpi > 300, F.floor(100 * (1 - F.pow(300 / dpi, F.lit(2))))).otherwise(30) * 0.75)
    rows = advised.withColumn("__saved", F.floor(F.col("size") * F.coalesce(share, F.lit(0.0)) / 100))
    rank = F.array_position(F.array(*map(F.lit, verdicts)), F.col("advice"))
    return rows.groupBy("advice").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("__saved").alias("saved")).orderBy(rank)


def view_flags(items: DataFrame, registry: FieldRegistry, as_of=None) -> tuple[dict[str, Column], dict[str, str]]:
    """A condition for each named view that compiles, and the errors of those that don't."""
    compiler, flags, errors = Compiler(items, registry, as_of), {}, {}
    for name in sorted(registry.views):
        try:
            flags[name] = compiler.flag(f'vl:"{name}"')
        except SearchError as e:
            errors[name] = str(e)
    return flags, errors


def view_counts(items: DataFrame, registry: FieldRegistry, as_of=None) -> DataFrame:
    """(view, n): the items in each view, and in all, in one pass over the items. A view that does not compile has a null n."""
    flags, errors = view_flags(items, registry, as_of)
    names = [*flags, "(all)"]
    one = items.agg(*(F.count_if(f).alias(f"c{i}") for i, f in enumerate(flags.values())), F.count("*").alias(f"c{len(flags)}"))
    pairs = [F.struct(F.lit(n).alias("view"), F.col(f"c{i}").alias("n")) for i, n in enumerate(names)] + [F.struct(F.lit(n).alias("view"), F.lit(None).cast("long").alias("n")) for n in errors]
    return one.select(F.explode(F.array(*pairs)).alias("e")).select("e.*")


def view_overlap(items: DataFrame, registry: FieldRegistry, as_of=None) -> DataFrame:
    """(views, n): how many items are in just these views, two at least; most first, then by name. One pass; views that don't
    compile are passed over."""
    flags, _ = view_flags(items, registry, as_of)
    inside = F.array_sort(F.array_compact(F.array(*(F.when(f, F.lit(n)) for n, f in flags.items())).cast("array<string>")))
    found = items.select(inside.alias("v")).where(F.size("v") > 1).groupBy(F.array_join("v", " + ").alias("views")).agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "views")


def catalog(items: DataFrame) -> DataFrame:
    """Items as a printed catalog lists them: by author key, then title, then library order."""
    return items.withColumn("author_key", F.trim(F.lower(F.substring_index(F.coalesce("author_sort", F.lit("")), "&", 1)))).orderBy("author_key", F.coalesce("title_sort", F.lit("")), *ORDER)


def sample(items: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same for the same seed."""
    return items.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def hit_rate(rows: DataFrame, group: str, hit: str) -> DataFrame:
    """(group, total, hits): most rows first."""
    return rows.groupBy(group).agg(F.count("*").alias("total"), F.count_if(hit).alias("hits")).orderBy(F.desc("total"), group)
