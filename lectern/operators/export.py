"""Projections for exports, and their files."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.display import author_display, author_key, series_label, star_text
from lectern.functions.isbn import isbn13_or_blank
from lectern.operators.scope import in_view
from lectern.plans.fields import FieldRegistry

#: Columns of the CSV export, and the header of the LibraryThing import.
CSV_COLUMNS = ("id", "title", "authors", "author_sort", "tags", "series", "series_index", "formats", "rating", "publisher", "languages", "added", "has_cover")
LT_HEADER = "'TITLE',\"'AUTHOR (last, first)'\",'DATE','ISBN',\"'PUBLICATION INFO'\",'TAGS','RATING','REVIEW',\"'DATE READ'\",\"'PAGE COUNT'\",\"'CALL NUMBER'\""
LT_BATCH = 500


def _column(items: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in items.columns else F.lit(None).cast(kind)


def records(items: DataFrame) -> DataFrame:
    """Items as nested records: lists, stars, the day they came, and whether there is a cover."""
    lists = {n: F.coalesce(_column(items, n, "array<string>"), F.array().cast("array<string>")) for n in ("authors", "tags", "formats", "languages")}
    return items.select(
        "id", "title", lists["authors"].alias("authors"), "author_sort", lists["tags"].alias("tags"), "series", "series_index", lists["formats"].alias("formats"), "rating", "publisher",
        lists["languages"].alias("languages"), F.substring(F.coalesce(_column(items, "timestamp"), F.lit("")), 1, 10).alias("added"), F.coalesce("cover", F.lit(False)).alias("has_cover"),
    )


def csv_rows(items: DataFrame) -> DataFrame:
    """The same flat: lists joined, and blanks for what is missing; an index of 0 stays."""
    rows = records(items)
    joined = {n: F.array_join(n, ", ") for n in ("authors", "tags", "formats", "languages")}
    blank = {n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("author_sort", "series", "series_index", "rating", "publisher")}
    return rows.withColumns({**joined, **blank, "has_cover": F.col("has_cover").cast("int")}).select(*CSV_COLUMNS)


def ai_lines(items: DataFrame) -> DataFrame:
    """(id, line): one line for each item, `title by author (series #index) [tags] stars/5`, without what is missing."""
    r = records(items)
    some = lambda c: F.nullif(c, F.lit(""))
    index = F.concat(F.lit(" #"), F.col("series_index").cast("string"))
    return r.select("id", F.concat_ws(" ", some(F.col("title")), F.concat(F.lit("by "), some(F.col("author_sort"))), F.concat(F.lit("("), some(F.col("series")), F.coalesce(index, F.lit("")), F.lit(")")), F.concat(F.lit("["), some(F.array_join("tags", ", ")), F.lit("]")), F.concat(F.col("rating").cast("string"), F.lit("/5"))).alias("line"))


def lt_rows(items: DataFrame, roles: dict[str, str] | None = None, call_numbers: bool = False) -> DataFrame:
    """(id, is_read, 11 columns c1 to c11): rows of a LibraryThing import. roles names the columns that hold translators,
    status, date_read and pages, where there are any."""
    col = lambda role, kind="string": _column(items, (roles or {}).get(role, role), kind)
    text = lambda c: F.coalesce(c, F.lit(""))
    raw = text(col("pubdate"))
    names = F.filter(F.transform(F.split(F.replace(text(col("translators")), F.lit("|"), F.lit(",")), ","), lambda x: F.trim(x)), lambda x: x != "")
    tags = F.concat(F.filter(F.coalesce(col("tags", "array<string>"), F.array().cast("array<string>")), lambda t: F.trim(t) != ""), F.transform(names, lambda n: F.concat(F.lit("translator:"), n)))
    ids = col("identifiers", "map<string,string>")
    pages = col("pages", "int")
    columns = [
        text(col("title")), text(col("author_sort")), F.when(raw.startswith("0101"), "").otherwise(F.ltrim(F.substring(raw, 1, 4), F.lit("0"))), isbn13_or_blank(F.try_element_at(ids, F.lit("isbn"))),
        text(col("publisher")), F.array_join(tags, ", "), F.when(col("rating_raw", "int") > 0, F.floor(col("rating_raw", "int") / 2).cast("string")).otherwise(""), F.lit(""),
        F.substring(text(col("date_read")), 1, 10), F.when(pages > 0, pages.cast("string")).otherwise(""), text(F.try_element_at(ids, F.lit("lcc"))) if call_numbers else F.lit(""),
    ]
    return items.select("id", (F.coalesce(col("status"), F.lit("")) == "Read").alias("is_read"), *(text(c).alias(f"c{i + 1}") for i, c in enumerate(columns)))


def lt_batches(rows: DataFrame, size: int = LT_BATCH) -> DataFrame:
    """rows with `batch`: numbers from 0 of runs of size rows, for read and other ones apart, in order of c2, c1, id. The order is
    cut into ranges that are counted first, so that no task has to number all rows. The cuts are rows that a hash of the id
    picks, so each reading of rows finds the same ranges."""
    spark, key = rows.sparkSession, F.struct("c2", "c1", "id")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    step = max(1, rows.count() // (20 * parts))
    some = rows.where(F.pmod(F.xxhash64("c2", "c1", "id"), F.lit(step)) == 0).select("c2", "c1", "id").distinct().orderBy("c2", "c1", "id").collect()  # about 20 for each range
    cuts = [some[i * len(some) // parts] for i in range(1, parts) if some]
    of = {f.name: f.dataType for f in rows.select("c2", "c1", "id").schema}
    bounds = F.array(*(F.struct(*(F.lit(r[c]).cast(of[c]).alias(c) for c in of)) for r in dict.fromkeys(cuts)))
    ranged = rows.withColumn("__part", F.size(F.filter(bounds, lambda b: b <= key)) if cuts else F.lit(0))
    counts = ranged.groupBy("__part", "is_read").count().orderBy("__part").collect()  # two rows for each range
    before, total = [], {True: 0, False: 0}
    for r in counts:
        before.append((r["__part"], r["is_read"], total[r["is_read"]]))
        total[r["is_read"]] += r["count"]
    own = Window.partitionBy("__part", "is_read").orderBy("c2", "c1", "id")
    ahead = F.broadcast(spark.createDataFrame(before, "__part int, is_read boolean, __before long"))
    number = F.coalesce("__before", F.raise_error(F.lit("rows changed while they were numbered")).cast("long")) + F.col("__n") - 1
    return ranged.withColumn("__n", F.row_number().over(own)).join(ahead, ["__part", "is_read"], "left").withColumn("batch", F.floor(number / size)).select(*rows.columns, "batch")


def lt_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.count_if(F.col("c4") != "").alias("with_isbn"), F.count_if(F.col("c10") != "").alias("with_pages"), F.count_if(F.col("c11") != "").alias("with_call_number"))


def lt_files(rows: DataFrame, size: int = LT_BATCH) -> DataFrame:
    """(name, content): the import files, read rows and other ones apart, size rows in each at most; either kind has a file even
    without rows. A file is built from one batch, so no task holds more than size rows of it."""
    line = F.rtrim(F.to_csv(F.struct(*(f"c{i}" for i in range(1, 12))), {"quote": '"', "emptyValue": ""}), F.lit("\n"))
    batches = lt_batches(rows, size).groupBy("is_read", "batch").agg(F.array_sort(F.collect_list(F.struct("c2", "c1", "id", line.alias("line")))).alias("lines"))
    kinds = rows.sparkSession.createDataFrame([(True,), (False,)], "kind boolean")
    listed = kinds.join(batches, F.col("kind") == F.col("is_read"), "left")
    name = F.concat(F.when(F.col("kind"), "read").otherwise("main"), F.lit("_"), F.lpad((F.coalesce("batch", F.lit(0)) + 1).cast("string"), 3, "0"), F.lit(".csv"))
    content = F.concat(F.lit(LT_HEADER + "\n"), F.array_join(F.transform(F.coalesce("lines", F.array().cast(batches.schema["lines"].dataType)), lambda x: F.concat(x["line"], F.lit("\n"))), ""))
    return listed.select(name.alias("name"), content.alias("content"))


def catalog_lines(items: DataFrame) -> DataFrame:
    """(id, author_key, line): items as a printed catalog shows them: title, series and stars."""
    series = F.concat(F.lit(" ("), F.nullif("series", F.lit("")), F.coalesce(F.concat(F.lit(" "), series_label(F.col("series_index"))), F.lit("")), F.lit(")"))
    shown = F.concat(F.lit(" ["), star_text(F.col("rating")), F.lit("]"))
    return items.select("id", author_key(F.col("author_sort")).alias("author_key"), F.concat(F.coalesce("title", F.lit("")), F.coalesce(series, F.lit("")), F.coalesce(shown, F.lit(""))).alias("line"))


def listing(items: DataFrame, query: str, suffix: Column | None = None) -> DataFrame:
    """(place, id, line): what a search found, in library order below the query and the number of matches. Order by place,
    author_sort, title_sort and id, or write it with write_text()."""
    text = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    line = F.concat(F.lit("  * "), text("title", "Untitled"), F.lit(" - "), text("author_sort", "Unknown"), suffix if suffix is not None else F.lit(""))
    head = items.agg(F.count("*").alias("n")).select(F.inline(F.array(*(F.struct(F.lit(i).alias("place"), c.alias("line")) for i, c in enumerate((F.lit(f"Search Query: {query}"), F.concat(F.lit("Matches: "), F.col("n")), F.lit("=" * 40), F.lit("")))))))
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    rows = items.select(F.lit(4).alias("place"), "author_sort", "title_sort", F.col("id").cast("long").alias("id"), line.alias("line"))
    return head.select("place", *none("author_sort", "title_sort"), F.lit(None).cast("long").alias("id"), "line").union(rows)


def catalog_text(items: DataFrame, header: str, tags: bool = False, with_id: bool = False, suffix: Column | None = None) -> DataFrame:
    """(place, author_key, part, title_sort, author_sort, id, line): the lines of a printed catalog: header, items below the
    name of each author (that of the key's first item), and the total. Headings are one aggregate by key, so no author's items
    meet in one task. In order of all columns but the line."""
    rows = items.withColumn("author_key", author_key(F.col("author_sort")))
    series = F.concat(F.lit(" ("), F.nullif("series", F.lit("")), F.coalesce(F.concat(F.lit(" "), series_label(F.col("series_index"))), F.lit("")), F.lit(")"))
    listed = F.array_join(F.coalesce(_column(rows, "formats", "array<string>"), F.array().cast("array<string>")), ",")
    formats = F.when(listed != "", F.concat(F.lit(" ["), listed, F.lit("]")))
    joined = F.array_join(F.filter(F.transform("tags", lambda t: F.trim(t)), lambda t: t != ""), ", ")
    stars = F.concat(F.lit(" ["), star_text(F.col("rating")), F.lit(" "), F.format_string("%.1f", F.col("rating").cast("double")), F.lit("/5]"))
    meta = F.when(joined != "", F.concat(F.lit(" ["), joined, F.lit("]"))) if tags else F.when(F.col("rating").isNotNull(), stars)
    parts = [series, formats, meta, suffix if suffix is not None else F.lit("")]
    number = F.concat(F.lit("["), F.col("id"), F.lit("] ")) if with_id else F.lit("")
    line = F.concat(F.lit("  * "), number, F.coalesce(F.nullif("title", F.lit("")), F.lit("Unknown Title")), *(F.coalesce(p, F.lit("")) for p in parts))
    sort = F.coalesce("title_sort", F.lit(""))
    body = rows.select(F.lit(1).alias("place"), "author_key", F.lit(3).alias("part"), sort.alias("title_sort"), "author_sort", F.col("id").cast("long").alias("id"), line.alias("line"))

    def fixed(place: int, frame: DataFrame, lines: Column, key: str | None = None) -> DataFrame:
        exploded = frame.select(*([key] if key else []), F.posexplode(lines).alias("part", "line"))
        blank = [F.lit(None).cast("string").alias(n) for n in ("title_sort", "author_sort")]
        return exploded.select(F.lit(place).alias("place"), (F.col(key) if key else F.lit("")).alias("author_key"), "part", *blank, F.lit(None).cast("long").alias("id"), "line")

    names = rows.groupBy("author_key").agg(F.min_by(author_display(F.col("authors")), F.struct(sort.alias("s"), F.coalesce("author_sort", F.lit("")).alias("a"), "id")).alias("name"))
    heads = fixed(1, names, F.array(F.lit(""), F.concat(F.lit("["), F.col("name"), F.lit("]")), F.repeat(F.lit("-"), F.length("name") + 2)), "author_key")
    total = rows.agg(F.count("*").alias("n"))
    foot = fixed(2, total, F.array(F.lit(""), F.lit("=" * 40), F.concat(F.lit("Total: "), F.col("n"), F.lit(" books"))))
    top = fixed(0, total, F.array(F.lit(header), F.lit("=" * len(header))))
    return top.union(heads).union(body).union(foot)


def write_text(lines: DataFrame, path: str) -> None:
    """The lines of listing() or catalog_text() in their order, as text files that follow one another by name."""
    lines.orderBy(*(c for c in lines.columns if c != "line")).select("line").write.mode("overwrite").text(path)


def write_views(items: DataFrame, registry: FieldRegistry, folder: str, as_of=None) -> dict[str, str]:
    """One catalog for each named view that holds something, below folder; the folder of each view."""
    written = {}
    for view, name in file_names(list(registry.views)).items():
        own = in_view(items, view, registry, as_of)
        if not own.isEmpty():
            written[view] = f"{folder}/{name}"
            write_text(catalog_text(own, f"Catalog [{view}]"), written[view])
    return written


def json_document(items: DataFrame) -> str:
    """Items in library order as one JSON array, as other programs read it. It is built on the driver: for a handful of items;
    write(records(items), path, "json") has no bound."""
    rows = [json.loads(r["line"]) for r in records(items.orderBy("author_sort", "title_sort", "id")).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line")).toLocalIterator()]
    return json.dumps(rows, indent=2, ensure_ascii=False) + "\n"


def audit_rows(audited: DataFrame) -> DataFrame:
    """The columns of an audit's CSV file out of quality.audit(): items first, then duplicates, then series."""
    rank = F.array_position(F.array(F.lit("book"), F.lit("duplicate"), F.lit("series_gap")), F.col("section"))
    return audited.orderBy(rank, F.col("id").try_cast("long"), "id", "title").select("id", "title", "author", "issue_type", "issues")


def lt_file_problems(files: DataFrame, expected: int | None = None) -> DataFrame:
    """(path, line, problem) of import files (path, content binary) as they were written: a byte order mark, line ends of two
    characters, bytes that are no UTF-8, another header, rows that have not eleven columns, ISBNs of a wrong shape, no title;
    and one row without a path if the files don't hold the expected number of rows. Of a file's bad rows the first is told."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for path, raw in zip(batch["path"], batch["content"]):
                raw = bytes(raw or b"")
                if raw.startswith(b"\xef\xbb\xbf"):
                    out.append((path, None, "byte order mark", 0))
                if b"\r\n" in raw:
                    out.append((path, None, "line ends of two characters", 0))
                try:
                    raw.decode()
                except UnicodeDecodeError:
                    out.append((path, None, "no UTF-8", 0))
                text = raw.decode(errors="replace")
                header, _, rest = text.partition("\n")
                if header != LT_HEADER:
                    out.append((path, 1, "another header", 0))
                if len(named := next(csv.reader([header]), [])) != 11 or named[3] != "'ISBN'":
                    out.append((path, 1, "columns out of line", 0))
                rows = list(csv.reader(io.StringIO(rest, newline="")))
                for number, row in enumerate(rows, 2):
                    wrong = f"{len(row)} columns" if len(row) != 11 else "ISBN shape" if row[3] and not re.fullmatch(r"[0-9]{13}", row[3]) else "" if row[0].strip() else "no title"
                    if wrong:
                        out.append((path, number, wrong, 0))
                        break
                out.append((path, None, None, len(rows)))
            yield pd.DataFrame(out, columns=["path", "line", "problem", "rows"]).astype({"line": "Int64"})

    found = files.select("path", "content").mapInPandas(run, "path string, line long, problem string, rows long")
    told = found.where("problem is not null").select("path", "line", "problem")
    if expected is None:
        return told
    total = F.coalesce(F.sum("rows"), F.lit(0))
    count = found.agg(total.alias("n")).where(F.col("n") != expected).select(F.lit(None).cast("string"), F.lit(None).cast("long"), F.concat(F.col("n"), F.lit(f" rows, {expected} expected")))
    return told.union(count)


def lt_problems(rows: DataFrame) -> DataFrame:
    """(id, problem): rows that an import would refuse: no title, or an ISBN of a wrong shape."""
    problem = F.when(F.col("c1") == "", "no title").when((F.col("c4") != "") & ~F.col("c4").rlike(r"^97[89]\d{10}$"), "ISBN shape")
    return rows.select("id", problem.alias("problem")).where("problem is not null")


def file_names(views: list[str]) -> dict[str, str]:
    """A file name for each view: letters, digits, blanks and dashes stay, blanks become underscores; names that would be empty
    or that are taken get a number."""
    names: dict[str, str] = {}
    for i, view in enumerate(sorted(views)):
        base = re.sub(r"[^\w\s-]", "", view).strip().replace(" ", "_") or f"wing_{i + 1}"
        taken, number, name = {n.lower() for n in names.values()}, 1, base
        while name.lower() in taken:
            number += 1
            name = f"{base}_{number}"
        names[view] = name
    return names


def write(rows: DataFrame, path: str, kind: str) -> bool:
    """rows as json, csv, or text (one string column) under path; nothing is written, and False returned, without rows."""
    if rows.isEmpty():
        return False
    writer = rows.write.mode("overwrite")
    {"json": writer.json, "csv": lambda p: writer.option("header", True).csv(p), "tsv": lambda p: writer.option("header", True).option("sep", "\t").csv(p), "text": writer.text}[kind](path)
    return True
