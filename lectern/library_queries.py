"""Queries over the star tables in a catalog's normalised shape, and over what files and texts hold, each with its SQL."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import dates, display, files, isbn, text
from lectern.operators import export, lookup, quality, reports, scope
from lectern.queries import QUERIES, SQL, flagship, query
from lectern.sources.star import CATALOG_SQL, CATALOG_VIEWS, PART_FULL_SQL, PART_SQL, part_catalog, part_items, part_items_full, table

__all__ = ["QUERIES", "SQL", "flagship"]


def _find(name: str, words: str, condition: str) -> None:
    """A search over the normalised catalog, which joins only what the search looks at."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return part_catalog(spark, sf_dir).find(words).select("id", "title")

    run.__name__, run.__doc__ = name, f"Search: {words}"
    query(f"WITH {CATALOG_SQL} SELECT id, title FROM items WHERE {condition}")(run)


_find("search_hier_below", 'tags:"=.promo"', "p_type = 'PROMO'")
_find("search_hier_regex", 'tags:"~^size\\.[12]$"', "p_size IN (1, 2)")
_find("search_text_presence", "series:false", "series IS NULL")
_find("search_comments_presence", "not comments:true", "comments IS NULL")
_find("search_int_literal", "id:=7 or id:>=1990", "id = 7 OR id >= 1990")
_find("search_float_literal", "rating:3.5", "rating = 3.5")
_find("search_date_presence", "pubdate:false", "p_size % 10 = 0")
_find("search_date_written", "date:2021-03-15 or pubdate:<1955", "p_size % 12 = 2 OR p_size % 10 <> 0 AND p_size + 1950 < 1955")
_find("search_isbn_alias", "isbn:00012", "contains(isbn, '00012')")
_find("search_isbn_equal", "isbn:=9780000000210", "isbn = '9780000000210'")
_find("search_identifiers_presence", "identifiers:isbn:false", "isbn IS NULL")
_find("search_identifiers_key_start", "identifiers:amaz:X", "contains(amazon, 'X')")
_find("search_empty_text", "series:", "series IS NOT NULL")
_find("search_empty_tag", "tags: or title:=blue", "title = 'blue'")
_find("search_escaped_mark", 'title:red not \\"', "contains(lower(title), 'red')")
_find("search_quoted_operator", '(title:red) "or" title:blue', "contains(lower(title), 'red') OR contains(lower(title), 'blue')")
_find("search_unknown_field", "nofield:red or title:blue", "contains(lower(title), 'blue')")
_find("search_blank_after_field", "title: red", "contains(lower(title), 'red') OR contains(lower(comments), 'red')")
_find("search_blank", "  ", "true")
_find("search_uuid", "uuid:=8f14e45fceea167a5a36dedd4bea2543", "id = 7")
_find("search_formats", "format:epub not format:=pdf", "list_contains(formats, 'EPUB') AND NOT list_contains(formats, 'PDF')")
_find("search_languages", "lang:=FRA", "languages[1] = 'fra'")
_find("search_custom_enumeration", "#status:=read or #status:false", "status IS DISTINCT FROM 'Unread'")
_find("search_custom_list", "#shelf:odd not #shelf:=promo", "id % 2 = 1 AND p_type <> 'PROMO'")
_find("search_custom_numbers", "#pages:>=400 or #score:<1.5", "coalesce(pages >= 400, false) OR coalesce(score < 1.5, false)")
_find("search_custom_date", "#done:2022-04", "done = '2022-04-01'")
_find("search_custom_bool", "#lent:false", "NOT coalesce(lent, false)")
_find("search_custom_view", "vl:Mine", "status = 'Read' AND p_type = 'PROMO'")
_find("search_all_of_catalog", "brand#3 not promo", "p_brand = 'Brand#3' AND p_type <> 'PROMO'")


_JOINED = "id, title, array_to_string(authors, '|') AS authors, array_to_string(tags, '|') AS tags, array_to_string(formats, '|') AS formats, array_to_string(languages, '|') AS languages, series, publisher, rating_raw::INT AS rating_raw, rating, cover, series_index, comments, timestamp, pubdate, uuid"


@query(f"WITH {CATALOG_SQL} SELECT {_JOINED}, isbn, amazon, status, pages::INT AS pages, score, lent FROM items")
def library_items(spark, sf_dir):
    items = part_catalog(spark, sf_dir).items()
    ids = {n: F.try_element_at("identifiers", F.lit(n)) for n in ("isbn", "amazon")}
    joined = {c: F.array_join(c, "|") for c in ("authors", "tags", "formats", "languages")}
    own = ("id", "title", *joined, "series", "publisher", "rating_raw", "rating", "cover", "series_index", "comments", "timestamp", "pubdate", "uuid", *ids)
    return items.withColumns({**joined, **ids}).select(*own, F.col("#status").alias("status"), F.col("#pages").alias("pages"), F.col("#score").alias("score"), F.col("#lent").cast("boolean").alias("lent"))


@query(f"WITH {CATALOG_SQL} SELECT id, array_to_string(authors, ', ') AS authors FROM items WHERE len(authors) > 0")
def list_agg_authors(spark, sf_dir):
    return part_catalog(spark, sf_dir).items(only=("authors",)).where(F.size("authors") > 0).select("id", F.array_join("authors", ", ").alias("authors"))


@query("SELECT p_partkey AS id FROM part")
def library_ids(spark, sf_dir):
    return part_catalog(spark, sf_dir).ids()


@query("SELECT DISTINCT p_type || '.' || p_brand AS name FROM part UNION SELECT 'Size.' || p_size FROM part UNION SELECT 'Unused'")
def library_tags(spark, sf_dir):
    return part_catalog(spark, sf_dir).all_tags()


@query("SELECT p_type || '.' || p_brand AS name, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT 'Size.' || p_size, count(*) FROM part GROUP BY 1 UNION ALL SELECT 'Unused', 0")
def library_tag_counts(spark, sf_dir):
    own = part_catalog(spark, sf_dir)
    return reports.tag_counts(own.table("tags"), own.table("books_tags_link")).select("name", "n")


@query(f"WITH {CATALOG_SQL} SELECT 'isbn' AS type, isbn AS val FROM items WHERE id = 15 UNION ALL SELECT 'amazon', amazon FROM items WHERE id = 15")
def library_identifiers(spark, sf_dir):
    return part_catalog(spark, sf_dir).identifiers_of(15)


@query(f"WITH {CATALOG_SQL} SELECT id, title, path, isbn AS val FROM items WHERE isbn IS NOT NULL")
def library_isbn_books(spark, sf_dir):
    return part_catalog(spark, sf_dir).identified("isbn")


@query(f"WITH {CATALOG_SQL} SELECT id, f AS format, '/lib/' || path || '/f' || id || '.' || lower(f) AS path FROM (SELECT id, path, unnest(formats) AS f FROM items)")
def library_files(spark, sf_dir):
    return part_catalog(spark, sf_dir).book_files("/lib")


@query("SELECT p_partkey AS book, lower(p_type) || CASE WHEN p_partkey % 2 = 1 AND lower(p_type) < 'odd' THEN ',odd' ELSE '' END AS value FROM part WHERE p_partkey % 2 = 0 OR lower(p_type) < 'odd' UNION ALL SELECT p_partkey, 'odd,' || lower(p_type) FROM part WHERE p_partkey % 2 = 1 AND lower(p_type) > 'odd'")
def library_custom_values(spark, sf_dir):
    return part_catalog(spark, sf_dir).custom_values("Shelf").select("book", F.array_join("value", ",").alias("value"))


@query("SELECT unnest(['status', 'shelf', 'pages', 'done', 'lent', 'score']) AS label, unnest(['enumeration', 'text', 'int', 'datetime', 'bool', 'float']) AS datatype")
def library_custom_columns(spark, sf_dir):
    return spark.createDataFrame([(c["label"], c["datatype"]) for c in part_catalog(spark, sf_dir).custom_columns()], "label string, datatype string")


@query("SELECT unnest(" + str(sorted(CATALOG_VIEWS)) + ") AS view, unnest(" + str([CATALOG_VIEWS[v] for v in sorted(CATALOG_VIEWS)]) + ") AS expression")
def library_views(spark, sf_dir):
    return spark.createDataFrame(sorted(part_catalog(spark, sf_dir).views().items()), "view string, expression string")


@query("SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) || '.parquet' AS name")
def file_scan(spark, sf_dir):
    return files.stored(spark, sf_dir, ".parquet").select(F.substring_index("path", "/", -1).alias("name")).where("name not like '%.parquet.%'")


# Scopes and orders


@query(f"WITH {PART_SQL} SELECT id FROM items WHERE p_type = 'PROMO' OR p_size = 3")
def scope_branches(spark, sf_dir):
    return scope.in_branches(part_items(spark, sf_dir), ("PROMO", "Size.3", "size.4")).select("id")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey IN (1, 5, 9)")
def scope_ids(spark, sf_dir):
    return scope.with_ids(part_items(spark, sf_dir), [1, 5, 9, -1]).select("id")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 1)")
def scope_found_ids(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").where("l_quantity = 1").select("l_partkey")
    return scope.with_ids(part_items(spark, sf_dir), found).select("id")


@query(f"WITH {CATALOG_SQL} SELECT id FROM items WHERE status = 'Read' AND p_type = 'PROMO'")
def scope_view(spark, sf_dir):
    own = part_catalog(spark, sf_dir)
    return scope.in_view(own.items(only=("tags", "#status")), "Mine", own.registry()).select("id")


@query(f"WITH {PART_SQL} SELECT id, CASE WHEN p_type = 'PROMO' THEN p_type || '.' || p_brand ELSE 'Size.' || p_size END AS tag FROM items")
def display_tags(spark, sf_dir):
    return part_items(spark, sf_dir).select("id", scope.display_tag(F.col("tags"), ("PROMO", "Size")).alias("tag"))


@query(f"WITH {PART_SQL} SELECT id FROM items ORDER BY author_sort, title_sort, id LIMIT 50 OFFSET 100")
def order_library(spark, sf_dir):
    return reports.library_order(part_items(spark, sf_dir)).offset(100).limit(50).select("id")


@query(f"WITH {PART_SQL} SELECT id FROM items ORDER BY lower(author_sort), title_sort, author_sort, id LIMIT 50 OFFSET 100")
def order_catalog(spark, sf_dir):
    return reports.catalog(part_items(spark, sf_dir)).offset(100).limit(50).select("id")


@query("SELECT l_orderkey::VARCHAR AS series, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, series LIMIT 20 OFFSET 30")
def order_series(spark, sf_dir):
    rollup = reports.series_rollup(table(spark, sf_dir, "lineitem").withColumn("series", F.col("l_orderkey").cast("string")), "series", "l_linenumber", "l_returnflag")
    return reports.series_by(rollup, "size").offset(30).limit(20).select("series", "n")


@query("SELECT l_orderkey::VARCHAR AS series, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, series LIMIT 10")
def top_series(spark, sf_dir):
    return reports.top_series(table(spark, sf_dir, "lineitem").withColumn("series", F.col("l_orderkey").cast("string")))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def largest_files(spark, sf_dir):
    return reports.largest(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 25, "n_chars", "doc_id")


@query("SELECT least(25, count(*)) AS n FROM documents")
def sample_size(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return reports.sample(docs, 25).agg(F.countDistinct("id").alias("n"))


# Findings

_STAMP = "CASE WHEN p_size % 10 = 0 THEN '0101-01-01' WHEN p_size % 10 = 1 THEN 'soon' ELSE '20' || lpad(p_size::VARCHAR, 2, '0') || '-13-01' END"
_CHECK10 = " + ".join(f"{10 - i} * substr(lpad(p_partkey::VARCHAR, 9, '0'), {i + 1}, 1)::INT" for i in range(9))
_DATE_FINDINGS = f"SELECT CASE WHEN p_size % 10 = 0 THEN 'NO_SENTINEL_PUBDATE' ELSE 'PUBDATE_PARSEABLE' END AS code, CASE WHEN p_size % 10 = 0 THEN 'W' ELSE 'E' END AS severity, p_partkey::VARCHAR AS id, {_STAMP} AS message FROM part"
_PUBLISHER_FINDINGS = "SELECT DISTINCT 'PUBLISHER_NOT_CONSOLIDATED' AS code, 'W' AS severity, p_type AS id, 'goes by Large' AS message FROM part WHERE p_type IN ('PROMO', 'ECONOMY')"


def _date_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    stamp = F.when(size % 10 == 0, "0101-01-01").when(size % 10 == 1, "soon").otherwise(F.concat(F.lit("20"), F.lpad(size.cast("string"), 2, "0"), F.lit("-13-01")))
    return quality.date_findings(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), stamp.alias("pubdate")))


@query(_DATE_FINDINGS)
def lint_dates(spark, sf_dir):
    return _date_findings(spark, sf_dir)


@query(f"SELECT 'AMAZON_IS_ISBN10' AS code, 'W' AS severity, p_partkey::VARCHAR AS id, lpad(p_partkey::VARCHAR, 9, '0') || CASE WHEN p_partkey % 10 = 0 THEN 'X' ELSE (p_partkey % 10)::VARCHAR END AS message FROM part WHERE p_partkey % 5 = 0 AND ({_CHECK10} + CASE WHEN p_partkey % 10 = 0 THEN 10 ELSE p_partkey % 10 END) % 11 = 0")
def lint_amazon(spark, sf_dir):
    return quality.amazon_findings(part_catalog(spark, sf_dir).table("identifiers"))


@query(_PUBLISHER_FINDINGS)
def lint_publishers(spark, sf_dir):
    return quality.publisher_findings(part_catalog(spark, sf_dir).table("publishers"), {"Large": ["PROMO", "ECONOMY", "none such"]})


@query(f"WITH {CATALOG_SQL} SELECT 'FORMAT_FICTION_PDF' AS code, 'W' AS severity, id::VARCHAR AS id, CASE WHEN p_type = 'PROMO' AND p_size = 3 THEN 'PROMO.' || p_brand || ', Size.3' WHEN p_size = 3 THEN 'Size.3' ELSE 'PROMO.' || p_brand END AS message FROM items WHERE list_contains(formats, 'PDF') AND NOT list_contains(formats, 'EPUB') AND (p_type = 'PROMO' OR p_size = 3)")
def lint_pdf_only(spark, sf_dir):
    return quality.pdf_only_findings(part_catalog(spark, sf_dir).items(only=("tags", "formats")), ("PROMO", "Size.3"))


@query(f"WITH f AS ({_DATE_FINDINGS} UNION ALL {_PUBLISHER_FINDINGS}), r AS (SELECT *, row_number() OVER (PARTITION BY severity, code ORDER BY try_cast(id AS BIGINT), id) AS rank, count(*) OVER (PARTITION BY severity, code) AS total FROM f) SELECT code, severity, id, message, rank::INT AS rank, total FROM r WHERE rank <= 5")
def lint_shown(spark, sf_dir):
    return quality.shown(_date_findings(spark, sf_dir).union(lint_publishers(spark, sf_dir)))


@query(f"WITH f AS ({_DATE_FINDINGS} UNION ALL {_PUBLISHER_FINDINGS}) SELECT * FROM f ORDER BY severity, code, id LIMIT 40 OFFSET 10")
def lint_by_severity(spark, sf_dir):
    return quality.by_severity(_date_findings(spark, sf_dir).union(lint_publishers(spark, sf_dir))).offset(10).limit(40)


@query("SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def lint_semi(spark, sf_dir):
    marked = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return quality.linked(table(spark, sf_dir, "orders"), marked, "o_orderkey", "l_orderkey").select(F.col("o_orderkey").alias("id"))


@query("SELECT id, concat_ws('; ', CASE WHEN k < 2 THEN 'deprecated_format_only' END, CASE WHEN k > 2 THEN 'no_file' END, CASE WHEN NOT cover THEN 'no_cover' END, CASE WHEN cover AND w IS NULL THEN 'cover_file_missing' END, CASE WHEN cover AND w < 500 THEN 'low_res_cover(' || w || 'x' || w // 2 || ')' END) AS issues FROM (SELECT p_partkey AS id, p_partkey % 4 AS k, p_size % 2 = 1 AS cover, CASE WHEN p_partkey % 7 <> 0 THEN p_size * 20 END AS w FROM part WHERE p_size % 11 <> 0) WHERE k <> 2 OR NOT cover OR w IS NULL OR w < 500")
def audit_files_and_covers(spark, sf_dir):
    k, size = F.col("id") % 4, F.col("series_index").cast("int")
    formats = F.when(k == 0, F.array(F.lit("MOBI"), F.lit(" lit"))).when(k == 1, F.array(F.lit("azw"))).when(k == 2, F.array(F.lit("MOBI"), F.lit("EPUB"))).otherwise(F.array().cast("array<string>"))
    items = part_items(spark, sf_dir).where("rating is not null").withColumns({"formats": formats, "authors": F.array("author_sort")})
    covers = part_items(spark, sf_dir).where("id % 7 <> 0").select("id", (size * 20).alias("width"), (size * 10).alias("height"))
    return quality.item_issues(items, covers).select("id", F.array_join("issues", "; ").alias("issues"))


@query(f"WITH {PART_SQL}, own AS (SELECT id::VARCHAR AS id, title, author_sort AS author, 'book' AS issue_type, concat_ws(', ', CASE WHEN rating IS NULL THEN 'unrated' END, 'no_file', CASE WHEN NOT cover THEN 'no_cover' END) AS issues FROM items), twice AS (SELECT string_agg(id, ', ' ORDER BY id) AS id, array_to_string(list_transform(string_split(title, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title, upper(publisher[1]) || lower(publisher[2:]) AS author, 'duplicate' AS issue_type, 'duplicate_books' AS issues FROM items GROUP BY title, publisher HAVING count(*) > 1), have AS (SELECT DISTINCT series, p_size FROM items), gap AS (SELECT series, i FROM (SELECT series, unnest(range(1, max(p_size) + 1)) AS i FROM have GROUP BY 1) w WHERE (series, i) NOT IN (SELECT (series, p_size) FROM have)) SELECT * FROM own UNION ALL SELECT * FROM twice UNION ALL SELECT '', series, '', 'series_gap', 'missing indices: ' || string_agg(i, ', ' ORDER BY i) FROM gap GROUP BY series")
def audit_csv(spark, sf_dir):
    items = part_items(spark, sf_dir).withColumns({"authors": F.array("publisher"), "formats": F.array().cast("array<string>")})
    return export.audit_rows(quality.audit(items))


@query(f"WITH {PART_SQL}, g AS (SELECT id, min(id) OVER w AS first, count(*) OVER w AS n FROM items WINDOW w AS (PARTITION BY lower(trim(title)), lower(publisher))) SELECT * FROM g WHERE n > 1")
def duplicate_members(spark, sf_dir):
    return quality.duplicate_members(part_items(spark, sf_dir).withColumn("authors", F.array("publisher")))


_ADVICE = "CASE WHEN mb < 50 THEN 'skip-small' WHEN dpi IS NULL THEN 'manual' WHEN opt AND mb < 200 AND dpi <= 200 THEN 'skip-optimized' WHEN dpi < 150 THEN 'skip-already-low-dpi' WHEN js OR dpi < 250 THEN 'printer' ELSE 'ebook' END"
_SCANS = "SELECT p_partkey AS id, p_size * 7 AS mb, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 50 * 9 END AS dpi, p_partkey % 3 = 0 AS opt, p_partkey % 5 = 0 AS js FROM part"


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("id"), (F.col("p_size") * 7 * (1 << 20)).cast("long").alias("size"), F.lit("none").alias("form"), (key % 5 == 0).alias("javascript"), F.lit(0).alias("attachments"), (key % 3 == 0).alias("optimized"), F.when(key % 4 != 0, key % 50 * 9).cast("int").alias("avg_dpi"))


@query(f"SELECT id, {_ADVICE} AS advice, CASE WHEN dpi >= 150 THEN floor(100 * (1 - pow(150.0::DOUBLE / dpi, 2)))::INT END AS estimate FROM ({_SCANS})")
def pdf_advice(spark, sf_dir):
    return files.compression_advice(_scans(spark, sf_dir)).select("id", "advice", "estimate")


@query(f"WITH a AS (SELECT mb::BIGINT * 1048576 AS size, dpi, {_ADVICE} AS advice FROM ({_SCANS})) SELECT advice, count(*) AS files, sum(size)::BIGINT AS bytes, sum(CASE advice WHEN 'ebook' THEN floor(size * (floor(100 * (1 - pow(150.0::DOUBLE / dpi, 2))) * 0.85::DOUBLE) / 100) WHEN 'printer' THEN floor(size * (CASE WHEN dpi > 300 THEN floor(100 * (1 - pow(300.0::DOUBLE / dpi, 2))) ELSE 30 END * 0.75::DOUBLE) / 100) ELSE 0 END)::BIGINT AS saved FROM a GROUP BY 1")
def pdf_summary(spark, sf_dir):
    return reports.compression_summary(files.compression_advice(_scans(spark, sf_dir)))


# Lints of texts


def _built(spark: SparkSession, sf_dir: str, *cases: Column) -> DataFrame:
    """(id, text): each part with one of the cases, by its key."""
    key, found = F.col("p_partkey") % len(cases), cases[-1]
    for i, case in enumerate(cases[:-1]):
        found = F.when(key == i, case).otherwise(found)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), found.alias("text"))


@query("SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 1 THEN 'TITLE_WHITESPACE' WHEN 2 THEN 'TITLE_MOJIBAKE' WHEN 3 THEN 'TITLE_CASE_GARBLE:HTMlish' WHEN 4 THEN 'TITLE_WHITESPACE' ELSE '' END AS flags FROM part")
def lint_titles(spark, sf_dir):
    name = F.col("p_name")
    rows = _built(spark, sf_dir, name, F.concat(name, F.lit("  x")), F.concat(F.lit("cafÃ© "), name), F.concat(name, F.lit(" SQLite HTMlish")), F.concat(F.lit(" "), name))
    return rows.select("id", F.array_join(quality.title_flags(F.col("text")), ",").alias("flags"))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 1 THEN 'AUTHOR_JUNK:' || p_name || ' Press' WHEN 2 THEN 'AUTHOR_MISSING' WHEN 3 THEN 'AUTHOR_CROWD:5' ELSE '' END AS flags FROM part")
def lint_authors(spark, sf_dir):
    name, none = F.col("p_name"), F.array().cast("array<string>")
    rows = _built(spark, sf_dir, F.array(name), F.array(F.concat(name, F.lit(" Press"))), none, F.array_repeat(name, 5))
    return rows.select("id", F.array_join(quality.author_flags(F.col("text")), ",").alias("flags"))


@query("WITH w AS (SELECT DISTINCT lower(regexp_extract(text, '^\\p{L}+')) AS w FROM documents), t AS (SELECT doc_id, lower(regexp_extract(text, '([\\p{L}''’]+)\\n?$', 1)) AS last FROM documents WHERE length(text) >= 120) SELECT doc_id FROM t WHERE last <> '' AND regexp_replace(last, '[''’]+$', '') NOT IN (SELECT w FROM w)")
def lint_truncated(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.truncated(docs, "text", docs.select(F.regexp_extract("text", r"^\p{L}+", 0).alias("word")).where("word is not null"), "word").select("doc_id")


_VERDICT = "CASE WHEN o_orderkey % {} = 0 THEN 'BAD' ELSE 'OK' END"
_LEDGER = f"SELECT o_orderkey AS id, {_VERDICT.format(3)} AS title, {_VERDICT.format(5)} AS author, {_VERDICT.format(7)} AS comment, o_orderpriority AS note FROM orders"


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    bad = lambda n: F.when(key % n == 0, "bad").otherwise("OK")
    line = F.concat_ws("\t", key.cast("string"), bad(3), bad(5), bad(7), "o_orderpriority")
    return quality.parse_verdicts(table(spark, sf_dir, "orders").select(line.alias("value")).union(spark.createDataFrame([("# a remark",), ("",), ("id,title,author,comment",)], "value string")))


@query(_LEDGER)
def verdict_lines(spark, sf_dir):
    return _ledger(spark, sf_dir).where("error is null").drop("error")


@query(f"SELECT count(*) AS judged, count_if(title = 'BAD' OR author = 'BAD' OR comment = 'BAD')::BIGINT AS bad FROM ({_LEDGER})")
def ledger_counts(spark, sf_dir):
    return quality.ledger_summary(_ledger(spark, sf_dir))


@query(" UNION ALL ".join(f"SELECT id, '{f}' AS field, note FROM ({_LEDGER}) WHERE {f} = 'BAD'" for f in ("title", "author", "comment")))
def review_worklist(spark, sf_dir):
    return quality.worklist(_ledger(spark, sf_dir))


_SUM13 = " + ".join(f"{3 if i % 2 else 1} * substr('978' || lpad(p_partkey::VARCHAR, 9, '0'), {i + 1}, 1)::INT" for i in range(12))
_ISBN13 = f"'978' || lpad(p_partkey::VARCHAR, 9, '0') || ((10 - ({_SUM13}) % 10) % 10)::VARCHAR"


@query(f"SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 2 THEN '' ELSE {_ISBN13} END AS every, CASE p_partkey % 4 WHEN 0 THEN {_ISBN13} ELSE '' END AS own FROM part")
def isbn_printed(spark, sf_dir):
    number = isbn.isbn13(F.concat(F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("x")))
    wrong = F.concat(F.substring(number, 1, 12), F.pmod(F.substring(number, 13, 1).cast("int") + 1, F.lit(10)).cast("string"))
    far = F.repeat(F.lit("lorem ipsum dolor "), 40)
    rows = _built(spark, sf_dir, F.concat(F.lit("Copyright 2001. ISBN "), number), F.concat(F.lit("See also ISBN-13: "), number, far), F.concat(F.lit("ISBN "), wrong), F.concat(F.lit("Printed in Ghent. "), far, F.lit("ISBN: "), number))
    return rows.withColumn("p", isbn.printed(F.col("text"))).select("id", F.array_join("p.every", ",").alias("every"), F.array_join("p.own", ",").alias("own"))


@query(f"SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN {_ISBN13} WHEN 1 THEN '9791234567890' ELSE '' END AS isbn FROM part")
def isbn_for_export(spark, sf_dir):
    rows = _built(spark, sf_dir, F.concat(F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("-X")), F.lit("979-1234567890"), F.lit("12345"))
    return rows.select("id", isbn.isbn13_or_blank(F.col("text")).alias("isbn"))


@query("SELECT p_partkey AS id, upper(p_name[1]) || p_name[2:] AS cased, '2020-01-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') || ' 10:00:00' AS day, 'é' || p_name AS octal FROM (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS p_name FROM part)")
def text_families(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.upper(F.substring_index("p_name", " ", 1)).alias("n"))
    day = F.concat(F.lit("2020:01:"), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0"), F.lit(" 10:00:00"))
    return rows.select(F.col("p_partkey").alias("id"), text.title_case(F.col("n")).alias("cased"), dates.dashed(day).alias("day"), text.from_octal(F.concat(F.lit("\\303\\251"), F.lower("n"))).alias("octal"))


@query("SELECT p_partkey AS id, CASE WHEN n >= 1073741824 THEN format('{:,.2f}', n / 1073741824) || ' GB' WHEN n >= 1048576 THEN format('{:,.1f}', n / 1048576) || ' MB' ELSE format('{:,.0f}', n / 1024) || ' KB' END AS size, repeat('█', (p_size * 40 // 50)::INT) AS bar, repeat('#', round_even(20.0 * p_size / 50, 0)::INT) AS share, CASE WHEN p_size > 25 THEN ' <Pages: ' || p_size || '>' ELSE '' END AS suffix FROM (SELECT p_partkey, p_size, (pow(p_partkey + 1, 3) * 1001 + 1)::BIGINT AS n FROM part)")
def display_scalars(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    # The number passes a long from key 209,645 on: exact in decimals, rounded once to a double; past 38 digits in doubles alone.
    one = key.cast("decimal(38,0)") + 1
    exact = F.try_add(F.try_multiply(F.try_multiply(F.try_multiply(one, one), one), F.lit(1001)), F.lit(1))
    number = F.coalesce(exact.cast("double"), F.pow(one.cast("double"), F.lit(3)) * 1001 + 1)
    pages = F.when(size > 25, size).when(size > 20, 0)
    return table(spark, sf_dir, "part").select(key.alias("id"), display.human_size(number).alias("size"), display.bar(size, F.lit(50)).alias("bar"), display.share_bar(size, F.lit(50)).alias("share"), display.value_suffix("Pages", pages).alias("suffix"))


@query("SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words FROM (SELECT doc_id, w, i FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+'), 1) AS i FROM documents)) GROUP BY 1")
def wrapped_words(spark, sf_dir):
    lines = display.wrapped(F.col("text"))
    docs = table(spark, sf_dir, "documents").where(F.trim("text") != "")
    return docs.select("doc_id", text.collapse(lines).alias("words"), F.exists(F.split(lines, "\n"), lambda x: (F.length(x) > 98) & F.trim(x).contains(" ")).alias("long")).where("not long").drop("long")


# Files

def _archive(**members: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/").replace("_", "."), body)
    return out.getvalue()


def _book(page: bool = True, **more: str) -> bytes:
    """An EPUB of one page; page: whether that page is there."""
    opf = '<package><manifest><item id="a" href="p.html"/></manifest><spine><itemref idref="a"/></spine></package>'
    return _archive(**{"META-INF__container_xml": '<container><rootfile full-path="c.opf"/></container>', "c_opf": opf, **({"p_html": "x" * 40_000} if page else {}), **more})


def _of_parts(spark: SparkSession, sf_dir: str, cases: list[tuple[str, bytes]]) -> DataFrame:
    """(id, path, content): each part with one of the files, by its key; the files are a literal of a few kilobytes."""
    held = F.array(*(F.struct(F.lit(ext).alias("e"), F.lit(bytearray(body)).alias("b")) for ext, body in cases))
    one = F.get(held, (F.col("p_partkey") % len(cases)).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("f"), F.col("p_partkey"), F.lit("."), one["e"]).alias("path"), one["b"].alias("content"))


def _cases(columns: str, *values: str) -> str:
    """The same in SQL: one row of values for each part."""
    return f"SELECT p_partkey AS id, {columns} FROM part JOIN (VALUES {', '.join(f'({i}, {v})' for i, v in enumerate(values))}) v(k, a, b) ON p_partkey % {len(values)} = v.k"


_MOBI = lambda kind: b"\0" * 76 + (1).to_bytes(2) + (82).to_bytes(4) + b"\0" * 12 + kind.to_bytes(2) + b"\0" * 8
_LOCKED = '<encryption><EncryptedData><EncryptionMethod Algorithm="x"/><CipherReference URI="p.html"/></EncryptedData></encryption>'


@query(_cases("a AS status, b AS kind", "'CLEAN', ''", "'DRM', 'encrypted content'", "'ERROR', 'unreadable'", "'CLEAN', ''", "'DRM', 'FileOpen'", "'BENIGN', 'encrypted-unclassified'", "'CLEAN', ''", "'DRM', 'Mobipocket'", "'ERROR', 'unreadable'", "'N/A', ''"))
def file_locks(spark, sf_dir):
    cases = [("epub", _book()), ("epub", _book(**{"META-INF__encryption_xml": _LOCKED})), ("epub", b"no zip"), ("pdf", b"%PDF-1.4 %%EOF"), ("pdf", b"%PDF-1.4 FOPN_fLock"), ("pdf", b"%PDF-1.4 /Encrypt 1"), ("mobi", _MOBI(0)), ("azw3", _MOBI(2)), ("prc", b"short"), ("txt", b"text")]
    rows = _of_parts(spark, sf_dir, cases)
    return files.locks(rows).select(F.regexp_extract("path", r"\d+", 0).cast("long").alias("id"), "status", "kind")


@query(_cases("a AS flags", "'', 0", "'EPUB_SPINE_MISSING:1/1,EPUB_THIN_TEXT:0B', 0", "'EPUB_BADZIP:BadZipFile', 0", "'EPUB_NO_CONTAINER', 0", "'', 0", "'PDF_BAD_HEADER', 0", "'PDF_NO_EOF', 0"))
def file_integrity(spark, sf_dir):
    cases = [("epub", _book()), ("epub", _book(page=False)), ("epub", b"no zip"), ("epub", _archive(a_txt="x")), ("pdf", b"%PDF-1.4 text %%EOF"), ("pdf", b"text %%EOF"), ("pdf", b"%PDF-1.4 text")]
    return files.file_flags(_of_parts(spark, sf_dir, cases)).select(F.regexp_extract("path", r"\d+", 0).cast("long").alias("id"), F.array_join("flags", ",").alias("flags"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 < 2 THEN p_size + 300 END AS width, CASE WHEN p_partkey % 3 < 2 THEN p_size * 7 END AS height FROM part")
def image_sizes(spark, sf_dir):
    number = lambda c, digits: F.lpad(F.hex(c.cast("long")), digits, "0")
    w, h = F.col("p_size") + 300, F.col("p_size") * 7
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(w, 8), number(h, 8))
    jpeg = F.concat(F.lit("FFD8FFE000040000FFC0001108"), number(h, 4), number(w, 4), F.lit("03000000000000000000"))
    rows = _built(spark, sf_dir, png, jpeg, F.lit("47494638"))
    return rows.withColumn("s", files.image_size(F.unhex("text"))).select("id", "s.width", "s.height")


@query(_cases("a AS state, b AS text", "'READ', 'first'", "'UNREADABLE', NULL", "'SKIPPED', NULL", "'READ', 'second'"))
def first_readable_file(spark, sf_dir):
    read = {"epub": lambda b: {"text": b.decode("ascii")}, "pdf": lambda b: {"text": b.decode("ascii")}}
    first = _of_parts(spark, sf_dir, [("epub", b"first"), ("epub", b"\xff"), ("mobi", b"x"), ("epub", b"")])
    second = _of_parts(spark, sf_dir, [("pdf", b"second"), ("pdf", b""), ("azw", b"x"), ("pdf", b"second")])
    found = files.read_with(first.union(second), read, "text string", ("id", "path"))
    return files.first_readable(found).select("id", "state", "text")


@query(f"WITH {CATALOG_SQL} SELECT '/lib/' || path || '/f' || id || '.' || lower(f) AS path, 'FILE_MISSING' AS flags FROM (SELECT id, path, unnest(formats) AS f FROM items) WHERE f <> 'EPUB'")
def file_missing(spark, sf_dir):
    listed = part_catalog(spark, sf_dir).book_files("/lib")
    return files.missing_files(listed, listed.where("format = 'EPUB'").select("path")).select("path", F.array_join("flags", ",").alias("flags"))


# Look-ups


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'QA' || p_size WHEN 2 THEN 'Z' END AS lcc, CASE p_partkey % 3 WHEN 0 THEN '5' || p_size WHEN 1 THEN '6' END AS ddc FROM part")
def class_codes(spark, sf_dir):
    mark = lambda kind, body: F.concat(F.lit(f'<m:classification authority="{kind}">'), body, F.lit("</m:classification>"))
    record = lambda *parts: F.concat(F.lit("<m:mods>"), *parts, F.lit("</m:mods>"))
    size = F.col("p_size").cast("string")
    whole = lambda *parts: F.concat(F.lit('<r xmlns:m="http://www.loc.gov/mods/v3">'), *parts, F.lit("</r>"))
    rows = _built(spark, sf_dir, whole(record(mark("ddc", F.concat(F.lit("5"), size))), record(mark("lcc", F.concat(F.lit(" QA"), size)), mark("ddc", F.lit("9")))), whole(record(mark("lcc", F.lit(" ")), mark("ddc", F.lit("6")))), whole(record(mark("lcc", F.lit("Z"))), record()))
    return rows.withColumn("c", lookup.class_codes(F.col("text"))).select("id", "c.lcc", "c.ddc")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'known' WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 <> 0 THEN 'asked ' || c_custkey END AS answer FROM customer")
def lookup_answers(spark, sf_dir):
    def ask(key):
        if key % 3 == 0:
            raise OSError("no answer")
        return None if key % 5 == 0 else {"answer": f"asked {key}"}

    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    cache = keys.where("id % 2 = 0").withColumn("answer", F.lit("known"))
    return lookup.lookup(keys, cache, "id", lookup.patient(ask, "id", ["id", "answer"], sleep=lambda s: None))[0]


# Exports

@query(f"WITH {CATALOG_SQL} SELECT id, to_json(struct_pack(id := id, title := title, authors := authors, author_sort := author_sort, tags := tags, series := series, series_index := series_index, formats := formats, rating := rating, publisher := publisher, languages := languages, added := substr(timestamp, 1, 10), has_cover := cover))::VARCHAR AS line FROM items")
def export_json(spark, sf_dir):
    rows = export.records(part_catalog(spark, sf_dir).items(custom=False))
    return rows.select("id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))


@query(f"WITH {PART_FULL_SQL} SELECT id, title, array_to_string(authors, ', ') AS authors, author_sort, array_to_string(tags, ', ') AS tags, series, series_index::VARCHAR AS series_index, array_to_string(formats, ', ') AS formats, coalesce(rating::VARCHAR, '') AS rating, publisher, '' AS languages, coalesce(timestamp, '') AS added, cover::INT AS has_cover FROM items")
def export_csv_projection(spark, sf_dir):
    return export.csv_rows(part_items_full(spark, sf_dir))


@query(f"WITH {PART_SQL} SELECT id, array_to_string(tags, ', ') || CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN ', translator:Ann' ELSE ', translator:Ann, translator:Bo Li, translator:C' END AS tags FROM items")
def lt_translators(spark, sf_dir):
    key = F.col("id") % 3
    items = part_items(spark, sf_dir).withColumn("by", F.when(key == 1, "Ann").when(key == 2, "Ann|Bo Li, C,"))
    return export.lt_rows(items, {"translators": "by"}).select("id", F.col("c6").alias("tags"))


@query(f"WITH {CATALOG_SQL} SELECT count(*) AS rows, count(isbn) AS with_isbn, count(pages) AS with_pages, 0::BIGINT AS with_call_number FROM items")
def lt_summary(spark, sf_dir):
    items = part_catalog(spark, sf_dir).items(only=("authors", "tags", "publisher", "rating", "identifiers", "#pages"))
    return export.lt_summary(export.lt_rows(items, {"pages": "#pages"}, call_numbers=True))


@query(_cases("a::BIGINT AS line, b AS problem", "1, 'another header'", "2, '3 columns'", "2, 'ISBN shape'", "3, 'no title'").replace("SELECT p_partkey AS id", "SELECT 'f' || p_partkey || '.csv' AS path") + " UNION ALL SELECT 'f' || p_partkey || '.csv', 1, 'columns out of line' FROM part WHERE p_partkey % 4 = 0")
def lt_file_check(spark, sf_dir):
    head = export.LT_HEADER + "\n"
    row = lambda title="T", number="": f"{title},A,2001,{number},P,t,4,,,,\n"
    cases = [("csv", b"TITLE,A\n"), ("csv", (head + "a,b,c\n").encode()), ("csv", (head + row(number="12")).encode()), ("csv", (head + row(number="9780306406157") + row(title=" ")).encode())]
    return export.lt_file_problems(_of_parts(spark, sf_dir, cases))


@query(f"WITH {PART_SQL}, h AS (SELECT count(*) AS n FROM items WHERE p_type = 'PROMO') SELECT 0 AS place, 'Search Query: tags:PROMO' AS line UNION ALL SELECT 1, 'Matches: ' || n FROM h UNION ALL SELECT 2, repeat('=', 40) UNION ALL SELECT 3, '' UNION ALL SELECT 4, '  * ' || title || ' - ' || author_sort || ' <Size: ' || p_size || '>' FROM items WHERE p_type = 'PROMO'")
def export_listing(spark, sf_dir):
    items = scope.in_branches(part_items(spark, sf_dir), ("PROMO",))
    return export.listing(items, "tags:PROMO", display.value_suffix("Size", F.col("series_index").cast("int"))).select("place", "line")


_STARS = "repeat('★', (rating_raw // 2)::INT) || repeat('½', (rating_raw % 2)::INT) || repeat('☆', (5 - rating_raw // 2 - rating_raw % 2)::INT)"


@query(f"WITH {CATALOG_SQL}, n AS (SELECT lower(author_sort) AS k, arg_min(CASE WHEN len(authors) > 0 THEN array_to_string(authors, ' & ') ELSE 'Unknown Author' END, (title_sort, author_sort, id)) AS name FROM items GROUP BY 1) SELECT 0 AS place, 0 AS part, '' AS author_key, 'Catalog' AS line UNION ALL SELECT 0, 1, '', '=======' UNION ALL SELECT 1, 0, k, '' FROM n UNION ALL SELECT 1, 1, k, '[' || name || ']' FROM n UNION ALL SELECT 1, 2, k, repeat('-', (length(name) + 2)::INT) FROM n UNION ALL SELECT 1, 3, lower(author_sort), '  * [' || id || '] ' || title || coalesce(' (' || series || ' #' || p_size || ')', '') || CASE WHEN len(formats) > 0 THEN ' [' || array_to_string(formats, ',') || ']' ELSE '' END || coalesce(' [' || {_STARS} || ' ' || rating::VARCHAR || '/5]', '') FROM items UNION ALL SELECT 2, 0, '', '' UNION ALL SELECT 2, 1, '', repeat('=', 40) UNION ALL SELECT 2, 2, '', 'Total: ' || count(*) || ' books' FROM items")
def export_catalog(spark, sf_dir):
    items = part_catalog(spark, sf_dir).items(custom=False)
    return export.catalog_text(items, "Catalog", with_id=True).select("place", "part", "author_key", "line")


@query("SELECT l_orderkey AS series, count(*) AS n, max(l_linenumber)::DOUBLE AS last, string_agg(DISTINCT l_linenumber, ',' ORDER BY l_linenumber) AS indices, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS titles FROM lineitem GROUP BY 1")
def series_rollup(spark, sf_dir):
    rollup = reports.series_rollup(table(spark, sf_dir, "lineitem").withColumn("l_orderkey", F.col("l_orderkey").cast("string")), "l_orderkey", "l_linenumber", "l_returnflag")
    return rollup.select(F.col("series").cast("long").alias("series"), "n", "last", F.array_join(F.transform("indices", lambda x: x.cast("int").cast("string")), ",").alias("indices"), F.array_join("titles", ",").alias("titles"))


_PLAIN = "trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '<style[^>]*>.*?</style>', ' ', 'gs'), '<[^>]+>', ' ', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '^\\s+', ''), '\\s+$', ''))"


@query(f"WITH p AS (SELECT doc_id, {_PLAIN} AS t FROM documents) SELECT doc_id AS id, 'COMMENT_STUB:' || length(t) AS flags FROM p WHERE length(t) BETWEEN 1 AND 119")
def lint_comment_stub(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.get(F.filter(quality.comment_flags(F.col("text")), lambda f: f.startswith("COMMENT_STUB")), F.lit(0)).alias("flags")).where("flags is not null")
