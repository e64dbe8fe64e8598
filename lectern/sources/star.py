"""The test tables as catalogs: parts as items or in a catalog's normalised tables, documents as items."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.display import stars
from lectern.sources.library import Library


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as items: all fields that the part table itself gives."""
    p = table(spark, sf_dir, "part")
    raw = F.pmod("p_size", F.lit(11)).cast("int")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_name").alias("title_sort"), F.col("p_brand").alias("author_sort"),
        F.array(F.concat_ws(".", "p_type", "p_brand"), F.concat(F.lit("Size."), F.col("p_size").cast("string"))).alias("tags"),
        raw.alias("rating_raw"), stars(raw).alias("rating"), F.col("p_brand").alias("series"), F.col("p_size").cast("double").alias("series_index"),
        F.col("p_type").alias("publisher"), (F.col("p_size") % 2 == 1).alias("cover"),
        F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")).alias("identifiers"),
    )


def part_items_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as items with authors (suppliers), formats (return flags) and dates, each gathered before it is joined."""
    sold = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", "l_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    names = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    authors = sold.select("l_partkey", "l_suppkey").distinct().join(names, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_partkey").alias("a")).agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x["s_name"]).alias("authors"))
    rest = (
        sold.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy(F.col("l_partkey").alias("r"))
        .agg(F.array_sort(F.collect_set("l_returnflag")).alias("formats"), F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("timestamp"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("pubdate"))
    )
    none = F.array().cast("array<string>")
    out = part_items(spark, sf_dir).join(authors, F.col("id") == F.col("a"), "left").join(rest, F.col("id") == F.col("r"), "left").drop("a", "r")
    return out.withColumns({"authors": F.coalesce("authors", none), "formats": F.coalesce("formats", none)})


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("comments"), F.array("lang").alias("languages"), F.col("source").alias("publisher"))


#: The same bindings as common table expressions in DuckDB's SQL.
PART_SQL = """items AS (
  SELECT p_partkey AS id, p_name AS title, p_name AS title_sort, p_brand AS author_sort, [p_type || '.' || p_brand, 'Size.' || p_size] AS tags,
    p_size % 11 AS rating_raw, CASE WHEN p_size % 11 = 0 THEN NULL ELSE (p_size % 11) / 2.0 END::DOUBLE AS rating, p_brand AS series, p_size::DOUBLE AS series_index,
    p_type AS publisher, p_size % 2 = 1 AS cover, p_brand, p_type, p_size FROM part)"""
PART_FULL_SQL = (
    PART_SQL.replace("items AS", "light AS")
    + """, au AS (
  SELECT l_partkey, list(s_name ORDER BY s_suppkey) AS authors FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey
), re AS (
  SELECT l_partkey, list(DISTINCT l_returnflag ORDER BY l_returnflag) AS formats, strftime(min(l_shipdate), '%Y-%m-%d') AS timestamp, strftime(min(o_orderdate), '%Y-%m-%d') AS pubdate
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey
), items AS (
  SELECT light.*, coalesce(authors, []) AS authors, coalesce(formats, []) AS formats, timestamp, pubdate FROM light LEFT JOIN au ON id = au.l_partkey LEFT JOIN re ON id = re.l_partkey)"""
)


def _catalog_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    p, sold = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    key, size = F.col("p_partkey"), F.col("p_size")
    text = lambda *cs: F.concat(*(c if not isinstance(c, str) else F.lit(c) for c in cs))
    own = lambda *names: p.select(*names)
    raw = F.pmod(size, F.lit(11)).cast("int")
    tags = own(key.alias("id"), key.alias("book"), F.explode(F.array(F.concat_ws(".", "p_type", "p_brand"), text("Size.", size.cast("string")))).alias("tag"))
    formats = F.when(F.col("l_returnflag") == "A", "EPUB").when(F.col("l_returnflag") == "N", "PDF").otherwise("MOBI")
    ids = own(key.alias("book"), F.lit("isbn").alias("type"), text("978", F.lpad(key.cast("string"), 9, "0"), "0").alias("val")).where("book % 4 <> 0")
    shops = own(key.alias("book"), F.lit("amazon").alias("type"), text(F.lpad(key.cast("string"), 9, "0"), F.when(key % 10 == 0, "X").otherwise((key % 10).cast("string"))).alias("val")).where("book % 5 = 0")
    names = p.select("p_type").distinct()
    return {
        "books": own(
            key.alias("id"), F.col("p_name").alias("title"), F.col("p_name").alias("sort"), F.col("p_brand").alias("author_sort"), (size % 2).alias("has_cover"), size.cast("double").alias("series_index"),
            text("2021-", F.lpad((size % 12 + 1).cast("string"), 2, "0"), "-15 10:00:00+00:00").alias("timestamp"),
            F.when(size % 10 == 0, "0101-01-01 00:00:00+00:00").otherwise(text((size + 1950).cast("string"), "-06-01 00:00:00+00:00")).alias("pubdate"), text("shelf/", key.cast("string")).alias("path"), F.md5(key.cast("string")).alias("uuid"),
        ),
        "authors": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        "books_authors_link": sold.select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("book"), F.col("l_suppkey").alias("author")).distinct(),
        "tags": tags.select(F.col("tag").alias("id"), F.col("tag").alias("name")).distinct().union(spark.range(1).select(F.lit("Unused"), F.lit("Unused"))), "books_tags_link": tags,
        "series": own(F.col("p_brand").alias("id"), F.col("p_brand").alias("name")).distinct(), "books_series_link": own(key.alias("id"), key.alias("book"), F.col("p_brand").alias("series")).where("book % 3 <> 0"),
        "publishers": names.select(F.col("p_type").alias("id"), F.col("p_type").alias("name")), "books_publishers_link": own(key.alias("id"), key.alias("book"), F.col("p_type").alias("publisher")),
        "ratings": spark.range(11).select(F.col("id").cast("int").alias("id"), F.col("id").cast("int").alias("rating")), "books_ratings_link": own(key.alias("id"), key.alias("book"), raw.alias("rating")),
        "languages": spark.createDataFrame([(0, "eng"), (1, "fra")], "id long, lang_code string"), "books_languages_link": own(key.alias("id"), key.alias("book"), (key % 2).alias("lang_code")),
        "data": sold.select(F.col("l_partkey").alias("book"), formats.alias("format"), text("f", F.col("l_partkey").cast("string")).alias("name")).distinct(),
        "identifiers": ids.union(shops), "comments": own(key.alias("book"), text("<p>About ", F.col("p_name"), "</p>").alias("text")).where(size % 7 != 0),
        "preferences": spark.createDataFrame([("virtual_libraries", json.dumps(CATALOG_VIEWS))], "key string, val string"),
        "custom_columns": spark.createDataFrame([(1, "status", "Status", "enumeration", False), (2, "shelf", "Shelf", "text", True), (3, "pages", "Pages", "int", False), (4, "done", "Done", "datetime", False), (5, "lent", "Lent", "bool", False), (6, "score", "Score", "float", False)], "id int, label string, name string, datatype string, is_multiple boolean"),
        "custom_column_1": spark.createDataFrame([(1, "Read"), (2, "Unread")], "id long, value string"), "books_custom_column_1_link": own(key.alias("book"), (F.col("p_partkey") % 3).alias("value")).where("value > 0"),
        "custom_column_2": names.select(F.col("p_type").alias("id"), F.lower("p_type").alias("value")).union(spark.range(1).select(F.lit("odd"), F.lit("odd"))),
        "books_custom_column_2_link": own(key.alias("book"), F.col("p_type").alias("value")).union(own(key.alias("book"), F.lit("odd")).where("book % 2 = 1")),
        "custom_column_3": own(key.alias("book"), (size * 10).alias("value")).where(size > 5), "custom_column_4": own(key.alias("book"), text("2022-", F.lpad((size % 12 + 1).cast("string"), 2, "0"), "-01 00:00:00").alias("value")).where(size % 3 == 0),
        "custom_column_5": own(key.alias("book"), (size % 2).alias("value")).where(size % 5 == 0), "custom_column_6": own(key.alias("book"), (size / 4).alias("value")).where(size % 4 == 0),
    }


#: Named views of the catalog below.
CATALOG_VIEWS = {"Promo": "tags:PROMO", "Mine": "#status:=Read vl:Promo"}


def part_catalog(spark: SparkSession, sf_dir: str) -> Library:
    """The star tables in the normalised shape of a catalog: parts as books, suppliers as authors."""
    return Library.frames(spark, _catalog_tables(spark, sf_dir))


#: Its items in DuckDB's SQL.
CATALOG_SQL = """au AS (
  SELECT l_partkey, list(s_name ORDER BY s_suppkey) AS authors FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey
), fo AS (
  SELECT l_partkey, list(DISTINCT CASE l_returnflag WHEN 'A' THEN 'EPUB' WHEN 'N' THEN 'PDF' ELSE 'MOBI' END ORDER BY CASE l_returnflag WHEN 'A' THEN 'EPUB' WHEN 'N' THEN 'PDF' ELSE 'MOBI' END) AS formats FROM lineitem GROUP BY l_partkey
), items AS (
  SELECT p_partkey AS id, p_name AS title, p_name AS title_sort, p_brand AS author_sort, '2021-' || lpad((p_size % 12 + 1)::VARCHAR, 2, '0') || '-15 10:00:00+00:00' AS timestamp,
    CASE WHEN p_size % 10 = 0 THEN '0101-01-01' ELSE (p_size + 1950) || '-06-01' END || ' 00:00:00+00:00' AS pubdate, p_size % 2 = 1 AS cover, p_size::DOUBLE AS series_index, 'shelf/' || p_partkey AS path, md5(p_partkey::VARCHAR) AS uuid,
    coalesce(authors, []) AS authors, list_sort([p_type || '.' || p_brand, 'Size.' || p_size]) AS tags, coalesce(formats, []) AS formats, [CASE WHEN p_partkey % 2 = 1 THEN 'fra' ELSE 'eng' END] AS languages,
    CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS series, p_type AS publisher, p_size % 11 AS rating_raw, CASE WHEN p_size % 11 = 0 THEN NULL ELSE (p_size % 11) / 2.0 END::DOUBLE AS rating,
    CASE WHEN p_partkey % 4 <> 0 THEN '978' || lpad(p_partkey::VARCHAR, 9, '0') || '0' END AS isbn, CASE WHEN p_partkey % 5 = 0 THEN lpad(p_partkey::VARCHAR, 9, '0') || CASE WHEN p_partkey % 10 = 0 THEN 'X' ELSE (p_partkey % 10)::VARCHAR END END AS amazon,
    CASE WHEN p_size % 7 <> 0 THEN '<p>About ' || p_name || '</p>' END AS comments, CASE p_partkey % 3 WHEN 1 THEN 'Read' WHEN 2 THEN 'Unread' END AS status, CASE WHEN p_size > 5 THEN p_size * 10 END AS pages,
    CASE WHEN p_size % 3 = 0 THEN '2022-' || lpad((p_size % 12 + 1)::VARCHAR, 2, '0') || '-01' END AS done, CASE WHEN p_size % 5 = 0 THEN p_size % 2 = 1 END AS lent, CASE WHEN p_size % 4 = 0 THEN p_size / 4 END::DOUBLE AS score, p_brand, p_type, p_size
  FROM part LEFT JOIN au ON p_partkey = au.l_partkey LEFT JOIN fo ON p_partkey = fo.l_partkey)"""
