import json
import sqlite3
import warnings

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.functions.display import share_bar, value_suffix, wrap
from lectern.functions.isbn import scan
from lectern.operators import export, lookup, quality, reports, scope
from lectern.plans.fields import FieldRegistry
from lectern.plans.predicates import fields_of
from lectern.sources.library import Library
from lectern.sources.sqlite import read_table, resolve

ITEMS = "id long, title string, title_sort string, author_sort string, authors array<string>, tags array<string>, formats array<string>, languages array<string>, series string, series_index double, rating double, publisher string, timestamp string, cover boolean"


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (1, "Tide 10", "Tide 10", "Varga, L", ["L Varga"], ["Tale.Orbit", "Prize.Oak"], ["EPUB"], ["eng"], "Coast", 1.0, 4.5, "Fen", "2024-01-02 10:00", True),
        (2, None, None, "Varga, L", ["L Varga"], [], [], [], None, None, None, None, None, None),
        (3, "Wind", "Wind", "arden, T", ["T Arden", "B"], ["Tales"], ["PDF"], ["eng"], "Coast", 2.5, None, "Fen", "2024-02-02", False),
    ]
    return spark.createDataFrame(rows, ITEMS).cache()


def ids(found):
    return sorted(r["id"] for r in found.collect())


def test_scopes(spark, items):
    assert ids(scope.in_branches(items, ("Tale",))) == [1] and ids(scope.in_branches(items, ("tale", "Tales"))) == [3] and ids(scope.in_branches(items, ())) == [1, 2, 3]
    assert ids(scope.with_ids(items, [3, 9])) == [3] and ids(scope.with_ids(items, range(2, 2000))) == [2, 3]
    assert ids(scope.with_ids(items, spark.createDataFrame([(1,), (1,), (None,)], "k long"))) == [1]
    registry = FieldRegistry(views={"Oak": "tags:Prize", "Both": "vl:Oak series:=Coast"})
    assert ids(scope.in_view(items, "Both", registry)) == [1]
    with pytest.raises(ValueError, match="Both, Oak"):
        scope.in_view(items, "None", registry)
    assert fields_of("not vl:Both or id:3", registry) == {"tags", "series", "id"} and fields_of(" ", registry) == set()
    tags = items.select("id", scope.display_tag(F.col("tags"), ("Prize",)).alias("t")).orderBy("id").collect()
    assert [r["t"] for r in tags] == ["Prize.Oak", "", "Tales"]


def test_texts(spark, items, tmp_path):
    lines = [r["line"] for r in export.listing(items, "x").orderBy("place", "author_sort", "title_sort", "id").collect()]
    assert lines[:4] == ["Search Query: x", "Matches: 3", "=" * 40, ""] and lines[4:] == ["  * Untitled - Varga, L", "  * Tide 10 - Varga, L", "  * Wind - arden, T"]
    export.write_text(export.catalog_text(items, "Head"), str(tmp_path / "c"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "c")).collect()]
    assert sorted(text) == sorted(["Head", "====", "", "[T Arden & B]", "-" * 13, "  * Wind (Coast #2.5) [PDF]", "", "[L Varga]", "-" * 9, "  * Unknown Title", "  * Tide 10 (Coast #1) [EPUB] [★★★★½ 4.5/5]", "", "=" * 40, "Total: 3 books"])
    ordered = [r["line"] for r in export.catalog_text(items, "Head", tags=True).orderBy("place", "author_key", "part", "title_sort", "author_sort", "id").collect()]
    assert ordered[2:8] == ["", "[T Arden & B]", "-" * 13, "  * Wind (Coast #2.5) [PDF] [Tales]", "", "[L Varga]"] and ordered[-1] == "Total: 3 books"
    assert export.catalog_text(items.limit(0), "Head").count() == 5
    registry = FieldRegistry(views={"Oak": "tags:Prize", "Nobody": "title:zzz"})
    assert export.write_views(items, registry, str(tmp_path)) == {"Oak": f"{tmp_path}/Oak"}
    found = json.loads(export.json_document(items))
    assert [r["id"] for r in found] == [2, 1, 3] and found[1]["tags"] == ["Tale.Orbit", "Prize.Oak"] and found[0]["rating"] is None and export.json_document(items.limit(0)) == "[]\n"
    assert wrap("aa bb  cc", 5) == "  aa bb\n  cc" and wrap(None) == "  (empty)" and wrap("x" * 200).strip() == "x" * 200
    row = spark.range(1).select(value_suffix("A", F.lit(0)).alias("a"), value_suffix("A", F.lit(None).cast("string")).alias("b"), value_suffix("A", F.lit("x")).alias("c"), share_bar(F.lit(1), F.lit(8)).alias("d"), share_bar(F.lit(0), F.lit(0)).alias("e")).first()
    assert tuple(row) == ("", "", " <A: x>", "##", "")


def test_import_files_are_checked(spark, items):
    good = export.lt_files(export.lt_rows(items.where("title is not null"))).select(F.col("name").alias("path"), F.col("content").cast("binary").alias("content"))
    assert export.lt_file_problems(good, 2).isEmpty()
    assert [tuple(r) for r in export.lt_file_problems(good, 5).collect()] == [(None, None, "2 rows, 5 expected")]
    bad = spark.createDataFrame([("a", bytearray(b"\xef\xbb\xbf" + export.LT_HEADER.encode() + b"\r\n\xff")), ("b", None)], "path string, content binary")
    found = {(r["path"], r["problem"]) for r in export.lt_file_problems(bad).collect()}
    assert {("a", "byte order mark"), ("a", "line ends of two characters"), ("a", "no UTF-8"), ("a", "another header"), ("b", "another header")} <= found


def test_findings(spark, items):
    found = quality.pdf_only_findings(items, ("Tales",))
    assert [(r["id"], r["message"]) for r in found.collect()] == [("3", "Tales")] and quality.exit_code(found) == 0
    assert quality.pdf_only_findings(items, ("Tales",), wanted=False).isEmpty() and quality.pdf_only_findings(items, ()).isEmpty()
    names = spark.createDataFrame([("Fen",), ("Fen Ltd",)], "name string")
    assert [r["id"] for r in quality.publisher_findings(names, {"Fen": ["Fen Ltd"]}).collect()] == ["Fen Ltd"] and quality.publisher_findings(names, {}).isEmpty()
    many = spark.range(20).select(F.lit("X").alias("code"), F.lit("E").alias("severity"), F.col("id").cast("string").alias("id"), F.lit("m").alias("message"))
    short = quality.shown(many).collect()
    assert [(r["id"], r["rank"], r["total"]) for r in short] == [(str(i), i + 1, 20) for i in range(5)] and quality.exit_code(many) == 1
    twins = spark.createDataFrame([(i, " A b", ["Q"]) if i < 3 else (i, None, []) for i in range(6)], "id long, title string, authors array<string>")
    assert [tuple(r) for r in quality.duplicate_members(twins).orderBy("id").collect()] == [(0, 0, 3), (1, 0, 3), (2, 0, 3)]
    assert [r["ids"] for r in quality.duplicate_items(twins).collect()] == [[0, 1, 2]]
    ledger = spark.createDataFrame([("OK", "BAD", None), ("OK", "OK", "OK"), (None, None, None)], "title string, author string, comment string")
    assert tuple(quality.ledger_summary(ledger).first()) == (3, 1)
    assert [tuple(r) for r in reports.top_series(items).collect()] == [("Coast", 2)]


def test_patience(spark):
    waits, turns = [], []

    def ask(key):
        turns.append(key)
        if key == "bad" or turns.count(key) < 3 and key == "slow":
            raise OSError
        return None if key == "none" else {"v": key}

    fetch = lookup.patient(ask, "k", ["k", "v"], sleep=waits.append)
    found = pd.concat(fetch(iter([pd.DataFrame({"k": ["slow", "bad", "none"]})])))
    assert found.values.tolist() == [["slow", "slow"], ["none", None]] and waits == [5.0, 10.0, 5.0, 10.0]


def test_look_up_asks_once(spark, tmp_path):
    def ask(batches):
        for b in batches:
            with open(tmp_path / "asked", "a") as f:
                f.write("".join(f"{k}\n" for k in b["k"]))
            yield b.assign(v="new")

    keys = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    cache = spark.createDataFrame([("a", "old")], "k string, v string")
    found, fresh = lookup.lookup(keys, cache, "k", ask, folder=str(tmp_path / "found"))
    assert sorted(map(tuple, found.collect())) == [("a", "old"), ("b", "new"), ("b", "new")] and fresh.count() == 2 and fresh.count() == 2
    assert (tmp_path / "asked").read_text() == "b\n"


def test_printed_numbers_of_thirteen():
    assert scan("Copyright 2001. ISBN 13 9780306406157") == (["9780306406157"],) * 2
    assert scan("ISBN 9780000112219") == ([], [])  # wrong as thirteen, though its first ten would do
    assert scan("ISBN 0306406152 (pbk)")[0] == ["9780306406157"] and scan("ISBN 1034567890")[0] == [] and scan("ISBN\n0-306\n40615-2")[0] == ["9780306406157"]


def test_lists_keep_their_digits(spark):
    """Positions in a list must not be taken for characters to trim."""
    books = spark.createDataFrame([(1, "t", "t", "a", None, None, 0, 1.0, "p")], "id long, title string, sort string, author_sort string, timestamp string, pubdate string, has_cover int, series_index double, path string")
    pair = lambda name: spark.createDataFrame([(1, 1, 1), (2, 1, 2)], f"id long, book long, {name} long")
    names = spark.createDataFrame([(1, "Ward 100, Ward 11", "eng0"), (2, "Bo 20", "fra1")], "id long, name string, lang_code string")
    none = spark.createDataFrame([], "id long, book long, series long, publisher long, rating long, name string, format string, type string, val string")
    frames = {"books": books, "authors": names, "tags": names, "languages": names, "books_authors_link": pair("author"), "books_tags_link": pair("tag"), "books_languages_link": pair("lang_code")}
    own = Library.frames(spark, {**frames, **dict.fromkeys(("data", "series", "books_series_link", "publishers", "books_publishers_link", "ratings", "books_ratings_link", "identifiers"), none)})
    row = own.items().first()
    assert row["authors"] == ["Ward 100", "Ward 11", "Bo 20"] and row["tags"] == ["Bo 20", "Ward 100", "Ward 11"] and row["languages"] == ["eng0", "fra1"]
    assert set(own.items(only=()).columns).isdisjoint({"authors", "rating", "comments"}) and own.find('author:"=Ward 11"').count() == 1


def test_sqlite_shapes(spark, tmp_path):
    path = str(tmp_path / "metadata.db")
    con = sqlite3.connect(path)
    con.executescript("CREATE TABLE a(k TEXT PRIMARY KEY, v INT) WITHOUT ROWID; CREATE TABLE b(id INTEGER PRIMARY KEY, v TEXT); CREATE TABLE preferences(key TEXT, val TEXT); INSERT INTO preferences VALUES('virtual_libraries', '{oops')")
    con.executemany("INSERT INTO a VALUES(?, ?)", [(f"k{i}", i) for i in range(50)])
    con.executemany("INSERT INTO b VALUES(?, ?)", [(i * 10, f"v{i}") for i in range(500)])
    con.commit()
    con.close()
    assert read_table(spark, path, "a").agg(F.sum("v")).first()[0] == 1225
    many = read_table(spark, path, "b", 7)
    assert many.rdd.getNumPartitions() == 7 and many.distinct().count() == 500 and read_table(spark, path, "b").count() == 500
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        assert Library.sqlite(spark, path).views() == {} and sum("named views" in str(w.message) for w in told) == 1
    assert resolve(str(tmp_path)) == path and resolve(None, path) == path and resolve(None, "/none", ("/none", str(tmp_path))) == path
    for bad in (lambda: resolve("/none/x.db"), lambda: resolve(None, None, ("/none",))):
        with pytest.raises(FileNotFoundError):
            bad()
