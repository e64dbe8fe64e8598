import collections
import io
import struct
import zipfile

from pyspark.sql import functions as F

from lectern.functions import display, files, isbn
from lectern.functions.dates import day_of
from lectern.functions.text import fold_text, plain_text, strip
from lectern.operators import export, lookup, quality, reports
from lectern.streaming.pace import pace_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def jpeg(w, h, extra=b""):
    return b"\xff\xd8" + extra + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\x00" * 3


PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480)


def palm(kind, records=1):
    return b"\0" * 76 + struct.pack(">H", records) + struct.pack(">I", 86) + b"\0" * 4 + b"\0" * 12 + struct.pack(">H", kind) + b"\0" * 2


def epub(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>'
OPF = '<package><manifest><item id="a" href="p%20q.xhtml#x"/><item id="b" href="r.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>'


def encrypted(algorithm, uri):
    return f'<encryption><EncryptedData><EncryptionMethod Algorithm="{algorithm}"/><CipherData><CipherReference URI="{uri}"/></CipherData></EncryptedData></encryption>'


def test_scalars(spark):
    assert [one(spark, display.stars(F.lit(r).cast("int"))) for r in (10, 5, 0, None)] == [5.0, 2.5, None, None]
    assert one(spark, display.star_text(F.lit(3.5))) == "★★★½☆" and display.star_suffix(4.25) == " [★★★★☆ 4.2/5]"
    assert one(spark, display.author_display(F.array())) == "Unknown Author" and one(spark, display.series_label(F.lit(2.5))) == "#2.5" and one(spark, display.series_label(F.lit(0.0))) == "#0"
    assert one(spark, display.bar(F.lit(1), F.lit(4), 8)) == "██" and one(spark, display.branch(F.lit("A.B.C"))) == "A.B" and one(spark, display.author_key(F.lit(" B & C"))) == "b"
    assert [str(one(spark, day_of(F.lit(x)))) for x in ("2020-01-02T23:00:00+05:00", "2020-13-01", "0101-01-01", "2013", None)] == ["2020-01-02", "None", "None", "None", "None"]
    assert fold_text("Beär ﬁ Straße") == "bear fi strasse" and one(spark, strip(F.lit("  x\t"))) == "x"
    assert one(spark, plain_text(F.lit("<p>a &amp; b&nbsp;</p><script>x<y</script>"))) == "a & b"
    gaps = lambda i, last: one(spark, reports.gaps(F.array(*map(F.lit, i)).cast("array<double>"), F.lit(last).cast("double")))
    assert gaps([1.0, 2.0, 4.0], 4.0) == [3] and gaps([1.0, 1.5, 2.0], 2.0) == [] and gaps([0.5], 0.5) == [] and gaps([], None) == []


def test_isbn(spark):
    ok = lambda x: one(spark, isbn.checksum_ok(F.lit(x)))
    assert [ok(x) for x in ("9780306406157", "978-0-306-40615-7", "9780306406158", "0201183994", "080442957X", "123", None)] == [True, True, False, True, True, False, False]
    assert one(spark, isbn.isbn13(F.lit("0-201-18399-4"))) == "9780201183993" and one(spark, isbn.isbn13_or_blank(F.lit("12"))) == ""
    text = "Copyright © 2001 by A. All rights reserved. ISBN 0-306-40615-2." + " x" * 400 + " see ISBN-13: 978-0-201-18399-3"
    assert isbn.scan(text) == (["9780201183993", "9780306406157"], ["9780306406157"]) and isbn.scan(None) == ([], [])
    row = spark.range(1).select(isbn.printed(F.lit(text)).alias("p")).select(isbn.verdict(F.lit("9780201183993"), F.col("p.every"), F.col("p.own")).alias("v")).first()
    assert row["v"] == "CONFIRMED"


def test_printed_numbers():
    both = lambda text: isbn.scan(text)
    assert both("ISBN 13: 978 0 306 40615 7 (pbk.)") == (["9780306406157"], ["9780306406157"]) and both("ISBN 10 0306406152")[0] == ["9780306406157"]
    assert both("isbn978\u20110\u2011306\u201140615\u20117")[0] == ["9780306406157"] and both("ISBN 0 8044 2957 x")[0] == ["9780804429573"]
    assert both("ISBN 978-0-306-40615-8") == ([], []) and both("no label 9780306406157") == ([], []) and both("ISBN" + " " * 40 + "0306406152") == ([], [])
    assert both("ISBN 0306406152 and ISBN 0-201-18399-4")[0] == ["9780201183993", "9780306406157"]
    assert both("All   rights\nreserved " + "y" * 300 + " ISBN 0306406152")[1] == []


def test_batches_lose_nothing(spark):
    rows = spark.range(20_000).selectExpr("id", "id % 7 = 0 AS is_read", "concat('t', pmod(xxhash64(id), 50)) AS c1", "CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('a', pmod(xxhash64(id, 1), 900)) END AS c2").cache()
    want, seen = {}, collections.Counter()
    for r in sorted(rows.collect(), key=lambda r: (r["c2"], r["c1"], r["id"])):
        want[r["id"]] = seen[r["is_read"]] // 500
        seen[r["is_read"]] += 1
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (4, 8, 16, 200):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert {r["id"]: r["batch"] for r in export.lt_batches(rows).select("id", "batch").collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert export.lt_batches(rows.limit(0)).count() == 0


def test_damaged_files():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.xhtml", "x" * 5000 + "".join(map(chr, range(300, 3000))))
    raw = bytearray(data.getvalue())
    raw[60:90] = b"\xff" * 30
    assert any(f.startswith("EPUB_CRC") for f in files.epub_flags_of(bytes(raw)))
    whole = jpeg(30, 20, b"\xff\xe1" + struct.pack(">H", 100) + b"z" * 98)
    assert files.jpeg_dimensions(whole[:2] + b"\x00\x01" + whole[2:]) == (30, 20)


def test_images_and_locks(spark):
    assert files.jpeg_dimensions(jpeg(300, 200)) == (300, 200) and files.jpeg_dimensions(jpeg(30, 20, b"\xff\xe1" + struct.pack(">H", 2000) + b"z" * 1998)) == (30, 20)
    assert [files.jpeg_dimensions(x) for x in (None, b"", b"GIF", b"\xff\xd8\xff")] == [None] * 4
    rows = spark.createDataFrame([("a.png", bytearray(PNG)), ("b.jpg", bytearray(jpeg(3, 2))), ("c.txt", bytearray(b"no")), ("d", None)], "path string, content binary")
    assert [tuple(r["s"]) if r["s"] else None for r in rows.select(files.image_size(F.col("content")).alias("s")).collect()] == [(640, 480), (3, 2), None, None]
    font, page = encrypted("http://www.idpf.org/2008/embedding", "fonts/1.dat"), encrypted("http://www.w3.org/2001/04/xmlenc#aes128-cbc", "o/p.xhtml")
    cases = {
        "1.epub": (epub({"a": "b"}), "CLEAN"), "2.epub": (epub({"META-INF/encryption.xml": font}), "BENIGN"), "3.epub": (epub({"META-INF/encryption.xml": page}), "DRM"), "4.epub": (epub({"META-INF/rights.xml": ""}), "BENIGN"),
        "5.epub": (b"junk", "ERROR"), "6.pdf": (b"%PDF-1.4 EBX_HANDLER %%EOF", "DRM"), "7.pdf": (b"%PDF-1.4 /Encrypt %%EOF", "BENIGN"), "8.pdf": (b"%PDF-1.4 %%EOF", "CLEAN"), "9.mobi": (palm(0), "CLEAN"), "10.azw3": (palm(2), "DRM"),
        "11.mobi": (b"x" * 20, "ERROR"), "12.mobi": (palm(0, 0), "ERROR"), "13.djvu": (b"", "N/A"),
    }
    found = files.locks(spark.createDataFrame([(k, bytearray(v[0])) for k, v in cases.items()], "path string, content binary"))
    assert {r["path"]: r["status"] for r in found.collect()} == {k: v[1] for k, v in cases.items()}


def test_file_flags(spark):
    good = epub({"META-INF/container.xml": CONTAINER, "o/c.opf": OPF, "o/p q.xhtml": "x" * 40_000, "o/r.xhtml": "y"})
    assert files.epub_flags_of(good) == [] and files.epub_flags_of(b"x") == ["EPUB_BADZIP:BadZipFile"] and files.epub_flags_of(epub({})) == ["EPUB_NO_CONTAINER"]
    thin = epub({"META-INF/container.xml": CONTAINER, "o/c.opf": OPF, "o/p q.xhtml": "x"})
    assert files.epub_flags_of(thin) == ["EPUB_SPINE_MISSING:1/2", "EPUB_THIN_TEXT:1B"] and files.epub_text_of(thin) == "x" and files.epub_text_of(b"") is None
    flags = files.file_flags(spark.createDataFrame([("a.pdf", bytearray(b"%PDF-")), ("b.pdf", bytearray(b"x%%EOF"))], "path string, content binary")).collect()
    assert [r["flags"] for r in flags] == [["PDF_NO_EOF"], ["PDF_BAD_HEADER"]]
    assert one(spark, quality.hard(F.array(F.lit("EPUB_CRC:a")))) and not one(spark, quality.hard(F.array(F.lit("EPUB_THIN_TEXT:1B"))))
    mb = 1 << 20
    rows = [(10 * mb, None, False, 0, False, 300), (100 * mb, None, False, 0, True, 180), (300 * mb, None, False, 0, True, 120), (300 * mb, None, False, 0, False, None), (300 * mb, "AcroForm", False, 0, False, 300), (300 * mb, None, False, 0, False, 300), (300 * mb, None, False, 0, False, 200)]
    advice = files.compression_advice(spark.createDataFrame(rows, "size long, form string, javascript boolean, attachments int, optimized boolean, avg_dpi int")).collect()
    assert [r["advice"] for r in advice] == ["skip-small", "skip-optimized", "skip-already-low-dpi", "manual", "printer", "ebook", "printer"] and advice[5]["estimate"] == 75


def test_lints(spark):
    flags = lambda c: one(spark, c)
    assert flags(quality.title_flags(F.lit(" The SPuter  x"))) == ["TITLE_WHITESPACE", "TITLE_CASE_GARBLE:SPuter"] and flags(quality.title_flags(F.lit("SQLite"))) == [] and flags(quality.title_flags(F.lit("donâ€™t"))) == ["TITLE_MOJIBAKE"]
    assert flags(quality.author_flags(F.array(F.lit("O'Reilly Press")))) == ["AUTHOR_JUNK:O'Reilly Press"] and flags(quality.author_flags(F.array().cast("array<string>"))) == ["AUTHOR_MISSING"]
    assert flags(quality.comment_flags(F.lit("<p>short</p>"))) == ["COMMENT_STUB:5"] and flags(quality.comment_flags(F.lit(None).cast("string"))) == ["COMMENT_MISSING"]
    words = spark.createDataFrame([("word",)], "w string")
    texts = spark.createDataFrame([(1, "x " * 80 + "word"), (2, "x " * 80 + "wor"), (3, "x " * 80 + "wor."), (4, "wor")], "id int, t string")
    assert [r["id"] for r in quality.truncated(texts, "t", words, "w").collect()] == [2]
    ids = one(spark, quality.parse_identifiers(F.lit("isbn:978, lcc: BF637.S4 G63 2007 , bad, :x, isbn:979")))
    assert ids == {"isbn": "979", "lcc": "bf637.s4 g63 2007"}
    findings = quality.by_severity(quality.date_findings(spark.createDataFrame([(1, "soon"), (2, "0101-01-01"), (3, "2020-01-01"), (4, None)], "id int, pubdate string")))
    assert [(r["code"], r["id"]) for r in findings.collect()] == [("PUBDATE_PARSEABLE", "1"), ("NO_SENTINEL_PUBDATE", "2")]
    assert [r["id"] for r in quality.amazon_findings(spark.createDataFrame([(1, "amazon", "0201183994"), (2, "amazon", "B0001"), (3, "isbn", "0201183994")], "book int, type string, val string")).collect()] == ["1"]


def test_drift(spark):
    db = ("T", ["A B", "C"], "S", "1", "P", "2020-01-01 00:00", ["eng"], ["x", "Y"], {"isbn": "1"}, "<p>hi</p>")
    same = {"title": " t ", "author(s)": "C & A B [B, A]", "series": "S #1.0", "publisher": "p", "published": "2020-01-01T00", "languages": "eng", "tags": "y, X", "identifiers": "isbn:1, z:2", "comments": "hi"}
    kind = "db struct<title:string,authors:array<string>,series:string,series_index:string,publisher:string,pubdate:string,languages:array<string>,tags:array<string>,identifiers:map<string,string>,comments:string>, file map<string,string>"
    rows = spark.createDataFrame([(db, same), (db, {}), (db, {**same, "series": "S", "identifiers": "isbn:2"})], kind)
    found = [r["drift"] for r in quality.drift(rows, "EPUB").collect()]
    assert found == [[], list(quality.DRIFT_FIELDS["EPUB"]), ["series", "identifiers"]]


def test_drift_comments(spark):
    long = "word " * 60
    rows = [(long + "one end", long + "another"), (long + "one end", "<p>word word"), (long, long), ("", "word"), ("word", ""), ("a word", "word"), (None, None), (long, long + "more")]
    kind = "db struct<title:string,authors:array<string>,series:string,series_index:string,publisher:string,pubdate:string,languages:array<string>,tags:array<string>,identifiers:map<string,string>,comments:string>, file map<string,string>"
    found = spark.createDataFrame([((None, [], None, None, None, None, [], [], {}, a), {"comments": b}) for a, b in rows], kind)
    for fmt in ("EPUB", "AZW3", "MOBI"):
        assert ["comments" in r["drift"] for r in quality.drift(found, fmt).collect()] == [True, False, False, True, True, True, False, True]


def test_review(spark):
    lines = spark.createDataFrame([("id,title,author,comment,note",), ("1,OK,bad,OK,wrong, see there",), ("# x",), ("2\tOK\tOK\tOK",), ("x,OK,OK,OK",), ("3,OK",), ("4,OK,OK,maybe",), ("",)], "value string")
    found = {r["id"]: r for r in quality.parse_verdicts(lines).where("error is null").collect()}
    assert set(found) == {1, 2} and found[1]["author"] == "BAD" and found[1]["note"] == "wrong, see there"
    assert quality.parse_verdicts(lines).where("error is not null").count() == 3
    ledger = quality.parse_verdicts(lines).where("error is null").drop("error")
    assert [(r["id"], r["field"]) for r in quality.worklist(ledger).collect()] == [(1, "author")]
    assert quality.upsert(ledger, ledger.where("id = 1")).count() == 2
    own = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert sorted(tuple(r) for r in quality.reconcile_ids(own(1, 2), own(2, 3)).collect()) == [(1, "invented"), (3, "missing")]


def test_exports(spark, tmp_path):
    assert export.file_names(["Tabletop: RPG", "Tabletop RPG", "!!!"]) == {"!!!": "wing_1", "Tabletop RPG": "Tabletop_RPG", "Tabletop: RPG": "Tabletop_RPG_2"}
    items = spark.createDataFrame([(1, "T", "A", ["x"], "S", 0.0, 4.0, 8, None, "0101-01-01", {"isbn": "0201183994"}), (2, None, None, None, None, None, None, None, "P", None, {})], "id long, title string, author_sort string, tags array<string>, series string, series_index double, rating double, rating_raw int, publisher string, pubdate string, identifiers map<string,string>").withColumn("cover", F.lit(True))
    assert [r["line"] for r in export.ai_lines(items).collect()] == ["T by A (S #0.0) [x] 4.0/5", ""]
    rows = export.lt_rows(items).collect()
    assert [rows[0][f"c{i}"] for i in range(1, 12)] == ["T", "A", "", "9780201183993", "", "x", "4", "", "", "", ""] and [r["problem"] for r in export.lt_problems(export.lt_rows(items)).collect()] == ["no title"]
    made = {r["name"]: r["content"].split("\n") for r in export.lt_files(export.lt_rows(items)).collect()}
    assert set(made) == {"read_001.csv", "main_001.csv"} and made["read_001.csv"] == [export.LT_HEADER, ""] and len(made["main_001.csv"]) == 4 and made["main_001.csv"][2].startswith("T,A,,9780201183993,")
    assert [r["line"] for r in export.catalog_lines(items).collect()] == ["T (S #0) [★★★★☆]", ""]
    assert export.csv_rows(items).first()["series_index"] == "0.0" and not export.write(items.where("false"), str(tmp_path / "none"), "json") and export.write(export.csv_rows(items), str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_pace_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00",), ("2024-01-01 00:50:00",), ("2024-01-01 01:00:00",)], "ts string").select(F.col("ts").cast("timestamp").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = pace_stream(spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("pace_out").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("pace_out").collect()) == [1, 2] and sorted(r["n"] for r in pace_stream(rows).collect()) == [1, 2]


def test_lookup(spark):
    xml = "<r xmlns='urn:m'><m><classification authority='ddc'>813</classification></m><m><classification authority='lcc'> QA76 </classification><classification authority='ddc'>5</classification></m></r>"
    assert tuple(one(spark, lookup.class_codes(F.lit(xml)))) == ("QA76", "813") and tuple(one(spark, lookup.class_codes(F.lit("<r/>")))) == (None, None)
    cache = spark.createDataFrame([("a", "1")], "isbn string, lcc string")
    keys = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "isbn string")

    def fetch(batches):
        for batch in batches:
            yield batch.assign(lcc="new")

    joined, fresh = lookup.lookup(keys, cache, "isbn", fetch, tasks=2)
    assert {(r["isbn"], r["lcc"]) for r in joined.collect()} == {("a", "1"), ("b", "new"), (None, None)} and fresh.count() == 2
    assert [tuple(r) for r in lookup.status_counts(keys, "isbn", ("b", "c", "a")).collect()] == [("b", 2), ("c", 0), ("a", 1)]
