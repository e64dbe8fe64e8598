import duckdb
from pyspark.sql import functions as F

from lectern.functions import files
from lectern.functions.text import plain_text
from lectern.library_queries import QUERIES, SQL


def test_display_scalars_of_large_keys(spark, tmp_path):
    spark.createDataFrame([(k, 30) for k in (0, 19_999, 208_538, 1_199_999, 10**12)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    rows = {r["id"]: r["size"] for r in QUERIES["display_scalars"](spark, str(tmp_path)).collect()}
    assert rows.pop(0) == "1 KB" and rows[208_538] == "8,454,658,445.92 GB"
    assert rows.pop(10**12).endswith(" GB")
    assert rows == {k: f"{float((k + 1) ** 3 * 1001 + 1) / 2**30:,.2f} GB" for k in (19_999, 208_538, 1_199_999)}


def test_file_scan_names_tables_in_parts(spark, tmp_path):
    folder = tmp_path / "x.parquet" / "sf"
    for name in ("part.parquet", "pages.parquet/part-0000.parquet", "pages.parquet/part-0001.parquet", "labels.parquet/day=1/part-0000.parquet", "more/part.parquet", "notes.txt"):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(b"x")
    assert sorted(r["path"] for r in files.stored(spark, f"{folder}/", ".parquet").collect()) == ["labels.parquet", "more/part.parquet", "pages.parquet", "part.parquet"]
    assert sorted(r["name"] for r in QUERIES["file_scan"](spark, str(folder)).collect()) == ["labels.parquet", "pages.parquet", "part.parquet", "part.parquet"]


def test_plain_text_pages_as_sql(spark, tmp_path):
    pages = ["<p>a &amp; b&amp</p>", "&amp <b>&copy 1 &copy; &middot;", "&amp;lt; &amp;amp; &lt;p&gt; &quot;x&quot;", "&nbsp;a&nbsp;", "&eacute; &#39; &am", "<style>p {}</style>x<script>a < b</script>", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES["plain_text_pages"](spark, str(tmp_path)).collect())) == sorted(con.execute(SQL["plain_text_pages"]).fetchall())
    assert spark.range(1).select(plain_text(F.lit("&copy 1 &eacute;&amp"))).first()[0] == "© 1 é&"
