"""The pipeline's stages and run(), against plain Python where a stage has no other test."""

import glob
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lectern.llm import compress, langid, simhash
from lectern.llm.common import scratch_root

WORDS = "the of and to in is was that for on as with by at from this be are it his an were which had".split()
BAD = [f"{w.upper()}!!" for w in WORDS]
EXTRA = {"n_lines": 1, "n_near": 2, "difference": 3, "text_": 4, "keep": 5, "lang_pred": 6, "__text": 7, "__lang": 8, "__score": 9, "__gone": 10, "held_out": 11}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=90, vocabulary=WORDS):
    rng = np.random.default_rng(seed)
    return "\n".join(" ".join(rng.choice(vocabulary, n // 3)) for _ in range(3))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Good and bad prose; an exact copy, a near one, a shared line; texts without letters; a null."""
    texts = {i: prose(i, vocabulary=BAD if i % 3 == 0 else WORDS) for i in range(300)}
    texts |= {1000: texts[1], 1001: texts[2] + " end", 1002: prose(4000) + "\n" + texts[4].split("\n")[0], 1003: "12 34 !!", 1004: None, 1005: ""}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 3 > 0), 0) for i in range(300) if i % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, texts, dict((i, q) for i, q, _ in labels)


def test_stages(spark, tables):
    folder, texts, _ = tables
    assert [name for name, _ in pipeline.STAGES] == ["language ID", "quality classifier", "line dedup", "SimHash near-dedup", "packing"]
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(out.collect(), SCHEMA)
        kept.append({r["doc_id"]: r for r in docs.collect()})
        assert len(kept[-1]) == docs.count()
    language, quality, line, near = kept
    assert {*texts} - {*language} >= {1003, 1004, 1005} and sum(i in language for i in range(300)) >= 297
    good = [i for i in language if i < 300 and i % 3]
    assert sum(i in quality for i in good) >= 0.97 * len(good) and sum(i in quality for i in range(0, 300, 3)) <= 3
    # Each line that an earlier document kept has gone; here no two lines are otherwise near.
    seen, want = set(), {}
    for i in sorted(quality):
        own = [x for x in quality[i]["text"].split("\n") if x not in seen]
        near_line = i == 1001
        seen |= {*own}
        want[i] = own[:-1] if near_line else own
    assert {i: r["text"].split("\n") for i, r in line.items()} == {i: t for i, t in want.items() if t}
    assert all(r["n_chars"] == len(r["text"]) for r in line.values())
    groups = {}
    for i, r in sorted(line.items()):
        fp = simhash.fingerprint(r["text"])
        if not any((fp ^ other).bit_count() <= 3 for other in groups.values()):
            assert i in near
        groups[i] = fp
    assert {*near} <= {*line} and all(near[i]["text"] == line[i]["text"] for i in near)


def test_run(spark, tables):
    folder, texts, _ = tables
    pieces = pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), SCHEMA)
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}
    assert all(sum(r["length"] for r in pieces if r["doc_id"] == i) == next(r["doc_tokens"] for r in pieces if r["doc_id"] == i) for i in {r["doc_id"] for r in pieces})
    left = glob.glob(scratch_root(spark).removeprefix("file:") + "/lectern-*")
    pipeline.run(spark, folder).count()
    assert len(glob.glob(scratch_root(spark).removeprefix("file:") + "/lectern-*")) <= len(left) + 2  # what the result reads, and no more


def test_empty_and_odd(spark, tables):
    folder = tables[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.where("doc_id > 295").select("*", *(F.lit(v).alias(k) for k, v in EXTRA.items()))
    odd = odd.unionByName(odd.where("doc_id = 1000")).unionByName(odd.where("doc_id = 299").withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        out = stage(spark, odd, folder)
        out.collect()
        if name != "packing":
            assert out.columns == odd.columns and out.where("n_lines = 1 and n_near = 2 and __gone = 10").count() == out.count() > 0, name


def test_scores_by_brute_force(spark, tables):
    folder, texts, labels = tables
    docs, own = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = {r["doc_id"]: r for r in compress.classify(docs, own).collect()}
    training = {i: q for i, q in labels.items() if zlib.crc32(str(i).encode()) % 3 != 1}
    order = [r["id"] for r in spark.createDataFrame([(i,) for i in training], "id long").select("id", F.lit(0).alias("k")).orderBy(F.xxhash64("id", "k"), "id").collect()]
    coders = []
    for wanted in (1, 0):  # every text here is one piece
        data = zstandard.ZstdCompressionDict(compress.train([texts[i].encode() for i in order if training[i] == wanted]))
        coders.append(zstandard.ZstdCompressor(level=compress.LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False))
    sizes = {i: [len(c.compress(t.encode())) for c in coders] if t else None for i, t in texts.items()}
    difference = {i: (s[1] - s[0]) / (s[1] + s[0]) if s else 0.0 for i, s in sizes.items()}
    assert all(abs(found[i]["difference"] - d) < 1e-12 for i, d in difference.items())
    bins = {}
    for i, q in training.items():
        bins.setdefault(int((difference[i] + 1) / 2 * compress.BINS), []).append((difference[i], q))
    blocks = [[sum(d for d, _ in x) / len(x) * len(x), sum(q for _, q in x), len(x)] for _, x in sorted(bins.items())]
    falls = True
    while falls:  # pool any two neighbours that fall, until none do
        falls = next((k for k in range(len(blocks) - 1) if blocks[k][1] * blocks[k + 1][2] >= blocks[k + 1][1] * blocks[k][2]), None)
        if falls is not None:
            blocks[falls : falls + 2] = [[a + b for a, b in zip(*blocks[falls : falls + 2])]]
            falls = True
    x, y = [b[0] / b[2] for b in blocks], [(b[1] + 0.5) / (b[2] + 1) for b in blocks]
    assert all(abs(found[i]["score"] - np.interp(d, x, y)) < 1e-9 for i, d in difference.items())
    assert {r["doc_id"] for r in compress.keep_good(docs, own).collect()} == {i for i, r in found.items() if r["score"] >= 0.5}


def test_scores_do_not_look_at_labels(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    told = {r["doc_id"]: r["score"] for r in langid.identify(docs).collect()}
    moved = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "xx").otherwise(F.col("lang")))
    assert {r["doc_id"]: r["score"] for r in langid.identify(moved.withColumn("source", F.lit("?"))).collect()} == told
