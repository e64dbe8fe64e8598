"""Small tests of the ten operators: brute force, round trips, and odd rows."""

import base64
import collections
import hashlib
import math
import re
import tracemalloc
import urllib.parse
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import ann, bpe, chunks, compress, langid, linededup, packing, ppm, rules, simhash, urls
from lectern.llm.graph import connected_components

WORDS = "the of and to in is was that for on as with by at from this be are it his an were which had".split()
ODD = [None, "", " ", "\n \n", "x" * 3000, "one", "  two  blanks \n\n lines\r\n", "é ü 😀 \t tab", "a\n a\n a", "<|endoftext|>"]
SCHEMA = "doc_id long, text string, lang string, source string, score double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n=120, vocabulary=WORDS):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(vocabulary, n)) + "\n" + " ".join(rng.choice(vocabulary, n // 2))


@pytest.fixture(scope="module")
def rows():
    texts = ODD + [prose(i) for i in range(20)] + [prose(3), prose(3) + " end", prose(4).upper(), " ".join(WORDS * 80)]
    return [(i if i != 2 else None, t, "en", "s", 1.0) for i, t in enumerate(texts)] + [(5, "one", "en", "s", 1.0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Documents with nulls, empty and long texts, a repeated row, and a column that has the name of a result."""
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark, none):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (100, 110), (7, 7), (5, None)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {**{i: 0 for i in range(31)}, 90: 90, 100: 90, 110: 90}
    assert connected_components(none.select("doc_id", F.col("doc_id").alias("b")), "doc_id", "b").count() == 0


def test_packing(docs, rows, none):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = packing.pack(docs, with_ids=True).collect()
    want = collections.Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, *_ in rows)
    held, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        held[r["doc_id"], r["doc_tokens"]].append((r["start"], r["ids"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["tier"]))
    assert sum(n for _, n, _ in sum(sequences.values(), [])) == sum(len(k[1]) * v for k, v in want.items())
    for (i, ids), times in want.items():
        pieces = sorted(held[i, len(ids)])
        assert [x for _, p in pieces[::times] for x in p] == list(ids)
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:])) and own[-1][0] + own[-1][1] == own[0][2]
    assert packing.pack(none).count() == 0
    texts = ["x <|endoftext|> y", "x  <|endoftext|>  y", "<|endoftext|>", "a<|endoftext|>, b"]
    special = docs.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for as_text in (False, True):
        tok.encode_special_tokens = as_text
        got = collections.defaultdict(list)
        for r in packing.pack(special, with_ids=True, special_as_text=as_text).orderBy("start").collect():
            got[r["doc_id"]] += r["ids"]
        assert [got[i] for i in range(len(texts))] == [tok.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_ids_by_ranks():
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), np.random.default_rng(8)
    alphabets = [range(0x250), range(32, 127), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 65, 66, 49, 39, 46], [*map(ord, "abcdefghinorst '\n")], [*range(0x250), 0x4E2D, 0x1F600, 0x3B1]]
    texts = ["".join(map(chr, rng.choice([*alphabets[k % 5]], rng.integers(1, 120)).tolist())) for k in range(2000)] + ["x" * 3000, " " * 3000 + "a", None, "", "a <|endoftext|> b"]
    store = packing._id_store(path, False)
    quick = store.encode.quick(pa.array(texts))
    assert store.encode.by_ranks and 0.9 < quick.mean() < 1 and quick[-5:].tolist() == [False, False, True, True, False]
    tok = Tokenizer.from_file(path)
    assert [x.tolist() for x in packing.encoded(store, pa.array(texts))] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert chunks.merge_ranks(public_tokenizers.path("word_bpe_49k.json")) is None


def test_packing_fills():
    pool = packing.Pool()
    for i, n in enumerate([1500, 700, 300, 90, 40, 30, 20] * 20):
        pool.add(i, 0, n)
    windows = packing.fill(pool)
    assert windows and all(sum(b - a for _, a, b in w) in packing.TIERS for w in windows)
    windows += packing.flush(pool)
    assert sum(b - a for w in windows for _, a, b in w) == 20 * 2680 and not pool.lengths
    assert all(packing.tokens(w).bit_count() == 1 for w in windows)  # a power of two, so nothing is padded
    steps, dealt = packing.StepGroups(4096), []
    for at in range(0, len(windows), 5):
        dealt += steps.deal(windows[at : at + 5])
    early = len(dealt)
    dealt += steps.deal([], last=True)
    groups = collections.defaultdict(list)
    for group, w in dealt:
        groups[group].append(packing.tokens(w))
    assert sorted(map(repr, windows)) == sorted(repr(w) for _, w in dealt) and early
    assert all(len(set(own)) == 1 for own in groups.values())
    assert all(sum(own) == 4096 for g, own in groups.items() if g in {g for g, _ in dealt[:early]})
    assert collections.Counter(own[0] for own in groups.values() if sum(own) < 4096).most_common(1)[0][1] == 1


def naive_statistics(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_rules(spark, docs, rows, none):
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(10, 30)] + [(10, None, 0)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.limit(0)):
        found = rules.judge(docs, own).collect()
        assert len(found) == len(rows)
        want = sorted((str(i), *naive_statistics(t)) for i, t, *_ in rows)
        assert sorted((str(r["doc_id"]), *(r[c] for c in rules.BASE)) for r in found) == want
        assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in found)
        assert not any(r["kept"] and r["base_failed"] for r in found)
    assert all(r["kept"] != r["base_failed"] for r in found) and rules.judge(none, labels).count() == 0


def naive_paths(rows, x, seed=42):
    """Mean path of each row of x through trees that are grown as the forest grows them."""
    rng, n = np.random.default_rng(seed), min(rules.TREE_ROWS, len(rows))
    deepest, total = math.ceil(math.log2(n)), np.zeros(len(x))

    def rest(k):
        return 0.0 if k < 2 else 1.0 if k == 2 else 2 * (math.log(k - 1) + 0.5772156649) - 2 * (k - 1) / k

    def grow(own, asked, depth):
        wide = [f for f in range(rows.shape[1]) if len(own) and own[:, f].max() > own[:, f].min()]
        if depth == deepest or len(own) < 2 or not wide:
            total[asked] += depth + rest(len(own))
            return
        f = int(rng.choice(np.array(wide)))
        v = rng.uniform(own[:, f].min(), own[:, f].max())
        grow(own[own[:, f] <= v], [i for i in asked if x[i, f] <= v], depth + 1)
        grow(own[own[:, f] > v], [i for i in asked if x[i, f] > v], depth + 1)

    for _ in range(rules.TREES):
        grow(rows[rng.choice(len(rows), n, replace=False)], list(range(len(x))), 0)
    return 2.0 ** (-total / rules.TREES / rest(n))


def test_forest_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.normal(size=(400, 3)), np.zeros((60, 3))])
    assert np.allclose(rules.Forest(rows).score(rows[::7]), naive_paths(rows, rows[::7]), rtol=1e-9)
    good, bad = np.zeros(rules.BINS + 2), np.zeros(rules.BINS + 2)
    good[[100, 900]], bad[[500, 2000]] = [998, 2], [50, 7]
    assert [rules.threshold(good, bad, x) * rules.BINS for x in (0.001, 0.002)] == [901, 101] and rules.threshold(good, 0 * bad, 0.5) == 2
    texts = [prose(i, 150) for i in range(150)] + ["#* $% && | " * 30 + prose(i, 60) for i in range(15)]
    labels = [(i, int(i < 150), 0) for i in range(165)]
    found = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(r["kept"] == (not r["base_failed"] and r["anomaly_chars"] < r["threshold_chars"] and r["anomaly_words"] < r["threshold_words"]) for r in found.values())
    assert sum(not found[i]["kept"] for i in range(150, 165)) >= 14 and sum(found[i]["kept"] for i in range(150)) >= 148


def test_forest_finds_the_odd_one():
    rng = np.random.default_rng(1)
    forest = rules.Forest(rng.normal(size=(500, 3)))
    assert forest.score(np.array([[9.0, 9, 9]]))[0] > forest.score(rng.normal(size=(50, 3))).max()


def test_compression(spark, docs, rows, none):
    bad = [f"{w.upper()}!!" for w in WORDS]
    own = spark.createDataFrame([(i, prose(i, vocabulary=bad if i % 3 == 0 else WORDS), "en", "s", 1.0) for i in range(200)] + [(None, "x", None, None, None), (900, None, None, None, None)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(1, None, None)], "doc_id long, quality int, toxic int")
    found = compress.classify(own, labels).collect()
    assert len(found) == 202 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r["held_out"] and r["doc_id"] is not None]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.95
    assert {r["score"] for r in compress.classify(docs, labels.limit(0)).collect()} == {0.5} and compress.classify(none, labels).count() == 0
    assert compress.keep_good(docs, labels.limit(0)).count() == len(rows) and compress.keep_good(own, labels).columns == own.columns


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 24))
    x = np.concatenate([c + 0.2 * rng.normal(size=(60, 24)) for c in centre]).astype(np.float32)
    x[5] = x[7]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1001, [0.0] * 24, 0), (1002, [float("nan")] * 24, 0), (1003, [], 0), (None, [1.0] * 24, 0), (1100, [1.0, None], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = ann.search(table, table.where(F.col("vec_id") % 20 == 0), k=10).collect()
    own, hits = x.astype(float), 0
    for q in {r["query_id"] for r in found}:
        d = np.sqrt(((own - own[q]) ** 2).sum(1))
        d[q] = np.inf
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [g[0] for g in got] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-12 for _, v, s in got) and [(s, v) for _, v, s in got] == sorted((s, v) for _, v, s in got)
        hits += len({v for _, v, _ in got} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits / len(found) >= 0.9 and len(found) == 360
    few = table.where("vec_id < 3")
    assert [(r["query_id"], r["rank"]) for r in ann.search(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert ann.search(table.limit(0), table).count() == 0
    twins = table.where("vec_id = 20").union(table.where("vec_id = 20")).union(table.where("vec_id = 40").withColumn("vec_id", F.lit(20).cast("long")))
    got = collections.Counter((r["query_id"], r["rank"]) for r in ann.search(table, twins, k=10).collect())
    assert got == {(20, k): 2 for k in range(1, 11)}


def test_bpe(docs, rows, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    found = bpe.encode_decode(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == sorted(want)
    assert bpe.encode_decode(none).count() == 0
    encoder = bpe.Encoder(ranks)
    rng = np.random.default_rng(3)
    words = [bytes(rng.choice(list(b"abethin \xc3\xa9\xff"), rng.integers(1, 900)).tolist()) for _ in range(300)]
    assert [x.tolist() for x in encoder.encode(words)] == [library._encode_single_piece(w) for w in words]


def naive_fingerprint(text):
    words = [w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_groups(fps, ids):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = collections.defaultdict(lambda: math.inf)
    for i, x in enumerate(ids):
        least[root(i)] = min(least[root(i)], math.inf if x is None else x)
    return [least[root(i)] for i in range(len(fps))]


def test_simhash(docs, rows, none):
    fps = [naive_fingerprint(t) for _, t, *_ in rows]
    want = sorted((str(r[0]), f"{f:016x}", g) for r, f, g in zip(rows, fps, naive_groups(fps, [r[0] for r in rows])))
    found = simhash.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in found) == want
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(none).count() == 0
    kept = simhash.keep_first(docs).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({w[2] for w in want}) and kept[0].asDict().keys() == set(docs.columns)


def test_anchors_join_all_links(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base.tolist():
        for k in (1, 2, 3, 3, 3, 4, 5):
            fps.add(b ^ sum(1 << int(i) for i in rng.choice(64, k, replace=False)))
    fps |= {int(base[0]) ^ (1 << i) for i in range(64)} | {int(base[0]) ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)}  # a crowded anchor
    fps = sorted(fps)
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    want = naive_groups(fps, list(range(len(fps))))
    for block in (simhash.BLOCK, 16):
        found = {r["node"]: r["component"] for r in connected_components(simhash.links(frame, block), "a", "b").collect()}
        assert [found.get(i, i) for i in range(len(fps))] == want


def test_urls(spark):
    pages = [
        (1, "https://a.example.org/es/1", '<link rel="canonical" href="http://mirror.net/x">'), (2, "http://mirror.net/x", None), (3, "http://m2.net/y?z=1#f", '<META HTTP-EQUIV="refresh" content="0; url=http://mirror.net/x">'),
        (4, None, "<p>"), (5, "http://q.net/a", "<link href=/b rel=canonical>"), (6, "http://q.net/b", ""), (7, "nope", ""), (8, "HTTP://X.ORG/a", '<link rel=canonical href="http://w.net/1">'),
        (9, "http://w.net/1", '<link rel=canonical href="http://b.com/de/2">'), (10, "http://B.com/de/2", ""), (11, "http://com/fr/", ""), (12, "http://example.org/en/12?x", ""), (13, "http://notexample.org/en/12", ""), (6, "http://q.net/b", ""),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("verdict", F.lit("?"))
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(table).collect()}
    assert {k: v[3] for k, v in found.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "block", 11: "allow", 12: "block", 13: "allow"}
    assert found[3][:3] == ("m2.net", "/y", None) and found[4][:3] == ("", "", None) and found[12][2] == "example.org/en/1" and found[13][2] == "org/"
    assert urls.judge(table).count() == 14 and urls.judge(table.limit(0)).count() == 0
    more = spark.createDataFrame([("http://q.net/b", "https://z.com/de/")], "src string, dst string")
    assert {r["page_id"] for r in urls.judge(table, redirects=more).where("verdict = 'block'").collect()} == {1, 2, 3, 5, 6, 10, 12}


def test_urls_relative(spark):
    bases = ["http://h.net", "http://h.net/", "http://h.net/a/b/c?q=1#f", "HTTP://h.net/a/b/", "http://h.net/x/../a"]
    targets = ["page2.html", "?id=3", "../x", "sub/y", "./z", ".", "..", "../../../up", "/a/../b/.", "/b", "//m.net/p/./q", "http://m.net", "d?u=http://k.net/&v=../w", "#top", "a..b/...", "/"]
    pairs = spark.createDataFrame([(b, t, urllib.parse.urljoin(b, t)) for b in bases for t in targets], "b string, t string, joined string")
    for r in pairs.select("b", "t", urls._bound(urls.resolved(F.col("b"), F.col("t")), urls.key_of).alias("got"), urls.key_of(F.col("joined")).alias("want")).collect():
        assert r["got"] == r["want"] and "/./" not in r["got"] and "/../" not in r["got"].split("?")[0], r
    pages = [
        (1, "http://b.com/de/x", None), (2, "http://q.net/dir/two", '<link rel="alternate canonical" href="one?a=1&amp;b=2">'), (3, "http://q.net/dir/one?a=1&b=2", '<link rel="canonical" href="http://b.com/de/x">'),
        (4, "http://q.net", '<meta http-equiv="refresh" content="0; url=dir/two">'), (5, "http://q.net/k/l", "<link rel=canonical href=../>"), (6, "http://r.net/s/t", "<link rel=canonical href='?id=3'>"),
        (7, "http://r.net/s/t?id=3", '<base href="http://q.net/dir/"><link href=two rel=canonical>'), (8, "http://q.net/mail", "<link rel=canonical href=mailto:a@b.com/de/x>"), (9, "http://q.net/no", '<link rel="canonicals" href="dir/two"><link rel="next" href="dir/two">'),
    ]
    pages += [
        (10, "http://s.net/a", '<!-- <link rel="canonical" href="http://b.com/de/x"> --><p>'), (11, "http://s.net/b", '<link rel="canonical" href="http://s.net/c"><link rel=canonical href=http://b.com/de/x>'),
        (12, "http://s.net/c", None), (None, "http://s.net/c", ""), (13, None, "<link rel=canonical href=/x>"), (14, "http://s.net/d", '<meta http-equiv=refresh content="1;url=c"><meta http-equiv=refresh content="2;url=/q">'), (14, "http://s.net/d", ""),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = urls.judge(table).collect()
    assert {r["page_id"] for r in found if r["verdict"] == "block"} == {1, 2, 3, 4, 5, 6, 7, 11, 12, None, 14} and len(found) == len(pages)
    con = duckdb.connect()
    con.register("pages", table.toPandas().astype({"page_id": "Int64"}))
    assert sorted(map(str, con.execute(urls.SQL).fetchall())) == sorted(str(tuple(r)) for r in found)


def edits(a, b):
    """Word edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines(spark, docs, rows, none):
    rng = np.random.default_rng(5)
    base = ["a b c d e f g h i", "a a a a a a a a a a", "p q r s t u v w"]
    texts = []
    for i in range(40):
        lines = []
        for _ in range(4):
            words = base[rng.integers(3)].split()
            for _ in range(rng.integers(0, 4)):
                at, how = rng.integers(len(words)), rng.integers(3)
                words[at : at + (how != 1)] = [] if how == 0 else [str(rng.choice(list("abxyz")))]
            lines.append("  ".join(words) if rng.random() < 0.2 else " ".join(words))
        texts.append("\n".join(lines) + "\n \nshort")
    own = [(i, t) for i, t in enumerate(texts)] + [(r[0], r[1]) for r in rows[10:] if r[0] is not None and r[0] >= 40] + [(None, "a b c d e f g h i"), (77, None), (78, "")]
    earlier, want = [], {}
    for i, t in sorted((x for x in own if x[0] is not None), key=lambda x: x[0]):
        kept = []
        for line in (t or "").split("\n"):
            words = line.split()
            gone = bool(words) and any(words == e or (min(len(words), len(e)) >= 8 and abs(len(words) - len(e)) < 2 and edits(words, e) <= 1) for e in earlier)
            kept += [] if gone else [line]
            earlier += [words] if words else []
        want[i] = None if t is None else "\n".join(kept)
    want[None] = "a b c d e f g h i"
    found = linededup.dedup(spark.createDataFrame(own, "doc_id long, text string").withColumn("near", F.lit(1))).collect()
    assert {r["doc_id"]: r["text"] for r in found} == want and len(found) == len(own) and found[0]["near"] == 1
    assert linededup.dedup(none).count() == 0 and linededup.dedup(docs).count() == len(rows)
    clash = spark.createDataFrame([(1, "a b\na b", 5, 6, 7)], "doc_id long, text string, n_lines int, doc_of int, gone_at int")
    out = linededup.dedup(clash)
    assert out.columns == [*clash.columns, "n_lines_", "n_exact", "n_near"] and tuple(out.first()) == (1, "a b", 5, 6, 7, 2, 1, 0)
    short = [(1, "a\nb c\nb c d"), (2, "b x\nq r s t\nz"), (3, "r s t\nq r s u v")]
    left = {r["doc_id"]: r["text"] for r in linededup.dedup(spark.createDataFrame(short, "doc_id long, text string"), min_words=1).collect()}
    assert left == {1: "a\nb c", 2: "q r s t", 3: "q r s u v"}
    many = "\n".join(f"line {i // 2}" for i in range(30_000))
    assert linededup.dedup(spark.createDataFrame([(1, many)], "doc_id long, text string")).first()["text"] == "\n".join(f"line {i}" for i in range(15_000))
    python = [x for x in ("Python", "Pandas", "Arrow") if x in linededup.dedup(docs)._jdf.queryExecution().executedPlan().toString()]
    assert not python


def test_languages(spark, docs, rows, none):
    french = "le la les des une dans pour avec être qui est sur pas plus".split()
    own = [(i, prose(i, 60, french if i % 2 else WORDS), "fr" if i % 2 else "en", "s", 1.0) for i in range(60)] + [(70, None, "en", "s", 1.0), (71, "12 !", "en", "s", 1.0), (72, "le la les", None, None, None), (None, "the of", "en", None, None)]
    found = langid.identify(spark.createDataFrame(own, SCHEMA)).collect()
    got = {r["doc_id"]: r for r in found}
    assert len(found) == 64 and all(got[i]["lang_pred"] == ("fr" if i % 2 else "en") for i in range(60)) and got[72]["lang_pred"] == "fr"
    assert (got[70]["lang_pred"], got[71]["lang_pred"], got[70]["score"]) == ("und", "und", 0.0) and all(0 <= r["score"] <= 1 for r in found)
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"} and langid.identify(none).count() == 0
    told = langid.identify(docs)
    kept = langid.keep_known(docs)
    assert kept.count() == told.where("lang_pred <> 'und' and score > 0").count() and kept.columns == docs.columns
    assert kept.where("doc_id >= 10").count() == sum(r[0] is not None and r[0] >= 10 for r in rows)


def naive_trigrams(text):
    clean = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
    clean = re.sub(" +", " ", clean)
    return collections.Counter(clean[i : i + 3] for i in range(len(clean) - 2))


def test_languages_by_brute_force(spark):
    own = [(i, prose(i, 30, WORDS if i % 2 else "le la les des être été".split()), "en" if i % 2 else "fr") for i in range(40)] + [(50, "", "en"), (51, None, "fr"), (52, "Ünß 中文", None)]
    sign = lambda c: np.random.default_rng([langid.SEED, ord(c)]).integers(0, 2, langid.DIMS, np.int8).astype(int) * 2 - 1
    vector = lambda g: np.roll(sign(g[0]), 2) * np.roll(sign(g[1]), 1) * sign(g[2])
    profile = lambda counts: sum((n * vector(g) for g, n in counts.items()), np.zeros(langid.DIMS))
    learned = [profile(sum((naive_trigrams(t) for i, t, x in own if x == lang and zlib.crc32(str(i).encode()) % 3 != 1), collections.Counter())) for lang in ("en", "fr")]
    unit = np.stack([v / np.linalg.norm(v) for v in learned])
    centred = unit - unit.mean(0)
    centred /= np.linalg.norm(centred, axis=1, keepdims=True)
    for r in langid.identify(spark.createDataFrame(own, "doc_id long, text string, lang string")).collect():
        p = profile(naive_trigrams(next(t for i, t, _ in own if i == r["doc_id"])))
        if not p.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        near = centred @ p / np.linalg.norm(p)
        assert r["lang_pred"] == ("en", "fr")[int(near.argmax())] and abs(r["score"] - max(0, near.max())) < 1e-6


def test_long_texts_of_many_letters():
    rng, letters = np.random.default_rng(9), langid.Letters()
    han = "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 330_000))) + " — " * 9
    prototypes = rng.normal(size=(3, langid.DIMS))
    tracemalloc.start()
    sizes, near = langid.cosines(letters, [han, "ab", None], prototypes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6 and sizes.tolist() == [330_000, 2, 0]
    own = list(letters.runs([han], 1000))
    assert sum(len(p) for p, _ in own) - 2 * (len(own) - 1) == 330_002  # what runs repeat are two points each
    small = "Zwei ÄÖ 12 drei"
    a, b = (collections.Counter(tuple(p[i : i + 3]) for p, _ in letters.runs([small], n) for i in range(len(p) - 2)) for n in (3, 100))
    assert a == b and near.shape == (3, 3)


def test_unknown_languages_go(spark):
    vocabularies = {
        "en": WORDS, "fr": "le la les des une dans pour avec être qui est sur pas plus".split(),
        "de": "der die und das nicht ein eine mit sich auf für ist dem werden auch nach".split(),
    }
    rng = np.random.default_rng(6)
    noise = lambda alphabet: "".join(rng.choice(list(alphabet), 700))
    clean = [(i, prose(i, 120, v), k) for i, (k, v) in enumerate(list(vocabularies.items()) * 300)]
    code = "def f(x):\n    for k, v in x.items():\n        yield (k << 3) ^ v, {k: [v]}\n" * 20
    finnish = prose(1, 120, "ja on ei että hän mutta oli kun niin myös vain kuin sitä ovat joka tai".split())
    planted = [code, finnish] + [noise(a) for a in ("abcdefghijklmnopqrstuvwxyz   ", "абвгдежзиклмноп   ", "qxzjkvw ") for _ in range(4)]
    own = clean + [(5000 + i, t, None) for i, t in enumerate(planted)] + [(6000, None, "en"), (6001, "12 !", "en")]
    kept = {r["doc_id"] for r in langid.keep_known(spark.createDataFrame(own, "doc_id long, text string, lang string")).collect()}
    assert not [i for i in kept if i >= 5000] and len(kept) >= 0.98 * len(clean)
    counts = np.zeros((4, 10), int)
    counts[1, 5], counts[2, 7], counts[2, 2], counts[3, 9] = 100, 998, 2, 1
    assert langid.floors(counts, 0.005, 200).tolist() == [0, 0, 0.7, 0.7]


def naive_ppm(rows, order=ppm.ORDER):
    low = lambda t: (t or "").encode().lower()
    training = [t for i, t, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    count = collections.Counter(w for t in training for w in [*low(t).split(), "end"])
    tables = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for t in training:
        b = b"\xfe" * order + low(t) + b"\xff"
        for i in range(order, len(b)):
            for k in range(order + 1):
                tables[k][b[i - k : i]][b[i]] += 1
    n, v, out = sum(count.values()), len(count), []
    for i, t, *_ in rows:
        tokens, total, b = [*low(t).split(), "end"], 0.0, b"\xfe" * order + low(t) + b"\xff"
        for j in range(order, len(b)):
            out_of = set()
            for k in range(order, -1, -1):
                if not (f := tables[k].get(b[j - k : j])):
                    continue
                left = {s: c for s, c in f.items() if s not in out_of}
                whole = sum(left.values()) + len(left)
                if b[j] in left:
                    total += math.log10(left[b[j]] / whole)
                    break
                total += math.log10(len(left) / whole) if left else 0.0
                out_of |= set(f)
            else:
                total += math.log10(1 / (ppm.SYMBOLS - len(tables[0][b""])))
        out.append((str(i), len(tokens), sum(count[w] > 0 for w in tokens), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens), total))
    return sorted(out)


def test_ppm(docs, rows, none):
    want = naive_ppm(rows)
    for grams, words in ((10**6, 10**6), (300, 5)):
        found = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in ppm.score(docs, most_grams=grams, most_words=words).collect())
        assert [f[:4] for f in found] == [w[:4] for w in want]
        assert np.allclose([f[4:] for f in found], [w[4:] for w in want], rtol=1e-9)
    assert ppm.score(none).count() == 0
