"""SimHash fingerprints and near-duplicate groups by anchor-point covering.

Two fingerprints that differ in at most 3 bits differ in at most one bit of their left or of their right half. The anchors of
a half are the words of a covering code: the Hamming code of length 31, times the free last bit. Its covering radius is 1, so
each fingerprint has one home anchor within distance 1, and goes also to every anchor within 1 + 1 of its half (17 at most).
If two halves differ in one bit at most, the home of either is among the anchors of the other: comparing per anchor finds
every link. Anchors with many fingerprints are dealt to several tasks, in blocks that meet pairwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, free_name, in_arrow, map_batches, schema_of, tidy
from lectern.llm.graph import connected_components

BITS, THRESHOLD, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints of one anchor that are compared in one task; beyond it the anchor is dealt out in blocks.
BLOCK = 4096
#: Groups up to this size are compared row against shifted row for all groups at once.
SMALL = 48


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text; 0 if it is null or has no word."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist())), np.uint64, len(words) - k + 1)
    ones = np.zeros(BITS, np.int64)
    raw = hashes.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 1 << 16):
        ones += np.unpackbits(raw[at : at + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp long): fp holds the 64 bits as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return map_batches(docs.select(id_col, text_col), run, schema_of([docs.schema[id_col]], "fp long"), text_col)


_PLACES = np.arange(32, dtype=np.uint64)


def _half_anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """half: 32-bit values as uint64. Rows of 17 anchors each, home first; and which of them are valid."""
    bits = (half[:, None] >> _PLACES[None, :]) & np.uint64(1)
    # Bit p of 0..30 is column p + 1 of the check matrix; bit 31 is the free bit.
    syndrome = np.bitwise_xor.reduce(np.where(bits[:, :31] == 1, np.arange(1, 32, dtype=np.uint64), np.uint64(0)), axis=1)
    flip = lambda s: np.where(s > 0, np.uint64(1) << (np.maximum(s, np.uint64(1)) - np.uint64(1)), np.uint64(0))
    home = half ^ flip(syndrome)
    out = np.empty((len(half), 2 + 30), np.uint64)
    valid = np.zeros(out.shape, bool)
    out[:, 0], valid[:, 0] = home, True
    out[:, 1], valid[:, 1] = home ^ np.uint64(1 << 31), True
    at = 2
    for i in range(1, 32):
        j = syndrome ^ np.uint64(i)
        # Pairs i < j of columns whose sum is the syndrome: flipping both gives a word of the code.
        ok = (syndrome > 0) & (j > i)
        if at < out.shape[1]:
            out[:, at] = half ^ flip(np.full(len(half), i, np.uint64)) ^ flip(j)
            valid[:, at] = ok
            at += 1
    return out, valid


def anchored(fps: DataFrame) -> DataFrame:
    """fps (fp, rep). A row (anchor, fp, rep) for every anchor that a fingerprint goes to."""

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 20_000):
                batch = whole.slice(start, 20_000)
                fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                rep = batch.column(1).to_numpy(zero_copy_only=False)
                for side, half in enumerate((fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF))):
                    anchors, valid = _half_anchors(half)
                    row = np.nonzero(valid)[0]
                    key = anchors[valid] | np.uint64(side << 32)
                    yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(fp[row].view(np.int64)), pa.array(rep[row])], names=["anchor", "fp", "rep"])

    return in_arrow(fps.select("fp", "rep"), run, "anchor long, fp long, rep long")


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= THRESHOLD


def _forest(fp: np.ndarray, rep: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of one large group that connect what its links connect; each fingerprint is reached once."""
    left, links, queue = np.arange(len(fp)), [], []
    while len(left) or queue:
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        hit = _near(fp[left], fp[at])
        if hit.any():
            got = left[hit]
            links.append((np.full(len(got), rep[at]), rep[got]))
            queue.extend(got.tolist())
            left = left[~hit]
    return links


def _group_links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links inside each run of equal keys. Rows come sorted by key."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    links = []
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        links += _forest(fp[s : s + n], rep[s : s + n])
    few = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    run, fp, rep = np.repeat(starts, sizes)[few], fp[few], rep[few]
    for k in range(1, SMALL):
        same = run[k:] == run[:-k]
        if not same.any():
            break
        hit = same & _near(fp[k:], fp[:-k])
        links.append((rep[:-k][hit], rep[k:][hit]))
    return links


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """fps (fp, rep), fp distinct. (a, b): pairs of rep that connect what links of at most 3 bits connect."""
    rows = cut(anchored(fps))
    heavy = rows.groupBy("anchor").count().where(F.col("count") > block).select("anchor", F.ceil(F.col("count") * 2 / block).cast("int").alias("k"))
    # An anchor of k blocks has a task for each two of them; every fingerprint goes to the k tasks of its block.
    dealt = (
        rows.join(heavy, "anchor", "left")
        .withColumn("mine", F.when(F.col("k").isNotNull(), F.pmod(F.xxhash64("fp", F.lit(7)), F.col("k")).cast("int")))
        .withColumn("other", F.explode(F.when(F.col("k").isNotNull(), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array(F.lit(0)))))
        .withColumn("key", F.when(F.col("k").isNull(), F.xxhash64("anchor")).otherwise(F.xxhash64("anchor", F.least("mine", "other"), F.greatest("mine", "other"))))
    )

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            last = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on in the next batch
            held = [x[last:] for x in now]
            yield from out([x[:last] for x in now])
        if held is not None:
            yield from out(held)

    def out(rows):
        key, fp, rep = rows
        if len(key) > 1 and (found := _group_links(key, fp.view(np.uint64), rep)):
            a, b = (np.concatenate(x) for x in zip(*found))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            if len(pairs):
                yield pa.record_batch([pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], names=["a", "b"])

    return in_arrow(dealt.select("key", "fp", "rep").repartition("key").sortWithinPartitions("key"), run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of docs. component_id is the smallest id that links of at most 3
    differing bits reach, itself included; ids are whole numbers. Null and word-less texts have fingerprint zero and link like
    any other; texts of any length are read in whole. Repeated rows come out repeated. A row with a null id is in its group and
    links what it links, but gives it no name; a group of such rows only has none. Other columns of docs are not looked at. An
    empty table gives an empty result."""
    with tidy() as keep:
        own = keep(cut(fingerprints(docs, id_col, text_col)))
        reps = cut(own.groupBy("fp").agg(F.min(id_col).cast("long").alias("rep")))
        # Links are between fingerprints, as one that only rows without an id have links others too.
        groups = connected_components(links(reps.select("fp", F.col("fp").alias("rep"))), "a", "b")
        joined = reps.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
        least = joined.groupBy(F.col("component").alias("c")).agg(F.min("rep").alias("component_id"))
        named = keep(cut(joined.join(least, F.col("component") == F.col("c")).select(F.col("fp").alias("f"), "component_id")))
    return own.join(named, F.col("fp") == F.col("f")).select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id names their group: one document of each group stays, with all its columns. Of rows that
    repeat an id, the one with the least text stays (a null is less than any); rows with a null id stay."""
    key = free_name("keep", *docs.columns)
    with tidy() as keep:
        own = near_duplicates(docs, id_col, text_col)
        named = keep(cut(own.where(F.col(id_col) == F.col("component_id")).groupBy(F.col(id_col).alias(key)).count()))
    kept = docs.join(named.select(key), F.col(id_col) == F.col(key), "left_semi")
    if not named.where("count > 1").isEmpty():
        whole = F.struct(*(F.col(c) for c in docs.columns))
        kept = kept.groupBy(F.col(id_col).alias(key)).agg(F.min_by(whole, F.struct(F.col(text_col), F.xxhash64(*(F.col(c).cast("string") for c in docs.columns)))).alias("row")).select("row.*")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
