"""Quality rules: statistics of each text, and an isolation forest over them.

A tree of the forest splits a small sample of rows at random places of random statistics; a row that few splits set apart is
odd. There is a forest for the statistics of characters and one for those of words and lines. They are grown on a bounded sample
of labelled rows, mostly good ones, and the anomaly from which on a document is dropped is calibrated over all labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, held_out, in_arrow, map_batches, schema_of, tidy

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_marks", "n_digits", "n_distinct")
#: Bounds of the labelled sample that the forests are grown on, trees of a forest, rows of a tree.
GOOD_ROWS, BAD_ROWS, TREES, TREE_ROWS = 4096, 96, 128, 256
#: Of the good labelled rows, the share that the threshold of each forest may drop.
GOOD_LOSS = 0.001
BINS = 4096
KINDS = ("chars", "words")
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(WINDOW)]


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of so many words that the list holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(window):
        rolled += h[k : k + n] * _POWERS[k]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return 0
    repeated = np.zeros(n, bool)
    repeated[order[1:][same]] = repeated[order[:-1][same]] = True
    code: dict[bytes, int] = {}
    codes = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words))
    a, b = order[:-1][same], order[1:][same]
    if any((codes[a + k] != codes[b + k]).any() for k in range(window)):  # windows of one hash that differ: count them in full
        seen: dict[tuple, list[int]] = {}
        for i in range(n):
            seen.setdefault(tuple(words[i : i + window]), []).append(i)
        repeated[:] = False
        for at in seen.values():
            repeated[at] = len(at) > 1
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(repeated)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_statistics(text: str | None) -> tuple[int, ...]:
    """BASE and MORE of one text; of a null text all are 0."""
    raw = (text or "").encode()
    words = raw.split()
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = int(len(raw) - count[0x80:0xC0].sum())
    white = int(count[0x20] + count[9:14].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper = sum(map(str.isupper, text)) if text and not text.isascii() else int(count[65:91].sum())
    marks, digits = int(count[[33, 63, 58, 59, 124, 61, 95, 126]].sum()), int(count[48:58].sum())
    return len(words), points - white, int(count[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeat_words(words), len(lines), upper, marks, digits, len(set(words))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the statistics (long) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [text_statistics(t) for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=[id_col, *BASE, *MORE])

    schema = schema_of([docs.schema[id_col]], ", ".join(f"{c} long" for c in BASE + MORE))
    return map_batches(docs.select(id_col, text_col), run, schema, text_col)


def features(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rates out of the statistics, a row of numbers for each document, in two kinds: of characters, and of words and lines. Each
    kind has a forest of its own, as splits at many calm statistics hide a few telling ones."""
    c = {k: np.asarray(v, np.float64) for k, v in columns.items()}
    chars, words, lines = c["word_chars"], c["n_words"], c["n_lines"]
    # A few characters, words or lines more keep short texts from standing out.
    return {
        "chars": np.stack([c["n_symbols"] / (chars + 20), c["n_upper"] / (chars + 200), c["n_marks"] / (chars + 20)], 1),
        "words": np.stack([chars / (words + 1), np.log(c["n_distinct"] + 1) / np.log(words + 2), c["n_repeat_words"] / (words + 20), c["n_dup_lines"] / (lines + 4), np.log((words + 20) / (lines + 1)), c["n_digits"] / (chars + 20)], 1),
    }


class Forest:
    """An isolation forest in flat arrays: a node's children stand at 2i + 1 and 2i + 2."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.rows, self.depth = min(tree_rows, len(rows)), max(1, int(np.ceil(np.log2(max(2, min(tree_rows, len(rows)))))))
        size = (2 << self.depth) - 1
        self.feature, self.value, self.path = np.full((trees, size), -1, np.int16), np.zeros((trees, size)), np.zeros((trees, size))
        for t in range(trees):
            self._grow(t, 0, 0, rows[rng.choice(len(rows), self.rows, replace=False)], rng)

    @staticmethod
    def _rest(n: int) -> float:
        """Mean further path of n rows that are not split."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, t: int, at: int, depth: int, rows: np.ndarray, rng) -> None:
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
        wide = np.flatnonzero(high > low)
        if depth == self.depth or len(rows) < 2 or not len(wide):
            self.path[t, at] = depth + self._rest(len(rows))
            return
        f = int(rng.choice(wide))
        v = rng.uniform(low[f], high[f])
        self.feature[t, at], self.value[t, at] = f, v
        left = rows[:, f] <= v
        self._grow(t, 2 * at + 1, depth + 1, rows[left], rng)
        self._grow(t, 2 * at + 2, depth + 1, rows[~left], rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1 for each row: above one half the odder, the higher."""
        total = np.zeros(len(x))
        own = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, at]
                at = np.where(f < 0, at, 2 * at + 1 + (x[own, np.maximum(f, 0)] > self.value[t, at]))
            total += self.path[t, at]
        return 2.0 ** (-total / len(self.feature) / max(self._rest(self.rows), 1e-9))


def _scored(stats: DataFrame, forests: dict[str, Forest], keep: list[str]) -> DataFrame:
    """keep and an anomaly_ of each kind."""
    names = [f"anomaly_{k}" for k in KINDS]
    schema = schema_of([stats.schema[c] for c in keep], ", ".join(f"{name} double" for name in names))

    def run(batches):
        for batch in batches:
            rates = features({c: batch.column(c).to_numpy(zero_copy_only=False) for c in BASE + MORE})
            found = [forests[k].score(rates[k]) if k in forests else np.zeros(batch.num_rows) for k in KINDS]
            yield pa.record_batch([*(batch.column(c) for c in keep), *map(pa.array, found)], names=[*keep, *names])

    return in_arrow(stats.select(*dict.fromkeys([*keep, *BASE, *MORE])), run, schema)


def _failed():
    """What the base rules drop."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def threshold(good: np.ndarray, bad: np.ndarray, good_loss: float) -> float:
    """From counts by anomaly (BINS to 1) of good and bad rows, the anomaly from which on rows are dropped: the lowest that drops
    at most good_loss of all good ones, or above it where a drop hits more bad rows than good ones; 2 where that is nowhere."""
    above_good, above_bad = good[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1]
    first = int(np.argmax(above_good <= good_loss * max(1, good.sum())))
    gain = above_bad[first:] - above_good[first:]
    return float(first + int(np.argmax(gain))) / BINS if gain.max() > 0 else 2.0


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", good_rows: int = GOOD_ROWS, bad_rows: int = BAD_ROWS, good_loss: float = GOOD_LOSS) -> tuple[dict[str, Forest], dict[str, float]]:
    """The forests, and for each the anomaly from which on documents are dropped. Only labels of ids whose crc32 (as text) mod 3
    is not 1 are looked at, so that the others can tell how well it does. The sample of good_rows and bad_rows is that of the
    smallest hashes of ids; rows that the base rules drop are left out. The thresholds come from all labelled rows, see
    threshold(). Without labelled rows nothing is dropped."""
    own = labels.where(~held_out(id_col, 3, 1)).groupBy(F.col(id_col).alias("labelled")).agg(F.max(label_col).alias("good")).where("good is not null")
    rows = cut(stats.where(~_failed()).select(F.col(id_col).alias("id"), *BASE, *MORE).join(own, F.col("id") == F.col("labelled")))
    some = [r for good, most in ((1, good_rows), (0, bad_rows)) for r in rows.where(F.col("good") == good).orderBy(F.xxhash64("id"), "id", *BASE, *MORE).limit(most).select(*BASE, *MORE).collect()]
    if not some:
        return {}, dict.fromkeys(KINDS, 2.0)
    rates = features({c: np.array([r[c] for r in some]) for c in BASE + MORE})
    forests = {k: Forest(rates[k]) for k in KINDS}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.floor(F.col(f"anomaly_{k}") * BINS).cast("int").alias("bin")) for k in KINDS))).alias("e")
    hits = {(k, good): np.zeros(BINS + 2) for k in KINDS for good in (False, True)}
    for r in _scored(rows, forests, ["good"]).select("good", each).groupBy("e.kind", "e.bin", "good").count().collect():
        hits[r["kind"], r["good"] > 0][r["bin"]] += r["count"]
    return forests, {k: threshold(hits[k, True], hits[k, False], good_loss) for k in KINDS}


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """For every row of docs: id_col, the BASE statistics, base_failed, kept, the MORE statistics, and of each kind of statistics
    the anomaly and its threshold. Dropped is what the base rules drop, and what is as odd as a threshold, or odder.

    base_failed: fewer than MIN_WORDS words, or more than MAX_REPEAT_PERCENT of them in repeated windows; such rows are not
    kept, whatever the forests say. A null text counts as empty; a text of any length is read in whole. Repeated rows are judged
    each on their own, and equal texts alike; labels of an id that occurs twice count once, as good if any is; null labels don't
    count. Without labels only the base rules drop. Other columns are not looked at; an empty table gives an empty result."""
    with tidy() as keep:
        stats = keep(cut(statistics(docs, id_col, text_col)))
        forests, least = fit(stats, labels, id_col, label_col)
    scored, failed = _scored(stats, forests, [id_col, *BASE, *MORE]), _failed()
    calm = ~failed
    for k in KINDS:
        calm = calm & (F.col(f"anomaly_{k}") < least[k])
    return scored.select(id_col, *BASE, failed.alias("base_failed"), calm.alias("kept"), *MORE, *(x for k in KINDS for x in (F.col(f"anomaly_{k}"), F.lit(least[k]).alias(f"threshold_{k}"))))
