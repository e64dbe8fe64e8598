"""Quality classifier by compression: the better of two dictionaries tells the class.

A zstandard dictionary is trained on good and one on bad labelled text. Each text is compressed with either, in pieces short
enough that the dictionary matters, and the difference of the sizes over their sum becomes the score: a monotone curve, fitted
over all labelled training rows, maps it to the share of good rows there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from lectern.llm.common import cut, held_out, in_arrow, map_batches, schema_of, tidy

PIECE = 2048
#: Labelled rows of each class, and pieces of their texts, in the sample that a dictionary is trained on; bytes of a dictionary.
SAMPLE_ROWS, SAMPLE_PIECES, DICT_BYTES, LEVEL = 2048, 2048, 65_536, 3
BINS = 2000


def pieces(text: str | None, size: int = PIECE) -> list[bytes]:
    raw = (text or "").encode()
    return [raw[i : i + size] for i in range(0, len(raw), size)]


class Model:
    """Two dictionaries and the curve from the size difference to the score."""

    def __init__(self, good: bytes, bad: bytes, knots: tuple[list[float], list[float]] = ([0.0], [0.5])):
        self.good, self.bad, self.knots = good, bad, knots

    def coders(self) -> list:
        made = []
        for content in (self.good, self.bad):
            data = zstandard.ZstdCompressionDict(content) if content else None
            if data:
                data.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False))
        return made

    def score(self, difference: np.ndarray) -> np.ndarray:
        return np.interp(difference, *self.knots)


def train(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary of the samples; of samples too few to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def monotone(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[list[float], list[float]]:
    """The rising curve nearest to good / n over x: pools neighbours that fall."""
    blocks: list[list[float]] = []
    for at, g, w in zip(x, good, n):
        blocks.append([at * w, g, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return [b[0] / b[2] for b in blocks], [(b[1] + 0.5) / (b[2] + 1) for b in blocks]


def difference_of(coders: list, texts: list[str | None]) -> np.ndarray:
    """(size with the bad dictionary - size with the good one) / their sum, over all pieces of each text; of an empty one 0."""
    out, (good, bad) = np.zeros(len(texts)), coders
    for i, text in enumerate(texts):
        if own := pieces(text):
            g, b = (sum(len(c.compress(p)) for p in own) for c in (good, bad))
            out[i] = (b - g) / (b + g)
    return out


def differences(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(id_col, held_out, difference) of every row."""
    cache: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache[:] = cache or model.coders()
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(difference_of(cache, batch.column(2).to_pylist()))], names=[id_col, "held_out", "difference"])

    own = docs.select(F.col(id_col), held_out(id_col, 3, 1).alias("held_out"), F.col(text_col).alias("__text"))
    return map_batches(own, run, schema_of([docs.schema[id_col]], "held_out boolean, difference double"), "__text")


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int = SAMPLE_ROWS, sample_pieces: int = SAMPLE_PIECES) -> tuple[Model, DataFrame]:
    """The model, and (id_col, held_out, difference) of every row of docs. Labels of held-out rows are not looked at. The sample
    is bounded: of each class the sample_rows labelled rows of the smallest hashes, and of their pieces the sample_pieces of the
    smallest hashes; ties go by id, place and bytes. Only these rows' ids meet the texts, so no text is shuffled."""
    with tidy() as keep:
        own = cut(labels.where(~held_out(id_col, 3, 1)).groupBy(F.col(id_col).alias("labelled")).agg(F.max(label_col).cast("int").alias("good")).where("good is not null"))
        first = lambda g: own.where(F.col("good") == g).orderBy(F.xxhash64("labelled"), "labelled").limit(sample_rows)
        picked = cut(first(1).union(first(0)))
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), F.col("id") == F.col("labelled"))

        def chop(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, texts, good = (c.to_pylist() for c in batch.columns)
            found = [(i, k, p, g) for i, t, g in zip(ids, texts, good) for k, p in enumerate(pieces(t))]
            return pa.record_batch([pa.array([x[j] for x in found], kind) for j, kind in enumerate((batch.column(0).type, pa.int32(), pa.binary(), pa.int32()))], names=["id", "k", "piece", "good"])

        schema = schema_of([StructField("id", docs.schema[id_col].dataType)], "k int, piece binary, good int")
        chopped = cut(map_batches(rows.select("id", "text", "good"), chop, schema))
        top = lambda g: [bytes(r["piece"]) for r in chopped.where(F.col("good") == g).orderBy(F.xxhash64("id", "k"), "id", "k", "piece").limit(sample_pieces).select("piece").collect()]
        good, bad = top(1), top(0)
        model = Model(train(good), train(bad))
        found = keep(cut(differences(docs, model, id_col, text_col)))
        if not good or not bad:
            model.knots = ([0.0], [0.5 if not good and not bad else float(bool(good))])
            return model, found
        told = found.select(F.col(id_col).alias("id"), "difference").join(own, F.col("id") == F.col("labelled"))
        bins = told.groupBy(F.floor((F.col("difference") + 1) / 2 * BINS).alias("bin")).agg(F.avg("difference").alias("x"), F.sum("good").alias("good"), F.count("*").alias("n")).orderBy("bin").collect()
        model.knots = monotone(np.array([r["x"] for r in bins]), np.array([r["good"] for r in bins], float), np.array([r["n"] for r in bins], float))
        return model, found


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """For every row of docs: id_col, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from 0.5 on) and
    difference.

    Null and empty texts get the score of no difference; a text of any length is compressed in whole, piece by piece. Labels of
    an id that occurs twice count once, as 1 if any is; null labels don't count. Without labels of both classes every score is
    the share of label 1, or 0.5 without any. Repeated rows come out repeated; equal texts get equal scores; other columns, such
    as source, are not looked at. An empty table gives an empty result."""
    model, found = fit(docs, labels, id_col, text_col, label_col)

    def run(batches):
        for batch in batches:
            score = model.score(batch.column(2).to_numpy(zero_copy_only=False))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), batch.column(2)], names=[id_col, "held_out", "score", "predicted", "difference"])

    schema = schema_of([docs.schema[id_col]], "held_out boolean, score double, predicted int, difference double")
    return in_arrow(found.select(id_col, "held_out", "difference"), run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.5) -> DataFrame:
    """The rows of docs, whole, whose score, that of classify(), is at least least. Without labels all stay. All columns come
    through, whatever their names. (Texts are compressed once more here than for the curve, which costs less than to write
    them beside their differences.)"""
    with tidy():
        model, _ = fit(docs, labels, id_col, text_col, label_col)
    cache: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache[:] = cache or model.coders()
        return batch.filter(pa.array(model.score(difference_of(cache, batch.column(text_col).to_pylist())) >= least))

    return map_batches(docs, run, docs.schema, text_col)
