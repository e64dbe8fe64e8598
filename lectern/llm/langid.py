"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs. An n-gram's vector binds its letters' vectors, each permuted once more than the one
behind it (a cyclic shift), by multiplication; a text's profile is the sum of its n-grams' vectors, and a language's prototype
the sum of its training texts'. A text gets the language whose prototype has the largest cosine with its profile. Prototypes
are centred on their mean first, so that what all languages share does not count.

Centred prototypes cannot tell that a text is unlike all of them, as some cosine is always positive. So whether a text is in a
known language at all is judged by the prototypes as they are, and by a floor for texts of its length: the longer a text, the
more it resembles its language.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import free_name, held_out, in_arrow, map_batches, release, schema_of, slices, worker_held

ORDER, DIMS, SEED = 3, 512, 42
#: Points that are worked on together, and n-grams whose vectors are made at a time; they bound a worker's memory.
RUN, BLOCK = 250_000, 4096
UNKNOWN = "und"
#: Of the labelled rows, the share that the floors may drop; no floor is set on fewer rows than can show such a share.
LOSS = 0.005
LEAST_ROWS, BINS, SIZES = round(1 / LOSS), 1000, 64


class Letters:
    """Vectors of letters, made when first seen; each depends on nothing but the letter."""

    def __init__(self, dims: int = DIMS):
        self.dims, self.known = dims, {}
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def vectors(self, letters: np.ndarray) -> np.ndarray:
        out = np.empty((len(letters), self.dims), np.int8)
        for i, c in enumerate(letters.tolist()):
            if c not in self.known:
                self.known[c] = np.random.default_rng([SEED, c]).integers(0, 2, self.dims, np.int8) * 2 - 1
            out[i] = self.known[c]
        return out

    def _points(self, lower: str) -> tuple[np.ndarray, np.ndarray]:
        """Code points, those of other characters than letters as blanks; and which are letters."""
        points = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letter = self.is_letter[points]
        return np.where(letter, points, 32), letter

    def _together(self, held: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
        points, letter = self._points("".join(t for _, t in held))
        doc = np.repeat([i for i, _ in held], [len(t) for _, t in held])
        kept = letter.copy()
        kept[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
        kept[:1] = True
        return points[kept], doc[kept]

    def runs(self, texts: list[str | None], size: int = RUN) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of about size points, and whose text each is of. Texts are lower-cased, runs of other characters than letters
        count as one blank, and blanks surround each text. A longer text comes in several runs, each of which begins with the
        last two points of the one before, so that every trigram is in exactly one."""
        held, total = [], 0
        for i, t in enumerate(texts):
            lower = " " + (t or "").lower() + " "
            if len(lower) <= size:
                held.append((i, lower))
                total += len(lower)
                if total >= size:
                    yield self._together(held)
                    held, total = [], 0
                continue
            before, last = True, np.empty(0, np.int64)
            for at in range(0, len(lower), size):
                points, letter = self._points(lower[at : at + size])
                kept = letter.copy()
                kept[1:] |= letter[:-1]
                kept[0] |= before
                before, own = letter[-1], np.concatenate([last, points[kept]])
                yield own, np.full(len(own), i)
                last = own[-2:]
        if held:
            yield self._together(held)

    def trigrams(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each run: its distinct letters; its distinct trigrams, as places among them; and for all its trigrams their text
        and their place among the distinct ones."""
        for points, doc in self.runs(texts):
            if len(points) < ORDER:
                continue
            own, at = np.unique(points, return_inverse=True)
            n = len(own)
            key, within = at[:-2] * n * n + at[1:-1] * n + at[2:], doc[:-2] == doc[2:]
            coded = pa.array(key[within]).dictionary_encode()
            yield own, coded.dictionary.to_numpy(), doc[2:][within], coded.indices.to_numpy().astype(np.int64)

    def blocks(self, own: np.ndarray, grams: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The trigrams' vectors, BLOCK at a time, and the place of the first."""
        base, n = self.vectors(own), len(own)
        for at in range(0, len(grams), BLOCK):
            g = grams[at : at + BLOCK]
            yield at, (np.roll(base[g // (n * n)], 2, 1) * np.roll(base[g // n % n], 1, 1) * base[g % n]).astype(np.float32)


def letters_of(dims: int) -> Letters:
    """One for each worker: the table of letters takes a while to make."""
    held = worker_held()
    if ("letters", dims) not in held:
        held["letters", dims] = Letters(dims)
    return held["letters", dims]


def cosines(letters: Letters, texts: list[str | None], prototypes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many n-grams each text has, and its cosine with each prototype; 0 for texts that are null or have no letter. Vectors
    are made for a block of n-grams at a time, whatever the number of distinct ones."""
    n = len(texts)
    sizes, dots, profiles = np.zeros(n, np.int64), np.zeros((n, len(prototypes))), np.zeros((n, prototypes.shape[1]))
    for own, grams, doc, code in letters.trigrams(texts):
        sizes += np.bincount(doc, minlength=n)
        # Sorted by block, text and n-gram.
        key, counts = np.unique((code // BLOCK * n + doc) * BLOCK + code % BLOCK, return_counts=True)
        of, place, counts = key // BLOCK, key % BLOCK, counts.astype(np.float32)
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
        spans = [*zip(starts.tolist(), [*starts[1:].tolist(), len(of)], of[starts].tolist())]
        for at, vectors in letters.blocks(own, grams):
            near, low, high = vectors @ prototypes.T, at // BLOCK * n, (at // BLOCK + 1) * n
            first, last = bisect.bisect_left(spans, low, key=lambda s: s[2]), bisect.bisect_left(spans, high, key=lambda s: s[2])
            for a, b, o in spans[first:last]:
                dots[o - low] += counts[a:b] @ near[place[a:b]]
                profiles[o - low] += counts[a:b] @ vectors[place[a:b]]
    return sizes, dots / np.maximum(np.linalg.norm(profiles, axis=1), 1e-12)[:, None]


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = DIMS) -> tuple[list[str], np.ndarray]:
    """The languages and their prototypes, of unit length, out of all rows with a text and a language. What comes to the driver
    is a vector for each language."""

    def run(batches):
        letters, sums = letters_of(dims), {}
        for whole in batches:
            for batch in slices(whole, text_col):
                langs = batch.column(1).dictionary_encode()
                found, which = langs.dictionary.to_pylist(), langs.indices.to_numpy().astype(np.int64)
                for own, grams, doc, code in letters.trigrams(batch.column(0).to_pylist()):
                    # Sums of up to RUN signs: float32 holds them exactly.
                    counts = np.bincount(which[doc] * len(grams) + code, minlength=len(found) * len(grams)).reshape(len(found), -1).astype(np.float32)
                    for at, vectors in letters.blocks(own, grams):
                        for lang, part in zip(found, counts[:, at : at + BLOCK] @ vectors):
                            sums[lang] = sums.get(lang, 0) + part.astype(np.float64)
            release()
        for lang, v in sums.items():
            yield pa.record_batch([pa.array([lang] * dims), pa.array(np.arange(dims, dtype=np.int32)), pa.array(v)], names=["lang", "at", "v"])

    rows = docs.select(text_col, lang_col).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    summed = in_arrow(rows, run, "lang string, at int, v double").groupBy("lang", "at").agg(F.sum("v").alias("v"))
    found = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("v")).orderBy("lang").collect()
    if not found:
        return [], np.empty((0, dims))
    raw = np.array([[x["v"] for x in r["v"]] for r in found])
    return [r["lang"] for r in found], raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = DIMS) -> tuple[list[str], np.ndarray]:
    """What learn() finds, the prototypes centred."""
    langs, unit = learn(docs, text_col, lang_col, dims)
    centred = unit - unit.mean(0) if len(unit) > 1 else unit
    return langs, centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """keep, and under names the language and its score: the cosine with the nearest prototype, at least 0; UNKNOWN and 0 for a text that is null or
    has no letter, or where no language was learned. Ties go to the language first in order."""
    dims, own = prototypes.shape[1], free_name("text", *keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        letters = letters_of(dims)
        texts = batch.column(len(keep)).to_pylist()
        sizes, found = cosines(letters, texts, prototypes)
        said, scores = [], []
        for size, near in zip(sizes.tolist(), found):
            if not size or not langs:
                said.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(near.argmax())
            said.append(langs[best])
            scores.append(min(1.0, max(0.0, float(near[best]))))
        return pa.record_batch([*batch.columns[: len(keep)], pa.array(said, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *names])

    schema = schema_of([docs.schema[c] for c in keep], f"{names[0]} string, {names[1]} double")
    return map_batches(docs.select(*keep, F.col(text_col).alias(own)), run, schema, own)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dims: int = DIMS) -> DataFrame:
    """For every row of docs: id_col, held_out, lang_pred and score. Learns from the rows that are not held out and have a
    text and a language. Repeated rows come out repeated; rows with a null id are held out; other columns are not looked at.
    Texts of any length are read in whole, in runs of bounded size; of equally near languages the first in order wins. Without
    training rows all are UNKNOWN, and an empty table gives an empty result."""
    own = docs.select(F.col(id_col), F.col(text_col), F.col(lang_col), held_out(id_col, 3, 1).alias("held_out"))
    langs, prototypes = train(own.where(~F.col("held_out")), text_col, lang_col, dims)
    return predict(own, langs, prototypes, [id_col, "held_out"], text_col)


def floors(counts: np.ndarray, loss: float = LOSS, least_rows: int = LEAST_ROWS) -> np.ndarray:
    """The floor for each size out of counts of rows by size and score (the rows and columns): the highest that drops at most
    the share loss of a size's rows. A size with fewer than least_rows rows is taken together with the next smaller ones, whose
    scores are lower, until there are as many; where they don't suffice the floor is 0."""
    out = np.zeros(len(counts))
    for size in range(len(counts)):
        pool, at = counts[size].copy(), size
        while pool.sum() < least_rows and at:
            at -= 1
            pool += counts[at]
        if pool.sum() >= least_rows:
            out[size] = int(np.argmax(np.cumsum(pool) > loss * pool.sum())) / counts.shape[1]
    return out


def calibrate(docs: DataFrame, langs: list[str], prototypes: np.ndarray, text_col: str = "text", lang_col: str = "lang") -> np.ndarray:
    """Floors by the bit length of a text's number of n-grams, out of the cosines of all rows with the prototype of the language
    that they are labelled with."""
    dims, place = prototypes.shape[1], {lang: i for i, lang in enumerate(langs)}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        letters = letters_of(dims)
        sizes, found = cosines(letters, batch.column(0).to_pylist(), prototypes)
        own = found[np.arange(len(sizes)), [place[x] for x in batch.column(1).to_pylist()]]
        bits, bins = np.array([int(n).bit_length() for n in sizes], np.int32), np.clip(own * BINS, 0, BINS - 1).astype(np.int32)
        return pa.record_batch([pa.array(bits[sizes > 0]), pa.array(bins[sizes > 0])], names=["size", "bin"])

    rows = docs.select(text_col, lang_col).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = np.zeros((SIZES, BINS), np.int64)
    for r in map_batches(rows, run, "size int, bin int", text_col).groupBy("size", "bin").count().collect():
        counts[r["size"], r["bin"]] = r["count"]
    return floors(counts)


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", above: float = 0.0, dims: int = DIMS) -> DataFrame:
    """The rows of docs, whole, that are in some known language: whose cosine with the nearest prototype, not centred, is above
    `above` and not under the floor for texts of that length. Learns prototypes and floors from the rows that identify() learns
    from; the floors drop at most LOSS of them. Where fewer than LEAST_ROWS of them are as short, `above` alone counts; without
    training rows nothing is dropped but texts that are null or have no letter. All columns come through, whatever their names;
    repeated rows stay or go together, and an empty table gives an empty result."""
    training = docs.where(~held_out(id_col, 3, 1))
    langs, prototypes = learn(training, text_col, lang_col, dims)
    if not langs:
        return docs.where(F.regexp_like(text_col, F.lit(r"\p{L}")))
    least = calibrate(training, langs, prototypes, text_col, lang_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        letters = letters_of(dims)
        sizes, found = cosines(letters, batch.column(text_col).to_pylist(), prototypes)
        best = found.max(1)
        return batch.filter(pa.array((sizes > 0) & (best > above) & (best >= least[[int(n).bit_length() for n in sizes]])))

    return map_batches(docs, run, docs.schema, text_col)
