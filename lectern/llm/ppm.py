"""Language-model scores by prediction by partial matching, beside an add-one unigram score.

The model is a trie of byte contexts of up to ORDER bytes, kept as tables of (context and next byte, count), gathered from all
training texts. A byte is coded in its longest context; where the context has never been followed by it, an escape (method C:
as likely as the number of distinct followers) leads to the next shorter context, in which all symbols that were already ruled
out are excluded. Below the empty context every symbol is equally likely. Texts begin with padding, and end with an end symbol.

What is frequent, a bounded number of grams and words, is broadcast to the tasks that score. What a task misses there it hands
on as rows, which meet the whole tables in joins; so no bound decides about a result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.llm.common import cut, held_out, in_arrow, release, slices, tidy

ORDER = 4
#: Bytes that UTF-8 never has: padding before a text, and the symbol after it. Symbols: 254 bytes and the end.
PAD, END, SYMBOLS = 0xFE, 0xFF, 255
#: Grams and words that are broadcast at most.
MOST_GRAMS, MOST_WORDS = 1_000_000, 250_000
#: Distinct keys that a counting task holds before it hands them on.
HELD = 1_000_000


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all (context, next) of the lower-cased texts, one text behind the other; where each text's end."""
    raw = [(t or "").encode() for t in texts]
    joined = b"".join([b"\xfe" * ORDER + r.lower() + b"\xff" for r in raw])
    a = np.frombuffer(joined, np.uint8).astype(np.int64)
    n = len(a) - ORDER
    codes = np.zeros(max(n, 0), np.int64)
    for k in range(ORDER + 1):
        codes <<= 8
        codes |= a[k : k + n]
    ends = np.cumsum([len(r) + 1 + ORDER for r in raw])
    own = np.ones(max(n, 0), bool)  # a code whose next byte is padding spans two texts
    own[a[ORDER:] == PAD] = False
    return codes[own], ends - ORDER * np.arange(1, len(raw) + 1)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the lower-cased texts, and where each text's end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[ends]


def _counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(code, word, n): counts of grams (code) and of words (word) of all texts; code -1 counts the texts."""

    def merged(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("k").aggregate([("n", "sum")]).rename_columns(["k", "n"])

    def out(code=None, word=None, n=None):
        size = len(n)
        return pa.record_batch([code if code is not None else pa.nulls(size, pa.int64()), word if word is not None else pa.nulls(size, pa.string()), n], names=["code", "word", "n"])

    def emit(held, is_word):
        for batch in merged(held).to_batches(1 << 17):
            yield out(**{"word" if is_word else "code": batch.column(0)}, n=batch.column(1).cast(pa.int64()))

    def run(batches):
        held: dict[bool, list[pa.Table]] = {False: [], True: []}
        texts = 0
        for whole in batches:
            for batch in slices(whole, text_col):
                texts += batch.num_rows
                column = batch.column(0)
                for is_word, keys in ((False, pa.array(_grams(column.to_pylist())[0])), (True, _words(column)[0].cast(pa.string()))):
                    c = pc.value_counts(keys)
                    held[is_word].append(pa.table({"k": c.field("values"), "n": c.field("counts")}))
                    if sum(map(len, held[is_word])) > HELD:
                        held[is_word] = [merged(held[is_word])]
                        if len(held[is_word][0]) > HELD // 2:
                            yield from emit(held[is_word], is_word)
                            held[is_word] = []
            release()
        if texts:
            yield out(code=pa.array([-1], pa.int64()), n=pa.array([texts], pa.int64()))
        for is_word, tables in held.items():
            if tables:
                yield from emit(tables, is_word)

    return in_arrow(docs.select(text_col), run, "code long, word string, n long").groupBy("code", "word").agg(F.sum("n").alias("n"))


def _part(code: Column, k: int) -> Column:
    """The gram's last k + 1 bytes: a context of k bytes, and the next."""
    return code.bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))


def _context(code: Column) -> Column:
    return F.shiftright(code, 8)


class Trie:
    """The context tables of grams (code, n)."""

    def __init__(self, grams: DataFrame):
        self.followers = {ORDER: grams}
        for k in range(ORDER - 1, -1, -1):
            self.followers[k] = cut(self.followers[k + 1].groupBy(_part(F.col("code"), k).alias("code")).agg(F.sum("n").alias("n")))
        # Of each context: total, distinct followers, and what the followers have together in the context one shorter.
        self.contexts = {}
        for k in range(ORDER, 0, -1):
            shorter = self.followers[k - 1].select(F.col("code").alias("short"), F.col("n").alias("s"))
            rows = self.followers[k].join(shorter, _part(F.col("code"), k - 1) == F.col("short"))
            self.contexts[k] = cut(rows.groupBy(_context(F.col("code")).alias("ctx")).agg(F.sum("n").alias(f"n{k}"), F.count("*").alias(f"t{k}"), F.sum("s").alias(f"x{k - 1}")))
        self.total, self.distinct = self.followers[0].agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()

    def seen(self) -> DataFrame:
        """(code, n, lp): log10 probabilities of the grams of the training texts."""
        k = ORDER
        joined = self.followers[k].join(self.contexts[k], _context(F.col("code")) == F.col("ctx"))
        return joined.select("code", "n", F.log10(F.col("n") / (F.col(f"n{k}") + F.col(f"t{k}"))).alias("lp"))

    def unseen(self, codes: DataFrame) -> DataFrame:
        """(code, lp) of codes (code), none of which the training texts have."""
        rows = codes
        for k in range(ORDER, 0, -1):
            rows = rows.join(self.contexts[k], _context(_part(F.col("code"), k)) == F.col("ctx"), "left").drop("ctx")
            short = self.followers[k - 1].select(F.col("code").alias("short"), F.col("n").alias(f"c{k - 1}"))
            rows = rows.join(short, _part(F.col("code"), k - 1) == F.col("short"), "left").drop("short")
        rows = rows.withColumns({"n0": F.lit(self.total or None).cast("long"), "t0": F.lit(self.distinct or None).cast("long"), f"c{ORDER}": F.lit(None).cast("long")})
        lp = F.lit(-math.log10(max(1, SYMBOLS - self.distinct)))
        for k in range(ORDER + 1):
            zero = lambda name, at=k: F.coalesce(F.col(name), F.lit(0)) if at < ORDER else F.lit(0)
            n, t = F.col(f"n{k}") - zero(f"x{k}"), F.col(f"t{k}") - zero(f"t{k + 1}")
            rows = rows.withColumn("lp", F.when(F.col(f"n{k}").isNull(), lp).when(F.col(f"c{k}") > 0, F.log10(F.try_divide(F.col(f"c{k}"), n + t))).otherwise(F.when(t > 0, F.log10(F.try_divide(t, n + t))).otherwise(0.0) + lp))
            lp = F.col("lp")
        return rows.select("code", "lp")


def _frequent(rows: DataFrame, most: int) -> DataFrame:
    """The rows with the largest n, most of them at most: those from a power of two on."""
    size = F.floor(F.log2("n")).cast("int")
    least, total = 63, 0
    for r in sorted(rows.groupBy(size.alias("b")).count().collect(), key=lambda r: -r["b"]):
        total += r["count"]
        if total > most:
            break
        least = r["b"]
    return rows.where(size >= least)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 7, remainder: int = 2, most_grams: int = MOST_GRAMS, most_words: int = MOST_WORDS) -> DataFrame:
    """For every row of docs: id_col, held_out, n_tokens (words and the end), n_known (tokens that training texts have),
    train_tokens, base_score (log10 of the add-one unigram probability), score (log10 of the model's), and bits_per_byte.

    Learns from the rows whose crc32(id as text) mod divisor is not remainder; a null id is held out. A null text is empty: an
    end alone. Letters A-Z are lower-cased. Repeated rows are scored, and learned from, each on their own. Without training
    rows every symbol is equally likely. Of equally frequent grams and words all or none are broadcast, so ties decide nothing.
    A text of any length is read in whole. Other columns are not looked at; an empty table gives an empty result."""
    own = docs.select(F.col(id_col), F.col(text_col), held_out(id_col, divisor, remainder).alias("held_out"))
    with tidy() as keep:
        return _score(own, id_col, text_col, most_grams, most_words, keep)


def _score(own: DataFrame, id_col: str, text_col: str, most_grams: int, most_words: int, keep) -> DataFrame:
    counts = cut(_counts(own.where(~F.col("held_out")), text_col))
    texts = (counts.where("code = -1").first() or {"n": 0})["n"]
    words = counts.where("word is not null").select("word", "n")
    n_words, v_words = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    train_tokens, distinct = n_words + texts, v_words + bool(texts)
    trie = Trie(counts.where("code >= 0").select("code", "n"))
    seen = cut(trie.seen())

    top = _frequent(seen, most_grams).select("code", "lp").toArrow()
    order = np.argsort(top["code"].to_numpy())
    top_codes, top_lp = top["code"].to_numpy()[order], top["lp"].to_numpy()[order]
    top_words = _frequent(words, most_words).toArrow()
    known_words, known_n = top_words["word"].combine_chunks().cast(pa.string()), top_words["n"].to_numpy()
    divide = float(train_tokens + distinct + 1)
    end_score = math.log10((texts + 1) / divide)

    def run(batches):
        base_id, made = TaskContext.get().partitionId() << 40, 0
        for whole in batches:
            for batch in slices(whole, text_col):
                rows = batch.num_rows
                codes, gram_ends = _grams(batch.column(1).to_pylist())
                coded = pa.array(codes).dictionary_encode()
                found, at = coded.dictionary.to_numpy(), coded.indices.to_numpy()
                place = np.minimum(np.searchsorted(top_codes, found), max(0, len(top_codes) - 1))
                hit = top_codes[place] == found if len(top_codes) else np.zeros(len(found), bool)
                lp = np.where(hit, top_lp[place], 0.0) if len(top_codes) else np.zeros(len(found))
                doc = np.repeat(np.arange(rows), np.diff(gram_ends, prepend=0))
                score = np.bincount(doc, lp[at], rows)

                flat, word_ends = _words(batch.column(1))
                coded_words = flat.dictionary_encode()
                each = coded_words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                where = pc.index_in(coded_words.dictionary, value_set=known_words)
                known = ~where.is_null().to_numpy(zero_copy_only=False)
                n = np.where(known, known_n[pc.fill_null(where, 0).to_numpy(zero_copy_only=False)], 0) if len(known_n) else np.zeros(len(known), np.int64)
                sizes = np.diff(word_ends, prepend=0)
                word_doc = np.repeat(np.arange(rows), sizes)
                base = np.bincount(word_doc, np.where(known, np.log10((n + 1) / divide), 0.0)[each], rows) + end_score
                n_known = np.bincount(word_doc, known[each], rows).astype(np.int64) + bool(texts)

                ids = base_id + made + np.arange(rows, dtype=np.int64)
                made += rows
                none = lambda kind, m=rows: pa.nulls(m, kind)
                yield pa.record_batch([pa.array(ids), none(pa.int64()), none(pa.string()), pa.array(np.ones(rows, np.int64)), batch.column(0), batch.column(2), pa.array(sizes + 1), pa.array(n_known), pa.array(base), pa.array(score), pa.array(np.diff(gram_ends, prepend=0))], names=names)
                # What was not among the frequent: a row for each distinct one of a document.
                for missed, place_of, docs_of, is_word in ((~hit[at], at, doc, False), (~known[each], each, word_doc, True)):
                    if missed.any():
                        key, times = np.unique(docs_of[missed].astype(np.int64) << 32 | place_of[missed], return_counts=True)
                        m, which = len(key), key & 0xFFFFFFFF
                        code = none(pa.int64(), m) if is_word else pa.array(found[which])
                        word = coded_words.dictionary.take(pa.array(which)).cast(pa.string()) if is_word else none(pa.string(), m)
                        yield pa.record_batch([pa.array(ids[key >> 32]), code, word, pa.array(times.astype(np.int64)), none(batch.column(0).type, m), *(none(k, m) for k in (pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()))], names=names)
            release()

    names = ["row", "code", "word", "times", id_col, "held_out", "n_tokens", "n_known", "base_score", "score", "n_symbols"]
    schema = StructType([*StructType.fromDDL("row long, code long, word string, times long").fields, own.schema[id_col], *StructType.fromDDL("held_out boolean, n_tokens long, n_known long, base_score double, score double, n_symbols long").fields])
    parts = keep(cut(in_arrow(own.select(id_col, text_col, "held_out"), run, schema)))
    heads = parts.where("code is null and word is null").drop("code", "word", "times")
    missed = parts.where("code is not null").select("row", "code", "times")
    # A missed gram is a rare one of the training texts, or one that they don't have.
    got = missed.join(seen.select(F.col("code").alias("k"), "lp"), F.col("code") == F.col("k"), "left").drop("k")
    got = cut(got)
    fresh = trie.unseen(got.where("lp is null").select("code").distinct())
    from_grams = got.where("lp is not null").unionByName(got.where("lp is null").drop("lp").join(fresh, "code")).select("row", (F.col("times") * F.col("lp")).alias("score"), F.lit(0.0).alias("base_score"), F.lit(0).cast("long").alias("n_known"))
    rare = parts.where("word is not null").select("row", "word", "times").join(words.select(F.col("word").alias("k"), "n"), F.col("word") == F.col("k"), "left")
    from_words = rare.select("row", F.lit(0.0).alias("score"), (F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(divide))).alias("base_score"), F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("n_known"))
    more = from_grams.unionByName(from_words).groupBy(F.col("row").alias("of")).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_known").alias("k"))
    more = keep(cut(more))
    zero = F.lit(0.0)
    out = heads.join(more, F.col("row") == F.col("of"), "left").withColumn("score", F.col("score") + F.coalesce("s", zero))
    return out.select(
        id_col, "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", zero)).alias("base_score"), "score", (-F.col("score") / math.log10(2) / F.col("n_symbols")).alias("bits_per_byte"),
    )
