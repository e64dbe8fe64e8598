"""Byte-level BPE by ranks, on padded matrices, and back.

Distinct pre-tokens are laid out in matrices by length, padded to the next power of two; every row is a sequence of token ids.
In each round every row merges its leftmost pair of minimum rank. Pair ranks come from a hash table of all pairs of tokens
that together are a token; after a merge only the two pairs beside it are looked up again. Rows without a pair leave the
matrix, and the rest is compacted. A long pre-token has a matrix of its own, in which a round also merges the pair's other
places, as far as that is what merging them one round after the other gives.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from lectern.llm.chunks import chunked
from lectern.llm.common import BATCH_BYTES, in_arrow, release, schema_of, slices

#: Pre-tokens of more bytes have a matrix of one row.
LONG = 512
#: Cells of a matrix at most.
CELLS = 1 << 21
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """rank(left, right) of all pairs of tokens whose bytes together are a token: open addressing, linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(a, b, r) for token, r in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None]
        left, right, rank = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.empty(0, np.int64),) * 3
        self.bits = max(4, int(np.ceil(np.log2(3 * len(rank) + 1))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        key = left << 32 | right
        slot, todo, self.probes = self._slot(key), np.arange(len(key)), 1
        while len(todo):
            at = slot[todo]
            free = self.keys[at] < 0
            order = todo[free]
            self.keys[slot[order]] = key[order]  # of several for one slot the last stays
            won = self.keys[at] == key[todo]
            self.values[at[won]] = rank[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & (size - 1)
            self.probes += bool(len(todo))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where the pair is no token, or a side is padding (-1)."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(key)
        out = np.where((self.keys[slot] == key) & (left >= 0) & (right >= 0), self.values[slot], NONE)
        todo = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] >= 0) & (left >= 0) & (right >= 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot[todo]]
            hit = got == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.token_bytes = {r: t for t, r in ranks.items()}

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, each merged on its own."""
        out: list = [None] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if (whole := self.ranks.get(w)) is not None:
                out[i] = np.array([whole], np.int32)
            elif not w:
                out[i] = np.empty(0, np.int32)
            elif len(w) > LONG:
                out[i] = self._row(w)
            else:
                buckets.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            each = max(1, CELLS // width)
            for at in range(0, len(rows), each):
                part = rows[at : at + each]
                for i, ids in zip(part, self._matrix([words[i] for i in part], width)):
                    out[i] = ids
        return out

    def _matrix(self, words: list[bytes], width: int) -> list[np.ndarray]:
        length = np.fromiter(map(len, words), np.int64, len(words))
        inside = np.arange(width)[None, :] < length[:, None]
        m = np.full(inside.shape, -1, np.int32)
        m[inside] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full((len(words), width), NONE, np.int32)
        rank[:, :-1] = self.pairs.rank(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(words), width - 1)
        row, out = np.arange(len(words)), [None] * len(words)
        while len(row):
            at = rank.argmin(1)
            best = rank[np.arange(len(row)), at]
            done = best == NONE
            if done.any():
                for i, ids, n in zip(row[done].tolist(), m[done], length[done].tolist()):
                    out[i] = ids[:n]
                keep = ~done
                row, length, at, best = row[keep], length[keep] - 1, at[keep], best[keep]
                width = max(2, int(length.max(initial=0)) + 1)
                m, rank = m[keep, :width], rank[keep, :width]
                if not len(row):
                    break
            else:
                length = length - 1
            own, place = np.arange(len(row)), np.arange(width)[None, :]
            # The merged pair's right place goes: everything behind it moves one to the left.
            move = np.minimum(place + (place > at[:, None]), width - 1)
            m = np.take_along_axis(m, move, 1)
            rank = np.take_along_axis(rank, move, 1)
            m[own, at] = best
            shifted = at < width - 1
            m[shifted, -1], rank[shifted, -1] = -1, NONE
            right = np.minimum(at + 1, width - 1)
            rank[own, at] = np.where(at + 1 < length, self.pairs.rank(m[own, at], m[own, right]), NONE)
            back = np.flatnonzero(at > 0)
            rank[back, at[back] - 1] = self.pairs.rank(m[back, at[back] - 1], m[back, at[back]])
        return out

    def _row(self, word: bytes) -> np.ndarray:
        """The same for one long word. Of the places of the minimum-rank pair, from the left and without overlap, those up to the
        first are merged in one round that makes a new pair of as low a rank; a later round goes on there."""
        row = self.byte_id[np.frombuffer(word, np.uint8)]
        rank = self.pairs.rank(row[:-1], row[1:])
        while len(rank) and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            # Of places next to each other every second one overlaps the one before.
            run = np.concatenate([[0], np.cumsum(np.diff(at) > 1)])
            first = np.searchsorted(run, run)
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            # What the merged token meets: on the left a merged or an old token, on the right one that is not merged yet.
            before = np.where(at > 0, row[np.maximum(at - 1, 0)], -1)
            before[1:] = np.where(at[1:] - at[:-1] == 2, best, before[1:])
            after = np.where(at + 2 < len(row), row[np.minimum(at + 2, len(row) - 1)], -1)
            merged = np.full(len(at), best, np.int32)
            low = (self.pairs.rank(before.astype(np.int32), merged) <= best) | (self.pairs.rank(merged, after.astype(np.int32)) <= best)
            at = at[: int(low.argmax()) + 1] if low.any() else at
            row[at] = best
            keep = np.ones(len(row), bool)
            keep[at + 1] = False
            row = row[keep]
            rank = np.append(rank, NONE)[keep][:-1]
            # Only pairs with a merged token on a side are new.
            now = at - np.arange(len(at))
            left = np.unique(np.concatenate([now - 1, now]))
            left = left[(left >= 0) & (left < len(row) - 1)]
            rank[left] = self.pairs.rank(row[left], row[left + 1])
        return row

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None, with_ids: bool = False, most: int = 400_000) -> DataFrame:
    """A row for each row of docs: id_col, n_tokens, ids_sha256 (of the decimal ids, joined by one space) and decoded_sha256
    (of the bytes that the ids decode to); with_ids adds the ids.

    ranks_path: a file of base64 tokens and ranks; pattern: what splits a text into pre-tokens. A null text is empty: no ids,
    and the digests of nothing. A text of any length is encoded in whole; of pairs of equal rank the leftmost goes first. Repeated
    rows and null ids come out as they came in; other columns are not looked at; an empty table gives an empty result. most:
    chunks that a task remembers at a time."""
    path, split = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(batches):
        encoder, find = Encoder(read_ranks(path)), regex.compile(split).findall
        known: dict[str, tuple[int, str, bytes]] = {}

        def learn(chunks: list[str]) -> None:
            pre: dict[str, int] = {}
            spans = [[pre.setdefault(p, len(pre)) for p in find(c)] for c in chunks]
            ids = encoder.encode([p.encode() for p in pre])
            said, back = [" ".join(map(str, x.tolist())) for x in ids], [encoder.decode(x) for x in ids]
            sizes = [len(x) for x in ids]
            for c, span in zip(chunks, spans):
                if len(span) == 1:
                    known[c] = (sizes[span[0]], said[span[0]], back[span[0]])
                else:
                    known[c] = (sum(sizes[i] for i in span), " ".join([said[i] for i in span]), b"".join([back[i] for i in span]))

        for whole in batches:
            for batch in slices(whole, text_col, BATCH_BYTES):
                if len(known) > most:
                    known.clear()
                found, texts = chunked(batch.column(1))
                learn([c for c in found if c not in known])
                own = [known[c] for c in found]
                size, said, back = np.array([x[0] for x in own], np.int64), [x[1] for x in own], [x[2] for x in own]
                n, digests, decoded, ids = [], [], [], []
                for codes in texts:
                    n.append(int(size[codes].sum()))
                    some = codes.tolist()
                    text = " ".join([s for i in some if (s := said[i])])
                    digests.append(hashlib.sha256(text.encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join([back[i] for i in some])).hexdigest())
                    if with_ids:
                        ids.append(np.array(text.split(), np.int32))
                arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                yield pa.record_batch(arrays + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)
            release()

    return in_arrow(docs.select(id_col, text_col), run, schema_of([docs.schema[id_col]], "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids))
