"""Texts as runs of few distinct chunks, so that a tokenizer sees each distinct chunk once.

A chunk begins at a space and goes up to the next. The pre-tokenizers here never match over a space that follows another
character than white space, nor over one that a word follows, so what they find in each chunk is what they find in the text.
A text with a space between two white-space characters, or at its end behind one, stays one chunk; so does one that holds a
string which the tokenizer takes out before all else.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

_WHITE = r"\s\pZ\x0b\x1c-\x1f\x{85}"
_MARKS = tuple(",.")
_UNSAFE = rf"[{_WHITE}] ([{_WHITE}]|\z)"


def chunked(texts: pa.Array, taken_out: tuple[str, ...] = ()) -> tuple[list[str], list[np.ndarray]]:
    """The distinct chunks of texts, and for each text its chunks' places among them. Null texts are empty."""
    texts = pc.fill_null(texts, "")
    unsafe = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
    for mark in taken_out:
        unsafe = unsafe | pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    safe = np.flatnonzero(~unsafe)
    split = pc.split_pattern(texts.take(pa.array(safe)), " ")
    flat = split.flatten().dictionary_encode()
    found = [" " + u for u in flat.dictionary.to_pylist()]
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(safe)]
    heads: dict[str, int] = {}
    if len(safe):
        codes[first] = [heads.setdefault(found[c][1:], len(found) + len(heads)) for c in codes[first].tolist()]
    out: list = [None] * len(texts)
    for i, a, b in zip(safe.tolist(), first.tolist(), ends.tolist()):
        out[i] = codes[a:b]
    found += heads
    for i in np.flatnonzero(unsafe).tolist():
        out[i] = np.array([len(found)], np.int64)
        found.append(texts[i].as_py())
    return found, out


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """The tokens of a byte-level BPE file for the tokenizers library by rank, if merging by ranks gives what its merges give; else
    None. It does if merges are in the order of ids, and each token is what its own bytes merge to: bytes that a token covers
    have then been merged among themselves only, in the same way whatever surrounds them, so its two parts are always those of
    its merge."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model.get("vocab"), model.get("merges")
    if model.get("type") != "BPE" or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    # The byte-level alphabet: printable bytes stand for themselves, the others for what follows Latin-1.
    printable = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*printable}))}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    ids = [vocab.get(a + b, -1) for a, b in pairs]
    if ids != sorted(set(ids)) or len(ids) + 256 != len(vocab) or not all(c in byte_of for t in vocab for c in t) or {t for t in vocab if len(t) == 1} != {*byte_of}:
        return None
    own = Tokenizer.from_file(path).model
    if not all(len(found := own.tokenize(t)) == 1 and found[0].id == i for t, i in vocab.items()):
        return None
    return {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items()}


class Encoder:
    """ids and sizes of texts, by a file for the tokenizers library: that library's own, or the same ids by ranks."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        split = self.tok.pre_tokenizer
        #: Whether texts may be cut into chunks: bytes of the text as it is, split by the usual pattern.
        self.chunks = self.tok.normalizer is None and self.tok.post_processor is None and isinstance(split, ByteLevel) and not split.add_prefix_space and split.use_regex
        added = [(i, t) for i, t in self.tok.get_added_tokens_decoder().items() if not special_as_text or not t.special]
        self.taken_out = tuple(t.content for _, t in added)
        # A token that stands for itself and nothing else parts the chunks of one long text, which is quicker than many texts.
        ranks = merge_ranks(path) if self.chunks else None
        # Merging by ranks is some five times as fast. Only for letters whose classes no version of Unicode will change, and not
        # for very long pre-tokens, over which it takes quadratic time.
        self.by_ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.mark = next(((t.content, i) for i, t in added if self.chunks and t.special and not (t.normalized or t.single_word or t.lstrip or t.rstrip)), None)

    def quick(self, texts: pa.Array) -> np.ndarray:
        """For which texts merging by ranks will do. Null texts are empty."""
        if not self.by_ranks:
            return np.zeros(len(texts), bool)
        texts = pc.fill_null(texts, "")
        bad = pc.match_substring_regex(texts, r"[^\x00-\x{24F}]|\S{500}|\s{500}").to_numpy(zero_copy_only=False)
        for mark in self.taken_out:
            bad = bad | pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        return ~bad

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.mark and not any(t in c for t in self.taken_out for c in chunks):
            flat = np.array(self.tok.encode_batch_fast([self.mark[0].join(chunks)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.append(np.flatnonzero(flat == self.mark[1]), len(flat))
            return flat[flat != self.mark[1]], np.diff(ends, prepend=-1) - 1
        ids = [e.ids for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(length.sum())), length


class IdStore:
    """Token ids of the chunks seen so far, in one array. Starts afresh when it holds too many chunks."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 300_000, most_chars: int = 16_000_000):
        self.encode, self.most, self.most_chars = encode, most, most_chars
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.chars = 0
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.length = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def places(self, chunks: list[str]) -> np.ndarray:
        """The row of each chunk; unseen ones are encoded."""
        if len(self.rows) > self.most or self.chars > self.most_chars:
            self.clear()
        rows = self.rows
        fresh = [c for c in chunks if c not in rows]
        # A mark behind a letter is a pre-token of its own: the ids are those of the chunk without it, and the mark's.
        plain, marked, cuts = [], [], getattr(self.encode, "chunks", True)
        for c in fresh:
            (marked if cuts and c.endswith(_MARKS) and c[-2:-1].isalpha() else plain).append(c)
        self._encode(plain)
        if marked:
            self._encode([c for c in dict.fromkeys([*_MARKS, *(c[:-1] for c in marked)]) if c not in rows])
            pairs = np.array([(rows[c[:-1]], rows[c[-1]]) for c in marked], np.int64)
            self._add(marked, self.ids(pairs.ravel()), self.length[pairs].sum(1))
        return np.fromiter((rows[c] for c in chunks), np.int64, len(chunks))

    def _encode(self, chunks: list[str]) -> None:
        for at in range(0, len(chunks), 4_000):  # an encoding is large, and kept only until its ids are taken
            self._add(chunks[at : at + 4_000], *self.encode(chunks[at : at + 4_000]))

    def _add(self, chunks: list[str], flat: np.ndarray, length: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        first = len(self.rows)
        while first + len(chunks) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.length))
        self.start[first : first + len(chunks)] = self.used + np.cumsum(length) - length
        self.length[first : first + len(chunks)] = length
        self.used += len(flat)
        self.chars += sum(map(len, chunks))
        self.rows.update(zip(chunks, range(first, first + len(chunks))))

    def ids(self, rows: np.ndarray) -> np.ndarray:
        """The ids of these rows, one behind the other."""
        length = self.length[rows]
        ends = np.cumsum(length)
        return self.flat[np.repeat(self.start[rows] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
