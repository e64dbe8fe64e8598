"""Hierarchical multi-length packing of documents into training sequences.

Each document gives its full windows of the longest tier; what remains is routed to the shortest tier that holds it. Each tier
is packed, longest first: a window takes one remainder of its own tier, and its gap is filled from shorter tiers, the largest
that fits first, and at last by cutting one. So windows are full at their tier's length. Remainders that find no company wait
for the next documents of the task; at its end they are laid end to end and cut at tier lengths, the last few tokens at powers
of two, so nothing is padded. Sequences of one tier go to step groups of equal tokens, dealt so that attention cost (the sum
of squared piece lengths) is even. A task packs on its own: nothing is shuffled, and a task that runs again gives the same.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lectern.llm.chunks import Encoder, IdStore, chunked
from lectern.llm.common import in_arrow, release, schema_of, slices, worker_held

TIERS = (64, 128, 256, 512, 1024, 2048)
END_ID = 1
#: Tokens of a step group.
STEP_TOKENS = 32_768


class Pool:
    """Remainders (doc, start, stop) of one task that wait for a window, sorted by length."""

    def __init__(self):
        self.by_length: dict[int, list] = defaultdict(list)
        self.lengths: list[int] = []

    def add(self, doc, start: int, stop: int) -> None:
        n = stop - start
        if n:
            if not self.by_length[n]:
                bisect.insort(self.lengths, n)
            self.by_length[n].append((doc, start, stop))

    def take(self, at: int):
        """One remainder of the length that stands at this place."""
        n = self.lengths[at]
        got = self.by_length[n].pop()
        if not self.by_length[n]:
            self.lengths.pop(at)
        return got

    def upto(self, n: int) -> int:
        """How many lengths are at most n."""
        return bisect.bisect_right(self.lengths, n)

    def drain(self) -> list:
        return [self.take(len(self.lengths) - 1) for _ in range(sum(map(len, self.by_length.values())))]


def fill(pool: Pool, tiers: tuple[int, ...] = TIERS) -> list[list]:
    """Full windows out of the pool: lists of pieces (doc, start, stop). What can't be filled stays in the pool."""
    windows = []
    for below, tier in zip((0, *tiers)[::-1][1:], tiers[::-1]):
        while (end := pool.upto(tier)) and pool.lengths[end - 1] > below:
            window = [pool.take(end - 1)]
            gap = tier - (window[0][2] - window[0][1])
            while gap:
                if fits := pool.upto(min(gap, below)):
                    piece = pool.take(fits - 1)
                elif shorter := pool.upto(below):  # all that is left of shorter tiers is longer than the gap
                    doc, start, stop = pool.take(shorter - 1)
                    piece = (doc, start, start + gap)
                    pool.add(doc, start + gap, stop)
                else:
                    break
                window.append(piece)
                gap -= piece[2] - piece[1]
            if gap:  # no shorter remainder is left; these wait
                for piece in window:
                    pool.add(*piece)
                break
            windows.append(window)
    return windows


def flush(pool: Pool, tiers: tuple[int, ...] = TIERS) -> list[list]:
    """All that waits, end to end, cut at tier lengths, longest first, and what is left under the shortest at powers of two; so
    every window is full."""
    windows, rest = [], pool.drain()
    left = sum(stop - start for _, start, stop in rest)
    rest.reverse()
    while left:
        room = next((t for t in tiers[::-1] if t <= left), 1 << left.bit_length() - 1)
        left -= room
        window = []
        while room:
            doc, start, stop = rest.pop()
            if stop - start > room:
                rest.append((doc, start + room, stop))
                stop = start + room
            window.append((doc, start, stop))
            room -= stop - start
        windows.append(window)
    return windows


def tokens(window: list) -> int:
    return sum(stop - start for _, start, stop in window)


class StepGroups:
    """Deals windows to step groups: all of a group have one length and together step_tokens tokens. Windows that do not fill
    a group yet wait for more of their length; only the last group of a length may be smaller."""

    def __init__(self, step_tokens: int = STEP_TOKENS):
        self.step_tokens, self.made = step_tokens, 0
        self.waiting: dict[int, list[list]] = defaultdict(list)

    def deal(self, windows: list[list], last: bool = False) -> list[tuple[int, list]]:
        """(group, window) for all that now has a group; groups that are made together have an even attention cost."""
        for w in windows:
            self.waiting[tokens(w)].append(w)
        out = []
        for n, own in sorted(self.waiting.items()):
            each = max(1, self.step_tokens // n)
            count = -(-len(own) // each) if last else len(own) // each
            now, self.waiting[n] = own[: count * each], own[count * each :]
            now.sort(key=lambda w: -sum((stop - start) ** 2 for _, start, stop in w))
            for k, w in enumerate(now):
                lap, at = divmod(k, count)
                out.append((self.made + (count - 1 - at if lap % 2 else at), w))
            self.made += count
        return out


def _id_store(path: str, special_as_text: bool) -> IdStore:
    """One for each worker: chunks that one task has met need no tokenizing in the next."""
    held, key = worker_held(), ("ids", path, special_as_text)
    if key not in held:
        held[key] = IdStore(Encoder(path, special_as_text))
    return held[key]


def encoded(store: IdStore, texts: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each text."""
    encode = store.encode
    quick = encode.quick(texts)
    slow = texts.filter(pa.array(~quick))
    if not len(slow):
        places, each = None, iter(())
    elif encode.chunks:
        found, codes = chunked(slow, encode.taken_out)
        places, each = store.places(found), iter(codes)
    else:
        places, each = store.places([t or "" for t in slow.to_pylist()]), iter(np.arange(len(slow))[:, None])
    for ok, text in zip(quick.tolist(), texts.to_pylist()):
        yield encode.by_ranks.encode_to_numpy(text or "", disallowed_special=()) if ok else store.ids(places[next(each)])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """A row for each piece: id_col, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset
    in the sequence, tier (the sequence's length) and step_group; with_ids adds the piece's ids.

    tokenizer: a file for the tokenizers library. Each text's ids are followed by END_ID. special_as_text: whether a special
    token's string in a text is ordinary text; the library's own way is that it is the special token. A null text is empty, and
    packs as END_ID alone. A text of any length gives as many windows as it fills. Repeated rows, and rows with a null id, are
    packed each on their own; remainders of equal length are taken latest first. Other columns are not looked at; an empty
    table gives no piece."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    longest = tiers[-1]

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        store = _id_store(path, special_as_text)
        base, made, pool, steps = TaskContext.get().partitionId() << 40, 0, Pool(), StepGroups(step_tokens)

        def out(dealt):
            nonlocal made
            cols: list[list] = [[] for _ in range(10)]
            for group, window in dealt:
                offset, total = 0, tokens(window)
                for (doc_id, n, first, ids), start, stop in window:
                    piece = ids[start - first : stop - first]
                    row = (doc_id, start, stop - start, zlib.crc32(piece), n, base + made, offset, total, base + group, piece)
                    for c, v in zip(cols, row):
                        c.append(v)
                    offset += stop - start
                made += 1
            arrays = [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7], pa.int32()), pa.array(cols[8], pa.int64())]
            if with_ids:
                arrays.append(pa.array(cols[9], pa.list_(pa.int32())))
            return pa.record_batch(arrays, names=names)

        id_type = None
        for whole in batches:
            id_type = whole.column(0).type
            for batch in slices(whole, text_col):
                full = []
                for doc_id, own in zip(batch.column(0).to_pylist(), encoded(store, batch.column(1))):
                    ids = np.append(own, END_ID).astype("<u4")
                    n = len(ids)
                    cut = n - n % longest
                    full += [[((doc_id, n, 0, ids), at, at + longest)] for at in range(0, cut, longest)]
                    pool.add((doc_id, n, cut, ids[cut:].copy() if cut else ids), cut, n)
                if dealt := steps.deal(full + fill(pool, tiers)):
                    yield out(dealt)
                del full, dealt
            release()
        if dealt := steps.deal(flush(pool, tiers), last=True):
            yield out(dealt)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"] + ["ids"] * with_ids
    schema = schema_of([docs.schema[id_col]], ", ".join(f"{name} {dict(tier='int', ids='array<int>').get(name, 'long')}" for name in names[1:]))
    return in_arrow(docs.select(id_col, text_col), run, schema)
