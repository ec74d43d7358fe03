"""Operator 5: order-preserving packing by dynamic programming with a monotone queue.

The token streams of a partition's documents, in the order of its rows, are joined and cut into windows of at most
``window`` tokens. Cuts lie at document ends (free) or sentence ends (a small penalty); only a sentence longer than the
window itself is cut inside, at every ``GRAIN``-th token, for the penalty of truncation. With f(i) the least cost of what
lies before boundary i at position p(i), f(j) = penalty(j) + min over p(j) - p(i) <= window of f(i) + window - (p(j) - p(i));
as f(i) + p(i) alone decides, a queue of increasing values yields each minimum in constant time. The partition's last
window is the only one that may be left with much padding: there, the programme weighs the padding against cutting the
rest into powers of two, which need none, each cut for the penalty of truncation.

The programme runs over the whole partition, and gives out the cuts that all windows still open have in common, so the
cuts are the best of the partition while little more than some windows is held. No shuffle: rows are packed where they
are read, so the cuts depend on how the input is split. A sequence's id is made of the partition's number and a counter;
a task that runs again gives the same rows. Defined cases: a null or empty text is the end token alone; ids may be null
or repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import deque
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import library_encoder, rules
from .common import arrow, rows_of, small_batches

WINDOW, END = 2048, 1
#: Costs of a cut, in padding tokens, at a sentence's end and inside a sentence, and the distance of cuts inside those
#: sentences that are longer than a window.
SENTENCE_CUT, INNER_CUT, GRAIN = 4, 64, 64
#: Tokens that are handed to the programme together.
TOGETHER = 1 << 16


@cache
def _ends_sentence(path: str) -> np.ndarray:
    """For each id, whether its text closes a sentence or a line."""
    marks = (".", "!", "?", "Ċ", "。", "…")
    spec, out = rules(path), np.zeros(rules(path).size, bool)
    for s, i in spec.vocab.items():
        out[i] = s.removesuffix(spec.end).endswith(marks)
    return out


def boundaries(sentence_ends: np.ndarray, document_ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions where a window may end, with their penalties; sentences longer than ``window`` get inner cuts."""
    grain = min(GRAIN, window)
    at = np.union1d(sentence_ends, document_ends)
    gaps = np.diff(at, prepend=0)
    long = np.flatnonzero(gaps > window)
    inner = [np.arange(at[k] - gaps[k] + grain, at[k], grain) for k in long]
    inner = np.concatenate(inner) if inner else np.empty(0, at.dtype)
    pos = np.concatenate([at, inner])
    cost = np.concatenate([np.where(np.isin(at, document_ends), 0, SENTENCE_CUT), np.full(len(inner), INNER_CUT)])
    order = np.argsort(pos, kind="stable")
    return pos[order], cost[order]


def last_cuts(n: int, window: int = WINDOW) -> tuple[int, list[int]]:
    """The least cost of a last window of ``n`` tokens, and the sizes of its parts: one, padded, or powers of two."""
    powers = [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
    whole = window - n if len(powers) > 1 else 0
    return min((whole, [n]), (INNER_CUT * (len(powers) - 1), powers))


class Programme:
    """The dynamic programme over a stream of boundaries; no gap between them may be longer than the window."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        # of boundaries not given out yet, the last one given out first: position, least cost, boundary before
        self.pos, self.total, self.back = [0], [0], [0]
        self.first = 0
        self.queue: deque[int] = deque([0])

    def add(self, pos: list[int], cost: list[int]) -> None:
        p, total, back, queue, window, first = self.pos, self.total, self.back, self.queue, self.window, self.first
        for at, c in zip(pos, cost, strict=True):
            low = at - window
            while p[queue[0] - first] < low:
                queue.popleft()
            i = queue[0]
            f = total[i - first] + window - at + p[i - first] + c
            j = first + len(p)
            p.append(at)
            total.append(f)
            back.append(i)
            f += at
            while queue and total[queue[-1] - first] + p[queue[-1] - first] >= f:
                queue.pop()
            queue.append(j)

    def open(self) -> list[int]:
        """The boundaries that a window may still begin at."""
        low, k = self.pos[-1] - self.window, len(self.pos) - 1
        while k and self.pos[k - 1] >= low:
            k -= 1
        return list(range(self.first + k, self.first + len(self.pos)))

    def _chain(self, i: int) -> list[int]:
        cuts = []
        while i > self.first:
            cuts.append(self.pos[i - self.first])
            i = self.back[i - self.first]
        return cuts[::-1]

    def common(self) -> list[int]:
        """The cuts that all open windows have in common; they are given out once."""
        heads = set(self.open())
        while len(heads) > 1:
            top = max(heads)
            heads.remove(top)
            heads.add(self.back[top - self.first])
        (i,) = heads
        cuts = self._chain(i)
        k = i - self.first
        del self.pos[:k], self.total[:k], self.back[:k]
        self.first = i
        return cuts

    def close(self) -> list[int]:
        """The rest of the cuts: the last window ends at the last boundary, whole or in powers of two."""
        end = self.pos[-1]
        if len(self.pos) == 1:
            return []
        _, i, parts = min((self.total[i - self.first] + cost, i, parts) for i in self.open() if self.pos[i - self.first] < end for cost, parts in [last_cuts(end - self.pos[i - self.first], self.window)])
        cuts, at = self._chain(i), self.pos[i - self.first]
        for n in parts:
            at += n
            cuts.append(at)
        return cuts


PIECE = "start long, length long, {ids}, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END, with_ids: bool = True) -> DataFrame:
    """One row per piece: the document's id, where the piece starts in it and how long it is, its ids (or their crc32),
    the document's length, the sequence it lies in and its offset there."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"`{id_col}` {kind}, " + PIECE.format(ids="ids array<int>" if with_ids else "ids_crc32 long")).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        enc, closes = library_encoder(path), _ends_sentence(path)
        finish, counter = int(end_id).to_bytes(4, "little"), [(TaskContext.get().partitionId()) << 36]

        def pieces(held, cuts, at):
            """The pieces up to the last cut; documents that end before it leave ``held``."""
            for b in cuts:
                a = at
                while at < b:
                    key, ids, first = held[0]
                    stop = min(b, first + len(ids))
                    piece = ids[at - first : stop - first]
                    yield (key, at - first, stop - at, piece.astype("i4") if with_ids else zlib.crc32(piece), len(ids), counter[0], at - a)
                    at = stop
                    if at == first + len(ids):
                        held.popleft()
                counter[0] += 1

        def rows():
            held, new, at, size, done = deque(), [], 0, 0, 0
            programme = Programme(window)

            def feed():
                ids = np.concatenate([x for _, x, _ in new])
                pos, cost = boundaries(np.flatnonzero(closes[ids]) + 1, np.cumsum([len(x) for _, x, _ in new]), window)
                programme.add((pos + (at - size)).tolist(), cost.tolist())
                held.extend(new)
                new.clear()

            for keys, texts in rows_of(batches):
                for k, t in zip(keys, texts, strict=True):
                    ids = np.frombuffer(enc(t) + finish, "<u4")
                    new.append((k, ids, at))
                    at += len(ids)
                    size += len(ids)
                    if size >= TOGETHER:
                        feed()
                        size = 0
                        if cuts := programme.common():
                            yield from pieces(held, cuts, done)
                            done = cuts[-1]
            if new:
                feed()
            yield from pieces(held, programme.close(), done)

        yield from small_batches(pa.schema(to_arrow_schema(out)), rows())

    return docs.select(id_col, text).transform(arrow, run, out)
