"""Operator 3: BPE encoding and decoding by a minimal acyclic transducer lexicon.

Frequent words of the corpus are compiled, with their id outputs, into the smallest deterministic acyclic automaton:
equal suffixes share states. Each arc carries the number of words that sort before it, so that the sum along a path is
the word's rank, and the rank leads to its ids. Executors get the compiled form as a file, which their workers map. All
distinct words of some texts walk the automaton together, a byte at a step, so every word of every text is looked up in
it first; the words that it does not hold are merged exactly by rank, those of many texts together, and only these are
remembered.

Defined cases: a null or empty text has no tokens and decodes to the empty text; special-token strings inside a text
become their id; rows with repeated or null ids stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, rules
from .common import arrow, batch, drop_path, mapped, rows_of, share, sole, stored

#: Words in the lexicon at most: the bound of what is collected and sent (a few MB).
LEXICON_WORDS = 50_000
#: A word must be found this often to count as frequent, and be no longer than this (the bound of what a word takes).
LEAST_COUNT, LONGEST = 2, 40
#: Characters of the texts whose words are looked up together.
TOGETHER = 4_000_000
#: Ids that are decoded at a time.
BLOCK = 50_000


class _State:
    __slots__ = ("arcs", "final", "n")

    def __init__(self) -> None:
        self.arcs: list[tuple[int, _State]] = []
        self.final = False
        self.n = -1


def compile_lexicon(entries: dict[str, bytes]) -> bytes:
    """The minimal automaton over the words' bytes with the outputs, as one block of memory.

    Words are added in sorted order; the path that the next word leaves is closed at once against a register of states.
    """
    words = sorted((w.encode(), ids) for w, ids in entries.items())
    root, register = _State(), {}
    path: list[_State] = [root]

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            child = path.pop()
            key = (child.final, tuple((b, id(s)) for b, s in child.arcs))
            same = register.setdefault(key, child)
            if same is not child:
                path[-1].arcs[-1] = (path[-1].arcs[-1][0], same)

    last = b""
    for w, _ in words:
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        close(common)
        for b in w[common:]:
            child = _State()
            path[-1].arcs.append((b, child))
            path.append(child)
        path[-1].final = True
        last = w
    close(0)
    order: list[_State] = []
    number: dict[int, int] = {}

    def visit(top: _State) -> None:
        stack = [(top, 0)]
        while stack:
            s, k = stack.pop()
            if k == 0:
                if id(s) in number:
                    continue
            if k < len(s.arcs):
                stack.append((s, k + 1))
                if id(s.arcs[k][1]) not in number:
                    stack.append((s.arcs[k][1], 0))
            elif id(s) not in number:
                s.n = s.final + sum(t.n for _, t in s.arcs)
                number[id(s)] = len(order)
                order.append(s)

    visit(root)
    first, labels, targets, skips, finals = [0], bytearray(), [], [], bytearray()
    for s in order:
        before = int(s.final)
        for b, t in s.arcs:
            labels.append(b)
            targets.append(number[id(t)])
            skips.append(before)
            before += t.n
        first.append(len(labels))
        finals.append(s.final)
    ends = np.cumsum([0, *(len(ids) // 4 for _, ids in words)]).astype("<u4")
    blocks = [np.array(first, "<u4").tobytes(), np.array(targets, "<u4").tobytes(), np.array(skips, "<u4").tobytes(), ends.tobytes(), b"".join(ids for _, ids in words), bytes(labels), bytes(finals)]
    head = struct.pack("<4sI7Q", b"DAWG", number[id(root)], *map(len, blocks))
    return head + b"".join(blocks)


class Lexicon:
    """A compiled lexicon over mapped memory."""

    def __init__(self, memory) -> None:
        magic, self.root, *sizes = struct.unpack_from("<4sI7Q", memory)
        assert magic == b"DAWG"
        parts, at = [], struct.calcsize("<4sI7Q")
        for n, kind in zip(sizes, ("<u4", "<u4", "<u4", "<u4", "u1", "u1", "u1"), strict=True):
            parts.append(np.frombuffer(memory, kind, n // np.dtype(kind).itemsize, at))
            at += n
        first, self.targets, self.skips, self.ends, ids, labels, self.finals = parts
        self.ids = memoryview(ids)
        self.states = len(self.finals)
        # arcs lie in the order of (state, label)
        self.arcs = np.repeat(np.arange(self.states, dtype=np.int64) << 8, np.diff(first)) | labels

    def look(self, words: list[str]) -> list[bytes | None]:
        """The ids of each word, or None: all words take one step at a time."""
        if not len(self.arcs):
            return [None] * len(words)
        data = [w.encode() for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        text = np.frombuffer(b"".join(data), np.uint8)
        at = np.cumsum(sizes) - sizes
        state, rank = np.full(len(data), self.root, np.int64), np.zeros(len(data), np.int64)
        found = np.full(len(data), -1, np.int64)
        alive = np.flatnonzero(sizes > 0)
        step = 0
        while len(alive):
            wanted = state[alive] << 8 | text[at[alive] + step]
            arc = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
            there = self.arcs[arc] == wanted
            alive, arc = alive[there], arc[there]
            rank[alive] += self.skips[arc]
            state[alive] = self.targets[arc]
            step += 1
            done = sizes[alive] == step
            whole = alive[done]
            whole = whole[self.finals[state[whole]] == 1]
            found[whole] = rank[whole]
            alive = alive[~done]
        hit = found >= 0
        low, high = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        low[hit], high[hit] = 4 * self.ends[found[hit]].astype(np.int64), 4 * self.ends[found[hit] + 1].astype(np.int64)
        ids = self.ids
        return [bytes(ids[a:b]) if k else None for k, a, b in zip(hit.tolist(), low.tolist(), high.tolist(), strict=True)]


class LexiconEncoder:
    """Texts to ids by a lexicon; ``seen`` counts the distinct words looked up in it and those that it held."""

    def __init__(self, spec, lexicon: Lexicon) -> None:
        self.rules, self.lexicon, self.merged = spec, lexicon, Encoder(spec).memo
        self.special = {s: i.to_bytes(4, "little") for s, i in spec.special.items()}
        self.seen = [0, 0]

    def _cut(self, text: str) -> list[str]:
        if "<|" not in text:
            return self.rules.words(text)
        # no word is like a special token: words don't mix letters and signs
        return [w for k, part in enumerate(self.rules.parts(text)) for w in ([part] if k % 2 else self.rules.words(part))]

    def texts(self, texts: list[str | None]):
        """The ids of each text, in order."""
        at = 0
        while at < len(texts):
            cut, chars = [], 0
            while at < len(texts) and chars < TOGETHER:
                t = texts[at]
                cut.append(self._cut(t) if t else [])
                chars += len(t or "")
                at += 1
            words = list(set().union(*cut).difference(self.special))
            found = self.lexicon.look(words)
            table = dict(zip(words, found, strict=True))
            self.seen[0] += len(words)
            self.seen[1] += len(words) - found.count(None)
            if None in found:
                merged = self.merged
                merged.fill([w for w, v in zip(words, found, strict=True) if v is None], self.rules.merge_many)
                for w, v in zip(words, found, strict=True):
                    if v is None:
                        table[w] = merged[w]
            table.update(self.special)
            get = table.__getitem__
            for ws in cut:
                yield b"".join(map(get, ws))


def word_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """How often each word occurs in all texts: counted in tasks, then summed by word."""

    def count(batches):
        cut, schema = rules(path), pa.schema([("word", pa.string()), ("n", pa.int64())])
        found: Counter = Counter()
        for (texts,) in rows_of(batches):
            for t in texts:
                for k, part in enumerate(cut.parts(t) if t else ()):
                    if k % 2 == 0:
                        found.update(cut.words(part))
            if len(found) > 200_000:
                yield batch(schema, list(found.items()))
                found.clear()
        if found:
            yield batch(schema, list(found.items()))

    return docs.select(text).transform(arrow, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, text: str = "text", size: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of the corpus' most frequent words; at most ``size`` words reach the driver.

    Counts fall into classes of an eighth of a power of two; the classes from the highest down that hold ``size`` words
    at most are taken whole, so no task sends more than it holds of them.
    """
    spec = rules(path)
    counts = word_counts(docs, path, text).where((F.col("n") >= LEAST_COUNT) & (F.length("word") <= LONGEST))
    counts = stored(counts.withColumn("class", F.floor(8 * F.log2("n")).cast("int")), "words")
    least, total = None, 0
    for r in counts.groupBy("class").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("class")).collect():
        total += r.words
        if total > size:
            break
        least = r["class"]
    top = [] if least is None else counts.where(F.col("class") >= least).select("word").collect()
    drop_path(docs.sparkSession, counts)
    return compile_lexicon({r.word: spec.merge(r.word) for r in top})


@cache
def _decoder(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids in a row, and where each id's begin and how many they are."""
    parts = rules(path).token_bytes()
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes


def decode(path: str, ids: bytes) -> bytes:
    """The UTF-8 of the text that the ids stand for; broken sequences become U+FFFD."""
    letters, firsts, sizes = _decoder(path)
    parts, every = [], np.frombuffer(ids, "<u4")
    for low in range(0, len(every), BLOCK):
        found = every[low : low + BLOCK]
        n = sizes[found]
        where = np.repeat(firsts[found] - np.cumsum(n) + n, n)
        where += np.arange(len(where))
        parts.append(letters[where].tobytes())
    data = b"".join(parts)
    try:
        data.decode()
    except UnicodeDecodeError:
        data = data.decode("utf-8", "replace").encode()
    return data


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(id_col, ids array<int>, decoded string) of every row, by the transducer lexicon."""
    return _run(docs, path, id_col, text, lexicon_words, "ids array<int>, decoded string", lambda ids, out: (np.frombuffer(ids, "<u4").astype("i4"), out.decode()))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of every row, from the same ids and decoded texts."""
    return _run(docs, path, id_col, text, lexicon_words, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, out: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(out).hexdigest()))


def _run(docs: DataFrame, path: str, id_col: str, text: str, lexicon_words: int, columns: str, made) -> DataFrame:
    spark = docs.sparkSession
    name = share(spark, build_lexicon(docs, path, text, lexicon_words))
    kind = docs.schema[id_col].dataType.simpleString()
    out = spark.createDataFrame([], f"`{id_col}` {kind}, {columns}").schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        enc = sole(("lexicon", path, name), lambda: LexiconEncoder(rules(path), Lexicon(mapped(name))))
        schema = to_arrow_schema(out)
        for keys, texts in rows_of(batches):
            yield batch(schema, [(i, *made(ids, decode(path, ids))) for i, ids in zip(keys, enc.texts(texts), strict=True)])

    return docs.select(id_col, text).transform(arrow, run, out)
