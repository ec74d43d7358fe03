"""Operator 9: n-gram Jaccard join by rare-first prefix filtering, and the components of its links.

A document's set holds the hashes of its distinct shingles of five words. Documents with equal sets are one node. In each
set the shingles are ordered by how many sets hold them, the rarest first, ties by hash. Two sets of Jaccard similarity t
or more share a shingle in the first n - ceil(t n) + 1 of each, so only these prefixes are dealt out by shingle; a shingle
that no other set holds leads nowhere and isn't dealt out at all. Pairs pass the length filter and the positional filter,
and are verified once by their whole sets, the suffix filter first.

Texts are read once, and never moved: their sets are written to the shared folder in chunks of some ``CHUNK`` shingles,
and later steps take the sets that they verify from there. How many sets hold a shingle is counted without sending sets about. Each chunk sends its distinct shingles, sorted, as 32-bit remainders
to one of as many buckets as keep some ``BUCKET`` shingles each, whatever the size of the corpus, and a bucket answers
with one byte a shingle in the same order. Two shingles of a bucket with the same remainder (about one in a thousand
shingles meets one) count as one shingle that is more frequent, which costs time and never a link. Copies count once in a chunk.

Only components are asked for, so no group is expanded into all pairs:
1. Prefix rows are dealt by ranges of (shingle, length, node), so that a hot shingle spreads over tasks. Each run of nodes
   that share a shingle is streamed: a node is paired with the run's first node and with the one before it. Pairs are
   verified; components of their links follow. A large group of near copies mostly is one component then.
2. What is left are pairs of nodes in one run (of four or more, or cut by a range's end) but in different components.
   Every node is put into its ``GROUPS`` largest runs that hold several components. A group's sets are brought together
   once, in blocks of some ``MEMBERS`` shingles and pairs of blocks where it is larger, and all its sets are intersected
   by an inverted index; of its links, a forest is returned.
3. The remaining pairs, of nodes with no group in common, are joined by shingle and class of length (only neighbouring
   classes can link), filtered, and verified singly.

Candidates name nodes by 64 bits, sets are equal only if 128 bits are. A set moves once for each pair to the pair's first
node (salted, so that one with many pairs is spread). Two different shingles are taken for the same with a chance of about 2^-64 for each pair compared.

Defined cases: null and empty texts have no shingles and no links; with one to four words, the whole sequence is the
only shingle; a row with a null id has a null component; rows that share an id are one vertex; an empty table gives an
empty result.
"""

from __future__ import annotations

import contextlib
import struct
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, delete, drop_path, file_system, rows_of, scratch, sole, stored

WORDS, SHARE = 5, 75
#: Shingles of a chunk and of a bucket, more or less. On executors of 3 GB these serve some TB; rows between them number
#: chunks times buckets, so a larger corpus wants both larger, in proportion to the executors' memory.
CHUNK, BUCKET = 1 << 20, 1 << 21
#: Pairs of one node that a task verifies at most.
SPREAD = 500
#: Nodes with more pairs than that which are broadcast at most (12 bytes each).
FEW = 100_000
#: Groups of a node, least rows of a run that makes a group, and shingles of a block.
GROUPS, LEAST_RUN, MEMBERS = 6, 8, 1 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], "<u8")
_hash = xxhash.xxh3_64_intdigest


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = text.encode().lower().split() if text else ()
    n = len(words)
    if not n:
        return np.empty(0, "<u8")
    if n < WORDS:
        return np.array([_hash(b" ".join(words), n)], "<u8")
    h = np.fromiter(map(_hash, words), "<u8", n)
    m = n - WORDS + 1
    x = h[:m] * _ODD[0]
    for k in range(1, WORDS):
        x += h[k : k + m] * _ODD[k]
    x = _mix(x)
    x.sort()
    first = np.ones(m, bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x if first.all() else x[first]


def _name(s: np.ndarray) -> tuple[int, int]:
    """The 128-bit name of a set, as two signed numbers: the node, and what tells nodes of one number apart."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(s.tobytes(), 1))


def least_overlap(a: int, b: int) -> int:
    """The intersection that two sets of these sizes need: 100 i >= 75 (a + b - i)."""
    return -(-SHARE * (a + b) // (100 + SHARE))


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 3) -> int:
    """An upper bound of the intersection of two sorted arrays, by halving one and parting the other likewise."""
    if depth == 0 or len(a) < 4 or len(b) < 4:
        return min(len(a), len(b))
    i = len(a) // 2
    j = int(np.searchsorted(b, a[i]))
    return suffix_bound(a[:i], b[:j], depth - 1) + suffix_bound(a[i:], b[j:], depth - 1)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the similarity of two sets reaches the threshold."""
    if len(a) > len(b):
        a, b = b, a
    need = least_overlap(len(a), len(b))
    if not len(a) or len(a) < need or suffix_bound(a, b) < need:
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) >= need


def write_sets(docs: DataFrame, id_col: str, text: str, folder: str) -> DataFrame:
    """Rows (id, n_shingles, node, more, chunk), node being null for empty sets and chunk for sets that the task's chunk
    has already, and a row (chunk, size) for each chunk written to ``folder``, size being its distinct shingles.

    A chunk is a file of one Arrow batch: id, node, number and shingles of each set."""
    kind, id_type = docs.schema[id_col].dataType.simpleString(), _arrow_type(docs, id_col)
    names = ["id", "n_shingles", "node", "more", "chunk", "size"]

    def run(batches):
        sole("jaccard", dict)  # what other operators remembered goes
        fs, base = file_system(folder)
        name, seen, held, size = 0, set(), [], 0

        def put():
            tokens = np.concatenate([s for *_, s in held])
            columns = [pa.array([i for i, *_ in held], id_type), pa.array([v for _, v, _ in held], pa.int64()), pa.array([len(s) for *_, s in held], pa.int64())]
            ends = np.cumsum([0, *(8 * len(s) for *_, s in held)])
            columns.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(held), [None, pa.py_buffer(ends.astype("<i8")), pa.py_buffer(tokens)]))
            made = pa.RecordBatch.from_arrays(columns, ["id", "node", "n", "tokens"])
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(f"{base}/{name}") as f, pa.ipc.new_stream(f, made.schema) as w:
                w.write_batch(made)
            tokens = np.sort(tokens)
            distinct = 1 + int((tokens[1:] != tokens[:-1]).sum())
            seen.clear()
            held.clear()
            empty = [pa.nulls(1, t) for t in (id_type, pa.int64(), pa.int64(), pa.int64())]
            return pa.RecordBatch.from_arrays([*empty, pa.array([name]), pa.array([distinct], pa.int64())], names)

        for b in batches:
            found = []
            for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = shingles(t)
                named = _name(s) if len(s) else (None, None)
                own = None
                if i is not None and len(s) and named not in seen:
                    name = own = name or uuid.uuid4().int >> 65
                    seen.add(named)
                    held.append((i, named[0], s))
                    size += len(s)
                found.append((len(s), *named, own))
                if size >= CHUNK:
                    yield put()
                    name = size = 0
            yield pa.RecordBatch.from_arrays([b.column(0).cast(id_type), *(pa.array(x, pa.int64()) for x in zip(*found, strict=True)), pa.nulls(len(found), pa.int64())], names)
        if held:
            yield put()

    return docs.select(id_col, text).transform(arrow, run, f"id {kind}, n_shingles long, node long, more long, chunk long, size long")


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _read(fs, path: str) -> pa.RecordBatch:
    with fs.open_input_file(path) as f:
        return pa.ipc.open_stream(f.read_buffer()).read_next_batch()


def _read_sets(fs, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes, sizes and shingles of a chunk."""
    held = _read(fs, path)
    return held["node"].to_numpy(), held["n"].to_numpy(), np.frombuffer(held["tokens"].buffers()[2], "<u8")


def fetch(wanted: DataFrame, folder: str, kind: str, tasks: int) -> DataFrame:
    """``wanted`` with the columns id and tokens (bytes) of its node in its chunk. Each chunk is read by one task."""
    out = wanted.withColumns({"id": F.lit(None).cast(kind), "tokens": F.lit(None).cast("binary")}).schema
    names = out.names

    def run(batches):
        fs, base = file_system(folder)
        name, held, places, ends = None, None, {}, None
        for b in batches:
            chunks = b.column(b.schema.get_field_index("chunk")).to_numpy()
            nodes = b.column(b.schema.get_field_index("node")).to_pylist()
            starts = np.flatnonzero(np.append(True, chunks[1:] != chunks[:-1])) if len(chunks) else []
            for a, z in zip(starts, [*starts[1:], len(chunks)], strict=True):
                if chunks[a] != name:
                    name, places = int(chunks[a]), {}
                    held = _read(fs, f"{base}/{name}")
                    sizes = held["n"].to_numpy()
                    for k, v in enumerate(held["node"].to_pylist()):
                        places.setdefault(v, []).append(k)
                both = [(k, at) for k in range(a, z) for at in places[nodes[k]]]
                ends = np.cumsum([sizes[at] for _, at in both])
                at = 0
                while at < len(both):  # some 8 MB at a time
                    stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20))))
                    left, right = (pa.array([x[k] for x in both[at:stop]], pa.int64()) for k in (0, 1))
                    yield pa.RecordBatch.from_arrays([*b.take(left).columns, held["id"].take(right), held["tokens"].take(right).cast(pa.binary())], names)
                    at = stop

    return wanted.repartition(tasks, "chunk").sortWithinPartitions("chunk").transform(arrow, run, out)


def _class(counts: np.ndarray) -> np.ndarray:
    """A byte for each count, growing with it; 0 for 1."""
    return np.minimum(8 * np.log2(counts), 255).astype(np.uint8)


def frequencies(chunks: DataFrame, folder: str, bits: int, tasks: int) -> DataFrame:
    """(chunk, bucket, classes): for each chunk's distinct shingles, in order, the class of the number of sets that hold them."""

    def ask(batches):
        fs, base = file_system(folder)
        for (names,) in rows_of(batches):
            for name in names:
                tokens, counts = np.unique(_read_sets(fs, f"{base}/{name}")[2], return_counts=True)
                rest = ((tokens >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
                counts = np.minimum(counts, 255).astype(np.uint8)
                bucket = (tokens >> np.uint64(32) >> np.uint64(32 - bits)).astype(np.int64)
                starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                ends = np.append(starts[1:], len(tokens))
                for k in range(0, len(starts), 1000):
                    part = list(zip(starts[k : k + 1000].tolist(), ends[k : k + 1000].tolist(), strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(part), pa.int64()), pa.array(bucket[starts[k : k + 1000]], pa.int32()), *(pa.array([x[a:b].tobytes() for a, b in part], pa.binary()) for x in (rest, counts))],
                        ["chunk", "bucket", "rest", "counts"],
                    )

    def answer(batches):
        key, held = None, []

        def solve():
            rest = np.concatenate([np.frombuffer(r, "<u4") for _, r, _ in held])
            _, at = np.unique(rest, return_inverse=True)
            total = np.bincount(at, np.frombuffer(b"".join(c for *_, c in held), np.uint8))
            found, k = _class(total)[at], 0
            for chunk, r, _ in held:
                n = len(r) // 4
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([key], pa.int32()), pa.array([found[k : k + n].tobytes()], pa.binary())], ["chunk", "bucket", "classes"])
                k += n
            held.clear()

        for rows in rows_of(batches):
            for chunk, bucket, rest, counts in zip(*rows, strict=True):
                if bucket != key:
                    if held:
                        yield from solve()
                    key = bucket
                held.append((chunk, rest, counts))
        if held:
            yield from solve()

    asked = chunks.select("chunk").repartition(tasks).transform(arrow, ask, "chunk long, bucket int, rest binary, counts binary")
    return asked.repartitionById(1 << bits, F.col("bucket")).sortWithinPartitions("bucket").transform(arrow, answer, "chunk long, bucket int, classes binary")


def prefixes(answers: DataFrame, folder: str, tasks: int) -> DataFrame:
    """(token, node, n, pos, chunk) for each prefix shingle of each set that other sets hold, too."""
    names = ["token", "node", "n", "pos", "chunk"]

    def rows(name, held, fs, base):
        nodes, sizes, tokens = _read_sets(fs, f"{base}/{name}")
        _, at = np.unique(tokens, return_inverse=True)
        often = np.frombuffer(b"".join(held), np.uint8)[at]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        # shingles are sorted within a set, and the sort is stable: ties are by hash
        order = np.argsort(owner << 8 | often, kind="stable")
        pos = np.arange(len(tokens)) - starts[owner]
        need = sizes - -(-SHARE * sizes // 100) + 1
        fit = (pos < need[owner]) & (often[order] > 0)
        owner = owner[fit]
        cols = [tokens[order[fit]].view(np.int64), nodes[owner], sizes[owner].astype(np.int32), pos[fit].astype(np.int32), np.full(len(owner), name)]
        for k in range(0, len(owner), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 50_000]) for c in cols], names)

    def run(batches):
        fs, base = file_system(folder)
        key, held = None, []
        for cols in rows_of(batches):
            for chunk, classes in zip(*cols, strict=True):
                if chunk != key:
                    if held:
                        yield from rows(key, held, fs, base)
                    key, held = chunk, []
                held.append(classes)
        if held:
            yield from rows(key, held, fs, base)

    dealt = answers.repartition(tasks, "chunk").sortWithinPartitions("chunk", "bucket").select("chunk", "classes")
    return dealt.transform(arrow, run, "token long, node long, n int, pos int, chunk long")


def possible(n1, p1, n2, p2):
    """Length and positional filter for numbers, arrays or columns: the overlap still possible reaches the one needed."""
    if isinstance(n1, np.ndarray):
        low, rest, pos, big, both = np.minimum(n1, n2), np.minimum(n1 - p1, n2 - p2), np.minimum(p1, p2), np.maximum(n1, n2), n1 + n2
    else:
        low, rest, pos, big, both = F.least(n1, n2), F.least(n1 - p1, n2 - p2), F.least(p1, p2), F.greatest(n1, n2), n1 + n2
    return (100 * low >= SHARE * big) & ((100 + SHARE) * (pos + rest) >= SHARE * both)


def first_pairs(entries: DataFrame) -> DataFrame:
    """Stream the runs of equal tokens: pairs with the run's first and previous node, and the rows of runs of four or more.

    Tasks hold ranges of (token, n, node); the rows of a task's first and last run, which other tasks may share, are given
    too. Rows of the result: (token, seg, a, ca, b, cb, n, pos); pairs, the first in the order of (n, node) as a, have a null
    token, rows of runs a null b, and seg is the task.
    """
    names = ["token", "seg", "a", "ca", "b", "cb", "n", "pos"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def rows_batch(**columns):
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in zip(names, types, strict=True)], names)

    def run(batches):
        # carried from batch to batch: the rows of the last run while it has three or fewer, else its first and last row
        pairs, empty = {}, tuple(np.empty(0, np.int64) for _ in range(5))
        held, going, opening = empty, None, True
        seg = TaskContext.get().partitionId()

        def fresh(rows):
            """Without rows that repeat the node before them in a run."""
            t, v = rows[:2]
            keep = np.ones(len(t), bool)
            keep[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
            return tuple(x[keep] for x in rows)

        def pair(rows, i, j):
            _, v, n, p, c = rows
            ok = possible(n[i], p[i], n[j], p[j]) & (v[i] != v[j])
            i, j = i[ok], j[ok]
            pairs.update(zip(zip(v[i].tolist(), v[j].tolist(), strict=True), zip(c[i].tolist(), c[j].tolist(), strict=True), strict=True))

        def hot(rows):
            t, v, n, p, c = rows
            if len(t):
                yield rows_batch(token=t, seg=np.full(len(t), seg), a=v, ca=c, n=n, pos=p)

        def runs(rows, last):
            """Pairs and rows of whole runs; the last run may go on unless ``last``."""
            nonlocal held, going, opening
            rows = fresh(rows)
            t = rows[0]
            if not len(t):
                return
            starts = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            sizes = np.diff(np.append(starts, len(t)))
            given = sizes > 3
            given[0] |= opening
            given[-1] |= last
            if not last:
                if sizes[-1] > 3:
                    going = tuple(x[[starts[-1], len(t) - 1]] for x in rows)
                else:
                    held, rows = tuple(x[starts[-1] :] for x in rows), tuple(x[: starts[-1]] for x in rows)
                    starts, sizes, given = starts[:-1], sizes[:-1], given[:-1]
            if not len(starts):
                return
            opening = False
            head = np.repeat(starts, sizes)
            i = np.arange(len(head))
            pair(rows, i[i > head] - 1, i[i > head])
            pair(rows, head[i > head + 1], i[i > head + 1])
            yield from hot(tuple(x[np.repeat(given, sizes)] for x in rows))

        def spill():
            found = list(pairs.items())
            pairs.clear()
            for k in range(0, len(found), 20_000):
                part = found[k : k + 20_000]
                yield rows_batch(a=[x[0][0] for x in part], b=[x[0][1] for x in part], ca=[x[1][0] for x in part], cb=[x[1][1] for x in part])

        for b in batches:
            rows = tuple(c.to_numpy().astype(np.int64) for c in b.columns)
            if going is not None and len(rows[0]):
                k = int((rows[0] == going[0][0]).sum())
                if k:
                    part = fresh(tuple(np.append(g[1:], x[:k]) for g, x in zip(going, rows, strict=True)))
                    i = np.arange(1, len(part[0]))
                    pair(part, i - 1, i)
                    both = tuple(np.append(g[:1], x[1:]) for g, x in zip(going, part, strict=True))
                    pair(both, np.zeros(len(i), np.int64), i)
                    yield from hot(tuple(x[1:] for x in part))
                    going = tuple(np.array([g[0], x[-1]]) for g, x in zip(going, part, strict=True))
                    rows = tuple(x[k:] for x in rows)
                if len(rows[0]):
                    going = None
            before, held = held, empty
            yield from runs(tuple(np.append(x, y) for x, y in zip(before, rows, strict=True)), False)
            if len(pairs) > 200_000:
                yield from spill()
        yield from runs(held, True)
        yield from spill()

    order = ["token", "n", "node"]
    kinds = "token long, seg int, a long, ca long, b long, cb long, n int, pos int"
    return entries.repartitionByRange(*order).sortWithinPartitions(*order).transform(arrow, run, kinds)


def verify(pairs: DataFrame, fetched, id_type: pa.DataType, kind: str, held) -> DataFrame:
    """The links (u, v) of documents among pairs (a, ca, b, cb) of nodes in chunks, verified by their whole sets."""
    busy = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("load")).where(F.col("load") > SPREAD).select("a", F.ceil(F.col("load") / SPREAD).cast("int").alias("salts"))
    busy = held(busy, "busy")
    if busy.count() <= FEW:  # else Spark sorts both sides
        busy = F.broadcast(busy)
    dealt = pairs.join(busy, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int"))
    right = dealt.select(F.col("a").alias("to"), "salt", F.lit(1).alias("role"), F.col("b").alias("node"), F.col("cb").alias("chunk"))
    left = dealt.groupBy(F.col("a").alias("to"), "salt").agg(F.min("ca").alias("chunk")).select("to", "salt", F.lit(0).alias("role"), F.col("to").alias("node"), "chunk")

    def run(batches):
        key, base = None, []
        for to, salt, role, ids, tokens in rows_of(batches):
            found = []
            for k in range(len(to)):
                if (to[k], salt[k]) != key:
                    key, base = (to[k], salt[k]), []
                s = np.frombuffer(tokens[k], "<u8")
                if role[k] == 0:
                    base.append((ids[k], s))
                else:
                    found += [(i, ids[k]) for i, x in base if linked(x, s)]
            if found:
                yield batch_of(found, id_type)

    sent = fetched(left.unionByName(right)).select("to", "salt", "role", "id", "tokens")
    return sent.repartition("to", "salt").sortWithinPartitions("to", "salt", "role").transform(arrow, run, f"u {kind}, v {kind}").distinct()


def batch_of(links: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], kind) for i in (0, 1)], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for each vertex of the edges (u, v) but the roots: the smallest vertex that it reaches.

    Alternating large-star and small-star steps; each is written to the shared folder, only counts reach the driver.
    """
    edges = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = stored(small.where("u != v").distinct(), "edges")
        new = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.countDistinct("u")).first()
        drop_path(edges.sparkSession, edges)
        edges = after
        if tuple(new) == mark and new[0] == new[2] or not new[0]:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
        mark = tuple(new)


@contextlib.contextmanager
def _swept(spark: SparkSession):
    """Shuffle files go when the query that wrote them has ended: each step's result is stored."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old) if old is not None else spark.conf.unset(key)


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    kind, id_type = docs.schema[id_col].dataType.simpleString(), _arrow_type(docs, id_col)
    folder, passing = scratch(spark, "chunks"), []

    def held(df: DataFrame, name: str) -> DataFrame:
        passing.append(stored(df, name))
        return passing[-1]

    with _swept(spark):
        made = stored(write_sets(docs, id_col, text, folder), "sets")
        rows = made.where("size IS NULL").select("id", "n_shingles", "node", "more", "chunk")
        vertices = rows.where("node IS NOT NULL AND id IS NOT NULL")
        reps = stored(vertices.groupBy("node", "more").agg(F.min("id").alias("rep")), "reps")
        chunks = made.where("size IS NOT NULL").select("chunk", "size")
        n, total = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        bits, tasks = max(0, (total // BUCKET).bit_length()), max(1, min(n, 16 * spark.sparkContext.defaultParallelism))
        entries = held(prefixes(frequencies(chunks, folder, bits, tasks), folder, 3 * tasks), "prefixes")
        found = held(first_pairs(entries), "pairs")

        def fetched(wanted: DataFrame) -> DataFrame:
            return fetch(wanted, folder, kind, 3 * tasks)

        first = held(found.where("token IS NULL").groupBy("a", "b").agg(F.min("ca").alias("ca"), F.min("cb").alias("cb")), "tried")
        # documents of one set in several chunks, and sets that one id has, belong together
        copies = vertices.where("chunk IS NOT NULL").join(reps, ["node", "more"]).where("id != rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
        torn = vertices.groupBy("id").agg(F.min(F.struct("node", "more")).alias("low"), F.max(F.struct("node", "more")).alias("high")).where("low != high").select("id")
        ties = vertices.join(torn, "id").join(reps, ["node", "more"]).select(F.col("id").alias("u"), F.col("rep").alias("v"))
        links = held(verify(first, fetched, id_type, kind, held).unionByName(copies).unionByName(ties), "links")
        runs = found.where("token IS NOT NULL").select("token", "seg", F.col("a").alias("node"), F.col("ca").alias("chunk"), "n", "pos")
        roots = components(_rest(runs, first, links, reps, fetched, id_type, kind, held))
        for df in passing:
            drop_path(spark, df)
        delete(spark, folder)
    named = reps.join(roots.withColumnRenamed("v", "rep"), "rep", "left").select("node", "more", F.coalesce("root", "rep").alias("root"))
    by_id = vertices.join(named, ["node", "more"]).groupBy("id").agg(F.min("root").alias("root"))
    return rows.join(by_id, "id", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("root", "id").alias("component_id"))


def verify_groups(members: DataFrame, fetched, id_type: pa.DataType, kind: str) -> DataFrame:
    """Links (u, v) that join components within groups. members: (token, weight, node, chunk, part, groups), groups sorted."""
    blocks = F.ceil(F.col("weight") / MEMBERS).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    spread = members.select("token", "node", "chunk", "part", "groups", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    wanted = spread.select("token", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "chunk", "part", "groups")

    def solve(key, rows):
        known: dict[tuple, tuple] = {}
        for own, node, part, groups, i, tokens in rows:
            known.setdefault((node, tokens), (own, part, groups, np.frombuffer(tokens, "<u8"), i))
        nodes = list(known.values())
        n, sizes = len(nodes), np.array([len(v[3]) for v in nodes])
        if n < 2:
            return
        owns, number = np.array([v[0] for v in nodes]), {}
        parts = np.array([number.setdefault(v[1], len(number)) for v in nodes])
        _, inverse = np.unique(np.concatenate([v[3] for v in nodes]), return_inverse=True)
        holder = np.repeat(np.arange(n), sizes)
        order = np.argsort(inverse, kind="stable")
        posting, at = holder[order], np.concatenate([[0], np.cumsum(np.bincount(inverse))])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        most = np.bincount(parts).argmax()
        root = list(range(len(number)))

        def top(p):
            while root[p] != p:
                root[p] = p = root[root[p]]
            return p

        for i in np.flatnonzero(parts != most).tolist():
            shared = np.bincount(np.concatenate([posting[at[x] : at[x + 1]] for x in inverse[ends[i] : ends[i + 1]].tolist()]), minlength=n)
            fit = ((100 + SHARE) * shared >= SHARE * (sizes + sizes[i])) & (parts != parts[i])
            if key[1] != key[2]:
                fit &= owns != owns[i]
            for j in np.flatnonzero(fit).tolist():
                # a pair belongs to the first group that it has in common
                if min(set(nodes[i][2]) & set(nodes[j][2])) != key[0]:
                    continue
                a, b = top(int(parts[i])), top(int(parts[j]))
                if a != b:
                    root[a] = b
                    yield nodes[i][4], nodes[j][4]

    def run(batches):
        key, held = None, []
        for token, low, high, *rest in rows_of(batches):
            for k, row in zip(zip(token, low, high, strict=True), zip(*rest, strict=True), strict=True):
                if k != key:
                    if links := list(solve(key, held)):
                        yield batch_of(links, id_type)
                    key, held = k, []
                held.append(row)
        if links := list(solve(key, held)):
            yield batch_of(links, id_type)

    sent = fetched(wanted).drop("chunk")
    return sent.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high").transform(arrow, run, f"u {kind}, v {kind}").distinct()


def _rest(runs: DataFrame, tried: DataFrame, links: DataFrame, reps: DataFrame, fetched, id_type: pa.DataType, kind: str, held) -> DataFrame:
    """All links, with those between nodes of one run that the first step left in different components."""

    def parted(rows: DataFrame, links: DataFrame) -> DataFrame:
        """Rows of the runs that hold several components; a run's rows stay in the segments that it was read in."""
        roots = components(links).select(F.col("v").alias("rep"), "root")
        named = rows.join(roots, "rep", "left").withColumn("part", F.coalesce("root", "rep")).drop("root")
        segs = named.groupBy("token", "seg").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.min("part").alias("low"), F.max("part").alias("high"))
        whole = segs.groupBy("token").agg(F.sum("size").alias("size"), F.sum("weight").alias("weight"), F.min("low").alias("low"), F.max("high").alias("high"))
        mixed = whole.where("low != high").select("token", "size", "weight")
        return named.join(segs.select("token", "seg").join(mixed, "token"), ["token", "seg"])

    names = held(parted(runs.join(reps.select("node", "rep"), "node"), links), "parts")
    largest = F.array_sort(F.collect_list(F.struct(-F.col("size"), "token")))
    groups = names.where(F.col("size") >= LEAST_RUN).groupBy("node").agg(F.array_sort(F.transform(F.slice(largest, 1, GROUPS), lambda x: x["token"])).alias("groups"))
    names = held(names.join(groups, "node", "left").withColumn("groups", F.coalesce("groups", F.array().cast("array<long>"))), "grouped")
    members = names.where(F.array_contains("groups", F.col("token"))).select("token", "weight", "node", "chunk", "part", "groups")
    links = links.unionByName(held(verify_groups(members, fetched, id_type, kind), "links"))
    # two sets that link have lengths of a ratio of at most 4 to 3, so their classes are the same or neighbours
    rest = parted(names.drop("part", "size", "weight"), links).withColumn("class", F.floor(F.log("n") / F.log(F.lit(1.34))).cast("int"))
    x, y = rest.alias("x"), rest.withColumn("class", F.explode(F.array(F.col("class") - 1, "class", F.col("class") + 1))).alias("y")
    fits = possible(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"))
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.class") == F.col("y.class")) & (F.col("x.part") < F.col("y.part")) & fits & ~F.arrays_overlap("x.groups", "y.groups")
    one, two = (F.struct(F.col(f"{s}.n"), F.col(f"{s}.node"), F.col(f"{s}.chunk")) for s in "xy")
    pairs = x.join(y, apart).select(F.least(one, two).alias("p"), F.greatest(one, two).alias("q"))
    pairs = pairs.groupBy(F.col("p.node").alias("a"), F.col("q.node").alias("b")).agg(F.min("p.chunk").alias("ca"), F.min("q.chunk").alias("cb"))
    pairs = held(pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "tried")
    return links.unionByName(held(verify(pairs, fetched, id_type, kind, held), "links"))
