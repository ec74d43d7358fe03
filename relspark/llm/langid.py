"""Operator 7: language identification by a linear-chain conditional random field.

Every word of a text gets a label. A word's emission is the sum of learned weights of its features (the word itself, as
in a lexicon; prefixes and suffixes; character n-grams; capital and accent signs); learned transitions tie neighbouring labels. Forward-backward over the whole text gives each word's label probabilities, so
code-switched texts are labelled word by word; a text's language is the label with the largest sum of probabilities,
its score the mean of them, and its confidence the mean of each word's largest probability, whatever its label.

Training takes a bounded sample (about ``TRAIN_ROWS`` distinct labelled texts, as many of each label, of least hash, and
``TRAIN_CHARS`` characters from a hashed place of each), joined into sequences that switch between languages, and maximises the likelihood by Adagrad. Defined
cases: a text that is null or has no letter is ``und`` with score 0; without labelled rows everything is ``und``;
words are runs of letters, those of more than ``LONG`` are successive positions of ``LONG`` letters each, so that text
without spaces is labelled letter for letter; very long texts are labelled whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count, islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, sole

#: Bounds of the training sample, and passes over it.
TRAIN_ROWS, TRAIN_CHARS, EPOCHS = 1500, 400, 25
#: Rows of a label at least, and labels at most.
LEAST_OF_LABEL, LABELS = 30, 500
#: Probabilities (words times labels) that one forward-backward pass over whole texts wants, and remembered words in a worker.
CELLS, MEMO = 600_000, 200_000
#: Words of a piece of a text, and labels with which texts are cut into pieces.
CUT, FEW = 128, 8
#: Letters of one position, words whose features are held at once, and codes of n-grams that are numbered by an array.
LONG, BLOCK, CODES = 40, 20_000, 1 << 22
_runs = re.compile(r"[^\W\d_]+").findall


def _words(text: str) -> list[str]:
    """The words of a text. A longer run than ``LONG`` is cut: a hyphen marks the cut ends, and a later piece repeats the two letters before it."""
    runs = _runs(text)
    if not runs or max(map(len, runs)) <= LONG:
        return runs
    return [p for r in runs for p in ([r] if len(r) <= LONG else [("-" if k else "") + r[max(0, k - 2) : k + LONG] + ("-" if k + LONG < len(r) else "") for k in range(0, len(r), LONG)])]


def _marked(word: str) -> str:
    """A word in lower case between its boundary marks, which cut ends don't have."""
    return ("" if word[0] == "-" else "^") + word.strip("-").lower() + ("" if word[-1] == "-" else "$")


def features(word: str) -> list[str]:
    """The features of a word between its boundary marks: its n-grams, affixes among them, and the word itself."""
    body, later, cut = word.strip("-"), word[0] == "-", word[-1] == "-"
    s = _marked(word)
    n = len(s)
    grams = [s[k : k + 2] for k in range(later, n - 1)] + [s[k : k + 3] for k in range(n - 2)]
    ends = ([] if later else [s[:4]]) + ([] if cut else [s[-4:], s[-5:]])
    return [*grams, *ends, s, "A" if body[0].isupper() else "a", "0" if body.isascii() else "1"]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Label probabilities of padded sequences, the longest first.

    scores: (sequences, time, labels), each row's largest is near 0; trans and start: log weights. Returns (sequences,
    time, labels) and, with ``pairs``, the expected transition counts and first labels.
    """
    b, t, n = scores.shape
    move, emit = np.exp(trans).astype(scores.dtype), np.exp(scores)
    alive = np.searchsorted(-lengths, -np.arange(1, t + 1), side="right")
    alpha = np.zeros_like(emit)
    alpha[:, 0] = emit[:, 0] * np.exp(start).astype(scores.dtype)
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for k in range(1, t):
        m = alive[k]
        a = (alpha[:m, k - 1] @ move) * emit[:m, k]
        alpha[:m, k] = a / a.sum(1, keepdims=True)
    beta = np.ones((b, n), scores.dtype)
    gamma = alpha
    counts, firsts = np.zeros((n, n)), None
    for k in range(t - 1, 0, -1):
        m = alive[k]
        right = emit[:m, k] * beta[:m]
        if pairs:
            joint = alpha[:m, k - 1, :, None] * move[None] * right[:, None, :]
            counts += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        g = gamma[:m, k] * beta[:m]
        back = right @ move.T
        beta[:m] = back / back.sum(1, keepdims=True)
        gamma[:m, k] = g / g.sum(1, keepdims=True)
    g = gamma[:, 0] * beta
    gamma[:, 0] = g / g.sum(1, keepdims=True)
    if pairs:
        firsts = gamma[:, 0].sum(0)
    return (gamma, counts, firsts) if pairs else gamma


def probabilities(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label probabilities of the words of sequences that lie one after the other, all of one word at least.

    emit: positive weights of (words, labels), of which a row's largest is near 1. Sequences are cut at every ``CUT`` words:
    the products of weights and moves over the pieces are made for all pieces together, a step at a time, then they carry
    what goes before and after each piece along its sequence, and all pieces are walked together. With more than ``FEW``
    labels, whose products would cost more than that saves, sequences are walked whole.
    """
    n, kind = emit.shape[1], emit.dtype
    move, first = np.exp(trans).astype(kind), np.exp(start).astype(kind)
    size = CUT if n <= FEW else int(lengths.max())
    pieces = -(-lengths // size)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    sizes = np.minimum(lengths[owner] - size * rank, size)
    order = np.argsort(-sizes, kind="stable")
    alive = np.searchsorted(-sizes[order], -np.arange(1, sizes.max() + 1), side="right")
    # where each word stands, in the order of the walk: all first words of pieces, then all second ones and so on
    firsts = (np.cumsum(sizes) - sizes)[order]
    begins = np.cumsum(alive) - alive
    where = firsts[np.arange(len(emit)) - np.repeat(begins, alive)] + np.repeat(np.arange(len(alive)), alive)
    emit = emit[where]
    before, behind = np.tile(first, (len(owner), 1)), np.ones((len(owner), n), kind)
    if len(owner) > len(lengths):
        products = np.empty((len(owner), n, n), kind)
        products[order] = _products(emit, alive, move)
        _carry(before, behind, products, pieces, move)
    done = np.empty_like(emit)
    done[where] = _walk(emit, alive, move, before[order], behind[order])
    return done


def _products(emit: np.ndarray, alive: np.ndarray, move: np.ndarray) -> np.ndarray:
    """For each piece in the order of the walk, the product of its words' weights with the moves between them, up to a factor."""
    n, after = len(move), np.cumsum(alive).tolist()
    ones = np.ones((n * n, 1), emit.dtype)
    out = np.eye(n, dtype=emit.dtype) * emit[: after[0], None, :]
    for low, high in zip(after, after[1:], strict=False):
        x = out[: high - low]
        np.multiply((x.reshape(-1, n) @ move).reshape(x.shape), emit[low:high, None, :], out=x)
        flat = x.reshape(-1, n * n)
        flat /= flat @ ones
    return out


def _carry(before: np.ndarray, behind: np.ndarray, products: np.ndarray, pieces: np.ndarray, move: np.ndarray) -> None:
    """Fill in what goes before a sequence's later pieces and behind its earlier ones."""
    starts = np.cumsum(pieces) - pieces
    ats = [starts[pieces > k] + k for k in range(1, int(pieces.max()))]
    for at in ats:
        x = (before[at - 1, None] @ products[at - 1])[:, 0] @ move
        before[at] = x / x.sum(1, keepdims=True)
    for at in reversed(ats):
        x = (products[at] @ behind[at, :, None])[..., 0] @ move.T
        behind[at - 1] = x / x.sum(1, keepdims=True)


def _walk(emit: np.ndarray, alive: np.ndarray, move: np.ndarray, before: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Label probabilities of the words of pieces, the longest first, ``alive`` of which have a word in each place."""
    ones, back, after = np.ones((len(move), 1), emit.dtype), np.ascontiguousarray(move.T), np.cumsum(alive).tolist()
    alpha = np.empty_like(emit)
    last = alpha[: after[0]]
    np.multiply(emit[: after[0]], before, out=last)
    last /= last @ ones
    for low, high in zip(after, after[1:], strict=False):
        a = alpha[low:high]
        np.matmul(last[: high - low], move, out=a)
        a *= emit[low:high]
        a /= a @ ones
        last = a
    for low, high in zip(after[-2::-1], after[:0:-1], strict=True):
        b = behind[: high - low]
        alpha[low:high] *= b
        b *= emit[low:high]
        b[:] = b @ back
        b /= b @ ones
    alpha[: after[0]] *= behind
    alpha /= alpha @ ones
    return alpha


class _Grams:
    """The numbers of the features of ``size`` characters, which are told by the numbers of their characters."""

    def __init__(self, known: dict[str, int], size: int, alphabet: dict[str, int]) -> None:
        self.none, base = len(known), len(alphabet) + 1
        code = lambda f: sum(alphabet[c] * base**k for k, c in enumerate(reversed(f)))
        found = sorted((code(f), n) for f, n in known.items() if len(f) == size)
        self.codes, self.numbers = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else ((-1,), (self.none,))))
        self.array = None
        if base**size <= CODES:
            self.array = np.full(base**size, self.none, np.int32)
            self.array[self.codes] = self.numbers

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        if self.array is not None:
            return self.array[codes]
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.numbers[at], self.none)


class Model:
    """Labels, the number of each feature, weights (features and a last row of zeros x labels), transitions and first-label weights."""

    def __init__(self, labels: list[str], known: dict[str, int], weights: np.ndarray, trans: np.ndarray, start: np.ndarray) -> None:
        self.labels, self.known, self.weights, self.trans, self.start = labels, known, weights, trans, start
        self.tables = None

    def emissions(self, words: list[str]) -> np.ndarray:
        """The summed weights of each word's :func:`features`, found for many words together; those that training didn't see weigh nothing."""
        if self.tables is None:
            alphabet = {c: k for k, c in enumerate(sorted(set().union(*(f for f in self.known if 2 <= len(f) <= 3))), 1)}
            letters = np.zeros(0x110000, np.int32)
            letters[[ord(c) for c in alphabet]] = list(alphabet.values())
            self.tables = letters, len(alphabet) + 1, _Grams(self.known, 2, alphabet), _Grams(self.known, 3, alphabet)
        return np.concatenate([self._emissions(words[at : at + BLOCK]) for at in range(0, len(words), BLOCK)])

    def _emissions(self, words: list[str]) -> np.ndarray:
        letters, base, twos, threes = self.tables
        get, none, take = self.known.get, len(self.known), lambda k: self.weights.take(k, 0)
        whole = "-" not in "".join(words)
        bodies, marked = (words, [f"^{w.lower()}$" for w in words]) if whole else ([w.strip("-") for w in words], list(map(_marked, words)))
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        ends = np.cumsum(sizes)
        firsts = ends - sizes
        c = letters[np.frombuffer("".join(marked).encode("utf-32-le"), "<u4")].astype(np.int64)
        c = np.concatenate([c, np.zeros(2, np.int64)])
        pairs = c[:-2] * base + c[1:-1]
        two, three = twos(pairs), threes(pairs * base + c[2:])
        two[ends - 1] = three[ends - 1] = three[np.maximum(ends - 2, firsts)] = none
        affixes = [np.array([get(s[k], none) for s in marked]) for k in (slice(4), slice(-4, None), slice(-5, None))]
        if not whole:
            later, cut = (np.array([w[k] == "-" for w in words]) for k in (0, -1))
            two[firsts[later]] = affixes[0][later] = affixes[1][cut] = affixes[2][cut] = none
        out = np.add.reduceat(take(two) + take(three), firsts)
        for held in affixes:
            out += take(held)
        out += take([get(s, none) for s in marked])
        big, small, plain, other = (get(f, none) for f in "Aa01")
        out += take([big if b[0].isupper() else small for b in bodies])
        out += take([plain if b.isascii() else other for b in bodies])
        return out


def fit(samples: list[tuple[str, list[str]]], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """The field's weights from (label, words) pieces."""
    labels = sorted({l for l, _ in samples})
    n, rng = len(labels), np.random.default_rng(seed)
    number: dict[str, int] = {}
    pieces = []
    for l, ws in samples:
        ids = [number.setdefault(w, len(number)) for w in ws]
        pieces += [(labels.index(l), ids[k : k + 24]) for k in range(0, len(ids), 24)]
    order = rng.permutation(len(pieces))
    sequences = [[pieces[i] for i in order[k : k + 4]] for k in range(0, len(order), 4)]
    flat = [(np.concatenate([ids for _, ids in s]), np.concatenate([np.full(len(ids), l) for l, ids in s])) for s in sequences]
    flat.sort(key=lambda x: -len(x[0]))
    lengths = np.array([len(x) for x, _ in flat])
    words, gold = np.zeros((len(flat), lengths[0]), np.int64), np.zeros((len(flat), lengths[0]), np.int64)
    for k, (x, y) in enumerate(flat):
        words[k, : len(x)], gold[k, : len(x)] = x, y
    inside = np.arange(lengths[0])[None] < lengths[:, None]
    known: dict[str, int] = {}
    found = [[known.setdefault(f, len(known)) for f in features(w)] for w in number]
    table = len(known)
    sizes = np.array(list(map(len, found)))
    idx = np.concatenate([np.array(f) for f in found])
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    weights, trans, start = np.zeros((table, n), np.float32), np.zeros((n, n)), np.zeros(n)
    square = [np.full_like(x, 1e-2) for x in (weights, trans, start)]
    true = np.zeros((len(number), n), np.float32)
    np.add.at(true, (words[inside], gold[inside]), 1)
    true_trans = np.zeros((n, n))
    both = inside[:, 1:]
    np.add.at(true_trans, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    true_start = np.bincount(gold[:, 0], minlength=n)
    total = inside.sum()
    for _ in range(epochs):
        emission = np.add.reduceat(weights[idx], firsts)
        scores = emission[words]
        scores -= scores.max(2, keepdims=True)
        gamma, pairs, first = forward_backward(scores, lengths, trans, start, True)
        expected = np.stack([np.bincount(words[inside], gamma[..., l][inside], len(number)) for l in range(n)], 1)
        by_word = np.repeat(((true - expected) / total * 1000).astype(np.float32), sizes, 0)
        grads = [np.stack([np.bincount(idx, by_word[:, l], table) for l in range(n)], 1) - 1e-3 * weights, (true_trans - pairs) / total * 1000, (true_start - first) / len(flat)]
        for w, g, s in zip((weights, trans, start), grads, square, strict=True):
            s += g * g
            w += 0.3 * g / np.sqrt(s)
    weights = np.concatenate([weights, np.zeros((1, n))])
    return Model(labels, known, weights.astype(np.float32), trans.astype(np.float32), start.astype(np.float32))


class Labeller:
    """A model with its memo of emissions; used inside a worker."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.reset()

    def reset(self) -> None:
        #: Words by number, in that order; those from ``done`` on have no emission yet.
        self.rows: dict[str, int] = defaultdict(count().__next__)
        self.done, self.emission = 0, np.zeros((1024, len(self.model.labels)), np.float32)

    def words(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Label probabilities of each word, for each list of words."""
        return [g if len(g) else None for lengths, gamma in self._passes(texts) for g in np.split(gamma, np.cumsum(lengths)[:-1])]

    def texts(self, texts: Iterable[str | None]) -> list[tuple[str, float, float]]:
        """(label, score, confidence) of each text."""
        cut = (_words(t) if t else [] for t in texts)
        cut = (ws if ws and any(w.strip("-").isalpha() for w in ws) else [] for ws in cut)
        out: list[tuple[str, float, float]] = []
        for lengths, gamma in self._passes(cut):
            some = np.flatnonzero(lengths)
            n, found = lengths[some], [("und", 0.0, 0.0)] * len(lengths)
            if len(some):
                firsts = np.cumsum(n) - n
                sums = np.add.reduceat(gamma, firsts, dtype=np.float64) / n[:, None]
                sure = np.add.reduceat(gamma.max(1), firsts, dtype=np.float64) / n
                for k, label, score, confidence in zip(some.tolist(), sums.argmax(1).tolist(), np.clip(sums.max(1), 0, 1).tolist(), np.clip(sure, 0, 1).tolist(), strict=True):
                    found[k] = self.model.labels[label], score, confidence
            out += found
        return out

    def _passes(self, cut: Iterable[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The numbers of words of successive texts, and the label probabilities of all their words in a row."""
        labels, held, total = len(self.model.labels), [], 0
        for ws in cut:
            held.append(np.fromiter(map(self.rows.__getitem__, ws), np.int64, len(ws)) if labels else np.zeros(0, np.int64))
            total += len(held[-1])
            if total * labels >= CELLS:
                yield self._pass(held)
                held, total = [], 0
                if len(self.rows) > MEMO:
                    self.reset()
        if held:
            yield self._pass(held)
        if len(self.rows) > MEMO:
            self.reset()

    def _pass(self, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        while len(self.rows) > len(self.emission):
            self.emission = np.concatenate([self.emission, np.zeros_like(self.emission)])
        if new := list(islice(self.rows, self.done, None)):
            e = self.model.emissions(new)
            self.emission[self.done : len(self.rows)] = np.exp(np.maximum(e - e.max(1, keepdims=True), -30))
            self.done = len(self.rows)
        lengths, ids = np.fromiter(map(len, held), np.int64, len(held)), np.concatenate(held)
        gamma = np.zeros((len(ids), len(self.model.labels)), np.float32)
        if len(ids):
            gamma = probabilities(self.emission.take(ids, 0), lengths[lengths > 0], self.model.trans, self.model.start)
        return lengths, gamma


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves 1 when divided by 3 (null ids: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Fit on labelled rows that aren't held out, ``chars`` characters of each: that bounds what the driver gets.

    Every label has the same part of ``rows``, ``LEAST_OF_LABEL`` at least, so that a rare one is learned, too; of copies of
    a text one counts. The ``LABELS`` most frequent labels are learned.
    """
    n = F.char_length(text)
    piece = F.substring(F.col(text), (1 + F.pmod(F.xxhash64(F.lit("at"), text), F.greatest(n - chars, F.lit(1)))).cast("int"), F.lit(chars))
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(id_col)).select(F.col(lang).alias("l"), F.xxhash64(lang, text).alias("h"), piece.alias("t"))
    labels = known.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("texts")).orderBy(F.desc("n"), "l").limit(LABELS).collect()
    if not labels:
        return Model([], {}, np.zeros((1, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    quota = max(LEAST_OF_LABEL, rows // len(labels))
    # least hashes, and some more than wanted, so that tasks don't send much more than is kept
    share = F.create_map(*[F.lit(x) for r in labels for x in (r.l, min(1 << 31, (3 * quota << 30) // max(1, r.texts) + 1))])
    sample = known.where(F.pmod("h", F.lit(1 << 31)) < share[F.col("l")]).groupBy("l", "h").agg(F.min("t").alias("t"))
    pieces: dict[str, list] = {}
    for r in sorted(sample.collect(), key=lambda r: (r.l, r.h % (1 << 31), r.h)):
        if len(held := pieces.setdefault(r.l, [])) < quota and (ws := _words(r.t)[1:-1] or _words(r.t)):
            held.append((r.l, ws))
    found = [x for held in pieces.values() for x in held]
    return fit(found) if found else Model([], {}, np.zeros((1, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (the id alone if None) with lang_pred, score and confidence of every row."""
    spark = docs.sparkSession
    shared, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    keep = [id_col] if keep is None else keep
    names = [f"__k{k}" for k in range(len(keep))]
    source = docs.select(F.col(text).alias("__text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)])
    out = source.drop("__text").withColumns({"__lang": F.lit("").cast("string"), "__score": F.lit(0.0), "__confidence": F.lit(0.0)}).schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        labeller = sole(("language", key), lambda: Labeller(shared.value))
        schema = to_arrow_schema(out)
        for b in batches:
            found = labeller.texts(chain.from_iterable(b.column(0).slice(k, 500).to_pylist() for k in range(0, b.num_rows, 500)))
            extra = [pa.array([x[0] for x in found], pa.string()), *[pa.array([x[k] for x in found], pa.float64()) for k in (1, 2)]]
            yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(b.columns[1:], schema, strict=False)], *extra], schema=schema)

    done = source.transform(arrow, run, out)
    return done.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__confidence").alias("confidence"))
