"""Byte-pair encoding, exactly as the public tokenizer files define it.

``Rules`` reads a tokenizer file: vocabulary, merges, special tokens, normalisation and word pattern.
``Encoder`` encodes texts by words: each distinct word is merged once and remembered in a bounded memo.
Texts of plain characters are cut here; what else Unicode has is cut by the tokenizers library's own normaliser and
pre-tokeniser, so that every code point is of the class that it has there.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cache, cached_property

import numpy as np

from .common import sole

#: Unicode white space, as a character class (the pattern's \s).
SPACE = "\t-\r \x85\xa0  -     　"
#: Characters whose class (letter, number, space, other) the standard library's \w and \d tell rightly, and that NFC keeps.
PLAIN = re.compile("[^\t-\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧]")
#: The letters among plain characters and what they become in lower case; their only digits are 0 to 9.
LETTERS = "A-Za-z\xaa\xb5\xbaÀ-ÖØ-öø-ʯⱥⱦ"
#: Bytes of a word at most that is merged together with others (63 places are told apart), and such words at a time.
SHORT, ABREAST = 60, 8192
#: Words that a worker remembers at most, in two generations.
MEMO = 600_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in shown else chr(spare)
        spare += b not in shown
    return out


class Rules:
    """One tokenizer file. ``words(text)`` gives the words that are merged apart; ``merge(word)`` their ids."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path = path
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.end = model["end_of_word_suffix"] or ""
        self.lower = spec["normalizer"] is not None
        self.size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.chars = byte_chars()
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.pairs.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.ranks = {p: rank << 20 | new for p, (rank, new) in self.pairs.items()}
        self.first = [self.vocab.get(c) for c in self.chars]
        self.last = [self.vocab.get(c + self.end) for c in self.chars]
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        cut = "'(?:s|t|re|ve|m|ll|d)"
        if self.lower:
            self._plain = re.compile(rf"{cut}|[{LETTERS}]+|[0-9]|[^{SPACE}{LETTERS}0-9]+").findall
        else:
            self._plain = re.compile(rf" ?[{LETTERS}]+|{cut}| ?[0-9]+| ?[^{SPACE}{LETTERS}0-9]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall

    def parts(self, text: str) -> list[str]:
        """The text cut at special tokens, which stay as parts of their own at odd places."""
        return self._split.split(text) if self._split and "<|" in text else [text]

    def words(self, text: str) -> list[str]:
        if PLAIN.search(text):
            cut = _library(self.path)
            if self.lower:
                text = cut.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in cut.pre_tokenizer.pre_tokenize_str(text)]
        return self._plain(text.lower() if self.lower else text)

    def merge(self, word: str) -> bytes:
        """Merge by rank, the leftmost first; ids as little-endian unsigned 32-bit integers."""
        data = word.encode()
        ids = [self.first[b] for b in data]
        if data and self.end:
            ids[-1] = self.last[data[-1]]
        ids = [i for i in ids if i is not None]
        get, none = self.ranks.get, 1 << 62
        found = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while found and (best := min(found)) < none:
            k = found.index(best)
            ids[k : k + 2] = [best & 0xFFFFF]
            del found[k]
            if k:
                found[k - 1] = get((ids[k - 1], ids[k]), none)
            if k < len(found):
                found[k] = get((ids[k], ids[k + 1]), none)
        return array("I", ids).tobytes()

    def merge_long(self, word: str) -> bytes:
        """The same for words of many bytes: a heap of pairs over a linked list, n log n."""
        import heapq

        data = word.encode()
        ids = [self.first[b] for b in data]
        if data and self.end:
            ids[-1] = self.last[data[-1]]
        ids = [i for i in ids if i is not None]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(f[0], k, ids[k], ids[k + 1]) for k in range(n - 1) if (f := self.pairs.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k] if alive[k] else n
            if j >= n or ids[k] != a or ids[j] != b:
                continue
            ids[k] = self.pairs[a, b][1]
            alive[j] = False
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if f := self.pairs.get((ids[k], ids[after[k]])):
                    heapq.heappush(heap, (f[0], k, ids[k], ids[after[k]]))
            if before[k] >= 0 and (f := self.pairs.get((ids[before[k]], ids[k]))):
                heapq.heappush(heap, (f[0], before[k], ids[before[k]], ids[k]))
        return array("I", [i for i, live in zip(ids, alive, strict=True) if live]).tobytes()

    @cached_property
    def _arrays(self):
        """Pairs by their codes with ranks, the new id of each rank, ids of bytes, and ranks of pairs of bytes; the rank 1 << 24 stands for none."""
        base, found = self.size + 1, sorted((a * (self.size + 1) + b, rank) for (a, b), (rank, _) in self.pairs.items())
        codes, ranks = (np.array(x, np.int64) for x in zip(*[*found, (1 << 62, 1 << 24)], strict=True))
        new = np.zeros(max((r for r, _ in self.pairs.values()), default=0) + 1, np.int32)
        for rank, made in self.pairs.values():
            new[rank] = made
        first = np.array(self.first, np.int32)
        ids = np.repeat(first.astype(np.int64), 256) * base + np.tile(first, 256)
        at = np.searchsorted(codes, ids)
        return codes, ranks, new, first, np.where(codes[at] == ids, ranks[at], 1 << 24)

    def merge_many(self, words: list[str]) -> list[bytes]:
        """What ``merge`` gives for each word: in each step all words make their own next merge."""
        if self.end or None in self.first:
            return [self.merge(w) if len(w) < 48 else self.merge_long(w) for w in words]
        data = [w.encode() for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        order = np.argsort(sizes, kind="stable")
        short = int(np.searchsorted(sizes[order], SHORT, side="right"))
        out: list = [b""] * len(words)
        for k in order[short:].tolist():
            out[k] = self.merge_long(words[k])
        for low in range(0, short, ABREAST):
            some = order[low : min(low + ABREAST, short)]
            for k, ids in zip(some.tolist(), self._abreast([data[k] for k in some.tolist()], sizes[some]), strict=True):
                out[k] = ids
        return out

    def _abreast(self, data: list[bytes], sizes: np.ndarray) -> list[bytes]:
        codes, ranks, made, first, byte_pairs = self._arrays
        n, height, none = len(data), int(sizes.max(initial=0)) + 2, 1 << 30
        # a column for each word; a row for each byte, with an empty row above and below
        row, col = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1, np.repeat(np.arange(n), sizes)
        raw = np.frombuffer(b"".join(data), np.uint8)
        ids = np.full((height, n), self.size, np.int32)
        ids[row, col] = first[raw]
        # the smallest key of a column is the leftmost pair of the least rank
        keys = np.full((height, n), none, np.int64)
        inner = np.flatnonzero(row < sizes[col])
        rank = byte_pairs[raw[inner].astype(np.int64) << 8 | raw[inner + 1]]
        keys[row[inner], col[inner]] = rank << 6 | row[inner]
        cells = np.arange(height * n).reshape(height, n)
        after, before = (cells + n).ravel(), (cells - n).ravel()
        ids, flat = ids.ravel(), keys.ravel()
        while True:
            best = keys.min(0)
            at = np.flatnonzero(best < none)
            if not len(at):
                break
            best = best[at]
            i = (best & 63) * n + at
            j, p = after[i], before[i]
            k, new = after[j], made[best >> 6]
            ids[i], ids[j], flat[j] = new, -1, none
            after[i], before[k] = k, i
            left = np.concatenate([i, p])
            pair = ids[left].astype(np.int64) * (self.size + 1) + np.concatenate([ids[k], new])
            where = np.searchsorted(codes, pair)
            flat[left] = np.where(codes[where] == pair, ranks[where] << 6 | left // n, none)
        kept = ids.reshape(height, n)[1:-1].T
        live = (kept >= 0) & (kept < self.size)
        ends = (4 * np.cumsum(live.sum(1))).tolist()
        block = kept[live].astype("<u4").tobytes()
        return [block[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id (of byte-level vocabularies without word ends)."""
        back = {c: b for b, c in enumerate(self.chars)}
        out = [b""] * self.size
        for s, i in [*self.vocab.items(), *self.special.items()]:
            out[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        return out


@cache
def _library(path: str):
    """The tokenizers library's reading of the file: its tables say what is a letter, a number, white space and lower case."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def rules(path: str) -> Rules:
    """One copy for each process."""
    return Rules(path)


class _Memo(dict):
    """Words and their ids. When the young generation is full it becomes the old one, from which words found again return."""

    def __init__(self, look, bound: int) -> None:
        super().__init__()
        self.look, self.bound, self.old = look, bound // 2, {}

    def fill(self, words: list[str], look) -> None:
        """Remember words that aren't, with what ``look`` gives for all of them together."""
        new = [w for w in words if len(w) < 64 and w not in self and w not in self.old]
        for w, v in zip(new, look(new), strict=True):
            self._keep(w, v)

    def __missing__(self, word: str) -> bytes:
        v = self.old.pop(word, None)
        if v is None:
            v = self.look(word)
        self._keep(word, v)
        return v

    def _keep(self, word: str, v: bytes) -> None:
        if len(word) < 64:
            if len(self) >= self.bound:
                self.old = self.copy()
                self.clear()
            self[word] = v


class Encoder:
    """Texts to ids. ``unseen(word)`` must give a word's ids, if not merged here."""

    def __init__(self, spec: Rules, unseen=None, bound: int = MEMO) -> None:
        self.rules = spec
        self.memo = _Memo(unseen or (lambda w: spec.merge(w) if len(w) < 48 else spec.merge_long(w)), bound)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" not in text:
            return b"".join(map(self.memo.__getitem__, self.rules.words(text)))
        out = []
        for k, part in enumerate(self.rules.parts(text)):
            out.append(self.rules.special[part].to_bytes(4, "little") if k % 2 else b"".join(map(self.memo.__getitem__, self.rules.words(part))))
        return b"".join(out)


def library_unseen(path: str):
    """Ids of one word by the tokenizers library's own BPE model."""
    model, chars = _library(path).model, byte_chars()

    def look(word: str) -> bytes:
        shown = word if word.isascii() and word.isalpha() else "".join([chars[b] for b in word.encode()])
        return array("I", [t.id for t in model.tokenize(shown)]).tobytes()

    return look


def library_encoder(path: str) -> Encoder:
    """Words cut by this module, each distinct word merged by the tokenizers library; one copy for each process."""
    return sole(("library", path), lambda: Encoder(rules(path), unseen=library_unseen(path)))
