"""Operator 4: URL rules in a sorted array of 64-bit digests.

A rule is a host and a path: it fits its host and all subdomains of it where the URL's path starts with the rule's. The
rules come from a list or a table of any size. Their strings are hashed by xxhash and sorted; the array, with the strings
themselves, goes to every executor as one file, which its workers map. Beside its rules, the array has an entry for each
host, which leads to the lengths of its rules' paths. For a batch of URLs, the host suffixes of as many labels as some rule's
host has are searched first, all at once by binary search; then, for the hosts found, the path prefixes of their lengths.
Each hit is confirmed by comparing the stored string, so a collision cannot decide. The longest fitting rule wins (of equal
length, the one with the longer host). URLs that no rule fits are judged by the list of hosts, kept in the same array as
rules with an empty path; else they are allowed.

A table of rules of more than ``LIMIT`` characters isn't brought to the driver: it is joined with the distinct keys of the
URLs instead. Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is allowed; a
host of very many labels costs no more than one of as many as the rules' longest; an empty table, or one without rules,
gives a result of as many rows; of rules that repeat a host and path the last verdict in order of the alphabet counts;
ids may be null or repeated.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, batch, mapped, rows_of, share

#: Characters of rules that are compiled into one array.
LIMIT = 1 << 29
_SPLIT = re.compile(r"(?s).*?://([^/?#]*)([^?#]*)")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)
_digest = xxhash.xxh64_intdigest


def host_and_path(url: str | None) -> tuple[str, str]:
    m = _SPLIT.match(url) if url else None
    return (m[1].translate(_FOLD), m[2]) if m else ("", "")


def suffixes(host: str, counts: list[int]) -> list[str]:
    """The ends of a host of so many labels (``counts`` in ascending order)."""
    if not host or not counts:
        return []
    labels = host.rsplit(".", counts[-1])
    return [".".join(labels[-k:]) for k in counts if k <= len(labels)]


def compile_rules(rules: list[tuple[str, str, str]], blocked_hosts: list[str] = ()) -> bytes:
    """(verdict, host, path) rules and listed hosts as one block of memory.

    After a head: digests, ends of strings, values, strings. An entry is a rule, its string being host, line feed, path and
    its value 0 (allow), 1 (block) or 2 (a listed host), or a host, its value being the place of its path lengths in the head.
    """
    entries = {f"{h}\n": 2 for h in blocked_hosts}
    entries |= {f"{h}\n{p}": int(verdict == "block") for verdict, h, p in sorted(rules)}
    hosts: dict[str, set[int]] = {}
    for key in entries:
        host, path = key.split("\n", 1)
        hosts.setdefault(host, set()).add(len(path))
    kinds = sorted({tuple(sorted(n)) for n in hosts.values()})
    place = {n: k for k, n in enumerate(kinds)}
    entries |= {h: place[tuple(sorted(n))] for h, n in hosts.items()}
    texts = [k.encode() for k in entries]
    keys = np.fromiter(map(_digest, texts), "<u8", len(texts))
    order = np.argsort(keys, kind="stable")
    texts = [texts[k] for k in order.tolist()]
    head = json.dumps({"n": len(texts), "labels": sorted({h.count(".") + 1 for h in hosts}), "lengths": kinds}).encode()
    head += b" " * (-len(head) % 8)
    values = np.fromiter(entries.values(), "<u4", len(texts))[order]
    return b"".join([struct.pack("<Q", len(head)), head, keys[order].tobytes(), np.cumsum([0, *map(len, texts)]).astype("<u8").tobytes(), values.tobytes(), *texts])


class DigestRules:
    """The array over mapped memory."""

    def __init__(self, memory) -> None:
        (size,) = struct.unpack_from("<Q", memory)
        info = json.loads(bytes(memory[8 : 8 + size]))
        self.n, self.labels, self.lengths = info["n"], info["labels"], info["lengths"]
        at = 8 + size
        self.keys = np.frombuffer(memory, "<u8", self.n, at)
        self.ends = np.frombuffer(memory, "<u8", self.n + 1, at + 8 * self.n)
        self.values = np.frombuffer(memory, "<u4", self.n, at + 16 * self.n + 8)
        self.texts = memoryview(memory)[at + 20 * self.n + 8 :]

    def find(self, strings: list[str]) -> list[tuple[int, int]]:
        """(place in ``strings``, value) of those that the array holds."""
        if not strings or not self.n:
            return []
        wanted = np.fromiter(map(_digest, strings), "<u8", len(strings))
        at = np.minimum(np.searchsorted(self.keys, wanted), self.n - 1)
        found = []
        for j in np.flatnonzero(self.keys[at] == wanted).tolist():
            text, i = strings[j].encode(), int(at[j])
            while i < self.n and self.keys[i] == wanted[j]:
                if self.texts[int(self.ends[i]) : int(self.ends[i + 1])] == text:
                    found.append((j, int(self.values[i])))
                i += 1
        return found

    def judge(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str]]:
        """(host, path, rule or None, verdict) for each URL of a batch."""
        parts = [host_and_path(u) for u in urls]
        ends = [(k, s) for k, (host, _) in enumerate(parts) for s in suffixes(host, self.labels)]
        keys = []
        for j, place in self.find([s for _, s in ends]):
            k, s = ends[j]
            path = parts[k][1]
            keys += [(k, s, path[:n]) for n in self.lengths[place] if n <= len(path)]
        best: dict[int, tuple] = {}
        for j, value in self.find([f"{s}\n{p}" for _, s, p in keys]):
            k, s, p = keys[j]
            score = (value < 2, len(s) + len(p), len(s), s + p, value)
            best[k] = max(best.get(k, score), score)
        return [(h, p, (b[3] if b[0] else None), "block" if b[4] else "allow") if (b := best.get(k)) else (h, p, None, "allow") for k, (h, p) in enumerate(parts)]


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, blocked_hosts: list[str] = (), id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict) of every row. ``rules`` are (verdict, host, path), as a list or a table with these columns."""
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    if isinstance(rules, DataFrame):
        rules = rules.select("verdict", "host", "path").dropna()
        size = rules.agg(F.sum(F.length("host") + F.length("path") + 20)).first()[0] or 0
        if size > LIMIT:
            return by_join(pages, rules, blocked_hosts, id_col, url)
        columns = rules.toArrow().to_pydict()
        rules = list(zip(columns["verdict"], columns["host"], columns["path"], strict=True))
    name = share(spark, compile_rules(rules, blocked_hosts))
    out = spark.createDataFrame([], f"`{id_col}` {kind}, host string, path string, rule string, verdict string").schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        found, schema = DigestRules(mapped(name)), pa.schema(to_arrow_schema(out))
        for ids, urls in rows_of(batches):
            yield batch(schema, [(i, *v) for i, v in zip(ids, found.judge(urls), strict=True)])

    return pages.select(id_col, url).transform(arrow, run, out)


def by_join(pages: DataFrame, rules: DataFrame, blocked_hosts: list[str], id_col: str, url: str) -> DataFrame:
    """The same by joins, for rules that no executor can hold: distinct host suffixes meet the hosts that have rules, and
    what is left of the distinct URLs meets the rules."""
    spark = pages.sparkSession
    listed = spark.createDataFrame([(h, "", 2) for h in blocked_hosts], "host string, path string, value int")
    value = F.when(F.col("verdict") == "block", 1).otherwise(0)
    table = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select("host", "path", value.alias("value"))
    table = table.unionByName(listed).groupBy("host", "path").agg(F.min("value").alias("value"))
    lengths = table.groupBy("host").agg(F.collect_set(F.char_length("path")).alias("lengths"))
    counts = [r[0] for r in table.select(F.size(F.split("host", "\\."))).distinct().limit(256).collect()]
    cut = lambda k: F.coalesce(F.regexp_extract(F.col(url), r"(?s)\A.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    rows = pages.select(id_col, F.translate(cut(1), _UPPER, _LOWER).alias("host"), cut(2).alias("path"))
    labels = F.split("host", "\\.")
    end = lambda k: F.when(F.size(labels) >= k, F.array_join(F.slice(labels, -k, k), "."))
    ends = F.array_compact(F.array(*[end(k) for k in sorted(counts)])) if counts else F.array().cast("array<string>")
    whole = rows.where("host != ''").select("host", "path").distinct()
    met = whole.select("host", "path", F.explode(ends).alias("end")).join(lengths.withColumnRenamed("host", "end"), "end")
    keys = met.select("host", "path", "end", F.explode("lengths").alias("n")).where(F.col("n") <= F.char_length("path"))
    keys = keys.withColumn("start", F.expr("substring(path, 1, n)"))
    hits = keys.join(table.select(F.col("host").alias("end"), F.col("path").alias("start"), "value"), ["end", "start"])
    score = F.struct((F.col("value") < 2).alias("named"), F.char_length(F.concat("end", "start")).alias("size"), F.char_length("end").alias("own"), F.concat("end", "start").alias("rule"), "value")
    best = hits.groupBy("host", "path").agg(F.max(score).alias("best"))
    verdict = F.when(F.col("best.value") > 0, "block").otherwise("allow")
    found = rows.join(best, ["host", "path"], "left")
    return found.select(id_col, "host", "path", F.when(F.col("best.named"), F.col("best.rule")).alias("rule"), verdict.alias("verdict"))
