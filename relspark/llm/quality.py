"""Operator 8: quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` evaluates every rule once and stores, for each document, the measurements and a 64-bit mask of the rules it
fails. Policies are versioned sets of rules: applying one is a bitwise AND with its mask, no text is read again.
``ablation`` tells, from counts by mask, how many documents each rule rejects, and rejects alone.

Defined cases: a null text has no words, and so fails the rule of least words; repeated and null ids stay as they are;
very long texts are measured whole, in time n log n; an empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rules in the order of their bits: (name, expression over the measurements that is true where the rule fails).
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines AND n_dup_lines > 2"),
    ("short_or_long_words", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("few_distinct_words", "5 * n_distinct_words < n_words"),
    ("few_letters", "10 * n_letters < 6 * word_chars"),
]
#: Versions of policies: the rules that reject.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "many_symbols"],
    "v2": [name for name, _ in RULES],
}
CURRENT = "v2"
#: few_distinct_words compares a text's vocabulary, which grows slower than the text, so it fails long clean texts by length
#: alone. Where documents are kept or rejected, its place is taken by the same share over windows of so many words.
SCALE = 1000
FEW_IN_WINDOWS = "5 * n_window_words < n_words"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(hashes: Column) -> Column:
    """Words that lie in a window of 8 words found twice or more; ``hashes``: a hash for each word, in order."""

    def covered(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda k, j: F.coalesce(F.get(s, k)["x"] == F.get(s, j)["x"], F.lit(False))
            marked = F.filter(F.transform(s, lambda e, k: F.when(same(k, k - 1) | same(k, k + 1), e["i"])), lambda p: p.isNotNull())
            first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            return F.aggregate(F.array_sort(marked), first, lambda a, p: F.struct((a["n"] + p + WORDS - F.greatest(p, a["end"])).alias("n"), (p + WORDS).alias("end")), lambda a: a["n"])

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, twice))

    def of(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - WORDS)
        windows = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)]))
        return F.when(F.size(h) > WORDS, let(windows, covered)).otherwise(F.lit(0))

    return let(hashes, of)


def measured(text: Column) -> Column:
    """The measurements of a text as a struct of longs."""
    body = F.coalesce(text, F.lit(""))
    long = lambda c: c.cast("long")

    def of_words(words: Column) -> list[Column]:
        return [
            long(F.size(words)).alias("n_words"),
            long(repeated_words(F.transform(words, lambda w: F.xxhash64(w)))).alias("n_repeat_words"),
            long(F.size(F.array_distinct(words))).alias("n_distinct_words"),
            F.when(F.size(words) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(SCALE)), F.lit(0).cast("long"), lambda n, k: n + F.size(F.array_distinct(F.slice(words, k, F.lit(SCALE)))))).otherwise(F.lit(0).cast("long")).alias("n_window_words"),
        ]

    words = F.filter(F.split(body, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda s: F.translate(s, SPACE, "") != "")
    dense = F.translate(body, SPACE, "")
    plain = [
        long(F.char_length(dense)).alias("word_chars"),
        long(F.char_length(dense) - F.char_length(F.translate(dense, SYMBOLS, ""))).alias("n_symbols"),
        long(F.char_length(F.regexp_replace(dense, "[^\\p{L}]+", ""))).alias("n_letters"),
    ]
    of_lines = lambda s: F.struct(long(F.size(s) - F.size(F.array_distinct(s))).alias("n_dup_lines"), long(F.size(s)).alias("n_lines"))
    return F.struct(let(words, lambda w: F.struct(*of_words(w))).alias("w"), let(lines, of_lines).alias("l"), *plain)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_window_words", "n_letters"]


def mask(rules: list[str]) -> int:
    """The bits of the named rules."""
    names = [n for n, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all if None) as ``doc``, the measurements, and ``failed``: bit k is set where rule k fails."""
    keep = docs.columns if keep is None else keep
    at = {"n_words": "w", "n_repeat_words": "w", "n_distinct_words": "w", "n_window_words": "w", "n_dup_lines": "l", "n_lines": "l"}
    doc = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc")
    rows = docs.select(doc, measured(F.col(f"`{text}`")).alias("m")).select("doc", *[(F.col(f"m.{at[c]}.{c}") if c in at else F.col(f"m.{c}")).alias(c) for c in MEASURES])
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return rows.withColumn("failed", failed)


def passes(policy: str = CURRENT) -> Column:
    """Whether a ledger row passes the policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def accepted(policy: str = CURRENT) -> Column:
    """Whether a ledger row passes the policy with few_distinct_words, if it is a rule of it, judged by windows of ``SCALE`` words."""
    rules = POLICIES[policy]
    rest = F.col("failed").bitwiseAND(F.lit(mask([r for r in rules if r != "few_distinct_words"])).cast("long")) == 0
    return rest & ~F.expr(FEW_IN_WINDOWS) if "few_distinct_words" in rules else rest


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents it rejects, and those that no other of its rules rejects.

    Rows are first counted by mask (at most 2^rules groups), so the ledger is read once.
    """
    counted = rows.select(F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")).alias("bits")).groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    sums = []
    for k, name in ((k, n) for k, (n, _) in enumerate(RULES) if n in POLICIES[policy]):
        bit = F.lit(1 << k).cast("long")
        sums.append(F.struct(F.lit(name).alias("rule"), F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("n"))), F.lit(0)).alias("rejects"), F.coalesce(F.sum(F.when(F.col("bits") == bit, F.col("n"))), F.lit(0)).alias("rejects_alone")))
    return counted.agg(F.array(*sums).alias("a")).select(F.inline("a"))
