"""Operator 2: personal data and information-theoretic sanitisation, in DataFrame functions only.

Patterns find the base spans of each whole text: mail addresses, IP addresses, card and phone numbers. Each is a
mention of a protected entity. All words of a text outside its base spans are terms that may disclose its entities. Over the
whole corpus, with N texts, df(e) and df(t) texts with the entity and the term and j texts with both, the term reveals
log2(N j / (df(e) df(t))) bits of the entity's log2(N / df(e)); where that share reaches ``DISCLOSES`` and the term is seen
between different words (``NEAR`` on each side) in two or more of these texts, so that copies tell nothing, all the term's
mentions in the texts with the entity are spans as well, and sanitising generalises them (terms with digits) or removes them.

Only texts with base spans are stored; of those, texts with an entity of two or more texts are cut into terms. Defined cases: a null or empty text has no spans; repeated and null
ids stay as they are; overlapping spans are replaced as one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

KINDS = ["email", "ip", "card", "phone", "term"]
#: Java patterns. Possessive loops and the look-behinds keep each search linear and find what the plain patterns find:
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), [0-9]([\x20-]?[0-9])+,
#: \+[0-9][\x20().0-9-]+[0-9].
PATTERNS = [
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
#: What a text must hold for a pattern to be worth running.
HINTS = ["@[A-Za-z0-9-]", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "[0-9][0-9 -]{14}", r"\+[0-9]"]
NEAR, DISCLOSES, CONTEXTS = 5, 0.8, 2
TERM = "[\\p{L}\\p{N}'-]+"
SPACES = "\t\n\x0b\x0c\r"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.filter(each, lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v) % 10 == 0


def _holds(kind: int, s: Column) -> Column:
    n = F.length(_digits(s))
    if kind == 1:
        return s.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)){3}$")
    if kind == 2:
        return F.when(n.between(16, 19), _luhn(_digits(s))).otherwise(F.lit(False))
    if kind == 3:
        return n.between(8, 15)
    return F.lit(True)


def _entity(kind: int, s: Column) -> Column:
    return F.concat(F.lit(KINDS[kind] + ":"), F.lower(s) if kind < 2 else _digits(s))


SPAN = "struct<kind:int,start:int,end:int>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column, step) -> Column:
    """For each number of an array what ``step`` (a sum or a maximum) makes of 0 and all before it.

    An array grows by copying, so the numbers are taken in blocks of about the square root of their count: n * sqrt(n).
    """

    def grown(block: Column) -> Column:
        first = F.struct(F.array().cast("array<int>").alias("a"), F.lit(0).alias("at"))
        return F.aggregate(block, first, lambda s, v: F.struct(F.concat(s["a"], F.array(s["at"])).alias("a"), step(s["at"], v).cast("int").alias("at")))

    def whole(width: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(values) - 1, width), lambda k: grown(F.slice(values, k + 1, width)))

        def joined(b: Column) -> Column:
            moved = lambda x, low: F.transform(x["a"], lambda v: step(low, v).cast("int"))
            return _let(grown(F.transform(b, lambda x: x["at"]))["a"], lambda before: F.flatten(F.transform(b, lambda x, k: _let(F.get(before, k), lambda low: moved(x, low)))))

        return _let(blocks, joined)

    return F.when(F.size(values) > 0, _let(F.ceil(F.sqrt(F.size(values))).cast("int"), whole)).otherwise(F.array().cast("array<int>"))


def _found(kind: int, text: Column) -> Column:
    """(spans, entities) of one kind: pieces between matches give the places."""
    pattern = PATTERNS[kind]

    def of(cut: Column) -> Column:
        pieces, matches = cut["p"], cut["m"]
        lengths = F.transform(matches, lambda m, i: (F.char_length(F.get(pieces, i)) + F.char_length(m)).cast("int"))

        def located(before: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = (F.get(before, i) + F.char_length(F.get(pieces, i))).cast("int")
                return F.struct(F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.char_length(m)).cast("int").alias("end")).alias("span"), _entity(kind, m).alias("entity"), _holds(kind, m).alias("holds"))

            good = F.filter(F.transform(matches, one), lambda x: x["holds"])
            return _let(good, lambda g: F.struct(F.transform(g, lambda x: x["span"]).alias("spans"), F.array_distinct(F.transform(g, lambda x: x["entity"])).alias("entities")))

        return _let(_let(lengths, lambda n: _scan(n, lambda a, v: a + v)), located)

    cut = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"))
    none = F.struct(F.array().cast(f"array<{SPAN}>").alias("spans"), F.array().cast("array<string>").alias("entities"))
    run = F.get(F.transform(F.filter(F.array(cut), lambda c: F.size(c["m"]) > 0), of), F.lit(0))
    return F.when(text.rlike(HINTS[kind]), F.coalesce(run, none)).otherwise(none)


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns as ``doc``, with ``spans`` (base spans by kind, then start) and ``entities`` (the distinct ones mentioned)."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[_found(k, body).alias(f"k{k}") for k in range(4)])
    return rows.select("doc", F.concat(*[F.col(f"k{k}.spans") for k in range(4)]).alias("spans"), F.concat(*[F.col(f"k{k}.entities") for k in range(4)]).alias("entities"))


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """In how many texts each term stands (term, df), over all texts."""
    words = F.array_distinct(F.split(F.lower(F.col(f"`{text}`")), "[^\\p{L}\\p{N}'-]+"))
    return docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))


def disclosing(found: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(entity, term) pairs whose disclosure reaches the threshold. ``found``: row, entities, blank.

    Terms are reduced to one a text, and terms of too many texts to reach an entity's threshold go, before they are paired.
    """
    n = F.lit(float(docs.count()))
    mentions = found.select("row", F.explode("entities").alias("entity"))
    entities = mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("df_e")).where((F.col("df_e") >= CONTEXTS) & (F.col("df_e") < n))
    mentions = mentions.join(entities, "entity")
    around = lambda w: F.transform(w, lambda t, i: F.struct(t.alias("term"), F.xxhash64(F.slice(w, F.greatest(i - NEAR, F.lit(0)) + 1, F.least(i, F.lit(NEAR)) + 1 + NEAR)).alias("context")))
    words = F.regexp_extract_all(F.lower("blank"), F.lit(TERM), 0)
    terms = found.join(mentions.select("row").distinct(), "row", "left_semi").select("row", F.inline(F.get(F.transform(F.array(words), around), F.lit(0)))).where(F.col("term").rlike("\\p{L}"))
    terms = terms.groupBy("row", "term").agg(F.min("context").alias("context")).join(term_counts(docs, text).where(F.col("df_t") >= CONTEXTS), "term")
    # j is at most df_e: a term of more texts than this can't reach the threshold
    near = terms.join(mentions, "row").where(F.col("df_t") <= 1.000001 * F.pow(n, 1 - DISCLOSES) * F.pow("df_e", F.lit(DISCLOSES)))
    pairs = near.groupBy("entity", "term", "df_e", "df_t").agg(F.count(F.lit(1)).alias("j"), F.min("context").alias("a"), F.max("context").alias("b"))
    pairs = pairs.where((F.col("a") != F.col("b")) & (F.col("j") >= CONTEXTS))
    bits = F.log2(n * F.col("j") / (F.col("df_e") * F.col("df_t")))
    return pairs.where(bits >= DISCLOSES * F.log2(n / F.col("df_e"))).select("entity", "term")


def _extra(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(row, more): the spans of all mentions of each row's disclosing terms."""
    sought = found.select("row", F.explode("entities").alias("entity")).join(pairs, "entity").groupBy("row").agg(F.collect_set("term").alias("sought"))
    cut = F.arrays_zip(F.split("blank", TERM, -1).alias("gap"), F.regexp_extract_all("blank", F.lit(TERM), 0).alias("word"))
    words = found.join(sought, "row").select("row", "sought", F.posexplode(cut).alias("at", "x")).select("row", "sought", "at", "x.gap", "x.word")
    end = F.sum(F.char_length("gap") + F.coalesce(F.char_length("word"), F.lit(0))).over(Window.partitionBy("row").orderBy("at"))
    words = words.withColumn("end", end.cast("int")).where(F.array_contains("sought", F.lower("word")))
    span = F.struct(F.lit(4).alias("kind"), (F.col("end") - F.char_length("word")).cast("int").alias("start"), "end")
    return words.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("more"))


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, base, spans): base spans, and all spans with those of the disclosing terms, by kind, then start."""
    body = F.when(F.size("spans") > 0, blanked(F.col(f"doc.`{text}`"), F.col("spans")))
    rows = detect(docs, text).select(F.col(f"doc.`{id_col}`").alias(id_col), F.monotonically_increasing_id().alias("row"), "spans", "entities", body.alias("blank"))
    rows = stored(rows, "pii-found")
    held = rows.where(F.size("spans") > 0).select("row", "entities", "blank")
    more = _extra(held, disclosing(held, docs, text))
    rows = rows.select(id_col, "row", F.col("spans").alias("base"))
    return rows.join(more, "row", "left").select(id_col, "base", F.concat("base", F.coalesce("more", F.array().cast(f"array<{SPAN}>"))).alias("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def blanked(text: Column, spans: Column) -> Column:
    """The text with blanks in the place of each span."""
    return replaced(text, spans, lambda s, at, word: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(at, s["start"]), F.lit(0))))


def _named(s: Column, at: Column, word: Column) -> Column:
    name = F.when(s["kind"] < 4, F.concat(F.lit("["), F.upper(F.get(F.array(*map(F.lit, KINDS)), s["kind"])), F.lit("]"))).when(word.rlike("[0-9]"), F.lit("[CODE]")).otherwise(F.lit("[TERM]"))
    return F.when(s["start"] >= at, name).otherwise(F.lit(""))


def replaced(text: Column, spans: Column, name=_named) -> Column:
    """The text with each span replaced by what ``name`` gives for it, the end of those before it and its characters; by
    default its kind in brackets, and nothing for one that overlaps with a span before it.

    A string is read from its start to find a place in it, so the text is cut into about as many parts as the square root
    of the spans' count, and the spans of a part are replaced in it: time grows with length * sqrt(spans).
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def whole(ordered: Column) -> Column:
        def placed(before: Column) -> Column:
            """before: where the text of a span begins, the greatest end of all spans before it."""

            def part(k: Column, width: Column) -> Column:
                own, places = F.slice(ordered, k + 1, width), F.slice(before, k + 1, width)
                low = F.get(before, k)
                high = F.get(before, k + width)  # null behind the last span

                def of(chunk: Column) -> Column:
                    def one(s: Column, i: Column) -> Column:
                        at = F.get(places, i)
                        kept = F.substring(chunk, at - low + 1, F.greatest(s["start"] - at, F.lit(0)))
                        return F.concat(kept, name(s, at, F.substring(chunk, s["start"] - low + 1, s["end"] - s["start"])))

                    return F.array_join(F.transform(own, one), "")

                # a span that overlaps with one of an earlier part starts before ``low``; nothing is named for it
                return _let(F.substring(text, low + 1, F.coalesce(high, F.char_length(text)) - low), of)

            def parts(width: Column) -> Column:
                return F.array_join(F.transform(F.sequence(F.lit(0), F.size(ordered) - 1, width), lambda k: part(k, width)), "")

            last = F.greatest(F.element_at(before, -1), F.element_at(ordered, -1)["end"])
            return F.concat(_let(F.ceil(F.sqrt(F.size(ordered))).cast("int"), parts), F.substring(text, last + 1, F.char_length(text)))

        return _let(_let(F.transform(ordered, lambda s: s["end"]), lambda e: _scan(e, F.greatest)), placed)

    return F.when(F.size(spans) > 0, _let(ordered, whole)).otherwise(text)


def sanitise(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with all spans replaced; ``n_chars``, where there is such a column, counts the new text.

    Rows without a mention pass unchanged; only rows with one are stored and joined with their disclosing terms.
    """
    columns = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    found = detect(docs, text)
    clean = found.where(F.size("spans") == 0).select(*columns)
    held = stored(found.where(F.size("spans") > 0).select("doc", F.monotonically_increasing_id().alias("row"), "spans", "entities"), "pii-held")
    found = held.select("row", "entities", blanked(F.col(f"doc.`{text}`"), F.col("spans")).alias("blank"))
    more = _extra(found, disclosing(found, docs, text))
    body = F.col(f"doc.`{text}`")
    done = held.drop("entities").join(more, "row", "left").select("doc", replaced(body, F.concat("spans", F.coalesce("more", F.array().cast(f"array<{SPAN}>")))).alias("__text"))
    new = {text: F.col("__text")}
    if n_chars in docs.columns:
        new[n_chars] = F.char_length("__text").cast(docs.schema[n_chars].dataType)
    return clean.unionByName(done.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns]))
