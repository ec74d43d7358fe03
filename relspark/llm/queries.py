"""The queries of the training-data operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplane, jaccard, langid, media, packing, pii, quality, template, transducer, urls

#: Rules of op4: (verdict, host, path).
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Hosts that op4 blocks where no rule fits.
BLOCKED_HOSTS = [f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file; tokenizers are a parameter everywhere else."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_template_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = template.extract(_table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_info_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find(_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    return rows.select("doc_id", *map(count, range(4)), F.sha2(pii.spelled(F.col("base")), 256).alias("base_sha256"), pii.spelled(F.col("spans")).alias("spans"))


def op3_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.digests(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_digest_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES, BLOCKED_HOSTS)


def op5_dp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), with_ids=False)


def op6_media_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media_columns(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature", "media_width", "media_height")


def op7_crf_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = quality.passes("base")
    return rows.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~base).alias("base_failed"), (base & quality.passes()).alias("kept"), "failed")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op10_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.round_trip(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_template_extract, op2_info_sanitise, op3_transducer_bpe, op4_digest_url_filter, op5_dp_packing, op6_media_shards, op7_crf_langid, op8_rule_ledger, op9_jaccard_join, op10_bitplane_ids, pipeline]
    return {f.__name__: f for f in ops}


_HOSTS = ", ".join(f"'{h}'" for h in BLOCKED_HOSTS)
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for v, h, p in URL_RULES)

OP4_SQL = f"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES {_RULE_ROWS}),
fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN EXISTS (SELECT 1 FROM (SELECT unnest([{_HOSTS}]) AS b) WHERE host = b OR ends_with(host, '.' || b)) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits USING (page_id)
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS ls FROM d),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS g FROM w, unnest(range(1, len(ws) - 6)) AS t(i) WHERE len(ws) >= 8),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 8)) AS u(k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(list_distinct(ws)) AS BIGINT) AS n_distinct_words,
         CAST(length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS BIGINT) AS n_letters
  FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CAST(""" + " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, (_, rule) in enumerate(quality.RULES)) + rf""" AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (failed & {quality.mask(quality.POLICIES[quality.CURRENT])}) = 0 AS kept, failed FROM f
"""  # noqa: S608


def oracle_sql() -> dict[str, str]:
    return {"op4_digest_url_filter": OP4_SQL, "op8_rule_ledger": OP8_SQL}
