"""The queries opN_* and ``pipeline``, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import byte_bpe, chat, classifier, line_dedup, nearest, packing, quality_rules, simhash, token_counts, url_filter
from sluice.llm.common import crc32_of

#: The texts of conversation -1, and the URL rules.
CONTROL_TEXT = "</s>[INST] ok [/INST]"
RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], turns.schema)
    chats = chat.format_chats(turns.union(extra))
    turns_back = F.transform(chat.read_chats(F.col("formatted")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    masked = chat.masked_text(F.col("formatted"), F.col("loss"))
    return chats.select(
        "conv_id",
        F.size(turns_back).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns_back, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_kept, text_sha256 (of the text that is left) of every document."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("lines.n").alias("n_lines"), F.col("lines.kept").alias("n_kept"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = classifier.score(docs, model)
    return scored.select("doc_id", (crc32_of(F.col("doc_id")) % 3 == 1).alias("held_out"), F.col("quality.score").alias("score"), (F.col("quality.score") >= 0.5).cast("int").alias("predicted"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(F.col(f"rules.{k}") for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "repeat_covered", "longest_repeat")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "tokens.n_bytes", "tokens.n_tokens", (F.col("tokens.n_tokens") > 4096).alias("over_limit"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_chat_format, op2_line_dedup, op3_quality_classifier, op4_url_filter, op5_packing, op6_byte_bpe, op7_quality_rules, op8_token_counts, op9_nearest, op10_simhash)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_OP1 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prev
  FROM c
), m AS (
  SELECT *, 2 * length(text) - length(regexp_replace(text, '[<\[\\]', '', 'g'))
           + CASE WHEN prev = role THEN 6 ELSE 19 + 2 * length(role) - length(regexp_replace(role, '[<\[\\]', '', 'g')) END AS cost
  FROM o
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY rn)) AS loss_sha256,
       (7 + sum(cost))::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""

_OP9 = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def _op4(spread: url_filter.Spread = url_filter.Spread()) -> str:
    link = url_filter.LINK.replace("'", "''")
    rounds, last = [], "start"
    for i in range(spread.rounds):
        rounds.append(f"""s{i} AS (SELECT kind, host, sum(score) AS score FROM (
  SELECT e.kind, e.t AS host, e.w * s.score * {spread.damping} AS score FROM edges e JOIN {last} s ON e.kind = s.kind AND e.f = s.host
  UNION ALL SELECT kind, host, score FROM start) GROUP BY kind, host)""")
        last = f"s{i}"
    return rf"""
WITH u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/' END AS rule FROM p
), d AS (SELECT *, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM r
), h AS (SELECT host, count(*) AS n, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM d WHERE host <> '' GROUP BY host
), seeds AS (SELECT 0 AS kind, host, a AS weight FROM h WHERE a > 0 UNION ALL SELECT 1, host, b FROM h WHERE b > 0
), start AS (SELECT kind, host, weight / sum(weight) OVER (PARTITION BY kind) * {1 - spread.damping} AS score FROM seeds
), l AS (SELECT host AS f, lower(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1))) AS t FROM p WHERE host <> ''
), x AS (SELECT string_split(host, '.') AS y, n FROM h
), i AS (SELECT y, n, unnest(range(1, len(y) - 1)) AS k FROM x
), up AS (SELECT array_to_string(y[k:], '.') AS f, array_to_string(y[k + 1:], '.') AS t, n FROM i
), pairs AS (SELECT f, t, sum(n)::DOUBLE AS n FROM (SELECT f, t, 1 AS n FROM l WHERE f <> t UNION ALL SELECT f, t, n FROM up UNION ALL SELECT t, f, n FROM up) GROUP BY f, t
), both_ways AS (SELECT 0 AS kind, f, t, n FROM pairs UNION ALL SELECT 1, t, f, n FROM pairs
), edges AS (SELECT kind, f, t, n / sum(n) OVER (PARTITION BY kind, f) AS w FROM both_ways
), {", ".join(rounds)}
, bad AS (SELECT host FROM {last} GROUP BY host HAVING sum(CASE WHEN kind = 1 THEN score ELSE 0 END) > {spread.factor} * sum(CASE WHEN kind = 0 THEN score ELSE 0 END))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN rule IS NULL THEN 'links' ELSE 'rule' END AS "by"
FROM d
"""


def oracle_sql() -> dict[str, str]:
    """The others hash, merge or train in ways that SQL has no functions for; tests hold them against plain Python and the tokenizers' libraries."""
    import corpus_pipeline

    known = {"op1_chat_format": _OP1, "op4_url_filter": _op4(), "op9_nearest": _OP9, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: v for k, v in known.items() if v}
