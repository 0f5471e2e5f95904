"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answergrid.llm import toxicity
from answergrid.llm.chat import format_chats
from answergrid.llm.decontaminate import find_benchmark
from answergrid.llm.language_id import identify, learn
from answergrid.llm.line_dedup import drop_common_lines
from answergrid.llm.mixing import mix_sources
from answergrid.llm.near_dedup import near_duplicates
from answergrid.llm.perplexity import judge_quality
from answergrid.llm.registry import query, table
from answergrid.llm.secret_scan import RULES, scan_secrets
from answergrid.llm.warc_zip import read_archives, write_archives


def remainder(divisor: int) -> Column:
    """crc32 of the doc_id as text, modulo the divisor; of an empty text for a NULL id."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % divisor


LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, parts[i] AS line,
         translate(regexp_replace(parts[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
),
common AS (
  SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN common c ON l.key = c.key
GROUP BY doc_id
"""


@query(LINE_DEDUP_SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder(4) != 2)
    index = toxicity.learn(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    scored = toxicity.score_toxicity(docs, index)
    return scored.select(
        "doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence"
    )


@query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(remainder(3) != 1))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score", "known")


def _rule_sql(rule) -> str:
    """Spans of one rule: the pieces between the matches give their starts."""
    p = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{rule.kind}' AS kind, {RULES.index(rule)} AS place, s AS a, s + length(m) AS b FROM (
    SELECT doc_id, ms[i] AS m, vs[i] AS v, list_sum(list_transform(ps[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT doc_id, ms, vs, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {rule.group}) AS vs,
             string_split_regex(t, '{p}') AS ps FROM texts)))
  WHERE length(v) >= {rule.least}"""


SECRETS_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_rule_sql(r) for r in RULES)}),
joined AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, place) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id
"""


def _spans(kind: str) -> Column:
    return F.coalesce(F.element_at("spans", kind), F.array().cast("array<struct<start:bigint,end:bigint>>"))


def _named_spans(kind: str, place: int) -> Column:
    def name(span: Column) -> Column:
        said = F.concat_ws(":", F.lit(kind), span["start"], span["end"])
        return F.struct(span["start"].alias("start"), F.lit(place).alias("place"), said.alias("said"))

    return F.transform(_spans(kind), name)


@query(SECRETS_SQL)
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = F.concat(*[_named_spans(r.kind, i) for i, r in enumerate(RULES)])
    said = F.array_join(F.transform(F.array_sort(listed), lambda x: x["said"]), ",")
    counts = [F.size(_spans(r.kind)).cast("long").alias(f"n_{r.kind}") for r in RULES]
    return found.select("doc_id", *counts, F.sha2(said, 256).alias("base_sha256"), said.alias("spans"))


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(d, {5 * (i // 4) + 1}, 5))::INTEGER >> {15 - 5 * (i % 4)}) & 31) + 1)::INTEGER, 1)"
    for i in range(32)
)
WARC_SQL = f"""
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS largest
      FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
"""


@query(WARC_SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), least_bytes=0)
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


DECONTAMINATION_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS i FROM item_words)
),
sizes AS (SELECT DISTINCT m FROM item_windows),
places AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS key
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc_words, sizes)
),
found AS (SELECT p.doc_id, p.i, p.m, x.item_id FROM places p JOIN item_windows x ON p.m = x.m AND p.key = x.key),
hit AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM found) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(s.n, 0) AS n_items,
       sha256(coalesce(s.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN items s ON d.doc_id = s.doc_id
"""


@query(DECONTAMINATION_SQL)
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), "contaminated"
    )


@query()
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity"
    )


MIXING_SQL = """
WITH RECURSIVE sources AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
means AS (
  SELECT source, mean, greatest(1, ceil(mean / 16.0)) AS rounds, mean / greatest(1, ceil(mean / 16.0)) AS part
  FROM (SELECT source, (SELECT sum(n)::DOUBLE FROM sources) * 1.0 / (SELECT count(*)::DOUBLE FROM sources) / n AS mean
        FROM sources)
),
odds AS (
  SELECT source, part, 0 AS k, exp(-part) AS p, exp(-part) AS below FROM means
  UNION ALL
  SELECT source, part, k + 1, p * part / (k + 1), below + p * part / (k + 1) FROM odds WHERE k < 80
),
drawn AS (
  SELECT d.*, m.source AS s, r,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-') || ':42:' || r), 1, 12))::BIGINT / 281474976710656.0 AS u
  FROM (SELECT d.*, unnest(range(1, rounds::BIGINT + 1)) AS r FROM documents d JOIN means m
        ON d.source IS NOT DISTINCT FROM m.source) d JOIN means m ON d.source IS NOT DISTINCT FROM m.source
),
counted AS (
  SELECT doc_id, any_value(text) AS text, any_value(source) AS source, sum(c)::INTEGER AS n_copies FROM (
    SELECT doc_id, text, source, r, (SELECT count(*) FROM odds o WHERE o.source IS NOT DISTINCT FROM drawn.source AND o.below <= u) AS c
    FROM drawn) GROUP BY doc_id
),
copies AS (SELECT *, unnest(range(0, n_copies)) AS c FROM counted)
SELECT doc_id, text, source, n_copies, c::INTEGER AS copy,
       ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-') || ':42:order:' || c), 1, 12))::BIGINT / 281474976710656.0 AS shuffle_key
FROM copies
"""


@query(MIXING_SQL)
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs, seed=42).select("doc_id", "text", "source", "n_copies", "copy", "shuffle_key")


CHAT_SQL = """
WITH logged AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST) AS turns, min(coalesce(turn, 0)) AS low
  FROM conversations GROUP BY conv_id
),
begun AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM logged)),
kept AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS copies, any_value(low) AS low FROM logged GROUP BY turns)
SELECT conv_id, floor(low / 1024)::BIGINT AS part, len(turns) AS n_turns, copies,
       array_to_string(list_transform(turns, lambda x: '<|im_start|>' || coalesce(x.role, '') || chr(10) || coalesce(x.text, '')
                                                 || '<|im_end|>' || chr(10)), '') AS chat
FROM kept WHERE turns NOT IN (SELECT turns FROM begun)
"""


@query(CHAT_SQL)
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


@query()
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "keeper")
