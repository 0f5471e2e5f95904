"""The registered queries of packing, spelling variants and phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answergrid.llm.packing import pack
from answergrid.llm.phrases import mine_phrases
from answergrid.llm.registry import query, table
from answergrid.llm.spelling import spelling_variants


@query()
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length"
    )


SPELLING_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  GROUP BY doc_id, run
),
hashed AS (
  SELECT run, times, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || x[2 * i - 1:2 * i])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT run, times, t, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs, crc)
),
words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
                       ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
),
shorter AS (
  SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS short
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
),
replaced AS (
  SELECT DISTINCT word, n, left(word, i - 1) || chr(0) || substr(word, i + 1) AS hole
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM replaced a JOIN replaced b ON a.hole = b.hole AND a.word <> b.word
  UNION
  SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.short = w.word
  UNION
  SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.short = w.word
),
best AS (
  SELECT word, count(*) AS n_near, (list(other ORDER BY other_n DESC, other))[1] AS other, max(other_n) AS other_n
  FROM near GROUP BY word
),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form,
         CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
),
chains AS (
  SELECT word, coalesce(form, word) AS root, form IS NULL AS done FROM forms
  UNION ALL
  SELECT c.word, coalesce(f.form, f.word), f.form IS NULL FROM chains c JOIN forms f ON c.root = f.word WHERE NOT c.done
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.root FROM forms f JOIN chains c ON f.word = c.word WHERE c.done
"""


@query(SPELLING_SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")


PHRASES_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
),
grams AS (
  SELECT lang, w[i:i + k - 1] AS p, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS k))
  GROUP BY lang, p HAVING count(*) >= 100
),
sizes AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang),
candidates AS (SELECT lang, p, f AS a FROM grams WHERE len(p) > 1),
inner_parts AS (
  SELECT DISTINCT lang, p[i:i + k - 1] AS p, a FROM (
    SELECT lang, p, a, k, unnest(range(1, len(p) - k + 2)) AS i
    FROM candidates, (SELECT unnest(range(2, 5)) AS k) WHERE k < len(p))
),
alive AS (
  SELECT c.* FROM candidates c ANTI JOIN inner_parts i ON c.lang = i.lang AND c.p = i.p AND 100 * i.a >= 100 * c.a
),
cuts AS (
  SELECT c.lang, c.p, c.a, k, l.f AS l, r.f AS r, s.n, 1000::HUGEINT * c.a * s.n // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM alive) c
  JOIN grams l ON l.lang = c.lang AND l.p = c.p[1:k]
  JOIN grams r ON r.lang = c.lang AND r.p = c.p[k + 1:]
  JOIN sizes s ON s.lang = c.lang
),
scored AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       n::BIGINT AS n, score::BIGINT AS score
FROM scored QUALIFY rank <= 2000
"""


@query(PHRASES_SQL)
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))
