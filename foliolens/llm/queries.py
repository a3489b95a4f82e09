"""Registered queries of this subpackage: one per operator, and the pipeline; SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, decontaminate, hard_negatives, line_dedup, license_scan, ngram_join, piece_bpe, quality_classifier, quality_rules, suffix_dedup, token_alignment, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents")).drop("removed_from", "removed_to")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(quality_rules.ledger(_table(spark, sf_dir, "documents")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.Ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), ranks)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_table(spark, sf_dir, "documents")).drop("class_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.report(hits).drop("char_from", "char_to")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.Ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.encode(_table(spark, sf_dir, "documents"), ranks), ranks)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fields = _table(spark, sf_dir, "documents"), ["source", "lang"]
    model = quality_classifier.train(docs, _table(spark, sf_dir, "labels"), fields)
    return quality_classifier.score(docs, model, fields)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = f"{chat_format.END}{chat_format.START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id bigint, turn bigint, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.report(chat_format.format_chats(turns))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # documents lie in a directory per source and language
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))
    return license_scan.scan(_table(spark, sf_dir, "documents"), path)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_alignment.Vocabularies(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return token_alignment.report(_table(spark, sf_dir, "documents"), files)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the contract moves the label of every seventh row
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", label))


def op13_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = piece_bpe.Vocabulary(spark, public_tokenizers.path("piece_bpe_32k.model"))
    return piece_bpe.report(piece_bpe.decode(piece_bpe.encode(_table(spark, sf_dir, "documents"), vocabulary), vocabulary))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_suffix_dedup, op3_quality_rules, op4_token_counts, op5_ngram_join, op6_decontamination, op7_byte_bpe, op8_quality_classifier, op9_chat_format, op10_license_scan, op11_token_alignment, op12_hard_negatives, op13_piece_bpe)}

ORACLE: dict[str, str] = {}

ORACLE["op3_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
gram AS (SELECT doc_id, i, x AS a, lead(x) OVER k AS b, lead(x, 2) OVER k AS c FROM word WINDOW k AS (PARTITION BY doc_id ORDER BY i)),
found AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM gram WHERE c IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM found WHERE n > 1) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d),
dup AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT x) AS n FROM line WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words, coalesce(dup.lines, 0) AS lines,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        100 * n_symbols > 10 * word_chars AS s, 100 * n_dup_lines > 50 * lines AS l, word_chars < 2 * n_words AS sh, word_chars > 20 * n_words AS lo, 2 * capitals > letters AS ca FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR s OR l OR sh OR lo OR ca) AS kept,
  CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (n_words = 0)::INT + 8 * s::INT + 16 * l::INT + 32 * sh::INT + 64 * lo::INT
    + 128 * (100 * n_symbols > 3 * word_chars)::INT + 256 * (100 * n_dup_lines > 20 * lines)::INT + 512 * ca::INT AS BIGINT) AS failed
FROM v"""

ORACLE["op6_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM s, unnest(range(1, len(w) - size + 2)) AS t(i)),
sizes AS (SELECT DISTINCT size FROM win),
pos AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g FROM d, sizes, unnest(range(1, CAST(len(w) AS BIGINT) - size + 2)) AS t(i)),
hit AS (SELECT doc_id, i, pos.size, item_id FROM pos JOIN win ON pos.g = win.g AND pos.size = win.size),
cover AS (SELECT doc_id, count(DISTINCT j) AS n FROM hit, unnest(range(i, i + size)) AS t(j) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(cover.n, 0) AS n_hit, coalesce(item.n, 0) AS n_items,
  sha256(coalesce(item.ids, '')) AS items_sha256, coalesce(cover.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN item USING (doc_id)"""

ORACLE["op9_chat_format"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
k AS (SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(replace(replace(text, '\', '\\'), '<|', '<\|')) + CASE WHEN before = role THEN 8
    ELSE 24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n>')) END) AS BIGINT) AS formatted_chars
FROM k GROUP BY conv_id"""

ORACLE["op5_ngram_join"] = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM d, unnest(range(1, greatest(CAST(len(w) AS BIGINT) - 2, 2))) AS t(i) WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT x, y FROM o JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) m ON m.x = d.doc_id"""

ORACLE["op2_suffix_dedup"] = r"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, unnest(range(0, greatest(length(h) // 2 - 199, 0))) AS i,
  unnest(list_transform(range(0, greatest(length(h) // 2 - 199, 0)), lambda i: md5_number(substring(h, 2 * i + 1, 400)))) AS g FROM d),
r AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM w SEMI JOIN (SELECT g FROM w GROUP BY g HAVING count(*) > 1) AS x USING (g)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM r GROUP BY doc_id, run),
o AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM s),
u AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY a) AS k FROM o) GROUP BY doc_id, k),
e AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM u),
k AS (SELECT e.doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS tail, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""

ORACLE["op12_hard_negatives"] = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
q AS MATERIALIZED (SELECT *, row_number() OVER () AS r FROM (SELECT DISTINCT vec_id, label, list_transform(e, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
s AS MATERIALIZED (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
