"""The corpus queries by name, and SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.llm import (
    chat,
    classifier,
    decontaminate,
    jaccard,
    licenses,
    negatives,
    pii,
    prefix_trie,
    repeats,
    rules,
    segment,
    token_shards,
    topk,
)
from ebbline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    book = rules.apply_policy(rules.ledger(table(spark, folder, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(rules.mask("base"))) != 0
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "failed", "policy",
    )


def op4_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.classes(table(spark, folder, "documents"))


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, folder, "documents")))


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    found = classifier.classify(table(spark, folder, "documents"))
    count = lambda v: F.size(F.filter("votes", lambda x: x == v)).cast("bigint")
    return found.select(
        "doc_id", count(1).alias("n_good"), count(-1).alias("n_bad"), "posterior", "score", "kept"
    )


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.repeated(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_chats(table(spark, folder, "conversations"))


def op7_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    path = token_shards.write_shards(table(spark, folder, "documents"), token_shards.load_ranks())
    return token_shards.read_slots(spark, path).select(
        "slot", "shard", "place", "doc_id", "seq", "n_tokens", F.sha2("record", 256).alias("record_sha256")
    )


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    pieces = segment.Pieces.load()
    encoded = segment.encode(table(spark, folder, "documents"), pieces)
    return segment.decode(encoded, pieces).select(
        "doc_id",
        "rank",
        F.size("ids").cast("bigint").alias("n_ids"),
        "log_prob",
        "inclusion",
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.mine(table(spark, folder, "embeddings"))


def op13_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "embeddings"))


RULES_SQL = r"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
listed AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM texts),
placed AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i FROM listed),
windows AS (
  SELECT r, i, x, lead(x) OVER s AS y, lead(x, 2) OVER s AS z FROM placed
  WINDOW s AS (PARTITION BY r ORDER BY i)),
found AS (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS n FROM windows WHERE z IS NOT NULL),
covered AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM found WHERE n > 1)
  GROUP BY r),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(l)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
  FROM listed LEFT JOIN covered USING (r)),
judged AS (
  SELECT *, n_words < 50 AS f0, 100 * n_repeat_words > 50 * n_words AS f1, 100 * n_symbols > 10 * word_chars AS f2,
    100 * n_dup_lines > 30 * n_lines AS f3, 100 * n_upper > 50 * word_chars AS f4, word_chars < 2 * n_words AS f5,
    word_chars > 20 * n_words AS f6
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 OR f1 AS base_failed,
  NOT (f0 OR f1 OR f2 OR f3 OR f4 OR f5 OR f6) AS kept,
  (f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT + 32 * f5::INT + 64 * f6::INT)::BIGINT AS failed,
  'v2' AS policy
FROM judged
"""


CHAT_SQL = """
WITH placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n,
    coalesce('r' || len(role) || role, 'n') || coalesce('t' || len(text) || text, 'n') AS own
  FROM conversations),
begun AS (
  SELECT *, string_agg(own, '') OVER (PARTITION BY conv_id ORDER BY k) AS so_far FROM placed),
whole AS (
  SELECT so_far, min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_copies FROM begun WHERE k = n GROUP BY so_far, n),
chosen AS (
  SELECT * FROM whole w
  WHERE NOT EXISTS (SELECT 1 FROM begun b WHERE b.k < b.n AND b.k = w.n_turns AND b.so_far = w.so_far))
SELECT c.conv_id, c.n_turns, c.n_copies,
  string_agg('<|im_start|>' || replace(coalesce(role, ''), '<|im_', '< |im_') || chr(10)
    || replace(coalesce(text, ''), '<|im_', '< |im_') || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered
FROM chosen c JOIN placed p ON p.conv_id IS NOT DISTINCT FROM c.conv_id
GROUP BY c.conv_id, c.n_turns, c.n_copies
"""


REPEATS_SQL = """
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (
  SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 200)) AS w
  FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS s FROM texts)),
later AS (
  SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, s) > 1),
marked AS (
  SELECT *, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, true)::INT AS fresh FROM later),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked),
runs AS (
  SELECT doc_id, min(s) AS low, max(s) + 100 AS high,
    coalesce(lag(max(s) + 100) OVER (PARTITION BY doc_id ORDER BY min(s)), 0) AS before
  FROM numbered GROUP BY doc_id, run),
cut AS (
  SELECT doc_id, count(*) AS n_spans, sum(high - low) AS gone, max(high) AS last,
    string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) AS kept
  FROM runs JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)
"""

JACCARD_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
near AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION
  SELECT l.b, r.root FROM reach r JOIN (SELECT a, b FROM near UNION ALL SELECT b, a FROM near) l ON l.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id,
  coalesce(any_value(k), 0) AS n_links
FROM reach r LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS k FROM (SELECT a AS doc_id FROM near UNION ALL SELECT b FROM near) GROUP BY doc_id)
  USING (doc_id)
GROUP BY r.doc_id
"""


TRIE_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS base,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, c: list_reduce(
        list_prepend(xor(crc, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda v, x: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 6 AS h
  FROM turns GROUP BY conv_id),
known AS (SELECT i.*, least(i.h, coalesce(b.n, 0)) AS lent FROM ids i LEFT JOIN ids b ON b.conv_id = i.base),
rebuilt AS (
  SELECT k.conv_id, p AS pos, role, text FROM known k JOIN turns t ON t.conv_id = k.base AND p <= k.lent
  UNION ALL
  SELECT k.conv_id, p - k.h + k.lent, role, text FROM known k JOIN turns t ON t.conv_id = k.conv_id AND p > k.h),
begun AS MATERIALIZED (
  SELECT conv_id, 0 AS pos, md5('') AS path, 0 AS size FROM ids
  UNION ALL
  SELECT conv_id, pos, md5(string_agg(len(role) || ':' || role || len(text) || ':' || text, '') OVER (
    PARTITION BY conv_id ORDER BY pos)), len(text) FROM rebuilt),
members AS MATERIALIZED (
  SELECT *, lag(path) OVER s AS above, lead(path) OVER s IS NULL AS last FROM begun
  WINDOW s AS (PARTITION BY conv_id ORDER BY pos)),
nodes AS MATERIALIZED (
  SELECT path, pos, min(conv_id) AS conv_id, any_value(above) AS above, count(*) AS n, any_value(size) AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends
  FROM members GROUP BY path, pos),
children AS (SELECT above AS path, pos - 1 AS pos, count(*) AS n FROM nodes WHERE pos > 0 GROUP BY above, pos),
below AS (
  SELECT DISTINCT a.path, a.pos, b.path AS path2, b.pos AS pos2
  FROM members a JOIN members b ON a.conv_id = b.conv_id AND a.pos <= b.pos),
sums AS (
  SELECT b.path, b.pos, sum((n.n - 1) * n.size) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
  FROM below b JOIN nodes n ON n.path = path2 AND n.pos = pos2 LEFT JOIN children c ON c.path = path2 AND c.pos = pos2
  GROUP BY b.path, b.pos)
SELECT n.conv_id, n.pos::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(c.n, 0) AS n_children,
  s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN sums s USING (path, pos) LEFT JOIN children c USING (path, pos)
LEFT JOIN nodes p ON p.path = n.above AND p.pos = n.pos - 1
"""

_VECTORS_SQL = """
WITH read AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
vectors AS (SELECT vec_id, label, list_transform(v, lambda x: x::BIGINT) AS v FROM read),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, q.label, c.label AS other,
    list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM {vectors} q JOIN {vectors} c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
"""

TOPK_SQL = _VECTORS_SQL.format(vectors="vectors") + """
SELECT query_id, (row_number() OVER s)::INT AS rank, vec_id, score FROM scored
WINDOW s AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER s <= 5
"""

NEGATIVES_SQL = _VECTORS_SQL.format(
    vectors="""(
    SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
    FROM vectors WHERE label IS NOT NULL)"""
) + """,
positives AS (
  SELECT query_id, label, vec_id, score FROM scored WHERE label = other
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.query_id AS anchor_id, p.vec_id AS positive_id, (row_number() OVER s)::INT AS rank, n.vec_id AS negative_id,
  p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.query_id = p.query_id AND n.other <> p.label
  AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW s AS (PARTITION BY p.query_id, p.vec_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER s <= 3
"""


def _licenses_sql() -> str:
    """The fullest stretch of every text for every template and whole license, without retrieval."""
    every = licenses.TEMPLATES | licenses.whole_texts()
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in every.items())
    return rf"""
WITH known(name, text) AS (VALUES {rows}),
texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
templates AS (SELECT name, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM known),
own AS (
  SELECT name, p, min(pos) AS place
  FROM (SELECT name, pos, w[pos + 1] || ' ' || w[pos + 2] AS p FROM (SELECT *, unnest(range(0, len(w) - 1)) AS pos FROM templates))
  GROUP BY name, p),
sizes AS (SELECT name, count(*) AS n, any_value(len(w)) - 1 AS length FROM own JOIN templates USING (name) GROUP BY name),
hits AS MATERIALIZED (
  SELECT r, doc_id, name, place, pos
  FROM (SELECT r, doc_id, pos, w[pos + 1] || ' ' || w[pos + 2] AS p FROM (SELECT *, unnest(range(0, len(w) - 1)) AS pos FROM texts))
  JOIN own USING (p)),
likely AS (SELECT r, name FROM hits JOIN sizes USING (name) GROUP BY r, name, n HAVING 100 * count(DISTINCT place) >= 80 * n),
near AS MATERIALIZED (SELECT h.*, n, length FROM hits h JOIN likely USING (r, name) JOIN sizes USING (name)),
firsts AS (
  SELECT a.r, a.doc_id, a.name, a.n, a.pos AS start, b.place, min(b.pos) AS pos
  FROM near a JOIN near b ON a.r = b.r AND a.name = b.name AND b.pos BETWEEN a.pos AND a.pos + {licenses.SPREAD} * a.length
  GROUP BY ALL),
stretches AS (
  SELECT r, doc_id, name, n, start, count(*) AS n_found, max(pos) + 2 AS past FROM firsts GROUP BY r, doc_id, name, n, start)
SELECT doc_id, name AS template, n_found, n AS n_shingles, start AS first_word, past AS past_word
FROM stretches WHERE 100 * n_found >= 80 * n
QUALIFY row_number() OVER (PARTITION BY r, name ORDER BY n_found DESC, past - start, start) = 1
"""


def queries() -> dict[str, Query]:
    from corpus_pipeline import run

    return {
        "pipeline": run,
        "op1_quality_classifier": op1_quality_classifier,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_decontamination": op3_decontamination,
        "op4_ngram_jaccard": op4_ngram_jaccard,
        "op5_quality_rules": op5_quality_rules,
        "op6_chat_formatting": op6_chat_formatting,
        "op7_token_shards": op7_token_shards,
        "op8_pii": op8_pii,
        "op9_license_scan": op9_license_scan,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_topk_search": op13_topk_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_dedup": REPEATS_SQL,
        "op4_ngram_jaccard": JACCARD_SQL,
        "op5_quality_rules": RULES_SQL,
        "op6_chat_formatting": CHAT_SQL,
        "op9_license_scan": _licenses_sql(),
        "op11_prefix_trie": TRIE_SQL,
        "op12_hard_negatives": NEGATIVES_SQL,
        "op13_topk_search": TOPK_SQL,
    }
