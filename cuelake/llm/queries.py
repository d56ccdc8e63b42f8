"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, toxicity
from .common import fold, table
from .embedding_dedup import embedding_components
from .extraction import extract
from .hard_negatives import hard_negatives
from .licenses import BASE, TEMPLATES, license_report
from .mixing import mix_plan
from .near_dedup import NearDedup, near_components
from .packing import Packing, packed
from .prefix_trie import numbered_turns, prefix_trie, spliced
from .quality import quality
from .substring_dedup import substring_dedup
from .token_counts import TokenCounts, token_counts


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _held():
    return F.coalesce(fold() == 0, F.lit(False)).alias("held_out")


def op1_bitmask_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.language(docs, langid.fit(docs)).select("doc_id", _held(), "lang_pred", "score")


def op2_template_deduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")


def op3_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), NearDedup(words=3, num=85, den=100))


def op4_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def op5_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op6_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op8_bernoulli_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", _held(), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def op10_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packed(table(spark, sf_dir, "documents"), Packing(vocabulary()))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_preorder_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie(spliced(numbered_turns(table(spark, sf_dir, "conversations"))))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), TokenCounts(vocabulary()))


def op13_inverted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def queries() -> dict:
    return {f.__name__: f for f in (op1_bitmask_filters, op2_template_deduction, op3_minhash_odd_sketch, op4_diagonal_voting, op5_collision_counting, op6_gear_chunks, op7_weak_supervision, op8_bernoulli_mix, op9_segment_search, op10_differencing, op11_preorder_intervals, op12_prefix_counts, op13_inverted_lists)}


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash_odd_sketch": OP3_SQL, "op4_diagonal_voting": _op4_sql(), "op5_collision_counting": OP5_SQL, "op8_bernoulli_mix": OP8_SQL, "op11_preorder_intervals": _op11_sql(), "op13_inverted_lists": OP13_SQL}


#: All pairs of documents that share a shingle, by counting, and what is reachable over links.
OP3_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM texts
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
)
SELECT s.doc_id, any_value(len(s.s))::BIGINT AS n_shingles, min(r.other) AS component_id, s.doc_id = min(r.other) AS kept
FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id
"""

#: All pairs of a label.
OP5_SQL = r"""
WITH RECURSIVE fine AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON l.x = r.other
), counted AS (
  SELECT x, count(*) AS n FROM links GROUP BY x
)
SELECT r.vec_id, coalesce(any_value(c.n), 0)::BIGINT AS n_links, min(r.other) AS component_id, r.vec_id = min(r.other) AS kept
FROM reach r LEFT JOIN counted c ON c.x = r.vec_id GROUP BY r.vec_id
"""


def _op4_sql() -> str:
    listed = [(i, t, label, i < len(BASE)) for i, (t, label) in enumerate(BASE + TEMPLATES)]
    values = ", ".join(f"({i}, '{t}', '{label}', {str(b).lower()})" for i, t, label, b in listed)
    return rf"""
WITH templates(template, t, label, base) AS (VALUES {values}),
texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), grams AS (
  SELECT doc_id, i - 1 AS pos, x || ' ' || lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS gram
  FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM texts)
), parts AS (
  SELECT template, label, base, len(string_split(t, ' ')) - 1 AS grams, i - 1 AS at_, string_split(t, ' ')[i] || ' ' || string_split(t, ' ')[i + 1] AS gram
  FROM templates, unnest(range(1, len(string_split(t, ' ')))) AS r(i)
), diagonal AS (
  SELECT doc_id, template, label, base, grams, pos - at_ AS off, list(DISTINCT at_) AS ats, min(pos) AS lo, max(pos) + 1 AS hi
  FROM grams JOIN parts USING (gram) GROUP BY ALL
), kept AS (
  SELECT *, (base OR coalesce(off - lag(off) OVER line > 3, true))::INT AS fresh FROM diagonal WHERE NOT base OR len(ats) = grams
  WINDOW line AS (PARTITION BY doc_id, template ORDER BY off)
), islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY off) AS island FROM kept
), merged AS (
  SELECT doc_id, template, label, base, grams, island, len(list_distinct(flatten(list(ats)))) AS n, min(lo) AS first_, max(hi) AS last_
  FROM islands GROUP BY ALL
), found AS (
  SELECT *, n / grams::DOUBLE AS cover FROM merged WHERE base OR (n / grams::DOUBLE >= 0.75 AND last_ - first_ + 1 <= 1.5 * (grams + 1))
)
SELECT x.doc_id, len(any_value(x.w))::BIGINT AS n_words, count(f.template) FILTER (f.base) AS n_base,
  min(first_) FILTER (f.base)::BIGINT AS first_word, max(first_) FILTER (f.base)::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (f.base)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS labels,
  coalesce(max(cover), 0.0) AS score
FROM texts x LEFT JOIN found f ON x.doc_id = f.doc_id GROUP BY x.doc_id
"""


#: All pairs of an anchor and a row.
OP13_SQL = r"""
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) <= 3
"""


def _op11_sql() -> str:
    """Every prefix as the list of its turns, grouped, and its ancestors by cutting it; crc32 by half bytes."""
    halves = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        halves.append(n)
    return rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({{'h': h, 'w': len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))}} ORDER BY turn NULLS FIRST, role, h) AS t FROM turns GROUP BY conv_id
), asked AS (
  SELECT conv_id, t, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(x) & 15, ord(x) >> 4] FOR x IN string_split(conv_id::VARCHAR, '')])::BIGINT[]), lambda crc, x: xor(({halves}::BIGINT[])[((xor(crc, x) & 15) + 1)::INT], crc >> 4)), 4294967295) % 4 AS h FROM own
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(o.t[1:a.h], []), a.t[a.h + 1:]) AS t FROM asked a LEFT JOIN own o ON o.conv_id = a.conv_id - a.conv_id % 20
), prefixes AS (
  SELECT conv_id, d, [x.h FOR x IN t[1:d]] AS path, CASE WHEN d = 0 THEN 0 ELSE t[d].w END AS w, len(t) AS n FROM rebuilt, unnest(range(0, len(t) + 1)) AS r(d)
), nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends FROM prefixes GROUP BY path, d
), kids AS (
  SELECT path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), above AS (
  SELECT path[1:i] AS path, sum(own) AS own, sum((k IS NULL)::INT) AS leaves
  FROM (SELECT n.path, n.d, n.own, k.n AS k FROM nodes n LEFT JOIN kids k ON k.path = n.path), unnest(range(0, d + 1)) AS r(i) GROUP BY ALL
)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0)::BIGINT AS n_children, a.leaves::BIGINT AS n_leaves, a.own::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN above a ON a.path = n.path LEFT JOIN kids k ON k.path = n.path LEFT JOIN nodes p ON n.d > 0 AND p.path = n.path[1:n.d - 1]
"""


#: The same filling by weight, over the sources in the order of limit over weight.
OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS nth
  FROM sized GROUP BY source
), limited AS (
  SELECT source, source_size, [3.0, 1.0, 2.0][(nth % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS lim FROM by_source
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM limited
  WINDOW before AS (ORDER BY lim / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), free AS (
  SELECT level FROM levels WHERE w * level <= lim ORDER BY lim / w, source ASC NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size, least(lim, w * coalesce((SELECT level FROM free), lim / w)) AS target FROM levels
), rates AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  size * (floor(rate)::BIGINT + (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 < rate - floor(rate))::BIGINT) AS taken
FROM rates
"""
