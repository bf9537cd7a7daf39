"""Registered queries opN_<name> over the given tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.llm import rules as _rules
from lapse.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_register
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards with row counts at most one apart."""
    from lapse.llm.sharding import shard_rows
    out = shard_rows(table(spark, sf_dir, "documents"), "doc_id", shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@_register
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources by weights 1, 2, 3 takes from every document."""
    from lapse.llm.mixing import mix_sources
    out = mix_sources(table(spark, sf_dir, "documents"), "doc_id", "source")
    return out.select("doc_id", "size", "source_size", "target", "taken", "mix_shard")


@_register
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    from lapse.llm.secrets import scan_secrets
    return scan_secrets(table(spark, sf_dir, "documents"), "doc_id").drop("findings")


@_register
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    from lapse.llm.simhash import simhash_groups
    return simhash_groups(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "fingerprint", "component_id")


@_register
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items."""
    from lapse.llm.decontaminate import contaminated, contamination
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


@_register
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    from lapse.llm.toxicity import toxicity
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@_register
def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without windows of 13 words that an earlier one has."""
    from lapse.llm.substring import remove_repeats
    out = remove_repeats(table(spark, sf_dir, "documents"), "doc_id")
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_register
def op1_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every 50th vector with all others."""
    from lapse.llm.knn import knn_join
    data = table(spark, sf_dir, "embeddings")
    return knn_join(data.where(F.col("vec_id") % 50 == 0), data, "vec_id", "embedding", k=5)


@_register
def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as directly addressable codes and read back."""
    import public_tokenizers
    from lapse.llm.tokens import tokenize_table
    return tokenize_table(table(spark, sf_dir, "documents"), "doc_id", public_tokenizers.path("byte_bpe_50k.json"))


@_register
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of every document for the text marked as good, and the Gumbel top-k draw."""
    from lapse.llm.quality import resample
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@_register
def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 100th vector and its positives; every 7th label is moved by one first."""
    from lapse.llm.negatives import hard_negatives
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0, "vec_id", "embedding", "label")


@_register
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first four whitened components."""
    from lapse.llm.whitening import whiten
    rows, components = whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=4)
    long = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    return (long.join(F.broadcast(components), "component")  # at most four rows
                .select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"))


@_register
def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    from lapse.llm.rules import apply_rules
    out = apply_rules(table(spark, sf_dir, "documents"), "doc_id")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      F.array_join("failed", ",").alias("failed"))


ORACLE["op1_knn"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

_WORDS_5 = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
ORACLE["op5_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS_5} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_5} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, l, array_to_string(w[s:s + l - 1], ' ') AS k
  FROM (SELECT item, w, least(13, len(w)) AS l, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)
),
place AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l),
hit AS (SELECT doc_id, place.l, s, item FROM place JOIN win ON place.l = win.l AND array_to_string(w[s:s + place.l - 1], ' ') = k),
words AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(s, s + l)) AS i FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE["op8_substring"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
early AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY k) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM early),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

ORACLE["op11_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         CAST(list_sum(list_transform(list_zip(a.e, r.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id
  WHERE a.vec_id % 100 = 0
), pos AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
neg AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM pos p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank,
       negative_id, positive_score, negative_score
FROM neg QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) <= 10
"""

_STOP = "[" + ", ".join(f"'{w}', '{w[:1].upper() + w[1:]}'" for w in _rules.STOP_WORDS) + "]"
ORACLE["op13_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 3)) AS p FROM twice) GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: list_contains({_STOP}, x))) AS n_stop,
         len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{{L}}'))) AS n_letterless,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis
  FROM w LEFT JOIN rep USING (r)
), f AS (
  SELECT *, n_words < 50 AS few, 100 * n_repeat_words > 50 * n_words AS rpt,
         word_chars < 2 * n_words OR word_chars > 12 * n_words AS len_, n_symbols > CAST(0.1 AS DOUBLE) * n_words AS sym,
         n_letterless > CAST(0.3 AS DOUBLE) * n_words AS nol, n_stop < CAST(0.02 AS DOUBLE) * n_words AS stp,
         2 * n_dup_lines > n_lines AS dup, n_bullet > CAST(0.9 AS DOUBLE) * n_lines AS bul, n_ellipsis > CAST(0.3 AS DOUBLE) * n_lines AS ell
  FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, few OR rpt AS base_failed,
       NOT (few OR rpt OR len_ OR sym OR nol OR stp OR dup OR bul OR ell) AS kept,
       array_to_string(list_filter([CASE WHEN few THEN 'too few words' END, CASE WHEN rpt THEN 'repeated words' END, CASE WHEN len_ THEN 'word length' END,
         CASE WHEN sym THEN 'symbols' END, CASE WHEN nol THEN 'words without a letter' END, CASE WHEN stp THEN 'stop words' END,
         CASE WHEN dup THEN 'repeated lines' END, CASE WHEN bul THEN 'list lines' END, CASE WHEN ell THEN 'cut lines' END], lambda x: x IS NOT NULL), ',') AS failed
FROM f
"""
