"""The registered queries of the corpus operators, one for each, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haggle.llm import (byte_pairs, contamination, exact, hard_negatives, manifest, near, nearest, pages, passages, secrets, token_counts, token_files,
                        toxicity)
from haggle.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_tokens(spark, files).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op6_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = byte_pairs.decode(byte_pairs.encode(table(spark, sf_dir, "documents"), path), path)
    decimal = F.concat_ws(" ", F.transform("ids", lambda x: x.cast("string")))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op4_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit, ids = F.size("hits").cast("long"), F.col("item_ids")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query
def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op10_exact"] = """
SELECT doc_id, MAX(doc_id) OVER w AS keep_id, COUNT(*) OVER w AS group_size, doc_id = MAX(doc_id) OVER w AS kept,
       sha256(COALESCE(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY COALESCE(text, ''))"""

ORACLES["op4_contamination"] = r"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
win AS (SELECT item_id, len(w) AS n, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) END) AS k
        FROM iw),
keys AS (SELECT DISTINCT item_id, LEAST(n, 10) AS n, k FROM win),
dw AS (SELECT doc_id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM keys),
grams AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM dw, sizes WHERE len(w) >= n),
hit AS (SELECT g.doc_id, g.i, g.n, k.item_id FROM grams g JOIN keys k ON k.n = g.n AND k.k = array_to_string(g.w[g.i:g.i + g.n - 1], ' ')),
pos AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, COALESCE(p.n_hit, 0) AS n_hit, COALESCE(t.n_items, 0) AS n_items,
       sha256(COALESCE(t.ids, '')) AS items_sha256, COALESCE(p.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN pos p USING (doc_id) LEFT JOIN its t USING (doc_id)"""


@query
def op5_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.near_components(table(spark, sf_dir, "documents"), size=3, low=85, high=100)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    scores = toxicity.score(docs, model)
    return scores.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


@query
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


ORACLES["op11_hard_negatives"] = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
             CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(ROW_NUMBER() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INT) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""


@query
def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


ORACLES["op12_nearest"] = """
WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT a.vec_id AS query_id, b.vec_id,
             sqrt(list_reduce(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])), lambda x, y: x + y)) AS score
      FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0)
SELECT query_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INT) AS rank, vec_id, score FROM d QUALIFY rank <= 10"""


@query
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = manifest.manifest(table(spark, sf_dir, "documents"), plain, [*plain[:-1], lowered], chosen)
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


ORACLES["op13_manifest"] = """
WITH RECURSIVE f AS (
    SELECT doc_id, lang, text, list_reduce([4294967295] || list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ord(CAST(doc_id AS VARCHAR)[i]) AS BIGINT)),
               lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc,
           concat(COALESCE(concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id), '-'), COALESCE(concat(strlen(source), ':', source), '-') ,
                  COALESCE(concat(strlen(lang), ':', lang), '-'), COALESCE(concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars), '-')) AS head
    FROM (SELECT doc_id, source, lang, n_chars, text FROM documents)),
g AS (SELECT doc_id, lang, sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS leaf,
             CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN
                 sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) END)) END AS found
      FROM f),
leaves AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, COUNT(*) OVER (PARTITION BY lang) AS n FROM g),
t AS (SELECT 0 AS lvl, lang, pos, n, leaf AS digest FROM leaves
      UNION ALL
      SELECT lvl + 1, lang, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lvl, lang, pos // 8, n),
subs AS (SELECT lang, digest, ROW_NUMBER() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, COUNT(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, pos, n, digest FROM subs
      UNION ALL
      SELECT lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 8, n),
tops AS (SELECT lang, MAX(lvl) AS h FROM t GROUP BY lang),
nodes AS (SELECT lvl, lang, pos, n, digest FROM t WHERE n > 1
          UNION ALL SELECT lvl + h, lang, u.pos, u.n, u.digest FROM u, tops WHERE u.n > 1),
sib AS (SELECT lvl, lang, pos, COALESCE(string_agg(digest, '' ORDER BY pos) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
               COALESCE(string_agg(digest, '' ORDER BY pos) OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
        FROM nodes WINDOW r AS (PARTITION BY lvl, lang, pos // 8 ORDER BY pos)),
fold AS (SELECT 0 AS lvl, doc_id, leaves.lang, leaf, leaves.pos AS first, COALESCE(found, leaf) AS cur, '' AS path, leaves.pos, h, subs.digest AS subroot, subs.pos AS sub_pos
         FROM leaves JOIN tops ON tops.lang IS NOT DISTINCT FROM leaves.lang JOIN subs ON subs.lang IS NOT DISTINCT FROM leaves.lang
         UNION ALL
         SELECT fold.lvl + 1, doc_id, fold.lang, leaf, first, sha256(concat(l, cur, r)), concat(path, l, r),
                CASE WHEN fold.lvl + 1 = h THEN sub_pos ELSE fold.pos // 8 END, h, subroot, sub_pos
         FROM fold JOIN sib ON sib.lvl = fold.lvl AND sib.lang IS NOT DISTINCT FROM fold.lang AND sib.pos = CASE WHEN fold.lvl = h THEN sub_pos ELSE fold.pos END)
SELECT doc_id, leaf, subroot, (SELECT digest FROM u WHERE n = 1) AS root, sha256(path) AS proof_sha256, cur AS folded_root,
       cur = (SELECT digest FROM u WHERE n = 1) AS verified
FROM fold QUALIFY lvl = MAX(lvl) OVER (PARTITION BY lang, first)"""
