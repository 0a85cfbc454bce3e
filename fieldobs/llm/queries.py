"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldobs.llm import (ann, fim, langid, linededup, lmscore, mixing, neardup, packing, piecebpe, quality, runs, topk,
                          toxicity)
from fieldobs.llm.common import id_remainder, table


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose labels may be learned from."""
    return table(spark, sf_dir, "documents").where(id_remainder(F.col("doc_id"), 5) != 0).select("doc_id", "text")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), quality.fit(training(spark, sf_dir), table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op2_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_products(vectors, vectors.where("vec_id % 20 = 0"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", "n_lines", "n_removed")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 7) == 2)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), path))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity.fit(training(spark, sf_dir), table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "epochs", "cut")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    told = langid.identify(docs, langid.fit(docs, ~held_out))
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"), seed=1, percent=90, spm_percent=20)
    return fim.restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op12_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    round_trip = piecebpe.decode(piecebpe.encode(table(spark, sf_dir, "documents"), path), path)
    return round_trip.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                             F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.collapse(runs.planted(table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (
    op1_ann_search, op2_threshold_topk, op3_line_dedup, op4_lm_scoring, op5_minhash_near_dedup, op6_quality, op7_best_fit_packing,
    op8_toxicity, op9_source_mixing, op10_language_id, op11_fill_in_middle, op12_piece_encoding, op13_periodic_runs)}

LINES_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM {docs}),
w AS (SELECT doc_id, unnest(range(1, len(lines) - 1)) AS pos, lines FROM d WHERE len(lines) >= 3),
x AS (SELECT doc_id, pos, lines[pos] || chr(10) || lines[pos + 1] || chr(10) || lines[pos + 2] AS win
      FROM w WHERE trim(lines[pos], ' ') <> '' OR trim(lines[pos + 1], ' ') <> '' OR trim(lines[pos + 2], ' ') <> ''),
o AS (SELECT *, first_value(doc_id) OVER p AS first_doc, first_value(pos) OVER p AS first_pos
      FROM x WINDOW p AS (PARTITION BY win ORDER BY doc_id, pos)),
c AS (SELECT DISTINCT doc_id, unnest(range(
        CASE WHEN doc_id = first_doc THEN greatest(pos, first_pos + 3) ELSE pos END, pos + 3)) AS pos
      FROM o WHERE doc_id <> first_doc OR pos <> first_pos),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (c.pos IS NULL) AS kept,
             count(*) AS n_lines, count(c.pos) AS n_removed
      FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id)
"""

ORACLE = {
    "op2_threshold_topk": """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER o AS INTEGER) AS rank, vec_id, score FROM p
WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER o <= 20
""",
    "op3_line_dedup": LINES_SQL.format(docs="documents") + """
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.kept, '') END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
""",
    "op9_source_mixing": """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
                  md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
v AS (SELECT *, CASE n % 3 WHEN 1 THEN 5.0::DOUBLE WHEN 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             CAST(2 * source_size AS DOUBLE) AS bound FROM s),
a AS (SELECT *, bound / weight AS level FROM v),
b AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(bound) OVER r, 0))
               / (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0)) AS reach
      FROM a WINDOW r AS (ORDER BY level, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(reach, level) AS reach FROM b WHERE level > reach),
t AS (SELECT source, source_size, CASE WHEN level <= b.reach THEN bound ELSE least(bound, (SELECT reach FROM f) * weight) END AS target
      FROM b),
e AS (SELECT *, CAST(round(target) AS BIGINT) AS budget,
             CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM t),
g AS (SELECT d.doc_id, d.size, e.*, budget - whole * source_size - coalesce(sum(d.size) OVER (
             PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
h AS (SELECT *, CAST(least(greatest(room, 0), size) AS BIGINT) AS part FROM g)
SELECT doc_id, size, source_size, target, CAST(whole * size + part AS BIGINT) AS taken, source,
       CAST(CASE WHEN size > 0 THEN whole + CASE WHEN part = size THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS epochs,
       CAST(CASE WHEN part = size THEN 0 ELSE part END AS BIGINT) AS cut
FROM h
""",
    "op11_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
h AS (SELECT *, CAST('0x' || key[1:8] AS BIGINT) AS h1, CAST('0x' || key[9:16] AS BIGINT) AS h2,
             CAST('0x' || key[17:24] AS BIGINT) AS h3, CAST('0x' || key[25:32] AS BIGINT) AS h4,
             regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units FROM d),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS lo,
             greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS hi,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(units[1:lo], '') AS a, array_to_string(units[lo + 1:hi], '') AS b,
             array_to_string(units[hi + 1:], '') AS c FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
                        ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p
""",
}
