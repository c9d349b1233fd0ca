"""The queries of this folder's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_decode, bpe_encode
from .classifier import fit_quality, score_quality
from .common import crc_mod, materialise, table
from .ctw import score_texts
from .filter_audit import filter_audit
from .jaccard import jaccard_components
from .line_dedup import LOWER, UPPER, dedup_lines
from .media import read_media, store_media
from .minhash import minhash_components
from .packing import pack, token_pieces
from .quality import bands_of, judged, quality_rules
from .substring_dedup import dedup_substrings
from .toxicity import fit_toxicity, score_toxicity
from .vector_codes import vector_codes


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_decode(bpe_encode(table(spark, sf_dir, "documents")))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(table(spark, sf_dir, "documents")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = f"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM rows_),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
marked AS (SELECT keyed.*, common.k IS NOT NULL AS gone FROM keyed LEFT JOIN common ON keyed.k = common.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=4, threshold=85)


def component_sql(width: int, threshold: int, more: str = "") -> str:
    """Documents linked by their sets of shingles, by all pairs that share one."""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - {width} + 2), lambda i: array_to_string(ws[i:i + {width} - 1], ' ')) END) AS s FROM w)),
cnt AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM both_ JOIN cnt p ON x = p.doc_id JOIN cnt q ON y = q.doc_id WHERE 100 * i >= {threshold} * (p.n + q.n - i)),
reach AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, l.y FROM reach r JOIN links l ON r.c = l.x)
SELECT d.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(c) AS component_id{more}
FROM documents d JOIN reach r ON d.doc_id = r.d LEFT JOIN cnt ON cnt.doc_id = d.doc_id GROUP BY d.doc_id
"""


OP4_SQL = component_sql(4, 85)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_media(store_media(table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("thumbnail").cast("long").alias("payload_bytes"),
        F.sha2("thumbnail", 256).alias("payload_sha256"),
        "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumbnail_hash").alias("feature"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Measured once: the bands and the verdicts both follow from the measures.
    measured = materialise(quality_rules(docs, keep=("lang",)))
    return judged(measured, bands_of(measured, table(spark, sf_dir, "labels"), hold_out=(5, 0))).drop("lang")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_toxicity(docs, fit_toxicity(docs, labels, hold_out=(5, 0)))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), run=3)


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), hold_out=(7, 2))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_quality(docs, fit_quality(docs, labels, hold_out=(4, 2)))
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Counts documents by what they fail, then walks every order; no polynomial.
OP11_SQL = """
WITH own AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
said AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS bad FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM own LEFT JOIN said USING (doc_id)),
kinds AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS f,
         count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM fails GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS o FROM l p, l q, l r, l s, l t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT o, k::INT AS step, o[k] AS letter, o[1:k - 1] AS before FROM orders, range(1, 6) g(k)),
rows_ AS (
  SELECT part, o, step, letter, n, good, bad, contains(f, letter) AS own, len(regexp_extract_all(f, '[' || before || '_]')) > 0 AS gone, f = letter AS alone FROM kinds, steps),
sums AS (
  SELECT part, o, step, letter, coalesce(sum(n) FILTER (WHERE NOT own AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE own AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE own AND gone), 0) AS redundant, coalesce(sum(n) FILTER (WHERE alone), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE own AND NOT gone), 0) AS good_lost, coalesce(sum(bad) FILTER (WHERE own AND NOT gone), 0) AS toxic_lost
  FROM rows_ GROUP BY ALL)
SELECT part, o AS filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM sums
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def lloyd_sql(rounds: int = 4) -> str:
    """Plain Lloyd rounds: every part against every entry."""
    nearest = """
a{k} AS MATERIALIZED (
  SELECT r, p, min({{'d': xx - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'e': e}}) AS best FROM parts JOIN b{k} USING (p) GROUP BY r, p)"""
    moved = """
s{k} AS (SELECT p, best.e AS e, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM a{k} JOIN parts USING (r, p), range(1, w + 1) g(i) GROUP BY ALL),
m{k} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS c FROM s{k} GROUP BY p, e),
b{n} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (p, e))"""
    steps = ",".join((nearest + "," + moved).format(k=k, n=k + 1) for k in range(rounds)) + "," + nearest.format(k=rounds)
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id, v) - 1 AS r, len(v) // 4 AS w FROM kept),
cut AS (SELECT r, w, p, v[p * w + 1:(p + 1) * w] AS x FROM numbered, range(4) g(p)),
parts AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM cut),
b0 AS MATERIALIZED (SELECT p, r AS e, x AS c FROM parts WHERE r < 256),{steps},
codes AS (SELECT r, string_agg(printf('%02x', (best.e)::BIGINT), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY r),
book AS (SELECT sha256(string_agg(list_aggregate(list_transform(c, lambda y: (y::BIGINT)::VARCHAR), 'string_agg', ','), ',' ORDER BY p, e)) AS h FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM codes JOIN numbered USING (r), book
"""


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"), width=3, threshold=85)


OP13_SQL = component_sql(3, 85, ", d.doc_id = min(c) AS kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_sum_of_squares_packing": op2_sum_of_squares_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_media_columns": op5_media_columns,
    "op6_quality_rules": op6_quality_rules,
    "op7_toxicity": op7_toxicity,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_context_tree": op9_context_tree,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_filter_audit": op11_filter_audit,
    "op12_vector_codes": op12_vector_codes,
    "op13_minhash": op13_minhash,
}

SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op4_ngram_jaccard": OP4_SQL, "op11_filter_audit": OP11_SQL, "op12_vector_codes": lloyd_sql(), "op13_minhash": OP13_SQL}
