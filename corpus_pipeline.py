"""The corpus pipeline: quality rules, line dedup, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. A driver may write a stage's result and read it again for
the next one. Only the first stage reads another table: labels, which its bands are fitted on.

Null and empty texts have no words and go in the first stage; a stage called by itself
keeps them as empty texts (the last gives them one piece, the end token). Repeated rows
stay apart, but for the third stage, where rows of one id are one group; rows without
an id are in no group and stay. Columns beside those of documents are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentloom.llm.common import after_free_caches, materialise, remove_table, settled
from momentloom.llm.jaccard import jaccard_components
from momentloom.llm.line_dedup import dedup_lines
from momentloom.llm.packing import pack, token_pieces
from momentloom.llm.quality import bands_of, judged, quality_rules
from momentloom.llm.substring_dedup import dedup_substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(changed: DataFrame) -> DataFrame:
    """The columns of documents, with kept as the text."""
    return changed.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged. Without labels only the base rule decides.

    The written table holds measures, not texts, as it stays while later stages run. A verdict follows from
    text and language alone; it meets its rows by the id and two 64-bit hashes of these.
    """
    own = docs.select(COLUMNS)
    judged_by = (F.coalesce("text", F.lit("")), F.col("lang").isNull(), "lang")
    own = own.select("*", F.xxhash64(*judged_by).alias("a"), F.xxhash64(F.lit(1), *judged_by).alias("b"))
    measured = materialise(quality_rules(own, keep=("lang", "a", "b")))
    bands = bands_of(measured, spark.read.parquet(f"{sf_dir}/labels.parquet"), hold_out=(5, 0))
    kept = judged(measured, bands).filter("kept").select(F.col("doc_id").alias("i"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    return own.join(after_free_caches(kept), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")), "left_semi").select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them hold."""
    return _with_text(dedup_lines(docs, min_docs=10, min_chars=1, keep=("lang", "source")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates (five words, 0.8); rows without an id stay."""
    groups = jaccard_components(docs, width=5, threshold=80)
    others = groups.filter("doc_id != component_id").select("doc_id").distinct()
    left = docs.join(others, "doc_id", "left_anti").select(COLUMNS)
    # Repeated rows of one id are one group too; the join has dealt the rows by doc_id already.
    return left.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(left.filter("doc_id is null"))


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences of passages that another document, or the text before, has had."""
    return _with_text(dedup_substrings(docs, run=3, keep=("lang", "source")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences of 1024."""
    return pack(token_pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("substring_dedup", passage_stage),
    ("packing", packing_stage),
]

#: SQL can't run the tokenisers that the first and the last stage need.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each one's result is written, and what it was made from is removed: stages read their input several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        remove_table(before)
    return STAGES[-1][1](spark, docs, sf_dir)
