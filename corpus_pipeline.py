"""From raw documents to packed sequences, in five stages; each is a (name, function) of STAGES.

Every function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, line_dedup, mixing, packing, quality, shingle_dedup

#: Word shingles of the near-duplicate stage.
SHINGLE_WORDS = 5


def with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the documents, n_chars counted anew where there is one."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*(f"`{c}`" for c in columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_scores(docs, labels).where("tm_kept").select(*(f"`{c}`" for c in docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the long lines that many documents share; the largest id keeps each. Every document stays."""
    return with_length(line_dedup.line_dedup(docs), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: fingerprints at most three bits apart, or a Jaccard
    similarity of 0.8 or more over the shingles. Rows that repeat an id stay or go together."""
    groups = shingle_dedup.near_groups(docs, words_each=SHINGLE_WORDS)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("tm_kept_id")).distinct()
    kept = common.written(kept, "near-copies-kept")
    side = F.broadcast(kept) if common.small_enough(kept) else kept
    return docs.join(side, docs["doc_id"].eqNullSafe(side["tm_kept_id"]), "left_semi")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them: the one on a source's mark comes once more if half of it is
    wanted. Documents without words are not taken."""
    mixed = mixing.mix_sources(docs, keep=tuple(docs.columns))
    times = F.when(F.col("tm_size") > 0, F.floor(F.col("tm_taken") / F.col("tm_size") + 0.5)).otherwise(0).cast("int")
    return mixed.withColumn("tm_times", times).where("tm_times > 0").withColumn("tm_copy", F.explode(F.sequence(F.lit(1), F.col("tm_times")))).select(*(f"`{c}`" for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each copy's own, placed in sequences."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, f"stage-{k}")
    return docs


#: A classifier that is fitted and a packing that is planned are beyond SQL; tests compare with brute force.
ORACLE_SQL = None
