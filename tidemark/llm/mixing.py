"""Mixing sources to target weights by capped water-filling, with DataFrame functions alone.

Every source wants its weight's share of all words; one whose share is above ``max_epochs`` times its
words stops there, and what it leaves is shared out among the others by weight until none is above.
Each source's words are then taken as whole repetitions and a seeded fractional one: documents stand in
the order of a seeded hash, those below the mark come once more, and the one on the mark gives just the
words that are missing. The mark is found from word counts by hash range, so no source, however
large, is sorted whole: only the documents of the one range that holds the mark are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, small_enough, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def drawn(seed: int, *key: Column) -> Column:
    """A seeded hash as text; md5, so that other engines can check it."""
    return F.md5(F.concat(F.lit(f"{seed}:"), *key))


def ranked(sources: DataFrame) -> DataFrame:
    """Sources by code point with nulls last, numbered from 0: sorted by range, counted by partition."""
    # a written sorted table keeps its order within files, not over them: the number is of (partition, row)
    numbered = written(sources.orderBy(F.col("tm_source").asc_nulls_last()).withColumn("tm_at", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("tm_at", 33)
    parts = numbered.groupBy(part.alias("tm_part")).agg(F.count(F.lit(1)).alias("tm_n"))
    before = parts.withColumn("tm_before", F.sum("tm_n").over(Window.orderBy("tm_part").rowsBetween(Window.unboundedPreceding, -1)))  # one row for each partition
    row = F.col("tm_at") - F.shiftleft(F.col("tm_part"), 33)
    return numbered.withColumn("tm_part", part).join(F.broadcast(before.drop("tm_n")), "tm_part").withColumn("tm_rank", F.coalesce("tm_before", F.lit(0)) + row).drop("tm_part", "tm_before", "tm_at")


def water_filled(sources: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Adds tm_target. Each round is one sum over the sources; the level only rises, and it stops when no
    further source reaches its cap."""
    by_rank = F.array(*(F.lit(float(w)) for w in weights))
    sources = sources.withColumn("tm_weight", F.element_at(by_rank, (F.col("tm_rank") % len(weights) + 1).cast("int")))
    cap = F.col("tm_source_size") * float(max_epochs)
    level, n_capped = 0.0, -1
    while True:
        capped = cap <= level * F.col("tm_weight")
        r = sources.agg(
            F.sum("tm_source_size").alias("total"), F.count_if(capped).alias("n"),
            F.sum(F.when(capped, cap).otherwise(0.0)).alias("capped"), F.sum(F.when(capped, 0.0).otherwise(F.col("tm_weight"))).alias("weight"),
        ).first()
        if r["n"] == n_capped or not r["weight"]:
            break
        n_capped, level = r["n"], (float(r["total"]) - r["capped"]) / r["weight"]
    return sources.withColumn("tm_target", F.least(cap, level * F.col("tm_weight"))).drop("tm_weight", "tm_rank")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its id, then tm_size, tm_source, tm_source_size, tm_target, tm_taken, tm_draw, and the
    columns named in ``keep``.

    Null texts have size 0; null sources are one source, the last. A source without words has the target 0. Rows
    that repeat an id draw alike, each its own way by text; equal rows in all are told apart by order alone, so what they take together
    is as defined. An empty table gives no rows. The same rows always take the same."""
    extra = [F.col(f"`{c}`") for c in dict.fromkeys(keep) if c != id_col]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    draw = drawn(seed, F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")))
    sized = docs.select(
        F.col(f"`{id_col}`"), *extra,
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tm_size"), F.col(f"`{source_col}`").cast("string").alias("tm_source"), draw.alias("tm_draw"),
    ).withColumn("tm_range", F.substring("tm_draw", 1, 3))
    counted = sized if extra else written(sized, "mix-sizes")
    ranges = written(counted.groupBy("tm_source", "tm_range").agg(F.sum("tm_size").alias("tm_words")), "mix-ranges")
    sources = water_filled(ranked(ranges.groupBy("tm_source").agg(F.sum("tm_words").alias("tm_source_size"))), weights, max_epochs)
    # repetitions: whole ones for every document, then this many words of one more
    size, target = F.col("tm_source_size"), F.col("tm_target")
    whole = F.when(size > 0, F.floor(target / size)).otherwise(0)
    sources = sources.withColumn("tm_whole", whole).withColumn("tm_more", F.greatest(F.lit(0), F.round(target).cast("long") - F.col("tm_whole") * size))
    upto = Window.partitionBy("tm_source").orderBy("tm_range").rowsBetween(Window.unboundedPreceding, -1)  # 4096 ranges a source at most
    marks = ranges.withColumn("tm_below", F.coalesce(F.sum("tm_words").over(upto), F.lit(0))).join(sources.withColumnRenamed("tm_source", "tm_s"), F.col("tm_source").eqNullSafe(F.col("tm_s"))).drop("tm_s")
    marks = written(marks, "mix-marks")

    # range by range: wholly below the mark, wholly above, or holding it (at most one range a source)
    on = [F.col("tm_range") == F.col("tm_r"), F.col("tm_source").eqNullSafe(F.col("tm_s"))]
    side = marks.withColumnsRenamed({"tm_source": "tm_s", "tm_range": "tm_r"})
    held = (F.col("tm_below") < F.col("tm_more")) & (F.col("tm_more") < F.col("tm_below") + F.col("tm_words"))
    per_range = F.broadcast(side) if small_enough(side, F.coalesce(F.octet_length("tm_s"), F.lit(0)) + 128) else side
    placed = counted.join(per_range, on).drop("tm_s", "tm_r")
    order = [F.col("tm_draw"), F.col(f"`{id_col}`"), F.col("tm_size")]
    before = Window.partitionBy("tm_source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on_mark = placed.where(held).withColumn("tm_at", F.col("tm_below") + F.coalesce(F.sum("tm_size").over(before), F.lit(0)))
    rest = placed.where(~held).withColumn("tm_at", F.col("tm_below"))
    more = F.when(held, F.least(F.col("tm_size"), F.greatest(F.lit(0), F.col("tm_more") - F.col("tm_at")))).when(F.col("tm_below") < F.col("tm_more"), F.col("tm_size")).otherwise(F.lit(0))
    return on_mark.unionByName(rest).withColumn("tm_taken", F.col("tm_whole") * F.col("tm_size") + more).select(
        F.col(f"`{id_col}`"), *extra, "tm_size", "tm_source", "tm_source_size", "tm_target", F.col("tm_taken").cast("long"), "tm_draw"
    )


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is rounded to a millionth of a word, as sums of doubles differ in their last bits between engines."""
    mixed = mix_sources(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("tm_size").alias("size"), F.col("tm_source_size").alias("source_size"), F.round("tm_target", 6).alias("target"), F.col("tm_taken").alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('7:' || coalesce(doc_id::VARCHAR, 'null')) AS draw FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source
), o AS (
  SELECT *, sum(source_size) OVER () AS total, coalesce(sum(3.0::DOUBLE * source_size) OVER b, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS left_weight
  FROM s WINDOW b AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lv AS (
  -- the level is that at the first source, by cap over weight, which stays below its cap
  SELECT coalesce(max((total - capped) / left_weight), 0) AS level FROM o WHERE (total - capped) / left_weight < 3.0::DOUBLE * source_size / weight
), t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, level * weight) AS target FROM s, lv
), w AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target,
  (whole * size + least(size, greatest(0, greatest(0, round(target)::BIGINT - whole * source_size) - below)))::BIGINT AS taken
FROM w
"""
