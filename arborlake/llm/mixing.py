"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Every source gets a target in words. Targets are in proportion to the weights as long as none asks
for more than ``max_epochs`` passes over its source; those that would are clamped there and the
excess goes to the others by weight, until the whole is feasible. A source then takes
``floor(target / size)`` whole passes over each of its documents, and for the fraction that is left
a seeded random order of its documents, as far as the fraction reaches.

Scale: a document moves once, as five narrow columns, to one of ``BUCKETS`` hash buckets of its
source, so that a source with a third of all rows is spread as evenly as any other; the only work
per source is over its buckets' sums, and the only global work is over one row per source.

Defined results: null or blank text has size 0 and takes 0; a null source is a source of its own,
last in order; an empty table gives no rows; rows that repeat a doc_id each count, and ties in the
random order go by doc_id, then size; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.llm.textops import WORD, n_words, table

BUCKETS = 4096
WEIGHTS, SHARE, MAX_EPOCHS, SEED = (5, 2, 1), 1.5, 2, "mix-1"


def water_fill(sizes: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """sizes: source, size, weight, one row per source. Adds target.

    The clamped sources are a prefix in order of cap / weight: source k is clamped if the level that
    the first k-1 leave to the rest is above its own cap / weight. One pass of running sums finds it.
    """
    cap = F.col("size") * F.lit(max_epochs)
    fill = W.orderBy(F.col("ratio").asc(), F.col("cap").asc(), F.col("weight").asc()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(fill), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
    return (
        sizes.withColumn("cap", cap.cast("double"))
        .withColumn("weight", F.col("weight").cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("size").over(everything) * F.lit(float(share)))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("own_level", level)
        .withColumn("level", F.max(F.when(F.col("own_level") <= F.col("ratio"), F.col("own_level"))).over(everything))
        .withColumn("target", F.when(F.col("own_level") > F.col("ratio"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.coalesce("level", "own_level"))))
        .drop("cap", "ratio", "total", "weights", "own_level", "level")
    )


def rank_weights(sizes: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """Weights by the code-point order of the source, repeating; a null source comes last."""
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))


def place(doc_id: str, seed: str) -> Column:
    """A seeded random place of a document: 32 hex digits."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))


def mix(docs: DataFrame, weights: DataFrame | None = None, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs: doc_id, text, source. weights: source, weight (else by rank). Returns doc_id, source, size, source_size, target, copies, taken."""
    at = F.col("place")
    base = docs.select("doc_id", "source", n_words("text").alias("size"), place("doc_id", seed).alias("place"))
    base = base.withColumn("bucket", F.conv(F.substring(at, 1, 3), 16, 10).cast("int")).withColumn("place", F.conv(F.substring(at, 4, 13), 16, 10).cast("long"))
    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sizes = sums.groupBy("source").agg(F.sum("bucket_size").alias("size"))
    if weights is None:
        sizes = rank_weights(sizes)
    else:
        given = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double"))
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source").filter("weight > 0")
    plan = water_fill(sizes, share, max_epochs).withColumnRenamed("size", "source_size").withColumnRenamed("source", "p_source")
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    starts = starts.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).select(F.col("source").alias("s_source"), F.col("bucket").alias("s_bucket"), "start", "source_size", "target")
    joined = base.join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("bucket") == F.col("s_bucket")))
    run = W.partitionBy("source", "bucket").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    middle = F.col("start") + F.sum("size").over(run) - F.col("size") / 2
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    extra = F.when(middle <= F.col("target") - F.col("whole") * F.col("source_size"), 1).otherwise(0)
    return (
        joined.withColumn("whole", whole)
        .withColumn("copies", F.when(F.col("source_size") > 0, F.col("whole") + F.when(F.col("whole") < max_epochs, extra).otherwise(0)).otherwise(0).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def take(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it, numbered by copy. Rows alike in id, source and size share one number of copies."""
    key = ["doc_id", "source", "size"]
    found = mix(docs, **options).groupBy(*key).agg(F.max("copies").alias("_copies")).filter("_copies > 0")
    found = found.select(*[F.col(c).alias(f"_{c}") for c in key], "_copies")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (n_words("text") == F.col("_size"))
    joined = docs.join(found, same)
    return joined.select(*[F.col(c) for c in docs.columns if c != "copy"], F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("copy"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_OP1 = f"""
WITH base AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5('{SEED}:' || COALESCE(doc_id::VARCHAR, '')) AS place FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS size FROM base GROUP BY source),
r AS (SELECT source, size, ([5.0::DOUBLE, 2.0, 1.0])[((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS weight FROM s),
c AS (SELECT *, size * 2.0::DOUBLE AS cap, size * 2.0::DOUBLE / weight AS ratio, SUM(size) OVER () * 1.5::DOUBLE AS total, SUM(weight) OVER () AS weights FROM r),
l AS (SELECT *, (total - COALESCE(SUM(cap) OVER f, 0)) / (weights - COALESCE(SUM(weight) OVER f, 0)) AS own_level FROM c
      WINDOW f AS (ORDER BY ratio, cap, weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, MAX(CASE WHEN own_level <= ratio THEN own_level END) OVER () AS level FROM l),
p AS (SELECT source, size AS source_size, CASE WHEN own_level > ratio THEN cap ELSE LEAST(cap, weight * COALESCE(level, own_level)) END AS target FROM m),
j AS (SELECT b.doc_id, b.size, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN floor(p.target / p.source_size)::BIGINT ELSE 0 END AS whole,
      SUM(b.size) OVER (PARTITION BY b.source ORDER BY b.place, b.doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - b.size / 2.0::DOUBLE AS middle
      FROM base b JOIN p ON b.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN size * (whole + CASE WHEN whole < 2 AND middle <= target - whole * source_size THEN 1 ELSE 0 END) ELSE 0 END)::BIGINT AS taken
FROM j
"""
