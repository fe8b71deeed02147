"""Mixing sources to target weights (DataFrame operations only).

Token counts are summed per source, every source gets a target by weight, and each document is
emitted ``floor(rate)`` times plus once more where a hash-seeded coin falls below the fraction of the
rate. The coin depends on the seed and the document's id alone, so reruns and any partitioning agree.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; a null
id has the coin of the empty string, and rows that repeat an id share its coin; a source without
tokens has target 0 and gives nothing; an empty table gives an empty result. Other columns pass
through untouched, whatever their names: the three working columns begin with a reserved ``__tessera_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.store import Store, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: A source table up to this many rows is joined by broadcast (it is counted first); a larger one by sort-merge.
BROADCAST_SOURCES = 20_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sizes``: (source, size) rows. Returns one row per source: source, source_size, weight, target, rate.

    Sources in code-point order, null last, weigh ``weights`` in turn. Targets share the total of all
    sizes by weight; none exceeds ``cap`` times its source and what is cut goes to the others by
    weight until none is above. That is water-filling: with sources ordered by cap/weight, those below
    the water level take their cap and the level is (total - caps below) / (weights above). Sums stay
    whole numbers until one division, so the result has no order of additions in it."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("i") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))).withColumn("weight", w.cast("long"))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    # caps below the water come first: cap * size / weight, compared without division by sorting on a decimal quotient
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "i").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = (
        per.withColumn("below", F.coalesce(F.sum(big("source_size") * cap).over(order), F.lit(0).cast("decimal(38,0)")))
        .withColumn("used", F.coalesce(F.sum("weight").over(order), F.lit(0)))
        .withColumn("total", F.sum(big("source_size")).over(every))
        .withColumn("all_w", F.sum("weight").over(every))
    )
    rest, above = F.col("total") - F.col("below"), F.col("all_w") - F.col("used")
    # the first source, in this order, whose cap is not under the level fixes the level for all from it on
    fits = rest * F.col("weight") <= big("source_size") * cap * above
    per = per.withColumn("level", F.min(F.when(fits, F.struct(F.col("source_size") / F.col("weight"), "i", rest.alias("rest"), above.alias("above")))).over(every))
    share = F.col("level.rest").cast("double") * F.col("weight").cast("double") / F.col("level.above").cast("double")
    full = (F.col("source_size") * cap).cast("double")
    target = F.when(F.col("level").isNull(), full).otherwise(F.least(full, share))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "weight", "target", "rate")


def coin(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) fixed by the seed and the id: 52 bits of a digest, exact as a double."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def plan_mix(spark: SparkSession, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``sizes``: (doc_id, source, size), read more than once, so give a stored table. Adds
    source_size, target, rate and copies to every row."""
    store = Store(spark, "mix")
    per = store.stage(targets(sizes.select("source", "size"), weights, cap), "targets")
    few = per.count() <= BROADCAST_SOURCES
    key = lambda c: F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), c))
    right = per.select(key(F.col("source")).alias("k"), "source_size", "target", "rate")
    out = sizes.withColumn("k", key(F.col("source"))).join(F.broadcast(right) if few else right, "k").drop("k")
    whole = F.floor("rate")
    return out.withColumn("copies", (whole + F.when(coin(F.col("doc_id"), seed) < F.col("rate") - whole, 1).otherwise(0)).cast("int"))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every column of ``docs``, each document as often as the mix takes it."""
    per = Store(spark, "mix").stage(targets(docs.select("source", size_of(F.col("text")).alias("size")), weights, cap), "targets")
    few = per.count() <= BROADCAST_SOURCES
    right = per.select(F.col("source").alias("__tessera_source"), F.col("rate").alias("__tessera_rate"))
    out = docs.join(F.broadcast(right) if few else right, docs["source"].eqNullSafe(right["__tessera_source"]))
    rate = F.col("__tessera_rate")
    copies = (F.floor(rate) + F.when(coin(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)).cast("int")
    out = out.withColumn("__tessera_copy", F.explode(F.array_repeat(F.lit(True), copies)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", size_of(F.col("text")).alias("size"))
    sizes = Store(spark, "mix").stage(docs, "sizes")
    plan = plan_mix(spark, sizes)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM sized GROUP BY source),
w AS (SELECT source, s, i, CASE (i - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM per),
cum AS (
  SELECT *, coalesce(sum(3 * s) OVER o, 0) AS below, coalesce(sum(weight) OVER o, 0) AS used, sum(s) OVER () AS total, sum(weight) OVER () AS all_w
  FROM w WINDOW o AS (ORDER BY s / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (
  SELECT CAST(total - below AS DOUBLE) AS rest, CAST(all_w - used AS DOUBLE) AS above FROM cum
  WHERE (total - below) * weight <= 3 * s * (all_w - used) ORDER BY s / weight, i LIMIT 1),
t AS (
  SELECT source, CAST(s AS BIGINT) AS source_size,
    least(CAST(3 * s AS DOUBLE), coalesce((SELECT rest FROM lev) * weight / (SELECT above FROM lev), CAST(3 * s AS DOUBLE))) AS target FROM w),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
c AS (
  SELECT z.doc_id, z.size, r.source_size, r.target, z.source,
    CAST(floor(rate) + CASE WHEN CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(z.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies
  FROM sized z JOIN r ON z.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies, source FROM c
"""
