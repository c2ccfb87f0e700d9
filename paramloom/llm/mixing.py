"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Targets: sources in code point order (null last) have weights that repeat a cycle; the mix has `share` times
all words; a source's target stops at `most` times its words and the excess goes to the others by weight.
A source with target t and size s takes every document floor(t / s) times; the rest of its target comes from a
sample whose documents have inclusion probability p = (t mod s) / s, or with weights p = min(1, c w) where c makes the
expected words equal the rest (documents with c w >= 1 are certain; c is found for the others, until none is
added): each gets the random odds u / (1 - u) over its inclusion odds p / (1 - p), and the smallest ranks are taken until the words
reach the target. u comes from a hash of doc_id and the seed, so reruns agree.

A rank bound is found from per-source histograms over the rank (bins in proportion to the rows), so no source
is ever sorted in one task: only the one bin that holds the bound is ordered.

Defined cases: null or blank texts have size 0 and take 0; an empty table gives an empty mix; null sources are
one source; rows that repeat a doc_id are ranked by their text's hash, equal rows in any order; weights that are null,
NaN or negative count as 0, and such documents come last; input columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, materialize
from .scratch import few as few_rows

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: sources up to which their sums, one row each, are broadcast after counting them
MOST_SOURCES = 100_000
#: rows a histogram bin holds on average, and the least number of bins
BIN_ROWS, LEAST_BINS = 2000, 64


def words(text: Column) -> Column:
    """Number of maximal runs of characters other than space, tab, LF, VT, FF, CR (null: 0)."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(seed: str) -> Column:
    """Uniform in (0, 1) from the md5 of seed and doc_id: (first 52 bits + 1/2) / 2^52."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10)
    return (bits.cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size), one row a source -> with weight and target (water filling in closed form).

    Sources ordered by cap / weight: the first k are capped for the smallest k at which the level that the
    others share stays below the next source's cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    s = (
        s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("w_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    )
    level = (F.col("total") - F.col("cap_before")) / F.col("w_left")
    s = s.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    s = s.withColumn("level", F.max("level").over(everything))
    goal = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return s.select("source", goal.alias("target"))


def scales(rated: DataFrame) -> DataFrame:
    """(_s, _scale): the factor c of each source with sum of min(1, c w) size = _rest; rated: source, size, _w, _rest.

    Starts without certain documents; each round sets those with c w >= 1 apart and shares what is left of _rest among
    the others, so c and the certain documents only grow, and the rounds end when no source has new ones.
    """
    level = rated.groupBy("source").agg(F.lit(0).cast("long").alias("_sure"), (F.max("_rest") / F.nullif(F.sum(F.col("_w") * F.col("size")), F.lit(0.0))).alias("_scale"))
    level = materialize(level.select(F.col("source").alias("_s"), "_sure", F.coalesce("_scale", F.lit(0.0)).alias("_scale")), "scales")
    while True:
        small = few_rows(level, MOST_SOURCES)
        joined = rated.join(F.broadcast(level) if small else level, F.col("source").eqNullSafe(F.col("_s")))
        certain = F.col("_scale") * F.col("_w") >= 1
        sums = joined.groupBy("_s").agg(
            F.max("_rest").alias("_rest"), F.max("_sure").alias("_old"), F.max("_scale").alias("_last"),
            F.sum(F.when(certain, F.col("size")).otherwise(0)).alias("_sure"),
            F.sum(F.when(certain, 0.0).otherwise(F.col("_w") * F.col("size"))).alias("_free"),
        )
        scale = F.when(F.col("_free") > 0, F.greatest(F.col("_last"), (F.col("_rest") - F.col("_sure")) / F.col("_free"))).otherwise(F.col("_last"))
        after = materialize(sums.select("_s", "_sure", "_old", scale.alias("_scale")), "scales")
        done = few_rows(after.where("_sure > _old"), 0)
        discard(level)
        level = after.drop("_old")
        if done:
            return level.select("_s", "_scale")
        level = materialize(level, "scales")
        discard(after)


def mix(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, share: float = SHARE, most: float = MOST, weight: str | None = None) -> DataFrame:
    """docs with size, source_size, target, copies (times the document is taken) and taken (copies * size).

    weight: a column of positive relative inclusion weights within a source (default: all alike).
    """
    base = docs.withColumn("size", words(F.col("text"))).withColumn("_u", draw(seed))
    tie = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    key = base.select("doc_id", "source", "size", "_u", tie.alias("_tie"), *([F.when(F.isnan(F.col(weight).cast("double")), 0.0).otherwise(F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))).alias("_w")] if weight else [F.lit(1.0).alias("_w")]))
    key = materialize(key, "sizes")
    stats = key.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    stats = materialize(stats, "sources")
    goals = stats.join(targets(stats.select("source", "source_size"), weights, share, most).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    goals = goals.select(
        F.col("source").alias("_s"), "source_size", "target",
        F.greatest(F.lit(LEAST_BINS), F.ceil(F.col("_rows") / BIN_ROWS)).cast("long").alias("_bins"),
    )
    goals = materialize(goals, "targets")
    # one row a source: pre-aggregated; broadcast only below a checked count
    few = few_rows(goals, MOST_SOURCES)
    rated = key.join(F.broadcast(goals) if few else goals, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rated = rated.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    share_left = F.when(F.col("source_size") > 0, F.col("_rest") / F.col("source_size")).otherwise(F.lit(0.0))
    p = share_left
    if weight:
        scale = scales(rated)
        rated = rated.join(F.broadcast(scale) if few else scale, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        p = F.least(F.col("_scale") * F.col("_w"), F.lit(1.0))
    # rank = (u / (1 - u)) / (p / (1 - p)); kept as rank / (1 + rank) to lie in [0, 1]
    up, down = F.col("_u") * (1 - F.col("_p")), (1 - F.col("_u")) * F.col("_p")
    rated = rated.withColumn("_p", p).withColumn("_rank", F.when(F.col("_p") <= 0, F.lit(1.0)).otherwise(up / (up + down)))
    rated = rated.withColumn("_bin", F.least(F.floor(F.col("_rank") * F.col("_bins")), F.col("_bins") - 1))
    open_ = rated.where((F.col("_rest") > 0) & (F.col("size") > 0))
    bins = open_.groupBy("source", "_bin").agg(F.sum("size").alias("_in"), F.first("_rest").alias("_goal"))
    run = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bound = bins.withColumn("_below", F.sum("_in").over(run) - F.col("_in")).where((F.col("_below") < F.col("_goal")) & (F.col("_below") + F.col("_in") >= F.col("_goal")))
    bound = materialize(bound.select(F.col("source").alias("_s"), F.col("_bin").alias("_edge"), "_below"), "bounds")
    same = F.col("source").eqNullSafe(F.col("_s"))
    marked = rated.join(F.broadcast(bound) if few else bound, same, "left").drop("_s")
    inside = (F.col("size") > 0) & (F.col("_rest") > 0)
    edge = marked.where(inside & (F.col("_bin") == F.col("_edge")))
    order = Window.partitionBy("source", "_bin").orderBy("_rank", F.col("doc_id").asc_nulls_last(), "_tie", "size")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    # a document of the edge is taken if that brings the words nearer to the target than leaving it out
    edge = edge.withColumn("_sum", F.col("_below") + F.sum("size").over(upto)).withColumn("_extra", (F.col("_sum") - F.col("size") / 2.0 <= F.col("_rest")).cast("long"))
    rest = marked.where(~F.coalesce(inside & (F.col("_bin") == F.col("_edge")), F.lit(False)))
    rest = rest.withColumn("_extra", (inside & (F.col("_edge").isNull() | (F.col("_bin") < F.col("_edge")))).cast("long"))
    cols = ["doc_id", "source", "_tie", "size", "source_size", "target", (F.col("_whole") + F.col("_extra")).alias("copies")]
    return rest.select(*cols).unionByName(edge.select(*cols)).withColumn("taken", F.col("copies") * F.col("size"))


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u, coalesce(text, '') AS text FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total,
    sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0) AS w_left, coalesce(sum(cap) OVER b, 0.0) AS cap_before
    FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, max(CASE WHEN (total - cap_before) / w_left * weight <= cap THEN (total - cap_before) / w_left END) OVER () AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM v),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, target - whole * source_size AS rest, CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0.0 END AS p FROM r),
k AS (SELECT *, CASE WHEN p <= 0 THEN 1.0 ELSE u * (1 - p) / (u * (1 - p) + (1 - u) * p) END AS rk FROM q),
c AS (SELECT *, CASE WHEN size > 0 AND rest > 0 THEN sum(size) OVER (PARTITION BY source, size > 0 ORDER BY rk, doc_id NULLS LAST, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS upto FROM k)
SELECT doc_id, size, source_size, target,
  CAST((whole + CASE WHEN upto IS NOT NULL AND upto - size / 2.0 <= rest AND upto - size < rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM c
"""
