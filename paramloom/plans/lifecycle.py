"""Plan compilation as DataFrame passes: steps of trials and elements, their edges, coalescing, sentinels.

elements (element, level, health), links (src, dst, kind): src depends on dst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.ranking import numbered


def steps(trials: DataFrame, elements: DataFrame, sizes: list[int]) -> DataFrame:
    """Deploy and teardown of every element and trial, coalesced to groups of consecutive trials that share an
    instance: of each group the first deploy and the last teardown stay. trials: (trial), numbered from 0."""
    from .grid import group_size

    last = trials.agg(F.max("trial")).first()[0]
    total = 0 if last is None else last + 1
    spark, kept = trials.sparkSession, None
    leveled = elements.withColumn("_depth", F.least("level", F.lit(len(sizes))))
    for k in range(len(sizes) + 1):  # one range of (group, element) a level: groups follow from the trials' number alone
        size = group_size(k, sizes)
        some = leveled.where(F.col("_depth") == k)
        found = numbered(some, F.col("element"), name="_e")
        many = some.count()
        if not many:
            continue
        groups = -(-total // size)
        pairs = spark.range(groups * many).select(F.expr(f"id div {many}").alias("grp"), (F.col("id") % many).alias("_e"))
        part = pairs.join(found, "_e").select("element", "grp", "level", "health", (F.col("grp") * size).alias("first"), F.least((F.col("grp") + 1) * size - 1, F.lit(total - 1)).alias("last"))
        kept = part if kept is None else kept.unionByName(part)
    if kept is None:
        kept = elements.where("false").select("element", F.lit(0).cast("long").alias("grp"), "level", "health", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"))
    row = lambda kind, at: F.struct(F.lit(kind).alias("kind"), F.col(at).alias("trial"), F.concat_ws(":", F.lit(kind), "element", F.col("grp").cast("string")).alias("node"))
    return kept.select("element", "grp", "level", "health", "first", "last", F.explode(F.array(row("deploy", "first"), row("teardown", "last"))).alias("s")).select("element", "grp", "level", "health", "first", "last", "s.*")


def edges(steps_: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst): deploy before teardown; a dependency deploys first and is torn down last; exclusive users of one
    instance follow each other; a lifeline's teardown stands for its dependents'."""
    deploy = steps_.where("kind = 'deploy'").select("element", "grp", "first", "last", F.col("node").alias("up"))
    down = steps_.where("kind = 'teardown'").select("element", "grp", F.col("node").alias("down"))
    inst = deploy.join(down, ["element", "grp"])
    own = inst.select(F.col("up").alias("src"), F.col("down").alias("dst"))
    a, b = inst.alias("a"), inst.alias("b")
    # instances meet where their ranges of trials overlap; the finer one names the trial
    pairs = (
        links.alias("l").join(a, F.col("a.element") == F.col("l.src")).join(b, (F.col("b.element") == F.col("l.dst")) & (F.col("a.first") <= F.col("b.last")) & (F.col("b.first") <= F.col("a.last")))
    ).select("l.kind", F.col("a.up").alias("user_up"), F.col("a.down").alias("user_down"), F.col("b.up").alias("dep_up"), F.col("b.down").alias("dep_down"), F.col("a.first").alias("first"), F.col("b.grp").alias("instance"), F.col("l.src").alias("user"), F.col("l.dst").alias("dep"))
    before = pairs.select(F.col("dep_up").alias("src"), F.col("user_up").alias("dst"))
    after = pairs.where("kind <> 'lifeline'").select(F.col("user_down").alias("src"), F.col("dep_down").alias("dst"))
    from pyspark.sql import Window

    line = Window.partitionBy("dep", "instance").orderBy("first", "user")
    turns = pairs.where("kind in ('exclusive', 'linear')").withColumn("next", F.lead("user_up").over(line)).where("next is not null").select(F.col("user_down").alias("src"), F.col("next").alias("dst"))
    return own.unionByName(before).unionByName(after).unionByName(turns).where("src <> dst").distinct()


def with_trials(steps_: DataFrame, edges_: DataFrame) -> DataFrame:
    """Trial start and end notifications: start after the trial's deploys, end before its teardowns."""
    spans = steps_.select("node", "kind", F.explode(F.sequence("first", "last")).alias("t"))
    start, end = F.concat(F.lit("start:"), F.col("t").cast("string")), F.concat(F.lit("end:"), F.col("t").cast("string"))
    up = spans.where("kind = 'deploy'").select(F.col("node").alias("src"), start.alias("dst"))
    down = spans.where("kind = 'teardown'").select(end.alias("src"), F.col("node").alias("dst"))
    both = spans.select(start.alias("src"), end.alias("dst")).distinct()
    return edges_.unionByName(up).unionByName(both).unionByName(down).distinct()


def with_gates(steps_: DataFrame, edges_: DataFrame) -> DataFrame:
    """A readiness gate after each deploy with a health check; what followed the deploy follows the gate, but for
    its own teardown."""
    gated = steps_.where("kind = 'deploy' and health").select(F.col("node").alias("src"), F.concat(F.lit("ready:"), F.col("element"), F.lit(":"), F.col("grp").cast("string")).alias("gate"), F.concat(F.lit("teardown:"), F.col("element"), F.lit(":"), F.col("grp").cast("string")).alias("own"))
    moved = edges_.join(gated, "src", "left").select(F.when(F.col("gate").isNotNull() & (F.col("dst") != F.col("own")), F.col("gate")).otherwise(F.col("src")).alias("src"), "dst")
    return moved.unionByName(gated.select("src", F.col("gate").alias("dst"))).distinct()


def with_sentinels(edges_: DataFrame) -> DataFrame:
    """plan:start before all sources, plan:end after all sinks."""
    src, dst = edges_.select(F.col("src").alias("n")).distinct(), edges_.select(F.col("dst").alias("n")).distinct()
    first = src.join(dst, "n", "left_anti").select(F.lit("plan:start").alias("src"), F.col("n").alias("dst"))
    last = dst.join(src, "n", "left_anti").select(F.col("n").alias("src"), F.lit("plan:end").alias("dst"))
    return edges_.unionByName(first).unionByName(last)


def compile_plan(trials: DataFrame, elements: DataFrame, links: DataFrame, sizes: list[int]) -> tuple[DataFrame, DataFrame]:
    """Steps and the reduced edges of the whole plan."""
    s = steps(trials, elements, sizes)
    return s, graph.reduction(with_sentinels(with_gates(s, with_trials(s, edges(s, links)))))


def trial_elements(elements: DataFrame, links: DataFrame, on: DataFrame | None = None, off: DataFrame | None = None) -> DataFrame:
    """Elements that nothing depends on, with those forced on and without those forced off."""
    leaves = elements.select("element").join(links.select(F.col("dst").alias("element")).distinct(), "element", "left_anti")
    leaves = leaves if on is None else leaves.unionByName(on.select("element")).distinct()
    return leaves if off is None else leaves.join(off.select("element"), "element", "left_anti")


def owners_with_conflict(links: DataFrame) -> DataFrame:
    """Elements that several others use exclusively (warning W002)."""
    return links.where("kind = 'exclusive'").groupBy("dst").agg(F.count_distinct("src").alias("users")).where("users > 1")


#: how dependencies may be
LINK_KINDS = ("shared", "exclusive", "dedicated", "linear", "lifeline")


def diagnostics(elements: DataFrame, links: DataFrame) -> DataFrame:
    """(problem, element, other): needs of elements that are not declared, of themselves, of unknown kinds, needs that are
    stated twice, and elements that several others use exclusively."""
    row = lambda rows, text, a="src", b="dst": rows.select(F.lit(text).alias("problem"), F.col(a).alias("element"), F.col(b).alias("other"))
    names = elements.select(F.col("element").alias("dst")).distinct()
    conflict = links.join(owners_with_conflict(links).select("dst"), "dst", "left_semi").where("kind = 'exclusive'")
    found = [
        row(links.join(names, "dst", "left_anti"), "undeclared"),
        row(links.join(names.withColumnRenamed("dst", "src"), "src", "left_anti"), "declared by none"),
        row(links.where("src = dst"), "needs itself"),
        row(links.where(~F.coalesce(F.col("kind").isin(*LINK_KINDS), F.lit(False))), "unsupported kind"),
        row(links.groupBy("src", "dst").count().where("count > 1"), "stated twice"),
        row(conflict, "exclusive use by several"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()
