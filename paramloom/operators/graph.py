"""Graph operators over edge tables (src, dst): src must come before dst.

Iterations run over DataFrames; rounds are checkpointed to the folder that spark.checkpoint.dir names.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget, written


def _cut(df: DataFrame) -> DataFrame:
    """Cut lineage with checkpoint() in the shared folder; a folder of our own only on a local master without one."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that all machines share")
        sc.setCheckpointDir(named or f"file://{tempfile.gettempdir()}/checkpoints/paramloom-graph")
    return df.checkpoint()


def closure(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(src, dst) for every dst reachable from src; with start (src), from those only. Semi-naive: each round
    extends only pairs found in the last; without start, pairs are doubled so rounds grow with the log of depth."""
    edges = edges.select("src", "dst").distinct()
    known = _cut(edges if start is None else edges.join(start.select("src").distinct(), "src", "left_semi"))
    fresh = known
    while fresh.limit(1).count():
        step = known if start is None else edges
        on = step.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
        more = fresh.join(on, "dst").select("src", F.col("far").alias("dst")).distinct()
        fresh = _cut(more.join(known, ["src", "dst"], "left_anti"))
        known = _cut(known.unionByName(fresh))
    return known


def dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, dependency): everything that must come before each node (nodes: column node)."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure(back, nodes.select(F.col("node").alias("src"))).select(F.col("src").alias("node"), F.col("dst").alias("dependency"))


def depths(nodes: DataFrame, edges: DataFrame, limit: int = 100_000) -> DataFrame:
    """(node, depth): longest path from a source; one round a wave. Raises on cycles.

    A round joins the edges to the last wave only, takes its arrivals off what each node still waits for, and writes one
    table of nodes in place of the one before."""
    edges = written(edges.select("src", "dst").distinct(), "edges")
    waits = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("left"))
    start = nodes.select("node").distinct().join(waits, "node", "left").select("node", F.coalesce("left", F.lit(0)).alias("left"))
    state = written(start.withColumn("depth", F.when(F.col("left") == 0, 0)), "depths")
    for wave in range(limit + 1):
        last = state.where(F.col("depth") == wave)
        if not last.limit(1).count():
            break
        hits = edges.join(last.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_n"))
        after = state.join(hits, "node", "left").withColumn("left", F.col("left") - F.coalesce("_n", F.lit(0)))
        after = after.select("node", "left", F.coalesce("depth", F.when(F.col("left") == 0, wave + 1)).alias("depth"))
        state, before = written(after, "depths"), state
        forget(before)
    else:
        raise ValueError("too deep")
    forget(edges)
    if state.where("depth is null").limit(1).count():
        raise ValueError("the graph has a cycle")
    return state.select("node", F.col("depth").cast("int").alias("depth"))


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): sorted by (depth, node), every edge points forward."""
    return depths(nodes, edges)


def longest_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(position, node): one longest chain, from position 0; of equals the largest node, from the end back.

    Every node points at its deepest (then largest) predecessor. The pointers are doubled round by round, and the nodes
    known to be on the chain add those their pointers reach, so a chain of n nodes takes log2(n) rounds of joins of its
    own nodes to the pointers; nothing but the largest depth comes to the driver."""
    deep = written(depths(nodes, edges), "deep")
    before = deep.select(F.col("node").alias("src"), F.struct("depth", F.col("node").alias("up")).alias("_up"))
    best = edges.join(before, "src").groupBy(F.col("dst").alias("node")).agg(F.max("_up")["up"].alias("up"))
    jump = written(deep.join(best, "node").select("node", "up"), "jump")
    end = deep.agg(F.max(F.struct("depth", "node")).alias("_end"))
    chain = end.where("_end is not null").select(F.col("_end.node").alias("node"), F.col("_end.depth").alias("position"))
    last = chain.agg(F.max("position")).first()[0]
    chain = written(chain, "chain")
    step = 1
    while last is not None and step <= last:
        reached = chain.join(jump, "node").select(F.col("up").alias("node"), (F.col("position") - step).alias("position"))
        chain, old = written(chain.unionByName(reached), "chain"), [chain]
        step *= 2
        if step <= last:
            further = jump.select(F.col("node").alias("up"), F.col("up").alias("_far"))
            jump, used = written(jump.join(further, "up").select("node", F.col("_far").alias("up")), "jump"), jump
            old.append(used)
        forget(*old)
    forget(deep, jump)
    return chain.select("position", "node")


def critical_path(nodes: DataFrame, edges: DataFrame) -> list:
    """The nodes of longest_path() in order, on the driver: for chains that are known to be short."""
    return [r["node"] for r in longest_path(nodes, edges).orderBy("position").collect()]


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, relation, other): direct dependencies and dependents of each node."""
    on = nodes.select("node").distinct()
    before = edges.select(F.col("dst").alias("node"), F.lit("dependency").alias("relation"), F.col("src").alias("other"))
    after = edges.select(F.col("src").alias("node"), F.lit("dependent").alias("relation"), F.col("dst").alias("other"))
    return before.unionByName(after).distinct().join(on, "node", "left_semi")


def subgraph(nodes: DataFrame, edges: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The nodes that fit and the edges between them."""
    kept = nodes.where(keep)
    ids = kept.select("node").distinct()
    inner = edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return kept, inner.select("src", "dst")


def framed(*fields: Column) -> Column:
    """Fields as one text that tells where each ends: `n:` before its n bytes, `-` for null."""
    return F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (f.cast("string") for f in fields)])


def set_hash(rows: DataFrame, by: list[str], hash_column: str, name: str, digits: tuple[int, ...] = (4, 2)) -> DataFrame:
    """by, name: one SHA-256 of each group's set of hashes, whatever their order.

    A tree over prefixes of the hashes: those of one prefix are sorted, joined and hashed, then the results by a shorter
    prefix, then all. So no task holds a whole group: with (4, 2) one in 65,536 of its rows, then at most 256 results."""
    level = rows.select(*by, F.col(hash_column).alias("_h")).distinct().withColumn("_p", F.col("_h"))
    for n in (*digits, 0):
        level = level.withColumn("_p", F.substring("_p", 1, n)).groupBy(*by, "_p").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ""), 256).alias("_h"))
    return level.select(*by, F.col("_h").alias(name))


def node_fingerprints(nodes: DataFrame, edges: DataFrame, *fields: str) -> DataFrame:
    """(node, fingerprint): SHA-256 over a node's fields and the fingerprints of what must come before it, so over all of
    its ancestors and their edges. Bottom-up by waves: equal subgraphs have equal fingerprints wherever they stand."""
    deep = written(depths(nodes, edges), "deep")
    last = deep.agg(F.max("depth")).first()[0]
    own = written(nodes.dropDuplicates(["node"]).join(deep, "node").select("node", "depth", framed(*map(F.col, fields or ("node",))).alias("own")), "own")
    links = written(edges.select("src", "dst").distinct().join(deep.select(F.col("node").alias("dst"), "depth"), "dst"), "links")
    none = F.lit(None).cast("string")
    done = written(own.where("depth = 0").select("node", F.sha2(F.concat("own", framed(none)), 256).alias("fingerprint")), "merkle")
    for wave in range(1, (last or 0) + 1):
        before = links.where(F.col("depth") == wave).join(done.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "fingerprint")
        found = own.where(F.col("depth") == wave).join(set_hash(before, ["node"], "fingerprint", "below", (2,)), "node")
        done, old = written(done.unionByName(found.select("node", F.sha2(F.concat("own", framed(F.col("below"))), 256).alias("fingerprint"))), "merkle"), done
        forget(old)
    forget(deep, own, links)
    return done


def fingerprint(nodes: DataFrame, edges: DataFrame, *fields: str) -> DataFrame:
    """One row: counts and a SHA-256 of the whole graph, which no order of rows changes and every edge does."""
    edges = edges.select("src", "dst").distinct()
    root = set_hash(node_fingerprints(nodes, edges, *fields), [], "fingerprint", "fingerprint")
    counts = nodes.select("node").distinct().agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))
    return counts.crossJoin(root)  # single rows


def plan_fingerprints(plans: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """(plan, fingerprint) of many plans at once: plans (plan, name, ...) with any fields of their own, and parts by name,
    tables (plan, place, ...) whose place orders a list (axes, elements) or is null in sets (bindings).

    Each row is hashed with its place, each part by the set of its rows, each plan by its fields and, in the order of
    their names, its parts; absent parts differ from parts with an empty row. Ids, labels, tags and metadata are left out
    by not being given."""
    own = plans.select("plan", framed(*[F.col(c) for c in sorted(plans.columns) if c != "plan"]).alias("_own"))
    for name in sorted(parts):
        part = parts[name]
        row = F.sha2(framed(F.col("place"), *[F.col(c) for c in sorted(part.columns) if c not in ("plan", "place")]), 256)
        own = own.join(set_hash(part.select("plan", row.alias("_row")), ["plan"], "_row", f"_{name}", (2,)), "plan", "left")
        own = own.withColumn("_own", F.concat("_own", framed(F.lit(name), F.col(f"_{name}")))).select("plan", "_own")
    return own.select("plan", F.sha2("_own", 256).alias("fingerprint"))


LABELS = 4


def _least_ranks(deep: DataFrame, links: DataFrame, last: int, up: bool) -> DataFrame:
    """(node, low0.., one a label): the least random ranks among a node and all it reaches (up: all that reach it).

    One round a wave, from the far end: a node's ranks are the least of its own and of its neighbours'."""
    ranks = [F.xxhash64(F.lit(f"{k}{up}"), "node") for k in range(LABELS)]
    names = [f"low{k}" for k in range(LABELS)]
    own = written(deep.select("node", "depth", *[r.alias(n) for r, n in zip(ranks, names)]), "ranks")
    near, far = ("dst", "src") if up else ("src", "dst")
    waves = range(last + 1) if up else range(last, -1, -1)
    done = None
    for wave in waves:
        here = own.where(F.col("depth") == wave).drop("depth")
        if done is not None:
            below = links.where(F.col(f"{near}_depth") == wave).join(done.withColumnRenamed("node", far), far).select(F.col(near).alias("node"), *names)
            here = here.unionByName(below).groupBy("node").agg(*[F.min(n).alias(n) for n in names])
        old = done
        done = written(here if done is None else done.unionByName(here), "ranks")
        if old is not None:
            forget(old)
    forget(own)
    return done


#: rows up to which a table is broadcast
SMALL = 500_000


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table


def _marks(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """(node, depth, low0.., uplow0..) of all nodes, written; the names of the first ranks."""
    deep = written(depths(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), edges), "deep")
    last = deep.agg(F.max("depth")).first()[0]
    depth = lambda end: deep.select(F.col("node").alias(end), F.col("depth").alias(f"{end}_depth"))
    links = written(edges.join(depth("src"), "src").join(depth("dst"), "dst"), "links")
    down, up = _least_ranks(deep, links, last, False), _least_ranks(deep, links, last, True)
    names = [f"low{k}" for k in range(LABELS)]
    marks = written(deep.join(down, "node").join(up.select("node", *[F.col(n).alias(f"up{n}") for n in names]), "node"), "marks")
    forget(deep, links, down, up)
    return marks, names


def reaches(edges: DataFrame, pairs: DataFrame, least: int = 1) -> DataFrame:
    """The distinct pairs (src, dst) with a path of `least` edges or more from src to dst (at most 2 can be asked for).

    No closure: a row (src, dst, lo, hi) asks whether lo reaches hi. It is looked up among the edges, which expands nothing;
    if that fails, one side goes on by one edge: lo forward or hi backward, whichever has fewer edges. Between two ends
    of a path lie inner nodes only (with edges in and out), so only edges from and to those are followed, and only while
    the depth of an inner node is left between lo and hi. Where inner nodes lead to inner nodes, rows are cut by labels as
    well: what a node reaches contains what its successors reach, so the least of random ranks over it never rises along a
    path (nor does the least over its ancestors, backwards). A pair that is found leaves the search."""
    if least not in (1, 2):
        raise ValueError("least is 1 or 2")
    return _reaches(written(edges.select("src", "dst").distinct(), "edges"), pairs.select("src", "dst").distinct(), least)


def _reaches(edges: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """reaches() of distinct edges in a table and distinct pairs."""
    inner = written(edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_semi"), "inner")
    at = lambda nodes, end: nodes.withColumnRenamed("node", end)
    some = _few(inner)
    into = written(edges.join(at(some, "dst"), "dst", "left_semi").select("src", "dst"), "into")
    out = written(edges.join(at(some, "src"), "src", "left_semi").select("src", "dst"), "out")
    core = written(into.join(at(some, "src"), "src", "left_semi").select("src", "dst"), "core")
    chained = core.limit(1).count() > 0
    deep = written(depths(inner, core), "deep") if chained else inner.withColumn("depth", F.lit(0))
    last = deep.agg(F.max("depth")).first()[0] or 0
    marks, names = _marks(edges) if chained else (None, [])
    beyond = (F.lit(-1), F.lit(last + 1))
    fan = lambda links, end, n: _few(written(links.groupBy(end).agg(F.count(F.lit(1)).alias(n)), n))
    ahead, behind = fan(into, "src", "ahead"), fan(out, "dst", "behind")
    depth = lambda end: deep.select(F.col("node").alias(end), F.col("depth").alias(f"{end}_depth"))
    deeper = lambda links, end: links.join(_few(depth(end)), end) if chained else links.withColumn(f"{end}_depth", F.lit(0))
    forward = deeper(into, "dst").select(F.lit(True).alias("_f"), F.col("src").alias("_key"), F.col("dst").alias("_via"), F.col("dst_depth").alias("_d"))
    backward = deeper(out, "src").select(F.lit(False).alias("_f"), F.col("dst").alias("_key"), F.col("src").alias("_via"), F.col("src_depth").alias("_d"))
    steps = forward.unionByName(backward)
    links = edges.select(F.col("src").alias("lo"), F.col("dst").alias("hi"))
    rows = pairs.select("src", "dst", F.col("src").alias("lo"), F.col("dst").alias("hi"))
    found = [written(pairs.join(edges, ["src", "dst"], "left_semi"), "found")] if least == 1 else []
    if found:
        rows = rows.join(found[0], ["src", "dst"], "left_anti")
    # depths of ends that are no inner nodes: before the first and after the last
    for end, other in zip(("lo", "hi"), beyond):
        rows = rows.join(_few(depth(end)), end, "left").withColumn(f"{end}_depth", F.coalesce(f"{end}_depth", other)) if chained else rows.withColumn(f"{end}_depth", F.lit(None).cast("int"))
    if not chained:  # an inner end has no inner node beside it and falls out by its fan
        rows = rows.withColumn("lo_depth", beyond[0]).withColumn("hi_depth", beyond[1])
    for k in range(last + 1):
        # a node between lo and hi is missing where either has no inner neighbour on that side
        rows = rows.join(behind.select(F.col("dst").alias("hi"), "behind"), "hi").join(ahead.select(F.col("src").alias("lo"), "ahead"), "lo")
        rows = rows.withColumn("_f", F.col("ahead") <= F.col("behind")).withColumn("_key", F.when(F.col("_f"), F.col("lo")).otherwise(F.col("hi")))
        more = rows.join(steps, ["_f", "_key"]).where((F.col("_d") > F.col("lo_depth")) & (F.col("_d") < F.col("hi_depth")))
        side = lambda end, here, value: F.when(F.col("_f") == F.lit(here), F.col(value)).otherwise(F.col(end)).alias(end)
        more = more.select("src", "dst", side("lo", True, "_via"), side("hi", False, "_via"), side("lo_depth", True, "_d"), side("hi_depth", False, "_d"))
        if k < last:
            more = written(more.distinct(), "front")
        hits = written(more.join(links, ["lo", "hi"], "left_semi").select("src", "dst").distinct(), "found")
        found.append(hits)
        if k == last:
            break
        rows = more.where("hi_depth - lo_depth > 1").join(hits, ["src", "dst"], "left_anti")
        low, high = [marks.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in marks.columns if c != "node"]).drop(f"{end}_depth") for end in ("lo", "hi")]
        can = reduce(lambda a, b: a & b, [(F.col(f"lo_{n}") <= F.col(f"hi_{n}")) & (F.col(f"lo_up{n}") >= F.col(f"hi_up{n}")) for n in names])
        rows = written(rows.join(low, "lo").join(high, "hi").where(can).select("src", "dst", "lo", "hi", "lo_depth", "hi_depth"), "rows")
        if not rows.limit(1).count():
            break
    return reduce(DataFrame.unionByName, found).distinct()


def reduction(edges: DataFrame) -> DataFrame:
    """Edges that no other path implies. Only edges that span two waves or more can be implied; those are searched for."""
    edges = written(edges.select("src", "dst").distinct(), "edges")
    return edges.join(_reaches(edges, edges, 2), ["src", "dst"], "left_anti")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, max_fan_in, max_fan_out, depth, max_parallelism, average_parallelism."""
    deep = depths(nodes, edges)
    wave = deep.groupBy("depth").count().agg((F.max("depth") + 1).alias("depth"), F.max("count").alias("max_parallelism"), F.avg("count").alias("average_parallelism"), F.sum("count").alias("nodes"))
    fan = lambda c, n: edges.groupBy(c).count().agg(F.max("count").alias(n))
    count = edges.agg(F.count(F.lit(1)).alias("edges"))
    return wave.crossJoin(fan("dst", "max_fan_in")).crossJoin(fan("src", "max_fan_out")).crossJoin(count)  # single rows


def ready(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (node, state) that are pending and whose dependencies are all completed or skipped."""
    over = nodes.select(F.col("node").alias("src"), F.col("state").isin("completed", "skipped").alias("over"))
    blocked = edges.join(over, "src", "left").groupBy(F.col("dst").alias("node")).agg(F.bool_and(F.coalesce("over", F.lit(False))).alias("open"))
    found = nodes.where("state = 'pending'").join(blocked, "node", "left")
    return found.where(F.coalesce("open", F.lit(True))).select("node")


def cascade(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Transitive dependents of failed nodes that are not over yet: they are skipped."""
    failed = nodes.where("state = 'failed'").select(F.col("node").alias("src"))
    hit = closure(edges, failed).select(F.col("dst").alias("node")).distinct()
    return nodes.join(hit, "node", "left_semi").where(~F.col("state").isin("completed", "skipped", "failed")).select("node")


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, node): repeated nodes, edges to nodes that don't exist."""
    twice = nodes.groupBy("node").count().where("count > 1").select(F.lit("repeated").alias("problem"), "node")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return twice.unionByName(ends.join(nodes, "node", "left_anti").select(F.lit("dangling").alias("problem"), "node"))
