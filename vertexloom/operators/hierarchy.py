"""Parent-child links of unknown depth to full hierarchies.

Chains of parents that stay inside one partition are contracted to the partition's exits by an array kernel; the exits form a
smaller quotient forest, which is solved the same way, until it fits one task; then every level's answers are expanded from its
exits. What lies in one partition is chosen anew in each level: with a coin drawn by id and level, a node whose parent's coin is
0 goes where its parent's key goes, any other keeps its own key. A node of coin 0 below one of coin 1 then lies with all its
children, which skip it, so that a quarter of the inner nodes leaves the forest in every level whatever it looks like, and
however many partitions there are. Loops come out as they are: closed in a partition, or as a loop of the quotient.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions import forest
from vertexloom.functions.arrow import whole_partition
from vertexloom.functions.vertex_ids import vertex_or_null
from vertexloom.operators.prefix import prefix_sums
from vertexloom.plans.lineage import Workspace
from vertexloom.plans.sizing import parts

NODE = ", ".join(f"{f} long" for f in forest.FIELDS)
#: Nodes a task holds; the fewest partitions of a contraction; the quotient that is solved in one task.
ROWS_PER_PART, LEAST_PARTS, BASE = 250_000, 4, 25_000
#: Hot parents, with more children than a HUB-th of a partition's rows: at most HUB of them for each partition.
HUB = 4
#: A parent of so few children is never hot.
COOL = 32
#: Walk positions, or places in a chain, of one block of an equi-join.
BLOCK = 1024


def current_links(states: DataFrame, id_col: str = "id", parent_col: str = "predecessor", order_col: str = "superstep") -> DataFrame:
    """``(id, parent)`` of each id's row with the greatest ``order_col``.

    Rows without an id are no nodes. A NULL order is older than any other. Of rows that tie, the one with the greatest parent
    counts, so the result doesn't depend on the rows' order. A parent outside the vertex domain is none (NULL).
    """
    rows = states.select(
        F.col(id_col).cast("long").alias("id"), F.col(order_col).alias("_o"), vertex_or_null(parent_col).alias("_p")
    ).where("id IS NOT NULL")
    return rows.groupBy("id").agg(F.max(F.struct("_o", "_p")).alias("_r")).select("id", F.col("_r._p").alias("parent"))


def _none() -> Column:
    return F.lit(int(forest.NONE)).cast("long")


def _coin(c: Column, level: int) -> Column:
    return F.xxhash64(c, F.lit(level)).bitwiseAND(1)


def _inner(ws: Workspace, t: DataFrame, n: int, p: int) -> tuple[DataFrame, int, DataFrame | None]:
    """The nodes of ``t`` that are some node's parent, their number, and the hot parents ``(hub)``, if there are any.

    A hot parent has more than a HUB-th of an even partition of ``t``, so there are at most ``HUB * p`` of them: a bound by the number
    of tasks, which makes them safe to broadcast. A hot parent needn't be a node.
    """
    kids = t.where(F.col("parent") != _none()).groupBy(F.col("parent").alias("_id")).agg(F.count(F.lit(1)).alias("_kids"))
    hot = F.col("_kids") > max(n / (HUB * p), COOL)
    known = F.col("id").isNotNull()
    every, seen = ws.cut_measured(kids.join(t, F.col("id") == F.col("_id"), "left"), hubs=F.count(F.when(hot, 1)), n=F.count(F.when(known, 1)))
    hubs = every.where(hot).select(F.col("_id").alias("hub")) if seen["hubs"] else None
    return every.where(known).select(t.columns), seen["n"], hubs


def _placed(t: DataFrame, hubs: DataFrame | None, p: int, level: int) -> DataFrame:
    """Into ``p`` partitions, each node with its parent if that has coin 0. The children of a hot parent stay where they are."""
    join = (F.col("parent") != _none()) & (_coin(F.col("parent"), level) == 0)
    if hubs is not None:
        t = t.join(F.broadcast(hubs), F.col("parent") == F.col("hub"), "left")
        join = join & F.col("hub").isNull()
    return t.withColumn("_key", F.when(join, F.col("parent")).otherwise(F.col("id"))).repartition(p, "_key").drop("_key", "hub")


def _expanded(t: DataFrame, answers: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """``t`` with the answers ``(_id, ...)`` of its parents, NULL where there is none. The rows of a hot parent aren't gathered."""
    if hubs is None:
        return t.join(answers, F.col("parent") == F.col("_id"), "left")
    cols = [c for c in answers.columns if c != "_id"]
    hot = answers.join(F.broadcast(hubs), F.col("_id") == F.col("hub")).select("hub", *[F.col(c).alias(f"_hot{c}") for c in cols])
    met = t.join(F.broadcast(hot), F.col("parent") == F.col("hub"), "left")
    # The rows that have met theirs are spread by their own ids, where no answer lies.
    spread = met.withColumn("_spread", F.when(F.col("hub").isNotNull(), F.xxhash64("id").bitwiseOR(1)).otherwise(F.lit(0)))
    cold = answers.withColumn("_at", F.lit(0).cast("long"))
    out = spread.join(cold, (F.col("parent") == F.col("_id")) & (F.col("_spread") == F.col("_at")), "left")
    return out.select(*t.columns, F.coalesce("_id", "hub").alias("_id"), *[F.coalesce(c, f"_hot{c}").alias(c) for c in cols])


def _solve(ws: Workspace, t: DataFrame, n: int, rows_per_part: int, base: int, level: int = 0) -> DataFrame:
    """``(id, root, depth)`` of the nodes in the step table ``t``."""
    kernel = whole_partition(forest.contract)
    if level and n <= base:
        return t.repartition(1).mapInArrow(kernel, NODE).select("id", "root", F.col("base").alias("depth"))
    p = max(LEAST_PARTS, parts(n, rows_per_part))
    inner, m, hubs = _inner(ws, t, n, p)
    contracted = ws.cut(_placed(inner, hubs, max(LEAST_PARTS, parts(m, rows_per_part)), level).mapInArrow(kernel, NODE))
    above = _solve(ws, contracted, m, rows_per_part, base, level + 1)
    answers = above.select(F.col("id").alias("_id"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
    if hubs is not None:
        answers = ws.cut(answers)  # read twice
    met = F.col("_id").isNotNull()
    return _expanded(t, answers, hubs).select(
        "id",
        F.when(met, F.col("_root")).otherwise(F.col("root")).alias("root"),
        F.when(met, F.when(F.col("_depth") < 0, -1).otherwise(F.col("w") + F.col("_depth"))).otherwise(F.col("base")).cast("long").alias("depth"),
    )


def _nodes(links: DataFrame, w: str | None = None) -> DataFrame:
    """Kernel input: ``w`` names a column with each node's step length (default 1); a root's own step counts too if it is named."""
    step = F.col(w).cast("long") if w else F.lit(1).cast("long")
    parent = F.coalesce("parent", _none())
    return links.select("id", parent.alias("parent"), step.alias("w"), F.col("id").alias("m"), F.col("id").alias("root"), (step if w else F.lit(0).cast("long")).alias("base"))


def solve(links: DataFrame, ws: Workspace | None = None, rows_per_part: int = ROWS_PER_PART, w: str | None = None, base: int = BASE) -> DataFrame:
    """``(id, root, depth)`` for each row of ``links (id, parent)``, whose ids are unique and not NULL.

    A node whose parent is NULL or no id of the table is a root of depth 0. A node on a closed loop, or whose parents lead into
    one, has depth -1 and the loop's smallest id as root. An empty table gives an empty result. With ``w``, the depth is the sum
    of that non-negative column from the root to the node, both included. Other columns of ``links`` are ignored. A quotient of at
    most ``base`` nodes is solved in one task; the table itself never is.
    """
    ws = ws or Workspace(links.sparkSession, "hierarchy")
    t, seen = ws.cut_measured(_nodes(links, w), n=F.count(F.lit(1)))
    return _solve(ws, t, seen["n"], rows_per_part, base)


def _sum_kernel(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ids, total = forest.subtree_sums(cols["id"], cols["parent"], cols["weight"])
    return {"id": ids, "total": total}


def _exits_kernel(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    zero = np.zeros(len(cols["id"]), np.int64)
    out = forest.contract({"id": cols["id"], "parent": cols["parent"], "w": zero, "m": cols["id"], "root": cols["id"], "base": zero})
    weight = cols["weight"][np.argsort(cols["id"], kind="stable")]
    return {"id": out["id"], "parent": out["parent"], "weight": weight}


def _sums(ws: Workspace, t: DataFrame, n: int, rows_per_part: int, base: int, level: int = 0) -> DataFrame:
    """``(id, total)``: the weight of every node's subtree. ``t (id, parent, weight)`` has no loops and no unknown parents."""
    add = whole_partition(_sum_kernel)
    if level and n <= base:
        return t.repartition(1).mapInArrow(add, "id long, total long")
    p = max(LEAST_PARTS, parts(n, rows_per_part))
    inner, m, hubs = _inner(ws, t.select("id", "parent"), n, p)
    # Leaves are their own totals; their parents take them over before anything is placed.
    leaves = ws.cut(t.join(inner.select("id"), "id", "left_anti"))
    gifts = leaves.where(F.col("parent") != _none()).groupBy(F.col("parent").alias("_to")).agg(F.sum("weight").alias("_w"))
    own = t.join(inner.select("id"), "id", "left_semi").join(gifts, F.col("id") == F.col("_to"), "left")
    q = max(LEAST_PARTS, parts(m, rows_per_part))
    placed = _placed(own.select("id", "parent", (F.col("weight") + F.coalesce("_w", F.lit(0))).alias("weight")), hubs, q, level)
    own = ws.cut(placed.withColumn("part", F.spark_partition_id().cast("long")))
    by_part = lambda rows: rows.repartitionById(q, F.col("part").cast("int")).drop("part")
    out = ws.cut(by_part(own).mapInArrow(whole_partition(_exits_kernel), "id long, parent long, weight long"))
    hung = out.where(F.col("parent") != _none()).groupBy(F.col("parent").alias("id")).agg(F.sum("weight").alias("weight"))
    quotient, seen = ws.cut_measured(out.select("id", "parent").join(hung, "id"), n=F.count(F.lit(1)))
    above = _sums(ws, quotient, seen["n"], rows_per_part, base, level + 1)
    gains = above.select("id", F.col("total").alias("_gain"))
    fuller = own.join(gains, "id", "left").select("id", "parent", (F.col("weight") + F.coalesce("_gain", F.lit(0))).alias("weight"), "part")
    return by_part(fuller).mapInArrow(add, "id long, total long").unionByName(leaves.select("id", F.col("weight").alias("total")))


def _sibling_order(c: str) -> Column:
    """Children are visited in this order: evenly spread LONGs, by multiplication, so that other engines can follow it too."""
    return ((F.pmod(F.col(c), F.lit(1 << 31)) * F.lit(2654435761)) % F.lit(1 << 32) - F.lit(1 << 31)) * F.lit(1 << 32)


def hierarchy(links: DataFrame, rows_per_part: int = ROWS_PER_PART, base: int = BASE) -> DataFrame:
    """Each node's place in its tree, in space proportional to the nodes: paths and descendants without listing them per node.

    ``links`` as in ``solve``. Columns: ``id, parent, root, depth``; ``size``, the nodes of its subtree, itself included;
    ``pre``, its number in a walk of the tree that visits parents first (from 1): **the ids below a node are those of the same
    root with ``pre`` in (pre, pre + size)**; ``chain`` and ``pos``: the tree is cut into heavy chains (each inner node is
    continued by its largest child), ``chain`` is the id of the chain's top and ``pos`` the node's place in it from 0: **the
    path of a node is its chain up to ``pos``, preceded by the path of the chain's top's parent**, and passes at most
    log2(size of the tree) + 1 chains. On or behind a loop, depth is -1, root the loop's smallest id, and the rest NULL.
    """
    spark = links.sparkSession
    ws = Workspace(spark, "hierarchy")
    links = ws.cut(links.select("id", "parent"))
    placed, seen = ws.cut_measured(
        solve(links, ws, rows_per_part, base=base).join(links, "id").withColumn("parent", F.when(F.col("depth") != 0, F.col("parent"))),
        n=F.count(F.lit(1)),
    )
    tree = placed.where("depth >= 0").select("id", F.coalesce("parent", _none()).alias("parent"))
    ones = ws.cut(tree.withColumn("weight", F.lit(1).cast("long")))
    sizes = _sums(ws, ones, seen["n"], rows_per_part, base)
    sized = ws.cut(placed.where("depth >= 0").join(sizes.withColumnRenamed("total", "size"), "id"))
    kids = sized.where("parent IS NOT NULL").select("id", "parent", "size", _sibling_order("id").alias("_h"))
    before = prefix_sums(kids, ["parent"], "_h", "id", "size").select("id", F.col("before").alias("_before"))
    heavy = kids.groupBy("parent").agg(F.max(F.struct("size", (-F.col("id")).alias("_neg"))).alias("_best")).select((-F.col("_best._neg")).alias("id"), F.lit(True).alias("_heavy"))
    steps = ws.cut(
        sized.join(before, "id", "left").join(heavy, "id", "left")
        .select("id", "parent", F.coalesce(F.col("_before") + 1, F.lit(1)).alias("step"), F.when(F.col("_heavy"), F.col("parent")).alias("_up"))
    )
    pre = solve(steps, ws, rows_per_part, w="step", base=base).select("id", F.col("depth").alias("pre"))
    chain = solve(steps.select("id", F.col("_up").alias("parent")), ws, rows_per_part, base=base).select("id", F.col("root").alias("chain"), F.col("depth").alias("pos"))
    whole = sized.join(pre, "id").join(chain, "id")
    looped = placed.where("depth < 0")
    return whole.unionByName(looped, allowMissingColumns=True).select("id", "parent", "root", "depth", "size", "pre", "chain", "pos")


def chains(nodes: DataFrame, block: int = 4096) -> DataFrame:
    """The heavy chains of ``hierarchy``: ``(chain, block_no, attach, members)``.

    ``members`` are the ids at positions ``block_no * block`` and following, in order; ``attach`` is the parent of the chain's
    top (NULL at a root). A chain of any length is spread over rows of at most ``block`` ids.
    """
    member = nodes.where("chain IS NOT NULL").withColumn("block_no", F.floor(F.col("pos") / block))
    return member.groupBy("chain", "block_no").agg(
        F.max(F.when(F.col("id") == F.col("chain"), F.col("parent"))).alias("attach"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("members"),
    )


def full_paths(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, path)``, root first, for the stated ``ids (id)``: the expansion of ``hierarchy`` along heavy chains.

    The result has the sum of the depths as its size, so state the ids that are wanted. Ids on or behind loops, and unknown
    ids, have no path and no row; an id stated twice has one row.
    """
    ws = Workspace(nodes.sparkSession, "paths")
    nodes = ws.cut(nodes.where("chain IS NOT NULL").select("id", "parent", "chain", "pos", "depth"))
    todo, done = ws.cut(ids.select(F.col("id").cast("long")).distinct().withColumn("at", F.col("id"))), []
    while not todo.isEmpty():
        here = todo.join(nodes.select(F.col("id").alias("at"), "chain", F.col("pos").alias("_upto")), "at").select("id", "chain", "_upto")
        done.append(here)
        tops = nodes.where("pos = 0 AND parent IS NOT NULL").select("chain", F.col("parent").alias("at"))
        todo = ws.cut(here.join(tops, "chain").select("id", "at"))
    if not done:
        return nodes.sparkSession.createDataFrame([], "id long, path array<long>")
    hops = done[0]
    for d in done[1:]:
        hops = hops.unionByName(d)
    # Only the blocks of a chain that the path passes are joined.
    hops = hops.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_upto") / BLOCK))))
    on = hops.join(nodes.withColumnRenamed("id", "_member").withColumn("_block", F.floor(F.col("pos") / BLOCK)), ["chain", "_block"]).where("pos <= _upto")
    return on.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "_member"))), lambda x: x["_member"]).alias("path"))


def descendants(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, below)``: one row for each id below a stated id.

    The range ``(pre, pre + size)`` of a stated id is covered by aligned blocks, so the join is on the root and the block: no task meets
    more than a block of nodes for each range, and the work follows the size of the result. As with ``full_paths``, state the ids:
    all pairs have the size of all paths together. Unknown ids, ids behind loops and leaves have no row.
    """
    block = lambda c: F.floor((F.col(c) if isinstance(c, str) else c) / BLOCK)
    tops = ids.select(F.col("id").cast("long")).distinct().join(nodes.where("size > 1"), "id").select("id", F.col("root").alias("_root"), F.col("pre").alias("_lo"), (F.col("pre") + F.col("size")).alias("_hi"))
    tops = tops.withColumn("_block", F.explode(F.sequence(block(F.col("_lo") + 1), block(F.col("_hi") - 1))))
    below = nodes.where("size IS NOT NULL").select(F.col("id").alias("below"), "root", "pre", block("pre").alias("_at"))
    return tops.join(below, (F.col("root") == F.col("_root")) & (F.col("_at") == F.col("_block"))).where("pre > _lo AND pre < _hi").select("id", "below")


def path_hops(nodes: DataFrame) -> DataFrame:
    """``(id, root, depth, hops)``: the full path of every node of ``hierarchy``, run-length encoded and lossless.

    ``hops`` is an array of ``(chain, upto)``, root first: the members of each chain from its top to position ``upto`` in turn
    are the path. It has at most log2(size of the tree) + 1 entries however deep the node is, so all paths together take space
    proportional to the nodes, where the listed paths would take the sum of the depths. Nodes on or behind loops have no row.
    """
    ws = Workspace(nodes.sparkSession, "hops")
    tree = ws.cut(nodes.where("chain IS NOT NULL").select("id", "parent", "root", "depth", "chain", "pos"))
    tops = tree.where("pos = 0").select("chain", "parent")
    kind = "array<struct<chain:bigint,upto:bigint>>"
    hang = ws.cut(tops.join(tree.select(F.col("id").alias("parent"), F.col("chain").alias("above"), F.col("pos").alias("upto")), "parent").select("chain", "above", "upto"))
    last = ws.cut(tops.where("parent IS NULL").select("chain", F.array().cast(kind).alias("before")))
    done = [last]
    while True:  # a level of chains at a time: each chain is reached once
        above = last.select(F.col("chain").alias("above"), F.col("before").alias("_b"))
        last, seen = ws.cut_measured(hang.join(above, "above").select("chain", F.concat("_b", F.array(F.struct(F.col("above").alias("chain"), "upto"))).alias("before")), n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        done.append(last)
    before = done[0]
    for d in done[1:]:
        before = before.unionByName(d)
    return tree.join(before, "chain").select("id", "root", "depth", F.concat("before", F.array(F.struct("chain", F.col("pos").alias("upto")))).alias("hops"))
