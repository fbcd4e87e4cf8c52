"""Mixing sources to target weights by hierarchical budgeting.

Weights are propagated from the root of a tree (domain, source, language) to its leaves; what a leaf can't supply, even with its
documents repeated as often as allowed, is redistributed among its siblings before its ancestors: first among the languages of
its source, then among the sources of its domain, then among the domains. Each leaf then contributes a token-prefix of seeded
epochs: whole epochs first, and of the last one the documents in a seeded order up to the leaf's budget.

The targets belong to the sources, so the source stands above the language in the tree. A language's weight is its share of all
documents' tokens, the same in every source whatever the source holds of it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.operators.prefix import prefix_sums
from vertexloom.plans.lineage import Workspace

#: A tree with more leaves than this is refused: the budgets are computed on the driver.
MOST_LEAVES = 100_000


@dataclass
class Node:
    """``weight``: the share of the parent's budget. ``supply``: the tokens it can give, repeats included."""

    path: tuple
    weight: float = 0.0
    supply: int = 0
    children: dict[object, Node] = field(default_factory=dict)
    budget: int = 0
    asked: float = 0.0


def _exact(weight: float) -> Fraction:
    """The decimal a weight was written as, not its binary neighbour."""
    return Fraction(weight).limit_denominator(10**12)


def ask(node: Node, amount: float) -> None:
    """What the weights alone would give each node, before any shortage."""
    node.asked = amount
    total = sum(c.weight for c in node.children.values())
    for c in node.children.values():
        ask(c, amount * c.weight / total if total else 0.0)


def add_up(node: Node) -> None:
    """Weights and supplies of inner nodes that have none of their own are those of their children."""
    for c in node.children.values():
        add_up(c)
    if node.children:
        node.supply = sum(c.supply for c in node.children.values())


def distribute(node: Node, budget: int) -> None:
    """Split a budget that ``node`` can supply among its children by weight; what exceeds one's supply goes to its siblings."""
    node.budget = budget = min(budget, node.supply)
    open_, left = [c for c in node.children.values() if c.supply > 0], budget
    while open_ and left > 0:
        total = sum(_exact(c.weight) for c in open_)
        share = {id(c): Fraction(left) * (_exact(c.weight) / total if total else Fraction(1, len(open_))) for c in open_}
        full = [c for c in open_ if share[id(c)] >= c.supply]
        if not full:
            # Whole tokens by the largest remainders.
            for c in open_:
                c.budget = int(share[id(c)])
            rest = left - sum(c.budget for c in open_)
            for c in sorted(open_, key=lambda c: (c.budget - share[id(c)], str(c.path)))[:rest]:
                c.budget += 1
            break
        for c in full:
            c.budget = c.supply
            left -= c.supply
        open_ = [c for c in open_ if c not in full]
    for c in node.children.values():
        distribute(c, c.budget)


def largest_even_total(children: list[Node]) -> int:
    """The largest total at which every child with a supply can give its share of the weights of those that have one."""
    able = [c for c in children if c.supply > 0 and c.weight > 0]
    weight = sum(_exact(c.weight) for c in able)
    return int(min((c.supply * weight / _exact(c.weight) for c in able), default=Fraction(0)))


@dataclass(frozen=True)
class Mix:
    """``selected (doc_id, source, lang, n_tokens, uses)``; ``shares``, a row for each source of the targets or the documents; and
    ``leaves (domain, source, lang, asked, supply, budget, tokens, largest)``: what the weights ask of each leaf, what it can supply, what
    it has to give after the shortages were redistributed, what it gives, and its largest document."""

    selected: DataFrame
    shares: DataFrame
    leaves: DataFrame


def mix(
    sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, buckets: int = 4096, domains: dict[str, str] | None = None, stretch: float = 1.0
) -> Mix:
    """Select from ``sizes (doc_id, source, lang, n_tokens)`` so that each source gives its share of all tokens.

    ``targets (source, target_share, max_repeats)``: repeated sources count once, with the summed share and the smallest
    ``max_repeats``; NULL shares and repeats count as 0. Without ``total``, the total is the largest at which no source that has
    documents falls short, times ``stretch``; the shares of sources without any are redistributed. With a larger ``total`` or ``stretch``,
    sources that fall short give all they may, and the others make it up as far as they can, those of the same of ``domains``
    (source to domain; sources that aren't named share one) before the rest. A document is used whole, at most
    ``max_repeats`` times. A leaf's last document is taken if the budget ends in its second half, so each leaf misses its budget
    by at most half a document. Documents of sources without a target, or with a NULL source, and documents of 0 tokens are not
    selected. Languages are compared in lower case; NULL is ``und``. Empty tables select nothing.
    """
    spark = sizes.sparkSession
    ws = Workspace(spark, "mix")
    docs = ws.cut(sizes.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.lower(F.coalesce("lang", F.lit("und"))).alias("lang"), F.col("n_tokens").cast("long").alias("n_tokens")))
    goals = targets.where("source IS NOT NULL").groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.min(F.coalesce("max_repeats", F.lit(0))).alias("repeats")).limit(MOST_LEAVES + 1).collect()
    leaves = docs.where("n_tokens > 0").groupBy("source", "lang").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).limit(MOST_LEAVES + 1).collect()
    if len(leaves) > MOST_LEAVES or len(goals) > MOST_LEAVES:
        raise ValueError(f"the tree has more than {MOST_LEAVES} leaves")
    goal, domain_of = {g["source"]: g for g in goals}, domains or {}
    spoken: dict[str, int] = {}
    for leaf in leaves:
        spoken[leaf["lang"]] = spoken.get(leaf["lang"], 0) + leaf["tokens"]
    root, sources = Node(()), {}
    for g in goals:
        domain = domain_of.get(g["source"], "")
        top = root.children.setdefault(domain, Node((domain,)))
        sources[g["source"]] = top.children[g["source"]] = Node((domain, g["source"]), max(0.0, g["share"]))
        top.weight += max(0.0, g["share"])
    for leaf in leaves:
        if leaf["source"] in goal:
            top = sources[leaf["source"]]
            supply = leaf["tokens"] * max(0, goal[leaf["source"]]["repeats"]) if top.weight > 0 else 0
            top.children[leaf["lang"]] = Node((*top.path, leaf["lang"]), float(spoken[leaf["lang"]]), supply)
    add_up(root)
    amount = int(largest_even_total(list(sources.values())) * _exact(stretch)) if total is None else total
    ask(root, float(amount))
    distribute(root, amount)

    have = {(leaf["source"], leaf["lang"]): leaf["tokens"] for leaf in leaves}
    plan = [(s, lang, n.budget // have[s, lang], n.budget % have[s, lang]) for s, c in sources.items() for lang, n in c.children.items() if n.budget]
    budgets = spark.createDataFrame(plan, "source string, lang string, epochs long, rest long")
    # Broadcast: at most MOST_LEAVES rows.
    planned = docs.where("n_tokens > 0").join(F.broadcast(budgets), ["source", "lang"])
    planned = planned.withColumn("_order", F.xxhash64("doc_id", F.lit(seed), "epochs"))
    placed = prefix_sums(planned, ["source", "lang"], "_order", "doc_id", "n_tokens", buckets)
    uses = F.col("epochs") + (F.col("before") * 2 + F.col("n_tokens") <= F.col("rest") * 2).cast("long") * (F.col("rest") > 0).cast("long")
    selected = ws.cut(placed.withColumn("uses", uses).where("uses > 0").select("doc_id", "source", "lang", "n_tokens", "uses"))

    got = selected.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.sum("uses").alias("documents"), F.max("uses").alias("most_uses"))
    rows = [(s, float(g["share"]), int(g["repeats"]), sources[s].budget) for s, g in goal.items()]
    wanted = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, budget long")
    supply = docs.groupBy(F.col("source").alias("_s")).agg(F.sum("n_tokens").alias("available"))
    every = supply.join(F.broadcast(wanted), F.col("_s").eqNullSafe(F.col("source")), "full_outer").withColumn("source", F.coalesce("source", "_s")).drop("_s")
    every = every.join(F.broadcast(got.withColumnRenamed("source", "_s")), F.col("source") == F.col("_s"), "left").drop("_s")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    whole = got.agg(F.sum("tokens").alias("_all"))
    shares = every.join(F.broadcast(whole)).select(
        "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("actual_share"),
        zero("budget"), zero("tokens"), zero("available"), zero("documents"), zero("most_uses"), zero("max_repeats"),
    )
    every_leaf = [(*n.path, n.asked, n.supply, n.budget) for c in sources.values() for n in c.children.values()]
    asked = spark.createDataFrame(every_leaf, "domain string, source string, lang string, asked double, supply long, budget long")
    gave = selected.groupBy("source", "lang").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"))
    most = docs.groupBy("source", "lang").agg(F.max("n_tokens").alias("largest"))
    leaf_rows = asked.join(most, ["source", "lang"], "left").join(gave, ["source", "lang"], "left")
    return Mix(selected, shares, leaf_rows.select("domain", "source", "lang", "asked", "supply", "budget", zero("tokens"), zero("largest")))
