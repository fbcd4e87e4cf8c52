"""Registered queries of the subpackage. Each takes (spark, folder of Parquet tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.vertex_ids import vertex_or_null
from vertexloom.llm import grouping, heavy_hitters, lines, mixing, packing, spans, tokens
from vertexloom.llm.sql import SQL  # noqa: F401


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _destinations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "edge").select(vertex_or_null("dest_vert").alias("dest_vert"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_hitters.holders(_destinations(spark, folder), "dest_vert", one_in=400).selectExpr("value AS dest_vert")


def p2_top(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_hitters.most_frequent(_destinations(spark, folder), "dest_vert", k=100).selectExpr("value AS dest_vert", "approx_count")


def p2_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Of the 100 most frequent, how many estimates are too low, or too high by more than the sketch allows for all rows together."""
    top, values = F.broadcast(p2_top(spark, folder)), _destinations(spark, folder)
    true = values.join(top, "dest_vert").groupBy("dest_vert", "approx_count").agg(F.count(F.lit(1)).alias("n"))
    rows = values.agg(F.count("dest_vert").alias("rows"))
    excess = F.col("approx_count") - F.col("n") > F.col("rows") * F.lit(2.72 / heavy_hitters.WIDTH)
    one = lambda c: F.count(F.when(c, 1))
    return true.join(F.broadcast(rows)).agg(F.count(F.lit(1)).alias("values"), one(F.col("approx_count") < F.col("n")).alias("too_low"), one(excess).alias("too_high"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = (table(spark, folder, "tmp_in_edge"), "src_vert", "dest_vert")
    states = (table(spark, folder, "cc_vert_attr"), "id", "component_root")
    return grouping.components([pairs, states])


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    sizes = tokens.sized(table(spark, folder, "documents"), ["doc_id"])
    return packing.fill(sizes, table(spark, folder, "pack_size"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p6_fill(spark, folder), table(spark, folder, "pack_size"))


def p6_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per container: documents packed, bins over their capacity, documents with missing, repeated or needless pieces, and documents
    whose tokens differ between the containers."""
    filled = p6_fill(spark, folder)
    size = table(spark, folder, "pack_size").select("container", "capacity_tokens")
    one = lambda c: F.count(F.when(c, 1))
    bins = filled.groupBy("container", "bin").agg(F.sum("n_tokens").alias("t")).join(F.broadcast(size), "container")
    over = bins.groupBy("container").agg(one(F.col("t") > F.col("capacity_tokens")).alias("overfull"))
    docs = filled.groupBy("container", "doc_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece").alias("places"), F.max("piece").alias("last"), F.sum("n_tokens").alias("t"),
        F.max(F.col("start_token") + F.col("n_tokens")).alias("ends"),
    )
    docs = docs.join(F.broadcast(size), "container")
    needed = F.greatest(F.ceil(F.col("t") / F.col("capacity_tokens")), F.lit(1))
    broken = (F.col("pieces") != F.col("places")) | (F.col("last") != F.col("pieces") - 1) | (F.col("pieces") != needed) | (F.col("ends") != F.col("t"))
    whole = docs.groupBy("container").agg(F.count(F.lit(1)).alias("documents"), one(broken).alias("broken"))
    uneven = docs.groupBy("doc_id").agg((F.max("t") - F.min("t")).alias("d")).agg(one(F.col("d") > 0).alias("uneven"))
    return whole.join(F.broadcast(over), "container").join(F.broadcast(uneven)).select("container", "documents", "overfull", "broken", "uneven")


#: Kinds of the sources, for the query with a stated domain: what a source lacks is made up within its kind first.
DOMAINS = {
    "central_registry": "registers", "district_feed": "registers", "tribunal_archive": "registers", "law_reports": "reports", "appeal_bulletin": "reports",
    "gazette": "reports", "chambers_digest": "notes", "maritime_notes": "notes", "labour_circular": "notes",
}


def _mixed(spark: SparkSession, folder: str, **options) -> mixing.Mix:
    sizes = tokens.sized(table(spark, folder, "documents"), ["doc_id", "source", "lang"])
    return mixing.mix(sizes, table(spark, folder, "mix_target"), **options)


def _stretched(spark: SparkSession, folder: str) -> mixing.Mix:
    """Three times the total that every source reaches: sources and languages fall short and are made up for in their domain first."""
    return _mixed(spark, folder, stretch=3.0, domains=DOMAINS)


def p7_selected(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder).selected


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder).shares


def p7_stretched(spark: SparkSession, folder: str) -> DataFrame:
    return _stretched(spark, folder).shares


def p7_leaves(spark: SparkSession, folder: str) -> DataFrame:
    return _stretched(spark, folder).leaves


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves that can give something, and what breaks a rule: uses beyond ``max_repeats``, rows without a target, documents selected
    twice, leaves that miss their budget by more than half their largest document, budgets beyond the supply."""
    mix = _stretched(spark, folder)
    one = lambda c: F.count(F.when(c, 1))
    goal = F.broadcast(table(spark, folder, "mix_target").select("source", "max_repeats"))
    rows = mix.selected.join(goal, "source", "left").agg(
        one(F.col("uses") > F.col("max_repeats")).alias("over_used"), one(F.col("max_repeats").isNull()).alias("untargeted"), (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("repeated")
    )
    off = F.abs(F.col("tokens") - F.col("budget")) * 2 > F.col("largest")
    leaves = mix.leaves.agg(one(F.col("supply") > 0).alias("leaves"), one(off).alias("off_budget"), one(F.col("budget") > F.col("supply")).alias("over_supply"))
    return rows.join(F.broadcast(leaves))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.sharing_pairs(spans.shared_runs(table(spark, folder, "documents")))


def p8_passages(spark: SparkSession, folder: str) -> DataFrame:
    return spans.passages(spans.shared_runs(table(spark, folder, "documents")))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return spans.sharing_report(docs, spans.shared_runs(docs))


def p8_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines.repeated_lines(table(spark, folder, "documents"))


ALL = (
    p2_found, p2_top, p2_checks, p3_found, p6_fill, p6_report, p6_checks, p7_selected, p7_shares, p7_stretched, p7_leaves, p7_checks, p8_found, p8_passages, p8_report, p8_lines,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in ALL}
