"""Derived facts: evidence summaries, authority, archetypes, drift, coverage and flow graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.trust import lookup, provenance_rank

# Order of the edge kinds of a flow graph.
EDGE_RANK = {k: i for i, k in enumerate("next branch_true branch_false switch_case loop_back async_spawn join retry error publish consume callback".split())}


def evidence_summary(subjects: DataFrame, evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """(type, count): evidence of the subjects (id, evidence) by type, STALE first of all, and their edges by provenance."""
    ids = subjects.select(F.explode("evidence").alias("id")).distinct()
    kinds = evidence.join(ids, "id", "left_semi").groupBy(F.when(F.col("stale"), "STALE").otherwise(F.col("type")).alias("type")).count()
    own = edges.join(subjects.select(F.col("id").alias("subject")), "subject", "left_semi").groupBy(F.col("provenance").alias("type")).count()
    return kinds.union(own).groupBy("type").agg(F.sum("count").alias("count"))


def mode(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value): the most frequent value, of equals the first."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.min_by(value, F.struct(-F.col("n"), value)).alias(value))


def writer_groups(writes: DataFrame, target: str, writer: str) -> DataFrame:
    """(target, writers) of targets with two writers or more."""
    return writes.groupBy(target).agg(F.sort_array(F.collect_set(writer)).alias("writers")).filter(F.size("writers") >= 2)


def unanimous(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value): the value that all rows agree on, else null."""
    return rows.groupBy(group).agg(F.when(F.count_distinct(value) == 1, F.min(value)).alias(value))


def archetype(counts: DataFrame, scores: dict[str, Column]) -> DataFrame:
    """(archetype, score): the class of the best score over one row of counts, of equals the first listed; Unknown at 0."""
    rows = F.array(*[F.struct(s.cast("double").alias("score"), F.lit(-i).alias("rank"), F.lit(n).alias("archetype")) for i, (n, s) in enumerate(scores.items())])
    best = F.array_max(rows)
    return counts.select(F.when(best["score"] > 0, best["archetype"]).otherwise("Unknown").alias("archetype"), best["score"].alias("score"))


def drift(declared: DataFrame, actual: DataFrame, key: str, kind: str) -> DataFrame:
    """Findings (kind, message) for declared keys that nothing actual answers."""
    return declared.select(key).distinct().join(actual.select(key).distinct(), key, "left_anti").select(F.lit(kind).alias("kind"), F.concat_ws(": ", F.lit(kind), F.col(key).cast("string")).alias("message"))


def coverage(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """(measure, percent): floor of 100 times the share of rows on which each flag holds."""
    n = F.greatest(F.count("*"), F.lit(1))
    one = rows.agg(*[F.floor(100 * F.sum(F.when(c, 1).otherwise(0)) / n).cast("long").alias(m) for m, c in flags.items()])
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in flags]), F.array(*[F.col(m) for m in flags]))).alias("measure", "percent"))


def merge_flow_edges(edges: DataFrame) -> DataFrame:
    """One edge per (from, to, kind): best provenance, first condition, all evidence."""
    return edges.groupBy("from", "to", "kind").agg(
        F.max_by("provenance", F.struct(provenance_rank(F.col("provenance")), "provenance")).alias("provenance"),
        F.min_by("condition", "ordinal").alias("condition"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"),
    )


def flow_joins(edges: DataFrame) -> DataFrame:
    """Nodes that several edges enter."""
    return edges.groupBy(F.col("to").alias("node")).agg(F.count_distinct("from").alias("entries")).filter("entries > 1")


def flow_exits(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("to").alias("node")).distinct().join(edges.select(F.col("from").alias("node")).distinct(), "node", "left_anti")


def edge_rank(kind: Column) -> Column:
    return lookup(EDGE_RANK, kind, len(EDGE_RANK))


def overloads(symbols: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Number declarations of one name: the first keeps its id, others get '#k'."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return symbols.withColumn("overload", k).withColumn("suffix", F.when(F.col("overload") > 0, F.concat(F.lit("#"), F.col("overload").cast("string"))).otherwise(""))


def carry_forward(rows: DataFrame, group: list[str], order: Column, value: Column, name: str, including: bool = False) -> DataFrame:
    """Add the last non-null value above each row, the row itself excluded unless ``including``."""
    from pyspark.sql import Window

    frame = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if including else -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(frame))


def compare_runs(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, delta, ratio) over two runs; a section that one of them lacks has no delta."""
    one, two = a.select(key, F.col(value).alias("before")), b.select(key, F.col(value).alias("after"))
    both = one.join(two, key, "full_outer")
    return both.withColumn("delta", F.col("after") - F.col("before")).withColumn("ratio", F.when(F.col("before") == 0, 0.0).otherwise(F.col("after") / F.col("before")))


def ci_gate(findings: DataFrame, allowed: str = "medium") -> DataFrame:
    """One row: whether no finding's severity is above the allowed one, and the worst."""
    from factloom.functions.trust import severity_rank

    worst = F.coalesce(F.max(severity_rank(F.col("severity"))), F.lit(-1))
    return findings.agg((worst <= severity_rank(F.lit(allowed))).alias("passed"), worst.alias("worst"))
