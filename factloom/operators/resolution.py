"""Upgrades of call edges by an outside resolver's table of definitions, their conflicts, and the gate over both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import content_id

# Call sites that one run resolves, confidence of a resolved edge, share that may stay open.
MOST_SITES, UPGRADED, OPEN_SHARE = 500, 0.99, 0.30


def external_edges(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """(file, id, subject, object, callee, line, evidence_id) of extracted calls with the place of their first evidence (id, path, symbol, line)."""
    first = edges.filter("predicate = 'calls' and provenance = 'EXTRACTED'").withColumn("evidence_id", F.get("evidence", F.lit(0)))
    place = evidence.select(F.col("id").alias("evidence_id"), F.col("path").alias("file"), F.col("symbol").alias("callee"), "line")
    return first.join(place, "evidence_id").select("file", "id", "subject", "object", F.coalesce("callee", F.lit("")).alias("callee"), F.coalesce("line", F.lit(0)).alias("line"), "evidence_id")


def candidate_files(sites: DataFrame, most: int = MOST_SITES) -> DataFrame:
    """(file, sites): the files with open calls, in order, until ``most`` sites are taken; the last may be cut, as the operator defines.

    The running sum needs the first files alone: a file takes one site at least, so ``most`` files bound the window.
    """
    counts = sites.groupBy("file").agg(F.count("*").alias("n")).orderBy("file").limit(most)
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("before", before).filter(F.col("before") < most).select("file", F.least(F.col("n"), most - F.col("before")).alias("sites"))


def upgrade(edges: DataFrame, sites: DataFrame, definitions: DataFrame) -> DataFrame:
    """All edges, the open calls that definitions (file, line, callee, target) answer resolved to their target under a new id."""
    answers = sites.join(definitions, ["file", "line", "callee"]).groupBy("id").agg(F.min("target").alias("target"))
    hit = edges.join(answers, "id")
    new = hit.withColumn("object", F.col("target")).withColumn("provenance", F.lit("RESOLVED")).withColumn("confidence", F.lit(UPGRADED))
    new = new.withColumn("id", content_id(F.col("subject"), F.col("predicate"), F.col("object"), F.get("evidence", F.lit(0)))).select(*edges.columns)
    return edges.join(answers.select("id"), "id", "left_anti").unionByName(new)


def diff_upgrades(before: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, callee, old_object, new_object, line): resolved calls now whose first evidence was an open call's before."""
    now = edges.filter("predicate = 'calls' and provenance = 'RESOLVED'").select(F.get("evidence", F.lit(0)).alias("evidence_id"), F.col("object").alias("new_object"))
    return now.join(before, "evidence_id").select("file", "callee", F.col("object").alias("old_object"), "new_object", "line")


def conflicts(upgrades: DataFrame) -> DataFrame:
    """(kind, severity, message) of upgrades to another target, each message once."""
    changed = upgrades.filter("old_object <> new_object")
    message = F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(" call to "), "callee", F.lit(" resolved to "), "new_object", F.lit("; the index had "), "old_object")
    return changed.select(F.lit("resolution_conflict").alias("kind"), F.lit("medium").alias("severity"), message.alias("message")).distinct()


def persist(found: DataFrame, known: DataFrame) -> DataFrame:
    """Findings whose message isn't known yet."""
    return found.join(known.select("message"), "message", "left_anti").select(*found.columns)


def summary(sites: DataFrame, upgrades: DataFrame, group: str) -> DataFrame:
    """(group, external, upgrades, unresolved, agreement, conflicts) of each repository."""
    a = sites.groupBy(group).agg(F.count("*").alias("external"))
    same = F.sum((F.col("old_object") == F.col("new_object")).cast("long"))
    b = upgrades.groupBy(group).agg(F.count("*").alias("upgrades"), same.alias("agreement"), (F.count("*") - same).alias("conflicts"))
    rows = a.join(b, group, "left").na.fill(0, ["upgrades", "agreement", "conflicts"])
    return rows.withColumn("unresolved", F.col("external") - F.col("upgrades"))


def gate(totals: DataFrame, open_share: float = OPEN_SHARE) -> DataFrame:
    """One row: whether no conflict is left and less than ``open_share`` of the calls stays open."""
    s = totals.agg(F.coalesce(F.sum("conflicts"), F.lit(0)).alias("conflicts"), F.coalesce(F.sum("unresolved"), F.lit(0)).alias("unresolved"), F.coalesce(F.sum("external"), F.lit(0)).alias("external"))
    ratio = F.when(F.col("external") == 0, 0.0).otherwise(F.col("unresolved") / F.col("external"))
    passed = (F.col("conflicts") == 0) & ((ratio < open_share) if open_share < 1 else F.lit(True))
    return s.select("conflicts", "unresolved", "external", passed.alias("passed"))
