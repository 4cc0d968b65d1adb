"""Keyed writes, cascading deletes, sweeps and registry diffs over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace by key: new rows win, others of the old stay. ``new`` holds a key once."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def latest(rows: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """One row per key, that of the greatest version; one aggregation without a window."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("row"))
    return best.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def registry_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key and change (added, changed, removed, same) between two registries."""
    a, b = old.select(key, F.col(digest).alias("old")), new.select(key, F.col(digest).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def stale(indexed: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys whose digest differs now, or that are gone."""
    now = current.select(key, F.col(digest).alias("__now"))
    return indexed.join(now, key, "left").filter(~F.col(digest).eqNullSafe(F.col("__now"))).select(key)


def purge(files: DataFrame, entities: DataFrame, edges: DataFrame, evidence: DataFrame, occurs: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """Delete all facts of the files ``gone`` (path), each step an anti join on keys.

    files: path. entities: id, path (null for concepts). edges: id, subject,
    object, evidence (array). evidence: id, path. occurs: concept, path. A concept
    stays while one occurrence does, with ``sources`` computed anew.
    """
    lost = gone.select("path").distinct()
    dead_evidence = evidence.join(lost, "path", "left_semi").select("id")
    dead_entities = entities.join(lost, "path", "left_semi").select("id")
    left = occurs.join(lost, "path", "left_anti")
    sources = left.groupBy("concept").agg(F.sort_array(F.collect_set("path")).alias("sources"))
    kept = entities.join(dead_entities, "id", "left_anti")
    concepts = kept.filter("path is null").join(sources, F.col("id") == F.col("concept")).drop("concept")
    kept = kept.filter("path is not null").withColumn("sources", F.array("path")).unionByName(concepts)
    ids = kept.select("id")
    by_evidence = edges.select("id", F.explode_outer("evidence").alias("e")).join(dead_evidence.select(F.col("id").alias("e")), "e", "left_semi").select("id").distinct()
    live = edges.join(ids.withColumnRenamed("id", "subject"), "subject", "left_semi").join(ids.withColumnRenamed("id", "object"), "object", "left_semi")
    return {
        "files": files.join(lost, "path", "left_anti"),
        "entities": kept,
        "edges": live.join(by_evidence, "id", "left_anti"),
        "evidence": evidence.join(lost, "path", "left_anti"),
        "occurs": left,
    }


def sweep(evidence: DataFrame, references: list[DataFrame]) -> DataFrame:
    """Evidence that none of the frames of arrays ``evidence`` refers to."""
    used = None
    for r in references:
        ids = r.select(F.explode("evidence").alias("id"))
        used = ids if used is None else used.union(ids)
    return evidence.join(used.distinct(), "id", "left_anti")


def dangling(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of which an endpoint is no entity, with the missing side."""
    ids = entities.select("id")
    one = edges.join(ids, edges["subject"] == ids["id"], "left_anti").withColumn("missing", F.lit("subject"))
    two = edges.join(ids, edges["object"] == ids["id"], "left_anti").withColumn("missing", F.lit("object"))
    return one.unionByName(two)
