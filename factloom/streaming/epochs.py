"""Generations of facts, the epoch they hash to, and caches that the epoch keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a generation counts.
KINDS = ("source", "semantic", "runtime", "intent", "policy", "model")


def bump(log: DataFrame, kind: str, batch: int) -> DataFrame:
    """The generation log (kind, batch) with one more entry; a batch counts once."""
    return log.unionByName(log.sparkSession.createDataFrame([(kind, batch)], "kind string, batch long")).distinct()


def generations(log: DataFrame) -> DataFrame:
    """One row: the generation of each kind."""
    return log.agg(*[F.count_distinct(F.when(F.col("kind") == k, F.col("batch"))).alias(k) for k in KINDS])


def epoch(log: DataFrame, revision: str) -> DataFrame:
    """One row: the hash of all generations and the revision."""
    return generations(log).select(F.sha2(F.concat_ws(":", *[F.col(k).cast("string") for k in KINDS], F.lit(revision)), 256).alias("epoch"))


def cache_get(cache: DataFrame, key: str, now: str) -> DataFrame:
    """The cached pack of a key, if it is of this epoch."""
    return cache.filter((F.col("key") == key) & (F.col("epoch") == now)).select("pack")


def cache_put(cache: DataFrame, key: str, now: str, pack: str) -> DataFrame:
    new = cache.sparkSession.createDataFrame([(key, now, pack)], "key string, epoch string, pack string")
    return cache.filter(F.col("key") != key).unionByName(new)


def record_visible(ledger: DataFrame, shown: DataFrame, now: str) -> DataFrame:
    """The ledger (epoch, id) with what has been shown; entries of other epochs go."""
    return ledger.filter(F.col("epoch") == now).unionByName(shown.select(F.lit(now).alias("epoch"), "id")).distinct()


def unseen(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    return candidates.join(ledger.select("id"), "id", "left_anti")
