"""Keyed state beside the facts: versioned Parquet folders that are replaced, merged or emptied as a whole."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import store
from factloom.session import delete_folder

#: The tables and their columns.
SCHEMAS = {
    "meta": "key string, value string",
    "components": "id string, name string, dirs array<string>, boundary string, attributes string",
    "flows": "id string, entrypoint string, trigger string, steps array<struct<order:int,actor:string,operation:string,provenance:string,evidence:array<string>>>",
    "flow_graphs": "id string, graph string",
    "invariants": "id string, name string, statement string, severity string, scope array<string>",
    "intent_claims": "source string, claim string",
    "runtime_edges": "source string, target string, count long, sum_ms double, errors long",
    "drift": "kind string, severity string, message string, resolved boolean",
    "embeddings": "id string, vector array<float>, model string",
    "cache": "key string, epoch string, pack string",
    "ranks": "id string, rank double, key string",
    "links": "src string, dst string, weight double, key string",
    "cochange": "a string, b string, count long, key string",
    "ledger": "epoch string, id string",
    "epochs": "kind string, batch long",
    "checkpoints": "id string, body string",
}
#: What a purge empties; caches of vectors, graphs of flows and settings stay.
PURGED = ("components", "flows", "invariants", "intent_claims", "runtime_edges", "drift", "cache", "ranks", "links", "ledger")


class State:
    """Tables below ``folder``. A write goes to a new version, which readers see once it is complete; the version before the last is deleted."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        """Complete versions, oldest first."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, name: str) -> DataFrame:
        """The table as it is now; one that was never written is empty."""
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}/{versions[-1]}")

    def replace(self, name: str, rows: DataFrame) -> None:
        """Delete all and insert; columns are taken by name."""
        versions = self._versions(name)
        columns = self.spark.createDataFrame([], SCHEMAS[name]).schema
        rows.select(*[F.col(f.name).cast(f.dataType) for f in columns]).write.mode("overwrite").parquet(f"{self.folder}/{name}/{versions[-1] + 1 if versions else 0}")
        for old in versions[:-1]:
            delete_folder(self.spark, f"{self.folder}/{name}/{old}")

    def merge(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Insert or replace by key."""
        self.replace(name, store.upsert(self.read(name), rows.select(*self.read(name).columns), keys))

    def clear(self, name: str) -> None:
        self.replace(name, self.spark.createDataFrame([], SCHEMAS[name]))

    def purge(self) -> None:
        for name in PURGED:
            self.clear(name)

    # settings and schema versions

    def meta_set(self, key: str, value: str) -> None:
        self.merge("meta", self.spark.createDataFrame([(key, value)], SCHEMAS["meta"]), ["key"])

    def meta_get(self, key: str) -> str | None:
        row = self.read("meta").filter(F.col("key") == key).first()
        return row["value"] if row else None

    def migrate(self, steps: dict[int, callable]) -> int:
        """Run the steps above the stored schema version in order; returns the version."""
        done = int(self.meta_get("schema_version") or 0)
        for version in sorted(v for v in steps if v > done):
            steps[version](self)
            self.meta_set("schema_version", str(version))
            done = version
        return done

    # generations

    def bump(self, kind: str) -> None:
        from factloom.streaming import epochs

        log = self.read("epochs")
        batch = log.filter(F.col("kind") == kind).agg(F.coalesce(F.max("batch"), F.lit(-1)) + 1).first()[0]
        self.replace("epochs", epochs.bump(log, kind, batch))

    def epoch(self, revision: str = "") -> str:
        from factloom.streaming import epochs

        return epochs.epoch(self.read("epochs"), revision).first()[0]

    # derived tables with a rule of their own

    def replace_intent_claims(self, rows: DataFrame) -> None:
        self.replace("intent_claims", rows)
        self.bump("intent")

    def add_findings(self, rows: DataFrame) -> None:
        """Findings (kind, severity, message) that aren't known yet; they are open."""
        known = self.read("drift")
        new = rows.dropDuplicates(["message"]).join(known.select("message"), "message", "left_anti").withColumn("resolved", F.lit(False))
        self.replace("drift", known.unionByName(new.select(*known.columns)))

    def clear_findings(self) -> None:
        self.clear("drift")

    def flow_graphs(self, schema: str) -> DataFrame:
        """The stored graphs decoded by a schema."""
        return self.read("flow_graphs").select("id", F.from_json("graph", schema).alias("graph"))

    def cached(self, name: str, key: str, build: callable) -> DataFrame:
        """The table if its rows are of ``key``, else what ``build`` gives, stored under it."""
        rows = self.read(name).filter(F.col("key") == key)
        if rows.isEmpty():
            self.replace(name, build().withColumn("key", F.lit(key)))
            rows = self.read(name)
        return rows.drop("key")

    def save_checkpoint(self, id_: str, body: dict) -> None:
        self.merge("checkpoints", self.spark.createDataFrame([(id_, json.dumps(body, sort_keys=True))], SCHEMAS["checkpoints"]), ["id"])
