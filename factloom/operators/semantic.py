"""Vectors of entities and claims of an outside summarizer; models are given as functions or tables, nothing here calls a network."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.scoring import cosine
from factloom.session import prepare

# Kinds of entities that get vectors, texts that a model takes at once, candidates that are ranked again.
EMBED_KINDS = ("symbol", "component", "route", "data_entity", "data_store", "test")
EMBED_BATCH, RERANKED = 32, 30
# What each adapter may do (name, file access, subprocess); none uses the network or credentials.
ADAPTERS = (
    ("native", "repo-read", False), ("scip", "external-file", False), ("ccg", "external-file", False), ("gitnexus", "external-file", False),
    ("lsp-pyright", "repo-read", True), ("lsp-tsserver", "repo-read", True), ("configrefs", "repo-read", False), ("failures", "repo-read", False), ("runtime", "repo-read", False),
)


def adapter_manifests(spark: SparkSession) -> DataFrame:
    """(name, filesystem, network, subprocess, credentials) of each adapter. Those that need a subprocess take a table of definitions here."""
    return spark.createDataFrame([(n, f, False, s, False) for n, f, s in ADAPTERS], "name string, filesystem string, network boolean, subprocess boolean, credentials boolean")


def entity_texts(entities: DataFrame) -> DataFrame:
    """(id, text): name, docstring and responsibility of the entities that get vectors."""
    said = F.get_json_object("attributes", "$.responsibility")
    return entities.filter(F.col("kind").isin(*EMBED_KINDS)).select("id", F.concat_ws(" ", "name", F.nullif("docstring", F.lit("")), said).alias("text"))


def embed(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], name: str) -> DataFrame:
    """(id, vector, model) of texts (id, text); the model gets EMBED_BATCH texts at most at once, on the executors.

    Null texts count as empty; a model that gives another number of vectors than it got texts fails the task.
    """
    prepare(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, said = b.column("id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
            vectors: list[list[float]] = []
            for i in range(0, len(said), EMBED_BATCH):
                part = said[i : i + EMBED_BATCH]
                got = model(part)
                if len(got) != len(part):
                    raise ValueError(f"the model gave {len(got)} vectors for {len(part)} texts")
                vectors += got
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(vectors, pa.list_(pa.float32())), pa.array([name] * len(ids), pa.string())], names=["id", "vector", "model"])

    return texts.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(run, "id string, vector array<float>, model string")


def semantic_scores(embeddings: DataFrame, goal: list[float]) -> DataFrame:
    """(id, score): cosine of each vector to the goal's; entities without a vector have no row and count as 0."""
    return embeddings.select("id", cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in goal]) if goal else F.array().cast("array<double>")).alias("score"))


def ranked_again(candidates: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, score) of candidates (id, kind, name, score), the best RERANKED scored again by (id, text) -> (id, score); if the scorer fails they stay as they are."""
    from factloom.operators.search import rerank

    best = candidates.orderBy(F.desc("score"), "id").limit(RERANKED).select("id", F.concat_ws(" ", "kind", "name").alias("text"))
    kept = candidates.select("id", "score")
    try:
        scores = scorer(best).select("id", F.col("score").cast("double").alias("score"))
        rows = scores.collect()  # RERANKED rows at most; a failure shows here
    except Exception:  # noqa: BLE001  whatever the outside model raises
        return kept
    return rerank(kept, candidates.sparkSession.createDataFrame([tuple(r) for r in rows], "id string, score double"), RERANKED)


def checked_claims(claims: DataFrame, keys: list[str], order: Column, claim: str, evidence: str, known: DataFrame) -> DataFrame:
    """keys, position, claim, unknown, line: claims held against the ids known to their pack.

    claims: keys, a claim's text and its evidence (array of ids). known: keys, id. ``unknown`` lists evidence that the pack doesn't
    know, in the claim's order; ``line`` is the claim with its evidence, null if it is rejected, that is without text or with unknown evidence. Claims of a pack are numbered
    from 0 by ``order``, which must tell them apart; a pack stands if none of its claims is rejected.
    """
    from pyspark.sql import Window

    rows = claims.withColumn("position", (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("int"))
    rows = rows.withColumn("evidence_", F.coalesce(F.col(evidence), F.array().cast("array<string>")))
    each = rows.select(*keys, "position", F.posexplode("evidence_").alias("place", "id"))
    bad = each.join(known.select(*keys, "id").distinct(), [*keys, "id"], "left_anti").groupBy(*keys, "position").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("bad"))
    rows = rows.join(bad, [*keys, "position"], "left").withColumn("unknown", F.coalesce(F.col("bad")["id"], F.array().cast("array<string>")))
    text = F.coalesce(F.col(claim), F.lit(""))
    shown = F.when(F.size("evidence_") == 0, F.lit("none (unverified)")).otherwise(F.array_join("evidence_", ", "))
    line = F.when((text != "") & (F.size("unknown") == 0), F.concat(F.lit("- "), text, F.lit(" [evidence: "), shown, F.lit("]")))
    return rows.select(*keys, "position", text.alias("claim"), "unknown", line.alias("line"))


def claims_text(pack: str, source: str, lines: list[str]) -> str:
    """A pack followed by the claims of an outside summarizer, marked as inferred."""
    return f"<!-- claims compressed by external summarizer: {source[:80]} — INFERRED, not verified facts -->\n\n{pack}\n## EXTERNAL CLAIMS (INFERRED)\n" + "".join(f"{x}\n" for x in lines)
