"""Lexical retrieval: inverted index, BM25, substring tiers and fused candidates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of BM25, as SQLite documents them.
K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf, len): terms are lowered runs of ASCII letters and digits."""
    found = docs.select(key, F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "").alias("t"))
    rows = found.select(key, F.size("t").cast("long").alias("len"), F.explode("t").alias("term"))
    return rows.groupBy(key, "len", "term").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, key: str, n_docs: Column | int, mean_len: Column | float, terms: list[str]) -> DataFrame:
    """(key, score) of the documents that hold every term, as an AND query asks."""
    hits = index.filter(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    n, mean = (x if isinstance(x, Column) else F.lit(x) for x in (n_docs, mean_len))
    idf = F.greatest(F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    scored = hits.join(F.broadcast(df), "term").withColumn("part", part)  # a row for each query term
    return scored.groupBy(key).agg(F.sum("part").alias("score"), F.count("*").alias("n")).filter(F.col("n") == len(set(terms))).select(key, "score")


def bm25_any(index: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """(key, score) of the documents that hold any of the terms: the sum of what each gives."""
    sizes = index.groupBy(key, "len").agg(F.lit(1).alias("one"))
    stats = F.broadcast(sizes.agg(F.count("*").alias("n"), F.avg("len").alias("mean")))  # one row
    hits = index.filter(F.col("term").isin(terms))
    df = F.broadcast(hits.groupBy("term").agg(F.count("*").alias("df")))  # a row for each query term
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return hits.join(df, "term").join(stats).groupBy(key).agg(F.sum(F.round(part, 9).cast("decimal(20,9)")).cast("double").alias("score"))


def prefix_search(index: DataFrame, key: str, text: str) -> DataFrame:
    """Keys of the documents that hold, for every word of the text, a term that begins with it."""
    words = [w for w in re.split(r"[^\w.-]+", text.lower()) if w]
    if not words:
        return index.select(key).limit(0)
    hit = [F.max(F.col("term").startswith(w).cast("int")) for w in words]
    return index.groupBy(key).agg(F.least(*hit, F.lit(1)).alias("all")).filter("all = 1").select(key)


def rerank(candidates: DataFrame, scores: DataFrame, most: int = 30) -> DataFrame:
    """(id, score): the first ``most`` candidates by a fifth of their score and five times an outside score (id, score), ties by id; others keep theirs."""
    top = candidates.orderBy(F.desc("score"), "id").limit(most).join(scores.select("id", F.col("score").alias("outside")), "id", "left")
    new = top.select("id", (0.2 * F.col("score") + 5 * F.coalesce("outside", F.lit(0.0))).alias("score"))
    return new.unionByName(candidates.join(new.select("id"), "id", "left_anti").select("id", "score")).orderBy(F.desc("score"), "id")


def like_search(rows: DataFrame, key: str, name: str, body: str, needle: str | list[str], k: int) -> DataFrame:
    """Case-insensitive substring, of one or any of several needles: hits in the name first, then the shortest name, then the key; the first k."""
    needles = [n.lower() for n in ([needle] if isinstance(needle, str) else needle)]
    holds = lambda c: reduce(lambda x, n: x | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(n)), needles, F.lit(False))
    in_name = holds(name)
    hits = rows.filter(in_name | holds(body)).withColumn("tier", F.when(in_name, 0).otherwise(1))
    return hits.orderBy("tier", F.char_length(name), key).limit(k).select(key, name, "tier")


def position_scores(ranked: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Score (k - i) / k by position from 0, for the first k rows."""
    top = ranked.orderBy(*order).limit(k)  # bounded before the window sees it
    place = F.row_number().over(Window.orderBy(*order)) - 1
    return top.withColumn("position", place).withColumn("score", (k - F.col("position")) / F.lit(float(k)))


def fuse(candidates: DataFrame, k: int) -> DataFrame:
    """(id, score, reason): the first push of an id, by source then position, counts; the best k, ties by id."""
    first = candidates.groupBy("id").agg(F.min_by(F.struct("score", "reason"), F.struct("source", "position")).alias("x"))
    return first.select("id", "x.score", "x.reason").orderBy(F.desc("score"), "id").limit(k)
