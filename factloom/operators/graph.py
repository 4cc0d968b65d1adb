"""Property-graph operators: lookups, closures, bounded paths, ranks and clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.scoring import PROJECTION_CAP, PROJECTION_FACTOR, edge_weight
from factloom.functions.trust import allows, provenance_rank
from factloom.session import cut, shuffle_partitions

#: Damping and rounds of the rank, share of the global rank in a task's start.
DAMPING, ROUNDS, WARM = 0.85, 50, 0.3
#: Greatest depth of a walk and nodes it visits.
DEPTH, VISITS = 10, 64
#: Merge thresholds of regions and services, cohesion, weight that a cross-unit pair must beat.
MERGE, SERVICE, COHESION = 6, 12, 0.4
#: Most nodes and links of a graph that one task ranks (about 100 MB).
SMALL = 1_000_000
#: Units of an edge's weight.
WEIGHT_UNITS = 1_000_000_000


def trusted(edges: DataFrame, stale_evidence: DataFrame | None = None, **policy) -> DataFrame:
    """Edges that the policy allows and that rest on no stale evidence (id)."""
    out = edges.filter(allows(F.col("provenance"), F.col("confidence"), **policy))
    if stale_evidence is None:
        return out
    bad = out.select("id", F.explode("evidence").alias("e")).join(stale_evidence.select(F.col("id").alias("e")), "e", "left_semi").select("id").distinct()
    return out.join(bad, "id", "left_anti")


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge per (subject, predicate, object): best provenance, greatest confidence, all evidence."""
    return edges.groupBy("subject", "predicate", "object").agg(
        F.max_by("provenance", F.struct(provenance_rank(F.col("provenance")), "provenance")).alias("provenance"),
        F.max("confidence").alias("confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"),
    )


def two_hop(edges: DataFrame, first: str, second: str) -> DataFrame:
    """(root, mid, leaf) over two predicates."""
    a = edges.filter(F.col("predicate") == first).select(F.col("subject").alias("root"), F.col("object").alias("mid"))
    b = edges.filter(F.col("predicate") == second).select(F.col("subject").alias("mid"), F.col("object").alias("leaf"))
    return a.join(b, "mid")


def reach(edges: DataFrame, seeds: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(seed, node, hops): the nodes that each seed (id) reaches over (src, dst) and the least number of hops, itself with 0.

    Each round joins the frontier with the edges and takes off what has been seen.
    """
    links = edges.select("src", "dst").distinct()
    seen = cut(seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("hops")).distinct())
    frontier = seen
    for hop in range(1, depth + 1):
        found = frontier.join(links, frontier["node"] == links["src"]).select("seed", F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def walk_paths(neighbours: dict[str, list[tuple[int, str]]], entry: str, depth: int = DEPTH, visits: int = VISITS) -> list[list[str]]:
    """Breadth-first paths from an entry: targets by provenance rank, then id; a node is entered once; at most ``visits`` nodes are expanded."""
    paths, queue, seen, popped = [], [[entry]], {entry}, 0
    while queue and popped < visits:
        path = queue.pop(0)
        popped += 1
        steps = [t for _, t in sorted(neighbours.get(path[-1], []), key=lambda x: (-x[0], x[1])) if t not in seen]
        if not steps or len(path) > depth:
            if len(path) > 1:
                paths.append(path)
            continue
        for t in steps:
            seen.add(t)
            queue.append([*path, t])
    return paths + [p for p in queue if len(p) > 1]


def expanded(edges: DataFrame, entries: DataFrame, depth: int = DEPTH, visits: int = VISITS) -> DataFrame:
    """(seed, node): the nodes that the walk from each entry (id) expands over (src, dst, rank), ``visits`` of a seed at most.

    Level by level: a level's nodes queue by their parent's place, then by rank and id, and only those within the
    visits that are left go on. A level that passes the visits is the last, so what it leaves out is never needed.
    """
    level = cut(entries.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(1).alias("place")).distinct())
    seen = level
    for _ in range(depth - 1):
        steps = level.join(edges, level["node"] == edges["src"]).groupBy("seed", F.col("dst").alias("node")).agg(F.min(F.struct("place", (-F.col("rank")).alias("rank"), "dst")).alias("key"))
        used = level.groupBy("seed").agg(F.max("place").alias("used")).filter(F.col("used") < visits)
        steps = steps.join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        first = steps.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy("key"))).filter(F.col("n") < visits)
        level = cut(first.join(used, "seed").withColumn("place", F.col("used") + F.col("n")).filter(F.col("place") <= visits).select("seed", "node", "place"))
        if level.isEmpty():
            break
        seen = cut(seen.unionByName(level))
    return seen.select("seed", "node")


def bounded_paths(edges: DataFrame, entries: DataFrame, depth: int = DEPTH, visits: int = VISITS) -> DataFrame:
    """Paths (entry, ordinal, path) of each entry (id) over (src, dst, rank).

    What an entry's task gathers are the edges of the nodes that its walk expands, ``visits`` nodes at most; all of
    them end a path or lead on, so this is what the entry's paths are made of.
    """
    own = expanded(edges, entries, depth, visits).select("seed", F.col("node").alias("src")).join(edges.select("src", "dst", "rank"), "src")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        entry, neighbours = pdf["seed"].iloc[0], {}
        for src, dst, rank in zip(pdf["src"], pdf["dst"], pdf["rank"], strict=True):
            neighbours.setdefault(src, []).append((int(rank), dst))
        found = walk_paths(neighbours, entry, depth, visits)
        return pd.DataFrame({"entry": entry, "ordinal": range(len(found)), "path": found})

    return own.groupBy("seed").applyInPandas(run, "entry string, ordinal int, path array<string>")


def weighted(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(src, dst, weight): weights by predicate, provenance, confidence and rarity, summed by pair and made to sum to 1 by source."""
    degree = edges.groupBy("object").agg(F.count_distinct("subject").alias("degree"))
    total = F.broadcast(entities.agg(F.count("*").alias("total")))
    w = edges.join(degree, "object").join(total)
    # whole numbers, so that sums don't depend on the order of rows
    units = F.round(WEIGHT_UNITS * edge_weight(F.col("predicate"), F.col("provenance"), F.col("confidence"), F.col("total"), F.col("degree"))).cast("long")
    w = w.groupBy(F.col("subject").alias("src"), F.col("object").alias("dst")).agg(F.sum(units).alias("w"))
    sums = w.groupBy("src").agg(F.sum("w").alias("s"))
    return w.join(sums, "src").filter("s > 0").select("src", "dst", (F.col("w") / F.col("s")).alias("weight"))


def _power(nodes: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, t: np.ndarray, rank: np.ndarray, rounds: int, damping: float) -> np.ndarray:
    """The rounds of the rank over node numbers; what nodes without links hold is dealt evenly."""
    loose = np.ones(nodes, bool)
    loose[src] = False
    for _ in range(rounds):
        got = np.bincount(dst, rank[src] * weight, nodes)
        rank = (1 - damping) * t + damping * (got + rank[loose].sum() / nodes)
    return rank


def _small_pagerank(links: DataFrame, base: DataFrame, rounds: int, damping: float) -> DataFrame:
    """The ranks of a graph within SMALL links and nodes, in one task; base: id, t, start."""
    none = lambda df, c, like: F.lit(None).cast(like.schema[c].dataType).alias(c)
    rows = base.select("id", none(base, "dst", links), F.col("t").alias("a"), F.col("start").alias("b"))
    rows = rows.union(links.select("src", "dst", F.col("weight").cast("double"), F.lit(0.0))).repartition(1)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts))
        own = pdf[pdf["dst"].isna()].sort_values("id")
        if len(own):
            number = pd.Series(np.arange(len(own)), index=own["id"])
            edges = pdf[pdf["dst"].notna()].sort_values(["id", "dst"])
            ends = [edges[c].map(number).to_numpy().astype(np.int64) for c in ("id", "dst")]
            rank = _power(len(own), *ends, edges["a"].to_numpy(float), own["a"].to_numpy(float), own["b"].to_numpy(float), rounds, damping)
            yield pd.DataFrame({"id": own["id"].to_numpy(), "rank": rank})

    return rows.mapInPandas(run, f"id {dict(base.dtypes)['id']}, rank double")


def pagerank(links: DataFrame, nodes: DataFrame, seeds: DataFrame | None = None, start: DataFrame | None = None, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(id, rank) over normalised (src, dst, weight) between the nodes (id).

    seeds (id, share): teleport shares, uniform if None. start (id, rank): the
    first vector, else the teleport shares. What nodes without links hold is dealt
    evenly. A graph of at most SMALL links and nodes is ranked in one task; a greater one by
    joins on one partitioning of the links, with checkpoints that cut the lineage.
    """
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    base = nodes.select("id").join(seeds.select("id", "share"), "id", "left").select("id", F.coalesce("share", F.lit(0.0)).alias("t")) if seeds is not None else nodes.select("id", F.lit(1.0 / n).alias("t"))
    first = base.join(start.select("id", F.col("rank").alias("start")), "id", "left").na.fill(0.0, ["start"]) if start is not None else base.withColumn("start", F.col("t"))
    links = cut(links.repartition(shuffle_partitions(links.sparkSession), "src"))
    if max(n, links.count()) <= SMALL:
        return _small_pagerank(links, first, rounds, damping)
    ends = links.select(F.col("src").alias("id")).distinct().withColumn("out", F.lit(1))
    base = cut(first.join(ends, "id", "left"))
    lossy = not base.filter("out is null").isEmpty()
    rank = base.select("id", F.col("start").alias("rank"))
    loose = base.filter("out is null").select("id")
    for i in range(rounds):
        given = links.join(rank, links["src"] == rank["id"]).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") * F.col("weight")).alias("got"))
        new, lost = base.join(given, base["id"] == given["to"], "left"), F.lit(0.0)
        if lossy:
            new = new.join(F.broadcast(rank.join(loose, "id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))))
            lost = F.col("lost")
        rank = new.select("id", ((1 - damping) * F.col("t") + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)).alias("rank"))
        if lossy or i % 10 == 9:  # a round that reads the ranks twice is cut at once, or plans would double
            rank = cut(rank)
    return rank


def connected(edges: DataFrame) -> DataFrame:
    """(id, root): the least id that each end of the edges (src, dst) is connected with; each round takes the least label of the neighbours and of the label's label."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).filter("src is not null and dst is not null").distinct())
    label = cut(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("root")))
    while True:
        near = both.join(label.select(F.col("id").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("root").alias("near"))
        step = label.join(near, "id").select("id", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = step.select(F.col("id").alias("root"), F.col("root").alias("far"))
        new = cut(step.join(jump, "root").select("id", F.least("root", "far").alias("root"), "old"))
        label = new.select("id", "root")
        if new.filter("root <> old").isEmpty():
            return label


def project_ranks(ranks: DataFrame, edges: DataFrame) -> DataFrame:
    """Own rank plus a capped share of the ranks of what each subject relates to."""
    got = edges.select("subject", "object").distinct().join(ranks, F.col("object") == F.col("id")).groupBy("subject").agg(F.sum("rank").alias("near"))
    return ranks.join(got, ranks["id"] == got["subject"], "left").select("id", (F.col("rank") + F.least(PROJECTION_FACTOR * F.coalesce("near", F.lit(0.0)), F.lit(PROJECTION_CAP))).alias("rank"))


def pair_weights(members: DataFrame, group: str, member: str, weight: Column | int) -> DataFrame:
    """(a, b, weight) summed over the groups that both are in; groups of one member give nothing.

    The groups are bounded: see ``co_occurrence`` for the cap on their size.
    """
    one = members.select(group, F.col(member).alias("a")).distinct()
    two = members.select(group, F.col(member).alias("b")).distinct()
    return one.join(two, group).filter("a < b").groupBy("a", "b").agg(F.sum(F.lit(weight) if isinstance(weight, int) else weight).cast("long").alias("weight"))


def co_occurrence(rows: DataFrame, group: str, member: str, least: int = 2, most_members: int = 500) -> DataFrame:
    """(a, b, count) of members that share ``least`` groups or more; groups of more than ``most_members`` say nothing and are left out, as the operator defines."""
    own = rows.select(group, member).distinct()
    sizes = own.groupBy(group).count().filter((F.col("count") >= 2) & (F.col("count") <= most_members)).select(group)
    return pair_weights(own.join(sizes, group, "left_semi"), group, member, 1).filter(F.col("weight") >= least).select("a", "b", F.col("weight").alias("count"))


def agglomerate(names: list[str], weight: dict[tuple[int, int], int], cross: set[tuple[int, int]] = frozenset(), threshold: int = MERGE, linkage: str = "max") -> list[list[str]]:
    """Greedy agglomeration of a small matrix.

    The pair of greatest linkage merges while it reaches the threshold; with
    linkage ``max`` a link below SERVICE must also be cohesive: its mean over all
    pairs is COHESION of it or more. Cross-unit pairs up to SERVICE count 0. Ties go
    to the smallest index pair.
    """
    clusters = [[i] for i in range(len(names))]
    value = lambda i, j: 0 if (min(i, j), max(i, j)) in cross and weight.get((min(i, j), max(i, j)), 0) <= SERVICE else weight.get((min(i, j), max(i, j)), 0)

    def link(a: list[int], b: list[int]) -> tuple[float, float]:
        every = [value(i, j) for i in a for j in b]
        return (sum(every) if linkage == "sum" else max(every)), sum(every) / len(every)

    while True:
        best = None
        for i in range(len(clusters)):
            for j in range(i + 1, len(clusters)):
                top, mean = link(clusters[i], clusters[j])
                if top >= threshold and (linkage == "sum" or top >= SERVICE or mean >= COHESION * top) and (best is None or top > best[0]):
                    best = (top, i, j)
        if best is None:
            return [sorted(names[i] for i in c) for c in clusters]
        _, i, j = best
        clusters[i] = clusters[i] + clusters.pop(j)


def cluster(regions: DataFrame, weights: DataFrame, threshold: int = MERGE, linkage: str = "max") -> DataFrame:
    """(cluster, members) by greedy agglomeration of regions (name, unit) under pair weights (a, b, weight).

    The merge is sequential by definition, so the region matrix, one row per
    region of a repository, is gathered in one task; facts are aggregated to pair
    weights before.
    """
    rows = weights.select("a", "b", "weight", F.lit(None).cast("string").alias("unit")).unionByName(regions.select(F.col("name").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0).cast("long").alias("weight"), "unit"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["b"].isna()].sort_values("a")
        names, units = own["a"].tolist(), dict(zip(own["a"], own["unit"], strict=True))
        at = {n: i for i, n in enumerate(names)}
        weight, cross = {}, set()
        for a, b, w in pdf[pdf["b"].notna()][["a", "b", "weight"]].itertuples(index=False):
            pair = (min(at[a], at[b]), max(at[a], at[b]))
            weight[pair] = int(w)
            if units[a] != units[b]:
                cross.add(pair)
        found = agglomerate(names, weight, cross, threshold, linkage)
        return pd.DataFrame({"cluster": [cluster_name(m) for m in found], "members": found})

    return rows.groupBy(F.lit(0).alias("all")).applyInPandas(run, "cluster string, members array<string>")


def cluster_name(members: list[str]) -> str:
    """Longest common directory of the members, else their names joined by '+'."""
    parts = [m.split("/") for m in sorted(members)]
    common = []
    for level in zip(*parts):  # noqa: B905
        if len(set(level)) > 1:
            break
        common.append(level[0])
    return "/".join(common) or "+".join(sorted(members))


def impact(seeds: DataFrame, contains: DataFrame, calls: DataFrame, depth: int = 3) -> DataFrame:
    """(id, relation) of everything that a change of the seeds (id) touches: members, containers, upstream and downstream."""
    own = seeds.select("id").distinct()
    members = own.join(contains, own["id"] == contains["src"]).select(F.col("dst").alias("id"))
    start = cut(own.union(members).distinct())
    down = reach(calls, start, depth).filter("hops > 0").select(F.col("node").alias("id"), F.lit("downstream").alias("relation"))
    up = reach(calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, depth).filter("hops > 0").select(F.col("node").alias("id"), F.lit("upstream").alias("relation"))
    holders = start.join(contains, start["id"] == contains["dst"]).select(F.col("src").alias("id"), F.lit("container").alias("relation"))
    return start.select("id", F.lit("seed").alias("relation")).union(down).union(up).union(holders).distinct()
