"""Selection under a token budget: greedy folds, diversification, quotas and cuts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Share of each kind in a surface, and the weight of score against likeness.
QUOTAS = {"public": 0.30, "core": 0.25, "types": 0.15, "state": 0.10, "contract": 0.10, "flow": 0.10}
LAMBDA = 0.5


def fold(items: Column, budget: Column, hard: Column, spent: Column | int = 0) -> Column:
    """Ids that a greedy walk over an array of (id, cost) takes: an item that doesn't fit is skipped and the walk goes on."""
    start = F.struct((spent if isinstance(spent, Column) else F.lit(spent)).cast("long").alias("spent"), F.array().cast("array<string>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["spent"] + x["cost"] <= budget) & (acc["spent"] + x["cost"] <= hard)
        return F.when(fits, F.struct((acc["spent"] + x["cost"]).alias("spent"), F.concat(acc["ids"], F.array(x["id"])).alias("ids"))).otherwise(acc)

    return F.aggregate(items, start, step)


def select_with_budget(items: DataFrame, group: list[str], budget: int, hard: int, by_density: bool = True) -> DataFrame:
    """Choose items (id, cost, value, required) of each group within the budget.

    Required items come first and always stay; the rest go by value per token, or in
    the order of ``position`` without ``by_density``, ties by position. A group is
    one request's candidates and is bounded by the search before it.
    """
    density = F.col("value") / F.greatest(F.col("cost"), F.lit(1))
    order = F.struct((-density if by_density else F.lit(0.0)).alias("order"), F.col("position"), F.col("id").cast("string").alias("id"), F.col("cost").cast("long").alias("cost"), "required")
    rows = items.groupBy(*group).agg(F.sort_array(F.collect_list(order)).alias("all"))
    must, rest = F.filter("all", lambda x: x["required"]), F.filter("all", lambda x: ~x["required"])
    spent = F.aggregate(must, F.lit(0).cast("long"), lambda s, x: s + x["cost"])
    picked = fold(rest, F.lit(budget), F.lit(hard), spent)
    return rows.select(*group, picked.alias("p"), F.transform(must, lambda x: x["id"]).alias("must")).select(*group, F.concat("must", "p.ids").alias("ids"), F.col("p.spent").alias("spent"))


def enforce_quotas(items: DataFrame, group: list[str], tokens: int, quotas: dict[str, float] | None = None) -> DataFrame:
    """(group, kind, ids, spent): each kind takes items in order of position while they fit its share; kinds without a share take all."""
    quotas = QUOTAS if quotas is None else quotas
    cap = F.create_map(*[F.lit(x) for k, v in quotas.items() for x in (k, int(min(1.0, max(0.0, v)) * tokens + 0.5))])[F.col("kind")]
    rows = items.groupBy(*group, "kind").agg(F.sort_array(F.collect_list(F.struct("position", F.col("id").cast("string").alias("id"), F.col("cost").cast("long").alias("cost")))).alias("all"))
    most = F.coalesce(cap, F.lit(2**31 - 1))
    return rows.withColumn("p", fold(F.col("all"), most, most)).select(*group, "kind", F.col("p.ids").alias("ids"), F.col("p.spent").alias("spent"))


def mmr(ranked: list[tuple[str, float, str]], k: int, weight: float = LAMBDA) -> list[str]:
    """Maximal marginal relevance over (id, score, likeness group): likeness is 1 within a group, else 0; ties keep the earlier."""
    left, picked, groups = list(ranked), [], set()
    while left and len(picked) < k:
        best = max(range(len(left)), key=lambda i: (weight * left[i][1] - (1 - weight) * (left[i][2] in groups), -i))
        item = left.pop(best)
        picked.append(item[0])
        groups.add(item[2])
    return picked


def mmr_diversify(candidates: DataFrame, group: list[str], k: int, weight: float = LAMBDA) -> DataFrame:
    """(group, ordinal, id) chosen from candidates (id, score, likeness), a bounded number in each group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values(["score", "id"], ascending=[False, True])
        ids = mmr(list(zip(own["id"], own["score"], own["likeness"], strict=True)), k, weight)
        return pd.DataFrame({**{g: pdf[g].iloc[0] for g in group}, "ordinal": range(len(ids)), "id": ids})

    kinds = dict(candidates.dtypes)
    return candidates.groupBy(*group).applyInPandas(run, ", ".join(f"{g} {kinds[g]}" for g in group) + f", ordinal int, id {kinds['id']}")


def drop_ladder(sections: DataFrame, group: list[str], budget: int, never: int = 9) -> DataFrame:
    """Sections (name, priority, position, cost) that stay: the least priority goes first, the earlier of equals first, until the rest fits; from ``never`` on none goes."""
    rows = sections.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("priority", "position", "name", F.col("cost").cast("long").alias("cost")))).alias("all"))
    total = F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x["cost"])
    start = F.struct(total.alias("total"), F.array().cast("array<string>").alias("kept"))
    step = lambda acc, x: F.when((acc["total"] > budget) & (x["priority"] < never), F.struct((acc["total"] - x["cost"]).alias("total"), acc["kept"].alias("kept"))).otherwise(F.struct(acc["total"].alias("total"), F.concat(acc["kept"], F.array(x["name"])).alias("kept")))
    return rows.withColumn("r", F.aggregate("all", start, step)).select(*group, F.col("r.kept").alias("kept"), F.col("r.total").alias("total"))
