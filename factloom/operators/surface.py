"""Ranked surfaces, packs and atlases as text under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import estimate_tokens, first_sentence, truncate_to_budget

# Kinds of a surface and what puts an entry there; confidences of entry points and contracts.
ENTRY_CONFIDENCE = {"http": 0.95, "cli": 0.95, "queue": 0.9, "schedule": 0.9, "event": 0.85, "export": 0.7}


def quota_kind(row: dict[str, Column]) -> Column:
    """public, state, contract, flow, types or core; ``row`` gives exported, writes, contract, flows, symbol_kind."""
    return (
        F.when(row["exported"], "public").when(row["writes"] > 0, "state").when(row["contract"], "contract").when(row["flows"] > 0, "flow")
        .when(row["symbol_kind"].isin("class", "interface", "type", "enum", "struct", "trait"), "types").otherwise("core")
    )


def entry_reasons(row: dict[str, Column]) -> Column:
    """Why an entry is shown, in a fixed order."""
    parts = [F.when(row["exported"], "public api"), F.when(row["writes"] > 0, "owns state"), F.when(row["contract"], "contract"), F.when(row["flows"] > 0, "in flow"), F.when(row["rank"] >= 0.05, "high rank")]
    return F.array_compact(F.array(*parts))


def render_entry(level: Column, name: Column, path: Column, signature: Column, docstring: Column, callers: Column) -> Column:
    """An entry at a level of compression: 0 all, 1 without callers, 2 signature, 3 name alone."""
    sig, doc = F.coalesce(signature, name), F.coalesce(first_sentence(docstring), F.lit(""))
    head = F.concat(sig, F.lit(" — "), path)
    with_doc = F.when(doc != "", F.concat(head, F.lit("\n  "), doc)).otherwise(head)
    with_callers = F.when(F.size(callers) > 0, F.concat(with_doc, F.lit("\n  callers: "), F.array_join(callers, ", "))).otherwise(with_doc)
    return F.when(level == 0, with_callers).when(level == 1, with_doc).when(level == 2, head).otherwise(name)


def render_groups(entries: DataFrame) -> DataFrame:
    """One text of entries (component, path, position, text): components and files in order, each under its heading.

    The entries of a surface are bounded by the selection before.
    """
    files = entries.groupBy("component", "path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n").alias("text"))
    comps = files.groupBy("component").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "text"))), lambda x: F.concat(F.lit("### "), x["path"], F.lit("\n"), x["text"])), "\n").alias("text"))
    return comps.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("component", "text"))), lambda x: F.concat(F.lit("## "), x["component"], F.lit("\n"), x["text"])), "\n\n").alias("text"))


def render_pack(sections: DataFrame, kept: DataFrame, budget: int) -> DataFrame:
    """(request, text, tokens, truncated) of the kept sections (request, name, position, text) within the budget."""
    names = kept.select("request", F.explode("kept").alias("name"))
    rows = sections.join(names, ["request", "name"]).groupBy("request").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "name", "text"))), lambda x: F.concat(F.lit("# "), x["name"], F.lit("\n"), x["text"])), "\n\n").alias("all"))
    cut = truncate_to_budget(F.col("all"), budget)
    return rows.select("request", cut.alias("text"), estimate_tokens(cut).alias("tokens"), (F.char_length("all") > 4 * budget).alias("truncated"))


def omission_lines(omitted: DataFrame) -> DataFrame:
    """(kind, n) of what a budget left out."""
    return omitted.groupBy("kind").agg(F.count("*").alias("n"))


def merge_contracts(rows: DataFrame) -> DataFrame:
    """Contracts of one subclass and set of operations as one, with all consumers and evidence."""
    return rows.groupBy("subclass", F.array_sort("operations").alias("operations")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("consumers")))).alias("consumers"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence")
    )


def structural_units(symbols: DataFrame, paths: list[str], deep: list[str], most: int = 200) -> DataFrame:
    """(path, text): a skeleton of each requested file: its symbols by line, with docstrings for the deep ones; ``most`` symbols of a file."""
    own = symbols.filter(F.col("path").isin(paths))
    line = F.concat(F.lpad(F.col("line").cast("string"), 5, " "), F.lit("  "), F.coalesce("signature", "name"), F.when(F.col("path").isin(deep or [""]) & F.col("docstring").isNotNull(), F.concat(F.lit("  # "), first_sentence(F.col("docstring")))).otherwise(""))
    rows = own.groupBy("path").agg(F.slice(F.sort_array(F.collect_list(F.struct("line", "name", line.alias("text")))), 1, most).alias("x"))
    return rows.select("path", F.array_join(F.transform("x", lambda e: e["text"]), "\n").alias("text"))


def landmarks(symbols: DataFrame, ranks: DataFrame, most: int = 40) -> DataFrame:
    """The exported symbols of the best rank, ``most`` at most by definition."""
    return symbols.filter("exported").join(ranks, "id").orderBy(F.desc("rank"), "id").limit(most).select("id", "name", "path", "rank")
