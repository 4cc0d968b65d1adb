"""Flows from paths of calls: steps, causal graphs, lifecycles, workflows and invariants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import ascii_lower
from factloom.functions.trust import provenance_rank
from factloom.operators.derive import flow_exits, flow_joins, merge_flow_edges

# Names of state transitions; endings and parts of the names of classes that hold a state.
TRANSITIONS = "advance transition set_status set_state move_to next_state retry cancel fail complete pause resume".split()
STATE_ENDS, STATE_PARTS = ("state", "status", "stage"), ("statemachine", "machine", "fsm")
_RETRY = r"(?i)(retry|fallback|backoff)"


def compile_flows(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(flow, order, actor, operation, provenance, evidence): the paths (entry, path) of an entry merged into steps, in the order first seen.

    edges: src, dst, provenance, evidence; a step takes the best provenance and all evidence of the calls into it.
    """
    steps = paths.select(F.col("entry").alias("flow"), "ordinal", F.posexplode("path").alias("pos", "node"), "path")
    steps = steps.withColumn("src", F.when(F.col("pos") > 0, F.get("path", F.col("pos") - 1))).drop("path")
    into = edges.select("src", F.col("dst").alias("node"), "provenance", "evidence")
    rows = steps.join(into, ["src", "node"], "left")
    merged = rows.groupBy("flow", "node").agg(
        F.min(F.struct("pos", "ordinal")).alias("seen"),
        F.max_by("provenance", F.struct(provenance_rank(F.col("provenance")), "provenance")).alias("provenance"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"),
    )
    placed = merged.groupBy("flow").agg(F.sort_array(F.collect_list(F.struct("seen", "node", "provenance", "evidence"))).alias("s"))  # one entry's bounded walk
    out = placed.select("flow", F.posexplode("s").alias("order", "x"))
    return out.select("flow", (F.col("order") + 1).alias("order"), actor_of(F.col("x.node")).alias("actor"), operation_of(F.col("x.node")).alias("operation"), "x.provenance", "x.evidence")


def actor_of(node: Column) -> Column:
    """The file or owner that a symbol id names, else the id."""
    found = F.regexp_extract(node, r"^symbol:([^#]*)#", 1)
    return F.when(found == "", node).otherwise(found)


def operation_of(node: Column) -> Column:
    return F.regexp_extract(node, r"([^#/:]+)$", 1)


def flow_graph(paths: DataFrame, calls: DataFrame) -> dict[str, DataFrame]:
    """edges (from, to, kind, ...), joins and exits of the causal graph of all paths.

    calls: src, dst, block, provenance, evidence; the block of a call tells branches, loops, errors and retries.
    """
    pairs = paths.select(F.posexplode("path").alias("pos", "to"), "path").filter("pos > 0").select(F.get("path", F.col("pos") - 1).alias("src"), F.col("to").alias("dst")).distinct()
    kind = F.when(F.col("block") == "branch", "branch_true").when(F.col("block") == "loop", "loop_back").when(F.col("block") == "error", "error").when(F.col("dst").rlike(_RETRY), "retry").when(F.col("dst").startswith("topic:") | F.col("dst").startswith("store:"), "publish").otherwise("next")
    rows = pairs.join(calls, ["src", "dst"]).select(F.col("src").alias("from"), F.col("dst").alias("to"), kind.alias("kind"), F.col("block").alias("condition"), F.lit(0).alias("ordinal"), "provenance", "evidence")
    edges = merge_flow_edges(rows)
    return {"edges": edges, "joins": flow_joins(edges), "exits": flow_exits(edges)}


def provenance_summary(edges: DataFrame) -> DataFrame:
    """One row: a map of provenance to the number of edges."""
    n = edges.groupBy("provenance").agg(F.count("*").alias("n"))
    return n.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("provenance", "n")))).alias("summary"))


def _base_name(name: Column) -> Column:
    """The last part of a dotted name, A-Z lowered."""
    return ascii_lower(F.element_at(F.split(name, r"\."), -1))


def is_transition_verb(name: Column) -> Column:
    n = _base_name(name)
    return n.isin(TRANSITIONS) | n.startswith("mark_")


def is_signal(name: Column, kind: Column, signature: Column) -> Column:
    """Whether a symbol tells of a state machine: a class or enum named so, an Enum in its signature, or a transition's name."""
    n = ascii_lower(name)
    named = F.lit(False)
    for end in STATE_ENDS:
        named = named | n.endswith(end)
    for part in STATE_PARTS:
        named = named | n.contains(part)
    return (F.coalesce(kind, F.lit("")).isin("class", "enum") & named) | F.coalesce(signature, F.lit("")).contains("Enum") | is_transition_verb(name)


def verb_category(name: Column) -> Column:
    """Condition of a lifecycle's step."""
    n = _base_name(name)
    begins = lambda *words: reduce(lambda x, w: x | n.startswith(w), words, F.lit(False))
    return (
        F.when(n == "retry", "retry").when(begins("mark_", "set_"), "event").when(begins("transition", "advance", "move", "next"), "transition")
        .when(n.isin("cancel", "fail", "complete"), "terminal outcome").otherwise("state")
    )


def lifecycles(symbols: DataFrame, component: str = "component") -> DataFrame:
    """(component, order, operation, condition): the signals (name, kind, signature) of components with two or more, by name, after a step for the component itself."""
    rows = symbols.filter(is_signal(F.col("name"), F.col("kind"), F.col("signature")))
    got = rows.groupBy(component).agg(F.sort_array(F.collect_list(F.struct("name", verb_category(F.col("name")).alias("condition")))).alias("s")).filter(F.size("s") >= 2)
    steps = F.concat(F.array(F.struct(F.col(component).cast("string").alias("name"), F.lit(None).cast("string").alias("condition"))), F.col("s"))
    return got.select(component, F.posexplode(steps).alias("pos", "x")).select(component, (F.col("pos") + 1).alias("order"), F.col("x.name").alias("operation"), F.col("x.condition").alias("condition"))


def workflows(symbols: DataFrame, component: str = "component") -> DataFrame:
    """(component, steps): components with two retry, fallback or backoff symbols or more."""
    own = symbols.filter(F.col("name").rlike(_RETRY)).groupBy(component).agg(F.sort_array(F.collect_set("name")).alias("steps"))
    return own.filter(F.size("steps") >= 2)


def resolve_scopes(invariants: DataFrame, entities: DataFrame) -> DataFrame:
    """(invariant, scope, id): each name of an invariant's scope with the entity of that name, in any case; null if there is none."""
    names = entities.groupBy(F.lower("name").alias("k")).agg(F.min("id").alias("id"))
    rows = invariants.select(F.col("name").alias("invariant"), F.explode("scope").alias("scope")).withColumn("k", F.lower("scope"))
    return rows.join(names, "k", "left").select("invariant", "scope", "id")
