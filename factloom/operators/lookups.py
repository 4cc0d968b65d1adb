"""Lookups over the fact tables: filters that reach the scan, and small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.trust import claim_allowed


def symbols_named(entities: DataFrame, name: str) -> DataFrame:
    return entities.filter((F.col("kind") == "symbol") & (F.col("name") == name)).select("id", "path", "signature")


def symbols_in_file(entities: DataFrame, path: str) -> DataFrame:
    """The symbols of a file by line, then name."""
    return entities.filter((F.col("kind") == "symbol") & (F.col("path") == path)).orderBy("line", "name", "id")


def edges_with_source(edges: DataFrame, path: str, predicate: str) -> DataFrame:
    """Ids of the edges that a file gave."""
    return edges.filter((F.col("path") == path) & (F.col("predicate") == predicate)).select("id")


def entity_sources(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, path): each entity (id, path) with its own file and those of the edges (subject, object, path) at it, each once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("subject", "object"))).alias("id"), "path").distinct()
    at = ends.join(entities.select("id").distinct(), "id", "left_semi")
    return entities.select("id", "path").union(at).filter("path is not null").distinct()


def first_named(entities: DataFrame, names: DataFrame) -> DataFrame:
    """(name, id): the first symbol of each name asked for."""
    own = entities.filter("kind = 'symbol'").join(names.select("name").distinct(), "name", "left_semi")
    return own.groupBy("name").agg(F.min("id").alias("id"))


def exported_names(entities: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("class", "interface")) -> DataFrame:
    """Names of the exported symbols of certain kinds (``symbol_kind``), each once."""
    out = edges.filter("predicate = 'exports'").select(F.col("object").alias("id"))
    return entities.filter(F.col("symbol_kind").isin(*kinds)).join(out, "id", "left_semi").select("name").distinct()


def concept_occurrences(edges: DataFrame, entities: DataFrame, concept: str) -> DataFrame:
    """The entities that occur for a concept, by id."""
    own = edges.filter((F.col("predicate") == "occurs") & (F.col("object") == concept)).select(F.col("subject").alias("id")).distinct()
    return entities.join(own, "id", "left_semi").orderBy("id")


def ubiquity(edges: DataFrame) -> DataFrame:
    """(id, sources): how many different subjects refer to each object."""
    return edges.groupBy(F.col("object").alias("id")).agg(F.count_distinct("subject").alias("sources"))


def locations(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, places): where the ends of each edge are, as distinct path:line-end_line of the symbols among them."""
    place = F.when(F.col("line").isNotNull(), F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit("-"), F.coalesce("end_line", "line").cast("string")))
    at = entities.filter("kind = 'symbol'").select(F.col("id").alias("end"), place.alias("place"))
    ends = edges.select("id", F.explode(F.array("subject", "object")).alias("end")).join(at, "end", "left")
    return ends.groupBy("id").agg(F.sort_array(F.collect_set("place")).alias("places"))


def evidence_lines(edges: DataFrame, evidence: DataFrame, default: int = 0) -> DataFrame:
    """(id, line): the least line of each edge's evidence (id, line), else the default."""
    rows = edges.select("id", F.explode_outer("evidence").alias("e")).join(evidence.select(F.col("id").alias("e"), "line"), "e", "left")
    return rows.groupBy("id").agg(F.coalesce(F.min("line"), F.lit(default)).alias("line"))


def longest_chains(paths: DataFrame) -> DataFrame:
    """(entry, length) of the longest path of each entry."""
    return paths.groupBy("entry").agg(F.max(F.size("path")).alias("length"))


def fresh(rows: DataFrame, stale_evidence: DataFrame, key: str = "id") -> DataFrame:
    """Rows none of whose ``evidence`` is stale (id)."""
    bad = rows.select(key, F.explode("evidence").alias("e")).join(stale_evidence.select(F.col("id").alias("e")), "e", "left_semi").select(key).distinct()
    return rows.join(bad, key, "left_anti")


def trusted_flows(flows: DataFrame, stale_evidence: DataFrame) -> DataFrame:
    """Flows (id, steps: order, operation, provenance, evidence) without a stale step, their untrusted steps left out; flows without steps go."""
    steps = flows.select("id", F.explode("steps").alias("s"))
    bad = steps.select("id", F.explode("s.evidence").alias("e")).join(stale_evidence.select(F.col("id").alias("e")), "e", "left_semi").select("id").distinct()
    kept = flows.join(bad, "id", "left_anti").withColumn("steps", F.filter("steps", lambda s: claim_allowed(s["provenance"])))
    return kept.filter(F.size("steps") > 0)


def pruned_claims(components: DataFrame, name: str = "claims") -> DataFrame:
    """Components with the claims (structs with a provenance) that are allowed."""
    return components.withColumn(name, F.filter(name, lambda c: claim_allowed(c["provenance"])))


def flow_groups(reached: DataFrame) -> DataFrame:
    """(seed, members) of what each seed reaches, groups of two or more; a group is one entry's bounded walk."""
    return reached.groupBy("seed").agg(F.sort_array(F.collect_set("node")).alias("members")).filter(F.size("members") >= 2)


def unit_dirs(units: DataFrame) -> DataFrame:
    """(name, dir) of deployment units (name, build_context, image): the context's folder, else for an image the name; the root says nothing."""
    context = F.regexp_replace(F.trim("build_context"), r"^(\./)+", "")
    rows = units.select("name", F.when(F.col("build_context").isNotNull(), F.when(~context.isin("", "."), context)).when(F.col("image").isNotNull(), F.col("name")).alias("dir"))
    return rows.filter("dir is not null")


def store_label(kind: Column, name: Column, store: Column) -> Column:
    """store.name for a data entity that has a store, else the name."""
    return F.when((kind == "data_entity") & store.isNotNull(), F.concat_ws(".", store, name)).otherwise(name)


def render_flows(steps: DataFrame) -> DataFrame:
    """(flow, text): numbered steps (flow, order, actor, operation, condition); a step of the actor before it follows an arrow.

    The steps of one flow are bounded by its walk.
    """
    rows = steps.groupBy("flow").agg(F.sort_array(F.collect_list(F.struct("order", "actor", "operation", "condition"))).alias("s"))

    def line(s: Column, i: Column) -> Column:
        same = (i > 0) & F.get(F.col("s"), i - 1)["actor"].eqNullSafe(s["actor"])
        head = F.when(same, F.concat(F.lit("  → "), s["operation"])).otherwise(F.concat(s["order"].cast("string"), F.lit(". "), s["actor"], F.lit(": "), s["operation"]))
        return F.concat(head, F.coalesce(F.concat(F.lit(" ("), s["condition"], F.lit(")")), F.lit("")))

    return rows.select("flow", F.array_join(F.transform("s", line), "\n").alias("text"))
