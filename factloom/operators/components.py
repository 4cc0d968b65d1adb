"""Components from boundaries: candidates by authority, regions of their folders, clusters and services above them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.trust import boundary_rank
from factloom.operators import graph


def build_candidates(boundaries: DataFrame) -> DataFrame:
    """(name, dirs, boundary): the boundaries (name, dir, boundary) of one name as one, of the highest authority, with all folders.

    A declared name is a folder of its own too; the root folder says nothing.
    """
    clean = F.regexp_replace(F.trim("dir"), r"^(\./)+|/+$", "")
    rows = boundaries.withColumn("dir", clean).filter("name <> '' and dir not in ('', '.')")
    implied = boundaries.filter("boundary = 'declared' and name <> ''").select("name", F.col("name").alias("dir"), "boundary")
    every = rows.select("name", "dir", "boundary").unionByName(implied)
    return every.groupBy("name").agg(F.sort_array(F.collect_set("dir")).alias("dirs"), F.max_by("boundary", F.struct(boundary_rank(F.col("boundary")), "boundary")).alias("boundary"))


def cli_dirs(entities: DataFrame) -> DataFrame:
    """Folders of files and symbols that commands belong to (entities of kind ``command`` with a path)."""
    return entities.filter("kind = 'command' and path is not null").select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir")).distinct()


def build_regions(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """(region, component, files): the files (path) of each component by the folder below its own, files at its top alone in the component's region.

    A file belongs to the component of the longest folder that holds it, others to "root".
    """
    dirs = candidates.select("name", F.explode("dirs").alias("dir"))
    parts = F.split("path", "/")
    prefixes = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    held = files.select("path", F.explode(prefixes).alias("dir")).join(dirs, "dir").groupBy("path").agg(F.max_by(F.struct("name", "dir"), F.struct(F.char_length("dir"), "name")).alias("c"))
    rows = files.select("path").join(held, "path", "left").select("path", F.coalesce("c.name", F.lit("root")).alias("component"), F.coalesce("c.dir", F.lit("")).alias("dir"))
    rest = F.when(F.col("dir") == "", F.col("path")).otherwise(F.substring("path", F.char_length("dir") + 2, F.char_length("path")))
    below = F.regexp_extract(rest, r"^([^/]+)/", 1)
    region = F.when(below == "", F.col("component")).when(F.col("dir") == "", below).otherwise(F.concat_ws("/", "dir", below))
    return rows.groupBy(region.alias("region"), "component").agg(F.count("*").alias("files"))


def build_clusters(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """(cluster, dirs, boundary): clusters (cluster, name) with the folders of all members and the boundary of the highest authority."""
    rows = members.join(candidates, "name")
    dirs = rows.select("cluster", F.explode("dirs").alias("dir")).groupBy("cluster").agg(F.sort_array(F.collect_set("dir")).alias("dirs"))
    best = rows.groupBy("cluster").agg(F.max_by("boundary", F.struct(boundary_rank(F.col("boundary")), "boundary")).alias("boundary"))
    return dirs.join(best, "cluster")


def compile_services(weights: DataFrame, least: int = graph.SERVICE) -> DataFrame:
    """(service, members): components that pairs (a, b, weight) of ``least`` or more connect; a service has two members or more."""
    roots = graph.connected(weights.filter(F.col("weight") >= least).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return roots.groupBy(F.col("root").alias("service")).agg(F.sort_array(F.collect_set("id")).alias("members")).filter(F.size("members") >= 2)


def without_prefix(rows: DataFrame, prefix: str, column: str = "id") -> DataFrame:
    """Rows whose id doesn't begin so: what a derived layer wrote before is cleared by its prefix."""
    return rows.filter(~F.col(column).startswith(prefix))


def architecture(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(order, actor, depends_on): one step for each component (id, name), in order of its name, with what it depends on."""
    to = edges.filter("predicate = 'depends_on'").groupBy(F.col("subject").alias("id")).agg(F.sort_array(F.collect_set("object")).alias("depends_on"))
    return components.select("id", "name").join(to, "id", "left").select("name", F.col("id").alias("actor"), F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))


def state_claims(edges: DataFrame, component: DataFrame) -> DataFrame:
    """(component, target, provenance) of what the symbols of each component (symbol, component) write, each once."""
    return edges.filter("predicate in ('writes', 'owns')").join(component, F.col("subject") == F.col("symbol")).select("component", F.col("object").alias("target"), "provenance").distinct()


def pipeline_phases(name: Column) -> Column:
    """The phase of a processing tool that a name tells, else null."""
    n = F.lower(name)
    phases = {"parse": "lex|token|pars", "analyse": "analy|resolv|check|bind", "transform": "transform|lower|optim|rewrit", "emit": "emit|codegen|generat|render|print"}
    out = F.lit(None).cast("string")
    for phase, words in reversed(phases.items()):
        out = F.when(n.rlike(words), phase).otherwise(out)
    return out
