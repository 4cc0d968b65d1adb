"""Benchmarks of what a model knows: misses by cause, transfer between corpora, agents' events and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scoring import f2_score, safe_ratio, share_or_one, token_density

LAYERS = "architecture entrypoints behavior state_authority contracts landmarks tests".split()
# The stages of a task's ranking, and what each variant leaves out.
STAGES = "lexical global_ppr task_ppr mmr quotas optimizer".split()
WITHOUT = {"lexical": STAGES, "global-ppr": ["task_ppr"], "task-ppr": [], "ppr-mmr": ["mmr"], "ppr-quotas": ["quotas"], "ppr-optimizer": ["optimizer"]}


def stages(variant: str) -> dict[str, bool]:
    return {s: s not in WITHOUT[variant] for s in STAGES}


def classify_gap(stored: Column, enabled: Column, isolated: Column, compiled: Column, in_flow: Column, in_text: Column) -> Column:
    """Where a missed fact was lost: before the store, in resolution, in the compilers, in the projection, or by its spelling alone.

    ``enabled``: whether the extractor of the named file's language is; null if it names no file.
    """
    lost = F.when(~enabled, "PARSER").otherwise("EXTRACTOR")
    return F.when(~stored, lost).when(isolated, "RESOLUTION").when(compiled, F.when(in_text, "ALIAS").otherwise("PROJECTION")).when(in_flow, "COMPILER").when(in_text, "ALIAS").otherwise("COMPILER")


def layer_recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(repo, layer, wanted, found, hits) over distinct items (repo, layer, item)."""
    t, f = truth.select("repo", "layer", "item").distinct(), found.select("repo", "layer", "item").distinct()
    both = t.withColumn("t", F.lit(1)).join(f.withColumn("f", F.lit(1)), ["repo", "layer", "item"], "full_outer")
    return both.groupBy("repo", "layer").agg(F.count("t").alias("wanted"), F.count("f").alias("found"), F.count(F.when(F.col("t").isNotNull() & F.col("f").isNotNull(), 1)).alias("hits"))


def recall_report(counts: DataFrame, tokens: DataFrame) -> DataFrame:
    """(repo, recall, precision, f2, density) of each repository, and the means of all in the row of null repo; tokens: repo, tokens."""
    own = counts.groupBy("repo").agg(F.sum("hits").alias("hits"), F.sum("found").alias("found"), F.sum("wanted").alias("wanted")).join(tokens, "repo", "left")
    p, r = share_or_one(F.col("hits"), F.col("found")), share_or_one(F.col("hits"), F.col("wanted"))
    own = own.select("repo", r.alias("recall"), p.alias("precision"), f2_score(p, r).alias("f2"), token_density(F.col("hits"), F.col("tokens")).alias("density"))
    return own.unionByName(own.agg(*[F.avg(c).alias(c) for c in own.columns[1:]]).withColumn("repo", F.lit(None).cast(own.schema["repo"].dataType)))


def transfer_ratios(before: DataFrame, after: DataFrame) -> DataFrame:
    """(layer, ratio) of the means (layer, mean) of two corpora, 0 where the first has none."""
    return before.select("layer", F.col("mean").alias("a")).join(after.select("layer", F.col("mean").alias("b")), "layer").select("layer", safe_ratio(F.col("b"), F.col("a")).alias("ratio"))


def haystack(entities: DataFrame) -> DataFrame:
    """(id, text): what names an entity, lower-cased."""
    return entities.select("id", F.lower(F.concat_ws(" ", "id", "name", "attributes")).alias("text"))


def agent_events(lines: DataFrame, body: str) -> DataFrame:
    """Tool calls of agents' JSON lines with ``type`` and ``tool`` or ``command``; starts, results, messages and lines that are no JSON objects are left out.

    Adds kind, tool, command, and paths (array) from the arguments.
    """
    b = F.trim(F.col(body))
    get = lambda path: F.get_json_object("b", path)
    rows = lines.withColumn("b", F.when(b.startswith("{"), b)).withColumn("outer", get("$.type")).filter("b is not null and (outer is null or outer <> 'item.started')")
    rows = rows.withColumn("b", F.when(F.col("outer") == "item.completed", get("$.item")).otherwise(F.col("b"))).withColumn("kind", get("$.type"))
    rows = rows.filter(F.col("kind").isin("command_execution", "mcp_tool_call", "tool_use"))
    tool = F.when(F.col("kind") == "mcp_tool_call", F.coalesce(get("$.tool"), F.col("kind"))).when(F.col("kind") == "tool_use", F.coalesce(get("$.name"), F.col("kind"))).otherwise(tool_of(F.coalesce(get("$.command"), F.lit(""))))
    arguments = F.coalesce(get("$.arguments.path"), get("$.arguments.file_path"), get("$.input.path"), get("$.input.file_path"))
    paths = F.when(F.col("kind") == "command_execution", command_paths(F.coalesce(get("$.command"), F.lit("")))).otherwise(F.array_compact(F.array(arguments)))
    return rows.select(*lines.columns, "kind", tool.alias("tool"), paths.alias("paths"))


def tool_of(command: Column) -> Column:
    """The first word of a command, or of what a shell is told to run."""
    strip = lambda t: F.regexp_replace(t, "^['\"]+|['\"]+$", "")
    words = F.filter(F.transform(F.split(F.trim(command), r"\s+"), strip), lambda w: w != "")
    first = F.coalesce(F.get(words, F.lit(0)), F.lit(""))
    inner = F.get(F.filter(F.slice(words, 2, 1 << 20), lambda w: ~w.startswith("-")), F.lit(0))
    return F.when(first.rlike("^(/.*sh|zsh|bash|sh)$"), F.coalesce(inner, F.lit("shell"))).otherwise(first)


def command_paths(command: Column) -> Column:
    """Words of a command that name files: no flags, globs, variables or redirections; with a folder or an extension."""
    strip = lambda t: F.regexp_replace(t, "^['\"]+|['\"]+$", "")
    words = F.transform(F.split(F.trim(command), r"\s+"), strip)
    fits = lambda w: (w != "") & ~w.isin(".", "..") & ~w.startswith("-") & ~w.rlike("[$|&;<>*?`=]") & w.rlike(r"^[^/].*(/|\.[A-Za-z]+$)|^[^/]+\.[A-Za-z]+$")
    return F.transform(F.filter(words, fits), lambda w: F.regexp_replace(w, r"^(\./)+", ""))


def variant_means(runs: DataFrame) -> DataFrame:
    """(variant, tasks, mean_duration, mean_recall, success) of runs (variant, task, duration, wanted, found, hits): hits over wanted, and the share of tasks all of whose items were found."""
    recall = share_or_one(F.col("hits"), F.col("wanted"))
    return runs.groupBy("variant").agg(F.count("*").alias("tasks"), F.avg("duration").alias("mean_duration"), F.avg(recall).alias("mean_recall"), F.avg((F.col("hits") >= F.col("wanted")).cast("double")).alias("success"))


def units_within(units: DataFrame, group: list[str], budget: int) -> DataFrame:
    """(group, ids, spent): whole units (id, position, cost) in order while they fit; the first is always kept, and the first that doesn't fit ends the walk."""
    rows = units.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("position", F.col("id").cast("string").alias("id"), F.col("cost").cast("long").alias("cost")))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<string>").alias("ids"), F.lit(False).alias("ended"))

    def step(acc: Column, x: Column) -> Column:
        fits = ~acc["ended"] & ((F.size(acc["ids"]) == 0) | (acc["spent"] + x["cost"] <= budget))
        return F.when(fits, F.struct((acc["spent"] + x["cost"]).alias("spent"), F.concat(acc["ids"], F.array(x["id"])).alias("ids"), acc["ended"].alias("ended"))).otherwise(F.struct(acc["spent"].alias("spent"), acc["ids"].alias("ids"), F.lit(True).alias("ended")))

    return rows.withColumn("r", F.aggregate("all", start, step)).select(*group, F.col("r.ids").alias("ids"), F.col("r.spent").alias("spent"))
