"""Readers of other tools' exports: code indexes, layered graphs, task lists, lessons, trace markers and property graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Which column names play which role in a property graph's tables.
ROLES = {
    "id": "id node_id symbol_id entity_id uid", "name": "name label title symbol", "kind": "kind type node_type category", "file": "file path file_path filename",
    "subject": "subject source src from source_id from_id", "object": "object target dst to target_id to_id", "relkind": "predicate relation rel rel_type edge_type relationship",
}
MOST_ROWS = 100_000

SCIP = (
    "metadata struct<tool:struct<version:string>>, documents array<struct<relative_path:string,language:string,"
    "symbols:array<struct<symbol:string,kind:string,display_name:string>>,occurrences:array<struct<symbol:string,symbol_roles:int,range:array<int>>>>>"
)


def scip(payloads: DataFrame, body: str) -> dict[str, DataFrame]:
    """symbols, occurrences and imports of SCIP/JSON; malformed payloads are counted in ``skipped``, not fatal."""
    parsed = payloads.select(F.from_json(body, SCIP).alias("p"), F.col(body).alias("raw"))
    docs = parsed.select(F.explode("p.documents").alias("d")).select("d.*")
    occ = docs.select(F.col("relative_path").alias("file"), F.explode("occurrences").alias("o")).select("file", "o.symbol", F.col("o.symbol_roles").alias("roles"), F.col("o.range").alias("range"))
    occ = occ.withColumn("definition", F.col("roles").bitwiseAND(1) == 1).withColumn("line", F.col("range")[0] + 1)
    short = F.regexp_extract("symbol", r"([^#/\s.]+?)[().#]*$", 1)
    defs = occ.filter("definition").groupBy("symbol").agg(F.min_by("file", F.struct("file", "line")).alias("file"), F.min("line").alias("line")).withColumn("name", short)
    uses = occ.filter("not definition").select(F.col("file").alias("from"), "symbol", "line").join(defs.select("symbol", F.col("file").alias("to")), "symbol", "left")
    imports = uses.filter("to is not null and to <> from").select("from", "to").distinct()
    calls = uses.select("from", "symbol", F.coalesce("to", F.lit("external")).alias("to"), F.when(F.col("to").isNull(), 0.80).otherwise(0.99).alias("confidence")).distinct()
    skipped = parsed.agg(F.sum(F.when(F.col("p").isNull() | F.col("p.documents").isNull(), 1).otherwise(0)).alias("skipped"))
    return {"symbols": defs, "imports": imports, "calls": calls, "skipped": skipped}


def layered(payloads: DataFrame, body: str) -> dict[str, DataFrame]:
    """entities and symbols of a layered graph: L1 architecture, L2 symbols."""
    kind = "struct<layers:struct<L1:struct<architecture:array<struct<id:string,kind:string,name:string>>>,L2:struct<symbols:array<struct<id:string,name:string,file:string,kind:string>>>>>"
    p = payloads.select(F.from_json(body, kind).alias("p"))
    return {"entities": p.select(F.explode("p.layers.L1.architecture").alias("x")).select("x.*"), "symbols": p.select(F.explode("p.layers.L2.symbols").alias("x")).select("x.*")}


def symbol_graph(payloads: DataFrame, body: str) -> dict[str, DataFrame]:
    """symbols, edges of one or several repository blocks; the first block of a repository counts, edges without both ends are counted."""
    block = "name:string,symbols:array<struct<id:string,name:string,file:string,kind:string>>,edges:array<struct<subject:string,predicate:string,object:string>>"
    p = payloads.select(F.from_json(body, f"struct<{block},repositories:array<struct<{block}>>>").alias("p"))
    own = F.struct("p.name", "p.symbols", "p.edges")
    blocks = p.select(F.posexplode(F.coalesce("p.repositories", F.array(own))).alias("pos", "b"))
    first = blocks.groupBy(F.coalesce("b.name", F.lit("")).alias("repo")).agg(F.min_by("b", "pos").alias("b"))
    symbols = first.select("repo", F.explode("b.symbols").alias("s")).select("repo", "s.*").dropDuplicates(["repo", "id"])
    by_id = symbols.select("repo", F.col("id").alias("k"), F.col("id").alias("v"))
    by_name = symbols.groupBy("repo", F.col("name").alias("k")).agg(F.min("id").alias("v"))
    edges = first.select("repo", F.explode("b.edges").alias("e")).select("repo", "e.*")
    for side in ("subject", "object"):  # by id, then by name
        edges = edges.join(by_id.withColumnsRenamed({"k": side, "v": f"{side}_id"}), ["repo", side], "left").join(by_name.withColumnsRenamed({"k": side, "v": f"{side}_nm"}), ["repo", side], "left")
        edges = edges.withColumn(f"{side}_ref", F.coalesce(f"{side}_id", f"{side}_nm")).drop(f"{side}_id", f"{side}_nm")
    ok = F.col("subject_ref").isNotNull() & F.col("object_ref").isNotNull()
    return {"symbols": symbols, "edges": edges.filter(ok).select("repo", F.col("subject_ref").alias("subject"), "predicate", F.col("object_ref").alias("object")).distinct(), "missing": edges.agg(F.sum(F.when(ok, 0).otherwise(1)).alias("missing"))}


def records(payloads: DataFrame, body: str, schema: str) -> DataFrame:
    """Records of JSON that is an array, an envelope {data: [...]}, an object, or lines of objects."""
    text = F.trim(F.col(body))
    array = F.when(text.startswith("["), F.from_json(text, f"array<struct<{schema}>>"))
    boxed = F.from_json(text, f"struct<data:array<struct<{schema}>>>")["data"]
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.from_json(x, f"struct<{schema}>")), lambda x: x.isNotNull())
    return payloads.select(F.explode(F.coalesce(array, boxed, lines)).alias("r")).select("r.*")


def tasks(payloads: DataFrame, body: str) -> DataFrame:
    """id, title, status, deps of task records; a record without id or title goes."""
    r = records(payloads, body, "id:string,title:string,name:string,status:string,deps:array<string>")
    return r.select("id", F.coalesce("title", "name").alias("title"), F.coalesce("status", F.lit("open")).alias("status"), F.coalesce("deps", F.array().cast("array<string>")).alias("deps")).filter("id is not null and title is not null").dropDuplicates(["id"])


def active_tasks(rows: DataFrame, limit: int) -> DataFrame:
    return rows.filter(F.lower("status").isin("in_progress", "in-progress", "active")).orderBy("id").limit(limit).select("title")


def lessons(payloads: DataFrame, body: str) -> DataFrame:
    """content, tags of lesson records."""
    r = records(payloads, body, "content:string,text:string,tags:array<string>")
    return r.select(F.coalesce("content", "text").alias("content"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags")).filter("content is not null")


_KV = r"""([A-Za-z_][A-Za-z0-9_-]*)=("(?:\\.|[^"\\])*"|\S+)"""


def key_values(text):
    """Map of key=value pairs; quoted values may hold spaces and escapes."""
    keys = F.regexp_extract_all(text, F.lit(_KV), F.lit(1))
    values = F.transform(F.regexp_extract_all(text, F.lit(_KV), F.lit(2)), lambda v: F.when(v.startswith('"'), F.regexp_replace(F.regexp_replace(v, r'^"|"$', ""), r"\\(.)", "$1")).otherwise(v))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    return F.map_from_entries(F.filter(F.transform(pairs, lambda p, i: F.when(F.array_position(keys, p["k"]) == i + 1, F.struct(p["k"].alias("k"), p["v"].alias("v")))), lambda p: p.isNotNull()))


def markers(files: DataFrame) -> dict[str, DataFrame]:
    """entities and links of ``trace:v1`` comment lines in files (path, content)."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "text")).filter(F.col("text").rlike(r"^\s*(//|#|--|/\*+|\*)\s*trace:v1\s"))
    m = lines.select("path", (F.col("line") + 1).alias("line"), key_values(F.regexp_extract("text", r"trace:v1\s+(.*)$", 1)).alias("kv"))
    kind = F.when(F.col("id").rlike("(?i)^req"), "requirement").when(F.col("id").rlike("(?i)^work"), "work").when(F.col("id").rlike("(?i)^test"), "test").when(F.col("id").rlike("(?i)^(dec|adr)"), "decision").otherwise("implementation")
    ents = m.filter("kv['id'] is not null").select(F.col("kv")["id"].alias("id"), "path", "line").withColumn("kind", kind).dropDuplicates(["id"])
    links = m.filter("kv['id'] is not null").select(F.col("kv")["id"].alias("subject"), F.explode("kv").alias("predicate", "object")).filter(F.col("predicate").isin("satisfies", "verifies", "work", "decides")).distinct()
    return {"entities": ents, "links": links}


def column_roles(columns: list[str]) -> dict[str, str]:
    """Role of each column that a property graph's table has, by its name; the first column of a role counts."""
    out: dict[str, str] = {}
    for c in columns:
        role = next((r for r, names in ROLES.items() if c.lower() in names.split()), None)
        if role and role not in out:
            out[role] = c
    return out


def property_graph(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """nodes and edges of tables whose roles their column names tell: edges have both ends, nodes a name. The first MOST_ROWS rows of a table count, as the format defines."""
    nodes = edges = None
    for name, df in sorted(tables.items()):
        roles, df = column_roles(df.columns), df.limit(MOST_ROWS)
        text = lambda role, default=None: F.col(roles[role]).cast("string") if role in roles else F.lit(default).cast("string")  # noqa: B023, E731
        if "subject" in roles and "object" in roles:
            own = df.select(text("subject").alias("subject"), F.coalesce(text("relkind"), F.lit(name)).alias("predicate"), text("object").alias("object"), F.lit("RESOLVED").alias("provenance"))
            edges = own if edges is None else edges.unionByName(own)
        elif "name" in roles:
            own = df.select(F.coalesce(text("id"), text("name")).alias("id"), text("name").alias("name"), F.coalesce(text("kind"), F.lit(name)).alias("kind"), text("file").alias("file"))
            nodes = own if nodes is None else nodes.unionByName(own)
    nodes = nodes if nodes is not None else spark.createDataFrame([], "id string, name string, kind string, file string")
    edges = edges if edges is not None else spark.createDataFrame([], "subject string, predicate string, object string, provenance string")
    return {"nodes": nodes, "edges": edges}


def markdown_truth(lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, section, item): bullets '- item — why' below '## section' headings."""
    from factloom.operators.derive import carry_forward

    heading = F.when(F.col(text).startswith("## "), F.lower(F.trim(F.substring(F.col(text), 4, 200))))
    rows = carry_forward(lines, [key], F.col(order), heading, "section")
    item = F.trim(F.regexp_extract(text, r"^- (.*?)( — .*)?$", 1))
    return rows.filter(F.col(text).startswith("- ") & F.col("section").isNotNull()).select(key, "section", item.alias("item")).distinct()
