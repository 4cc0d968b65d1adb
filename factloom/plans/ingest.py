"""From files to facts: entities, edges and evidence of a repository as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import content_id
from factloom.functions.trust import default_confidence
from factloom.operators import resolve
from factloom.sources.configs import config_facts
from factloom.sources.extract import source_facts

# Fixed value: confidence of a store access.
STORE_CONFIDENCE = 0.8
_STORE = {"read": "reads", "write": "writes", "publish": "publishes", "subscribe": "subscribes"}


_NAMED = {"registration": "registers", "callback": "handles_callback", "validation": "validates", "composition": "composes"}


def _named(facts: DataFrame) -> DataFrame:
    """Facts that name something else, with what of the same file they name: ``target``, null if it isn't there.

    Registrations and callbacks name symbols, validations and compositions schemas, else symbols; ``part`` is the
    schema that is composed.
    """
    whole = F.concat_ws(".", F.nullif("owner", F.lit("")), "name")
    symbols = facts.filter("family = 'symbol'").select("path", whole.alias("name"), _symbol(F.col("path"), F.col("owner"), F.col("name")).alias("symbol")).distinct()
    schemas = facts.filter("family = 'schema'").select("path", "name", F.concat(F.lit("schema:"), "path", F.lit("#"), "name").alias("schema")).distinct()
    rows = facts.filter(F.col("family").isin(*_NAMED)).join(symbols, ["path", "name"], "left").join(schemas, ["path", "name"], "left")
    rows = rows.join(schemas.withColumnsRenamed({"name": "owner", "schema": "part"}), ["path", "owner"], "left")
    about = F.col("family").isin("validation", "composition")
    return rows.withColumn("target", F.when(about, F.coalesce("schema", "symbol")).otherwise(F.col("symbol"))).withColumn("part", F.when(F.col("family") == "composition", F.col("part"))).drop("symbol", "schema")


def _file(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def _symbol(path: Column, owner: Column, name: Column) -> Column:
    return F.concat(F.lit("symbol:"), path, F.lit("#"), F.when(owner == "", name).otherwise(F.concat_ws(".", owner, name)))


def _holder(path: Column, owner: Column) -> Column:
    """The symbol that owns a fact, else its file."""
    return F.when(owner == "", _file(path)).otherwise(F.concat(F.lit("symbol:"), path, F.lit("#"), owner))


def _edges(rows: DataFrame, subject: Column, predicate: Column, obj: Column, provenance: Column, confidence: Column) -> DataFrame:
    evidence = F.array(F.concat_ws(":", "path", F.col("line").cast("string")))
    return rows.select(content_id(subject, predicate, obj, F.col("path")).alias("id"), subject.alias("subject"), predicate.alias("predicate"), obj.alias("object"), provenance.alias("provenance"), confidence.cast("double").alias("confidence"), evidence.alias("evidence"), "path")


def extract_all(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of source files and facts of configuration files (path, language, content)."""
    return source_facts(files), config_facts(files.filter(F.col("language").isin("json", "yaml", "toml", "env", "dockerfile", "terraform", "other")))


def build(files: DataFrame, facts: DataFrame, config: DataFrame) -> dict[str, DataFrame]:
    """entities and edges of a repository: one projection for each family of facts, then unions and keyed merges."""
    detail = F.from_json("detail", "exported boolean, signature string, docstring string, module string, imported string, receiver string, order int, block string, tokens array<string>, via string, mutable boolean")
    f = facts.withColumn("d", detail)
    fam = lambda *names: f.filter(F.col("family").isin(*names))
    none = lambda t="string": F.lit(None).cast(t)

    def ents(rows: DataFrame, id_: Column, kind: Column, name: Column, **more: Column) -> DataFrame:
        cols = {"path": F.col("path"), "line": none("int"), "end_line": none("int"), "exported": none("boolean"), "signature": none(), "docstring": none(), "attributes": none()} | more
        return rows.select(id_.alias("id"), kind.alias("kind"), name.alias("name"), *[c.alias(n) for n, c in cols.items()])

    symbols = fam("symbol")
    entities = ents(files, _file(F.col("path")), F.lit("file"), F.col("path"), attributes=F.to_json(F.struct("language", "kind")))
    entities = entities.unionByName(ents(symbols, _symbol(F.col("path"), F.col("owner"), F.col("name")), F.lit("symbol"), F.col("name"), line=F.col("line"), end_line=F.col("end_line"), exported=F.col("d.exported"), signature=F.col("d.signature"), docstring=F.col("d.docstring"), attributes=F.to_json(F.struct(F.col("kind").alias("symbol_kind")))))
    for family, kind in (("route", "route"), ("queue", "job"), ("cli", "command"), ("schema", "schema"), ("test", "test"), ("config", "configuration"), ("reactive", "reactive")):
        shared = family == "config"
        key = F.concat(F.lit(f"{kind}:"), F.col("name")) if shared else F.concat(F.lit(f"{kind}:"), F.col("path"), F.lit("#"), F.col("name"))
        entities = entities.unionByName(ents(fam(family), key, F.lit(kind), F.col("name"), path=none() if shared else F.col("path"), line=none("int") if shared else F.col("line"), attributes=F.to_json(F.struct("kind"))))
    entities = entities.unionByName(ents(fam("store"), F.concat(F.lit("store:"), F.col("name")), F.when(F.col("kind").isin("publish", "subscribe"), "topic").otherwise("data_store"), F.col("name"), path=none()))
    field = F.concat(F.lit("field:"), F.col("path"), F.lit("#"), F.concat_ws(".", F.nullif("owner", F.lit("")), "name"))
    entities = entities.unionByName(ents(fam("state"), field, F.lit("field"), F.concat_ws(".", F.nullif("owner", F.lit("")), "name"), line=F.col("line"), attributes=F.to_json(F.struct(F.col("d.mutable").alias("mutable"), "owner"))))
    entities = entities.unionByName(ents(fam("annotation"), F.concat(F.lit("annotation:"), "name"), F.lit("annotation"), F.col("name"), path=none()))
    named = _named(facts)
    contract = named.filter("family = 'registration' and target is null")
    entities = entities.unionByName(ents(contract, F.concat(F.lit("contract:"), "name"), F.lit("contract"), F.col("name"), path=none(), attributes=F.to_json(F.struct("kind"))))
    entities = entities.unionByName(ents(config.filter("predicate = '' and kind <> 'unreadable'"), F.concat(F.col("kind"), F.lit(":"), F.col("name")), F.col("kind"), F.col("name"), attributes=F.col("attributes")))
    entities = entities.groupBy("id").agg(*[F.min_by(c, F.struct(F.coalesce("path", F.lit("")), F.coalesce("line", F.lit(0)))).alias(c) for c in ("kind", "name", "path", "line", "end_line", "exported", "signature", "docstring", "attributes")])

    lit = F.lit
    holder = _holder(F.col("path"), F.col("owner"))
    extracted, one = lit("EXTRACTED"), lit(1.0)
    edges = _edges(symbols, _file(F.col("path")), lit("contains"), _symbol(F.col("path"), F.col("owner"), F.col("name")), extracted, one)
    edges = edges.unionByName(_edges(symbols.filter("d.exported"), _file(F.col("path")), lit("exports"), _symbol(F.col("path"), F.col("owner"), F.col("name")), extracted, one))
    for family, kind, predicate in (("route", "route", "handles"), ("queue", "job", "handles"), ("cli", "command", "handles"), ("schema", "schema", "defines"), ("test", "test", "defines")):
        edges = edges.unionByName(_edges(fam(family), holder, lit(predicate), F.concat(lit(f"{kind}:"), F.col("path"), lit("#"), F.col("name")), extracted, one))
    edges = edges.unionByName(_edges(fam("config"), holder, lit("configured_by"), F.concat(lit("configuration:"), F.col("name")), extracted, one))
    edges = edges.unionByName(_edges(fam("state"), holder, lit("contains"), field, extracted, one))
    edges = edges.unionByName(_edges(fam("annotation"), F.concat(lit("annotation:"), "name"), lit("annotates"), holder, extracted, one))
    reached = F.coalesce("target", F.concat(F.when(F.col("family") == "registration", "contract:").otherwise("unknown:"), "name"))
    verb = F.create_map(*[lit(x) for p in _NAMED.items() for x in p])[F.col("family")]
    edges = edges.unionByName(_edges(named, F.coalesce("part", holder), verb, reached, extracted, one))
    predicate = F.create_map(*[lit(x) for p in _STORE.items() for x in p])[F.col("kind")]
    edges = edges.unionByName(_edges(fam("store"), holder, predicate, F.concat(lit("store:"), F.col("name")), extracted, lit(STORE_CONFIDENCE)))
    linked = config.filter("predicate <> ''").withColumn("line", lit(1))
    edges = edges.unionByName(_edges(linked, F.concat("kind", lit(":"), "name"), F.col("predicate"), F.concat("kind", lit(":"), "object"), lit("DECLARED"), one))

    imports = fam("import").select(F.col("path").alias("file"), F.col("name").alias("local"), F.coalesce("d.module", "name").alias("module"), F.col("d.imported").alias("original"), "line", "path")
    resolved = resolve.resolve_imports(imports.select("file", "module").distinct(), files)
    found = imports.join(resolved, ["file", "module"])
    prov = F.when(F.col("internal"), "RESOLVED").otherwise("EXTRACTED")
    target = F.when(F.col("internal"), _file(F.col("target"))).otherwise(F.col("target"))
    edges = edges.unionByName(_edges(found, _file(F.col("path")), lit("imports"), target, prov, default_confidence(prov)))

    own = symbols.select(F.col("path").alias("file"), F.when(F.col("owner") != "", F.col("owner")).alias("owner"), "name", _symbol(F.col("path"), F.col("owner"), F.col("name")).alias("symbol"))
    calls = fam("call").select(F.xxhash64("path", "line", "owner", "name", "detail").alias("call"), F.col("path").alias("file"), F.regexp_extract("owner", r"^([^.]*)", 1).alias("owner"), F.col("d.receiver").alias("receiver"), "name", "path", "line", F.col("owner").alias("whole")).dropDuplicates(["call"])
    known = found.select("file", "local", F.when(F.col("internal"), F.col("target")).alias("target_file"), F.coalesce("original", F.col("local")).alias("original"))
    answers = resolve.resolve_calls(calls.select("call", "file", "owner", "receiver", "name"), own, known)
    called = calls.select("call", "path", "line", "whole").join(answers, "call")
    prov = F.when(F.col("rule").isin("external", "unknown"), "EXTRACTED").otherwise("RESOLVED")
    edges = edges.unionByName(_edges(called, _holder(F.col("path"), F.col("whole")), lit("calls"), F.col("target"), prov, F.col("confidence")))

    tests = fam("test").select(F.concat(lit("test:"), "path", lit("#"), "name").alias("test"), "path", F.coalesce("d.tokens", F.split(F.lower("name"), "[^a-z0-9]+")).alias("tokens"), "line")
    reach = tests.join(found.filter("internal").select("path", F.col("target").alias("file")).distinct(), "path")
    hits = resolve.link_tests(reach.select("test", "file", "tokens"), own.select("file", "name", "symbol")).withColumn("path", F.regexp_extract("test", r"^test:(.*)#", 1)).withColumn("line", lit(0))
    edges = edges.unionByName(_edges(hits, F.col("test"), lit("tests"), F.col("symbol"), lit("INFERRED"), F.col("confidence")))
    edges = edges.groupBy("id").agg(*[F.first(c).alias(c) for c in ("subject", "predicate", "object", "provenance")], F.max("confidence").alias("confidence"), F.array_sort(F.collect_set(F.col("evidence")[0])).alias("evidence"), F.first("path").alias("path"))
    return {"entities": entities, "edges": edges}


def evidence_of(edges: DataFrame) -> DataFrame:
    """(id, path) of what the edges rest on."""
    return edges.select(F.explode("evidence").alias("id"), "path").distinct()


