"""Rules that rate, name or classify entities, edges and goals, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import ascii_lower
from factloom.functions.trust import lookup

# Confidence of entry points by kind, and of contracts by subclass.
ENTRYPOINT = {
    "route": 1.0, "http": 1.0, "cli": 0.95, "cli-subcommand": 0.95, "public_api": 0.9, "public-api": 0.9, "event": 0.85, "queue": 0.85,
    "schedule": 0.8, "process": 0.8, "plugin": 0.75, "framework_callback": 0.75, "lifecycle": 0.7, "entrypoint": 0.4,
}
CONTRACT = {
    "http": 0.95, "cli": 0.90, "event": 0.85, "configuration": 0.80, "public_api": 0.75, "rpc": 0.75, "message": 0.70, "plugin": 0.70,
    "extension": 0.70, "serialization": 0.65, "call_contract": 0.60, "schema": 0.35,
}
# What each kind of evidence adds to a component's confidence.
COMPONENT = {
    "purpose": 0.15, "implementation": 0.10, "symbols": 0.10, "consumes": 0.10, "produces": 0.10, "upstream": 0.10, "downstream": 0.10,
    "owns": 0.10, "failure_behavior": 0.05,
}
# Kind of a reference by its edge's predicate.
REFERENCE = {
    "calls": "call", "invokes": "call", "handles_callback": "call", "reads": "read", "writes": "write", "implements": "implement", "implemented_by": "implement",
    "inherits": "extend", "registers": "register", "publishes": "register", "subscribes": "register", "imports": "import", "exports": "export",
    "decorates": "decorate", "annotates": "decorate",
}
# Each structural edge of the rank graph and the one that leads back.
REVERSE = {
    "contains": "member_of", "member_of": "contains", "participates_in": "flow_reaches_participant", "flow_reaches_participant": "participates_in",
    "handles": "handled_by", "handled_by": "handles", "defines": "defined_by", "defined_by": "defines",
}
# What the regions of an archetype have in common.
PRIOR = {"cli": "cli_commands", "web_framework": "framework_registrations", "service_application": "service_entrypoints", "compiler_language_tool": "compiler_phases"}
PRIOR_WEIGHT = 2


def entrypoint_confidence(kind: Column, symbol: Column) -> Column:
    return F.least(lookup(ENTRYPOINT, kind, 0.3) + F.when(F.coalesce(symbol, F.lit("")) == "", 0.0).otherwise(0.05), F.lit(1.0))


def contract_confidence(subclass: Column, id_: Column, producer: Column, consumers: Column, evidence: Column) -> Column:
    """By subclass, more with a producer of its own, with consumers and with evidence (arrays)."""
    produced = (F.coalesce(producer, F.lit("")) != "") & ~producer.eqNullSafe(id_)
    bonus = F.when(produced, 0.10).otherwise(0.0) + F.when(F.size(consumers) > 0, 0.05).otherwise(0.0) + F.when(F.size(evidence) > 0, 0.05).otherwise(0.0)
    return F.least(lookup(CONTRACT, subclass) + bonus, F.lit(1.0))


def component_confidence(has: dict[str, Column], layer: Column) -> Column:
    """A floor and what each kind of evidence adds (``has``: name to whether there is any); a layer of its own adds too."""
    score = F.lit(0.2)
    for name, more in COMPONENT.items():
        score = score + F.when(has[name], more).otherwise(0.0)
    return F.least(score + F.when(layer != "component", 0.05).otherwise(0.0), F.lit(1.0))


def reference_kind(predicate: Column, target_kind: Column) -> Column:
    """Null for edges that are no references."""
    return F.when((predicate == "owns") & target_kind.isin("state", "reactive"), "write").otherwise(lookup(REFERENCE, predicate))


def reverse_transition(kind: Column) -> Column:
    return lookup(REVERSE, kind)


def cluster_prior(archetype: Column) -> Column:
    return lookup(PRIOR, archetype)


def generalization_efficiency(dev: Column, validation: Column) -> Column:
    """Validation's gain for each gain in development; without one, 1 if validation gained, else 0."""
    return F.when(dev == 0, F.when(validation > 0, 1.0).otherwise(0.0)).otherwise(validation / dev)


def is_cache_store(name: Column, technology: Column) -> Column:
    n = ascii_lower(name)
    return F.coalesce(ascii_lower(technology).isin("redis", "memcached", "valkey"), F.lit(False)) | n.contains("cache") | n.contains("redis") | n.contains("memcache")


def is_skip_path(path: Column) -> Column:
    """State files and lock files, which say nothing about what changes together."""
    name = ascii_lower(F.regexp_extract(path, r"([^/]*)$", 1))
    lock = name.isin("go.sum", "npm-shrinkwrap.json") | name.endswith(".lock") | name.contains("-lock.") | name.contains("_lock.")
    return path.startswith(".scc/") | (path == ".scc") | lock


def compression_policy(goal: Column) -> Column:
    """Why, what to keep and what to compress for a goal, as JSON."""
    g = ascii_lower(goal)
    about = lambda *words: reduce(lambda x, w: x | g.contains(w), words, F.lit(False))
    tests = '{"preserve":["failures","test output","stack traces"],"compress":["passing output","setup logs"],"rationale":"task touches tests"}'
    speed = '{"preserve":["timings","warnings","errors"],"compress":["logs"],"disable_log_compression":true,"rationale":"performance investigation"}'
    plain = '{"preserve":["errors","failures","warnings"],"compress":["passing output","repetitive logs"],"rationale":"standard"}'
    return F.when(about("test", "spec", "suite"), tests).when(about("perf", "latency", "slow", "benchmark"), speed).otherwise(plain)


def canonical_signature(signature: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(signature, r"\s+", " ")))


def common_prefix_len(a: Column, b: Column) -> Column:
    """Characters that both begin with."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.least(F.char_length(a), F.char_length(b))).cast("long")


def resolve_module_ref(from_file: Column, module: Column) -> Column:
    """The path that a module's name means: dots as folders, or relative to the file's folder."""
    from factloom.functions.text import normalize_path

    folder = F.regexp_extract(from_file, r"^(.*)/[^/]*$", 1)
    return F.when(module.startswith("."), normalize_path(F.concat_ws("/", folder, module))).otherwise(F.replace(module, F.lit("."), F.lit("/")))


def surface_paths(text: Column) -> Column:
    """Paths of the groups of a rendered surface, each once: a line between blank lines below a component's line, with a '/' or '.', and not in capitals alone."""
    lines = F.split(text, r"\r?\n")
    blank = lambda x: F.trim(x) == ""

    def path(line: Column, i: Column) -> Column:
        before, above, after = F.get(lines, i - 1), F.get(lines, i - 2), F.get(lines, i + 1)
        fits = (i >= 2) & ~blank(line) & ~line.startswith(" ") & blank(before) & ~blank(above) & F.coalesce(blank(after), F.lit(False))
        return F.when(fits & line.rlike("[/.]") & line.rlike(r"\p{Ll}"), F.trim(F.element_at(F.split(line, r"\["), 1)))

    return F.array_distinct(F.array_compact(F.transform(lines, path)))
