"""Scores, confidences and verdicts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the importance blend.
BLEND = {"task_ppr": 0.30, "global_ppr": 0.20, "lexical": 0.15, "semantic": 0.10, "confidence": 0.10, "criticality": 0.10, "change_risk": 0.05, "novelty": 0.05}
GLOBAL_WITHOUT_TASK = 0.50
# Fixed values of edge weights by predicate; resolved calls weigh more.
PREDICATE_WEIGHT = {
    "calls": 0.9, "invokes": 1.5, "handles_callback": 1.5, "exports": 1.4, "owns": 1.4, "reads": 1.3, "writes": 1.3, "implements": 1.25,
    "implemented_by": 1.25, "inherits": 1.2, "registers": 1.2, "publishes": 1.2, "subscribes": 1.2, "imports": 0.6, "contains": 0.4,
}
CALLS_RESOLVED = 1.2
RARITY = (0.25, 1.5)
SPECIFICITY = (0.25, 1.25)
UBIQUITY = 20
PROJECTION_FACTOR, PROJECTION_CAP = 0.4, 0.5


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f2_score(precision: Column, recall: Column) -> Column:
    return safe_ratio(5 * precision * recall, 4 * precision + recall)


def share_or_one(hits: Column, n: Column) -> Column:
    """Hits over items; without items 1."""
    return F.when(n == 0, F.lit(1.0)).otherwise(safe_ratio(hits, n))


def token_density(matched: Column, tokens: Column) -> Column:
    return safe_ratio(1000 * matched, tokens)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 for another length, no numbers or a zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def rarity(total: Column, in_degree: Column) -> Column:
    return F.when(total == 0, F.lit(1.0)).otherwise(F.least(F.greatest(F.ln(total / (1 + in_degree)), F.lit(RARITY[0])), F.lit(RARITY[1])))


def predicate_weight(predicate: Column, provenance: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PREDICATE_WEIGHT.items() for x in pair])
    return F.when((predicate == "calls") & (provenance == "RESOLVED"), F.lit(CALLS_RESOLVED)).otherwise(F.coalesce(table[predicate], F.lit(1.0)))


def edge_weight(predicate: Column, provenance: Column, confidence: Column, total: Column, in_degree: Column) -> Column:
    from factloom.functions.trust import provenance_weight

    return predicate_weight(predicate, provenance) * provenance_weight(provenance) * F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)) * rarity(total, in_degree)


def final_importance(parts: dict[str, Column], has_task: bool = True) -> Column:
    """The weighted sum of the blend's parts; without a task its share goes to the global rank."""
    out = F.lit(0.0)
    for name, weight in BLEND.items():
        if not has_task:
            weight = 0.0 if name == "task_ppr" else GLOBAL_WITHOUT_TASK if name == "global_ppr" else weight
        out = out + weight * parts[name]
    return out


def architectural_specificity(base: Column, path: Column, name: Column, references: Column) -> Column:
    """The base halved for each of generic names, tests, generated code, vendored code and ubiquity, within the clamp."""
    factor = F.lit(1.0)
    for hit in (is_generic(name), path_has_test(path), is_generated(path), is_vendored(path), references > UBIQUITY):
        factor = factor * F.when(hit, 0.5).otherwise(1.0)
    return F.least(F.greatest(base * factor, F.lit(SPECIFICITY[0])), F.lit(SPECIFICITY[1]))


def is_generic(name: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(name), r"[^a-z0-9]+"), F.array(*[F.lit(x) for x in "utils logger errors common types helpers config".split()]))


def path_has_test(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|[/._-])(test|tests|spec|specs|__tests__)([/._-]|$)")


def is_generated(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)(generated|gen|dist|build)/|\.(generated|gen|min)\.|_pb2?\.")


def is_vendored(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)(vendor|vendored|third_party|node_modules|site-packages)/")


def file_importance(path: Column) -> Column:
    """1 for manifests, continuous integration and bootstrap files, else 0."""
    name = F.lower(F.regexp_extract(path, r"([^/]+)$", 1))
    return F.when(name.isin("package.json", "cargo.toml", "pyproject.toml", "go.mod", "pom.xml", "build.gradle", "dockerfile", "makefile", "main.py", "main.go", "main.rs", "index.ts") | path.startswith(".github/"), 1.0).otherwise(0.0)


def novelty(visible: Column, changed: Column, critical: Column) -> Column:
    return F.when(visible & ~changed & ~critical, 0.1).otherwise(1.0)


def holdout_verdict(gap: Column, margin: float = 0.05) -> Column:
    return F.when(gap >= 0, "NoOverfit").when(gap >= -margin, "Borderline").otherwise("Overfit")


def risk_class(components: Column, contracts: Column, invariants: Column) -> Column:
    return F.when((invariants > 0) | (contracts > 2), "HIGH").when((contracts > 0) | (components > 1), "MEDIUM").otherwise("LOW")


def adaptive_budget(entities: Column, candidates: Column, cap: int = 10_000) -> Column:
    """Share of a budget for the surface: by size, one point more for each 2000 candidates (five at most), half at most."""
    tier = F.when(entities < 500, 0.20).when(entities < 5000, 0.30).otherwise(0.40)
    return F.least(tier + F.least(F.floor(candidates / 2000), F.lit(5)) / 100, F.lit(0.50))


def hard_max(budget: Column) -> Column:
    return budget + F.greatest(F.ceil(budget * 0.2), F.lit(500))
