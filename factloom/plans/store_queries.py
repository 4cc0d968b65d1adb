"""Registry, store and lookup queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.functions import trust
from factloom.operators import derive, graph, store
from factloom.plans import binding as B
from factloom.plans.registry import Tables, query

_RANK = "CASE provenance WHEN 'RESOLVED' THEN 4 WHEN 'OBSERVED' THEN 4 WHEN 'EXTRACTED' THEN 3 WHEN 'DECLARED' THEN 2 WHEN 'INFERRED' THEN 1 ELSE 0 END"
_DEFAULT = "CASE provenance WHEN 'EXTRACTED' THEN 1.0 WHEN 'RESOLVED' THEN 0.98 WHEN 'OBSERVED' THEN 1.0 WHEN 'DECLARED' THEN 1.0 WHEN 'INFERRED' THEN 0.7 ELSE 0.0 END"
_ALLOWS = "CASE WHEN provenance = 'STALE' THEN false WHEN provenance = 'INFERRED' THEN confidence >= 0.85 ELSE provenance IN ('EXTRACTED', 'RESOLVED', 'OBSERVED', 'DECLARED') END"


@query("SELECT lang AS language, CAST(count(*) AS BIGINT) AS files FROM documents GROUP BY 1")
def language_histogram(t: Tables) -> DataFrame:
    return B.files(t).groupBy("language").agg(F.count("*").alias("files"))


@query(f"WITH {B.FILES_SQL} SELECT path, digest, language, size FROM files")
def all_files(t: Tables) -> DataFrame:
    return B.files(t).select("path", "digest", "language", "size")


@query(f"WITH {B.FILES_SQL} SELECT path, digest, language, size FROM files WHERE path = 'src3/3'")
def file_lookup(t: Tables) -> DataFrame:
    return B.files(t).filter("path = 'src3/3'").select("path", "digest", "language", "size")


@query(f"WITH {B.FILES_SQL} SELECT path, digest FROM new_files UNION ALL SELECT path, digest FROM files WHERE path NOT IN (SELECT path FROM new_files)")
def registry_upsert(t: Tables) -> DataFrame:
    return store.upsert(B.files(t).select("path", "digest"), B.new_files(t).select("path", "digest"), ["path"])


@query("SELECT o_custkey, max_by(o_orderkey, o_orderkey) AS o_orderkey, max_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def latest_version(t: Tables) -> DataFrame:
    return store.latest(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.col("o_orderkey"))


@query(f"""WITH {B.FILES_SQL} SELECT coalesce(a.path, b.path) AS path,
CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.digest <> b.digest THEN 'changed' ELSE 'same' END AS change FROM files a FULL JOIN new_files b ON a.path = b.path""")
def registry_diff(t: Tables) -> DataFrame:
    return store.registry_diff(B.files(t), B.new_files(t), "path", "digest")


@query(f"WITH {B.FILES_SQL} SELECT a.path FROM files a LEFT JOIN new_files b ON a.path = b.path WHERE b.digest IS NULL OR a.digest <> b.digest")
def stale_paths(t: Tables) -> DataFrame:
    return store.stale(B.files(t), B.new_files(t), "path", "digest")


@query(f"WITH {B.FILES_SQL} SELECT path, language FROM files WHERE doc_id % 11 <> 0")
def delete_by_key(t: Tables) -> DataFrame:
    rows = B.files(t)
    return store.delete(rows, rows.filter("doc_id % 11 = 0"), ["path"]).select("path", "language")


def _facts(t: Tables) -> dict[str, DataFrame]:
    """Parts as concepts, orders' lines as occurrences in files named after suppliers."""
    line = t.lineitem.select(F.concat(F.lit("f"), F.col("l_suppkey") % 97).alias("path"), F.concat(F.lit("part:"), "l_partkey").alias("concept"), F.concat(F.lit("orders:"), "l_orderkey").alias("order")).distinct()
    occurs = line.select("concept", "path").distinct()
    owned = line.groupBy("order").agg(F.min("path").alias("path"))
    ents = owned.select(F.col("order").alias("id"), "path").unionByName(occurs.select(F.col("concept").alias("id"), F.lit(None).cast("string").alias("path")).distinct())
    edges = line.groupBy("order", "concept").agg(F.min("path").alias("p")).select(F.concat_ws(">", "order", "concept").alias("id"), F.col("order").alias("subject"), F.col("concept").alias("object"), F.array(F.concat_ws("#", "p", "order")).alias("evidence"))
    evidence = line.select(F.concat_ws("#", "path", "order").alias("id"), "path").distinct()
    return {"files": line.select("path").distinct(), "entities": ents, "edges": edges, "evidence": evidence, "occurs": occurs}


_FACTS_SQL = """line AS (SELECT DISTINCT 'f' || (l_suppkey % 97) AS path, 'part:' || l_partkey AS concept, 'orders:' || l_orderkey AS ord FROM lineitem),
occurs AS (SELECT DISTINCT concept, path FROM line), gone AS (SELECT DISTINCT path FROM line WHERE CAST(substr(path, 2) AS INT) % 5 = 0),
ents AS (SELECT ord AS id, min(path) AS path FROM line GROUP BY 1 UNION ALL SELECT DISTINCT concept, NULL FROM occurs),
sources AS (SELECT concept, list_sort(list(DISTINCT path)) AS sources FROM occurs WHERE path NOT IN (SELECT path FROM gone) GROUP BY 1),
kept AS (SELECT id, path, [path] AS sources FROM ents WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM gone) UNION ALL SELECT id, path, s.sources FROM ents JOIN sources s ON id = concept WHERE path IS NULL),
edge AS (SELECT ord || '>' || concept AS id, ord AS subject, concept AS object, min(path) || '#' || ord AS e, min(path) AS p FROM line GROUP BY ord, concept)"""


def _purged(t: Tables) -> dict[str, DataFrame]:
    f = _facts(t)
    gone = f["files"].filter("cast(substring(path, 2, 9) as int) % 5 = 0")
    return store.purge(f["files"], f["entities"], f["edges"], f["evidence"], f["occurs"], gone)


@query(f"WITH {_FACTS_SQL} SELECT id, path, array_to_string(sources, ',') AS sources FROM kept")
def purge_cascade_entities(t: Tables) -> DataFrame:
    return _purged(t)["entities"].select("id", "path", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {_FACTS_SQL} SELECT id FROM edge WHERE subject IN (SELECT id FROM kept) AND object IN (SELECT id FROM kept) AND p NOT IN (SELECT path FROM gone)")
def purge_cascade_edges(t: Tables) -> DataFrame:
    return _purged(t)["edges"].select("id")


@query(f"WITH {_FACTS_SQL} SELECT DISTINCT path || '#' || ord AS id FROM line WHERE path || '#' || ord NOT IN (SELECT e FROM edge)")
def sweep_orphan_evidence(t: Tables) -> DataFrame:
    f = _facts(t)
    return store.sweep(f["evidence"], [f["edges"]]).select("id")


@query(f"WITH {B.ENTITIES_SQL} SELECT id, name FROM entities WHERE kind = 'supplier'")
def entities_by_kind(t: Tables) -> DataFrame:
    return B.entities(t).filter("kind = 'supplier'").select("id", "name")


@query(f"WITH {B.EDGES_SQL} SELECT predicate, object, provenance, round(confidence, 6) AS confidence FROM edges WHERE subject = 'orders:7'")
def relationships_for(t: Tables) -> DataFrame:
    return B.edges(t).filter("subject = 'orders:7'").select("predicate", "object", "provenance", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {B.EDGES_SQL} SELECT subject, predicate FROM edges WHERE object = 'nation:3'")
def relationships_to(t: Tables) -> DataFrame:
    return B.edges(t).filter("object = 'nation:3'").select("subject", "predicate")


@query(f"WITH {B.EDGES_SQL} SELECT subject, predicate, object FROM edges WHERE (subject, predicate, object) IN (SELECT 'nation:' || n_nationkey, 'belongs_to', 'region:' || r_regionkey FROM nation, region) OR (predicate = 'imports' AND object = 'customer:1')")
def relationships_between(t: Tables) -> DataFrame:
    """The edges of asked pairs: each nation with each region, and what imports customer 1."""
    asked = t.nation.join(t.region).select(F.concat(F.lit("nation:"), "n_nationkey").alias("subject"), F.lit("belongs_to").alias("predicate"), F.concat(F.lit("region:"), "r_regionkey").alias("object"))  # 125 rows
    e = B.edges(t)
    return e.join(asked, ["subject", "predicate", "object"], "left_semi").union(e.filter("predicate = 'imports' and object = 'customer:1'")).select("subject", "predicate", "object")


@query(f"WITH {B.EDGES_SQL} SELECT predicate, provenance, {_ALLOWS} AS allowed, CAST(count(*) AS BIGINT) AS n FROM edges GROUP BY 1, 2, 3")
def trust_filter(t: Tables) -> DataFrame:
    return B.edges(t).groupBy("predicate", "provenance", trust.allows(F.col("provenance"), F.col("confidence")).alias("allowed")).agg(F.count("*").alias("n"))


@query(f"WITH {B.EDGES_SQL} SELECT subject, object FROM edges WHERE predicate = 'calls' AND {_ALLOWS} AND subject NOT IN (SELECT 'orders:' || o_orderkey FROM orders WHERE o_totalprice < 50000)")
def trusted_relationships(t: Tables) -> DataFrame:
    edges = B.edges(t).filter("predicate = 'calls'").withColumn("id", F.concat_ws(">", "subject", "object")).withColumn("evidence", F.array("subject"))
    stale = t.orders.filter("o_totalprice < 50000").select(F.concat(F.lit("orders:"), "o_orderkey").alias("id"))
    return graph.trusted(edges, stale).select("subject", "object")


@query("SELECT l_returnflag AS flag, CASE l_returnflag WHEN 'R' THEN 'RESOLVED' WHEN 'N' THEN 'INFERRED' END AS provenance, l_returnflag IN ('R', 'A') AS allowed, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def claim_filter(t: Tables) -> DataFrame:
    prov = F.when(F.col("l_returnflag") == "R", "RESOLVED").when(F.col("l_returnflag") == "N", "INFERRED")
    rows = t.lineitem.select(F.col("l_returnflag").alias("flag"), prov.alias("provenance"))
    return rows.groupBy("flag", "provenance", trust.claim_allowed(F.col("provenance")).alias("allowed")).agg(F.count("*").alias("n"))


@query(f"WITH {B.EDGES_SQL} SELECT DISTINCT provenance, round({_DEFAULT}, 6)::DOUBLE AS confidence, CAST({_RANK} AS BIGINT) AS rank FROM edges")
def provenance_defaults(t: Tables) -> DataFrame:
    p = F.col("provenance")
    return B.edges(t).select("provenance").distinct().select("provenance", trust.default_confidence(p).alias("confidence"), trust.provenance_rank(p).cast("long").alias("rank"))


@query("""SELECT l_orderkey, l_partkey, provenance, confidence, evidence FROM (SELECT l_orderkey, l_partkey, max(l_tax) AS confidence,
 arg_max(provenance, (r, provenance)) AS provenance, array_to_string(list_sort(list(DISTINCT e)), ',') AS evidence FROM (
 SELECT l_orderkey, l_partkey, l_tax, 's' || l_suppkey AS e, CASE l_returnflag WHEN 'R' THEN 'RESOLVED' WHEN 'A' THEN 'EXTRACTED' ELSE 'INFERRED' END AS provenance, CASE l_returnflag WHEN 'R' THEN 4 WHEN 'A' THEN 3 ELSE 1 END AS r FROM lineitem) GROUP BY 1, 2)""")
def edge_merge(t: Tables) -> DataFrame:
    prov = F.when(F.col("l_returnflag") == "R", "RESOLVED").when(F.col("l_returnflag") == "A", "EXTRACTED").otherwise("INFERRED")
    rows = t.lineitem.select(F.col("l_orderkey").alias("subject"), F.lit("calls").alias("predicate"), F.col("l_partkey").alias("object"), prov.alias("provenance"), F.col("l_tax").alias("confidence"), F.array(F.concat(F.lit("s"), "l_suppkey")).alias("evidence"))
    return graph.merge_edges(rows).select(F.col("subject").alias("l_orderkey"), F.col("object").alias("l_partkey"), "provenance", "confidence", F.array_join("evidence", ",").alias("evidence"))


@query("SELECT 'dangling' AS kind, 'orders:' || l_orderkey AS subject, 'part:' || l_partkey AS object, 'object' AS missing FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def verify_dangling(t: Tables) -> DataFrame:
    edges = t.lineitem.select(F.concat(F.lit("orders:"), "l_orderkey").alias("subject"), F.concat(F.lit("part:"), "l_partkey").alias("object")).distinct()
    known = t.part.filter("p_size > 5").select(F.concat(F.lit("part:"), "p_partkey").alias("id")).union(t.orders.select(F.concat(F.lit("orders:"), "o_orderkey")))
    return store.dangling(edges, known).select(F.lit("dangling").alias("kind"), "subject", "object", "missing")


@query(f"WITH {B.ENTITIES_SQL}, {B.EDGES_SQL} SELECT 'entities' AS measure, CAST(count(*) AS BIGINT) AS n FROM entities UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'documents', count(*) FROM documents")
def stats(t: Tables) -> DataFrame:
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")
    return one("entities", B.entities(t)).union(one("edges", B.edges(t))).union(one("documents", t.documents))


@query("SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE left(text, 40) || '…' END AS short FROM documents")
def truncate_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.truncate(F.col("text"), 40).alias("short"))


@query("SELECT conv_id, turn, role, role = 'user' AND false AS never, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS INT) AS overload, CASE WHEN row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) > 1 THEN '#' || (row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1) ELSE '' END AS suffix FROM conversations")
def overload_numbering(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", "role", F.lit(False).alias("never"))
    return derive.overloads(rows, ["conv_id", "role"], [F.col("turn")])


@query("SELECT CAST(count(*) AS BIGINT) AS documents, CAST(sum(n_chars) AS BIGINT) AS size, max(doc_id) AS newest FROM documents")
def snapshot_status(t: Tables) -> DataFrame:
    return t.documents.agg(F.count("*").alias("documents"), F.sum("n_chars").alias("size"), F.max("doc_id").alias("newest"))


@query(f"WITH {B.FILES_SQL} SELECT sha256(array_to_string(list_sort(list(path || ' ' || digest)), chr(10))) AS manifest, CAST(count(*) AS BIGINT) AS files FROM files")
def blind_manifest(t: Tables) -> DataFrame:
    return B.files(t).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "path", "digest"))), "\n"), 256).alias("manifest"), F.count("*").alias("files"))
