"""Rules, lookups, failures, resolution and benchmarks over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import rules as R
from factloom.operators import benchmark, lookups, resolution, semantic
from factloom.plans import binding as B
from factloom.plans.registry import Tables, query
from factloom.sources import failures, manifests

_count = lambda c: F.sum(c.cast("int"))


# confidences and kinds

_KIND = "CASE c_mktsegment WHEN 'BUILDING' THEN 'route' WHEN 'MACHINERY' THEN 'queue' WHEN 'AUTOMOBILE' THEN 'entrypoint' WHEN 'HOUSEHOLD' THEN 'lifecycle' ELSE 'other' END"


@query(f"""WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, round(least(CASE {_KIND} WHEN 'route' THEN 1.0 WHEN 'queue' THEN 0.85 WHEN 'entrypoint' THEN 0.4 WHEN 'lifecycle' THEN 0.7 ELSE 0.3 END + CASE WHEN n IS NULL THEN 0 ELSE 0.05 END, 1.0), 6)::DOUBLE AS confidence FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def entrypoint_confidence(t: Tables) -> DataFrame:
    """Customers as entry points by segment; those with orders name a symbol."""
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "route").when(F.col("c_mktsegment") == "MACHINERY", "queue").when(F.col("c_mktsegment") == "AUTOMOBILE", "entrypoint").when(F.col("c_mktsegment") == "HOUSEHOLD", "lifecycle").otherwise("other")
    symbol = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").cast("string").alias("symbol"))
    return t.customer.join(symbol, "c_custkey", "left").select("c_custkey", F.round(R.entrypoint_confidence(kind, F.col("symbol")), 6).alias("confidence"))


_SUBCLASS = "CASE p_type WHEN 'ECONOMY' THEN 'http' WHEN 'SMALL' THEN 'event' WHEN 'STANDARD' THEN 'schema' WHEN 'PROMO' THEN 'rpc' ELSE 'message' END"


@query(f"""WITH l AS (SELECT l_partkey, count(DISTINCT l_suppkey) FILTER (l_returnflag = 'R') AS consumers, count(*) FILTER (l_discount > 0.09) AS evidence, min(l_suppkey) AS producer FROM lineitem GROUP BY 1)
SELECT p_partkey, round(least(CASE {_SUBCLASS} WHEN 'http' THEN 0.95 WHEN 'event' THEN 0.85 WHEN 'schema' THEN 0.35 WHEN 'rpc' THEN 0.75 ELSE 0.7 END + CASE WHEN producer IS NULL OR producer = p_partkey THEN 0 ELSE 0.1 END + CASE WHEN consumers > 0 THEN 0.05 ELSE 0 END + CASE WHEN evidence > 0 THEN 0.05 ELSE 0 END, 1.0), 6)::DOUBLE AS confidence
FROM part LEFT JOIN l ON p_partkey = l_partkey""")
def contract_confidence(t: Tables) -> DataFrame:
    """Parts as contracts by type, with the suppliers of their lines as producer, consumers and evidence."""
    l = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("consumers"), F.collect_set(F.when(F.col("l_discount") > 0.09, F.col("l_orderkey"))).alias("evidence"), F.min("l_suppkey").cast("string").alias("producer"))
    none = F.array().cast("array<bigint>")
    rows = t.part.join(l, "p_partkey", "left").withColumns({"consumers": F.coalesce("consumers", none), "evidence": F.coalesce("evidence", none)})
    subclass = F.when(F.col("p_type") == "ECONOMY", "http").when(F.col("p_type") == "SMALL", "event").when(F.col("p_type") == "STANDARD", "schema").when(F.col("p_type") == "PROMO", "rpc").otherwise("message")
    return rows.select("p_partkey", F.round(R.contract_confidence(subclass, F.col("p_partkey").cast("string"), F.col("producer"), F.col("consumers"), F.col("evidence")), 6).alias("confidence"))


_SUPPLIES = "l AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_linestatus = 'O') AS o, count(*) FILTER (l_quantity > 49.5) AS q, count(*) FILTER (l_discount > 0.095) AS d FROM lineitem GROUP BY 1)"


@query(f"""WITH {_SUPPLIES}, c AS (SELECT s_suppkey AS id, round(least(0.2 + CASE WHEN s_acctbal > 0 THEN 0.15 ELSE 0 END + CASE WHEN r > 0 THEN 0.1 ELSE 0 END + CASE WHEN a > 0 THEN 0.1 ELSE 0 END + CASE WHEN o > 0 THEN 0.1 ELSE 0 END + CASE WHEN q > 0 THEN 0.1 ELSE 0 END + CASE WHEN d > 0 THEN 0.1 ELSE 0 END
 + CASE WHEN s_acctbal > 5000 THEN 0.1 ELSE 0 END + CASE WHEN s_nationkey > 20 THEN 0.1 ELSE 0 END + CASE WHEN s_acctbal < 0 THEN 0.05 ELSE 0 END + CASE WHEN s_nationkey < 5 THEN 0.05 ELSE 0 END, 1.0), 6)::DOUBLE AS confidence FROM supplier LEFT JOIN l ON s_suppkey = l_suppkey)
SELECT id, confidence, CAST(row_number() OVER (ORDER BY confidence DESC, id) AS INT) AS position FROM c""")
def rank_startup_components(t: Tables) -> DataFrame:
    """Suppliers as components, ordered by what is known of them."""
    l = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(_count(F.col("l_returnflag") == "R").alias("r"), _count(F.col("l_returnflag") == "A").alias("a"), _count(F.col("l_linestatus") == "O").alias("o"), _count(F.col("l_quantity") > 49.5).alias("q"), _count(F.col("l_discount") > 0.095).alias("d"))
    rows = t.supplier.join(l, "s_suppkey", "left").na.fill(0, list("raoqd"))
    bal = F.col("s_acctbal")
    has = {"purpose": bal > 0, "implementation": F.col("r") > 0, "symbols": F.col("a") > 0, "consumes": F.col("o") > 0, "produces": F.col("q") > 0, "upstream": F.col("d") > 0, "downstream": bal > 5000, "owns": F.col("s_nationkey") > 20, "failure_behavior": bal < 0}
    layer = F.when(F.col("s_nationkey") < 5, "core").otherwise("component")
    return B.ranked(rows.select(F.col("s_suppkey").alias("id"), F.round(R.component_confidence(has, layer), 6).alias("confidence")), [F.desc("confidence"), F.col("id")], "position")


@query(f"""WITH {B.EDGES_SQL} SELECT subject, object, CASE predicate WHEN 'calls' THEN 'call' WHEN 'imports' THEN 'import' END AS kind FROM edges""")
def reference_kind(t: Tables) -> DataFrame:
    return B.edges(t).select("subject", "object", R.reference_kind(F.col("predicate"), F.regexp_extract("object", "^([a-z]+):", 1)).alias("kind"))


@query("""WITH m AS (SELECT l_returnflag AS layer, avg(l_discount) AS mean FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), n AS (SELECT l_returnflag AS layer, avg(l_discount) AS mean FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT m.layer, round(CASE WHEN m.mean = 0 THEN 0 ELSE n.mean / m.mean END, 6) AS ratio, round(CASE WHEN m.mean - 0.05 = 0 THEN CASE WHEN n.mean > 0.05 THEN 1.0 ELSE 0.0 END ELSE (n.mean - 0.05) / (m.mean - 0.05) END, 4) AS efficiency FROM m JOIN n ON m.layer = n.layer""")
def transfer_ratios(t: Tables) -> DataFrame:
    """Mean discounts of open and of finished lines as two corpora."""
    mean = lambda s: t.lineitem.filter(F.col("l_linestatus") == s).groupBy(F.col("l_returnflag").alias("layer")).agg(F.avg("l_discount").alias("mean"))
    ratios = benchmark.transfer_ratios(mean("O"), mean("F"))
    gains = mean("O").withColumnRenamed("mean", "a").join(mean("F").withColumnRenamed("mean", "b"), "layer")
    gains = gains.select("layer", R.generalization_efficiency(F.col("a") - 0.05, F.col("b") - 0.05).alias("efficiency"))
    return ratios.join(gains, "layer").select("layer", F.round("ratio", 6).alias("ratio"), F.round("efficiency", 4).alias("efficiency"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(t, 'test|spec|suite') THEN 'task touches tests' WHEN regexp_matches(t, 'perf|latency|slow|benchmark') THEN 'performance investigation' ELSE 'standard' END AS rationale FROM (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)""")
def compression_policy(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.get_json_object(R.compression_policy(F.col("text")), "$.rationale").alias("rationale"))


@query(r"""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS p FROM pages UNION ALL SELECT -1 - page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || CASE WHEN url LIKE 'https%' THEN '/yarn.lock' ELSE '/package-lock.json' END FROM pages)
SELECT page_id, regexp_matches(regexp_extract(p, '([^/]*)$', 1), '(?i)^(go\.sum|npm-shrinkwrap\.json)$|\.lock$|-lock\.|_lock\.') AS skipped FROM u""")
def skip_paths(t: Tables) -> DataFrame:
    """Pages' paths, and a lock file of each page's host."""
    path = t.pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("p"))
    lock = t.pages.select((-1 - F.col("page_id")), F.concat(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.when(F.col("url").startswith("https"), "/yarn.lock").otherwise("/package-lock.json")))
    return path.union(lock).select("page_id", R.is_skip_path(F.col("p")).alias("skipped"))


@query("""WITH d AS (SELECT source, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS before, doc_id FROM documents)
SELECT doc_id, CAST(coalesce(list_position(list_transform(range(1, greatest(length(text), length(before)) + 1), lambda i: text[i] = before[i] AND i <= length(text) AND i <= length(before)), false) - 1, length(text)) AS BIGINT) AS n FROM d WHERE before IS NOT NULL""")
def common_prefixes(t: Tables) -> DataFrame:
    """Characters that each document shares with the one before it of its source."""
    rows = t.documents.withColumn("before", F.lag("text").over(Window.partitionBy("source").orderBy("doc_id")))
    return rows.filter("before is not null").select("doc_id", R.common_prefix_len(F.col("text"), F.col("before")).alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '/') || '/' || p_type ELSE replace(replace(p_brand, '#', '/'), ' ', '/') || '/' || p_type END AS path FROM part""")
def module_references(t: Tables) -> DataFrame:
    """Dotted names, and names relative to a file two folders down, by size."""
    dotted = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("."), "p_type")
    module = F.when(F.col("p_size") % 2 == 0, dotted).otherwise(F.concat(F.lit("./../x/.././"), "p_type"))
    file = F.concat(F.replace("p_brand", F.lit("#"), F.lit("/")), F.lit("/sub/file.py"))
    return t.part.select("p_partkey", R.resolve_module_ref(file, module).alias("path"))


@query("""SELECT c_custkey, c_mktsegment = 'BUILDING' OR contains(lower(c_name), '7') AS cached FROM (SELECT c_custkey, c_mktsegment, c_name FROM customer)""")
def cache_stores(t: Tables) -> DataFrame:
    """Customers as stores: builders run redis, and names with a 7 call themselves a cache."""
    name = F.regexp_replace("c_name", "7", "Cache")
    technology = F.when(F.col("c_mktsegment") == "BUILDING", "Redis")
    return t.customer.select("c_custkey", R.is_cache_store(name, technology).alias("cached"))


@query(r"""SELECT doc_id, trim(lower(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ') AS signature FROM documents WHERE lang <> 'tr'""")
def canonical_signatures(t: Tables) -> DataFrame:
    return t.documents.filter("lang <> 'tr'").select("doc_id", R.canonical_signature(F.col("text")).alias("signature"))


@query("""SELECT o_custkey, string_agg(o_orderpriority || '/' || o_orderkey || '.py', ',' ORDER BY o_orderkey) AS paths FROM orders WHERE o_totalprice > 100000 GROUP BY 1""")
def surface_paths(t: Tables) -> DataFrame:
    """A surface of each customer's large orders, rendered and read again."""
    lines = F.concat(F.lit("\nCOMPONENT\n\n"), "o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".py [core]\n\n  function f\n"))
    rows = t.orders.filter("o_totalprice > 100000").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", lines.alias("x")))).alias("all"))
    text = F.array_join(F.transform("all", lambda x: x["x"]), "")
    return rows.select("o_custkey", F.array_join(R.surface_paths(text), ",").alias("paths"))


# lookups

@query(f"WITH {B.EDGES_SQL} SELECT object AS id, CAST(count(DISTINCT subject) AS BIGINT) AS sources FROM edges GROUP BY 1")
def ubiquity(t: Tables) -> DataFrame:
    return lookups.ubiquity(B.edges(t))


@query("""WITH e AS (SELECT DISTINCT 'part:' || l_partkey AS subject, 'supplier:' || l_suppkey AS object, l_returnflag AS path FROM lineitem),
ends AS (SELECT subject AS id, path FROM e UNION SELECT object, path FROM e), n AS (SELECT 'part:' || p_partkey AS id, p_brand AS path FROM part)
SELECT id, path FROM n UNION SELECT ends.id, ends.path FROM ends JOIN n ON ends.id = n.id""")
def entity_sources(t: Tables) -> DataFrame:
    """The sources of each part: its brand, and the flags of its lines."""
    edges = t.lineitem.select(F.concat(F.lit("part:"), "l_partkey").alias("subject"), F.concat(F.lit("supplier:"), "l_suppkey").alias("object"), F.col("l_returnflag").alias("path"))
    return lookups.entity_sources(t.part.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_brand").alias("path")), edges)


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, CAST(l_partkey AS VARCHAR) AS a, CAST(l_suppkey AS VARCHAR) AS b, CASE WHEN l_linenumber = 4 THEN '' ELSE l_returnflag END AS claim FROM lineitem),
k AS (SELECT DISTINCT l_orderkey, CAST(l_partkey AS VARCHAR) AS id FROM lineitem WHERE l_quantity > 10 UNION SELECT DISTINCT l_orderkey, CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_discount > 0.02),
c AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS INT) AS position, claim, a, b, EXISTS (SELECT 1 FROM k WHERE k.l_orderkey = l.l_orderkey AND k.id = l.a) AS ka, EXISTS (SELECT 1 FROM k WHERE k.l_orderkey = l.l_orderkey AND k.id = l.b) AS kb FROM l)
SELECT l_orderkey, position, claim, concat_ws(',', CASE WHEN NOT ka THEN a END, CASE WHEN NOT kb THEN b END) AS unknown, CASE WHEN claim <> '' AND ka AND kb THEN '- ' || claim || ' [evidence: ' || a || ', ' || b || ']' END AS line FROM c""")
def claim_evidence(t: Tables) -> DataFrame:
    """Lines of orders as claims that rest on their part and supplier; a pack knows those of large or discounted lines."""
    one = t.lineitem
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("order")  # lines may share a number
    claims = one.select("l_orderkey", order, F.when(F.col("l_linenumber") == 4, "").otherwise(F.col("l_returnflag")).alias("claim"), F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("evidence"))
    known = one.filter("l_quantity > 10").select("l_orderkey", F.col("l_partkey").cast("string").alias("id")).union(one.filter("l_discount > 0.02").select("l_orderkey", F.col("l_suppkey").cast("string")))
    checked = semantic.checked_claims(claims, ["l_orderkey"], F.col("order"), "claim", "evidence", known)
    return checked.select("l_orderkey", "position", "claim", F.array_join("unknown", ",").alias("unknown"), "line")


@query("""SELECT l_orderkey || '/' || l_partkey AS id, max(p_brand) || ':' || max(p_size) || '-' || (max(p_size) + 1) AS places FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, l_partkey""")
def edge_locations(t: Tables) -> DataFrame:
    """Where the ends of the calls of orders are: parts have a place, orders none."""
    edges = t.lineitem.select("l_orderkey", "l_partkey").distinct().select(F.concat_ws("/", "l_orderkey", "l_partkey").alias("id"), F.concat(F.lit("orders:"), "l_orderkey").alias("subject"), F.concat(F.lit("part:"), "l_partkey").alias("object"))
    entities = t.part.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.lit("symbol").alias("kind"), F.col("p_brand").alias("path"), F.col("p_size").alias("line"), (F.col("p_size") + 1).alias("end_line"))
    return lookups.locations(edges, entities).select("id", F.array_join("places", ",").alias("places"))


@query("SELECT l_orderkey AS id, CAST(coalesce(min(l_linenumber) FILTER (l_quantity > 25), 0) AS INT) AS line FROM lineitem GROUP BY 1")
def evidence_lines(t: Tables) -> DataFrame:
    """The first large line of each order; lines are its evidence, small ones have no place."""
    edges = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_quantity")).alias("evidence"))
    evidence = t.lineitem.filter("l_quantity > 25").select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_quantity").alias("id"), F.col("l_linenumber").alias("line")).distinct()
    return lookups.evidence_lines(edges, evidence)


@query("SELECT CAST(conv_id AS VARCHAR) AS entry, CAST(count(*) AS INT) AS length FROM conversations GROUP BY 1")
def chain_lengths(t: Tables) -> DataFrame:
    paths = t.conversations.groupBy(F.col("conv_id").cast("string").alias("entry")).agg(F.collect_list("turn").alias("path"))
    return lookups.longest_chains(paths)


@query("SELECT p_name AS name, 'part:' || CAST(min(CAST(p_partkey AS VARCHAR)) AS VARCHAR) AS id FROM part WHERE p_size > 25 GROUP BY 1")
def first_named(t: Tables) -> DataFrame:
    entities = t.part.filter("p_size > 25").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("symbol").alias("kind"), F.col("p_name").alias("name"))
    return lookups.first_named(entities, t.part.select(F.col("p_name").alias("name")))


@query("SELECT DISTINCT p_name AS name FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def exported_class_names(t: Tables) -> DataFrame:
    """Names of economy and promotion parts, as classes, that were returned, as exports."""
    kind = F.when(F.col("p_type") == "ECONOMY", "class").when(F.col("p_type") == "PROMO", "interface").otherwise("function")
    entities = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), kind.alias("symbol_kind"))
    edges = t.lineitem.filter("l_returnflag = 'R'").select(F.lit("exports").alias("predicate"), F.col("l_partkey").alias("object"))
    return lookups.exported_names(entities, edges)


@query("SELECT 'orders:' || o_orderkey AS id, o_orderstatus AS name FROM orders WHERE o_custkey = 1")
def concept_occurrences(t: Tables) -> DataFrame:
    edges = t.orders.select(F.concat(F.lit("orders:"), "o_orderkey").alias("subject"), F.lit("occurs").alias("predicate"), F.concat(F.lit("customer:"), "o_custkey").alias("object"))
    return lookups.concept_occurrences(edges, B.entities(t).select("id", "name"), "customer:1")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.095)")
def fresh_entities(t: Tables) -> DataFrame:
    """Orders without a line of a great discount, which counts as stale evidence."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.concat_ws("/", "l_orderkey", "l_discount")).alias("evidence"))
    rows = t.orders.select(F.col("o_orderkey").alias("id")).join(lines, "id", "left")
    stale = t.lineitem.filter("l_discount > 0.095").select(F.concat_ws("/", "l_orderkey", "l_discount").alias("id")).distinct()
    return lookups.fresh(rows, stale).select("id")


_STEP_PROV = "CASE l_returnflag WHEN 'R' THEN 'RESOLVED' WHEN 'A' THEN 'INFERRED' ELSE 'EXTRACTED' END"


@query(f"""WITH s AS (SELECT l_orderkey AS id, l_linenumber, {_STEP_PROV} AS prov, l_discount > 0.095 AS stale FROM lineitem)
SELECT id, CAST(count(*) FILTER (prov <> 'INFERRED') AS INT) AS steps FROM s GROUP BY 1 HAVING NOT bool_or(stale) AND count(*) FILTER (prov <> 'INFERRED') > 0""")
def trusted_flows(t: Tables) -> DataFrame:
    """Orders as flows: accepted lines are inferred steps, discounted ones rest on stale evidence."""
    prov = F.when(F.col("l_returnflag") == "R", "RESOLVED").when(F.col("l_returnflag") == "A", "INFERRED").otherwise("EXTRACTED")
    step = F.struct(F.col("l_linenumber").alias("order"), prov.alias("provenance"), F.array(F.concat_ws("/", "l_orderkey", "l_discount")).alias("evidence"))
    flows = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(step).alias("steps"))
    stale = t.lineitem.filter("l_discount > 0.095").select(F.concat_ws("/", "l_orderkey", "l_discount").alias("id")).distinct()
    return lookups.trusted_flows(flows, stale).select("id", F.size("steps").alias("steps"))


@query("SELECT s_suppkey AS seed, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS members FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 2")
def flow_participant_groups(t: Tables) -> DataFrame:
    return lookups.flow_groups(t.lineitem.select(F.col("l_suppkey").alias("seed"), F.col("l_partkey").alias("node"))).select("seed", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query("SELECT c_name AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'svc/' || c_nationkey ELSE c_name END AS dir FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def unit_dirs(t: Tables) -> DataFrame:
    """Customers as deployment units: builders have a context, machinery an image, households the root."""
    seg = F.col("c_mktsegment")
    context = F.when(seg == "BUILDING", F.concat(F.lit("./svc/"), F.col("c_nationkey").cast("string"))).when(seg == "HOUSEHOLD", F.lit("./"))
    return lookups.unit_dirs(t.customer.select(F.col("c_name").alias("name"), context.alias("build_context"), F.when(seg == "MACHINERY", "img").alias("image")))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand || '.' || p_name ELSE p_name END AS label FROM part")
def store_labels(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", lookups.store_label(F.when(F.col("p_size") > 25, "data_entity").otherwise("state"), F.col("p_name"), F.col("p_brand")).alias("label"))


@query("""WITH s AS (SELECT CAST(conv_id AS VARCHAR) AS flow, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, length(text) AS n FROM conversations)
SELECT flow, string_agg(CASE WHEN role = before THEN '  → ' || n ELSE (turn + 1) || '. ' || role || ': ' || n END || CASE WHEN n > 500 THEN ' (long)' ELSE '' END, chr(10) ORDER BY turn) AS text FROM s GROUP BY 1""")
def render_flows(t: Tables) -> DataFrame:
    n = F.char_length("text")
    steps = t.conversations.select(F.col("conv_id").cast("string").alias("flow"), (F.col("turn") + 1).alias("order"), F.col("role").alias("actor"), n.cast("string").alias("operation"), F.when(n > 500, "long").alias("condition"))
    return lookups.render_flows(steps)


# failures, references and manifests

@query("""WITH d AS (SELECT *, CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'go' WHEN 'de' THEN 'rust' ELSE 'typescript' END AS language, 'src/' || source || '/m' || doc_id AS path FROM documents)
SELECT path, symbol, kind, detail, CAST(line AS INT) AS line FROM (
 SELECT path, 'run_' || doc_id AS symbol, 'dlq' AS kind, 'orders-dlq-' || source AS detail, 4 AS line FROM d WHERE language = 'python'
 UNION ALL SELECT path, 'run_' || doc_id, 'except-fallback', 'except block', 5 FROM d WHERE language = 'python' UNION ALL SELECT path, 'run_' || doc_id, 'circuit-breaker', 'Circuit' || n_chars, 6 FROM d WHERE language = 'python'
 UNION ALL SELECT path, 'Store.Save' || doc_id, 'panic', 'panic call', 3 FROM d WHERE language = 'go'
 UNION ALL SELECT path, 'load_' || doc_id, 'panic', 'expect(', 2 FROM d WHERE language = 'rust' UNION ALL SELECT path, 'load_' || doc_id, 'dlq', 'dead-letter ' || n_chars, 2 FROM d WHERE language = 'rust'
 UNION ALL SELECT path, 'pull_' || doc_id, 'circuit-breaker', 'circuit_open', 2 FROM d WHERE language = 'typescript' UNION ALL SELECT path, 'circuit_open', 'except-fallback', 'catch block', 3 FROM d WHERE language = 'typescript' UNION ALL SELECT path, 'circuit_open', 'dlq', 'DLQ', 3 FROM d WHERE language = 'typescript')""")
def scan_failures(t: Tables) -> DataFrame:
    return failures.scan_failures(B.sources(t))


@query("""SELECT 'symbol:src/' || source || '/m' || doc_id || CASE lang WHEN 'en' THEN '#run_' || doc_id WHEN 'de' THEN '#load_' || doc_id ELSE '#circuit_open' END AS subject, 'subscribes' AS predicate,
'topic:' || CASE lang WHEN 'en' THEN 'orders-dlq-' || source WHEN 'de' THEN 'dead-letter ' || n_chars ELSE 'DLQ' END AS object FROM documents WHERE lang <> 'fr'""")
def dead_letter_edges(t: Tables) -> DataFrame:
    return failures.apply_failures(failures.scan_failures(B.sources(t)))["edges"]


@query("""SELECT 'src/' || source || '/m' || doc_id AS path, CASE lang WHEN 'en' THEN 'run_' || doc_id WHEN 'fr' THEN 'Store.Save' || doc_id WHEN 'de' THEN 'load_' || doc_id ELSE 'circuit_open' END AS symbol, 'KEY_' || upper(lang) AS key, CAST(CASE lang WHEN 'en' THEN 7 WHEN 'fr' THEN 4 WHEN 'de' THEN 3 ELSE 4 END AS INT) AS line FROM documents""")
def env_references(t: Tables) -> DataFrame:
    return failures.env_references(B.sources(t))


@query("""WITH d AS (SELECT DISTINCT lang, source FROM documents) SELECT source AS name, array_to_string(list_sort(list(lang || '/' || source)), ',') AS dirs FROM d WHERE lang IN ('de', 'fr') GROUP BY 1
UNION ALL SELECT name, dirs FROM (SELECT 'en' AS name, 'en' AS dirs) WHERE EXISTS (SELECT 1 FROM d WHERE lang = 'en')""")
def manifest_packages(t: Tables) -> DataFrame:
    """A workspace of Cargo packages by glob for German and French sources, and one folder that go.work uses."""
    files = t.documents.select(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), F.lit("").alias("content"))
    cargo, gowork = '[workspace]\nresolver = "2"\nmembers = ["de/*", \'fr/*\',\n "gone"]\n', "go 1.22\nuse (\n\t./en // main\n\t./absent\n)\n"
    listed = t.spark.createDataFrame([("Cargo.toml", cargo), ("go.work", gowork)], "path string, content string")
    return manifests.manifest_packages(files.union(listed)).select("name", F.array_join("dirs", ",").alias("dirs"))


# resolution

def _calls(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines as extracted calls from orders to parts, their evidence, and definitions by the suppliers of returned lines."""
    ev = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    line = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").distinct().groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.max("l_returnflag").alias("l_returnflag"))
    edges = line.select(ev.alias("id"), F.concat(F.lit("orders:"), "l_orderkey").alias("subject"), F.lit("calls").alias("predicate"), F.concat(F.lit("external:"), "l_partkey").alias("object"), F.lit("EXTRACTED").alias("provenance"), F.lit(0.8).alias("confidence"), F.array(ev).alias("evidence"))
    evidence = line.select(ev.alias("id"), F.col("l_orderkey").cast("string").alias("path"), F.concat(F.lit("p"), "l_partkey").alias("symbol"), (F.col("l_linenumber") * 100000 + F.col("l_suppkey")).alias("line"))
    target = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("external:"), "l_partkey")).otherwise(F.concat(F.lit("symbol:"), "l_suppkey"))
    definitions = line.filter("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("file"), (F.col("l_linenumber") * 100000 + F.col("l_suppkey")).alias("line"), F.concat(F.lit("p"), "l_partkey").alias("callee"), target.alias("target"))
    return edges, evidence, definitions


_L = "l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2, 3, 4)"


@query(f"""WITH {_L} SELECT 'orders:' || l_orderkey AS subject, CASE WHEN f <> 'R' OR l_suppkey % 2 = 0 THEN 'external:' || l_partkey ELSE 'symbol:' || l_suppkey END AS object, CASE WHEN f = 'R' THEN 'RESOLVED' ELSE 'EXTRACTED' END AS provenance, CASE WHEN f = 'R' THEN 0.99 ELSE 0.8 END::DOUBLE AS confidence FROM l""")
def upgraded_calls(t: Tables) -> DataFrame:
    edges, evidence, definitions = _calls(t)
    return resolution.upgrade(edges, resolution.external_edges(edges, evidence), definitions).select("subject", "object", "provenance", "confidence")


@query(f"""WITH {_L} SELECT DISTINCT 'resolution_conflict' AS kind, 'medium' AS severity, l_orderkey || ':' || (l_linenumber * 100000 + l_suppkey) || ' call to p' || l_partkey || ' resolved to symbol:' || l_suppkey || '; the index had external:' || l_partkey AS message FROM l WHERE f = 'R' AND l_suppkey % 2 = 1 AND l_linenumber > 1""")
def resolution_conflicts(t: Tables) -> DataFrame:
    """Conflicts of the upgrades; those of first lines are known."""
    edges, evidence, definitions = _calls(t)
    before = resolution.external_edges(edges, evidence)
    found = resolution.conflicts(resolution.diff_upgrades(before, resolution.upgrade(edges, before, definitions)))
    known = found.filter(F.regexp_extract("message", r":(\d+) call", 1).cast("long") < 200000).select("message")
    return resolution.persist(found, known)


@query(f"""WITH {_L} SELECT CAST(sum(CAST(f = 'R' AND l_suppkey % 2 = 1 AS INT)) AS BIGINT) AS conflicts, CAST(sum(CAST(f <> 'R' AS INT)) AS BIGINT) AS unresolved, CAST(count(*) AS BIGINT) AS external, sum(CAST(f = 'R' AND l_suppkey % 2 = 1 AS INT)) = 0 AND sum(CAST(f <> 'R' AS INT)) < 0.3 * count(*) AS passed FROM l""")
def resolution_gate(t: Tables) -> DataFrame:
    edges, evidence, definitions = _calls(t)
    before = resolution.external_edges(edges, evidence).withColumn("repo", F.col("file").cast("long") % 7)
    after = resolution.diff_upgrades(before, resolution.upgrade(edges, before, definitions)).withColumn("repo", F.col("file").cast("long") % 7)
    return resolution.gate(resolution.summary(before, after, "repo"))


@query(f"""WITH {_L}, c AS (SELECT CAST(l_orderkey AS VARCHAR) AS file, count(*) AS n FROM l GROUP BY 1), s AS (SELECT file, n, coalesce(sum(n) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT file, CAST(least(n, 500 - before) AS BIGINT) AS sites FROM s WHERE before < 500""")
def candidate_files(t: Tables) -> DataFrame:
    edges, evidence, _ = _calls(t)
    return resolution.candidate_files(resolution.external_edges(edges, evidence))


# benchmarks

@query("""WITH w AS (SELECT DISTINCT n_name AS repo, c_mktsegment AS layer, c_custkey AS item FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0), f AS (SELECT DISTINCT n_name AS repo, c_mktsegment AS layer, c_custkey AS item FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey),
k AS (SELECT coalesce(w.repo, f.repo) AS repo, count(w.item) AS wanted, count(f.item) AS found, count(CASE WHEN w.item IS NOT NULL AND f.item IS NOT NULL THEN 1 END) AS hits FROM w FULL JOIN f ON w.repo = f.repo AND w.layer = f.layer AND w.item = f.item GROUP BY 1),
r AS (SELECT repo, CASE WHEN wanted = 0 THEN 1.0 ELSE hits / wanted::DOUBLE END AS recall, CASE WHEN found = 0 THEN 1.0 ELSE hits / found::DOUBLE END AS precision FROM k), x AS (SELECT *, CASE WHEN 4 * precision + recall = 0 THEN 0 ELSE 5 * precision * recall / (4 * precision + recall) END AS f2 FROM r)
SELECT repo, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f2, 6) AS f2 FROM x UNION ALL SELECT NULL, round(avg(recall), 6), round(avg(precision), 6), round(avg(f2), 6) FROM x""")
def atlas_recall(t: Tables) -> DataFrame:
    """Customers in credit as what should be known of each nation, those with orders as what is."""
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("repo"), F.col("c_mktsegment").alias("layer"), F.col("c_custkey").alias("item"), "c_acctbal")
    found = rows.join(t.orders.select(F.col("o_custkey").alias("item")).distinct(), "item", "left_semi")
    counts = benchmark.layer_recall(rows.filter("c_acctbal > 0"), found)
    report = benchmark.recall_report(counts, rows.groupBy("repo").agg(F.count("*").alias("tokens")))
    return report.select("repo", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f2")])


@query("""WITH s AS (SELECT p_partkey, count(l_orderkey) AS n, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_linestatus = 'O') AS o, p_size, p_type FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 5, 6)
SELECT p_partkey, CASE WHEN p_size > 45 THEN CASE WHEN p_type = 'PROMO' THEN 'PARSER' ELSE 'EXTRACTOR' END WHEN n = 0 THEN 'RESOLUTION' WHEN r > 5 THEN CASE WHEN o > 10 THEN 'ALIAS' ELSE 'PROJECTION' END WHEN o > 15 THEN 'COMPILER' WHEN p_size > 20 THEN 'ALIAS' ELSE 'COMPILER' END AS cause FROM s""")
def gap_causes(t: Tables) -> DataFrame:
    """Parts as missed facts: large ones never reached the store, unsold ones were never connected."""
    s = t.part.join(t.lineitem, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy("p_partkey", "p_size", "p_type").agg(F.count("l_orderkey").alias("n"), _count(F.col("l_returnflag") == "R").alias("r"), _count(F.col("l_linestatus") == "O").alias("o")).na.fill(0)
    size = F.col("p_size")
    cause = benchmark.classify_gap(size <= 45, F.when(F.col("p_type") == "PROMO", False).when(F.col("p_type") == "ECONOMY", True), F.col("n") == 0, F.col("r") > 5, F.col("o") > 15, F.when(F.col("r") > 5, F.col("o") > 10).otherwise(size > 20))
    return s.select("p_partkey", cause.alias("cause"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'command_execution' WHEN 'click' THEN 'mcp_tool_call' ELSE 'tool_use' END AS kind, CASE event_type WHEN 'view' THEN 'cat' WHEN 'click' THEN 'search' ELSE 'Read' END AS tool,
CASE event_type WHEN 'view' THEN 'src/u' || user_id || '.py' WHEN 'click' THEN '' ELSE 'lib/' || event_id || '.ts' END AS paths FROM events WHERE event_type IN ('view', 'click', 'purchase', 'login')""")
def agent_events(t: Tables) -> DataFrame:
    """Events as agents' lines: views run a command in a shell, clicks ask a server, purchases read a file; errors are no JSON, the rest are results."""
    j = lambda s, *cols: F.format_string(s, *cols)
    e, u = F.col("event_id"), F.col("user_id")
    body = (
        F.when(F.col("event_type") == "view", j('{"type": "item.completed", "item": {"type": "command_execution", "command": "/bin/zsh -lc \'cat -n ./src/u%d.py | head > $X\'"}}', u))
        .when(F.col("event_type") == "click", j(' {"type": "mcp_tool_call", "tool": "search", "arguments": {"q": "%d"}}', e)).when(F.col("event_type").isin("purchase", "login"), j('{"type": "tool_use", "name": "Read", "input": {"file_path": "lib/%d.ts"}}', e))
        .when(F.col("event_type") == "error", j("no json %d", e)).otherwise(j('{"type": "tool_result", "id": %d}', e))
    )
    return benchmark.agent_events(t.events.select("event_id", body.alias("body")), "body").select("event_id", "kind", "tool", F.array_join("paths", ",").alias("paths"))


@query("""WITH r AS (SELECT c_mktsegment AS variant, c_custkey, count(o_orderkey) AS wanted, count(*) FILTER (o_orderstatus = 'F') AS hits, coalesce(sum(o_totalprice), 0) AS duration FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2)
SELECT variant, CAST(count(*) AS BIGINT) AS tasks, round(avg(duration), 2) AS mean_duration, round(avg(CASE WHEN wanted = 0 THEN 1.0 ELSE hits / wanted::DOUBLE END), 6) AS mean_recall, round(avg(CASE WHEN hits >= wanted THEN 1.0 ELSE 0.0 END), 6) AS success FROM r GROUP BY 1""")
def variant_means(t: Tables) -> DataFrame:
    runs = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_mktsegment").alias("variant"), F.col("c_custkey").alias("task"))
    runs = runs.agg(F.count("o_orderkey").alias("wanted"), F.coalesce(_count(F.col("o_orderstatus") == "F"), F.lit(0)).alias("hits"), F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("duration"))
    return benchmark.variant_means(runs).select("variant", "tasks", F.round("mean_duration", 2).alias("mean_duration"), F.round("mean_recall", 6).alias("mean_recall"), F.round("success", 6).alias("success"))


@query(f"""WITH RECURSIVE {B.CANDIDATES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY position) AS k FROM candidates),
walk AS (SELECT request, 1::BIGINT AS k, cost::BIGINT AS spent, CAST(id AS VARCHAR) AS ids FROM r WHERE k = 1 UNION ALL SELECT w.request, r.k, w.spent + r.cost, w.ids || ',' || r.id FROM walk w JOIN r ON w.request = r.request AND r.k = w.k + 1 AND w.spent + r.cost <= 9000)
SELECT request, ids, spent FROM walk w WHERE k = (SELECT max(k) FROM walk v WHERE v.request = w.request)""")
def units_within(t: Tables) -> DataFrame:
    return benchmark.units_within(B.candidates(t), ["request"], 9000).select("request", F.array_join("ids", ",").alias("ids"), "spent")


@query("SELECT 'customer:' || c_custkey AS id, lower('customer:' || c_custkey || ' ' || c_name || ' ' || c_mktsegment) AS text FROM customer")
def entity_haystack(t: Tables) -> DataFrame:
    return benchmark.haystack(t.customer.select(F.concat(F.lit("customer:"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("attributes")))
