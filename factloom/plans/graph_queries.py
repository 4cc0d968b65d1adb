"""Joins, aggregates and graph derivations over the bound property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import trust
from factloom.operators import derive, graph, resolve
from factloom.plans import binding as B
from factloom.plans.registry import Tables, query


@query("SELECT 'region:' || r_regionkey AS component, 'customer:' || c_custkey AS symbol FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey")
def symbol_component_map(t: Tables) -> DataFrame:
    down = B.edges(t).filter("predicate = 'belongs_to'").select(F.col("object").alias("subject"), F.lit("contains").alias("predicate"), F.col("subject").alias("object"))
    return graph.two_hop(down, "contains", "contains").filter("leaf like 'customer:%'").select(F.col("root").alias("component"), F.col("leaf").alias("symbol"))


_PATH = "regexp_extract(url, '^[a-z]+://([^?#]*[^?#/])', 1)"
_DIRS = f"dirs AS (SELECT DISTINCT regexp_extract({_PATH}, '^([^/]*)', 1) AS dir FROM pages UNION SELECT DISTINCT regexp_extract({_PATH}, '^([^/]*/[^/]*)/', 1) FROM pages WHERE page_id % 3 = 0 AND regexp_extract({_PATH}, '^([^/]*/[^/]*)/', 1) <> '')"


@query(f"WITH p AS (SELECT DISTINCT {_PATH} AS path FROM pages), {_DIRS} SELECT path, coalesce(max_by(dir, (length(dir), dir)), 'root') AS component FROM p LEFT JOIN dirs ON path = dir OR starts_with(path, dir || '/') GROUP BY 1")
def component_for_path(t: Tables) -> DataFrame:
    pages = t.pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^?#]*[^?#/])", 1).alias("path"))
    hosts = pages.select(F.regexp_extract("path", "^([^/]*)", 1).alias("dir")).distinct()
    sections = pages.filter("page_id % 3 = 0").select(F.regexp_extract("path", "^([^/]*/[^/]*)/", 1).alias("dir")).filter("dir <> ''").distinct()
    dirs = hosts.union(sections).distinct().select("dir", F.col("dir").alias("component"))
    return resolve.longest_prefix(pages, "path", dirs, "dir", "component", F.lit("root"))


_PAIRS = "pairs AS (SELECT a.l_partkey AS a, b.l_partkey AS b, CAST(count(*) AS BIGINT) AS count FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey WHERE a.l_orderkey IN (SELECT l_orderkey FROM li GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8) GROUP BY 1, 2 HAVING count(*) >= 2)"
_LI = "li AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"


@query(f"WITH {_LI}, {_PAIRS} SELECT a, b, count FROM pairs")
def cochange_pairs(t: Tables) -> DataFrame:
    return graph.co_occurrence(t.lineitem, "l_orderkey", "l_partkey", 2, 8)


@query("""WITH li AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey), pairs AS (SELECT a.p_brand AS a, b.p_brand AS b, count(*) AS n FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand
 WHERE a.l_orderkey IN (SELECT l_orderkey FROM li GROUP BY 1 HAVING count(*) BETWEEN 2 AND 500) GROUP BY 1, 2 HAVING count(*) >= 2) SELECT a, b, CAST(least(n, 5) AS BIGINT) AS weight FROM pairs""")
def cochange_weight(t: Tables) -> DataFrame:
    li = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")
    return graph.co_occurrence(li, "l_orderkey", "p_brand").select("a", "b", F.least("count", F.lit(5)).alias("weight"))


@query("""WITH s AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY n DESC, l_partkey) AS top FROM
 (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) AS r FROM s) WHERE r <= 5 GROUP BY 1""")
def enrich_components(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    top = n.groupBy("l_suppkey").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "l_partkey"))), 1, 5).alias("x"))
    return top.select("l_suppkey", F.array_join(F.transform("x", lambda e: e["l_partkey"].cast("string")), ",").alias("top"))


@query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS neighbours FROM orders GROUP BY 1")
def neighbour_lists(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.slice(F.sort_array(F.collect_set("o_orderpriority")), 1, 12), ",").alias("neighbours"))


@query(f"WITH {B.EDGES_SQL} SELECT subject, CASE WHEN bool_or(provenance = 'RESOLVED') THEN 'RESOLVED' ELSE 'EXTRACTED' END AS provenance, CASE WHEN bool_or(provenance = 'RESOLVED') THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END AS confidence FROM edges WHERE predicate = 'calls' GROUP BY 1")
def entry_provenance(t: Tables) -> DataFrame:
    hit = F.bool_or(F.col("provenance") == "RESOLVED")
    rows = B.edges(t).filter("predicate = 'calls'").groupBy("subject").agg(hit.alias("hit"))
    return rows.select("subject", F.when(F.col("hit"), "RESOLVED").otherwise("EXTRACTED").alias("provenance"), F.when(F.col("hit"), 1.0).otherwise(0.85).alias("confidence"))


@query(f"WITH {B.EDGES_SQL}, s AS (SELECT 'orders:' || o_orderkey AS id, o_custkey AS e FROM orders WHERE o_totalprice > 200000) SELECT type, CAST(sum(n) AS BIGINT) AS count FROM (SELECT CASE WHEN c_acctbal < 0 THEN 'STALE' ELSE c_mktsegment END AS type, count(*) AS n FROM customer WHERE c_custkey IN (SELECT e FROM s) GROUP BY 1 UNION ALL SELECT provenance, count(*) FROM edges WHERE subject IN (SELECT id FROM s) GROUP BY 1) GROUP BY 1")
def evidence_summary(t: Tables) -> DataFrame:
    subjects = t.orders.filter("o_totalprice > 200000").select(F.concat(F.lit("orders:"), "o_orderkey").alias("id"), F.array("o_custkey").alias("evidence"))
    evidence = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"), (F.col("c_acctbal") < 0).alias("stale"))
    return derive.evidence_summary(subjects, evidence, B.edges(t))


@query("SELECT target, array_to_string(list_sort(list(DISTINCT writer)), ',') AS writers FROM (SELECT 'part:' || l_partkey AS target, 'supplier:' || l_suppkey AS writer FROM lineitem) GROUP BY 1 HAVING count(DISTINCT writer) >= 2")
def state_authority_groups(t: Tables) -> DataFrame:
    w = t.lineitem.select(F.concat(F.lit("part:"), "l_partkey").alias("target"), F.concat(F.lit("supplier:"), "l_suppkey").alias("writer"))
    return derive.writer_groups(w, "target", "writer").select("target", F.array_join("writers", ",").alias("writers"))


@query("SELECT l_orderkey AS concept, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS expression, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS sources FROM lineitem GROUP BY 1")
def concept_merge(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("concept"), "l_returnflag", "l_suppkey")
    sources = rows.groupBy("concept").agg(F.array_join(F.transform(F.sort_array(F.collect_set("l_suppkey")), lambda x: x.cast("string")), ",").alias("sources"))
    return derive.unanimous(rows, "concept", "l_returnflag").withColumnRenamed("l_returnflag", "expression").join(sources, "concept")


@query("SELECT l_partkey AS concept, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS sources, count(DISTINCT l_suppkey) > 20 AS ubiquitous FROM lineitem GROUP BY 1")
def occurrence_count(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_partkey").alias("concept")).agg(F.count("*").alias("occurrences"), F.count_distinct("l_suppkey").alias("sources")).withColumn("ubiquitous", F.col("sources") > 20)


@query("""WITH c AS (SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS a, (SELECT count(*) FROM events WHERE event_type = 'purchase') AS b, (SELECT count(*) FROM pages) AS p)
SELECT CASE WHEN greatest(a * 2.0, b * 3.0, p * 1.0) <= 0 THEN 'Unknown' WHEN a * 2.0 >= b * 3.0 AND a * 2.0 >= p THEN 'service' WHEN b * 3.0 >= p THEN 'worker' ELSE 'site' END AS archetype, CAST(greatest(a * 2.0, b * 3.0, p * 1.0) AS DOUBLE) AS score FROM c""")
def detect_archetype(t: Tables) -> DataFrame:
    one = t.orders.agg(F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("a"))
    two = t.events.agg(F.sum((F.col("event_type") == "purchase").cast("long")).alias("b"))
    three = t.pages.agg(F.count("*").alias("p"))
    counts = one.join(two).join(three)  # three single rows
    return derive.archetype(counts, {"service": F.col("a") * 2.0, "worker": F.col("b") * 3.0, "site": F.col("p") * 1.0})


@query("""SELECT 'resolved' AS measure, CAST(floor(100.0 * count(*) FILTER (l_returnflag = 'R') / greatest(count(*), 1)) AS BIGINT) AS percent FROM lineitem UNION ALL
SELECT 'discounted', CAST(floor(100.0 * count(*) FILTER (l_discount > 0.05) / greatest(count(*), 1)) AS BIGINT) FROM lineitem""")
def compute_coverage(t: Tables) -> DataFrame:
    return derive.coverage(t.lineitem, {"resolved": F.col("l_returnflag") == "R", "discounted": F.col("l_discount") > 0.05})


@query("SELECT c_mktsegment AS layer, n_name AS repo, round(avg(c_acctbal), 4) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (c_mktsegment, n_name)")
def mean_layer_map(t: Tables) -> DataFrame:
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup(F.col("c_mktsegment").alias("layer"), F.col("n_name").alias("repo")).agg(F.round(F.avg("c_acctbal"), 4).alias("mean"))


_TINY = "links AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS w FROM trade)"


@query(f"""WITH RECURSIVE {B.TRADE_SQL}, {_TINY}, step AS (
 SELECT 0 AS i, n_nationkey AS id, 1.0::DOUBLE / 25 AS r FROM nation UNION ALL
 SELECT i + 1, id, r FROM (SELECT s.i, n.n_nationkey AS id, 0.15 / 25 + 0.85 * (coalesce(sum(s.r * l.w) FILTER (l.dst = n.n_nationkey), 0) + coalesce(sum(s.r) FILTER (l.src IS NULL), 0) / 25) AS r
   FROM nation n, step s LEFT JOIN links l ON l.src = s.id WHERE s.i < 50 GROUP BY s.i, n.n_nationkey))
SELECT id, round(r, 6) AS rank FROM step WHERE i = 50""")
def global_pagerank(t: Tables) -> DataFrame:
    return _rank(t).select("id", F.round("rank", 6).alias("rank"))


def _links(t: Tables) -> DataFrame:
    trade = B.trade(t)
    return trade.join(trade.groupBy("src").agg(F.sum("weight").alias("s")), "src").select("src", "dst", (F.col("weight") / F.col("s")).alias("weight"))


def _rank(t: Tables, seeds: DataFrame | None = None) -> DataFrame:
    return graph.pagerank(_links(t), t.nation.select(F.col("n_nationkey").alias("id")), seeds)


@query(f"""WITH RECURSIVE {B.TRADE_SQL}, {_TINY}, seeds AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey IN (1, 5) THEN 0.5::DOUBLE ELSE 0 END AS s FROM nation), step AS (
 SELECT 0 AS i, id, s AS r FROM seeds UNION ALL
 SELECT i + 1, id, r FROM (SELECT s.i, n.id, 0.15 * n.s + 0.85 * (coalesce(sum(s.r * l.w) FILTER (l.dst = n.id), 0) + coalesce(sum(s.r) FILTER (l.src IS NULL), 0) / 25) AS r
   FROM seeds n, step s LEFT JOIN links l ON l.src = s.id WHERE s.i < 50 GROUP BY s.i, n.id, n.s))
SELECT id, round(r, 6) AS rank FROM step WHERE i = 50""")
def task_pagerank(t: Tables) -> DataFrame:
    seeds = t.nation.filter("n_nationkey in (1, 5)").select(F.col("n_nationkey").alias("id"), F.lit(0.5).alias("share"))
    return _rank(t, seeds).select("id", F.round("rank", 6).alias("rank"))


@query(f"""WITH {B.TRADE_SQL}, d AS (SELECT dst, count(DISTINCT src) AS degree FROM trade GROUP BY 1) SELECT dst AS id, CAST(degree AS BIGINT) AS references, round(least(greatest(ln(25.0 / (1 + degree)), 0.25), 1.5), 6) AS rarity FROM d""")
def rarity(t: Tables) -> DataFrame:
    from factloom.functions.scoring import rarity as f

    d = B.trade(t).groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("references"))
    return d.select("id", "references", F.round(f(F.lit(25), F.col("references")), 6).alias("rarity"))


_PW = "CASE WHEN predicate = 'calls' AND provenance = 'RESOLVED' THEN 1.2 WHEN predicate = 'calls' THEN 0.9 WHEN predicate = 'imports' THEN 0.6 ELSE 1.0 END"
_VW = "CASE provenance WHEN 'OBSERVED' THEN 1.0 WHEN 'RESOLVED' THEN 1.0 WHEN 'EXTRACTED' THEN 0.85 WHEN 'DECLARED' THEN 0.8 WHEN 'INFERRED' THEN 0.6 ELSE 0.0 END"


@query(f"""WITH {B.ENTITIES_SQL}, {B.EDGES_SQL}, n AS (SELECT count(*) AS total FROM entities), d AS (SELECT object, count(DISTINCT subject) AS degree FROM edges GROUP BY 1),
w AS (SELECT subject AS src, edges.object AS dst, sum(CAST(round(1000000000 * ({_PW}::DOUBLE * {_VW}::DOUBLE * least(greatest(confidence, 0), 1) * least(greatest(ln(total / (1 + degree)::DOUBLE), 0.25), 1.5))) AS BIGINT)) AS w FROM edges JOIN d ON edges.object = d.object, n GROUP BY 1, 2)
SELECT src, dst, round(CAST(w AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY src) AS DOUBLE), 6) AS weight FROM w""")
def rank_graph(t: Tables) -> DataFrame:
    return graph.weighted(B.edges(t), B.entities(t)).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"""WITH {B.TRADE_SQL}, near AS (SELECT src, sum(n_nationkey / 100.0) AS s FROM (SELECT DISTINCT src, dst FROM trade WHERE weight > 500) JOIN nation ON dst = n_nationkey GROUP BY 1)
SELECT n_nationkey AS id, round(n_nationkey / 100.0 + least(0.4 * coalesce(s, 0), 0.5), 6)::DOUBLE AS rank FROM nation LEFT JOIN near ON src = n_nationkey""")
def project_to_symbols(t: Tables) -> DataFrame:
    ranks = t.nation.select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") / 100.0).alias("rank"))
    edges = B.trade(t).filter("weight > 500").select(F.col("src").alias("subject"), F.col("dst").alias("object"))
    return graph.project_ranks(ranks, edges).select("id", F.round("rank", 6).alias("rank"))


_DOWN = f"links AS (SELECT object AS src, subject AS dst FROM edges WHERE predicate IN ('belongs_to', 'imports') UNION ALL SELECT subject, object FROM edges WHERE predicate = 'calls')"


@query(f"""WITH RECURSIVE {B.EDGES_SQL}, {_DOWN}, walk AS (SELECT 'region:' || r_regionkey AS seed, 'region:' || r_regionkey AS node, 0 AS hops FROM region UNION SELECT seed, dst, hops + 1 FROM walk JOIN links ON node = src WHERE hops < 4)
SELECT seed, node, CAST(min(hops) AS INT) AS hops FROM walk GROUP BY 1, 2""")
def bounded_reach(t: Tables) -> DataFrame:
    """What each region reaches over the whole graph, from nations to parts."""
    e = B.edges(t)
    links = e.filter("predicate in ('belongs_to', 'imports')").select(F.col("object").alias("src"), F.col("subject").alias("dst")).union(e.filter("predicate = 'calls'").select("subject", "object"))
    return graph.reach(links, t.region.select(F.concat(F.lit("region:"), "r_regionkey").alias("id")), 4)


@query()
def walk_calls(t: Tables) -> DataFrame:
    """Order-dependent walk from the dearest urgent orders: tested against a plain walk."""
    e = B.edges(t).filter("predicate in ('calls', 'imports', 'belongs_to')").select(F.col("subject").alias("src"), F.col("object").alias("dst"), trust.provenance_rank(F.col("provenance")).alias("rank"))
    entries = t.orders.filter("o_orderpriority = '1-URGENT' and o_totalprice > 400000").select(F.concat(F.lit("orders:"), "o_orderkey").alias("id"))
    return graph.bounded_paths(e, entries, 3).select("entry", "ordinal", F.array_join("path", " > ").alias("path"))


@query("""WITH m AS (SELECT DISTINCT l_partkey AS g, 'nation:' || s_nationkey AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), p AS (SELECT a.m AS a, b.m AS b, CAST(count(*) * 2 AS BIGINT) AS weight FROM m a JOIN m b ON a.g = b.g AND a.m < b.m GROUP BY 1, 2) SELECT * FROM p""")
def pair_weights(t: Tables) -> DataFrame:
    m = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("g"), F.concat(F.lit("nation:"), "s_nationkey").alias("m"))
    return graph.pair_weights(m, "g", "m", 2)


@query()
def cluster_components(t: Tables) -> DataFrame:
    """Sequential greedy merge of the 25 nations by shared parts: tested against a plain merge."""
    m = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("g"), F.concat(F.lit("nation:"), "s_nationkey").alias("m"))
    regions = t.nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("name"), F.concat(F.lit("unit:"), "n_regionkey").alias("unit"))
    return graph.cluster(regions, graph.pair_weights(m, "g", "m", 2)).select("cluster", F.array_join("members", ",").alias("members"))


@query("""WITH orph AS (SELECT DISTINCT p_brand FROM part WHERE p_size > 40 EXCEPT SELECT p_brand FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_quantity > 45)
SELECT 'target_missing' AS kind, 'target_missing: ' || p_brand AS message FROM orph UNION ALL SELECT 'conflicting_writers', 'conflicting_writers: part:' || l_partkey FROM lineitem WHERE l_quantity > 40 GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 2""")
def drift_findings(t: Tables) -> DataFrame:
    declared = t.part.filter("p_size > 40").select("p_brand")
    actual = t.part.join(t.lineitem.filter("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey")).select("p_brand")
    one = derive.drift(declared, actual, "p_brand", "target_missing")
    w = derive.writer_groups(t.lineitem.filter("l_quantity > 40").select("l_partkey", F.col("l_suppkey").cast("string").alias("w")), "l_partkey", "w")
    return one.union(w.select(F.lit("conflicting_writers").alias("kind"), F.concat(F.lit("conflicting_writers: part:"), "l_partkey").alias("message")))


@query("""WITH cross_ AS (SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R')
SELECT x.n_name AS source, y.n_name AS target, 'unit:' || x.n_regionkey AS unit_a, 'unit:' || y.n_regionkey AS unit_b FROM cross_ JOIN nation x ON a = x.n_nationkey JOIN nation y ON b = y.n_nationkey WHERE x.n_regionkey <> y.n_regionkey""")
def boundary_crossings(t: Tables) -> DataFrame:
    rows = t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey", "l_suppkey").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("s_nationkey", "c_nationkey").distinct()
    x = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("source"), F.concat(F.lit("unit:"), "n_regionkey").alias("unit_a"))
    y = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("target"), F.concat(F.lit("unit:"), "n_regionkey").alias("unit_b"))
    return rows.join(x, "s_nationkey").join(y, "c_nationkey").filter("unit_a <> unit_b").select("source", "target", "unit_a", "unit_b")


@query("""WITH seed AS (SELECT 'customer:1' AS id UNION ALL SELECT 'orders:' || o_orderkey FROM orders WHERE o_custkey = 1), down AS (SELECT DISTINCT 'part:' || l_partkey AS id FROM lineitem WHERE 'orders:' || l_orderkey IN (SELECT id FROM seed))
SELECT id, 'seed' AS relation FROM seed UNION SELECT id, 'downstream' FROM down UNION SELECT 'customer:1', 'container' FROM orders WHERE o_custkey = 1""")
def compute_impact(t: Tables) -> DataFrame:
    contains = t.orders.select(F.concat(F.lit("customer:"), "o_custkey").alias("src"), F.concat(F.lit("orders:"), "o_orderkey").alias("dst"))
    calls = t.lineitem.select(F.concat(F.lit("orders:"), "l_orderkey").alias("src"), F.concat(F.lit("part:"), "l_partkey").alias("dst")).distinct()
    return graph.impact(t.customer.filter("c_custkey = 1").select(F.lit("customer:1").alias("id")), contains, calls, 1)


_FLOW = "f AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS a, l_suppkey + 1000000 AS b FROM lineitem)"


@query(f"WITH {_FLOW} SELECT b AS node, CAST(count(DISTINCT a) AS BIGINT) AS entries FROM f GROUP BY 1 HAVING count(DISTINCT a) > 1")
def flow_joins(t: Tables) -> DataFrame:
    e = t.lineitem.select(F.col("l_partkey").alias("from"), (F.col("l_suppkey") + 1000000).alias("to"))
    return derive.flow_joins(e)


@query(f"WITH {_FLOW} SELECT DISTINCT b AS node FROM f WHERE b NOT IN (SELECT a FROM f)")
def flow_exits(t: Tables) -> DataFrame:
    e = t.lineitem.select(F.col("l_partkey").alias("from"), (F.col("l_suppkey") + 1000000).alias("to"))
    return derive.flow_exits(e)



@query("""WITH r AS (SELECT conv_id, min(turn) AS s, max(turn) AS e, conv_id || 'a' AS id FROM conversations GROUP BY 1 UNION ALL SELECT conv_id, min(turn), min(turn) + 1, conv_id || 'b' FROM conversations GROUP BY 1)
SELECT c.conv_id, c.turn, coalesce(min_by(id, (e - s, id)), 'file') AS range_id FROM conversations c LEFT JOIN r ON c.conv_id = r.conv_id AND s <= turn AND turn <= e GROUP BY 1, 2""")
def innermost_range(t: Tables) -> DataFrame:
    g = t.conversations.groupBy("conv_id").agg(F.min("turn").alias("start"), F.max("turn").alias("m"))
    ranges = g.select("conv_id", "start", F.col("m").alias("end"), F.concat(F.col("conv_id").cast("string"), F.lit("a")).alias("range_id")).union(g.select("conv_id", "start", F.col("start") + 1, F.concat(F.col("conv_id").cast("string"), F.lit("b"))))
    points = t.conversations.select("conv_id", F.col("turn").alias("line"), F.concat_ws(":", "conv_id", "turn").alias("point_id"))
    return resolve.innermost(points, ranges, "conv_id", F.lit("file")).select("conv_id", F.col("line").alias("turn"), "range_id")


@query("SELECT p_brand AS file, min_by(p_name, (p_name <> 'default', length(p_name), p_name)) AS name FROM part GROUP BY 1")
def default_symbol_name(t: Tables) -> DataFrame:
    return resolve.default_symbol(t.part.select(F.col("p_brand").alias("file"), F.col("p_name").alias("name")))


@query("""SELECT l_orderkey AS call, CASE WHEN l_linenumber = 1 THEN 'symbol:' || l_partkey ELSE 'external:' || l_partkey END AS target, CASE WHEN l_linenumber = 1 THEN 0.99::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM
 (SELECT l_orderkey, l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2)""")
def definition_lookup(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("first"))
    defs = rows.filter("first = 1").select("l_orderkey", "l_partkey", F.concat(F.lit("symbol:"), "l_partkey").alias("d"))
    j = rows.join(defs, ["l_orderkey", "l_partkey"], "left")
    return j.select(F.col("l_orderkey").alias("call"), F.coalesce("d", F.concat(F.lit("external:"), "l_partkey")).alias("target"), F.when(F.col("d").isNull(), 0.8).otherwise(0.99).alias("confidence"))


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def relink_tests(t: Tables) -> DataFrame:
    changed = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(changed, "o_custkey", "left_semi").select("o_orderkey")
