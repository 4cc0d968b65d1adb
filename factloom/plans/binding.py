"""The driver's tables as a property graph, a file registry, traces and candidates; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.plans.registry import Tables


def _id(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


_NODES = [
    ("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"),
    ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("orders", "o_orderkey", "o_orderstatus"),
]


def entities(t: Tables) -> DataFrame:
    """id, kind, name."""
    out = None
    for table, key, name in _NODES:
        rows = getattr(t, table).select(_id(table, key).alias("id"), F.lit(table).alias("kind"), F.col(name).alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return out


ENTITIES_SQL = "entities AS (" + " UNION ALL ".join(f"SELECT '{t}:' || CAST({k} AS VARCHAR) AS id, '{t}' AS kind, {n} AS name FROM {t}" for t, k, n in _NODES) + ")"


def edges(t: Tables) -> DataFrame:
    """subject, predicate, object, provenance, confidence; the lines of an order and a part are one edge of the best provenance."""
    fact = lambda df, s, p, o, prov: df.select(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), prov.alias("provenance"), F.lit(1.0).alias("confidence"))
    status = F.when(F.col("o_orderstatus") == "F", "RESOLVED").when(F.col("o_orderstatus") == "O", "EXTRACTED").otherwise("INFERRED")
    out = fact(t.nation, _id("nation", "n_nationkey"), "belongs_to", _id("region", "n_regionkey"), F.lit("RESOLVED"))
    out = out.unionByName(fact(t.customer, _id("customer", "c_custkey"), "belongs_to", _id("nation", "c_nationkey"), F.lit("DECLARED")))
    out = out.unionByName(fact(t.supplier, _id("supplier", "s_suppkey"), "belongs_to", _id("nation", "s_nationkey"), F.lit("DECLARED")))
    out = out.unionByName(fact(t.orders, _id("orders", "o_orderkey"), "imports", _id("customer", "o_custkey"), status))
    rank = F.when(F.col("l_returnflag") == "R", 4).when(F.col("l_returnflag") == "A", 3).otherwise(1)
    lines = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.max(rank).alias("rank"), F.max(1 - F.col("l_discount") - F.col("l_tax")).alias("confidence"))
    prov = F.when(F.col("rank") == 4, "RESOLVED").when(F.col("rank") == 3, "EXTRACTED").otherwise("INFERRED")
    return out.unionByName(lines.select(_id("orders", "l_orderkey").alias("subject"), F.lit("calls").alias("predicate"), _id("part", "l_partkey").alias("object"), prov.alias("provenance"), "confidence"))


EDGES_SQL = """edges AS (
  SELECT 'nation:' || n_nationkey AS subject, 'belongs_to' AS predicate, 'region:' || n_regionkey AS object, 'RESOLVED' AS provenance, 1.0::DOUBLE AS confidence FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'belongs_to', 'nation:' || c_nationkey, 'DECLARED', 1.0 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'belongs_to', 'nation:' || s_nationkey, 'DECLARED', 1.0 FROM supplier
  UNION ALL SELECT 'orders:' || o_orderkey, 'imports', 'customer:' || o_custkey, CASE o_orderstatus WHEN 'F' THEN 'RESOLVED' WHEN 'O' THEN 'EXTRACTED' ELSE 'INFERRED' END, 1.0 FROM orders
  UNION ALL SELECT 'orders:' || l_orderkey, 'calls', 'part:' || l_partkey, CASE max(CASE l_returnflag WHEN 'R' THEN 4 WHEN 'A' THEN 3 ELSE 1 END) WHEN 4 THEN 'RESOLVED' WHEN 3 THEN 'EXTRACTED' ELSE 'INFERRED' END, max(1 - l_discount - l_tax)
    FROM lineitem GROUP BY l_orderkey, l_partkey
)"""


def trade(t: Tables) -> DataFrame:
    """subject, object (nations), weight: quantity that suppliers of one nation sent to customers of another."""
    rows = t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity").join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.filter("s_nationkey <> c_nationkey").groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.sum("l_quantity").alias("weight"))


TRADE_SQL = """trade AS (
  SELECT s_nationkey AS src, c_nationkey AS dst, sum(l_quantity) AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2
)"""


def files(t: Tables) -> DataFrame:
    """path, digest, language, size of the indexed registry."""
    return t.documents.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("digest"), F.col("lang").alias("language"), F.col("n_chars").alias("size"), "doc_id")


def new_files(t: Tables) -> DataFrame:
    """The registry after a change: every seventh text altered, every eleventh file gone, every thirteenth added."""
    old = files(t)
    kept = old.filter("doc_id % 11 <> 0").withColumn("digest", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("digest", F.lit("+")), 256)).otherwise(F.col("digest")))
    more = old.filter("doc_id % 13 = 0").withColumn("path", F.concat("path", F.lit(".new")))
    return kept.unionByName(more)


FILES_SQL = """files AS (SELECT source || '/' || doc_id AS path, sha256(text) AS digest, lang AS language, n_chars AS size, doc_id FROM documents),
new_files AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN sha256(digest || '+') ELSE digest END AS digest, language, size, doc_id FROM files WHERE doc_id % 11 <> 0
  UNION ALL SELECT path || '.new', digest, language, size, doc_id FROM files WHERE doc_id % 13 = 0)"""


def transitions(t: Tables) -> DataFrame:
    """Event spans: trace (user and day), span, parent span, service, latency and error; the parent is the event before."""
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = t.events.select(F.concat_ws("/", F.col("user_id").cast("string"), day).alias("trace"), F.col("event_id").cast("string").alias("span"), F.col("event_type").alias("service"), F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("error"), "ts", "event_id")
    return rows.withColumn("parent", F.lag("span").over(Window.partitionBy("trace").orderBy("ts", "event_id")))


SPANS_SQL = """spans AS (
  SELECT *, lag(span) OVER w AS parent, lag(service) OVER w AS parent_service, lag(user_id) OVER w AS parent_user FROM (
    SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS trace, CAST(event_id AS VARCHAR) AS span, event_type AS service, value AS latency_ms, event_type = 'error' AS error, ts, event_id, user_id FROM events)
  WINDOW w AS (PARTITION BY trace ORDER BY ts, event_id)
)"""


def candidates(t: Tables) -> DataFrame:
    """Documents as candidates of a request (a group of 100 ids): id, cost, value, position, kind, required."""
    cost = F.ceil(F.col("n_chars") / 4).cast("long")
    return t.documents.select(F.floor(F.col("doc_id") / 100).cast("long").alias("request"), F.col("doc_id").alias("id"), cost.alias("cost"), (F.lit(1000.0) - (F.col("doc_id") * 37) % 997).alias("value"), F.col("doc_id").alias("position"), F.col("lang").alias("kind"), (F.col("doc_id") % 50 == 0).alias("required"))


CANDIDATES_SQL = "candidates AS (SELECT doc_id // 100 AS request, doc_id AS id, CAST(ceil(n_chars / 4.0) AS BIGINT) AS cost, 1000.0::DOUBLE - (doc_id * 37) % 997 AS value, doc_id AS position, lang AS kind, doc_id % 50 = 0 AS required FROM documents)"


def ranked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Add the position from 1 in a global order: a range partition, a sort within it and the counts of the partitions before."""
    from factloom.session import cut, shuffle_partitions

    placed = cut(rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("__mid", F.monotonically_increasing_id()))
    part = F.shiftright("__mid", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))  # one row a partition
    before = counts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = placed.withColumn("__part", part).join(F.broadcast(before), "__part")
    return own.withColumn(name, (F.col("__before") + F.col("__mid") - F.shiftleft("__part", 33) + 1).cast("int")).drop("__mid", "__part", "__before")


def sources(t: Tables) -> DataFrame:
    """path, language, content: a source file for each document, by its language and with its facts as names."""
    i, n, s = F.col("doc_id").cast("string"), F.col("n_chars").cast("string"), F.col("source")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    python = text("import os\ndef run_", i, "(x):\n    try:\n        return send('orders-dlq-", s, "')\n    except ValueError:\n        Circuit", n, ".trip()\n    return os.environ[\"KEY_EN\"]\n")
    go = text("package m\nfunc (s *Store) Save", i, "(x int) {\n\tpanic(\"state-", n, "\")\n\tos.Getenv(\"KEY_FR\")\n}\n")
    rust = text("pub fn load_", i, "(x: u32) -> u32 {\n    let y = x.checked_add(", n, ").expect(\"dead-letter ", n, "\");\n    std::env::var(\"KEY_DE\");\n    y\n}\n")
    script = text("export async function pull_", i, "(q) {\n  const circuit_open = q.state\n  try { go(q) } catch (e) { push(\"DLQ\") }\n  go(process.env.KEY_", F.upper("lang"), ")\n}\n")
    lang = F.col("lang")
    language = F.when(lang == "en", "python").when(lang == "fr", "go").when(lang == "de", "rust").otherwise("typescript")
    content = F.when(lang == "en", python).when(lang == "fr", go).when(lang == "de", rust).otherwise(script)
    return t.documents.select(F.concat(F.lit("src/"), s, F.lit("/m"), i).alias("path"), language.alias("language"), content.alias("content"))
