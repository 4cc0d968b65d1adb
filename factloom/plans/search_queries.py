"""Retrieval, ranking, selection and scoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import scoring as S
from factloom.operators import derive, search, selection
from factloom.plans import binding as B
from factloom.plans.registry import Tables, query

_BM = """post AS (SELECT doc_id, len, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, len(l) AS len, unnest(l) AS term FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS l FROM documents)) GROUP BY 1, 2, 3)"""
_STATS = "st AS (SELECT count(*) AS n, avg(len) AS mean FROM (SELECT DISTINCT doc_id, len FROM post))"


def _bm25_sql(terms: list[str]) -> str:
    inside = ", ".join(f"'{x}'" for x in terms)
    return f"""WITH {_BM}, {_STATS}, df AS (SELECT term, count(*) AS df FROM post WHERE term IN ({inside}) GROUP BY 1)
SELECT doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM post JOIN df USING (term), st GROUP BY 1 HAVING count(*) = {len(terms)}"""


def _bm25(t: Tables, terms: list[str]) -> DataFrame:
    index = search.postings(t.documents, "doc_id", F.col("text"))
    stats = index.select("doc_id", "len").distinct().agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()  # one row
    return search.bm25(index, "doc_id", stats["n"], stats["mean"], terms)


@query(_bm25_sql(["with", "are"]))
def search_documents(t: Tables) -> DataFrame:
    return _bm25(t, ["with", "are"]).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT * FROM ({_bm25_sql(['for', 'this'])}) ORDER BY score DESC, doc_id LIMIT 20")
def search_top(t: Tables) -> DataFrame:
    return _bm25(t, ["for", "this"]).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query("SELECT p_partkey, p_name, CASE WHEN contains(lower(p_name), 'a') THEN 0 ELSE 1 END AS tier FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_type), 'a') ORDER BY tier, length(p_name), p_partkey LIMIT 15")
def like_search(t: Tables) -> DataFrame:
    return search.like_search(t.part, "p_partkey", "p_name", "p_type", "A", 15)


@query("SELECT DISTINCT doc_id FROM documents, (SELECT 1) WHERE len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: starts_with(x, 'th'))) > 0 AND len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: starts_with(x, 'an'))) > 0")
def prefix_search(t: Tables) -> DataFrame:
    return search.prefix_search(search.postings(t.documents, "doc_id", F.col("text")), "doc_id", "Th, AN").distinct()


@query("""WITH s AS (SELECT c_custkey AS id, c_acctbal AS score FROM customer), o AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1), top AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 30)
SELECT s.id, round(CASE WHEN s.id IN (SELECT id FROM top) THEN 0.2 * score + 5 * coalesce(n, 0) ELSE score END, 6) AS score FROM s LEFT JOIN o ON s.id = o.id""")
def rerank(t: Tables) -> DataFrame:
    """Customers by balance, the best thirty ranked again by their orders."""
    outside = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").cast("double").alias("score"))
    return search.rerank(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score")), outside).select("id", F.round("score", 6).alias("score"))


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS INT) AS position, round((12 - (row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1)) / 12.0, 6)::DOUBLE AS score FROM part QUALIFY position < 12")
def position_scores(t: Tables) -> DataFrame:
    return search.position_scores(t.part, [F.desc("p_retailprice"), F.col("p_partkey")], 12).select("p_partkey", "position", F.round("score", 6).alias("score"))


_CAND = """c AS (SELECT p_partkey AS id, 0.6 AS score, 'name' AS reason, 1 AS source, p_partkey AS position FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, 2.0, 'explicit', 0, p_partkey FROM part WHERE p_partkey % 40 = 0
 UNION ALL SELECT DISTINCT l_partkey, 1.0, 'caller', 2, l_partkey FROM lineitem WHERE l_quantity > 45)"""


@query(f"WITH {_CAND} SELECT id, CAST(arg_min(score, source * 10000000 + position) AS DOUBLE) AS score, arg_min(reason, source * 10000000 + position) AS reason FROM c GROUP BY 1 ORDER BY score DESC, id LIMIT 48")
def candidate_fusion(t: Tables) -> DataFrame:
    row = lambda df, key, score, reason, source: df.select(F.col(key).alias("id"), F.lit(score).alias("score"), F.lit(reason).alias("reason"), F.lit(source).alias("source"), F.col(key).alias("position"))
    every = row(t.part.filter("p_size > 25"), "p_partkey", 0.6, "name", 1).union(row(t.part.filter("p_partkey % 40 = 0"), "p_partkey", 2.0, "explicit", 0)).union(row(t.lineitem.filter("l_quantity > 45").select("l_partkey").distinct(), "l_partkey", 1.0, "caller", 2))
    return search.fuse(every, 48)


def _fold_sql(order: str, where: str, budget: str, start: str = "0") -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY {order}) AS k FROM candidates WHERE {where}),
walk AS (SELECT r.request, 0::BIGINT AS k, coalesce({start}, 0)::BIGINT AS spent, ''::VARCHAR AS ids FROM (SELECT DISTINCT request FROM candidates) r
  UNION ALL SELECT w.request, r.k, CASE WHEN w.spent + r.cost <= {budget} THEN w.spent + r.cost ELSE w.spent END, CASE WHEN w.spent + r.cost <= {budget} THEN w.ids || ',' || r.id ELSE w.ids END FROM walk w JOIN ranked r ON w.request = r.request AND r.k = w.k + 1)"""


_MUST = "(SELECT sum(cost) FROM candidates q WHERE q.request = r.request AND required)"
_MUST_IDS = "must AS (SELECT request, string_agg(CAST(id AS VARCHAR), ',' ORDER BY {order}) AS m FROM candidates WHERE required GROUP BY 1)"


def _select_sql(order: str) -> str:
    return f"""WITH RECURSIVE {B.CANDIDATES_SQL}, {_fold_sql(order, 'NOT required', '12000', _MUST)}, {_MUST_IDS.format(order=order)}
SELECT w.request, ltrim(coalesce(m, '') || ids, ',') AS ids, spent FROM walk w LEFT JOIN must USING (request) WHERE k = (SELECT max(k) FROM walk v WHERE v.request = w.request)"""


@query(_select_sql("-(value / greatest(cost, 1)), position, CAST(id AS VARCHAR)"))
def select_with_budget(t: Tables) -> DataFrame:
    return selection.select_with_budget(B.candidates(t), ["request"], 12000, 12000).select("request", F.array_join("ids", ",").alias("ids"), "spent")


@query(_select_sql("position"))
def select_in_order(t: Tables) -> DataFrame:
    return selection.select_with_budget(B.candidates(t), ["request"], 12000, 12000, by_density=False).select("request", F.array_join("ids", ",").alias("ids"), "spent")


@query(f"""WITH RECURSIVE {B.CANDIDATES_SQL}, caps AS (SELECT * FROM (VALUES ('en', 3000), ('de', 1500), ('fr', 1000)) v(kind, cap)), ranked AS (SELECT c.*, coalesce(cap, 2147483647) AS cap, row_number() OVER (PARTITION BY request, c.kind ORDER BY position) AS k FROM candidates c LEFT JOIN caps ON c.kind = caps.kind),
walk AS (SELECT DISTINCT request, kind, 0::BIGINT AS k, 0::BIGINT AS spent, ''::VARCHAR AS ids FROM candidates UNION ALL
 SELECT w.request, w.kind, r.k, CASE WHEN w.spent + r.cost <= cap THEN w.spent + r.cost ELSE w.spent END, CASE WHEN w.spent + r.cost <= cap THEN w.ids || ',' || r.id ELSE w.ids END FROM walk w JOIN ranked r ON w.request = r.request AND w.kind = r.kind AND r.k = w.k + 1)
SELECT request, kind, ltrim(ids, ',') AS ids, spent FROM walk w WHERE k = (SELECT max(k) FROM walk v WHERE v.request = w.request AND v.kind = w.kind)""")
def enforce_quotas(t: Tables) -> DataFrame:
    return selection.enforce_quotas(B.candidates(t), ["request"], 10_000, {"en": 0.30, "de": 0.15, "fr": 0.10}).select("request", "kind", F.array_join("ids", ",").alias("ids"), "spent")


@query()
def mmr_diversify(t: Tables) -> DataFrame:
    """Sequential choice: tested against a plain version."""
    c = B.candidates(t).select("request", "id", (F.col("value") / 1000).alias("score"), F.col("kind").alias("likeness"))
    return selection.mmr_diversify(c, ["request"], 10)


@query(f"""WITH RECURSIVE {B.CANDIDATES_SQL}, s AS (SELECT request, kind AS name, length(kind) + CASE WHEN kind = 'en' THEN 8 ELSE 0 END AS priority, min(position) AS position, sum(cost) AS cost FROM candidates GROUP BY request, kind),
tot AS (SELECT request, sum(cost) AS total FROM s GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY priority, position) AS k FROM s),
walk AS (SELECT request, 0::BIGINT AS k, total::BIGINT AS total, ''::VARCHAR AS kept FROM tot UNION ALL SELECT w.request, r.k, CASE WHEN w.total > 40000 AND priority < 9 THEN w.total - r.cost::BIGINT ELSE w.total END, CASE WHEN w.total > 40000 AND priority < 9 THEN w.kept ELSE w.kept || ',' || r.name END FROM walk w JOIN r ON w.request = r.request AND r.k = w.k + 1)
SELECT request, ltrim(kept, ',') AS kept, total FROM walk w WHERE k = (SELECT max(k) FROM walk v WHERE v.request = w.request)""")
def drop_ladder(t: Tables) -> DataFrame:
    c = B.candidates(t).groupBy("request", F.col("kind").alias("name")).agg(F.min("position").alias("position"), F.sum("cost").alias("cost"))
    c = c.withColumn("priority", F.char_length("name") + F.when(F.col("name") == "en", 8).otherwise(0))
    return selection.drop_ladder(c, ["request"], 40_000).select("request", F.array_join("kept", ",").alias("kept"), "total")


_FACTS = """f AS (SELECT s_suppkey, s_acctbal, count(l_orderkey) AS n, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_linestatus = 'O') AS o, count(DISTINCT l_partkey) AS parts FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1, 2), m AS (SELECT max(n) AS most FROM f)"""


@query(f"""WITH {_FACTS} SELECT s_suppkey, round(CASE WHEN s_acctbal > 0 THEN 0.3 * (r / greatest(n, 1)::DOUBLE) + 0.2 * (n / most::DOUBLE) ELSE 0.5 * (n / most::DOUBLE) END + 0.15 * (parts / greatest(n, 1)::DOUBLE) + 0.1 * 1.0 + 0.1 * 1.0 + 0.1 * (o / greatest(n, 1)::DOUBLE) + 0.05 * 0.5
 + 0.05 * CASE WHEN s_acctbal < 0 AND NOT r > 0 AND NOT o > n THEN 0.1 ELSE 1.0 END, 6)::DOUBLE AS score FROM f, m""")
def importance_blend(t: Tables) -> DataFrame:
    """Suppliers by their share of lines, of returns, of open lines and of different parts; those in debt have no task."""
    count = lambda c: F.sum(F.coalesce(c.cast("int"), F.lit(0)))
    f = t.supplier.join(t.lineitem, F.col("s_suppkey") == F.col("l_suppkey"), "left").groupBy("s_suppkey", "s_acctbal").agg(F.count("l_orderkey").alias("n"), count(F.col("l_returnflag") == "R").alias("r"), count(F.col("l_linestatus") == "O").alias("o"), F.count_distinct("l_partkey").alias("parts"))
    f = f.join(F.broadcast(f.agg(F.max("n").alias("most"))))  # one row
    share = lambda c: F.col(c) / F.greatest("n", F.lit(1)).cast("double")
    parts = {"task_ppr": share("r"), "global_ppr": F.col("n") / F.col("most"), "lexical": share("parts"), "semantic": F.lit(1.0), "confidence": F.lit(1.0), "criticality": share("o"), "change_risk": F.lit(0.5), "novelty": S.novelty(F.col("s_acctbal") < 0, F.col("r") > 0, F.col("o") > F.col("n"))}
    return f.select("s_suppkey", F.round(F.when(F.col("s_acctbal") > 0, S.final_importance(parts)).otherwise(S.final_importance(parts, has_task=False)), 6).alias("score"))


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS p FROM pages), f AS (SELECT page_id,
 CASE WHEN list_has_any(regexp_split_to_array(lower(p), '[^a-z0-9]+'), ['utils', 'logger', 'errors', 'common', 'types', 'helpers', 'config']) THEN 0.5 ELSE 1 END * CASE WHEN regexp_matches(lower(p), '(^|[/._-])(test|tests|spec|specs|__tests__)([/._-]|$)') THEN 0.5 ELSE 1 END
 * CASE WHEN regexp_matches(lower(p), '(^|/)(generated|gen|dist|build)/|\\.(generated|gen|min)\\.|_pb2?\\.') THEN 0.5 ELSE 1 END * CASE WHEN regexp_matches(lower(p), '(^|/)(vendor|vendored|third_party|node_modules|site-packages)/') THEN 0.5 ELSE 1 END * CASE WHEN page_id % 30 > 20 THEN 0.5 ELSE 1 END AS f FROM u)
SELECT page_id, round(least(greatest(0.9 * f, 0.25), 1.25), 6)::DOUBLE AS specificity FROM f""")
def architectural_specificity(t: Tables) -> DataFrame:
    p = F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1)
    return t.pages.select("page_id", F.round(S.architectural_specificity(F.lit(0.9), p, p, F.col("page_id") % 30), 6).alias("specificity"))


@query("""WITH s AS (SELECT lang AS layer, count(*) FILTER (quality = 1 AND toxic = 0) AS hit, count(*) FILTER (quality = 1) AS found, count(*) FILTER (toxic = 0) AS wanted, sum(n_chars) AS chars FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT layer, round(CASE WHEN found = 0 THEN 1.0 ELSE hit / found::DOUBLE END, 6) AS precision, round(CASE WHEN wanted = 0 THEN 1.0 ELSE hit / wanted::DOUBLE END, 6) AS recall,
round(CASE WHEN hit = 0 THEN 0.0 ELSE 5.0 * (hit / found::DOUBLE) * (hit / wanted::DOUBLE) / (4 * (hit / found::DOUBLE) + hit / wanted::DOUBLE) END, 6) AS f2, round(1000.0 * hit / (chars / 4)::DOUBLE, 6) AS density FROM s""")
def layer_scores(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    s = rows.groupBy(F.col("lang").alias("layer")).agg(n((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("hit"), n(F.col("quality") == 1).alias("found"), n(F.col("toxic") == 0).alias("wanted"), F.sum("n_chars").alias("chars"))
    p, r = S.share_or_one(F.col("hit"), F.col("found")), S.share_or_one(F.col("hit"), F.col("wanted"))
    return s.select("layer", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(S.f2_score(p, r), 6).alias("f2"), F.round(S.token_density(F.col("hit"), F.col("chars") / 4), 6).alias("density"))


@query("""WITH a AS (SELECT c_mktsegment AS section, avg(c_acctbal) AS v FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1), b AS (SELECT c_mktsegment AS section, avg(c_acctbal) AS v FROM customer WHERE c_custkey % 2 = 1 AND c_mktsegment <> 'BUILDING' GROUP BY 1)
SELECT coalesce(a.section, b.section) AS section, round(a.v, 6) AS before, round(b.v, 6) AS after, round(b.v - a.v, 6) AS delta, CASE WHEN b.v - a.v >= 0 THEN 'NoOverfit' WHEN b.v - a.v >= -0.05 THEN 'Borderline' WHEN b.v - a.v IS NULL THEN NULL ELSE 'Overfit' END AS verdict FROM a FULL JOIN b ON a.section = b.section""")
def compare_runs(t: Tables) -> DataFrame:
    run = lambda c: t.customer.filter(c).groupBy(F.col("c_mktsegment").alias("section")).agg(F.avg("c_acctbal").alias("v"))
    both = derive.compare_runs(run("c_custkey % 2 = 0"), run("c_custkey % 2 = 1 and c_mktsegment <> 'BUILDING'"), "section", "v")
    verdict = F.when(F.col("delta").isNotNull(), S.holdout_verdict(F.col("delta")))
    return both.select("section", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round("delta", 6).alias("delta"), verdict.alias("verdict"))


@query("SELECT count(*) FILTER (toxic = 1) = 0 AS passed, CAST(CASE WHEN count(*) FILTER (toxic = 1) > 0 THEN 3 WHEN count(*) FILTER (quality = 0) > 0 THEN 1 ELSE -1 END AS INT) AS worst FROM labels")
def ci_gate(t: Tables) -> DataFrame:
    sev = F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "low")
    return derive.ci_gate(t.labels.select(sev.alias("severity")).filter("severity is not null"))


@query("SELECT request, CAST(count(*) AS BIGINT) AS candidates, round(least(CASE WHEN count(*) < 500 THEN 0.20 WHEN count(*) < 5000 THEN 0.30 ELSE 0.40 END + least(floor(sum(cost) / 2000), 5) / 100, 0.5), 6)::DOUBLE AS share FROM (SELECT doc_id // 100 AS request, CAST(ceil(n_chars / 4.0) AS BIGINT) AS cost FROM documents) GROUP BY 1")
def adaptive_budget(t: Tables) -> DataFrame:
    g = B.candidates(t).groupBy("request").agg(F.count("*").alias("candidates"), F.sum("cost").alias("cost"))
    return g.select("request", "candidates", F.round(S.adaptive_budget(F.col("candidates"), F.col("cost")), 6).alias("share"))


@query("SELECT item_id, CAST(count(*) FILTER (contains(d.text, b.text)) AS BIGINT) AS holders FROM benchmark b, documents d GROUP BY 1")
def score_tasks(t: Tables) -> DataFrame:
    """How many documents hold each benchmark passage whole."""
    items = t.benchmark.select("item_id", F.col("text").alias("passage"), F.left("text", F.lit(40)).alias("k"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("passage")), F.lit(0)).alias("bytes")).first()
    docs = t.documents.select("doc_id", "text")
    if size["n"] <= 1000 and size["bytes"] <= 4 << 20:  # a stated query set of proven size
        listed = F.broadcast(items.agg(F.collect_list(F.struct("item_id", "passage")).alias("q")))
        hits = docs.join(listed).select("doc_id", F.explode(F.filter("q", lambda x: F.contains(F.col("text"), x["passage"]))).alias("x")).select("doc_id", "x.item_id")
    else:
        grams = docs.select("doc_id", "text", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("text") - 39, F.lit(1))), lambda i: F.substring("text", i, F.lit(40))))).alias("k"))
        hits = grams.join(items, "k").filter(F.contains("text", "passage")).select("doc_id", "item_id")
    n = hits.groupBy("item_id").agg(F.count("*").alias("n"))
    return t.benchmark.select("item_id").join(n, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).cast("long").alias("holders"))
