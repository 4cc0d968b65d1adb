"""Scalar text functions over documents, pages, conversations and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import scoring as S
from factloom.functions import text as X
from factloom.plans.registry import Tables, query

_A = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


def _terms_sql(c: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_split_to_array({_A.format(c)}, '[^\\pL\\pN]+'), lambda x: strlen(x) >= 3 AND x NOT IN ({_STOP}))))"


def _slug_sql(c: str) -> str:
    return f"CASE WHEN rtrim(regexp_replace({_A.format(c)}, '[^a-z0-9./]+', '-', 'g'), '-') = '' THEN 'unnamed' ELSE rtrim(regexp_replace({_A.format(c)}, '[^a-z0-9./]+', '-', 'g'), '-') END"


@query(f"SELECT doc_id, array_to_string({_terms_sql('text')}, ' ') AS terms FROM documents")
def terms(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(X.terms(F.col("text")), " ").alias("terms"))


_STEMS = (
    "list_sort(list_distinct(list_filter([w, CASE WHEN w LIKE '%ation' THEN left(w, length(w) - 5) || 'e' END, CASE WHEN w LIKE '%ations' THEN left(w, length(w) - 6) || 'e' END, "
    + ", ".join(f"CASE WHEN w LIKE '%{s}' AND strlen(w) - {len(s)} >= 4 THEN left(w, length(w) - {len(s)}) END, CASE WHEN w LIKE '%{s}' AND length(w) > {len(s)} AND strlen(left(w, length(w) - {len(s) + 1})) >= 3 THEN left(w, length(w) - {len(s) + 1}) END" for s in X.SUFFIXES)
    + "], lambda x: x IS NOT NULL)))"
)


@query(f"WITH w AS (SELECT DISTINCT unnest({_terms_sql('p_name')}) AS w FROM part UNION SELECT DISTINCT unnest({_terms_sql('text')}) FROM documents) SELECT w AS term, CASE WHEN strlen(w) < 5 THEN w ELSE array_to_string({_STEMS}, ' ') END AS stems FROM w")
def stem_variants(t: Tables) -> DataFrame:
    words = t.part.select(F.explode(X.terms(F.col("p_name"))).alias("term")).union(t.documents.select(F.explode(X.terms(F.col("text"))))).distinct()
    return words.select("term", F.array_join(X.stem_variants(F.col("term")), " ").alias("stems"))


@query(f"""WITH p AS (SELECT p_partkey, {_terms_sql("p_name || ' ' || p_type")} AS n, {_terms_sql('p_brand')} AS a FROM part), g AS (SELECT unnest(['steel', 'brand', 'polished', 'econ']) AS g)
SELECT p_partkey, CAST(sum(2 * CAST(len(list_filter(n, lambda x: CASE WHEN strlen(g) < 4 OR strlen(x) < 4 THEN g = x ELSE starts_with(g, x) OR starts_with(x, g) END)) > 0 AS INT)
 + CAST(len(list_filter(a, lambda x: CASE WHEN strlen(g) < 4 OR strlen(x) < 4 THEN g = x ELSE starts_with(g, x) OR starts_with(x, g) END)) > 0 AS INT)) AS DOUBLE) AS score FROM p, g GROUP BY 1""")
def entity_similarity(t: Tables) -> DataFrame:
    goal = F.array(*[F.lit(x) for x in ("steel", "brand", "polished", "econ")])
    return t.part.select("p_partkey", X.similarity(goal, F.concat_ws(" ", "p_name", "p_type"), F.col("p_brand")).alias("score"))


@query(f"SELECT page_id, {_slug_sql('url')} AS slug, 'repo://' || 'web' || '/page/' || {_slug_sql('url')} AS id FROM pages")
def entity_ids(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.sanitize_key(F.col("url")).alias("slug"), X.entity_id(F.lit("web"), F.lit("page"), F.col("url")).alias("id"))


@query("SELECT doc_id, array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CASE WHEN h < '80' AND regexp_matches(chr(CAST('0x' || h AS INT)), '^[A-Za-z0-9/._-]$') THEN chr(CAST('0x' || h AS INT)) ELSE '%' || h END), '') AS encoded, text AS decoded FROM documents")
def percent_encoding(t: Tables) -> DataFrame:
    enc = X.encode_component(F.col("text"))
    return t.documents.select("doc_id", enc.alias("encoded")).select("doc_id", "encoded", X.decode_component(F.col("encoded")).alias("decoded"))


@query("SELECT p_partkey, left(sha256(p_name || '|' || p_brand || '|' || p_size || '|'), 12) AS id FROM part")
def content_ids(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.content_id(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("id"))


@query(f"SELECT page_id, 'page' AS kind, regexp_extract('repo://web/page/' || {_slug_sql('url')}, '([^/]+)$', 1) AS name FROM pages")
def normalize_ids(t: Tables) -> DataFrame:
    n = X.normalize_id(X.entity_id(F.lit("web"), F.lit("page"), F.col("url")))
    return t.pages.select("page_id", n["kind"].alias("kind"), n["name"].alias("name"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def estimate_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 400 THEN text WHEN contains(left(text, 400), chr(10)) AND (length(left(text, 400)) - instr(reverse(left(text, 400)), chr(10))) * 2 >= 400
 THEN left(text, length(left(text, 400)) - instr(reverse(left(text, 400)), chr(10))) ELSE left(text, 400) END AS cut FROM documents""")
def truncate_to_budget(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.truncate_to_budget(F.col("text"), 100).alias("cut"))


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ') AS line, CASE WHEN regexp_extract(text, '^[^.]*\\.') = '' THEN text ELSE regexp_extract(text, '^[^.]*\\.') END AS sentence FROM documents")
def collapse_and_first_sentence(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.collapse(F.col("text")).alias("line"), X.first_sentence(F.col("text")).alias("sentence"))


_SECRET = " OR ".join([f"contains(k, '{h}')" for h in X.SECRET_KEYS] + [f"starts_with(v, '{h}')" for h in X.SECRET_VALUES])
_PAIR = r"""unnest(regexp_extract_all(text, '[A-Za-z_]+ = "[^"\n]*"'))"""


@query(rf"""WITH p AS (SELECT doc_id, {_PAIR} AS m FROM documents), q AS (SELECT doc_id, m, lower(regexp_extract(m, '^([A-Za-z_]+)', 1)) AS k, regexp_extract(m, '"([^"]*)"', 1) AS v FROM p)
SELECT doc_id, k AS key, ({_SECRET}) AS secret, CASE WHEN v = '' THEN v WHEN strlen(v) <= 8 THEN '***REDACTED***' ELSE left(v, 2) || '…***REDACTED***' END AS value FROM q""")
def redact_secrets(t: Tables) -> DataFrame:
    found = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r'[A-Za-z_]+ = "[^"\n]*"'), F.lit(0))).alias("m"))
    rows = found.select("doc_id", F.lower(F.regexp_extract("m", "^([A-Za-z_]+)", 1)).alias("key"), F.regexp_extract("m", '"([^"]*)"', 1).alias("v"))
    return rows.select("doc_id", "key", X.classify_secret(F.col("key"), F.col("v")).alias("secret"), X.redact_value(F.col("v")).alias("value"))


@query(r"SELECT conv_id, turn, regexp_matches(text, '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)') AS hit FROM conversations")
def keyword_scan(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.has_keyword(F.col("text"), "the").alias("hit"))


_TABLE = r"""(?i)\b(?:from|into|update|join|table)\s+["'`]?([A-Za-z_][A-Za-z0-9_.]*)"""


@query(rf"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)^\s*(insert|update|delete|replace|merge|create|drop|alter)\b') THEN 'write' WHEN regexp_matches(text, '(?i)^\s*select\b') THEN 'read' ELSE 'query' END AS op,
nullif(regexp_extract(text, '{_TABLE.replace("'", "''")}', 1), '') AS "table" FROM documents UNION ALL SELECT -1 - page_id, 'read', regexp_extract(url, '^[a-z]+://([a-z]+)', 1) FROM pages""")
def sql_sniffing(t: Tables) -> DataFrame:
    """Documents as they are, and a statement over each page's host."""
    statements = t.pages.select((-1 - F.col("page_id")).alias("doc_id"), F.concat(F.lit(" SELECT a, b\n FROM "), F.regexp_extract("url", "^[a-z]+://([a-z]+)", 1), F.lit(" WHERE c = 1")).alias("text"))
    x = X.sql_op_table(F.col("text"))
    return t.documents.select("doc_id", "text").union(statements).select("doc_id", x["op"].alias("op"), x["table"].alias("table"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, list_extract(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1), '/'), 1) AS section FROM pages")
def url_parts(t: Tables) -> DataFrame:
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]+/?([^?#]*)", 1)
    return t.pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.element_at(F.split(path, "/"), 1).alias("section"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS BIGINT) AS links FROM pages")
def html_links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("links"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_attributes(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k"))


@query("SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') AND position('STEEL' IN p_type) > 0 THEN true ELSE false END AS hit, contains(p_name, left(p_name, 3)) AS own FROM part")
def item_matching(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.item_matches(F.col("p_type"), F.lit("STEEL")).alias("hit"), X.item_matches(F.col("p_name"), F.left("p_name", F.lit(3))).alias("own"))


@query("SELECT conv_id, list_filter(list(role ORDER BY turn), lambda x: x = 'assistant') <> [] AND list_position(list(role ORDER BY turn), 'user') < len(list(role ORDER BY turn)) - list_position(list_reverse(list(role ORDER BY turn)), 'assistant') + 1 AS matched FROM conversations GROUP BY 1")
def chain_matching(t: Tables) -> DataFrame:
    rows = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"))
    roles = F.transform("r", lambda x: x["role"])
    return rows.select("conv_id", X.chain_matches(roles, F.array(F.lit("user"), F.lit("assistant"))).alias("matched"))


_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"


@query("WITH g AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, e), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS score FROM embeddings, g")
def embedding_scores(t: Tables) -> DataFrame:
    goal = F.broadcast(t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("e")))  # one row
    return t.embeddings.join(goal).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("e")), 6).alias("score"))
