r"""Document fingerprints: Merkle trees over sections, paragraphs and phrases, with SQL functions alone.

A text's paragraphs are its lines, its leaves the phrases of the lines: runs of words
up to one that ends in certain letters. A section ends after a paragraph whose digest
begins with 0 or 1, so an edit moves no border but its own. A paragraph's digest is taken
over its leaves', a section's over its paragraphs', the root over the sections'. Roots tell whether
texts are equal; the first and last branches that differ locate an edit.

The fingerprint is the root and the leaves' digests in order, about a tenth of the
text; likeness is the share of leaves that two trees have in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.order import ordered
from factloom.session import cut, prepare, shuffle_partitions

#: Hexadecimal digits of a leaf in a fingerprint, and of any node in the tree.
LEAF_HEX, NODE_HEX = 6, 16
#: Words of a phrase but the last don't end in these letters or marks; sixteen words at most.
_PHRASE = r"(?:[^ ]*[^ ghkmowyz.!?] ){0,15}[^ ]*[ ]?"
_SECTION = rf"(?:[2-9a-f][0-9a-f]{{{NODE_HEX - 1}}}){{0,63}}[0-9a-f]{{{NODE_HEX}}}"
_MID, _SHIFT = "__mid", 33


def _digest(text: Column) -> Column:
    return F.substring(F.md5(text), 1, NODE_HEX)


def tree(text: Column) -> Column:
    """Digests of the leaves of each paragraph of a text that isn't null."""
    leaves = lambda p: F.transform(F.filter(F.regexp_extract_all(p, F.lit(_PHRASE), F.lit(0)), lambda x: x != ""), _digest)
    return F.transform(F.split(text, "\n"), leaves)


def _finish(df: DataFrame, node: str, name: str) -> DataFrame:
    """Replace the column ``node`` by paragraphs, sections and fingerprint columns named after ``name``."""
    df = df.withColumn(f"{name}_paragraphs", F.transform(F.col(node), lambda p: _digest(F.array_join(p, ""))))
    joined = F.array_join(f"{name}_paragraphs", "")
    df = df.withColumn(f"{name}_sections", F.transform(F.regexp_extract_all(joined, F.lit(_SECTION), F.lit(0)), _digest))
    root = F.sha2(F.array_join(f"{name}_sections", ""), 256)
    return df.withColumn(name, F.concat_ws(":", root, F.array_join(F.transform(F.flatten(node), lambda x: F.substring(x, 1, LEAF_HEX)), "")))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1: 1 for equal roots, else below 1, the common part of the distinct leaves of both."""
    root = lambda x: F.substring(x, 1, 64)
    leaves = lambda x: F.array_distinct(F.regexp_extract_all(F.substr(x, F.lit(66)), F.lit(f".{{{LEAF_HEX}}}"), F.lit(0)))
    both, every = F.size(F.array_intersect(leaves(a), leaves(b))).cast("double"), F.size(leaves(a)) + F.size(leaves(b))
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(F.least(2 * both / F.greatest(every, F.lit(1)), F.lit(0.9999)))


def _next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) of distinct ids in descending order; after the last comes the first.

    The ids are range-partitioned and sorted; the next of a row is the one after it, the next
    of a partition's last row the head of the following partition that has rows.
    """
    src = ordered(ids, [F.desc("doc_id")]).withColumn("part", F.shiftright(_MID, _SHIFT))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = src.filter(F.col(_MID) == F.shiftleft("part", _SHIFT)).select("part", F.col("doc_id").alias("head"))  # one row a partition
    following = heads.select("part", F.coalesce(F.lead("head").over(Window.orderBy("part")), F.first("head").over(every)).alias("following"))
    near = src.select((F.col(_MID) - 1).alias(_MID), F.col("doc_id").alias("near"))
    return src.join(near, _MID, "left").join(F.broadcast(following), "part").select("doc_id", F.coalesce("near", "following").alias("next_id"))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text and its edited text (see ``queries``), and hold them against each other.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, then n_sections, n_paragraphs and the paragraphs (from 1;
    null if none) between which the edited text's tree differs, first and last counted
    from either end. A null text counts as empty. Of rows that repeat a doc_id one,
    of the least text, is the next document of others; each row has a result. Rows of
    null doc_id have no next document: nothing is replaced and near_next is null. A
    lone document is its own next. An empty table gives no rows; other columns
    aren't read.
    """
    prepare(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = cut(base.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.char_length("text")).alias("most"), F.count("*").alias("n")))
    wanted = cut(_next_ids(sizes.select("doc_id")).join(sizes, "doc_id").select(F.col("next_id").alias("giver"), F.col("doc_id").alias("taker"), F.expr("most div 3").alias("take")))
    # both joins read one shuffle of the texts; every id has a giver, rows without an id none
    texts = base.filter("doc_id is not null").repartition(shuffle_partitions(docs.sparkSession), "doc_id")
    givers = texts if sizes.filter("n > 1").isEmpty() else texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    lent = givers.join(wanted, F.col("doc_id") == F.col("giver"))
    lent = lent.withColumn("node", tree(F.col("text")))
    lent = _finish(lent, "node", "next_fingerprint").select("taker", F.expr("substring(text, 1, take)").alias("prefix"), "next_fingerprint")
    own = texts.join(lent, F.col("doc_id") == F.col("taker"))
    lone = base.filter("doc_id is null")
    if not lone.isEmpty():  # a union keeps Spark from reading the shuffle twice, so it is made only where it holds rows
        own = own.unionByName(lone, allowMissingColumns=True)
    own = own.withColumn("n_chars", F.char_length("text").cast("long"))
    swap = F.expr("cast(n_chars div 3 as int)")
    edited = F.when(F.col("taker").isNull(), F.col("text")).otherwise(F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 3 as int))"), F.substring(F.coalesce("prefix", F.lit("")), F.lit(1), swap)))
    own = own.withColumn("edited", edited).withColumn("node", tree(F.col("text"))).withColumn("edited_node", tree(F.col("edited")))
    own = _finish(_finish(own, "node", "fingerprint"), "edited_node", "edited_fingerprint")
    a, b = F.col("fingerprint_paragraphs"), F.col("edited_fingerprint_paragraphs")
    differ = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True)
    first, last = differ(a, b), differ(F.reverse(a), F.reverse(b))
    same = F.substring("fingerprint", 1, 64) == F.substring("edited_fingerprint", 1, 64)
    return own.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        F.when(F.col("next_fingerprint").isNotNull(), likeness(F.col("fingerprint"), F.col("next_fingerprint"))).alias("near_next"),
        F.size("fingerprint_sections").cast("long").alias("n_sections"),
        F.size(a).cast("long").alias("n_paragraphs"),
        F.when(~same, first).alias("first_changed"),
        F.when(~same, last).alias("last_changed_from_end"),
    )


def oracle_sql() -> str:
    """The same rows."""
    def fp(t: str, of: str, source: str) -> str:
        phrases = f"list_filter(regexp_extract_all(p, '{_PHRASE}'), lambda x: x <> '')"
        nodes = f"list_transform(string_split({t}, chr(10)), lambda p: list_transform({phrases}, lambda x: left(md5(x), {NODE_HEX})))"
        return f"""{of}1 AS (SELECT *, {nodes} AS nodes FROM {source}), {of}2 AS (SELECT *, list_transform(nodes, lambda p: left(md5(array_to_string(p, '')), {NODE_HEX})) AS {of}_p FROM {of}1),
{of}3 AS (SELECT *, list_transform(regexp_extract_all(array_to_string({of}_p, ''), '{_SECTION}'), lambda s: left(md5(s), {NODE_HEX})) AS {of}_s FROM {of}2),
{of} AS (SELECT * EXCLUDE (nodes), sha256(array_to_string({of}_s, '')) || ':' || array_to_string(list_transform(flatten(nodes), lambda x: left(x, {LEAF_HEX})), '') AS {of}_f FROM {of}3)"""

    def near(a: str, b: str) -> str:
        leaves = lambda x: f"list_distinct(regexp_extract_all(substring({x}, 66), '.{{{LEAF_HEX}}}'))"
        share = f"2.0::DOUBLE * len(list_intersect({leaves(a)}, {leaves(b)})) / greatest(len({leaves(a)}) + len({leaves(b)}), 1)"
        return f"CASE WHEN left({a}, 64) = left({b}, 64) THEN 1.0::DOUBLE ELSE least({share}, 0.9999::DOUBLE) END"

    differ = lambda a, b: f"list_position(list_transform(list_zip({a}, {b}), lambda x: x[1] IS DISTINCT FROM x[2]), true)"
    changed = "left(own_f, 64) <> left(edit_f, 64)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM documents),
g AS (SELECT doc_id, min(text) AS given FROM t WHERE doc_id IS NOT NULL GROUP BY 1),
x AS (SELECT doc_id, coalesce(lead(given) OVER w, first_value(given) OVER w) AS nxt FROM g WINDOW w AS (ORDER BY doc_id DESC)),
{fp('text', 'own', 't')}, {fp('nxt', 'nx', 'x')},
e AS (SELECT own.*, nxt, nx_f, CASE WHEN nxt IS NULL THEN text ELSE left(text, n_chars - n_chars // 3) || left(nxt, n_chars // 3) END AS edited FROM own LEFT JOIN nx ON own.doc_id = nx.doc_id),
{fp('edited', 'edit', 'e')}
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, own_f AS fingerprint, edit_f AS edited_fingerprint, {near('own_f', 'edit_f')} AS near_edited, CASE WHEN nx_f IS NOT NULL THEN {near('own_f', 'nx_f')} END AS near_next,
  CAST(len(own_s) AS BIGINT) AS n_sections, CAST(len(own_p) AS BIGINT) AS n_paragraphs,
  CASE WHEN {changed} THEN CAST({differ('own_p', 'edit_p')} AS BIGINT) END AS first_changed, CASE WHEN {changed} THEN CAST({differ('list_reverse(own_p)', 'list_reverse(edit_p)')} AS BIGINT) END AS last_changed_from_end FROM edit
"""
