"""Benchmark decontamination with DataFrame functions alone.

A set of hashed leading word sequences of the benchmark's windows is sent to
every task as a bit map of bounded size. Each document's word windows are probed against it inside the row;
the few positions that answer are held against the windows' full text, and
only those rows are joined and counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import cut, prepare

#: Words in a window, and leading words of it that are probed.
WINDOW, LEAD = 13, 4
#: A document is contaminated if one word in so many is hit.
SHARE = 20
#: Bits of the map for each probe, most bits of it (16 MB; with more probes more positions answer in vain), and most bytes of window text that are broadcast; beyond them they are joined by shuffle.
BITS, MOST_BITS, MOST_BYTES = 64, 1 << 27, 8 << 20
#: Words of the text before lower-casing; lower-casing A-Z changes none of their borders.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))


def _shifted(a: Column, by: int) -> Column:
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))


def _joined(a: Column, b: Column) -> Column:
    """Hashes of neighbouring runs; past the end they are hashes of shorter runs, which are never asked for."""
    return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))


def _with_leads(df: DataFrame, leads: list[int]) -> DataFrame:
    """Add ``lead1`` to ``lead4``: the hash of so many words from each position on."""
    # full lower-casing equates at least what A-Z lower-casing equates; the text is compared exactly later
    df = df.withColumn("lead1", F.transform("words", lambda w: F.xxhash64(F.lower(w))))
    if max(leads) > 1:
        df = df.withColumn("lead2", _joined(F.col("lead1"), _shifted(F.col("lead1"), 1)))
    if 3 in leads:
        df = df.withColumn("lead3", _joined(F.col("lead2"), _shifted(F.col("lead1"), 2)))
    if 4 in leads:
        df = df.withColumn("lead4", _joined(F.col("lead2"), _shifted(F.col("lead2"), 2)))
    return df


def _span(pos: Column, n: Column) -> Column:
    return F.translate(F.array_join(F.slice("words", pos, n), " "), _UPPER, _LOWER)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct (item_id, n, window, lead, probe) of every item that has words; rows without item_id are left out."""
    w = benchmark.filter("item_id is not null").select("item_id", words(F.col("text")).alias("words")).filter("size(words) > 0")
    w = _with_leads(w, [1, 2, 3, 4]).withColumn("n", F.least(F.size("words"), F.lit(WINDOW)))
    w = w.withColumn("pos", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)))
    lead = F.least(F.col("n"), F.lit(LEAD))
    probe = reduce(lambda rest, k: F.when(lead == k, F.element_at(f"lead{k}", F.col("pos"))).otherwise(rest), range(1, LEAD + 1), F.lit(None).cast("long"))
    return w.select("item_id", "n", _span(F.col("pos"), F.col("n")).alias("window"), lead.alias("lead"), probe.alias("probe")).distinct()


def bit_map(probes: DataFrame, bits: int) -> DataFrame:
    """One row: an array of ``bits`` / 64 longs with the bits set that the lowest bits of ``probe`` number; ``bits`` is a power of two."""
    at = F.col("probe").bitwiseAND(F.lit(bits - 1))
    word, bit = F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    words = probes.groupBy(word).agg(F.bit_or(bit).alias("set"))
    every = probes.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    row = every.agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("set", F.lit(0).cast("long")).alias("set")))).alias("words"))
    return row.select(F.transform("words", lambda w: w["set"]).alias("bit_map"))


def _positions(lead: str, bits: int) -> Column:
    """Positions whose lead may be one of the probes."""
    at = lambda h: h.bitwiseAND(F.lit(bits - 1))
    hit = lambda h: F.getbit(F.get("bit_map", F.shiftright(at(h), 6).cast("int")), at(h).bitwiseAND(F.lit(63)).cast("int")) == 1
    return F.filter(F.transform(lead, lambda h, i: F.when(hit(h), i + 1)), lambda i: i.isNotNull())


def _spans(k: int, n: int) -> Column:
    """The ``n`` words from each position that answered to ``k`` leading words, where so many are left."""
    whole = F.filter(F.coalesce(f"at{k}", F.array().cast("array<int>")), lambda p: p + (n - 1) <= F.size("words"))
    return F.transform(whole, lambda p: F.struct(p.alias("pos"), F.lit(n).alias("n"), _span(p, F.lit(n)).alias("window")))


def _key() -> list[Column]:
    """What tells rows apart: the id and a digest of the text. Rows that agree in both have one result."""
    return [F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")]


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_key, copies, n_words, hits and items of the distinct rows."""
    prepare(docs.sparkSession)
    windows = cut(benchmark_windows(benchmark))
    shapes = windows.groupBy("n", "lead").agg(F.count_distinct("probe").alias("probes"), F.sum(F.octet_length("window")).alias("bytes")).collect()  # 13 rows at most
    base = docs.select(*_key(), words(F.col("text")).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    own = ["doc_id", "text_key", "n_words"]
    leads = sorted({r["lead"] for r in shapes})
    if not leads:
        none = F.array().cast("array<struct<pos:int,n:int>>")
        return base.groupBy(*own).agg(F.count("*").alias("copies")).select(*own, "copies", none.alias("hits"), F.array().cast("array<string>").alias("items"))
    lengths = {k: sorted(r["n"] for r in shapes if r["lead"] == k) for k in leads}
    bits = min(MOST_BITS, max(1 << 12, 1 << (BITS * sum(r["probes"] for r in shapes) - 1).bit_length()))
    probed = _with_leads(base.join(F.broadcast(bit_map(windows.select("probe").distinct(), bits))), leads)
    for k in leads:
        probed = probed.withColumn(f"at{k}", _positions(f"lead{k}", bits))
    # the first entry stands for the row itself
    row = F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("window")))
    spans = F.flatten(F.array(row, *[_spans(k, n) for k in leads for n in lengths[k]]))
    spread = probed.select(*own, F.explode(spans).alias("x")).select(*own, "x.pos", "x.n", "x.window")
    items = windows.select(F.col("window").alias("found"), F.col("item_id").cast("string").alias("item")).distinct()
    if sum(r["bytes"] for r in shapes) <= MOST_BYTES:
        items = F.broadcast(items)
    held = spread.join(items, spread["window"] == items["found"], "left")
    hit = F.when(F.col("item").isNotNull(), F.struct("pos", "n"))
    return held.groupBy(*own).agg(F.sum((F.col("pos") == 0).cast("int")).alias("copies"), F.collect_set(hit).alias("hits"), F.collect_set("item").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Hold every whole document against every window of the benchmark.

    Returns doc_id, n_words, n_hit (words inside an occurrence of a window),
    n_items, items_sha256, contaminated, and ``hits`` (array of first word from 1 and
    length), one row per input row, repeated rows included. A null or empty
    text has no words and no hits; a null doc_id stays null; an empty benchmark
    hits nothing; an empty table gives no rows; other columns aren't read. Rows are
    told apart by content, so a task that runs again gives the same.
    """
    found = _result(_found(docs, benchmark))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("text_key", "copies", "copy")


def _result(found: DataFrame) -> DataFrame:
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["pos"], h["pos"] + h["n"] - 1))))).cast("long")
    return found.withColumn("n_hit", covered).select(
        "text_key",
        "copies",
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.array_sort("hits").alias("hits"),
    )


def _with_results(docs: DataFrame, results: DataFrame, how: str) -> DataFrame:
    """Join rows with the results (``__doc``, ``__key``, ...) of their id and text."""
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(results, docs["doc_id"].eqNullSafe(results["__doc"]) & (key == results["__key"]), how)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Keep the documents that aren't contaminated, with all their columns; each row is decided by its own text, also of null or repeated doc_id."""
    bad = _result(_found(docs, benchmark)).filter("contaminated").select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"))
    return _with_results(docs, bad, "left_anti")


def remove_hit_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Delete the words that windows cover, with what separates them from the word before; all rows and columns stay, n_chars follows the text where it is there."""
    hits = _result(_found(docs, benchmark)).filter("n_hit > 0").select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"), F.col("hits").alias("__hits"))
    pieces = F.regexp_extract_all("text", F.lit(rf"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*(?:{_WORD}|\z)"), F.lit(0))
    inside = lambda i: F.exists("__hits", lambda h: (h["pos"] <= i + 1) & (i + 1 < h["pos"] + h["n"]))
    text = F.when(F.col("__hits").isNull(), F.col("text")).otherwise(F.array_join(F.filter(pieces, lambda p, i: ~inside(i)), ""))
    out = _with_results(docs, hits, "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__hits").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS p FROM b WHERE len(w) > 0)
), ns AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT rid, p, n, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns WHERE len(w) >= n)
), hit AS (SELECT rid, p, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win), words AS (
  SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS pos FROM hit) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
