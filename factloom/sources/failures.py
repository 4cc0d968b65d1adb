"""Failure behaviour read from source lines: handlers, panics, circuit breakers and dead-letter queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.derive import carry_forward

# Calls that panic, the first that a line holds counts.
PANICS = ("panic!()", "panic!(", "panic(", "unwrap()", "expect(")
_IDENT = "[A-Za-z0-9_$]"


def _has(line: Column, word: str) -> Column:
    quoted = "".join(f"\\{c}" if not c.isalnum() else c for c in word)
    return line.rlike(rf"(?<!{_IDENT}){quoted}(?!{_IDENT})")


def circuit_identifier(line: Column) -> Column:
    """The first identifier that holds "circuit" in any case, else null."""
    return F.nullif(F.regexp_extract(line, rf"(?i)({_IDENT}*circuit{_IDENT}*)", 1), F.lit(""))


def dlq_literals(line: Column) -> Column:
    """Quoted texts that name a dead-letter queue, 40 characters of each; an open quote ends the line."""
    closed = F.regexp_extract(line, "^((?:[^'\"]*(?:'[^']*'|\"[^\"]*\"))*)", 1)
    quoted = F.transform(F.regexp_extract_all(closed, F.lit("'[^']*'|\"[^\"]*\""), F.lit(0)), lambda q: F.substring(q, F.lit(2), F.char_length(q) - 2))
    return F.transform(F.filter(quoted, lambda q: q.rlike("(?i)dlq|dead-letter|dead_letter")), lambda q: F.left(q, F.lit(40)))


def boundary_name(line: Column, language: Column) -> Column:
    """The function that a line declares, else null; a Go method is Receiver.name."""
    got = lambda pattern, group=1: F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))
    ident = f"({_IDENT}+)"
    receiver = F.nullif(F.regexp_extract(line, r"^\s*func \s*\([^)]*?[*&]*(?:\w+\.)?(\w+)(?:\[[^)]*)?\s*\)", 1), F.lit(""))
    go = F.when(receiver.isNotNull(), F.concat_ws(".", receiver, got(rf"^\s*func \s*\([^)]*\)\s*{ident}"))).otherwise(got(rf"^\s*func \s*{ident}"))
    rust = got(rf"^\s*(?:pub(?:\([^)]*\))?\s+|async |const |unsafe |extern |\"[^\"]*\"\s*)*fn {ident}")
    java = got(rf"^\s*(?:(?:public|protected|private|static|final|synchronized|abstract)\s+)+[\w<>\[\], ?]+\s{ident}\s*\(")
    script = F.coalesce(got(rf"^\s*(?:export )?(?:async )?function {ident}"), got(rf"^\s*(?:export )?(?:async )?const {ident}\s*="))
    return F.when(language == "python", got(rf"^\s*(?:async )?def {ident}")).when(language == "go", go).when(language == "rust", rust).when(language == "java", java).otherwise(script)


def source_lines(files: DataFrame) -> DataFrame:
    """(path, language, line, text, symbol): each line with the function declared last before it."""
    rows = files.select("path", "language", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "text")).withColumn("line", (F.col("pos") + 1).cast("int"))
    rows = rows.withColumn("boundary", boundary_name(F.col("text"), F.col("language")))
    return carry_forward(rows, ["path", "language"], F.col("line"), F.col("boundary"), "symbol").drop("boundary", "pos")


def scan_failures(files: DataFrame) -> DataFrame:
    """(path, symbol, kind, detail, line) of files (path, language, content), each hit of a line once; the symbol is the function above.

    A file is cut into lines and its functions carried on by a window of its own; other languages have none.
    """
    known = files.filter(F.col("language").isin("python", "typescript", "javascript", "java", "go", "rust"))
    rows = source_lines(known)
    text, language = F.col("text"), F.col("language")
    hit = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    handler = F.when(language == "python", F.when(_has(text, "except"), F.lit("except block"))).when(language.isin("typescript", "javascript", "java"), F.when(_has(text, "catch"), F.lit("catch block")))
    panic = F.coalesce(*[F.when(_has(text, p), F.lit(p)) for p in PANICS])
    panic = F.when(language == "go", F.when(_has(text, "panic") & text.contains("("), F.lit("panic call"))).when(language == "rust", panic)
    circuit = F.when(language != "go", circuit_identifier(text))
    dlq = F.when(language != "go", F.transform(dlq_literals(text), lambda d: hit("dlq", d)))
    single = F.filter(F.array(hit("except-fallback", handler), hit("panic", panic), hit("circuit-breaker", circuit)), lambda h: h["detail"].isNotNull())
    hits = F.concat(single, F.coalesce(dlq, F.array().cast("array<struct<kind:string,detail:string>>")))
    return rows.select("path", "symbol", "line", F.explode(F.array_distinct(hits)).alias("x")).select("path", "symbol", "x.kind", "x.detail", "line")


def apply_failures(hits: DataFrame) -> dict[str, DataFrame]:
    """failures (subject, failures: sorted array) and edges (subject, predicate, object): who handles what, and the queues that dead letters go to.

    The failures of one symbol are bounded by its lines.
    """
    subject = F.coalesce(F.concat(F.lit("symbol:"), "path", F.lit("#"), "symbol"), F.concat(F.lit("file:"), "path"))
    rows = hits.withColumn("subject", subject)
    failures = rows.groupBy("subject").agg(F.sort_array(F.collect_set(F.struct("line", "kind", "detail"))).alias("failures"))
    edges = rows.filter("kind = 'dlq'").select("subject", F.lit("subscribes").alias("predicate"), F.concat(F.lit("topic:"), "detail").alias("object")).distinct()
    return {"failures": failures, "edges": edges}


def env_references(files: DataFrame) -> DataFrame:
    """(path, symbol, key, line): configuration that lines read, with the function above them."""
    rows = source_lines(files)
    text, language = F.col("text"), F.col("language")
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    keys = (
        F.when(language == "python", every(r"os\.(?:environ(?:\.get\(|\[)|getenv\()\s*[\"']([^\"']+)[\"']"))
        .when(language.isin("typescript", "javascript"), F.concat(every(r"process\.env\.([A-Za-z_]\w*)"), every(r"process\.env\[[\"']([^\"']+)[\"']\]")))
        .when(language == "go", every(r"os\.(?:Getenv|LookupEnv)\(\"([^\"]+)\"")).when(language == "rust", every(r"env::var(?:_os)?\(\"([^\"]+)\"")).when(language == "java", every(r"System\.getenv\(\"([^\"]+)\""))
    )
    return rows.select("path", "symbol", F.explode(keys).alias("key"), "line")
