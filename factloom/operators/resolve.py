"""Resolution of imports, calls, tests, paths and ranges by joins on keys, never by scanning pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import normalize_path, prefixes

# Confidence of each way in which a call is resolved, by precedence.
CALL_CONFIDENCE = {"self": 0.98, "local": 0.99, "external": 0.80, "import": 0.95, "namespace": 0.97, "class": 0.90, "unknown": 0.50}
TEST_CONFIDENCE = 0.65
# Endings and source roots under which a module is looked for, in order.
ENDINGS = ("", ".py", "/__init__.py", ".ts", ".tsx", "/index.ts", ".js", ".jsx", "/index.js", ".go", ".rs", "/mod.rs", ".java")
ROOTS = ("", "src/", "lib/", "app/", "packages/", "services/", "src/main/java/")


def longest_prefix(paths: DataFrame, path: str, dirs: DataFrame, directory: str, name: str, default: Column) -> DataFrame:
    """(path, name) of the directory with the longest prefix of each path; every path's prefixes are joined on equality."""
    own = paths.select(path).distinct()
    each = own.select(path, F.explode(prefixes(F.col(path))).alias("__prefix"))
    hits = each.join(dirs.select(F.col(directory).alias("__prefix"), F.col(name).alias("__name")), "__prefix").groupBy(path).agg(F.max_by("__name", F.struct(F.length("__prefix"), "__name")).alias("__name"))
    return own.join(hits, path, "left").select(path, F.coalesce("__name", default).alias(name))


def candidate_paths(module: Column) -> Column:
    """Files in which a module may lie, best first."""
    base = F.replace(module, F.lit("."), F.lit("/"))
    return F.array(*[F.concat(F.lit(r), b, F.lit(e)) for r in ROOTS for b in (module, base) for e in ENDINGS])


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file, module, target, internal): relative modules from the file's folder, others by their candidates; the first that exists wins."""
    folder = F.regexp_replace("file", r"[^/]*$", "")
    relative = F.col("module").rlike(r"^\.{1,2}(/|$)")
    module = F.when(relative, normalize_path(F.concat(folder, "module"))).otherwise(F.col("module"))
    each = imports.select("file", "module", F.posexplode(candidate_paths(module)).alias("place", "path"))
    best = each.join(files.select("path").distinct(), "path").groupBy("file", "module").agg(F.min_by("path", "place").alias("target"))
    return imports.select("file", "module").distinct().join(best, ["file", "module"], "left").withColumn("internal", F.col("target").isNotNull()).withColumn("target", F.coalesce("target", F.concat(F.lit("external:"), "module")))


def resolve_calls(calls: DataFrame, symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """(call, target, rule, confidence): one left join a rule, the first rule that answers wins.

    calls: call, file, owner (class or null), receiver (or null), name. symbols:
    file, name, owner, symbol. imported: file, local, target_file (null: external), original.
    """
    one = symbols.groupBy("file", "owner", "name").agg(F.min("symbol").alias("symbol"))
    top = one.filter("owner is null").select("file", "name", "symbol")
    own = one.filter("owner is not null")
    rows = calls
    rows = rows.join(own.select("file", "owner", "name", F.col("symbol").alias("s_self")), (calls["receiver"] == "self") & (calls["file"] == own["file"]) & (calls["owner"] == own["owner"]) & (calls["name"] == own["name"]), "left").select(calls["*"], "s_self")
    rows = rows.join(top.select(F.col("file").alias("f1"), F.col("name").alias("n1"), F.col("symbol").alias("s_local")), (F.col("file") == F.col("f1")) & (F.col("name") == F.col("n1")) & F.col("receiver").isNull(), "left").drop("f1", "n1")
    names = imported.select(F.col("file").alias("f2"), F.col("local").alias("l2"), "target_file", "original").dropDuplicates(["f2", "l2"])
    rows = rows.join(names, (F.col("file") == F.col("f2")) & (F.coalesce("receiver", "name") == F.col("l2")), "left").drop("f2")
    wanted = F.when(F.col("receiver").isNull(), F.col("original")).otherwise(F.col("name"))
    rows = rows.withColumn("wanted", wanted).join(top.select(F.col("file").alias("f3"), F.col("name").alias("n3"), F.col("symbol").alias("s_import")), (F.col("target_file") == F.col("f3")) & (F.col("wanted") == F.col("n3")), "left").drop("f3", "n3")
    rows = rows.join(own.select(F.col("file").alias("f4"), F.col("owner").alias("o4"), F.col("name").alias("n4"), F.col("symbol").alias("s_class")), (F.coalesce("target_file", "file") == F.col("f4")) & (F.coalesce("original", "receiver") == F.col("o4")) & (F.col("name") == F.col("n4")), "left").drop("f4", "o4", "n4")
    known, outer = F.col("l2").isNotNull(), F.col("l2").isNotNull() & F.col("target_file").isNull()
    answer = lambda rule, target: F.struct(target.alias("target"), F.lit(rule).alias("rule"), F.lit(CALL_CONFIDENCE[rule]).alias("confidence"))
    chosen = (
        F.when(F.col("s_self").isNotNull(), answer("self", F.col("s_self")))
        .when(F.col("s_local").isNotNull(), answer("local", F.col("s_local")))
        .when(outer, answer("external", F.concat(F.lit("external:"), F.coalesce("receiver", "name"))))
        .when(known & F.col("receiver").isNull() & F.col("s_import").isNotNull(), answer("import", F.col("s_import")))
        .when(known & F.col("receiver").isNotNull() & F.col("s_import").isNotNull(), answer("namespace", F.col("s_import")))
        .when(F.col("s_class").isNotNull(), answer("class", F.col("s_class")))
        .otherwise(answer("unknown", F.concat(F.lit("unknown:"), "name")))
    )
    return rows.withColumn("x", chosen).select("call", "x.target", "x.rule", "x.confidence")


def default_symbol(symbols: DataFrame) -> DataFrame:
    """(file, name): the symbol called default, else the shortest name, the first of equals."""
    return symbols.groupBy("file").agg(F.min_by("name", F.struct((F.col("name") != "default"), F.length("name"), "name")).alias("name"))


def link_tests(tests: DataFrame, symbols: DataFrame) -> DataFrame:
    """(test, symbol, confidence) where a token of the test is the symbol's name, or both share six leading characters.

    tests: test, file (an imported one), tokens. Joined on the file, then on the name or
    its first six characters.
    """
    each = tests.select("test", "file", F.explode("tokens").alias("token"))
    six = lambda c: F.when(F.length(c) >= 6, F.left(F.lower(c), F.lit(6))).otherwise(F.lower(c))
    a, b = each.withColumn("k", six(F.col("token"))), symbols.select("file", F.col("name"), "symbol").withColumn("k", six(F.col("name")))
    same = (F.lower("token") == F.lower("name")) | ((F.length("token") >= 6) & (F.length("name") >= 6))
    return a.join(b, ["file", "k"]).filter(same).select("test", "symbol", F.lit(TEST_CONFIDENCE).alias("confidence")).distinct()


def innermost(points: DataFrame, ranges: DataFrame, key: str, default: Column) -> DataFrame:
    """(point columns, range_id): the narrowest range (key, start, end, range_id) that holds each point (key, line, point_id), else ``default``.

    Ranges are cut into pieces of 256 lines, so the join is on (key, piece) and a wide
    document isn't one group.
    """
    piece = lambda c: F.floor(c / 256)
    r = ranges.select(key, "start", "end", "range_id", F.explode(F.sequence(piece(F.col("start")), piece(F.col("end")))).alias("piece"))
    hits = points.withColumn("piece", piece(F.col("line"))).join(r, [key, "piece"]).filter("start <= line and line <= end")
    best = hits.groupBy("point_id").agg(F.min_by("range_id", F.struct(F.col("end") - F.col("start"), "range_id")).alias("range_id"))
    return points.join(best, "point_id", "left").withColumn("range_id", F.coalesce("range_id", default))
