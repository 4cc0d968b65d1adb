"""The file registry: a folder read as rows, classified and hashed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import prepare

#: Fixed value: larger files are skipped.
MOST_BYTES = 5 * 1024 * 1024
# Language of each ending.
LANGUAGES = {
    "python": "py pyi", "typescript": "ts tsx mts cts", "javascript": "js jsx mjs cjs", "go": "go", "rust": "rs", "java": "java", "json": "json jsonc",
    "yaml": "yaml yml", "toml": "toml", "terraform": "tf", "markdown": "md mdx rst", "shell": "sh bash zsh", "sql": "sql", "env": "env",
}
CONFIG_LANGUAGES = ("json", "yaml", "toml", "env", "dockerfile", "sql")


def glob_regex(glob: str) -> str:
    """Regular expression of a glob: '**' crosses folders, '*' and '?' don't."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def is_ignored(path: Column, globs: list[str], state: str = ".factloom", keep: tuple[str, ...] = (".factloom/intent.yaml",)) -> Column:
    """Whether a glob matches the path or a folder above it; the state folder is always out, ``keep`` always in."""
    out = path.startswith(f"{state}/") | path.rlike(r"(^|/)\.git/")
    for g in globs:
        pattern = glob_regex(g.rstrip("/"))
        out = out | path.rlike(pattern) | path.rlike(pattern[:-1] + "/")
    return out & ~path.isin(*keep)


def language(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, r"([^/]+)$", 1))
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.when(name.startswith(".env"), "env")
    for lang, endings in LANGUAGES.items():
        out = out.when(ending.isin(*endings.split()), lang)
    return out.when(name == "dockerfile", "dockerfile").when(ending == "", "other")  # other endings: null, not indexed


def is_test_path(path: Column, lang: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    dirs = F.split(F.regexp_replace(path, r"/?[^/]*$", ""), "/")
    inside = lambda *names: F.exists(dirs, lambda d: d.isin(*names))
    return (
        F.when(lang == "python", name.startswith("test_") | name.endswith("_test.py") | inside("tests", "test"))
        .when(lang.isin("typescript", "javascript"), name.rlike(r"\.(test|spec)\.tsx?$|\.test\.js$|\.spec\.js$") | inside("__tests__"))
        .when(lang == "java", name.rlike(r"Tests?\.java$") | F.exists(dirs, lambda d: d.startswith("test")))
        .otherwise(False)
    )


def file_kind(path: Column, lang: Column) -> Column:
    name = F.lower(F.regexp_extract(path, r"([^/]+)$", 1))
    infra = (lang == "terraform") | (name == "dockerfile") | ((lang == "yaml") & (name.rlike("^(docker-)?compose|^helm") | path.contains(".github/")))
    return F.when(is_test_path(path, lang), "test").when(lang == "markdown", "docs").when(infra, "infra").when(lang.isin(*CONFIG_LANGUAGES), "config").otherwise("source")


def _hidden_files(spark: SparkSession, root: str) -> DataFrame:
    """path, content, length of files that Spark's readers pass over: a name on their path begins with '_' or '.'.

    The listing is of such names alone; contents are read by the workers through the file system of the path.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base, found = fs.makeQualified(top).toString().rstrip("/"), []
    every = fs.listFiles(top, True)
    while every.hasNext():
        f = every.next()
        path = f.getPath().toString()
        rest = path[len(base) + 1 :]
        if re.search(r"(^|/)[._]", rest) and "/.git/" not in f"/{rest}" and f.getLen() <= MOST_BYTES:
            found.append((path,))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as store

        for b in batches:
            paths, contents = b.column("path").to_pylist(), []
            for p in paths:
                own, name = store.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", p))
                with own.open_input_stream(name) as f:
                    contents.append(f.read())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary()), pa.array([len(c) for c in contents], pa.int64())], names=["path", "content", "length"])

    return spark.createDataFrame(found, "path string").mapInArrow(read, "path string, content binary, length long")


def scan_repo(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """path, digest, language, kind, size, content of every file below the root that is indexed, dotfiles included.

    A symbolic link out of the root isn't followed by the readers. SHA-256 stands for
    the content hash.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content", "length").unionByName(_hidden_files(spark, root))
    top = re.sub(r"^file:(//)?(?=/)", "", root.rstrip("/"))
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:(//)?(?=/)", ""), "^" + re.escape(top) + "/", "")
    rows = files.filter(F.col("length") <= MOST_BYTES).select(rel.alias("path"), "content", F.col("length").alias("size"))
    rows = rows.filter(~is_ignored(F.col("path"), ignore or [])).withColumn("language", language(F.col("path"))).filter("language is not null")
    return rows.select("path", F.sha2("content", 256).alias("digest"), "language", file_kind(F.col("path"), F.col("language")).alias("kind"), "size", F.decode("content", "UTF-8").alias("content"))
