"""Packages that workspace manifests list, as table functions over files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _clean(folder: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.trim(folder), r"^\./", ""), F.lit("/"))


def cargo_members(content: Column) -> Column:
    """Folders of the members of a Cargo workspace, globs as they stand."""
    listed = F.regexp_extract(content, r"(?s)\[workspace\][^\[]*?members\s*=\s*\[(.*?)\]", 1)
    return F.transform(F.regexp_extract_all(listed, F.lit(r"[\"']([^\"']+)[\"']"), F.lit(1)), _clean)


def gowork_dirs(content: Column) -> Column:
    """Folders that a go.work file uses, in blocks and on single lines."""
    plain = F.regexp_replace(content, r"(?m)//.*$", "")
    blocks = F.regexp_extract_all(plain, F.lit(r"(?s)(?:^|\n)\s*use\s*\(([^)]*)\)"), F.lit(1))
    inside = F.flatten(F.transform(blocks, lambda b: F.split(F.trim(b), r"\s+")))
    single = F.regexp_extract_all(plain, F.lit(r"(?:^|\n)[ \t]*use[ \t]+([^\s(]+)"), F.lit(1))
    return F.filter(F.transform(F.concat(inside, single), _clean), lambda d: d != "")


def manifest_packages(files: DataFrame) -> DataFrame:
    """(name, dirs) of the packages that manifests (path, content) list, by the last part of their folder.

    A folder is below its manifest's; "folder/*" stands for the folders in it that hold files; folders without files are left out.
    """
    base = F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1)
    listed = files.filter(F.col("path").rlike(r"(^|/)(Cargo\.toml|go\.work)$"))
    found = F.when(F.col("path").endswith("go.work"), gowork_dirs(F.col("content"))).otherwise(cargo_members(F.col("content")))
    rows = listed.select(F.explode(found).alias("dir"), base.alias("base")).select(F.when(F.col("base") == "", F.col("dir")).otherwise(F.concat_ws("/", "base", "dir")).alias("dir")).distinct()
    parts = F.split("path", "/")
    folders = files.select(F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))).alias("dir")).distinct()
    parent = folders.select("dir", F.concat(F.regexp_extract("dir", r"^(.*)/[^/]*$", 1), F.lit("/*")).alias("glob"))
    whole = rows.filter(~F.col("dir").endswith("/*")).join(folders, "dir", "left_semi")
    globbed = rows.filter(F.col("dir").endswith("/*")).select(F.col("dir").alias("glob")).join(parent, "glob").select("dir")
    return merge_candidates(whole.union(globbed).select(F.regexp_extract("dir", r"([^/]+)$", 1).alias("name"), "dir"))


def merge_candidates(rows: DataFrame) -> DataFrame:
    """(name, dirs): the folders of each name, sorted."""
    return rows.groupBy("name").agg(F.sort_array(F.collect_set("dir")).alias("dirs"))
