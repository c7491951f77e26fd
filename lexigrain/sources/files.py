"""File sources: directory walks as distributed scans, globs, revisions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def glob_pattern(glob: str) -> str:
    """A glob over whole paths as a regular expression: ``*`` stays within a component, ``**`` does not."""
    out = ""
    for part in re.findall(r"\*\*/?|\*|\?|\{[^}]*\}|\[[^\]]*\]|.", glob):
        if part.startswith("**"):
            out += ".*"
        elif part == "*":
            out += "[^/]*"
        elif part == "?":
            out += "[^/]"
        elif part[0] == "{":
            out += "(" + "|".join(map(re.escape, part[1:-1].split(","))) + ")"
        elif part[0] == "[":
            out += part.replace("[!", "[^")
        else:
            out += re.escape(part)
    return f"^(.*/)?{out}$"


def glob_filter(path: Column, include: list[str], exclude: list[str]) -> Column:
    """No include allows all; no exclude forbids none."""
    keep = F.lit(True)
    if include:
        keep = keep & F.greatest(*[path.rlike(glob_pattern(g)) for g in include], F.lit(False))
    for g in exclude:
        keep = keep & ~path.rlike(glob_pattern(g))
    return keep


def read_tree(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), hidden: bool = False) -> DataFrame:
    """``path, text`` of all files below a root; filters run on the listing, before content is read as text.

    Files that are not valid UTF-8 are dropped; hidden files and folders unless asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^[a-z]+:/+", "/")
    files = files.withColumn("path", path).where(glob_filter(F.col("path"), list(include), list(exclude)))
    if not hidden:
        files = files.where(~F.regexp_replace("path", re.escape(root.rstrip("/")), "").rlike(r"/\."))
    return files.select("path", F.try_validate_utf8("content").alias("text")).where("text is not null")


def normal_blob(text: Column) -> Column:
    """A run of line ends at the end becomes one newline; none is added."""
    return F.regexp_replace(text, r"[\r\n]+\z", "\n")


def changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """``path, status`` between two snapshots ``(path, text)``; renames are a deletion and an addition."""
    b = base.select("path", F.sha2("text", 256).alias("b"))
    h = head.select("path", F.sha2("text", 256).alias("h"))
    status = F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "deleted").otherwise("modified")
    return b.join(h, "path", "full_outer").where(~F.col("b").eqNullSafe(F.col("h"))).select("path", status.alias("status"))
