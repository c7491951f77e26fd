"""Corpus operators: ranking, two-revision comparison, gates, thresholds, change folds, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import stages
from ..functions import expr

# The metrics that ranking and comparison know, with label and whether higher is better, and those taken by default.
SELECTORS = {
    "cyclomatic": ("Cyclomatic", False), "cognitive": ("Cognitive", False), "nom.functions": ("Functions", False), "loc.lloc": ("LLOC", False), "mi.original": ("MI (Original)", True),
    "mi.sei": ("MI (SEI)", True), "mi.visual_studio": ("MI", True), "halstead.volume": ("Halstead Vol", False), "abc": ("ABC", False),
}
DEFAULT_SELECTORS = ("cyclomatic", "cognitive", "nom.functions", "loc.lloc", "mi.visual_studio")


def metric_key(selector: str) -> str:
    """The metric behind a selector: sums for the two complexities."""
    return f"{selector}.sum" if selector in ("cyclomatic", "cognitive") else selector


def parse_selectors(names: list[str]) -> list[tuple[str, str, bool]]:
    """``(key, label, higher is better)``; ``+`` and ``-`` override the polarity, unknown names are skipped."""
    out = []
    for n in names:
        key, sign = (n[1:], n[0]) if n[:1] in "+-" else (n, "")
        if key in SELECTORS:
            label, higher = SELECTORS[key]
            out.append((key, label, sign == "+" if sign else higher))
    return out


def lookup(metrics: str, key: str, aggregate: str | None = None) -> Column:
    """A value of a metric map: ``key.sum`` or ``key_sum`` (also ``average`` for avg), 0 where missing."""
    names = [key] if aggregate is None else [f"{key}.{aggregate}", f"{key}_{aggregate}"] + ([f"{key}.average", f"{key}_average"] if aggregate == "avg" else [])
    return F.coalesce(*[F.try_element_at(F.col(metrics), F.lit(n)) for n in names], F.lit(0.0))


def rank(files: DataFrame, keys: list[tuple[str, bool]], path: str = "path", k: int = 10) -> DataFrame:
    """The ``k`` worst rows: by each key in turn (worst first), ties by path; one TakeOrderedAndProject."""
    return files.orderBy(*[F.asc(c) if higher else F.desc(c) for c, higher in keys], F.asc(path)).limit(k)


def compare(base: DataFrame, head: DataFrame, metrics: list[str], key: str = "path") -> DataFrame:
    """Full outer comparison of two revisions: ``key, metric, current, baseline, delta, is_new, is_deleted``."""
    b = base.select(F.col(key), *[F.col(m).cast("double").alias(f"b_{m}") for m in metrics], F.lit(True).alias("in_base"))
    h = head.select(F.col(key), *[F.col(m).cast("double").alias(f"h_{m}") for m in metrics], F.lit(True).alias("in_head"))
    both = b.join(h, key, "full_outer")
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(f"h_{m}", F.lit(0.0)).alias("current"), F.coalesce(f"b_{m}", F.lit(0.0)).alias("baseline")) for m in metrics]))
    out = both.select(key, F.col("in_base").isNull().alias("is_new"), F.col("in_head").isNull().alias("is_deleted"), rows.alias("m"))
    return out.select(key, "m.*", (F.col("m.current") - F.col("m.baseline")).alias("delta"), "is_new", "is_deleted")


def changed_only(diff: DataFrame, key: str = "path") -> DataFrame:
    """Without the files none of whose metrics changed."""
    moved = F.max(F.col("delta") != 0).over(Window.partitionBy(key))
    return diff.withColumn("moved", moved).where("moved").drop("moved")


def violations(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rows beyond their limit, strictly: above it where lower is better, below it where higher is."""
    bad = F.when(F.col("higher_is_better"), F.col("value") < F.col("limit_value")).otherwise(F.col("value") > F.col("limit_value"))
    return metrics.join(thresholds, "metric").where(bad)


def multiset_increase(base: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more often in ``head``, with the surplus."""
    b, h = (d.groupBy(*keys).agg(F.count("*").alias(n)) for d, n in ((base, "nb"), (head, "nh")))
    return h.join(b, keys, "left").withColumn("surplus", F.col("nh") - F.coalesce("nb", F.lit(0))).where("surplus > 0").select(*keys, "surplus")


def fold_changes(changes: DataFrame) -> DataFrame:
    """Net status by path of ordered ``(ord, path, status)``: an addition after a deletion modifies, a deletion
    of something added cancels, a modification of something added leaves it added."""
    step = F.sort_array(F.collect_list(F.struct("ord", "status")))
    a, s = "added", lambda x: x["status"]
    net = F.aggregate(
        step, F.lit("none"),
        lambda acc, x: F.when(s(x) == a, F.when(acc == "deleted", "modified").otherwise(a)).when(s(x) == "modified", F.when(acc == a, a).otherwise("modified")).otherwise(F.when(acc == a, "none").otherwise("deleted")),
    )
    return changes.groupBy("path").agg(net.alias("status")).where("status <> 'none'")


def roll_up(spaces: DataFrame, value: str = "value", most: int = 1000) -> DataFrame:
    """Sum, extremes and count over each space and all below it, from ``(path, space_id, parent_id, value)``.

    Every space is paired with its ancestors by joining one level at a time on ``(path, parent)``, until no row has
    a parent left; the rows that have one shrink with the level, and each level is written, so the plan stays short.
    Spaces nested more than ``most`` deep are no tree, and an error.
    """
    out = spaces.select("path", F.col("space_id").alias("ancestor"), F.col(value).alias("v"))
    parents = spaces.select("path", F.col("space_id").alias("ancestor"), F.col("parent_id").alias("next"))
    level = spaces.where("parent_id is not null").select("path", "parent_id", F.col(value).alias("v"))
    for _ in range(most):
        found = level.select("path", F.col("parent_id").alias("ancestor"), "v").join(parents, ["path", "ancestor"])
        found = stages.write(found, "level")
        out = out.unionByName(found.select("path", "ancestor", "v"))
        level = found.where("next is not null").select("path", F.col("next").alias("parent_id"), "v")
        if level.isEmpty():
            break
    else:
        raise ValueError(f"spaces nested more than {most} deep")
    return out.groupBy("path", "ancestor").agg(F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("spaces"))


def deepest(tokens: DataFrame, spaces: DataFrame) -> DataFrame:
    """Each token with the innermost space that contains it: an interval join inside an equi-join on path."""
    inside = (F.col("t.start") >= F.col("s.start")) & (F.col("t.end") <= F.col("s.end"))
    j = tokens.alias("t").join(spaces.alias("s"), (F.col("t.path") == F.col("s.path")) & inside)
    return j.groupBy(F.col("t.path").alias("path"), F.col("t.token").alias("token")).agg(F.max("s.space_id").alias("space_id"))


def path_filter(path: Column, prefixes: list[str]) -> Column:
    """Component-wise prefixes; none allows all."""
    clean = [p.removeprefix("./").rstrip("/") for p in prefixes]
    p = F.regexp_replace(path, r"^\./", "")
    return F.lit(True) if not clean else F.greatest(*[(p == c) | p.startswith(f"{c}/") for c in clean], F.lit(False))


def severity(dmi_drop, broken_added, filler) -> Column:
    """4 for the worst kind of change of a document, 0 for none."""
    return F.when(expr.col(broken_added) > 0, 4).when(expr.col(filler) >= 0.6, 3).when(expr.col(dmi_drop) >= 3.0, 2).when(expr.col(dmi_drop) > 0, 1).otherwise(0)
