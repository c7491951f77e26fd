"""Pure column expressions shared by all metrics: normalisers, bands and closed formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: "Column | str | float | int") -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def clamp01(x) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(x)))


def sat(x, lo: float, hi: float) -> Column:
    """Where ``x`` lies between ``lo`` (0) and ``hi`` (1); a step at ``hi`` if the interval is empty."""
    if hi <= lo:
        return F.when(col(x) >= hi, 1.0).otherwise(0.0)
    return clamp01((col(x) - lo) / (hi - lo))


def ratio(a, b, default: float = 0.0) -> Column:
    """``a / b``, or the default where ``b`` is 0."""
    return F.when(col(b) != 0, col(a).cast("double") / col(b)).otherwise(F.lit(default))


def round3(x) -> Column:
    """Three decimals; NaN and infinities become 0."""
    c = col(x)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.round(c, 3))


def band(x, edges: list[float]) -> Column:
    """0 below the first edge, 1 from it on, and so on."""
    return sum((F.when(col(x) >= e, 1).otherwise(0) for e in edges), F.lit(0))


# ------------------------------------------------------------------ code metrics
def halstead(n1, n2, N1, N2) -> dict[str, Column]:  # noqa: N803
    """All Halstead values from distinct and total operators (1) and operands (2)."""
    n1, n2, N1, N2 = map(col, (n1, n2, N1, N2))  # noqa: N806
    n, length = n1 + n2, N1 + N2
    volume = F.when(n > 0, length * F.log2(n)).otherwise(0.0)
    difficulty = F.when(n2 > 0, n1 / 2 * (N2 / n2)).otherwise(0.0)
    effort = difficulty * volume
    estimated = F.when(n1 > 0, n1 * F.log2(n1)).otherwise(0.0) + F.when(n2 > 0, n2 * F.log2(n2)).otherwise(0.0)
    return {
        "length": length, "vocabulary": n, "volume": volume, "difficulty": difficulty, "level": ratio(F.lit(1.0), difficulty), "effort": effort,
        "time": effort / 18, "bugs": F.pow(effort, F.lit(2 / 3)) / 3000, "estimated_program_length": estimated, "purity_ratio": ratio(estimated, length),
    }


def maintainability(volume, cyclomatic, sloc, comment_share) -> dict[str, Column]:
    """``mi_original``, ``mi_sei``, ``mi_visual_studio``; 0 without volume or lines."""
    v, g, s, c = map(col, (volume, cyclomatic, sloc, comment_share))
    ok = (v > 0) & (s > 0)
    original = F.when(ok, 171 - 5.2 * F.log(v) - 0.23 * g - 16.2 * F.log(s)).otherwise(0.0)
    sei = F.when(ok, 171 - 5.2 * F.log2(v) - 0.23 * g - 16.2 * F.log2(s) + 50 * F.sin(F.sqrt(2.4 * c))).otherwise(0.0)
    return {"mi_original": original, "mi_sei": sei, "mi_visual_studio": F.greatest(F.lit(0.0), original * 100 / 171)}


def abc(a, b, c) -> Column:
    return F.sqrt(F.pow(col(a), F.lit(2)) + F.pow(col(b), F.lit(2)) + F.pow(col(c), F.lit(2)))


# ------------------------------------------------------------------ document metrics
def documentation_index(v, m, r, link, table, artifact, section, filler, good) -> Column:
    """Documentation maintainability, 0 to 100, from volume, cognitive load, reading paths and debts."""
    loss = 0.18 * sat(F.log1p(col(v)), 8, 15) + 0.18 * sat(m, 15, 80) + 0.10 * sat(r, 8, 40) + 0.16 * col(link) + 0.10 * col(table) + 0.10 * col(artifact) + 0.10 * col(section) + 0.12 * col(filler)
    return 100 * clamp01(1 - loss + 0.10 * col(good))


def link_debt(broken, anchor_miss, bare, external, per_100_words) -> Column:
    return 0.45 * sat(broken, 0, 0.10) + 0.20 * sat(anchor_miss, 0, 0.10) + 0.15 * sat(bare, 0.05, 0.30) + 0.10 * sat(external, 0.60, 0.90) + 0.10 * sat(per_100_words, 6, 14)


def english_wording(passive, hedge, weasel, wordy, adverb, nominal, long_rate, cliche, illusions, nonwords) -> Column:
    loss = (
        0.18 * sat(passive, 0.25, 0.60) + 0.15 * sat(hedge, 0.02, 0.08) + 0.12 * sat(weasel, 0.01, 0.05) + 0.12 * sat(wordy, 0.01, 0.05) + 0.10 * sat(adverb, 0.02, 0.06)
        + 0.08 * sat(nominal, 0.08, 0.20) + 0.08 * sat(long_rate, 0.05, 0.30) + 0.07 * sat(cliche, 0.002, 0.02)
        + F.when(col(illusions) > 0, 0.05).otherwise(0.0) + F.when(col(nonwords) > 0, 0.05).otherwise(0.0)
    )
    return clamp01(1 - loss)


def section_balance(p95, large, tiny, skips, depth) -> Column:
    return 1 - 0.30 * sat(p95, 900, 2000) - 0.25 * sat(large, 0.05, 0.40) - 0.15 * sat(tiny, 0.20, 0.70) - 0.20 * sat(skips, 0.02, 0.20) - 0.10 * sat(F.abs(col(depth) - 3), 2, 5)


# ------------------------------------------------------------------ comparison
def trend(delta, higher_is_better: bool) -> Column:
    d = col(delta) if higher_is_better else -col(delta)
    return F.when(d > 0, "better").when(d < 0, "worse").otherwise("same")


def adverse(delta, higher_is_better: bool) -> Column:
    """How far a change goes the wrong way; 0 if it does not."""
    d = -col(delta) if higher_is_better else col(delta)
    return F.greatest(F.lit(0.0), d)
