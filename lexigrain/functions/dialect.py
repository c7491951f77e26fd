"""SQL text for two engines: Spark SQL, which runs the document plans, and DuckDB, which checks them.

A plan is written once, over the few functions whose names or literals differ; everything else is
plain SQL that both read alike.
"""

from __future__ import annotations


class Spark:
    """Spark SQL."""

    text = "STRING"

    @staticmethod
    def pattern(p: str) -> str:
        return f"r'{p}'"

    def replace(self, s: str, p: str, r: str) -> str:
        return f"regexp_replace({s}, {self.pattern(p)}, '{r.replace(chr(92), '$')}')"

    def like(self, s: str, p: str) -> str:
        return f"({s} RLIKE {self.pattern(p)})"

    def every(self, s: str, p: str, group: int = 0) -> str:
        return f"regexp_extract_all({s}, {self.pattern(p)}, {group})"

    def extract(self, s: str, p: str, group: int = 0) -> str:
        return f"regexp_extract({s}, {self.pattern(p)}, {group})"

    @staticmethod
    def script(name: str) -> str:
        """A script's letters, inside a character class."""
        return rf"\p{{Is{name}}}"

    @staticmethod
    def array(*xs: str) -> str:
        return f"array({', '.join(xs)})"

    @staticmethod
    def item(a: str, i: int) -> str:
        return f"try_element_at({a}, {i})"

    @staticmethod
    def size(a: str) -> str:
        return f"size({a})"

    @staticmethod
    def lines(s: str) -> str:
        return f"split({s}, '\\n', -1)"

    @staticmethod
    def exploded(source: str, keep: str, array: str, value: str, place: str) -> str:
        """One row an element; places count from 1."""
        return f"SELECT {keep}, {place} + 1 AS {place}, {value} FROM {source} LATERAL VIEW posexplode({array}) x AS {place}, {value}"

    @staticmethod
    def quantile(x: str, q: float) -> str:
        return f"percentile({x}, {q})"

    @staticmethod
    def ranked(x: str, q: float) -> str:
        return f"percentile_disc({q}) WITHIN GROUP (ORDER BY {x})"

    @staticmethod
    def joined(x: str, order: str, by: str) -> str:
        """The values of a group in an order, as one text."""
        return f"array_join(transform(array_sort(collect_list(struct({order}, {x} AS v__))), e -> e.v__), '{by}')"


class Duck(Spark):
    """DuckDB."""

    text = "VARCHAR"

    @staticmethod
    def pattern(p: str) -> str:
        return f"'{p}'"

    def replace(self, s: str, p: str, r: str) -> str:
        return f"regexp_replace({s}, '{p}', '{r}', 'g')"

    def like(self, s: str, p: str) -> str:
        return f"regexp_matches({s}, '{p}')"

    @staticmethod
    def script(name: str) -> str:
        return rf"\p{{{name}}}"

    @staticmethod
    def array(*xs: str) -> str:
        return f"[{', '.join(xs)}]"

    @staticmethod
    def item(a: str, i: int) -> str:
        return f"({a})[{i}]"

    @staticmethod
    def size(a: str) -> str:
        return f"len({a})"

    @staticmethod
    def lines(s: str) -> str:
        return f"string_split({s}, chr(10))"

    @staticmethod
    def exploded(source: str, keep: str, array: str, value: str, place: str) -> str:
        return f"SELECT {keep}, generate_subscripts({array}, 1) AS {place}, unnest({array}) AS {value} FROM {source}"

    @staticmethod
    def quantile(x: str, q: float) -> str:
        return f"quantile_cont({x}, {q})"

    @staticmethod
    def ranked(x: str, q: float) -> str:
        return f"quantile_disc({x}, {q})"

    @staticmethod
    def joined(x: str, order: str, by: str) -> str:
        return f"string_agg({x}, '{by}' ORDER BY {order})"


SPARK, DUCK = Spark(), Duck()


def num(x: float) -> str:
    """A double, not a decimal, in both engines."""
    return f"{x!r}e0"


def clamp(x: str) -> str:
    return f"least(1e0, greatest(0e0, {x}))"


def sat(x: str, lo: float, hi: float) -> str:
    """0 up to ``lo``, 1 from ``hi`` on, a line between."""
    return clamp(f"(({x}) - {num(lo)}) / {num(hi - lo)}")


def per(a: str, b: str) -> str:
    """``a / b``, or 0 where ``b`` is 0."""
    return f"(CASE WHEN ({b}) = 0 THEN 0e0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"


def weighted(*terms: tuple[float, str]) -> str:
    return "(" + " + ".join(f"{num(w)} * ({x})" for w, x in terms) + ")"


def flag(condition: str) -> str:
    return f"(CASE WHEN {condition} THEN 1 ELSE 0 END)"
