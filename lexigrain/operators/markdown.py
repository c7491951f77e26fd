"""Markdown: a block parser emits nodes, document metrics are column expressions over them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..session import ship

NODES = "path string, node_id int, kind string, start_line int, end_line int, level int, info string, words int, links int, rows int, cols int, cells int, empty_cells int, nodes int, edges int, cycles int"
_NAMES = [f.split()[0] for f in NODES.split(", ")]
_DIAGRAMS = {"mermaid", "plantuml", "dot", "graphviz", "d2", "vega", "vega-lite"}
_LINK = re.compile(r"!?\[[^\]]*\]\([^)]*\)|<https?://[^>]+>")
_WORD = re.compile(r"[^\W_]+")


def diagram(text: str) -> tuple[int, int, int]:
    """Nodes, edges and independent cycles (edges - nodes + parts) of an arrow diagram."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    edges = 0
    for line in text.split("\n"):
        ends = [m[0] for p in re.split(r"\s*(?:-[-.=]*(?:\|[^|]*\|)?>+|={2,}>|-{2,})\s*", line) if (m := re.match(r"[\w.]+", p.strip()))]
        if len(ends) > 1 and re.search(r"--|->|==>", line):
            for a, b in zip(ends, ends[1:]):
                edges += 1
                root[find(a)] = find(b)
    parts = len({find(x) for x in list(root)})
    return len(root), edges, max(0, edges - len(root) + parts)


def blocks(text: str) -> list[dict]:
    """Block nodes: heading, paragraph, code, diagram, table, list item, quote, html, math, metadata, blank."""
    lines = text.replace("\r\n", "\n").split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    out, i = [], 0

    def add(kind: str, a: int, b: int, **more) -> None:
        body = "\n".join(lines[a:b])
        plain = _WORD.findall(re.sub(r"\]\([^)]*\)|<[^>]*>|`[^`]*`", " ", body)) if kind in ("heading", "paragraph", "item", "quote") else []
        out.append({"kind": kind, "start_line": a + 1, "end_line": b, "words": len(plain), "links": len(_LINK.findall(body)) if kind not in ("code", "diagram", "math") else 0} | more)

    if lines and lines[0] in ("---", "+++") and lines[0] in lines[1:]:
        i = lines.index(lines[0], 1) + 1
        add("metadata", 0, i)
    while i < len(lines):
        line, start = lines[i], i
        if not line.strip():
            add("blank", i, i + 1)
            i += 1
        elif m := re.match(r" {0,3}(`{3,}|~{3,})\s*([\w+-]*)", line):
            i += 1
            while i < len(lines) and not re.match(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[i]):
                i += 1
            i = min(i + 1, len(lines))
            info = m[2].lower()
            n, e, c = diagram("\n".join(lines[start + 1 : i - 1])) if info in _DIAGRAMS else (0, 0, 0)
            add("diagram" if info in _DIAGRAMS else "code", start, i, info=info, nodes=n, edges=e, cycles=c, rows=max(0, i - start - 2))
        elif m := re.match(r" {0,3}(#{1,6})(\s|$)", line):
            add("heading", i, i + 1, level=len(m[1]))
            i += 1
        elif line.strip().startswith("$$"):
            i += 1
            while i < len(lines) and "$$" not in lines[i]:
                i += 1
            i = min(i + 1, len(lines))
            add("math", start, i)
        elif re.match(r" {0,3}<(?!https?:)[a-zA-Z/!]", line):
            while i < len(lines) and lines[i].strip():
                i += 1
            add("html", start, i)
        elif "|" in line and i + 1 < len(lines) and re.match(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$", lines[i + 1]) and "-" in lines[i + 1]:
            while i < len(lines) and "|" in lines[i]:
                i += 1
            body = [[c.strip() for c in x.strip().strip("|").split("|")] for x in [lines[start], *lines[start + 2 : i]]]
            cells = [c for r in body for c in r]
            add("table", start, i, rows=len(body), cols=max(map(len, body)), cells=len(cells), empty_cells=sum(not c for c in cells))
        elif m := re.match(r"( *)([-*+]|\d+[.)])\s", line):
            i += 1
            while i < len(lines) and lines[i].startswith(" " * (len(m[1]) + 2)) and not re.match(r" *([-*+]|\d+[.)])\s", lines[i]):
                i += 1
            add("item", start, i, level=len(m[1]) // 2 + 1)
        elif line.lstrip().startswith(">"):
            while i < len(lines) and lines[i].lstrip().startswith(">"):
                i += 1
            add("quote", start, i)
        else:
            i += 1
            while i < len(lines) and lines[i].strip() and not re.match(r" {0,3}(#{1,6}\s|```|~~~|>|[-*+]\s|\d+[.)]\s)", lines[i]):
                i += 1
            add("paragraph", start, i)
    return out


def nodes(files: DataFrame) -> DataFrame:
    """Block nodes of Markdown files ``(path, text)``."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [{"path": p, "node_id": i} | b for p, t in zip(f["path"], f["text"]) for i, b in enumerate(blocks(t or ""))]
            out = pd.DataFrame(rows, columns=_NAMES)
            for c in _NAMES[1:]:
                out[c] = out[c].fillna("" if c == "info" else 0) if c != "kind" else out[c]
            yield out.astype({c: "int32" for c in _NAMES if c not in ("path", "kind", "info")})

    return files.select("path", "text").mapInPandas(run, NODES)


def metrics(files: DataFrame) -> DataFrame:
    """Counts, content units and cognitive load of every file, all-zero for an empty one; the scores are in ``operators.documents``."""
    n = nodes(files)
    k = F.col("kind")
    size = F.col("end_line") - F.col("start_line") + 1
    count = lambda *kinds: F.sum(k.isin(*kinds).cast("long"))
    span = lambda *kinds: F.sum(F.when(k.isin(*kinds), size).otherwise(0))
    code_load = F.when(k == "code", (1 + 0.08 * F.greatest(F.lit(0), F.col("rows") - 12)) + F.when(F.col("info") == "", 1.5).otherwise(0.0)).otherwise(0.0)
    table_load = F.when(k == "table", F.when(F.col("cells") > 60, 0.75 + 0.03 * F.pow(F.greatest(F.lit(0), F.col("cells") - 60), F.lit(0.85))).otherwise(0.75)).otherwise(0.0)
    read_load = code_load + table_load + F.when(k == "item", 0.5 * F.col("level")).when(k == "quote", 0.5).when(k == "math", 1.5).when(k == "diagram", 1.5).when(k == "html", F.least(F.lit(8.0), 0.3 * size)).otherwise(0.0) + 0.25 * F.col("links") + F.when((k == "paragraph") & (F.col("words") > 160), 1.25).otherwise(0.0)
    per = n.groupBy("path").agg(
        F.max("end_line").alias("dloc"), span("paragraph", "heading", "item", "quote").alias("ploc"), span("code").alias("cloc"), span("table").alias("tloc"), span("math").alias("mloc"), span("blank").alias("bloc"),
        F.sum("words").alias("words"), count("heading").alias("headings"), count("code").alias("fences"), F.sum(((k == "code") & (F.col("info") == "")).cast("long")).alias("unlabelled"), count("table").alias("tables"),
        count("diagram").alias("diagrams"), F.sum("links").alias("links"), F.max("cells").alias("max_cells"), F.sum("cells").alias("cells"), F.sum("nodes").alias("diagram_nodes"), F.sum("edges").alias("diagram_edges"), F.sum("cycles").alias("diagram_cycles"),
        span("html").alias("html_lines"), F.sum(read_load).alias("load"),
    )
    heads = n.where("kind = 'heading'").select("path", "level", "node_id")
    from pyspark.sql import Window

    prev = F.lag("level").over(Window.partitionBy("path").orderBy("node_id"))
    jump = heads.withColumn("jump", F.col("level") - prev).groupBy("path").agg(F.sum((F.col("jump") > 1).cast("long")).alias("skips"), F.sum(F.when(F.col("jump") == 1, 0.2).when(F.col("jump") > 1, 1.0).otherwise(0.0)).alias("heading_load"), F.max("level").alias("depth"))
    j = files.select("path").join(per, "path", "left").join(jump, "path", "left")
    j = j.select("path", *[F.coalesce(c, F.lit(0)).alias(c) for c in j.columns if c != "path"])
    ecu = F.col("words") / 240 + 0.35 * F.col("cloc") + 0.06 * F.col("cells") + 0.40 * F.col("diagram_nodes") + 0.25 * F.col("diagram_edges") + 0.12 * F.col("mloc") + 0.20 * F.col("html_lines")
    j = j.select("*", F.round(ecu, 6).alias("content_units"), F.round(F.col("load") + F.col("heading_load"), 6).alias("cognitive_complexity"))
    return j.drop("load", "heading_load").select("*", F.round(F.col("cloc") / F.greatest(F.col("dloc"), F.lit(1)), 6).alias("code_line_ratio"))
