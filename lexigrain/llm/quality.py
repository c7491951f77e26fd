"""Quality classifier: generalised additive model with pairwise interactions.

Each text becomes a vector of numeric features.  A feature is cut into at most ``bins`` bins at its
quantiles, and the model is an intercept plus one lookup table per feature plus one two-way table
for each chosen pair of features, so scoring is a vectorised sum of table entries.  The tables are
learned by cyclic gradient boosting on the logistic loss: in every round each feature in turn adds
a shrunken shallow tree (a few leaves over neighbouring bins) fitted to the current residuals;
pairs are then ranked by how much residual variance a tree over their grid explains, and the
best ones are boosted the same way.

Fitting uses at most ``max_rows`` labelled rows (a documented bound; rows are taken by a hash of
their id, whole texts).

Edge cases: null and empty texts are scored on their all-zero features; rows with a null id are
scored and never learned from; null labels are ignored; several labels for one id count each;
without labels of both kinds the score is the share of label 1 (0.5 without any); repeated rows
are scored each; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FEATURES = (
    "log_chars", "log_words", "word_len", "upper", "punct", "symbol", "bang", "digit", "pipe", "space",
    "distinct_words", "top_word", "adjacent_equal", "long_words", "short_words", "words_with_symbol",
    "lines", "line_words", "repeated_lines", "stops_per_word", "compression", "non_ascii", "shout_words", "capital_words", "distinct_pairs",
)
_SYMBOLS, _PUNCT = b"#$%&*@^~<>{}[]\\=+_`", b".,;:!?'\"()-"
_UPPER = bytes(range(65, 91))


def _share(data: bytes, kinds: bytes) -> int:
    return len(data) - len(data.translate(None, kinds))


def features(text: str | None) -> list[float]:
    """The features of one text, each finite; see FEATURES."""
    data = (text or "").encode("utf-8", "surrogatepass")
    ws = data.split()
    if not ws:
        return [0.0] * len(FEATURES)
    n, w = len(data), len(ws)
    count = Counter(ws)
    lines = [x for x in data.split(b"\n") if x.strip()]
    lens = np.fromiter(map(len, ws), np.int64, w)
    letters = data.translate(None, _PUNCT + _SYMBOLS + b"|0123456789")
    joined = b" ".join(ws)
    bare = joined.translate(None, _SYMBOLS)
    return [
        np.log1p(n), np.log1p(w), float(lens.mean()), _share(data, _UPPER) / max(len(letters), 1), _share(data, _PUNCT) / n, _share(data, _SYMBOLS) / n,
        data.count(b"!") / w, _share(data, b"0123456789") / n, data.count(b"|") / w, (n - int(lens.sum())) / n,
        len(count) / w, max(count.values()) / w, sum(map(bytes.__eq__, ws, ws[1:])) / w, float((lens > 14).mean()), float((lens < 4).mean()), sum(map(bytes.__ne__, joined.split(b" "), bare.split(b" "))) / w,
        len(lines) / w, float(np.log1p(w / len(lines))), 1 - len(set(lines)) / len(lines), (data.count(b". ") + data.count(b".\n") + data.endswith(b".")) / w, len(zlib.compress(data, 1)) / (n + 20), _share(data, bytes(range(128, 256))) / n,
        sum(map(bytes.isupper, ws)) / w, sum(1 for x in ws if 65 <= x[0] <= 90) / w, len(set(zip(ws, ws[1:]))) / max(w - 1, 1),
    ]


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(total: np.ndarray, weight: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A shallow tree over ordered bins: values per bin from greedy splits of the gain G²/H."""
    g, h = np.concatenate([[0], np.cumsum(total)]), np.concatenate([[0], np.cumsum(weight)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    cuts = [0, len(total)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                m = np.arange(a + 1, b)
                won = gain(a, m) + gain(m, b) - gain(a, b)
                i = int(np.argmax(won))
                if won[i] > best[0]:
                    best = (won[i], int(m[i]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(total))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _grid_tree(total: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """A tree of depth two over a grid: the best cut of the rows, then of the columns on either side."""
    best, won = None, -1.0
    for cut in range(1, total.shape[0]):
        out, score = np.zeros_like(total), 0.0
        for part in (slice(0, cut), slice(cut, None)):
            row = _tree(total[part].sum(0), weight[part].sum(0), 2, ridge)
            out[part] = row
            score += float((row * total[part].sum(0)).sum())
        if score > won:
            best, won = out, score
    return np.zeros_like(total) if best is None else best


def boost(x: np.ndarray, y: np.ndarray, bins: int = 24, rounds: int = 120, pairs: int = 6, rate: float = 0.15, leaves: int = 3, ridge: float = 2.0) -> dict:
    """Fit the tables to features ``x`` and labels ``y`` (0 or 1)."""
    p0 = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    model = {"base": float(np.log(p0 / (1 - p0))), "edges": [], "tables": [], "pairs": []}
    if not len(y) or y.min() == y.max():
        return model
    edges = [_edges(x[:, j], bins) for j in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    size = [len(e) + 1 for e in edges]
    tables = [np.zeros(n) for n in size]
    f = np.full(len(y), model["base"])
    grad = lambda: (y - (p := 1 / (1 + np.exp(-f))), p * (1 - p))
    for _ in range(rounds):
        for j in range(len(edges)):
            if size[j] > 1:
                r, h = grad()
                step = rate * _tree(np.bincount(at[j], r, size[j]), np.bincount(at[j], h, size[j]), leaves, ridge)
                tables[j] += step
                f += step[at[j]]
    coarse = [np.minimum(a * 6 // n, 5) for a, n in zip(at, size)]
    r, h = grad()
    rank = []
    for i in range(len(edges)):
        for j in range(i):
            cell = coarse[i] * 6 + coarse[j]
            g, w = np.bincount(cell, r, 36).reshape(6, 6), np.bincount(cell, h, 36).reshape(6, 6)
            t = _grid_tree(g, w, ridge)
            rank.append((float((t * g).sum()), i, j))
    chosen = [(i, j) for _, i, j in sorted(rank, reverse=True)[:pairs]]
    grids = [np.zeros((6, 6)) for _ in chosen]
    for _ in range(rounds // 3):
        for k, (i, j) in enumerate(chosen):
            r, h = grad()
            cell = coarse[i] * 6 + coarse[j]
            step = rate * _grid_tree(np.bincount(cell, r, 36).reshape(6, 6), np.bincount(cell, h, 36).reshape(6, 6), ridge)
            grids[k] += step
            f += step[coarse[i], coarse[j]]
    return model | {"edges": edges, "tables": tables, "pairs": [(i, j, g) for (i, j), g in zip(chosen, grids)]}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of label 1 by bin additions."""
    f = np.full(len(x), model["base"])
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model["edges"])]
    for a, t in zip(at, model["tables"]):
        f += t[a]
    for i, j, g in model["pairs"]:
        f += g[np.minimum(at[i] * 6 // len(model["tables"][i]), 5), np.minimum(at[j] * 6 // len(model["tables"][j]), 5)]
    return 1 / (1 + np.exp(-f))


def _with_features(rows: DataFrame, *keep: str) -> DataFrame:
    def run(batches):
        for b in batches:
            yield {k: b[k] for k in keep} | {"x": [features(t) for t in b["text"].to_pylist()]}

    kinds = {"doc_id": "bigint", "label": "int"}
    return common.in_arrow(rows.select(*keep, "text"), run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", x array<double>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, folds: int = 5) -> dict:
    """Learn from labelled rows outside fold 0; ``max_rows`` bounds what the driver receives."""
    common.tune(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(common.fold("doc_id", folds) != 0)
    draw = F.xxhash64("doc_id", F.lit(5))
    marks = marks.orderBy(draw, "doc_id", "label").limit(max_rows)
    found = common.texts(docs).join(F.broadcast(marks), "doc_id")  # at most max_rows rows of two numbers
    got = _with_features(found, "doc_id", "label").select("label", "x").toArrow()
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = got["label"].to_numpy().astype(np.float64)
    order = np.lexsort([*x.T, y])  # the order of arrival must not matter
    return boost(x[order], y[order])


def apply(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, score`` of every row."""
    spark = common.tune(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)  # some thousand numbers

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b["text"].to_pylist()])
            yield {"doc_id": b["doc_id"], "score": score(held.value, x)}

    return common.in_arrow(common.texts(docs), run, "doc_id bigint, score double")


def keep(docs: DataFrame, model: dict, cut: float) -> DataFrame:
    """The rows, all columns kept, whose score is at least ``cut``; one pass, no shuffle."""
    import pyarrow as pa

    spark = common.tune(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(score(held.value, x) >= cut))

    return docs.mapInArrow(run, docs.schema)
