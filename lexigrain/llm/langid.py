"""Language identification by error-correcting output codes.

Every language gets a codeword; one binary n-gram classifier predicts each bit.  A classifier is
the log-likelihood ratio of hashed character n-grams (1 to 3 bytes of the case-folded text)
between the languages whose bit is 1 and those whose bit is 0, averaged over the text.  Decoding
adds, over the bits, a logistic loss of the bit's margin against the codeword's bit, weighted by
how well that bit separated the training documents, and takes the codeword of least loss; the
second-best codeword within ``ambiguity`` of the best flags the document as ambiguous.

The n-gram counts come from at most ``per_language`` training documents of each language (a
documented bound; documents are taken by the order of a hash of their id, whole texts).  The model
has ``2**BUCKETS_LOG`` weights for each bit, whatever the corpus.

Edge cases: null text, and text without a letter, gives ``und`` with score 0; rows with a null id
are predicted and never learned from; rows with a null language are predicted only; repeated rows
are predicted each; no training rows at all gives ``und`` everywhere; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS_LOG = 15
_B = 1 << BUCKETS_LOG
_PIECE = 1 << 18


def grams(data: np.ndarray) -> list[np.ndarray]:
    """Bucket numbers of all 1- to 3-byte grams, bucketed apart from each other."""
    x = data.astype(np.uint32)
    out = [x]
    if len(x) > 1:
        pairs = x[:-1] << 8 | x[1:]
        out.append(256 + (pairs * np.uint32(2654435761) >> np.uint32(32 - 13)))
    if len(x) > 2:
        triples = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
        out.append(_B // 2 + (triples * np.uint32(2654435761) >> np.uint32(33 - BUCKETS_LOG)))
    return out


#: ASCII other than letters becomes a blank, bytes of other characters are kept.
_WIDE = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def folded(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_WIDE).split()) + b" "


def has_letter(text: str, data: bytes) -> bool:
    """Whether the text has a letter of any script."""
    return any(97 <= c <= 122 for c in data[:64]) or any(map(str.isalpha, text))


def counts_of(data: bytes) -> np.ndarray:
    total = np.zeros(_B, np.float64)
    a = np.frombuffer(data, np.uint8)
    for at in range(0, len(a), _PIECE):  # pieces overlap by what a gram reaches over
        for k, g in enumerate(grams(a[at : at + _PIECE + 2])):
            total += np.bincount(g[: _PIECE] if len(g) > _PIECE else g, minlength=_B)
    return total


def codewords(n: int) -> np.ndarray:
    """``n`` rows of -1 and 1: all distinct splits for few languages, else far-apart random rows."""
    if n <= 6:
        bits = [[1 if j == 0 or (b >> (j - 1)) & 1 else -1 for j in range(n)] for b in range((1 << (n - 1)) - 1)]
        return np.array(bits or [[1]], np.float64).T.copy() if n > 1 else np.ones((1, 1))
    rng, width, best = np.random.default_rng(7), int(np.ceil(10 * np.log2(n))), None
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (n, width))
        far = min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i))
        if best is None or far > best[0]:
            best = (far, m)
    keep = [j for j in range(width) if abs(best[1][:, j].sum()) < n]
    return best[1][:, keep]


def fit(docs: DataFrame, per_language: int = 4000, folds: int = 5) -> dict:
    """The model: languages, codewords, bit weights and n-gram weights ``(buckets, bits)``."""
    spark = common.tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where("doc_id is not null and lang is not null and text is not null").where(common.fold("doc_id", folds) != 0)
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    langs = sorted(sizes)
    if not langs:
        return {"langs": []}
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_language / sizes[lang]))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw <= share[F.col("lang")]).select("lang", "text").repartition(min(8, common.partitions(spark)))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist()):
                c = counts_of(folded(text))
                # Each document weighs the same whatever its length, up to a square root.
                c /= np.sqrt(max(c.sum(), 1.0))
                total[lang] = total.get(lang, 0) + c
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield {"lang": [lang] * len(at), "gram": at.astype(np.int32), "n": c[at]}

    table = np.full((len(langs), _B), 0.0)
    place = {lang: i for i, lang in enumerate(langs)}
    got = common.in_arrow(sample, count, "lang string, gram int, n double").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    for b in got.groupBy("lang").agg(F.collect_list("gram").alias("g"), F.collect_list("n").alias("n")).toLocalIterator():
        table[place[b.lang], b.g] = b.n
    code = codewords(len(langs))
    # Buckets of each gram length are a distribution of their own.
    parts = [slice(0, 256), slice(256, _B // 2), slice(_B // 2, _B)]
    weights = np.zeros((_B, code.shape[1]), np.float32)
    probs = np.zeros_like(table)
    for p in parts:
        c = table[:, p] + 1e-3
        probs[:, p] = c / c.sum(axis=1, keepdims=True)
    sharp = np.zeros(code.shape[1])
    for j in range(code.shape[1]):
        one, two = probs[code[:, j] > 0].mean(axis=0), probs[code[:, j] <= 0]
        llr = np.log(one) - np.log(two.mean(axis=0) if len(two) else one)
        weights[:, j] = np.clip(llr, -4, 4)
        sharp[j] = sum(abs((probs[i] * llr).sum()) for i in range(len(langs))) / len(langs)
    sharp /= max(sharp.sum(), 1e-9)
    return {"langs": langs, "code": code, "weights": weights, "bit_weight": sharp}


def predict(model: dict, texts: list[str | None], slope: float = 8.0) -> list[tuple[str, float, float]]:
    """For each text the language, its share of the decoding scores, and the lead over the second."""
    out = []
    for text in texts:
        if not model["langs"] or text is None or not has_letter(text, data := folded(text)):
            out.append(("und", 0.0, 0.0))
            continue
        a, total, n = np.frombuffer(data, np.uint8), 0.0, 0
        counts = counts_of(data) if len(a) > 4096 else None
        if counts is not None:
            total, n = counts @ model["weights"], counts.sum()
        else:
            for g in grams(a):
                total, n = total + model["weights"][g].sum(axis=0, dtype=np.float64), n + len(g)
        margin = slope * total / max(n, 1)
        loss = (np.log1p(np.exp(np.clip(-model["code"] * margin, -50, 50))) * model["bit_weight"]).sum(axis=1)
        p = np.exp(-slope * (loss - loss.min()))
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        out.append((model["langs"][order[0]], float(p[order[0]]), float(p[order[0]] - p[order[1]]) if len(p) > 1 else 1.0))
    return out


def identify(docs: DataFrame, model: dict, ambiguity: float = 0.1) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` of every row."""
    spark = common.tune(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)  # 2**BUCKETS_LOG weights a bit

    def run(batches):
        for b in batches:
            got = predict(held.value, b["text"].to_pylist())
            yield {"doc_id": b["doc_id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "ambiguous": [g[0] == "und" or g[2] < ambiguity for g in got]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.in_arrow(rows, run, "doc_id bigint, lang_pred string, score double, ambiguous boolean")
