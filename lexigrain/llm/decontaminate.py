"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are compared as sequences of words.  Items share seeds (runs of
``seed`` words) with a document or are never looked at: the seed hashes of all items go into a
bitmap of fixed size, a scan of the documents keeps those that hit it together with the hits, and
an equi-join on the hit hashes yields the candidate pairs, whatever the size of the
benchmark.  Tiles that cover a share ``threshold`` of an item's ``m`` words start at
``threshold * m / seed`` of its places at least, so its most frequent seeds, on fewer places than that, need not be
joined: a pair that reaches the threshold shares another one.  A candidate pair is tiled greedily:
running Karp-Rabin hashes find the longest common run of at least ``seed`` words, it is
marked, and the search repeats on what is not yet marked on
either side.  Tiles may lie in any order, so reordered passages are covered too.  The coverage of an
item is the share of its words under tiles; a document is contaminated if one item reaches
``threshold``.

Edge cases: null and empty texts match nothing; an item of fewer than ``seed`` words (but one at
least) is sought as one run of all its words; equal items are tiled once and all reported; rows
that share an id are tiled each and reported once for the id, with the best coverage, by :func:`contaminated`, and
each for itself by :func:`contaminated_rows`; of equally long runs the one that comes first in the document, then in
the item, is marked; rows with a null id are returned as clean; extra columns are ignored; an empty benchmark leaves every
document clean.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

_BASE = np.uint64(0x9E3779B97F4A7C15)
_EDGES = b".,;:!?\"'()[]{}|"


def tokens(text: str) -> np.ndarray:
    """Hashes of the words, punctuation at their ends dropped."""
    return common.word_hashes([x for w in common.words(text) if (x := w.strip(_EDGES))])


def running(h: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``width`` words, each from its neighbour's prefix sums."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    # Polynomial prefix hashes modulo 2**64 with an odd base: hash(i, w) = (S[i+w] - S[i]) * base**-i.
    n = len(h)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(h * power[:n], dtype=np.uint64)])
        return common.mix64((sums[width:] - sums[: n - width + 1]) * inverse[: n - width + 1])


def seeds(h: np.ndarray, seed: int) -> np.ndarray:
    return np.unique(running(h, min(seed, len(h)))) if len(h) else np.empty(0, np.uint64)


def _longest(doc: np.ndarray, item: np.ndarray, free_doc: np.ndarray, free_item: np.ndarray, least: int, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The length of the longest common run of unmarked words up to ``most`` (0 if below ``least``), where in the document
    such runs begin, and the hashes of all runs of that length in the document and the item."""

    def open_runs(h: np.ndarray, free: np.ndarray, n: int) -> np.ndarray:
        marked = np.concatenate([[0], np.cumsum(~free)])
        return marked[n:] == marked[: len(h) - n + 1]

    def shared(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if n > min(len(doc), len(item)):
            return None
        x, y = running(doc, n), running(item, n)
        on = np.isin(x, y[open_runs(item, free_item, n)]) & open_runs(doc, free_doc, n)
        return (np.flatnonzero(on), x, y) if on.any() else None

    low, high, best = least - 1, most + 1, None
    while high - low > 1:
        mid = (low + high) // 2
        if (found := shared(mid)) is not None:
            low, best = mid, found
        else:
            high = mid
    return (low, *best) if best else (0, doc[:0], doc[:0], doc[:0])


def tile(doc: np.ndarray, item: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(start in doc, start in item, length)``, longest first."""
    least = min(seed, len(item))
    if not least or len(doc) < least:
        return []
    # Words outside every seed are as good as marked; what stays is cut together around them.
    on = np.flatnonzero(np.isin(running(doc, least), running(item, least)))
    edge = np.zeros(len(doc) + 1, np.int64)
    np.add.at(edge, on, 1)
    np.add.at(edge, on + least, -1)
    inside = np.cumsum(edge)[:-1] > 0
    near = inside.copy()
    near[1:] |= inside[:-1]
    place = np.flatnonzero(near)
    part, free_doc, free_item = doc[place], inside[place], np.ones(len(item), bool)
    out, most = [], min(len(part), len(item))
    while most >= least:
        n, on, x, y = _longest(part, item, free_doc, free_item, least, most)
        if not n:
            break
        at: dict[int, list[int]] = {}
        for j in range(len(y) - 1, -1, -1):
            at.setdefault(int(y[j]), []).append(j)
        for i in on.tolist():
            if free_doc[i : i + n].all():
                todo = at[int(x[i])]
                while todo:  # marked places never become free again
                    j = todo[-1]
                    if free_item[j : j + n].all():
                        if (part[i : i + n] == item[j : j + n]).all():
                            free_doc[i : i + n] = free_item[j : j + n] = False
                            out.append((int(place[i]), j, n))
                        break
                    todo.pop()
        most = n - 1
    return out


def coverage(doc: np.ndarray, item: np.ndarray, seed: int) -> float:
    return sum(n for _, _, n in tile(doc, item, seed)) / len(item) if len(item) else 0.0


def matches(docs: DataFrame, benchmark: DataFrame, seed: int = 5, threshold: float = 0.0) -> DataFrame:
    """``doc_id, tkey, item_id, coverage`` of pairs that share a seed; pairs below the threshold may be left out."""
    common.tune(docs.sparkSession)
    base = common.texts(docs).where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("item")).where("item_id is not null")
    texts = common.stage(items.groupBy("item").agg(F.min("item_id").alias("first")), "items")

    def item_seeds(batches):
        for b in batches:
            out = {"first": [], "seed": [], "width": [], "places": [], "spare": []}
            for first, text in zip(b["first"].to_pylist(), b["item"].to_pylist()):
                t = tokens(text)
                s, places = np.unique(running(t, min(seed, len(t))), return_counts=True) if len(t) else (np.empty(0, np.uint64), [])
                out["first"] += [first] * len(s)
                out["seed"] += common.as_long(s).tolist()
                out["width"] += [min(seed, len(t))] * len(s)
                out["places"] += list(places)
                # Places that may go unnoticed: fewer than tiles of the threshold's total length need.
                out["spare"] += [max(int(np.ceil(threshold * len(t) / max(1, min(seed, len(t))) - 1e-9)) - 1, 0)] * len(s)
            yield out

    sown = common.stage(common.in_arrow(texts, item_seeds, "first bigint, seed bigint, width int, places bigint, spare bigint"), "seeds")
    widths = sorted(r.width for r in sown.select("width").distinct().collect())  # at most `seed` values
    sieve = common.Sieve(sown, common.key_slot("seed"))

    def hits(batches):
        for b in batches:
            out = {"doc_id": [], "tkey": [], "text": [], "hits": []}
            for doc_id, tkey, text in zip(b["doc_id"].to_pylist(), b["tkey"].to_pylist(), b["text"].to_pylist()):
                t = tokens(text)
                found = [x for w in widths if len(x := common.as_long(running(t, w)))]
                s = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
                s = s[sieve.passes(np.mod(s, 1 << common.SIEVE_LOG))]
                if len(s):
                    for name, v in zip(out, (doc_id, tkey, text, s)):
                        out[name].append(v)
            yield out

    near = common.stage(common.in_arrow(base, hits, "doc_id bigint, tkey bigint, text string, hits array<bigint>"), "near")
    hit = near.select("doc_id", "tkey", F.explode("hits").alias("seed"))
    often = hit.groupBy("seed").agg(F.count("*").alias("docs"))
    by_rarity = Window.partitionBy("first").orderBy(F.desc("docs"), "seed")  # the seeds of one item
    ranked = sown.join(often, "seed").withColumn("upto", F.sum("places").over(by_rarity))
    needed = common.stage(ranked.where("upto > spare").select("first", "seed"), "needed")
    pairs = common.stage(hit.join(needed, "seed").select("doc_id", "tkey", "first").distinct(), "pairs")
    todo = pairs.join(texts, "first").join(near.select("doc_id", "tkey", "text").dropDuplicates(["doc_id", "tkey"]), ["doc_id", "tkey"])

    def cover(batches):
        last, t = None, None
        for b in batches:
            out = []
            for text, item in zip(b["text"].to_pylist(), b["item"].to_pylist()):
                if text != last:  # the pairs of a document follow each other
                    last, t = text, tokens(text)
                out.append(coverage(t, tokens(item), seed))
            yield {"doc_id": b["doc_id"], "tkey": b["tkey"], "first": b["first"], "coverage": out}

    covered = common.in_arrow(todo.select("doc_id", "tkey", "first", "text", "item"), cover, "doc_id bigint, tkey bigint, first bigint, coverage double").where(F.col("coverage") >= threshold)
    same = items.join(texts, "item").select("first", "item_id")
    return covered.join(same, "first").select("doc_id", "tkey", "item_id", "coverage")


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, seed: int = 5, threshold: float = 0.5) -> DataFrame:
    """``doc_id, tkey, coverage, items`` of rows, named by id and hash of the text, in which some item reaches the threshold."""
    found = matches(docs, benchmark, seed, threshold)
    return found.groupBy("doc_id", "tkey").agg(F.max("coverage").alias("coverage"), F.sort_array(F.collect_set("item_id")).alias("items"))


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = 5, threshold: float = 0.5) -> DataFrame:
    """``doc_id, coverage, items``: documents in which some item reaches the threshold."""
    found = matches(docs, benchmark, seed, threshold)
    return found.groupBy("doc_id").agg(F.max("coverage").alias("coverage"), F.sort_array(F.collect_set("item_id")).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, seed: int = 5, threshold: float = 0.5) -> DataFrame:
    """``doc_id, contaminated, coverage, items`` of every row (coverage 0 and no items where clean)."""
    found = common.stage(contaminated(docs, benchmark, seed, threshold), "contaminated")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found, "doc_id", "left")
    return out.select("doc_id", F.col("coverage").isNotNull().alias("contaminated"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))
