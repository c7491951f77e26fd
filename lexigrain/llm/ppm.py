"""Language-model scoring by prediction by partial matching, with a unigram word model beside it.

The byte model is a trie of contexts of up to ``ORDER`` bytes with the counts of the bytes that
follow each.  A byte is coded in the longest context that training holds; a context of total T with q
distinct successors gives a successor seen n times n/(T+q) and escapes with q/(T+q) (escape method
C) to the next shorter context, in which all successors already considered are excluded; below
the empty context lies the uniform distribution over what is not excluded.  Byte 0xFF, which UTF-8
never holds, ends a text, so the model is a distribution over whole texts.

No context that training holds is left out, so the model grows with the corpus and is never held in
one place.  A block of at most ``BLOCK`` bytes of text sends its distinct runs of ``ORDER + 1`` bytes
(context and byte) once, with their counts in training texts; sums of these are the counts of
order ``ORDER``, sums of their tails those of the shorter contexts.  As every successor of a context also
follows its tail, what escape and exclusion need of a context is its total, its number of
successors and what these sum to in its tail: each order is one join with the order below and
one window over contexts of at most 256 rows.  Blocks get the probabilities of their runs back by a join.

Word counts of the base score go the same way: a block sends its distinct words once to the sums,
and gets their counts back.  A word is known by a 64-bit hash.

Edge cases: a null text is empty (one end token); rows with a null id are scored and not
learned from; without training rows the base score is 0 a token and the byte model uniform;
repeated rows each count and are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

ORDER, BLOCK = 4, 16 << 20
_PAD, _END = 0xFE, 0xFF
_CHUNK = 1 << 20
_END_WORD = xxhash.xxh3_64_intdigest(b" ")  # no word holds a blank


# --------------------------------------------------------------------- byte model
def stream(text: str) -> bytes:
    return padded(lowered(text))


def padded(raw: bytes) -> bytes:
    return b"\xfe" * ORDER + raw + b"\xff"


def lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(common.LOWER)


def runs(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """All runs of ``ORDER + 1`` bytes in pieces: the place where the first of a piece begins, and the runs packed into numbers."""
    for at in range(0, len(data) - ORDER, _CHUNK):
        part = data[at : at + _CHUNK + ORDER].astype(np.int64)
        g = np.zeros(len(part) - ORDER, np.int64)
        for j in range(ORDER + 1):
            g = g << 8 | part[j : len(part) - ORDER + j]
        yield at, g


def probabilities(grams: DataFrame) -> DataFrame:
    """``g, lp``: log10 probabilities of the runs ``g, n``; ``n`` counts them in training texts and may be 0."""
    levels = [grams.select("g", "n")]
    for k in range(ORDER - 1, -1, -1):
        levels.insert(0, levels[0].groupBy(F.expr(f"g & {(1 << 8 * (k + 1)) - 1}L").alias("g")).agg(F.sum("n").alias("n")))
    known = F.col("n") > 0
    for k, level in enumerate(levels):
        if k:
            level = level.join(below, F.expr(f"g & {(1 << 8 * k) - 1}L") == F.col("tail"))  # noqa: F821
        # t, q: total and distinct successors of the context; e: the total of these successors in its tail.
        of = Window.partitionBy(F.shiftright("g", 8))
        e = F.sum(F.when(known, F.col("pn")).otherwise(0)).over(of) if k else F.lit(0)
        level = level.select("*", F.sum("n").over(of).alias("t"), F.sum(known.cast("long")).over(of).alias("q"), e.alias("e"))
        if k:
            # rest: the byte's probability after an escape, with the successors excluded below.
            t, q = F.col("pt") - F.col("e"), F.col("pq") - F.col("q")
            rest = F.when(F.col("pn") > 0, F.col("pn") / (t + q)).when(t > 0, q / (t + q) * F.col("prest")).otherwise(F.col("prest"))
            shorter = F.col("pp")
        else:
            rest = 1 / F.greatest(F.lit(255) - F.col("q"), F.lit(1))  # all bytes but _PAD
            shorter = rest
        level = level.withColumn("rest", F.when(~known, rest))
        whole = F.col("t") + F.col("q")
        level = level.withColumn("p", F.when(F.col("t") == 0, shorter).when(known, F.col("n") / whole).otherwise(F.col("q") / whole * F.col("rest")))
        below = level.select(F.col("g").alias("tail"), F.col("n").alias("pn"), F.col("t").alias("pt"), F.col("q").alias("pq"), F.col("rest").alias("prest"), F.col("p").alias("pp"))
    return level.select("g", F.log10("p").cast("float").alias("lp"))


# ------------------------------------------------------- the same in memory, for small texts
def table(levels: list[tuple[np.ndarray, np.ndarray]]) -> dict:
    """Log10 probabilities of every byte in every kept context, and the steps from context to context."""
    levels = [(np.array([0]), np.zeros((1, 256)))] if not len(levels[0][0]) else levels
    rows, suffix = [], [None]
    for k in range(1, len(levels)):
        suffix.append(np.searchsorted(levels[k - 1][0], levels[k][0] & ((1 << 8 * (k - 1)) - 1)))
    alphabet = np.arange(256) != _PAD
    for k, (keys, counts) in enumerate(levels):
        p = np.zeros(counts.shape, np.float32)
        for at in range(0, len(keys), 4096):
            idx = np.arange(at, min(at + 4096, len(keys)))
            out, mass, seen = np.zeros((len(idx), 256)), np.ones(len(idx)), np.zeros((len(idx), 256), bool)
            for j in range(k, -1, -1):
                c = levels[j][1][idx] * ~seen
                t, q = c.sum(axis=1), (c > 0).sum(axis=1)
                full = np.maximum(t + q, 1)
                out += (mass / full)[:, None] * c
                mass = np.where(t > 0, mass * q / full, mass)
                seen |= c > 0
                idx = suffix[j][idx] if j else idx
            left = alphabet & ~seen
            rest = left.sum(axis=1)
            out += np.where(left, (mass / np.maximum(rest, 1))[:, None], 0)
            p[at : at + len(out)] = np.log10(np.maximum(out, 1e-300))
        rows.append(p)
    model = {"base": np.cumsum([0] + [len(r) for r in rows]), "rows": np.concatenate(rows)}
    # Order 1 by its byte; longer contexts by the context of their first bytes and their last byte.
    steps = []
    for k in range(1, len(levels)):
        keys = levels[k][0]
        before = np.searchsorted(levels[k - 1][0], keys >> 8) if k > 1 else np.zeros(len(keys), np.int64)
        d = np.full((max(len(levels[k - 1][0]), 1), 256), -1, np.int32)
        d[before, keys & 0xFF] = np.arange(len(keys))
        steps.append(d)
    return model | {"steps": steps}


def log_probabilities(model: dict, texts: list[str]) -> np.ndarray:
    """The log10 probability of each text."""
    raw = list(map(stream, texts))
    ends = np.cumsum([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    lp = np.zeros(len(data))
    flat = model["rows"].reshape(-1)
    for at in range(0, len(data), _CHUNK):
        lo = max(0, at - ORDER)
        a = data[lo : at + _CHUNK]
        row = np.zeros(len(a), np.int64)
        # ctx[i]: the kept context of the current length that ends right before place i.
        ctx = np.zeros(len(a), np.int64)
        for k, step in enumerate(model["steps"], 1):
            longer = np.full(len(a), -1, np.int64)
            before = ctx[:-1]
            longer[1:] = np.where(before >= 0, step[np.maximum(before, 0), a[:-1]], -1)
            if k > 1:
                longer[: min(k, len(a))] = -1
            row = np.where(longer >= 0, model["base"][k] + longer, row)
            ctx = longer
        lp[at : at + _CHUNK] = flat[row * 256 + a][at - lo :]
    lp[data == _PAD] = 0
    return np.add.reduceat(lp, np.concatenate([[0], ends[:-1]])) if len(ends) else np.zeros(0)


# --------------------------------------------------------------------- blocks and scores
_DOCS, _WORDS, _GRAMS = range(3)


class _Tally:
    """Distinct numbers and how often training texts hold each."""

    def __init__(self) -> None:
        self.keys, self.counts, self.size, self.least = [], [], 0, 1 << 20

    def add(self, x: np.ndarray, train: bool) -> None:
        k, n = np.unique(x, return_counts=True)
        self.keys.append(k)
        self.counts.append(n if train else np.zeros(len(k), np.int64))
        self.size += len(k)
        if self.size > 2 * self.least:
            k, n = self.merged()
            self.keys, self.counts, self.size, self.least = [k], [n], len(k), max(self.least, len(k))

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        k, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        return k, np.bincount(at, np.concatenate(self.counts), len(k)).astype(np.int64)


def _tokens(raw: bytes) -> np.ndarray:
    return common.as_long(np.append(common.word_hashes(raw.split()), np.uint64(_END_WORD)))


def _blocks(docs: DataFrame) -> DataFrame:
    """Rows of three kinds: documents of one batch (``items``: ids, ``n``: sizes of their lower-cased texts, ``packed``: these,
    compressed), and the block's distinct words and runs (``items``: hashes or runs, ``n``: counts in training texts)."""

    def run(batches):
        from pyspark import TaskContext

        part, seq, size = TaskContext.get().partitionId(), 0, 0
        tallies = {_WORDS: _Tally(), _GRAMS: _Tally()}

        def out():
            for kind, tally in tallies.items():
                k, n = tally.merged()
                for i in range(0, len(k), 200_000):
                    s = slice(i, i + 200_000)
                    yield {"block": [part << 32 | seq], "kind": [kind], "items": [k[s]], "n": [n[s]], "held_out": [None], "packed": [None]}

        for b in batches:
            raw, train = list(map(lowered, b["text"].to_pylist())), b["train"].to_pylist()
            packed = pa.compress(b"".join(raw), "zstd", asbytes=True)
            yield {"block": [part << 32 | seq], "kind": [_DOCS], "items": [b["doc_id"].to_pylist()], "n": [list(map(len, raw))], "held_out": [b["held_out"].to_pylist()], "packed": [packed]}
            for which in (True, False):
                some = [r for r, t in zip(raw, train) if t == which]
                if some:
                    tallies[_WORDS].add(np.concatenate(list(map(_tokens, some))), which)
                    for _, g in runs(np.frombuffer(b"".join(map(padded, some)), np.uint8)):
                        tallies[_GRAMS].add(g[g & 0xFF != _PAD], which)  # not those that end in the padding of the next text
            size += sum(map(len, raw))
            if size > BLOCK:
                yield from out()
                seq, size, tallies = seq + 1, 0, {_WORDS: _Tally(), _GRAMS: _Tally()}
        if tallies[_WORDS].keys:
            yield from out()

    return common.in_arrow(docs, run, "block bigint, kind int, items array<bigint>, n array<bigint>, held_out array<boolean>, packed binary")


def score(docs: DataFrame, held_fold: int = 1, folds: int = 5) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    common.tune(docs.sparkSession)
    rows = common.texts(docs).withColumn("fold", common.fold("doc_id", folds))
    rows = rows.select("doc_id", "text", F.coalesce(F.col("fold") == held_fold, F.lit(False)).alias("held_out"), F.coalesce(F.col("fold") != held_fold, F.lit(False)).alias("train"))
    blocks = common.stage(_blocks(rows), "blocks")
    sent = {k: blocks.where(F.col("kind") == k).select("block", F.explode(F.arrays_zip("items", "n")).alias("i")).select("block", F.col("i.items").alias("item"), F.col("i.n").alias("n")) for k in (_WORDS, _GRAMS)}
    counts = common.stage(sent[_WORDS].groupBy("item").agg(F.sum("n").alias("c")).where("c > 0"), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    grams = common.stage(sent[_GRAMS].groupBy(F.col("item").alias("g")).agg(F.sum("n").alias("n")), "grams")
    model = common.stage(probabilities(grams), "model")
    common.discard(grams)
    floor = total + 0.5 * (distinct + 1)
    known = sent[_WORDS].join(counts, "item").select(F.col("block").alias("in_block"), F.lit(_WORDS).alias("kind"), "item", F.col("c").cast("double").alias("value"))
    known = known.union(sent[_GRAMS].join(model.withColumnRenamed("g", "item"), "item").select("block", F.lit(_GRAMS), "item", F.col("lp").cast("double")))

    def cover(docs_of: pa.Table, known_of: pa.Table) -> pa.Table:
        kind, item, value = (known_of[n].to_numpy() for n in ("kind", "item", "value"))

        def lookup(which: int):
            on = kind == which
            order = np.argsort(item[on])
            # One more entry, never equal, so that every search ends inside.
            keys, values = np.append(item[on][order], 0), np.append(value[on][order], 0.0)

            def find(x: np.ndarray) -> np.ndarray:
                at = np.searchsorted(keys[:-1], x)
                return np.where((keys[at] == x) & (at < len(keys) - 1), values[at], 0.0)

            return find

        count, log_p = lookup(_WORDS), lookup(_GRAMS)
        out = {n: [] for n in ("doc_id", "held_out", "n_tokens", "score", "n_known", "base_score")}
        for i in range(docs_of.num_rows):
            sizes = np.array(docs_of["n"][i].as_py(), np.int64)
            ends = np.cumsum(sizes)
            text = pa.decompress(docs_of["packed"][i].as_py(), int(ends[-1]), "zstd", asbytes=True)
            raw = [text[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
            tokens = list(map(_tokens, raw))
            lens = np.array(list(map(len, tokens)))
            first = np.cumsum(lens) - lens
            c = count(np.concatenate(tokens))
            data = np.frombuffer(b"".join(map(padded, raw)), np.uint8)
            lp = np.zeros(len(data))
            for at, g in runs(data):
                lp[at + ORDER : at + ORDER + len(g)] = log_p(g)
            lp[data == _PAD] = 0
            whole = sizes + ORDER + 1
            out["doc_id"] += docs_of["items"][i].as_py()
            out["held_out"] += docs_of["held_out"][i].as_py()
            out["n_tokens"] += lens.tolist()
            out["score"] += np.add.reduceat(lp, np.cumsum(whole) - whole).tolist()
            out["n_known"] += np.add.reduceat((c > 0).astype(np.int64), first).tolist()
            out["base_score"] += np.add.reduceat(np.log10((c + 0.5) / floor), first).tolist()
        types = {"held_out": pa.bool_(), "score": pa.float64(), "base_score": pa.float64()}
        return pa.table({n: pa.array(v, types.get(n, pa.int64())) for n, v in out.items()})

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, score double, n_known bigint, base_score double"
    parts = blocks.where(F.col("kind") == _DOCS).select("block", "items", "n", "held_out", "packed")
    done = parts.groupBy("block").cogroup(known.groupBy("in_block")).applyInArrow(cover, schema)
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
