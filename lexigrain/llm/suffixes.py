"""Suffix-array deduplication with a common-prefix interval tree.

An enhanced suffix array (suffixes in order and the lengths of the prefixes that neighbours share)
is scanned once with a stack; every interval that leaves the stack is a node of the tree: a string
with all its occurrences.  A node is a maximal repeat if its occurrences are preceded by different
bytes (or a beginning), else it only is the tail of a longer repeat.

No machine can hold the suffix array of a corpus, so suffixes are dealt out such that suffixes that
share their first ``length`` bytes meet: every window of ``length`` bytes is keyed by the smallest
hash among its ``GRAM``-byte grams, a value that equal windows share wherever they stand.  Runs of
windows with one key are fragments of fewer than ``2 * length`` bytes.  Three steps keep this
small: equal texts collapse into the copy with the smallest id; keys that occur in one text
only are dropped by an aggregation over keys; equal fragments collapse into one with its
smallest id before the arrays are built, so a passage in a third of all texts costs one fragment.
Arrays are built for batches of whole key groups, over all suffixes of ``length`` bytes or more up to the end of
their fragment.  A repeat that is longer than a run of one key is thus found in pieces, one for each run, whose
windows join without a gap.  The maximal repeats with all their occurrences are what :func:`repeats` returns,
and what :func:`duplicated_spans` derives the removal from: an occurrence is removed if its repeat also occurs in
an earlier document.

Edge cases: a null text is empty, empty texts and texts below ``length`` bytes lose nothing; rows
with a null id take no part and lose nothing; equal rows, and rows that share an id, do not count as
each other's earlier copy; matches never cross documents; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GRAM = 20
_EMPTY = hashlib.sha256(b"").hexdigest()
_P = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 18


# --------------------------------------------------------------------- the interval tree
def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Nodes ``(length, first, last)`` of the tree with ``length >= least``, children before parents.

    ``lcp[i]`` is the common prefix of the sorted suffixes ``i`` and ``i + 1``.
    """
    deep = np.concatenate([[False], lcp >= least, [False]])
    edge = np.flatnonzero(np.diff(deep.astype(np.int8)))
    begins, ends = edge[::2], edge[1::2]
    if not len(begins):
        return
    # Stretches below `least` part the tree; stretches of one length are a node each.
    bounds = np.stack([begins, ends], 1).ravel()
    padded = np.append(lcp, 0)
    low, high = np.minimum.reduceat(padded, bounds)[::2], np.maximum.reduceat(padded, bounds)[::2]
    for first, end, shallow, deepest in zip(begins.tolist(), ends.tolist(), low.tolist(), high.tolist()):
        if shallow == deepest:
            yield shallow, first, end
            continue
        stack: list[tuple[int, int]] = []
        for i, n in enumerate([*lcp[first:end].tolist(), 0], first):
            left = i
            while stack and stack[-1][0] > n:
                size, left = stack.pop()
                yield size, left, i
            if n >= least and (not stack or stack[-1][0] < n):
                stack.append((n, left))


def sort_suffixes(data: np.ndarray, end: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes that begin at ``starts``, and the common prefixes of neighbours.

    ``end`` holds for every byte where its text ends.  Ranks of 7 bytes (with their number, as a shorter suffix
    sorts before a longer one that it begins) combine to ranks of 14, 28, ... bytes; going back down the same ranks
    measures the common prefixes.
    """
    n = len(data)
    rem = end - np.arange(n)
    padded = np.concatenate([data, np.zeros(7, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for j in range(7):
        word = word << np.uint64(8) | np.where(j < rem, padded[j : j + n], np.uint64(0))
    word = word << np.uint64(8) | np.minimum(rem, 7).astype(np.uint64)
    levels, width = [np.unique(word, return_inverse=True)[1].astype(np.int64)], 7
    deepest = int(rem[starts].max()) if len(starts) else 0
    while width < deepest:
        r = levels[-1]
        after = np.zeros(n, np.int64)
        at = np.flatnonzero(rem > width)
        after[at] = r[at + width] + 1
        levels.append(np.unique(r * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
        width *= 2
    order = np.argsort(levels[-1][starts], kind="stable")
    s = starts[order]
    a, b = s[:-1].copy(), s[1:].copy()
    end_a, end_b = end[a], end[b]
    for r in reversed(levels):
        open_ = (a < end_a) & (b < end_b)
        same = open_ & (r[np.minimum(a, n - 1)] == r[np.minimum(b, n - 1)])
        step = np.where(same, np.minimum(width, end_a - a), 0)
        a, b, width = a + step, b + step, width // 2
    # The first words that differ: whole bytes alike, as far as both reach.
    open_ = (a < end_a) & (b < end_b)
    differ = np.where(open_, word[np.minimum(a, n - 1)] ^ word[np.minimum(b, n - 1)], np.uint64(0))
    alike, on = np.zeros(len(a), np.int64), open_.copy()
    for j in range(7):
        on &= differ >> np.uint64(56 - 8 * j) == 0
        alike += on
    return order, a - s[:-1] + np.minimum(alike, np.where(open_, np.minimum(end_a - a, end_b - b), 0))


def maximal_nodes(data: np.ndarray, end: np.ndarray, starts: np.ndarray, before: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes in order, and ``length, first, last`` of the nodes whose occurrences differ in the byte ``before`` them."""
    order, lcp = sort_suffixes(data, end, starts)
    nodes = np.array(list(intervals(lcp, least)), np.int64).reshape(-1, 3)
    left = before[order]
    changes = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
    nodes = nodes[changes[nodes[:, 2]] > changes[nodes[:, 1]]] if len(nodes) else nodes
    return order, nodes[:, 0], nodes[:, 1], nodes[:, 2]


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(length, [(text, start), ...])`` of all maximal repeats of at least ``least`` bytes, in memory."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    if not len(data):
        return []
    first = np.cumsum(size) - size
    text = np.repeat(np.arange(len(texts)), size)
    starts = np.arange(len(data))
    before = np.where(starts == first[text], -1 - text, np.concatenate([[-1], data[:-1].astype(np.int64)]))
    order, *nodes = maximal_nodes(data, (first + size)[text], starts, before, least)
    out = []
    for n, a, b in zip(*(x.tolist() for x in nodes)):
        out.append((n, sorted((int(text[i]), int(i - first[text[i]])) for i in order[a : b + 1])))
    return sorted(out)


# --------------------------------------------------------------------- keys and fragments
def window_keys(data: np.ndarray, length: int) -> np.ndarray:
    """For every window of ``length`` bytes the smallest hash among its grams."""
    n = len(data)
    if n < length:
        return np.empty(0, np.uint64)
    x = data.astype(np.uint64)
    h = np.zeros(n - GRAM + 1, np.uint64)
    # Doubling: hashes of 1, 2, 4, ... bytes combine to the hash of GRAM bytes.
    part, width, done, need = x + np.uint64(1), 1, 0, GRAM
    while need:
        if need & 1:
            shifted = part[done : done + len(h)]
            h = h * np.uint64(pow(int(_P), width, 1 << 64)) + shifted
            done += width
        need >>= 1
        if need:
            part = part[:-width] * np.uint64(pow(int(_P), width, 1 << 64)) + part[width:]
            width *= 2
    low, span, count = common.mix64(h), 1, length - GRAM + 1
    while span * 2 <= count:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = count - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def runs(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows with one key: keys, first windows, window counts."""
    data = np.frombuffer(text, np.uint8)
    keys, firsts = [], []
    last = None
    total = max(0, len(data) - length + 1)
    for at in range(0, total, _PIECE):
        k = window_keys(data[at : at + _PIECE + length - 1], length)
        new = np.concatenate([[last is None or k[0] != last], k[1:] != k[:-1]])
        last = k[-1]
        p = np.flatnonzero(new)
        keys.append(k[p])
        firsts.append(p + at)
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.concatenate(firsts)
    return np.concatenate(keys), first, np.diff(np.append(first, total))


def _group_repeats(rows: list[tuple[int, bytes, int]], length: int, named: bool) -> dict:
    """For every fragment ``(key, bytes, smallest id)`` of whole key groups the maximal repeats in it, as columns.

    ``starts, sizes``: where in the fragment; ``lows``: the smallest id that has the repeat; ``names``: hashes of the
    repeats' bytes.  Not ``named``, only those are given that tell which bytes an earlier document has: a repeat inside
    another one that an as early document has says nothing more.
    """
    data = np.frombuffer(b"".join(f for _, f, _ in rows), np.uint8)
    size = np.array([len(f) for _, f, _ in rows], np.int64)
    ids = np.array([d for _, _, d in rows], np.int64)
    first = np.cumsum(size) - size
    fragment = np.repeat(np.arange(len(rows)), size)
    end = (first + size)[fragment]
    starts = np.flatnonzero(end - np.arange(len(data)) >= length)
    of = fragment[starts]
    before = np.where(starts == first[of], -1 - of, data[starts - 1].astype(np.int64))
    order, n, a, b = maximal_nodes(data, end, starts, before, length)
    place, low = starts[order], ids[of[order]]
    # The fragment as a whole repeats if several documents have it.
    at, width, lows, names = first, size, ids, None
    if len(n):
        least = np.minimum.reduceat(np.append(low, 0), np.stack([a, b + 1], 1).ravel())[::2]
        if named:
            each = b - a + 1
            node = np.repeat(np.arange(len(n)), each)
            on = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + a[node]
        else:
            # Children come first: at one place a longer repeat tells all that a shorter one does, unless that is in an earlier document.
            told, picked = np.full(len(order), -1), []
            for i, j, m in zip(a.tolist(), (b + 1).tolist(), np.unique(least, return_inverse=True)[1].tolist()):
                part = told[i:j]
                picked.append(np.flatnonzero(part != m) + i)
                part[:] = m
            on, node = np.concatenate(picked), np.repeat(np.arange(len(n)), [len(x) for x in picked])
        at, width, lows = np.concatenate([at, place[on]]), np.concatenate([width, n[node]]), np.concatenate([lows, least[node]])
        if not named:
            # Of those that end together and are as early, the longest.
            by = np.lexsort([at, lows, at + width])
            at, width, lows = at[by], width[by], lows[by]
            stop = at + width
            keep = np.concatenate([[True], (stop[1:] != stop[:-1]) | (lows[1:] != lows[:-1])])
            at, width, lows = at[keep], width[keep], lows[keep]
    if named:
        raw = data.tobytes()
        names = np.array([xxhash.xxh3_64_intdigest(raw[i : i + k]) - (1 << 63) for i, k in zip(at.tolist(), width.tolist())], np.int64)
    by = np.argsort(fragment[at], kind="stable")
    at, width, lows, names = at[by], width[by], lows[by], names[by] if named else None
    cuts = np.searchsorted(fragment[at], np.arange(len(rows) + 1)).astype(np.int32)
    listed = lambda x, to=cuts: pa.ListArray.from_arrays(pa.array(to), pa.array(x))
    starts = at - np.repeat(first, np.diff(cuts))
    return {
        "key": [k for k, _, _ in rows],
        "frag": [f for _, f, _ in rows],
        "starts": listed(starts.astype(np.int32)),
        "sizes": listed(width.astype(np.int32)),
        "names": listed(names) if named else listed(np.empty(0, np.int64), np.zeros(len(rows) + 1, np.int32)),
        "lows": listed(lows),
        "least": np.minimum.reduceat(lows, cuts[:-1]),
    }


def _repeats(docs: DataFrame, length: int, named: bool) -> tuple[DataFrame, DataFrame]:
    """All rows ``(doc_id, tkey, n_bytes, sha256, first)``, and the repeats in texts that are no copies.

    ``first`` is the smallest id with the same text.  The second frame has a row for each fragment of a text, ``(doc_id,
    tkey, start, starts, sizes, names, lows)``, with the repeats in it as :func:`_group_repeats` gives them.
    """
    spark = common.tune(docs.sparkSession)
    base = common.texts(docs)

    def facts(batches):
        for b in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in b["text"].to_pylist()]
            yield {"doc_id": b["doc_id"], "tkey": [xxhash.xxh3_64_intdigest(r) - (1 << 63) for r in raw], "n_bytes": list(map(len, raw)), "sha256": [hashlib.sha256(r).hexdigest() for r in raw]}

    rows = common.stage(common.in_arrow(base, facts, "doc_id bigint, tkey bigint, n_bytes bigint, sha256 string"), "facts")
    firsts = rows.where("doc_id is not null").groupBy("sha256").agg(F.min("doc_id").alias("first"))
    facts_of = rows.join(firsts, "sha256", "left").select("doc_id", "tkey", "n_bytes", "sha256", "first")
    originals = common.Sieve(firsts, common.sieve_slot("first"))

    def anchors(batches):
        for b in batches:
            out_ids, out_keys = [], []
            ok = originals.passes(b["slot"].to_numpy())
            for i in np.flatnonzero(ok).tolist():
                keys = np.unique(runs(b["text"][i].as_py().encode("utf-8", "surrogatepass"), length)[0])
                out_keys.append(common.as_long(keys))
                out_ids.append(np.full(len(keys), b["doc_id"][i].as_py(), np.int64))
            if out_ids:
                yield {"doc_id": np.concatenate(out_ids), "key": np.concatenate(out_keys)}

    slotted = base.where("doc_id is not null").withColumn("slot", common.sieve_slot("doc_id"))
    met = common.in_arrow(slotted, anchors, "doc_id bigint, key bigint").repartition(common.partitions(spark), "key").sortWithinPartitions("key")

    def shared(batches):
        """Of rows in the order of keys, those whose key has several documents."""
        key, doc, several = None, None, False
        for b in batches:
            k, d = b["key"].to_numpy(), b["doc_id"].to_numpy()
            start = np.concatenate([[True], k[1:] != k[:-1]])
            first_at = np.flatnonzero(start)
            group = np.cumsum(start) - 1
            lo, hi = np.minimum.reduceat(d, first_at), np.maximum.reduceat(d, first_at)
            extra_d, extra_k = [], []
            if key is not None and k[0] == key:
                lo[0], hi[0] = min(lo[0], doc), max(hi[0], doc)
                if not several and lo[0] < hi[0]:  # the group's rows of the batch before were held back as one id
                    extra_d, extra_k = [doc], [key]
            many = lo < hi
            if key is not None and k[0] == key and several:
                many[0] = True
            keep = many[group]
            key, doc, several = int(k[-1]), int(d[-1]), bool(many[-1])
            yield {"doc_id": np.concatenate([d[keep], np.array(extra_d, np.int64)]), "key": np.concatenate([k[keep], np.array(extra_k, np.int64)])}

    hits = common.in_arrow(met, shared, "doc_id bigint, key bigint").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    hits = common.stage(hits, "hits")

    def fragments(batches):
        for b in batches:
            out = {"doc_id": [], "tkey": [], "start": [], "key": [], "frag": []}
            for doc_id, text, given in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["keys"]):
                raw = text.encode("utf-8", "surrogatepass")
                tkey = xxhash.xxh3_64_intdigest(raw) - (1 << 63)
                keys, first, count = runs(raw, length)
                signed = common.as_long(keys)
                for i in np.flatnonzero(np.isin(signed, given.values.to_numpy())).tolist():
                    at, n = int(first[i]), int(count[i])
                    out["doc_id"].append(doc_id)
                    out["tkey"].append(tkey)
                    out["start"].append(at)
                    out["key"].append(int(signed[i]))
                    out["frag"].append(raw[at : at + n + length - 1])
            yield out

    where = _texts_of(base, hits)
    cut = common.stage(common.in_arrow(where.join(hits, "doc_id"), fragments, "doc_id bigint, tkey bigint, start bigint, key bigint, frag binary"), "fragments")
    unique = cut.groupBy("key", "frag").agg(F.min("doc_id").alias("low"))
    dealt = unique.repartition(common.partitions(spark), "key").sortWithinPartitions("key")

    def solve(batches):
        held: list[tuple[int, bytes, int]] = []
        size = 0

        for b in batches:
            for row in zip(b["key"].to_pylist(), b["frag"].to_pylist(), b["low"].to_pylist()):
                if size > 60_000 and row[0] != held[-1][0]:
                    yield _group_repeats(held, length, named)
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
        if held:
            yield _group_repeats(held, length, named)

    schema = "key bigint, frag binary, starts array<int>, sizes array<int>, names array<bigint>, lows array<bigint>, least bigint"
    solved = common.in_arrow(dealt, solve, schema).withColumn("fkey", F.xxhash64("frag")).drop("frag")
    return facts_of, cut.select("doc_id", "tkey", "start", "key", F.xxhash64("frag").alias("fkey")).join(solved, ["key", "fkey"])


def repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """``repeat, size, doc_id, tkey, start``: every maximal repeat of at least ``length`` bytes (by a hash of its bytes) with all its
    occurrences, in byte places of texts, texts that are copies of an earlier one left out."""
    _, found = _repeats(docs, length, True)
    each = found.select("doc_id", "tkey", "start", F.explode(F.arrays_zip("starts", "sizes", "names")).alias("x"))
    rows = common.stage(each.select(F.col("x.names").alias("repeat"), F.col("x.sizes").alias("size"), "doc_id", "tkey", (F.col("start") + F.col("x.starts")).alias("start")).distinct(), "occurrences")
    several = rows.groupBy("repeat", "size").agg(F.count("*").alias("n")).where("n > 1").select("repeat", "size")
    return rows.join(several, ["repeat", "size"], "left_semi")


def duplicated_spans(docs: DataFrame, length: int = 50) -> tuple[DataFrame, DataFrame]:
    """All rows ``(doc_id, tkey, n_bytes, sha256, first)`` and, for texts that are no copies, ``(doc_id, tkey, spans)``.

    ``spans`` are begins and ends of occurrences of repeats that an earlier document has too.
    """
    facts_of, found = _repeats(docs, length, False)

    def mark(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "tkey": b["tkey"], "spans": marked_spans(b)}

    known = found.where("least < doc_id").select("doc_id", "tkey", "start", "starts", "sizes", "lows")
    marked = common.in_arrow(known, mark, "doc_id bigint, tkey bigint, spans array<bigint>")
    spans = marked.groupBy("doc_id", "tkey").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return facts_of, common.stage(spans, "spans")


def marked_spans(b: dict) -> pa.Array:
    """Of every row the begins and ends of what its ``starts`` and ``sizes`` cover, by repeats whose ``lows`` are below its id."""
    n = len(b["doc_id"])
    row = np.repeat(np.arange(n), b["starts"].value_lengths().to_numpy())
    doc_id, start = b["doc_id"].to_numpy(), b["start"].to_numpy()
    on = b["lows"].flatten().to_numpy() < doc_id[row]
    row, begin = row[on], b["starts"].flatten().to_numpy()[on].astype(np.int64)
    end = begin + b["sizes"].flatten().to_numpy()[on]
    by = np.lexsort((begin, row))
    row, begin, end = row[by], begin[by], end[by]
    # Rows one after another on one line, far enough apart not to touch; then a span begins where nothing before it reaches.
    wide = int(end.max(initial=0)) + 2
    reach = np.maximum.accumulate(end + row * wide) if len(row) else end
    new = np.ones(len(row), bool)
    new[1:] = (begin + row * wide)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row))[: len(first)] - 1
    of = row[first]
    ends = np.stack([begin[first] + start[of], reach[last] - of * wide + start[of]], 1).ravel()
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], 2 * np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)), pa.array(ends))


def _texts_of(base: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of the ids, and of few others, so that a join does not shuffle the rest."""
    sieve = common.Sieve(ids, common.sieve_slot("doc_id"))

    def run(batches):
        for b in batches:
            at = np.flatnonzero(sieve.passes(b["slot"].to_numpy()))
            yield {"doc_id": b["doc_id"].take(at), "text": b["text"].take(at)}

    return common.in_arrow(base.where("doc_id is not null").withColumn("slot", common.sieve_slot("doc_id")), run, "doc_id bigint, text string")


def keep(raw: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of ``raw``, bytes removed, and maximal runs removed."""
    on = np.zeros(len(raw) + 1, np.int32)
    np.add.at(on, spans[::2], 1)
    np.add.at(on, spans[1::2], -1)
    gone = np.cumsum(on)[:-1] > 0
    n_runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), n_runs


def deduplicate(docs: DataFrame, length: int = 50) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    facts_of, spans = duplicated_spans(docs, length)

    def cut(batches):
        for b in batches:
            out = {"doc_id": [], "tkey": [], "removed": [], "runs": [], "kept": []}
            for doc_id, text, tkey, s in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["tkey"].to_pylist(), b["spans"]):
                raw = text.encode("utf-8", "surrogatepass")
                if xxhash.xxh3_64_intdigest(raw) - (1 << 63) == tkey:
                    left, removed, n = keep(raw, s.values.to_numpy())
                    for name, v in zip(out, (doc_id, tkey, removed, n, hashlib.sha256(left).hexdigest())):
                        out[name].append(v)
            yield out

    changed = common.in_arrow(_texts_of(common.texts(docs), spans).join(spans, "doc_id"), cut, "doc_id bigint, tkey bigint, removed bigint, runs bigint, kept string").dropDuplicates(["doc_id", "tkey"])
    all_rows = facts_of.join(changed, ["doc_id", "tkey"], "left")
    copy = F.coalesce((F.col("first") < F.col("doc_id")) & (F.col("n_bytes") >= length), F.lit(False))
    return all_rows.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("kept", "sha256")).alias("kept_sha256"),
    )
