"""MinHash near-deduplication with circulant permutations and exact Jaccard verification.

Two fixed permutations of the 32-bit universe are enough for a whole signature: the first
scatters a shingle, the second is applied after a circular shift by 0, 1, 2, ... and every shift
gives one signature coordinate, its minimum over the document's shingles.  Coordinates are cut
into bands; documents that agree in a band are candidates; a candidate pair becomes a link only
if its full shingle sets satisfy ``den * |A & B| >= num * |A | B|``.

Copies collapse first: documents with equal shingle sets are one class, represented by the
smallest id.  Within a bucket not all pairs are formed.  Every bucket has a hub, the member that shares
the most candidates.  First each class meets the one hub that it shares the most buckets with; then,
of the hubs in components other than its own, the best one of each component; then the hubs that are
still elsewhere.  Buckets whose other members by then lie in one component are finished, because further
links in them could change nothing.  In those left, two more hubs from different components are compared
with the rest, which finishes buckets of up to four members; what still lies apart after that is compared pair by
pair in small buckets, where that is asked for, and otherwise goes
through an exact prefix filter over full sets, which misses no link between components.

With 32 bands of 4 rows a pair at similarity 0.8 escapes all buckets with probability 5e-8.

Edge cases: a null or empty text, or one without words, has an empty set and links with nothing;
a text of fewer than ``k`` words is one shingle; rows that share an id count as one document
(linked to each other if their sets are not empty) in :func:`near_duplicates`, and stand for themselves
in :func:`copies`, which names rows by id and text; rows with a null id are returned with their
set size, a null component and ``kept`` true; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_U32 = np.uint32


def _permute(v: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of 32-bit values, in place."""
    v ^= v >> _U32(16)
    v *= _U32(a)
    v ^= v >> _U32(13)
    v *= _U32(b)
    v ^= v >> _U32(16)
    return v


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """``size`` circulant MinHash coordinates of a set of 64-bit shingle hashes."""
    scattered = _permute((hashes ^ (hashes >> np.uint64(32))).astype(_U32), 0x85EBCA6B, 0xC2B2AE35)
    shift = np.arange(size, dtype=_U32)[:, None]
    out = np.full(size, 0xFFFFFFFF, _U32)
    for at in range(0, len(scattered), 1024):
        part = scattered[None, at : at + 1024] - shift
        np.minimum(out, _permute(part, 0x7FEB352D, 0x846CA68B).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key per band; keys of different bands differ."""
    acc = np.arange(1, bands + 1, dtype=np.uint64)
    for col in sig[: bands * rows].reshape(bands, rows).T:
        acc = common.mix64(acc * np.uint64(0x9E3779B97F4A7C15) + col)
    return acc


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, tkey, n, digest, bands``: hash of the text, set size, digest of the set (null when empty), bucket keys."""

    def run(batches):
        for b in batches:
            n, digest, keys = [], [], []
            for text in b["text"].to_pylist():
                s = common.distinct(common.shingles(common.words(text), k))
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(packed(band_keys(signature(s, bands * rows), bands, rows)[None])[0] if len(s) else None)
            yield {"doc_id": b["doc_id"], "tkey": b["tkey"], "n": n, "digest": digest, "bands": keys}

    keyed = docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    return common.in_arrow(keyed, run, "doc_id bigint, tkey bigint, n bigint, digest binary, bands binary")


def _sets(docs: DataFrame, wanted: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """``rep, items`` for the nodes asked for; only their texts are hashed again, and no text is shuffled."""
    asked = wanted.select(F.col("rep").alias("wanted"))
    ids = classes.join(asked, F.col("node") == F.col("wanted")).select("wanted", F.col("digest").alias("of"), F.col("rep").alias("id"))
    ids = common.stage(ids, "wanted")
    sieve = common.Sieve(ids, common.sieve_slot("id"))

    def run(batches):
        for b in batches:
            at = np.flatnonzero(sieve.passes(b["slot"].to_numpy()))
            doc_ids, found = b["doc_id"].take(at), b["text"].take(at)
            sets = [common.distinct(common.shingles(common.words(t), k)) for t in found.to_pylist()]
            yield {"doc_id": doc_ids, "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "items": [common.as_long(s) for s in sets]}

    rows = docs.where("doc_id is not null").withColumn("slot", common.sieve_slot("doc_id"))
    made = common.in_arrow(rows, run, "doc_id bigint, digest binary, items array<bigint>")
    exact = made.join(ids, (F.col("doc_id") == F.col("id")) & (F.col("digest") == F.col("of"))).select(F.col("wanted").alias("rep"), "items")
    return exact.dropDuplicates(["rep"])


def link(docs: DataFrame, k: int = 4, num: int = 80, den: int = 100, bands: int = 32, rows: int = 4, by_id: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows with their set's digest, classes ``(digest, rep, node)``, and components ``(id, comp)`` of linked nodes.

    With ``by_id``, classes that hold rows of one id hang together.
    """
    common.tune(docs.sparkSession)
    base = common.texts(docs)
    signed = common.stage(signatures(base, k, bands, rows), "signatures")
    known = signed.where("n > 0 and doc_id is not null")
    named = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    # An id that is the smallest of several classes names one of them; the others get a name of their own.
    several = named.groupBy("rep").agg(F.count("*").alias("c"), F.min("digest").alias("one")).where("c > 1").select("rep", "one")
    node = F.when(F.coalesce(F.col("one") == F.col("digest"), F.lit(True)), F.col("rep")).otherwise(F.xxhash64("digest"))
    classes = common.stage(named.join(several, "rep", "left").select("digest", "rep", "n", node.alias("node")), "classes")
    first = classes.select(F.col("digest").alias("of"), F.col("rep").alias("id"), F.col("node").alias("rep"))
    banded = known.join(first, (F.col("digest") == F.col("of")) & (F.col("doc_id") == F.col("id"))).select(F.array("rep").alias("reps"), F.array("n").alias("ns"), "bands")
    given = None
    if by_id:
        twice = known.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("doc_id")
        of = known.select("doc_id", "digest").join(twice, "doc_id", "left_semi").join(classes, "digest").select("doc_id", "node")
        given = of.join(of.groupBy("doc_id").agg(F.min("node").alias("low")), "doc_id").select(F.col("low").alias("a"), F.col("node").alias("b"))
    comps = connect(banded, lambda ids: _sets(base, ids, classes.select("digest", "rep", "node"), k), num, den, given)
    return signed, classes, comps


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, alike=None) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets reach the similarity.

    With ``alike``, which makes a function that tells of two lists of texts which pairs reach it, ``items`` are texts: far fewer bytes to move.
    """
    left, right = (sets.select(F.col("rep").alias(x), F.col("items").alias(f"i{x}")) for x in "ab")
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    if alike is None:
        na, nb = F.size("ia"), F.size("ib")
        both = both.withColumn("i", F.size(F.array_intersect("ia", "ib")))
        return both.where(F.col("i") * den >= num * (na + nb - F.col("i"))).select("a", "b")

    def run(batches):
        test = alike()
        for b in batches:
            at = np.flatnonzero(test(b["ia"].to_pylist(), b["ib"].to_pylist()))
            yield {"a": b["a"].take(at), "b": b["b"].take(at)}

    return common.in_arrow(both.select("a", "b", "ia", "ib"), run, "a bigint, b bigint")


#: Slots of the table that orders items: its size is fixed (4 MB), whatever the number of items.
_ORDER_LOG, _CHUNK_LOG = 20, 14


def _item_order(rows: DataFrame, cut) -> np.ndarray:
    """For every slot of items 0 if its items occur in one component only, else how often they occur.

    Any order that all rows share serves the prefix filter, so items may share a slot.
    """
    mask, low = np.uint64((1 << _ORDER_LOG) - 1), (1 << _CHUNK_LOG) - 1

    def count(batches):
        n = np.zeros(1 << _ORDER_LOG, np.int64)
        lo, hi = np.full(1 << _ORDER_LOG, 2**63 - 1), np.full(1 << _ORDER_LOG, -(2**63))
        for b in batches:
            for c, t in zip(b["c"].to_pylist(), _items(b, cut)):
                at = (t & mask).astype(np.int64)
                np.add.at(n, at, 1)
                lo[at], hi[at] = np.minimum(lo[at], c), np.maximum(hi[at], c)
        full = np.flatnonzero(n)
        ends = np.searchsorted(full >> _CHUNK_LOG, np.arange((1 << (_ORDER_LOG - _CHUNK_LOG)) + 1))
        for i, (x, y) in enumerate(zip(ends[:-1], ends[1:])):
            if x < y:
                at = full[x:y]
                yield {"chunk": [i], "slots": [at & low], "n": [n[at]], "lo": [lo[at]], "hi": [hi[at]]}

    def merge(batches):
        held: dict[int, tuple] = {}
        for b in batches:
            for i, chunk in enumerate(b["chunk"].to_pylist()):
                at, n, lo, hi = (b[x][i].values.to_numpy() for x in ("slots", "n", "lo", "hi"))
                a = held.setdefault(chunk, (np.zeros(low + 1, np.int64), np.full(low + 1, 2**63 - 1), np.full(low + 1, -(2**63))))
                a[0][at] += n
                a[1][at], a[2][at] = np.minimum(a[1][at], lo), np.maximum(a[2][at], hi)
        for chunk, (n, lo, hi) in held.items():
            yield {"chunk": [chunk], "rank": [np.where(lo < hi, np.minimum(n, 2**31 - 1), 0).astype("<i4").tobytes()]}

    spark = rows.sparkSession
    parts = common.in_arrow(rows, count, "chunk bigint, slots array<bigint>, n array<bigint>, lo array<bigint>, hi array<bigint>")
    whole = common.in_arrow(parts.repartition(common.partitions(spark), "chunk"), merge, "chunk bigint, rank binary")
    order = np.zeros(1 << _ORDER_LOG, np.int32)
    for r in whole.collect():  # 64 rows of 64 KB
        order[r.chunk << _CHUNK_LOG : (r.chunk + 1) << _CHUNK_LOG] = np.frombuffer(bytes(r.rank), "<i4")
    return order


def _items(b: dict, cut) -> list[np.ndarray]:
    if cut is not None:
        return cut(b["items"].to_pylist())
    return [x.values.to_numpy().view(np.uint64) for x in b["items"]]


def _posts(rows: DataFrame, order: np.ndarray, num: int, den: int, cut) -> DataFrame:
    """``rep, c, n, rest, t, small, k``: the items under which a set must be sought, and the class of sizes there.

    ``n`` is the size of the set, ``rest`` how many of its items may still be shared from ``t`` on.
    """
    held = rows.sparkSession.sparkContext.broadcast(order)
    mask = np.uint64((1 << _ORDER_LOG) - 1)

    def size_class(n: np.ndarray) -> np.ndarray:
        return np.floor(np.log(np.maximum(n, 1)) / np.log(1.06)).astype(np.int64)

    def run(batches):
        for b in batches:
            out: dict[str, list] = {x: [] for x in ("rep", "c", "n", "rest", "t", "small", "k")}
            for rep, c, t in zip(b["rep"].to_pylist(), b["c"].to_pylist(), _items(b, cut)):
                n = len(t)
                often = held.value[(t & mask).astype(np.int64)]
                some = np.flatnonzero(often)
                # Items of one component come first in the order and are shared with no other.
                rest = len(some) - np.arange(len(some))
                some = some[np.lexsort((t[some], often[some]))]
                ahead = rest * den >= num * n
                rest, some = rest[ahead], some[ahead]
                least = int(size_class(np.array([-(-num * n // den)]))[0])
                most = np.maximum(size_class(np.minimum(n, rest * (num + den) // num - n)), least)
                short = rest * (num + den) >= 2 * num * n
                each = most - least + 1
                at = np.concatenate([np.flatnonzero(short), np.repeat(np.arange(len(rest)), each)])
                k = np.concatenate([np.repeat(size_class(np.array([n])), short.sum()), np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + least])
                small = np.arange(len(at)) < short.sum()
                for x, v in (("rep", np.full(len(at), rep)), ("c", np.full(len(at), c)), ("n", np.full(len(at), n)), ("rest", rest[at]), ("t", common.as_long(t[some[at]])), ("small", small), ("k", k)):
                    out[x].append(v)
            yield {x: np.concatenate(v) for x, v in out.items()}

    return common.in_arrow(rows, run, "rep bigint, c bigint, n bigint, rest bigint, t bigint, small boolean, k bigint")


#: 64-bit words of a set's parities.
_WORDS = 8


def parities(t: np.ndarray) -> np.ndarray:
    """For every slot of a hash whether an odd number of the set's items fall into it, as ``_WORDS`` words.

    What two sets share cancels, so their parities differ in no more slots than there are items in only one of them.
    """
    at = (common.mix64(t) % np.uint64(64 * _WORDS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * _WORDS) & 1).astype(np.uint8)).view("<i8")


def all_parities(sets: list[np.ndarray]) -> np.ndarray:
    """:func:`parities` of many sets, a row each."""
    bits, size = 64 * _WORDS, np.array([len(t) for t in sets])
    at = np.repeat(np.arange(len(sets)) * bits, size) + (common.mix64(np.concatenate(sets)) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits * len(sets)) & 1).astype(np.uint8)).view("<i8").reshape(-1, _WORDS)


def _marks(rows: DataFrame, cut) -> DataFrame:
    """``rep, m, b0, b1, ...``: size and parities of every set."""

    def run(batches):
        for b in batches:
            sets = _items(b, cut)
            words = all_parities(sets)
            yield {"rep": b["rep"], "m": [len(t) for t in sets]} | {f"b{i}": words[:, i] for i in range(_WORDS)}

    return common.in_arrow(rows, run, "rep bigint, m bigint, " + ", ".join(f"b{i} bigint" for i in range(_WORDS)))


def _named(marks: DataFrame, x: str) -> DataFrame:
    return marks.select(*(F.col(c).alias(f"{c}{x}") for c in marks.columns))


def _close(num: int, den: int) -> "F.Column":
    """Whether sizes and parities of ``a`` and ``b`` leave the similarity possible."""
    differ = " + ".join(f"bit_count(b{i}a ^ b{i}b)" for i in range(_WORDS))
    return F.expr(f"{den} * least(ma, mb) >= {num} * greatest(ma, mb) and ({differ}) * {num + den} <= {den - num} * (ma + mb)")


def _placed(rows: DataFrame, comps: DataFrame, of: str, name: str) -> DataFrame:
    """``rows`` with the component of the node ``of`` as column ``name``."""
    known = comps.select(F.col("id").alias("__node"), F.col("comp").alias("__comp"))
    return rows.join(known, F.col(of) == F.col("__node"), "left").withColumn(name, F.coalesce("__comp", of)).drop("__node", "__comp")


def _fits(x: str, y: str, num: int, den: int) -> "F.Column":
    """Whether sets of these sizes can reach the similarity."""
    return F.expr(f"{den} * least({x}, {y}) >= {num} * greatest({x}, {y})")


def _divided(members: DataFrame, n: int, comps: DataFrame) -> DataFrame:
    """``h, rep, n, c, lo, hi`` of buckets whose members beside their hub lie in several components, with two of these to be hubs."""

    def others(batches):
        def tables():
            for b in batches:
                for raw in b["cells"].to_pylist():
                    h, rep, size, p, _ = t = common.table(raw, 5)
                    t = t[:3, rep != p]
                    new = common.changes(t[0])
                    yield t[:, np.diff(np.append(np.flatnonzero(new), len(new)))[np.cumsum(new) - 1] > 1]

        yield from common.deal(tables(), 1, n)

    def placed(batches):
        t, known = common.gathered(batches, 3, 2)
        ok, at = common.looked_up(t[1], known)
        c = t[1].copy()
        c[ok] = known[1][at[ok]]
        yield from common.deal(iter([np.concatenate([t, c[None]])]), 0, n)

    def ends(batches):
        (t,) = common.gathered(batches, 4)
        h, rep, size, c = t = t[:, np.lexsort((t[2], t[1], t[3], t[0]))]
        new = common.changes(h)
        first = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        last = np.append(first[1:], len(h))[: len(first)] - 1
        lo, hi = first[of], last[of]
        on = c[lo] < c[hi]
        named = {"h": h, "rep": rep, "n": size, "c": c, "lo_c": c[lo], "lo_rep": rep[lo], "lo_n": size[lo], "hi_c": c[hi], "hi_rep": rep[hi], "hi_n": size[hi]}
        yield {k: v[on] for k, v in named.items()}

    both = common.in_arrow(members, others, common.DEALT).union(_by_id(comps, 1, n))
    met = common.in_arrow(common.to_slots(both, n), placed, common.DEALT)
    out = common.in_arrow(common.to_slots(met, n), ends, ", ".join(f"{x} bigint" for x in ("h", "rep", "n", "c", "lo_c", "lo_rep", "lo_n", "hi_c", "hi_rep", "hi_n")))
    of = lambda x: F.struct(*(F.col(f"{x}_{c}").alias(c) for c in ("c", "rep", "n"))).alias(x)
    return out.select("h", "rep", "n", "c", of("lo"), of("hi"))


def _by_id(comps: DataFrame, kind: int, n: int) -> DataFrame:
    """Components, dealt by their nodes."""
    return common.in_arrow(comps.select("id", "comp"), lambda batches: common.deal((np.stack([b["id"].to_numpy(), b["comp"].to_numpy()]) for b in batches), 0, n, kind), common.DEALT)


def _rest(left: DataFrame, sets: DataFrame, num: int, den: int, cut=None) -> DataFrame:
    """Pairs ``(a, b)`` that may still link two components, for members ``rep, c`` of buckets that stay divided.

    An exact filter, so no bucket is compared pair by pair.  Items are put into one order: first those
    that occur in a single component, then roughly by rising frequency.  If two sets are similar enough, their
    first common item stands near the beginning of both: what follows it must hold the overlap.  The
    smaller set therefore offers a short prefix, the larger one a longer prefix for every class of
    sizes its partner may have.  Under each key the rows of its most frequent component are not
    compared with each other.  Of those that meet, only pairs go on whose parities do not rule out the similarity.
    """
    held = common.stage(left.join(sets, "rep").select("rep", "c", "items"), "held")
    posts = common.stage(_posts(held, _item_order(held, cut), num, den, cut), "posts")
    marks = common.stage(_marks(held, cut).drop("m"), "marks")
    common.discard(held)
    per = posts.groupBy("t", "k", "c").agg(F.count("*").alias("f"), F.max("small").alias("any"), F.min("small").alias("all"))
    tops = per.groupBy("t", "k").agg(F.max_by("c", "f").alias("top"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("any").alias("any"), F.min("all").alias("all")).where("lo < hi and any and not all")
    rows = posts.join(tops.select("t", "k", "top"), ["t", "k"]).withColumn("top", F.col("c") == F.col("top"))
    rows = common.stage(rows.join(marks, "rep"), "rows")
    words = [f"b{i}" for i in range(_WORDS)]
    a = rows.where("small").select("t", "k", *(F.col(x).alias(f"{x}a") for x in ("rep", "c", "n", "rest", "top", *words)))
    b = rows.where("not small").select("t", "k", *(F.col(x).alias(f"{x}b") for x in ("rep", "c", "n", "rest", "top", *words)))
    differ = " + ".join(f"bit_count({w}a ^ {w}b)" for w in words)
    fits = F.expr(f"na <= nb and ca <> cb and least(resta, restb) * {num + den} >= {num} * (na + nb) and ({differ}) * {num + den} <= {den - num} * (na + nb)")

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.join(y, ["t", "k"]).where(fits).select(F.least("repa", "repb").alias("a"), F.greatest("repa", "repb").alias("b"))

    pairs = common.stage(meet(a.where("not topa"), b).union(meet(a.where("topa"), b.where("not topb"))).distinct(), "pairs")
    common.discard(posts, rows, marks)
    return pairs


def _inside(left: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``(a, b)`` of members ``h, rep, c`` of one bucket that lie in several components, but those that their marks rule out."""
    marked = left.select("h", "rep", "c").join(marks, "rep")
    x, y = (marked.select("h", *(F.col(c).alias(f"{c}{r}") for c in marked.columns if c != "h")) for r in "ab")
    return x.join(y, "h").where("repa < repb and ca <> cb").where(_close(num, den)).select(F.col("repa").alias("a"), F.col("repb").alias("b")).distinct()


#: Bytes of a bucket's name.  Two buckets that share one by chance are a few more pairs to test, and no link more.
_NAME = 5
#: Low bits of a word that tell the members of a bucket apart while the buckets are sought; the others name the bucket.
_TELL = 12


def packed(keys: np.ndarray) -> list[bytes]:
    """Bucket names of rows of 64-bit keys, one after another."""
    cut = np.ascontiguousarray(keys, "<u8").view(np.uint8).reshape(*keys.shape, 8)[:, :, :_NAME]
    return [r.tobytes() for r in cut]


def _wide(raw: np.ndarray) -> np.ndarray:
    """Numbers from rows of their low bytes."""
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : raw.shape[1]] = raw
    return out.view("<i8").ravel()


def _bands(b: dict) -> np.ndarray:
    return _wide(np.frombuffer(b"".join(b["bands"].to_pylist()), np.uint8).reshape(-1, _NAME))


def longs(x: pa.Array) -> np.ndarray:
    """The numbers of arrays, or of their bytes, one after another."""
    if pa.types.is_list(x.type):
        return x.flatten().to_numpy()
    return np.frombuffer(b"".join(x.to_pylist()), "<i8")


def _steps(words: np.ndarray) -> bytes:
    """Rising words of 56 bits as their differences, lowest bytes first: the high bytes hardly differ and take little when compressed."""
    return np.diff(words, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :7].T.tobytes()


def _words(raw: bytes) -> np.ndarray:
    return np.cumsum(_wide(np.frombuffer(raw, np.uint8).reshape(7, -1).T))


def _shared(banded: DataFrame) -> DataFrame:
    """``h, m``: the buckets that have several members, and how many values the bits of these take.

    Keys travel as arrays, one for each slot and some batches, so that a row is a thousand keys and not one; a
    task then holds the distinct keys of its slots.  A word is a bucket and some bits of its member, so a member
    that was posted by several tasks does not make a bucket of its own.
    """
    slots = 4 * common.partitions(banded.sparkSession)
    bounds = np.arange(slots + 1) * -(-(1 << (8 * _NAME + _TELL)) // slots)

    def deal(batches):
        held, size = [], 0

        def out():
            w = common.distinct(np.concatenate(held))
            ends = np.searchsorted(w, bounds)
            full = np.flatnonzero(np.diff(ends))
            return {"slot": full, "keys": [_steps(w[ends[i] : ends[i + 1]]) for i in full]}

        for b in batches:
            h, reps = _bands(b), longs(b["reps"])
            of = np.repeat(reps, len(h) // max(len(reps), 1)).view(np.uint64)
            tell = common.mix64(of ^ h.view(np.uint64)) >> np.uint64(64 - _TELL)
            held.append(h << _TELL | tell.view(np.int64))
            size += len(h)
            if size > 1_000_000:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def several(batches):
        known, held, size = np.empty(0, np.int64), [], 0
        for b in batches:
            held += [_words(x) for x in b["keys"].to_pylist()]
            size += sum(map(len, held[-len(b["keys"]) :]))
            if size > max(1_000_000, len(known)):
                known = common.distinct(np.concatenate([known, *held]))
                held, size = [], 0
        h = common.distinct(np.concatenate([known, *held])) >> _TELL
        first = np.flatnonzero(common.changes(h))
        m = np.diff(np.append(first, len(h)))
        h, m = h[first[m > 1]], m[m > 1]
        for at in range(0, len(h), 100_000):
            yield {"h": h[at : at + 100_000], "m": m[at : at + 100_000]}

    dealt = common.in_arrow(banded.select("reps", "bands"), deal, "slot bigint, keys binary").repartition(common.partitions(banded.sparkSession), "slot")
    return common.in_arrow(dealt, several, "h bigint, m bigint")


#: Members that a slot gets at least, on average: each task deals a row to every slot, so slots without work cost the more the more tasks there are.
_DEALT = 1 << 12


def _spread(shared: DataFrame) -> int:
    """How many slots the members of these buckets are dealt to."""
    most, full = common.slots(shared.sparkSession), 1 << _TELL
    # So many members make m values likely; a bucket that has nearly all of them may have any number.
    r = shared.agg(F.max("m").alias("top"), F.sum(F.log1p(-F.least("m", F.lit(full - 1)) / full) * -full).alias("n")).first()
    return most if r.top and r.top > 0.95 * full else int(min(most, 1 + (r.n or 0) // _DEALT))


def _members(banded: DataFrame) -> tuple[DataFrame, int]:
    """The members of buckets of two or more: ``h, rep, n, p, pn``, with the bucket's hub and the size of its set, dealt by bucket; and to how many slots.

    Most buckets have one member.  Keys move once, without their members, to find the others; those then pass a
    sieve of fixed size, so that the rest never moves again.  A table of a slot has its buckets whole and in order.
    """
    shared = common.stage(_shared(banded), "shared")
    sieve, n = common.Sieve(shared, common.key_slot("h")), _spread(shared)
    common.discard(shared)

    def few(batches):
        def tables():
            for b in batches:
                h, reps = _bands(b), longs(b["reps"])
                at = np.repeat(np.arange(len(reps)), len(h) // max(len(reps), 1))
                ok = sieve.passes(np.mod(h, 1 << common.SIEVE_LOG))
                sizes = longs(b["ns"])[at[ok]] if "ns" in b else np.zeros(ok.sum(), np.int64)
                yield np.stack([h[ok], reps[at[ok]], sizes])

        yield from common.deal(tables(), 0, n)

    def sized(batches):
        (t,) = common.gathered(batches, 3)
        t = t[:, np.lexsort((t[1], t[0]))]
        t = t[:, common.changes(t[0], t[1])]
        new = common.changes(t[0])
        size = np.diff(np.append(np.flatnonzero(new), len(new)))[np.cumsum(new) - 1]
        yield from common.deal(iter([np.concatenate([t, size[None]])[:, size > 1]]), 1, n)

    def tied(batches):
        (t,) = common.gathered(batches, 4)
        t = t[:, np.argsort(t[1], kind="stable")]
        first = np.flatnonzero(common.changes(t[1]))
        ties = np.add.reduceat(np.append(t[3], 0), first) if len(first) else t[3]
        t[3] = np.repeat(ties, np.diff(np.append(first, t.shape[1])))
        yield from common.deal(iter([t]), 0, n)

    def hubs(batches):
        (t,) = common.gathered(batches, 4)
        h, rep, sizes, ties = t = t[:, np.lexsort((t[1], _mixed(t[1]), t[3], t[0]))]
        new = common.changes(h)
        hub = np.append(np.flatnonzero(new)[1:], len(h))[np.cumsum(new) - 1] - 1
        yield from common.deal(iter([np.stack([h, rep, sizes, rep[hub], sizes[hub]])]), 0, n)

    met = common.in_arrow(banded, few, common.DEALT)
    for step in (sized, tied, hubs):
        met = common.in_arrow(common.to_slots(met, n), step, common.DEALT)
    return common.stage(met, "members"), n


def _mixed(x: np.ndarray) -> np.ndarray:
    return common.mix64(x.view(np.uint64))


def _order(first: str, then: str) -> "F.Column":
    """One number that orders by ``first``, and rows equal in it by a hash of ``then``."""
    return F.least(F.col(first), F.lit(1 << 37)) * F.lit(1 << 25) + F.pmod(F.xxhash64(then), F.lit(1 << 25))


def _hub_pairs(members: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``rep, p, w, best``: every member with each hub that its size allows, the number of buckets that they share, and whether this is
    the most; besides, with itself and 0, every member."""

    def met(batches):
        def tables():
            for b in batches:
                for raw in b["cells"].to_pylist():
                    _, rep, size, p, hub = common.table(raw, 5)
                    fits = den * np.minimum(size, hub) >= num * np.maximum(size, hub)
                    p = np.where(fits, p, rep)
                    yield np.stack([rep, p, (p != rep).astype(np.int64)])
                    yield np.stack([rep, rep, np.zeros(len(rep), np.int64)])

        yield from common.deal(tables(), 0, n)

    def best(batches):
        (t,) = common.gathered(batches, 3)
        t = t[:, np.lexsort((t[1], t[0]))]
        first = np.flatnonzero(common.changes(t[0], t[1]))
        w = np.add.reduceat(np.append(t[2], 0), first) if len(first) else t[2]
        rep, p = t[:2, first]
        by = np.lexsort((_mixed(p), w, rep))
        rep, p, w = rep[by], p[by], w[by]
        yield {"rep": rep, "p": p, "w": w, "best": (np.append(rep[1:] != rep[:-1], True)[: len(rep)]) & (rep != p)}

    return common.in_arrow(common.to_slots(common.in_arrow(members, met, common.DEALT), n), best, "rep bigint, p bigint, w bigint, best boolean")


#: Pairs up to which the names of their sets are broadcast (1 MB), for only these sets to move; the names of more go into a sieve.
_FEW = 1 << 16


def _asked(rows: DataFrame, pairs: DataFrame, n: int, total: int) -> DataFrame:
    """Of ``total`` rows those that ``n`` pairs name, and few others, so that the rest need not move; all, where the pairs may name most."""
    if 2 * n > total:
        return rows
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep"))
    if n <= _FEW:
        return rows.join(F.broadcast(ids), "rep", "left_semi")
    return rows.where(common.sifted(common.Sieve(ids, common.sieve_slot("rep")), common.sieve_slot("rep")))


def connect(banded: DataFrame, sets_of, num: int, den: int, given: DataFrame | None = None, cut=None, alike=None, within: int = 0) -> DataFrame:
    """Components ``(id, comp)`` over nodes that share a bucket key and pass the exact test.

    ``banded`` has rows of some nodes: ``reps``, the sizes of their sets ``ns`` (0 where not known), and ``bands``, their
    keys one after another.  ``sets_of(ids)`` gives ``rep, items`` for a frame of ``rep``, where ``items`` are a
    set, or a text that ``cut`` turns into one and ``alike`` compares; ``given`` are links ``(a, b)`` known
    beforehand.  With ``within``, sizes and parities of all sets are kept, and only pairs that these do not rule out are
    compared in full; what the hubs leave apart in buckets of up to so many members is then compared pair by
    pair, which for small sets costs less than the filter.  The text that a group was copied from agrees with more of the group than the copies do with
    each other, so one good hub joins most of a group, and what it has joined is compared no more.
    """
    members, slots = _members(banded)
    links = [common.stage(given.select("a", "b"), "given")] if given is not None else []
    count = sum(t.count() for t in links)
    comps = common.components(links[0]) if links else common.stage(banded.sparkSession.range(0).selectExpr("id", "id as comp"), "components")
    if members.isEmpty():
        common.discard(members, *links)
        return comps
    every = common.stage(_hub_pairs(members, slots, num, den), "pairs")
    sets = common.stage(sets_of(every.where("rep = p").select("rep")), "sets")
    total = sets.count()
    marks = common.stage(_marks(sets, cut), "marks") if within else None
    pairs = every.where("rep <> p").withColumns({"a": F.least("rep", "p"), "b": F.greatest("rep", "p")})
    tried: list[DataFrame] = []

    def settle(which: DataFrame, comps: DataFrame) -> DataFrame:
        """The components after the pairs ``(a, b)`` that have not been tried are tested."""
        nonlocal count
        for t in tried:
            which = which.join(t, ["a", "b"], "left_anti")
        now = common.stage(which.select("a", "b").distinct(), "now")
        tried.append(now)
        some, n = now, now.count()
        if not n:
            return comps
        if marks is not None:
            few = _asked(marks, now, n, total)
            some = now.join(_named(few, "a"), F.col("a") == F.col("repa")).join(_named(few, "b"), F.col("b") == F.col("repb")).where(_close(num, den))
            some = common.stage(some.select("a", "b"), "close")
            n = some.count()
        found = common.stage(_verified(some, _asked(sets, some, n, total), num, den, alike), "links")
        common.discard(*[some] * (some is not now))
        more = found.count()
        count += more
        links.append(found)
        if not more:
            return comps
        if count > common.SMALL_GRAPH:
            return common.joined_components(comps, found)
        of = links[0]
        for t in links[1:]:
            of = of.union(t)
        out = common.small_components(of)
        common.discard(comps)
        return out

    best = F.max_by("p", _order("w", "p")).alias("p")
    ends = F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b")
    comps = settle(pairs.where("best").select("a", "b"), comps)
    apart = _placed(_placed(pairs, comps, "rep", "c"), comps, "p", "cp").where("c <> cp")
    comps = settle(apart.groupBy("rep", "cp").agg(best).select(*ends), comps)
    apart = _placed(_placed(pairs, comps, "rep", "c"), comps, "p", "cp").where("c <> cp")
    live = common.stage(_divided(members, slots, comps), "live")
    rivals = live.select("rep", "n", "c", F.explode(F.array("lo", "hi")).alias("e")).where("c <> e.c").where(_fits("n", "e.n", num, den))
    comps = settle(apart.select("a", "b").union(rivals.select(F.least("rep", "e.rep"), F.greatest("rep", "e.rep"))), comps)
    # Every pair with a bucket's three hubs is known; what is left of it goes on if it still lies apart.
    others = _placed(live.where("rep <> lo.rep and rep <> hi.rep").select("h", "rep"), comps, "rep", "c")
    open_ = others.groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("size")).where("x < y").select("h", "size")
    left = common.stage(others.join(open_, "h"), "left")
    if within:
        comps = settle(_inside(left.where(F.col("size") <= within), marks, num, den), comps)
    large = common.stage(left.where(F.col("size") > within).select("rep", "c").distinct(), "large")
    if not large.isEmpty():
        rest = _rest(large, sets, num, den, cut)
        comps = settle(rest, comps)
        common.discard(rest)
    common.discard(large)
    common.discard(every, left, live, sets, members, *tried, *links, *[marks] * (marks is not None))
    return comps


def _joined(docs: DataFrame, k: int, num: int, den: int, bands: int, rows: int, by_id: bool) -> DataFrame:
    """``doc_id, tkey, n, node, low, head``: every row with its class, and its component's smallest id and the class of that."""
    signed, classes, comps = link(docs, k, num, den, bands, rows, by_id)
    of = classes.select("digest", "rep", "node").join(comps.withColumnRenamed("id", "node"), "node", "left")
    first = of.where("comp is not null").groupBy("comp").agg(F.min(F.struct("rep", "node")).alias("first"))
    of = of.join(first, "comp", "left").select("digest", "node", F.coalesce("first.rep", "rep").alias("low"), F.coalesce("first.node", "node").alias("head"))
    return signed.select("doc_id", "tkey", "n", "digest").join(common.stage(of, "of"), "digest", "left").drop("digest")


def near_duplicates(docs: DataFrame, k: int = 4, num: int = 80, den: int = 100, bands: int = 32, rows: int = 4) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    out = _joined(docs, k, num, den, bands, rows, True)
    comp = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("low")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def copies(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bands: int = 32, rows: int = 4) -> DataFrame:
    """``doc_id, tkey`` (id and hash of the text) of rows that repeat an earlier row, here or in near copy.

    Of each component the class with the smallest id stays, and of that class the rows with that id.
    """
    out = _joined(docs, k, num, den, bands, rows, False).where("n > 0 and doc_id is not null")
    return out.where("doc_id <> low or node <> head").select("doc_id", "tkey").distinct()
