"""Fuzzy line deduplication: MinHash over character shingles, exact verification, union-find.

A line is compared in a normal form (lower case, runs of white space as one blank, ends trimmed).
Its set holds the shingles of ``k`` characters of that form, or the whole of a shorter form.  Lines
of equal form are one class, known by 128 bits of hash.  Classes that agree in a band of their MinHash signature are candidates and
are linked if their full sets reach the Jaccard similarity ``num / den``; of every connected component
only its first line (by document id, hash of the text, position) stays.  With 4 characters at 0.8, lines
from 39 characters on are linked whichever one character was changed.

Signatures are taken over shingles of ``GRAM`` characters, longer ones than are compared.  Unrelated lines of one
language share many runs of 4 characters, the more the longer they are, so bands over these would
make candidates of pairs without number; runs of 7 they hardly share.  Coordinates are minima of
multiplicative permutations of mixed shingle hashes, computed for whole batches of lines.  A pair at the
threshold shares about 0.675 of the longer shingles, and 28 bands of 4 rows find it with probability
0.998; at 0.85 with 0.99999.

Edge cases: blank lines are neither compared nor removed; a null text has no lines; rows with a
null id are left as they are; rows that share an id but not a text are documents of their own, rows equal in
both are one document, so equal lines at equal places of them are one line; extra columns are kept,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, near_dedup

#: Characters of the shingles that signatures are taken over.
GRAM = 7
#: Members of a bucket up to which what the hubs leave apart is compared pair by pair.
WITHIN = 1024
_M = np.random.default_rng(20).integers(0, 1 << 32, 512, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_CHARS = 60_000


def form(line: str) -> str:
    return _spaced(line.lower())


def _spaced(line: str) -> str:
    # Of white space only a blank is printable, so most lines are found to be in this form without being taken apart.
    if line.isprintable() and "  " not in line and line[:1] != " " and line[-1:] != " ":
        return line
    return " ".join(line.split())


def _points(forms: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all lines one after another, each filled up to ``k``; which places begin a shingle; where lines' shingles begin."""
    size = np.fromiter((max(len(f), k) for f in forms), np.int64, len(forms))
    points = np.frombuffer("".join(f if len(f) >= k else f.ljust(k, "\0") for f in forms).encode("utf-32-le", "surrogatepass"), "<u4")
    keep = np.ones(len(points), bool)
    ends = np.cumsum(size)
    for j in range(1, k):
        keep[ends - j] = False
    return points, keep, np.concatenate([[0], np.cumsum(size - k + 1)[:-1]])


def _ragged(forms: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingle hashes of all lines one after another, and where each line's begin."""
    points, keep, starts = _points(forms, k)
    points, acc = points.astype(np.uint64), np.zeros(len(points) - k + 1, np.uint64)
    for j in range(k):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + points[j : len(points) - k + 1 + j]
    return common.mix64(acc[keep[: len(acc)]]), starts


def _short(forms: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same in 32 bits, for signatures."""
    points, keep, starts = _points(forms, k)
    n = len(points) - k + 1
    acc = points[:n].copy()
    for j in range(1, k):
        acc *= np.uint32(0x9E3779B1)
        acc += points[j : n + j]
    acc = acc[keep[:n]]
    for shift, by in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1)):
        acc ^= acc >> np.uint32(shift)
        acc *= np.uint32(by)
    return acc, starts


def signatures(forms: list[str], k: int, coordinates: int) -> np.ndarray:
    """``(lines, coordinates)`` MinHash signatures of non-blank forms."""
    out = np.empty((coordinates, len(forms)), np.uint32)
    at = 0
    while at < len(forms):
        to, total = at, 0
        while to < len(forms) and (to == at or total + len(forms[to]) < _CHARS):
            total += len(forms[to])
            to += 1
        x, starts = _short(forms[at:to], k)
        turned = np.empty_like(x)
        for c in range(coordinates):
            np.multiply(x, _M[c], out=turned)
            np.minimum.reduceat(turned, starts, out=out[c, at:to])
        at = to
    return out.T


def _keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    cut = sig.reshape(len(sig), bands, rows)
    for r in range(rows):
        acc = common.mix64(acc * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, r])
    return acc


def _key(f: str) -> tuple[int, int]:
    """Two halves of a 128-bit hash."""
    h = xxhash.xxh3_128_intdigest(f.encode("utf-8", "surrogatepass"))
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def _shingles(f: str, k: int) -> set[str]:
    return {f[i : i + k] for i in range(max(len(f) - k + 1, 1))}


def _lines(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """One row a text: ``doc_id, tkey``, how many non-blank lines ``size``, and for these ``line, key, check`` as 64-bit numbers one after another.

    Of classes that a task meets first here, the names (``reps``, likewise), forms (a line each) and bucket keys follow.
    """

    def run(batches):
        met: set[tuple[int, int]] = set()
        for b in batches:
            out = {c: [] for c in ("size", "line", "key", "check", "reps", "forms", "bands")}
            fresh: list[str] = []
            counts: list[int] = []
            for text in b["text"].to_pylist():
                line, key, check, reps = [], [], [], []
                # Lower case first: it makes or moves no line feed.
                for i, raw in enumerate(text.lower().split("\n")):
                    if f := _spaced(raw):
                        name = _key(f)
                        if name not in met:
                            met.add(name)
                            reps.append(name[0])
                            fresh.append(f)
                        line.append(i)
                        key.append(name[0])
                        check.append(name[1])
                out["size"].append(len(line))
                counts.append(len(reps))
                for c, v in (("line", line), ("key", key), ("check", check), ("reps", reps)):
                    out[c].append(np.array(v, "<i8").tobytes())
            keys = near_dedup.packed(_keys(signatures(fresh, GRAM, bands * rows), bands, rows)) if fresh else []
            done = 0
            for n in counts:
                out["forms"].append("\n".join(fresh[done : done + n]))
                out["bands"].append(b"".join(keys[done : done + n]))
                done += n
            if len(met) > 500_000:
                met.clear()
            yield {"doc_id": b["doc_id"], "tkey": b["tkey"]} | out

    schema = "doc_id bigint, tkey bigint, size int, line binary, key binary, check binary, reps binary, forms string, bands binary"
    return common.in_arrow(docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text"), run, schema)


def _forms(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """``rep, items``: the forms of the classes asked for."""
    sieve = common.Sieve(ids, common.key_slot("rep"))

    def run(batches):
        for b in batches:
            raw = b["reps"].to_pylist()
            reps = np.frombuffer(b"".join(raw), "<i8")
            ok = sieve.passes(np.mod(reps, 1 << common.SIEVE_LOG))
            ends = np.cumsum([len(r) // 8 for r in raw])
            forms: list[str] = []
            for i, (end, r) in enumerate(zip(ends.tolist(), raw)):
                begin = end - len(r) // 8
                if (on := np.flatnonzero(ok[begin:end])).size:
                    each = b["forms"][i].as_py().split("\n")
                    forms += [each[j] for j in on.tolist()]
            yield {"rep": reps[ok], "items": forms}

    found = common.in_arrow(lines.select("reps", "forms"), run, "rep bigint, items string").join(ids, "rep", "left_semi")
    # Tasks may each have met a class; a 64-bit name that two forms share stands for one of them.
    return found.groupBy("rep").agg(F.max("items").alias("items"))


def _cut(forms: list[str], k: int) -> list[np.ndarray]:
    """The sorted shingle sets of non-blank forms."""
    hashes, starts = _ragged(forms, k)
    return [common.distinct(x) for x in np.split(hashes, starts[1:])]


def _exact(forms: list[str], k: int) -> list[np.ndarray | None]:
    """The sorted sets of shingles of up to 4 characters, these as one number each; None for forms that numbers may not tell apart."""
    points, keep, starts = _points(forms, k)
    points = points.astype(np.uint64)
    n = len(points) - k + 1
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = acc << np.uint64(16) | points[j : n + j]
    # Fillers of short forms are 0, and so are characters that a form may have.
    odd = np.maximum.reduceat(np.where(points == 0, np.uint64(1 << 16), points), np.cumsum([0, *(max(len(f), k) for f in forms[:-1])])) >> np.uint64(16)
    return [None if o else common.distinct(x) for o, x in zip(odd.tolist(), np.split(acc[keep[:n]], starts[1:]))]


def _alike(k: int, num: int, den: int):
    """Makes functions that tell of two lists of forms which pairs reach the similarity."""

    def reach(a: int, b: int, same: int) -> bool:
        return same * den >= num * (a + b - same)

    def test(one: list[str], two: list[str]) -> list[bool]:
        if not one:
            return []
        sets = _exact([*one, *two], k) if k <= 4 else [None] * (2 * len(one))
        out = []
        for x, y, a, b in zip(one, two, sets, sets[len(one) :]):
            if a is None or b is None:
                a, b = _shingles(x, k), _shingles(y, k)
                out.append(reach(len(a), len(b), len(a & b)))
            elif min(len(a), len(b)) * den < num * max(len(a), len(b)):
                out.append(False)
            else:
                both = np.sort(np.concatenate([a, b]))
                out.append(reach(len(a), len(b), int(np.count_nonzero(both[1:] == both[:-1]))))
        return out

    return lambda: test


def line_classes(docs: DataFrame, k: int = 4, num: int = 80, den: int = 100, bands: int = 28, rows: int = 4) -> tuple[DataFrame, DataFrame]:
    """Every text's lines, ``doc_id, tkey, line, key, check`` with arrays, and ``(key, check, component, first)``
    of classes that are linked or occur more than once; ``first`` is the place of the line that stays."""
    common.tune(docs.sparkSession)
    base = common.texts(docs).where("doc_id is not null")
    lines = common.stage(_lines(base, k, bands, rows), "lines")
    banded = lines.where("length(reps) > 0").select("reps", "bands")
    comps = near_dedup.connect(banded, lambda ids: _forms(lines, ids), num, den, cut=lambda f: _cut(f, k), alike=_alike(k, num, den), within=WITHIN)
    found = common.stage(_classes(lines, comps), "repeated")
    heads = found.where("comp is not null").groupBy("comp").agg(F.min("first").alias("head"))
    out = found.join(heads, "comp", "left").select("key", "check", F.coalesce("comp", "key").alias("component"), F.coalesce("head", "first").alias("first"))
    done = common.stage(out, "classes")
    common.discard(found, comps)
    few = lines.select("doc_id", "tkey", "size", "line", "key", "check")
    few._lexigrain_path = lines._lexigrain_path
    return few, done


def _numbers(b: dict) -> np.ndarray:
    """``key, check, doc_id, tkey, line`` of all lines of a batch, a row of the table each."""
    size = b["size"].to_numpy()
    key, check, line = (near_dedup.longs(b[c]) for c in ("key", "check", "line"))
    return np.stack([key, check, np.repeat(b["doc_id"].to_numpy(), size), np.repeat(b["tkey"].to_numpy(), size), line])


def _by_class(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table in the order of classes and places; the first and the last row of each class."""
    t = t[:, np.lexsort((t[4], t[3], t[2], t[1], t[0]))]
    first = np.flatnonzero(common.changes(t[0], t[1]))
    return t, first, np.append(first[1:], t.shape[1])[: len(first)] - 1


def _classes(lines: DataFrame, comps: DataFrame) -> DataFrame:
    """``key, check, comp, first`` of classes that are linked (``comp``, else null) or have several places; ``first`` is the first of these.

    Each task hands on two places of a class at most, so a common line is no large group anywhere.
    """
    n = common.slots(lines.sparkSession)

    def places(batches):
        def ends():
            held, size = [], 0
            for b in batches:
                held.append(_numbers(b))
                size += held[-1].shape[1]
                if size > 200_000:
                    yield outer(np.concatenate(held, axis=1))
                    held, size = [], 0
            if size:
                yield outer(np.concatenate(held, axis=1))

        def outer(t):
            t, first, last = _by_class(t)
            return t[:, common.distinct(np.concatenate([first, last]))]

        yield from common.deal(ends(), 0, n)

    def classes(batches):
        t, known = common.gathered(batches, 5, 2)
        t, first, last = _by_class(t)
        linked, at = common.looked_up(t[0][first], known)
        several = (t[2:, first] != t[2:, last]).any(axis=0)
        on = linked | several
        key, check, doc, tkey, line = t[:, first[on]]
        comp = pa.array(known[1][at[on]] if known.shape[1] else np.zeros(on.sum(), np.int64), mask=~linked[on])
        yield {"key": key, "check": check, "comp": comp, "doc_id": doc, "tkey": tkey, "line": line.astype(np.int32)}

    met = common.in_arrow(lines.select("doc_id", "tkey", "size", "line", "key", "check"), places, common.DEALT).union(near_dedup._by_id(comps, 1, n))
    out = common.in_arrow(common.to_slots(met, n), classes, "key bigint, check bigint, comp bigint, doc_id bigint, tkey bigint, line int")
    return out.select("key", "check", "comp", F.struct("doc_id", "tkey", "line").alias("first"))


def _places(lines: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``doc_id, tkey, line, key, check``: one row a line; with ``of``, only lines of its classes, and few others."""
    sieve = common.Sieve(of, common.key_slot("key")) if of is not None else None

    def run(batches):
        for b in batches:
            t = _numbers(b)
            if sieve is not None:
                t = t[:, sieve.passes(np.mod(t[0], 1 << common.SIEVE_LOG))]
            yield {"doc_id": t[2], "tkey": t[3], "line": t[4].astype(np.int32), "key": t[0], "check": t[1]}

    return common.in_arrow(lines.select("doc_id", "tkey", "size", "line", "key", "check"), run, "doc_id bigint, tkey bigint, line int, key bigint, check bigint")


def _gone(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """``doc_id, tkey, line`` of the lines to remove."""
    met = _places(lines, classes).join(classes, ["key", "check"])
    return met.where(F.struct("doc_id", "tkey", "line") != F.col("first")).select("doc_id", "tkey", "line")


def repeated_lines(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, line, key, component, kept`` of every non-blank line; lines count from 0."""
    lines, classes = line_classes(docs, **how)
    kept = F.coalesce(F.struct("doc_id", "tkey", "line") == F.col("first"), F.lit(True))
    return _places(lines).join(classes, ["key", "check"], "left").select("doc_id", "line", "key", F.coalesce("component", "key").alias("component"), kept.alias("kept"))


def removed(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, tkey, lines``: the numbers of the lines to remove, for texts that have any; a stage table, beside which nothing is kept."""
    lines, classes = line_classes(docs, **how)
    out = common.stage(_gone(lines, classes).groupBy("doc_id", "tkey").agg(F.sort_array(F.collect_set("line")).alias("lines")), "removed")
    common.discard(lines, classes)
    return out


def rewrite(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents, all columns kept, without the lines of ``gone``; documents that lose their last line go.

    Only texts that may lose lines move to meet these, once and compressed; the others stay where they are read.
    """
    cells = {c: F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("key"), *cells.values())
    sieve = common.Sieve(gone, common.key_slot("tkey"))
    asked = gone.select(F.col("doc_id").alias("of"), F.col("tkey").alias("of_key"), "lines")
    at = f"c{docs.columns.index('text')}"
    # One function sifts and packs, as each would take a Python worker of its own; for the same reason Spark must not copy them into the filters.
    packed = F.arrow_udf(lambda slots, texts: _packed(sieve.passes(slots.to_numpy(zero_copy_only=False)), texts), "binary").asNondeterministic()
    moved = named.withColumn(at, packed(common.key_slot("key"), F.col(at).cast("string"))).where(F.col(at).isNotNull())
    # Dealt out before the join, even where that is a broadcast: else one task would run both functions, in two workers.
    both = moved.repartition("id", "key").join(asked, (F.col("id") == F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    out = both.withColumn(at, F.arrow_udf(_without, "string").asNondeterministic()(at, "lines")).where(F.col("lines").isNull() | F.col(at).isNotNull())
    may = common.sifted(sieve, common.key_slot("key"))
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return out.select(*kept).union(named.where(~may).select(*kept))


def _packed(chosen: np.ndarray, texts: pa.Array) -> pa.Array:
    """The chosen texts compressed, each after its length in bytes; no bytes for a null text, null for one that was not chosen."""
    codec, out = pa.Codec("zstd", 3), [None] * len(texts)
    at = np.flatnonzero(chosen)
    for i, t in zip(at.tolist(), texts.take(pa.array(at)).to_pylist()):
        raw = b"" if t is None else t.encode("utf-8", "surrogatepass")
        out[i] = b"" if t is None else len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True)
    return pa.array(out, pa.binary())


def _without(packed: pa.Array, lines: pa.Array) -> pa.Array:
    """The texts without these lines; null where no line but blank ones is left of a text that loses any."""
    codec, out = pa.Codec("zstd", 3), []
    for raw, gone in zip(packed.to_pylist(), lines.to_pylist()):
        text = None if not raw else codec.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True).decode("utf-8", "surrogatepass")
        if gone is not None:
            gone = set(gone)
            text = "\n".join(x for i, x in enumerate((text or "").split("\n")) if i not in gone)
            text = text if text.strip(" \t\n\x0b\f\r") else None
        out.append(text)
    return pa.array(out, pa.string())


def summary(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed_lines`` of every document with a line; texts of one id are counted together."""
    lines, classes = line_classes(docs, **how)
    gone = _gone(lines, classes).groupBy("doc_id").agg(F.collect_set("line").alias("gone"))
    sizes = lines.where("size > 0").groupBy("doc_id", "tkey").agg(F.max("size").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n_lines"))
    none = F.array().cast("array<int>")
    out = sizes.join(gone, "doc_id", "left").withColumn("removed_lines", F.sort_array(F.coalesce("gone", none)))
    return out.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines")
