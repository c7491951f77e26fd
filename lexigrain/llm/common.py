"""Plumbing shared by the text operators: stage tables, byte words, 64-bit hashing.

Stage tables are Parquet written below ``spark.checkpoint.dir``, the folder that the
driver and all executors share, so that a lost executor never takes the only copy of an
intermediate result with it.  A table that later eager steps have fully consumed is
removed with :func:`discard`; one that a returned DataFrame still reads stays until the
process ends.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Rows and bytes that one Arrow batch may hold on its way to Python.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_U64 = np.uint64


# --------------------------------------------------------------------- session and stages
def tune(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches, since one document may be megabytes long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset, on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("lexigrain.tmp.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^,\]]*(,\d+)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexigrain-")
        spark.conf.set("lexigrain.tmp.dir", found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark)}/lexigrain/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the JVM may be gone at exit; the folder is then the cluster's to clean
        pass


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a stage table and read it back, which cuts its lineage.

    As nothing reads the shuffles behind it any more, Spark may remove their files as soon as it is written.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        # The plan is made anew, for the setting to hold for it.
        df.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexigrain_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove stage tables that no pending plan reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._lexigrain_path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that extra columns of any name cannot clash; null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fold(col: str | None = "doc_id", k: int = 5) -> "F.Column":
    """crc32 of the id as text, modulo ``k``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(k)


def in_arrow(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` with plain columns: ``fn`` gets and gives dicts of name to Arrow array or list."""
    out_schema = df.sparkSession.createDataFrame([], schema).schema
    fields = [(f.name, f.dataType.simpleString()) for f in out_schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [(n, _arrow_type(t)) for n, t in fields]
        for got in fn({n: b.column(i) for i, n in enumerate(b.schema.names)} for b in batches if b.num_rows):
            arrays = [x if isinstance(x := got[n], pa.Array) and x.type == t else pa.array(x, type=t) for n, t in types]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in types])

    return df.mapInArrow(run, out_schema)


def _arrow_type(t: str) -> pa.DataType:
    if t.startswith("array<"):
        return pa.list_(_arrow_type(t[6:-1]))
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[t]


# --------------------------------------------------------------------- words and hashes
def words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text as UTF-8, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


class _WordHashes(dict):
    """xxh3 of words, remembered; emptied when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, ws), dtype=_U64, count=len(ws))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def shingles(ws: list[bytes], k: int) -> np.ndarray:
    """Hashes of all ``k``-word shingles in order; of the whole sequence where it has fewer words."""
    n = len(ws)
    if not n:
        return np.empty(0, _U64)
    h = word_hashes(ws)
    width = min(n, k)
    acc = np.full(n - width + 1, width, dtype=_U64)
    for i in range(width):
        acc = mix64(acc * _U64(0x9E3779B97F4A7C15) + h[i : n - width + 1 + i])
    return acc


def distinct(x: np.ndarray) -> np.ndarray:
    """The values of an array, sorted; many times as fast as ``np.unique`` on integers."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# --------------------------------------------------------------------- many small rows as few large ones
#: Rows that a task gathers before it deals them out.
_GATHERED = 400_000


def slots(spark: SparkSession) -> int:
    return 4 * partitions(spark)


def slot_of(x: np.ndarray, n: int) -> np.ndarray:
    return (mix64(x.view(_U64)) >> _U64(32)).astype(np.int64) % n


def deal(tables: Iterator[np.ndarray], by: int, n: int, kind: int = 0) -> Iterator[dict]:
    """``slot, kind, cells``: the columns of tables of 64-bit numbers, dealt to ``n`` slots by a hash of column ``by``.

    A row then is all that some batches have for a slot, which costs Spark far less than a row for each number.
    """

    def out(held):
        table = np.concatenate(held, axis=1)
        slot = slot_of(table[by], n)
        order = np.argsort(slot, kind="stable")
        table, ends = table[:, order], np.searchsorted(slot[order], np.arange(n + 1))
        full = np.flatnonzero(np.diff(ends))
        return {"slot": full, "kind": np.full(len(full), kind), "cells": [_cells(table[:, ends[i] : ends[i + 1]]) for i in full]}

    held, size = [], 0
    for t in tables:
        held.append(t)
        size += t.shape[1]
        if size > _GATHERED:
            yield out(held)
            held, size = [], 0
    if size:
        yield out(held)


DEALT = "slot bigint, kind bigint, cells binary"


def _cells(t: np.ndarray) -> bytes:
    """A table column by column, of each the first bytes of all numbers, then the second ones: those that hardly differ take little when compressed."""
    return np.ascontiguousarray(t, "<i8").view(np.uint8).reshape(*t.shape, 8).transpose(0, 2, 1).tobytes()


def table(cells: bytes, width: int) -> np.ndarray:
    """The table, of so many columns, of a dealt row."""
    return np.ascontiguousarray(np.frombuffer(cells, np.uint8).reshape(width, 8, -1).transpose(0, 2, 1)).view("<i8")[:, :, 0]


def gathered(batches: Iterator[dict], *widths: int) -> list[np.ndarray]:
    """For each kind the table, of so many columns, that a task was dealt."""
    held: list[list[np.ndarray]] = [[np.empty((w, 0), np.int64)] for w in widths]
    for b in batches:
        for kind, cells in zip(b["kind"].to_pylist(), b["cells"].to_pylist()):
            held[kind].append(table(cells, widths[kind]))
    return [np.concatenate(x, axis=1) for x in held]


def to_slots(dealt: DataFrame, n: int) -> DataFrame:
    """Rows dealt to ``n`` slots, four of these a task."""
    return dealt.repartition(-(-n // 4), "slot")


def changes(*columns: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def looked_up(x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether ``x`` is in the first row of a table of distinct keys, and where."""
    if not table.shape[1]:
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    order = np.argsort(table[0])
    at = order[np.minimum(np.searchsorted(table[0], x, sorter=order), len(order) - 1)]
    return table[0][at] == x, at


# --------------------------------------------------------------------- distributed union-find
#: Edges up to which a graph is solved by one task, in 32 MB; a larger one takes rounds of joins.
SMALL_GRAPH = 1 << 20


def lowest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and the smallest node that each can reach."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, low = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while len(ids):
        x, y = low[a], low[b]
        if (x == y).all():
            break
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while ((up := low[low]) != low).any():
            low = up
    return ids, ids[low]


def small_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """What :func:`components` gives, by one task."""

    def run(batches):
        held = [(b["a"].to_numpy(), b["b"].to_numpy()) for b in batches]
        if held:
            ids, low = lowest(*map(np.concatenate, zip(*held)))
            yield {"id": ids, "comp": low}

    return stage(in_arrow(edges.where("a <> b").select("a", "b").coalesce(1), run, "id bigint, comp bigint"), name)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(id, comp)`` with the smallest id reachable.

    Alternates large-star and small-star steps, each one aggregation by key and one join, so
    that no group of neighbours is ever gathered; a stage table after each round cuts the
    lineage.  It ends as soon as every node hangs on one root and no root hangs on another node.
    Self-loops and repeated edges are harmless; ids without an edge do not appear.
    """
    cur = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not _is_stars(cur):
        # Large star: every node hands its smallest neighbour to the neighbours above it.
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: every node hands its smallest neighbour to those at or below it.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        nxt = stage(small.where("a <> b").distinct(), name)
        discard(cur)
        cur = nxt
    roots = cur.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("comp"))
    res = stage(cur.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(roots), name)
    discard(cur)
    return res


def _is_stars(edges: DataFrame) -> bool:
    """Whether every ``a`` has one ``b`` and no ``b`` is an ``a``."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def joined_components(comps: DataFrame, links: DataFrame, name: str = "components") -> DataFrame:
    """The components that ``links(a, b)`` make of ``comps(id, comp)``; only the components that they touch are searched.

    ``comps`` is a stage table and is removed.
    """
    by = [comps.select(F.col("id").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab"]
    ends = links.join(by[0], "a", "left").join(by[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(ends, name)
    renamed = comps.join(merged.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    # Ids that had no component are nodes of their own in `merged`.
    fresh = merged.join(comps.select("id"), "id", "left_anti")
    res = stage(renamed.union(fresh), name)
    discard(comps, merged)
    return res


# --------------------------------------------------------------------- bounded sieve of ids
#: Bits of a sieve: its size is fixed (8 MB), so it may be broadcast at any scale.
SIEVE_LOG = 26
_WORD = 1 << 15


def sieve_slot(col: "str | F.Column") -> "F.Column":
    return F.pmod(F.xxhash64(col), F.lit(1 << SIEVE_LOG))


def key_slot(col: "str | F.Column") -> "F.Column":
    """The slot of a value that is a hash already."""
    return F.pmod(F.col(col) if isinstance(col, str) else col, F.lit(1 << SIEVE_LOG))


class Sieve:
    """A fixed-size bitmap of hashed ids: never misses an id that was put in, and passes few others.

    A sieve only saves work; an exact join on the ids always follows.
    """

    def __init__(self, ids: DataFrame, slot: "F.Column") -> None:
        spark, log = ids.sparkSession, _WORD.bit_length() - 1

        def mark(batches):
            held, size = [], 0

            def out():
                at = distinct(np.concatenate(held))
                ends = np.searchsorted(at >> log, np.arange((1 << (SIEVE_LOG - log)) + 1))
                full = np.flatnonzero(np.diff(ends))
                low = (at & (_WORD - 1)).astype("<u2")
                return {"w": full, "bits": [low[ends[i] : ends[i + 1]].tobytes() for i in full]}

            for b in batches:
                held.append(b["s"].to_numpy())
                size += len(held[-1])
                if size > 1_000_000:
                    yield out()
                    held, size = [], 0
            if size:
                yield out()

        def merge(batches):
            maps: dict[int, np.ndarray] = {}
            for b in batches:
                for w, low in zip(b["w"].to_pylist(), b["bits"].to_pylist()):
                    maps.setdefault(w, np.zeros(_WORD, bool))[np.frombuffer(low, "<u2")] = True
            for w, bits in maps.items():
                yield {"w": [w], "bits": [np.packbits(bits, bitorder="little").tobytes()]}

        marked = in_arrow(ids.select(slot.alias("s")).where("s is not null"), mark, "w bigint, bits binary")
        bits = np.zeros((1 << SIEVE_LOG) // 8, np.uint8)
        # At most 2**SIEVE_LOG / 2**15 rows of 4 KB, in one job.
        for r in in_arrow(marked.repartition(partitions(spark), "w"), merge, "w bigint, bits binary").collect():
            bits[r.w * _WORD // 8 : (r.w + 1) * _WORD // 8] = np.frombuffer(r.bits, np.uint8)
        self.held = spark.sparkContext.broadcast(bits)

    def passes(self, slots: np.ndarray) -> np.ndarray:
        """Which of the slots, as :func:`sieve_slot` computes them, are in the bitmap."""
        return (self.held.value[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def sifted(sieve: Sieve, slot: "F.Column") -> "F.Column":
    """Whether a row's slot is in the sieve, as a column."""
    return F.arrow_udf(lambda s: pa.array(sieve.passes(s.to_numpy(zero_copy_only=False))), "boolean")(slot)
