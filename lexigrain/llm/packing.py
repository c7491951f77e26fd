"""Best-fit packing: bin completion with branch and bound over the histogram of piece lengths.

Piece lengths lie between 1 and the capacity, so the multiset of all pieces of any corpus is a
histogram of at most ``capacity`` numbers, and that is what the search sees.  The first incumbent is the
whole best-fit solution.  The search then completes one bin after another around the largest length that is
left: it enumerates the fillings of the rest of the bin depth first, longest pieces first, drops
dominated ones, applies a filling to as many bins at once as the counts allow, and goes back to other
undominated fillings when the waste so far leaves no room to beat the incumbent.  A filling is dominated if a piece
that is left could take the place of some of its pieces with a sum no larger, within the waste: the bin would be
no worse and smaller pieces would be left for the others.  The search ends
when the incumbent meets a lower bound (total length, and pairs that cannot share a bin), when nothing is left to try, or
after ``steps`` bins; :func:`search` tells which, with the bound.  The result is a short list of bin patterns with
multiplicities.  Concrete pieces then find their place by rank among the pieces of equal length, a lookup
that runs in parallel.

Edge cases: a null or empty text is one piece holding the end id; only documents longer than the
capacity are cut, their first piece being the shorter one; repeated rows are packed each; an empty
table gives no rows; extra columns are ignored.  The effort for one bin is bounded by ``nodes``, after which the best
filling met, or the best fit, stands.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder


@dataclass
class Pattern:
    """``times`` bins, each holding ``sizes`` from left to right."""

    sizes: list[int]
    times: int


@dataclass
class Packing:
    """Patterns, the least number of bins that any packing has, and whether the search ended before its limits."""

    patterns: list[Pattern]
    bound: int
    whole: bool

    @property
    def bins(self) -> int:
        return sum(p.times for p in self.patterns)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: pieces over half the capacity need one each, and what these leave free holds only so much.

    For each ``a`` up to half the capacity: pieces over ``capacity - a`` fill a bin for all pieces of at least ``a``; those
    down to half share theirs with the smaller ones.
    """
    n = np.arange(capacity + 1)
    number, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * n)])
    half = capacity // 2 + 1
    best = -(-int(total[-1]) // capacity)
    for a in range(half):
        alone = int(number[-1] - number[capacity - a + 1])
        pairs = int(number[capacity - a + 1] - number[half])
        free = pairs * capacity - int(total[capacity - a + 1] - total[half])
        small = int(total[half] - total[a])
        best = max(best, alone + pairs + max(0, -(-(small - free) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit, longest first, for many equal pieces at once: each goes where it leaves the least room."""
    rooms: dict[int, list[Pattern]] = {}
    for n in np.flatnonzero(counts)[::-1].tolist():
        todo = int(counts[n])
        for room in sorted(r for r in rooms if r >= n):
            while todo and rooms.get(room):
                p = rooms[room].pop()
                each = room // n
                full = min(p.times, todo // each)
                if not full:  # the last bin of this kind takes what is left
                    full, each = 1, todo
                if full < p.times:
                    rooms[room].append(Pattern(p.sizes, p.times - full))
                rooms.setdefault(room - each * n, []).append(Pattern([*p.sizes, *[n] * each], full))
                todo -= full * each
        if each := min(todo, capacity // n):
            full, rest = divmod(todo, each)
            rooms.setdefault(capacity - each * n, []).append(Pattern([n] * each, full))
            if rest:
                rooms.setdefault(capacity - rest * n, []).append(Pattern([n] * rest, 1))
    return [p for ps in rooms.values() for p in ps]


def _spread(sums: int, waste: int) -> int:
    """The bits of ``sums``, each moved up by 0 to ``waste`` places."""
    done = 0
    while done < waste:
        step = min(done + 1, waste - done)
        sums |= sums << step
        done += step
    return sums


def dominated(sizes: list[tuple[int, int]], waste: int, open_lengths: int) -> bool:
    """Whether a length in the bit set ``open_lengths`` could take the place of pieces ``(length, times)`` with no larger sum."""
    # Bit s of `some` and `two`: some pieces, or at least two of them, have the sum s.
    some, two = 1, 0
    for n, k in sizes:
        for _ in range(k):
            two |= two << n | (some & ~1) << n
            some |= some << n
    if waste and _spread(some << 1, waste - 1) & open_lengths:
        return True
    return bool(_spread(two, waste) & open_lengths)


def fillings(counts: np.ndarray, room: int, most: int, nodes: int, width: int) -> tuple[list[tuple[int, list[int]]], bool]:
    """Up to ``width`` undominated fillings of ``room`` with the least waste, at most ``most``, as ``(waste, sizes)``; whether all were seen."""
    lengths = np.flatnonzero(counts[: room + 1])[::-1].tolist()
    have = [int(counts[n]) for n in lengths]
    # A sum from place i on can fill at most `tail[i]`.
    tail = np.cumsum([n * k for n, k in zip(lengths, have)][::-1])[::-1].tolist() + [0]
    at = {n: i for i, n in enumerate(lengths)}
    all_open = sum(1 << n for n in lengths)
    found: list[tuple[int, list[int]]] = []
    # (place, room left, chosen); iterative, a deep filling of ones must not exhaust the stack
    todo = [(0, room, ())]
    while todo and nodes:
        i, free, chosen = todo.pop()
        nodes -= 1
        while i < len(lengths) and lengths[i] > free:
            i += 1
        if free - min(free, tail[i]) > most:
            continue
        if i == len(lengths):
            closed = sum(1 << n for n, k in chosen if k == have[at[n]])
            if not dominated(list(chosen), free, all_open & ~closed):
                found.append((free, [n for n, k in chosen for _ in range(k)]))
                found.sort(key=lambda x: x[0])
                del found[width:]
                if len(found) == width:
                    most = min(most, found[-1][0] - 1)
                    if most < 0:
                        return found, True
            continue
        n = lengths[i]
        for k in range(min(have[i], free // n) + 1):  # popped last to first: most copies of the longest piece first
            todo.append((i + 1, free - k * n, (*chosen, (n, k)) if k else chosen))
    return found, not todo


def _greedy(left: np.ndarray, room: int) -> list[int]:
    """The longest pieces that fit, one after another."""
    sizes, n = [], room
    while n:
        n = min(n, room)
        if k := min(int(left[n]), room // n):
            sizes += [n] * k
            room -= n * k
        n -= 1
    return sizes


def _applied(left: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, int]:
    """What is left after as many bins of these sizes as there are pieces for, and their number."""
    uses = {n: sizes.count(n) for n in set(sizes)}
    times = min(int(left[n]) // k for n, k in uses.items())
    out = left.copy()
    for n, k in uses.items():
        out[n] -= times * k
    return out, times


def search(counts: np.ndarray, capacity: int, nodes: int = 2000, width: int = 3, steps: int = 4000) -> Packing:
    """Bin completion with branch and bound, from the best-fit incumbent."""
    counts = counts.astype(np.int64)
    bound, total = lower_bound(counts, capacity), int((counts * np.arange(capacity + 1)).sum())
    best, whole = best_fit(counts, capacity), True
    bins = sum(p.times for p in best)

    def children(left: np.ndarray, waste: int):
        """Bins around the largest length, least waste first; the first one always, others while they can lead to fewer bins."""
        nonlocal whole
        top = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[top] -= 1
        room = capacity - top
        some, seen = fillings(rest, room, room, nodes, width)
        if not seen:
            whole = False
            some = some or [(room - sum(g := _greedy(rest, room)), g)]
        for w, sizes in some:
            sizes = [top, *sizes]
            after, times = _applied(left, sizes)
            yield waste + w * times, Pattern(sizes, times), after

    # The way down to the present node: iterators of children, and the patterns chosen.
    way, chosen = [children(counts, 0)] if total else [], []
    first = True
    while way and bins > bound:
        nxt = next(way[-1], None)
        steps -= 1
        # To beat the incumbent, all bins together may waste no more than this.
        if nxt is None or not first and nxt[0] > (bins - 1) * capacity - total:
            way.pop()  # the other children waste no less
            if chosen:
                chosen.pop()
            continue
        if steps < 0 and not first:
            whole = False
            break
        waste, pattern, after = nxt
        chosen.append(pattern)
        if after.any():
            way.append(children(after, waste))
        else:
            first = False
            if (n := sum(p.times for p in chosen)) < bins:
                best, bins = list(chosen), n
            chosen.pop()
    return Packing(best, bound, whole or bins == bound)


def plan(counts: np.ndarray, capacity: int, **effort: int) -> list[Pattern]:
    """Patterns that use up ``counts`` (by length, index 0 unused) in few bins."""
    return search(counts, capacity, **effort).patterns


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, chunk, nth``: the ``nth`` piece of its length in its task."""

    def run(batches):
        from pyspark import TaskContext

        chunk, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        enc, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        names = ("doc_id", "piece", "start", "length", "ids_crc32", "nth")
        for b in batches:
            out = {n: [] for n in names}
            for doc_id, raw in zip(b["doc_id"].to_pylist(), enc.encode(b["text"].to_pylist())):
                raw += end
                n, at, piece = len(raw) // 4, 0, 0
                size = n % capacity or capacity
                while at < n:
                    for name, v in zip(names, (doc_id, piece, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), int(seen[size]))):
                        out[name].append(v)
                    seen[size] += 1
                    at, piece, size = at + size, piece + 1, capacity
            yield out | {"chunk": [chunk] * len(out["doc_id"])}

    common.tune(docs.sparkSession)
    return common.in_arrow(common.texts(docs), run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, chunk int, nth bigint")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    cut = common.stage(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    per_chunk = cut.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    w = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = per_chunk.select("chunk", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most one row for each length up to the capacity
        counts[r.length] = r["count"]
    # For each length: first ranks of its runs, and the bin and offset where each run starts.
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used, base = np.zeros(capacity + 1, np.int64), 0
    for p in plan(counts, capacity):
        offset = 0
        for n in p.sizes:
            runs.setdefault(n, []).append((int(used[n]), base, offset))
            used[n] += p.times
            offset += n
        base += p.times
    table = {n: np.array(v, np.int64) for n, v in runs.items()}

    def place(batches):
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                at, t = np.flatnonzero(length == n), table[int(n)]
                k = np.searchsorted(t[:, 0], rank[at], side="right") - 1
                seq[at], off[at] = t[k, 1] + rank[at] - t[k, 0], t[k, 2]
            yield {k: b[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": seq, "offset": off}

    ranked = cut.join(before, ["chunk", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    return common.in_arrow(ranked, place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
