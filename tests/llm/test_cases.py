"""Lost-row cases, and operators against plain Python on small tables."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lexigrain.llm import decontaminate, line_dedup, near_dedup, packing, ppm, suffixes

SCHEMA = "doc_id long, text string, lang string, row string, lines string, `__id` int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y", 3) for i, t in rows], SCHEMA)


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


COMMON = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def test_a_repeated_id_takes_no_other_text_with_it_in_line_dedup(spark):
    docs = table(spark, [(1, f"{COMMON}\nkeep me one"), (7, f"{COMMON}\nsecond text A"), (7, "a wholly unique line found nowhere else at all\nquite other words"), (None, COMMON), (8, None), (9, "")])
    left = corpus_pipeline.line_stage(spark, docs, "")
    assert left.columns == docs.columns
    got = left.select("doc_id", "text").collect()
    assert {(r.doc_id, r.text) for r in got} == {(1, f"{COMMON}\nkeep me one"), (7, "second text A"), (7, "a wholly unique line found nowhere else at all\nquite other words"), (None, COMMON), (8, None), (9, "")}


def test_a_repeated_id_takes_no_other_text_with_it_in_near_dedup(spark):
    x, y = COMMON, "one two three four five six seven eight nine ten eleven"
    docs = table(spark, [(1, x), (7, x), (7, y), (9, y + " twelve"), (None, x), (3, None)])
    left = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert left.columns == docs.columns
    assert {(r.doc_id, r.text) for r in left.collect()} == {(1, x), (7, y), (None, x), (3, None)}
    assert corpus_pipeline.near_dedup_stage(spark, docs.limit(0), "").count() == 0


def test_near_dedup_of_rows_against_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]

    def shingles(t):
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t)]
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            same = len(sets[i] & sets[j])
            if 100 * same >= 80 * (len(sets[i]) + len(sets[j]) - same):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    gone = {r.doc_id for r in near_dedup.copies(spark.createDataFrame(rows, "doc_id long, text string"), k=5).collect()}
    assert gone == {i for i in ids if root(i) != i}


def test_line_dedup_finds_nearly_all_similar_lines(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    forms = {}
    for r in docs.collect():
        for raw in (r.text or "").split("\n"):
            if f := line_dedup.form(raw):
                forms.setdefault(line_dedup._key(f)[0], f)
    sets = {k: {f[i : i + 4] for i in range(max(len(f) - 3, 1))} for k, f in forms.items()}
    where, pairs = {}, Counter()
    for k, s in sets.items():
        for t in s:
            where.setdefault(t, []).append(k)
    for ks in where.values():
        if len(ks) < 400:
            pairs.update((a, b) for i, a in enumerate(ks) for b in ks[:i])
    linked = [(a, b) for (a, b), n in pairs.items() if 100 * n >= 45 * min(len(sets[a]), len(sets[b])) and 100 * (m := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - m)]
    comp = {r.key: r.component for r in line_dedup.repeated_lines(docs).select("key", "component").distinct().collect()}
    found = sum(comp[a] == comp[b] for a, b in linked)
    assert len(linked) > 10 and found >= 0.99 * len(linked)


def test_decontamination_stage_keeps_clean_rows(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(30))
    words = item.split()
    spark.createDataFrame([(5, item), (6, item), (7, None), (8, "short item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    moved = "x " + " ".join(words[15:] + ["y"] + words[:15])
    docs = table(spark, [(1, moved), (1, "clean words of the same id"), (2, " ".join(words[:10])), (3, None), (4, ""), (None, item), (5, "a short item here")])
    left = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert {(r.doc_id, r.text) for r in left.collect()} == {(1, "clean words of the same id"), (2, " ".join(words[:10])), (3, None), (4, ""), (None, item)}
    assert corpus_pipeline.decontamination_stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    named = {(r.doc_id, tuple(r["items"])) for r in decontaminate.contaminated(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()}
    assert named == {(1, (5, 6)), (5, (8,))}


def test_tiles_against_a_plain_greedy_search():
    def plain(doc, item, least):
        free_d, free_i, total = [True] * len(doc), [True] * len(item), 0
        while True:
            best = (0, 0, 0)
            for i in range(len(doc)):
                for j in range(len(item)):
                    n = 0
                    while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_d[i + n] and free_i[j + n]:
                        n += 1
                    if n > best[0]:
                        best = (n, i, j)
            n, i, j = best
            if n < least:
                return total
            free_d[i : i + n], free_i[j : j + n], total = [False] * n, [False] * n, total + n

    rng = np.random.default_rng(4)
    for _ in range(60):
        doc, item = (rng.integers(0, 3, rng.integers(0, 40)).astype(np.uint64) for _ in range(2))
        got = decontaminate.tile(doc, item, 3)
        assert sum(n for _, _, n in got) == plain(doc.tolist(), item.tolist(), min(3, len(item)) or 1)
        assert all((doc[i : i + n] == item[j : j + n]).all() for i, j, n in got)
    # Words that repeat without end are no product of places.
    assert decontaminate.coverage(np.zeros(20_000, np.uint64), np.zeros(3_000, np.uint64), 5) == 1.0


def test_packing_is_optimal_on_small_cases_and_reports_its_bound():
    def least(items, room):
        best = [len(items)]

        def go(i, bins):
            if len(bins) < best[0]:
                if i == len(items):
                    best[0] = len(bins)
                    return
                for j in {b: k for k, b in enumerate(bins) if b >= items[i]}.values():
                    go(i + 1, [*bins[:j], bins[j] - items[i], *bins[j + 1 :]])
                go(i + 1, [*bins, room - items[i]])

        go(0, [])
        return best[0]

    rng = np.random.default_rng(0)
    for _ in range(60):
        room = int(rng.integers(10, 60))
        items = sorted(rng.integers(1, room + 1, rng.integers(1, 11)).tolist(), reverse=True)
        found = packing.search(np.bincount(items, minlength=room + 1), room)
        assert found.bins == least(items, room) >= found.bound
    assert packing.dominated([(3, 1), (4, 1)], 0, 1 << 7) and not packing.dominated([(7, 1)], 0, 1 << 3)
    assert packing.dominated([(5, 1)], 2, 1 << 6) and not packing.dominated([(5, 1)], 2, 1 << 8)


def test_packed_ids_are_the_plain_tokenizers(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40").select("doc_id", "text")
    plain, want = Tokenizer.from_file(path), set()
    for r in docs.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [2]
        size = len(ids) % 1024 or 1024
        cuts = [0, *range(size, len(ids) + 1, 1024)]
        want |= {(r.doc_id, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.pack(docs, path).collect()} == want


def test_base_score_against_plain_counts(spark, sf):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = {i: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower)), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in toks}
    c = Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    total, floor = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    got = {r.doc_id: r for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, ws in toks.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in c for w in ws), total)
        assert r.base_score == pytest.approx(sum(log10((c[w] + 0.5) / floor) for w in ws), abs=1e-6)


def test_removed_bytes_and_repeats_against_all_windows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect())
    first: dict[bytes, int] = {}
    for i, t in rows:
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    want = {}
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(t)) if gone[k] and (not k or not gone[k - 1]))
        want[i] = (len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.deduplicate(docs).collect()} == want
    text, by = dict(rows), {}
    for r in suffixes.repeats(docs).collect():
        by.setdefault((r.repeat, r.size), []).append(text[r.doc_id][r.start : r.start + r.size])
    assert by and all(len(x) > 1 and len(set(x)) == 1 and len(x[0]) == size >= 50 for (_, size), x in by.items())
