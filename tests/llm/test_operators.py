"""The text operators on small tables: nulls, empty and repeated rows, clashing columns, empty tables."""

import hashlib
import math
import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexigrain.llm import common, decontaminate, langid, line_dedup, near_dedup, packing, ppm, quality, records, suffixes, topk
from lexigrain.llm.queries import QUERIES

LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, LONG, "en", "a"), (2, LONG, "en", "a"), (3, LONG.replace("w30", "x"), "en", "b"), (4, None, None, None), (5, "", "en", "a"), (6, " \n ", "de", "b"),
    (7, "two words", "de", "a"), (7, "two words", "de", "a"), (8, "TWO  Words", "de", "c"), (None, "no id", "en", "a"), (9, LONG + "\n" + "zebra " * 3000, "en", "a"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"
#: Names that the operators use inside.
CLASH = ("rep", "n", "digest", "h", "comp", "key", "slot", "n_shingles", "lines", "first")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH:
        df = df.withColumn(c, F.lit(0))
    return df


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_near_dedup(docs, none):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[1] == comp[2] == comp[3] == 1 and comp[7] == comp[8] == 7
    assert comp[5] == 5 and comp[6] == 6 and comp[None] is None
    assert {r.doc_id: r.n_shingles for r in got}[4] == 0
    assert near_dedup.near_duplicates(none).count() == 0


def test_line_dedup(docs, none):
    got = {(r.doc_id, r.line): r.kept for r in line_dedup.repeated_lines(docs).collect()}
    assert got[1, 0] and not got[2, 0] and not got[3, 0] and not got[9, 0] and got[9, 1]
    left = line_dedup.rewrite(docs, line_dedup.removed(docs))
    assert left.columns == docs.columns
    texts = {r.doc_id: r.text for r in left.collect()}
    assert 2 not in texts and texts[9].startswith("zebra") and texts[4] is None and texts[None] == "no id"
    assert line_dedup.repeated_lines(none).count() == 0


def test_line_dedup_of_edited_lines_against_brute_force(spark):
    rng = random.Random(5)
    lines = []
    for size in (40, 60, 80, 100):
        for _ in range(6):
            words = []
            while len(" ".join(words)) < size:
                words.append("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8))))
            line, at = " ".join(words)[:size].replace(" ", "-", 1), size // 2
            lines += [line, line[:at] + "#" + line[at + 1 :], " ".join(words[:3] + words[4:])]
    sets = [{f[i : i + 4] for i in range(len(f) - 3)} for f in map(line_dedup.form, lines)]
    root = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                hi, lo = max(root[a], root[b]), min(root[a], root[b])
                root = [lo if r == hi else r for r in root]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    kept = {r.doc_id for r in line_dedup.repeated_lines(df).where("kept").collect()}
    assert kept == {i for i, r in enumerate(root) if r == i}
    assert not any(i in kept for i in range(1, len(lines), 3))  # one character


def test_language_id(docs, none):
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (4, 5, 6)} == {"und"}
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(none)).collect()} == {"und"}


def test_topk(spark):
    rows = [(i, [float((i * 7 + j) % 5) / 4 for j in range(6)]) for i in range(300)] + [(400, None), (401, [None] * 6), (402, [float("nan")] * 6), (7, [0.5] * 6), (None, [1.0] * 6), (500, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1))
    got = topk.top_k(df, F.pmod("vec_id", F.lit(100)) == 0).collect()
    vec = {}
    for i, v in rows:
        if i is not None and v and None not in v and v[0] == v[0]:
            q = [int(1024 * x // 1) for x in v]
            vec[i] = min(vec.get(i, q), q)
    want = []
    for q in (0, 100, 200, 300, 400, 500):
        if q in vec:
            s = sorted((-sum(a * b for a, b in zip(vec[q], v)), i) for i, v in vec.items() if i != q and len(v) == len(vec[q]))[:10]
            want += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_topk_sends_no_copies_of_packs_through_the_driver(spark):
    df = spark.range(3000).selectExpr("id AS vec_id", "transform(sequence(1, 8), i -> CAST(sin(id * i) AS FLOAT)) AS embedding")
    out = topk.top_k(df, F.pmod("vec_id", F.lit(100)) == 0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert out.count() == 300


def test_packing(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(docs, path, 256).collect()
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    nine = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 9)
    assert len(nine) > 1 and all(n == 256 for _, _, n in nine[1:])
    assert sum(r.length for r in got if r.doc_id == 5) == 1
    assert packing.pack(none, path).count() == 0


def test_records(spark, docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = records.write(docs, path, common.new_dir(spark, "t"))
    got = sorted(records.digests(records.read(manifest)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    empty = next(r for r in got if r.doc_id == 5)
    assert (empty.n_tokens, empty.ids_crc32) == (1, zlib.crc32(b"\1\0\0\0"))
    file = manifest.first().path
    assert sorted(map(str, records.read_shuffled(file, 1))) == sorted(map(str, records.read_file(file)))
    assert records.read(records.write(none, path, common.new_dir(spark, "t"))).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.apply(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality.apply(docs, quality.fit(none, labels)).count() == len(ROWS)
    assert quality.keep(docs, quality.fit(none, labels), 0.3).columns == docs.columns


def test_ppm(docs, none):
    got = ppm.score(docs).collect()
    assert len(got) == len(ROWS) and all(r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (4, 5, 6)} == {1}
    assert ppm.score(none).count() == 0


def test_ppm_keeps_every_context(docs):
    after: dict[bytes, dict[int, int]] = {}
    for d, t in (r[:2] for r in ROWS):
        if d is not None and zlib.crc32(str(d).encode()) % 5 != 1:
            b = ppm.stream(t or "")
            for i in range(ppm.ORDER, len(b)):
                for k in range(ppm.ORDER + 1):
                    n = after.setdefault(b[i - k : i], {})
                    n[b[i]] = n.get(b[i], 0) + 1

    def log_p(context: bytes, byte: int) -> float:
        p, seen = 1.0, set()
        for k in range(ppm.ORDER, -1, -1):
            n = {x: c for x, c in after.get(context[ppm.ORDER - k :], {}).items() if x not in seen}
            if byte in n:
                return math.log10(p * n[byte] / (sum(n.values()) + len(n)))
            if n:
                p *= len(n) / (sum(n.values()) + len(n))
                seen |= set(n)
        return math.log10(p / (255 - len(seen)))

    want = []
    for d, t in (r[:2] for r in ROWS):
        b = ppm.stream(t or "")
        want.append((-1 if d is None else d, sum(log_p(b[i - ppm.ORDER : i], b[i]) for i in range(ppm.ORDER, len(b)))))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in ppm.score(docs).collect())
    assert [d for d, _ in got] == [d for d, _ in sorted(want)]
    assert [x for _, x in got] == pytest.approx([x for _, x in sorted(want)], rel=1e-5)


def test_suffix_dedup_against_brute_force(docs, none):
    got = {r.doc_id: r for r in suffixes.deduplicate(docs).collect()}
    seen: dict[bytes, int] = {}
    for d, t in sorted({(r[0], r[1] or "") for r in ROWS if r[0] is not None}):
        b = t.encode()
        on = bytearray(len(b))
        for i in range(len(b) - 49):
            if seen.setdefault(b[i : i + 50], d) < d:
                on[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(b, on) if not m)
        assert (got[d].n_bytes, got[d].n_removed, got[d].kept_sha256) == (len(b), sum(on), hashlib.sha256(kept).hexdigest())
    assert suffixes.deduplicate(docs).count() == len(ROWS) and suffixes.deduplicate(none).count() == 0


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20, 50))), (2, "unseen words in this item here"), (3, None), (4, "two words")], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.report(docs, bench).collect()}
    assert got[1].contaminated and got[1].items == [1] and got[7].items == [4]
    assert not got[5].contaminated and not got[None].contaminated
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(none, bench).count() == 0


def test_held_out_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op3_language_id"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
