"""What the text operators keep on disk, and that nothing is lost by it."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexigrain.llm import common, line_dedup, near_dedup


def _banded(spark, pairs):
    """All nodes in one bucket, two and two with nearly the same set."""
    rows, sets = [], []
    for p in range(pairs):
        for side in (0, 1):
            node = 10 * p + side + 1
            rows.append(([node], [20], near_dedup.packed(np.array([[7]], np.uint64))[0]))
            sets.append((node, [1000 * p + i for i in range(19)] + [1000 * p + 500 + side]))
    return spark.createDataFrame(rows, "reps array<bigint>, ns array<bigint>, bands binary"), spark.createDataFrame(sets, "rep bigint, items array<bigint>")


def test_small_buckets_are_compared_pair_by_pair_and_large_ones_by_the_filter(spark, monkeypatch):
    banded, sets = _banded(spark, 8)
    ask = lambda within: {(r.id, r.comp) for r in near_dedup.connect(banded, lambda ids: sets.join(ids, "rep"), 80, 100, within=within).collect()}
    want = {(10 * p + side + 1, 10 * p + 1) for p in range(8) for side in (0, 1)}
    assert ask(4) == want  # the bucket is larger, so the filter has it

    def never(*_):
        raise AssertionError("no filter for small buckets")

    monkeypatch.setattr(near_dedup, "_rest", never)
    assert ask(64) == want


def test_pairs_that_their_marks_rule_out_are_not_compared_in_full(spark, monkeypatch):
    banded, sets = _banded(spark, 6)
    full, seen = near_dedup._verified, []

    def verified(pairs, *how):
        seen.extend(map(tuple, pairs.collect()))
        return full(pairs, *how)

    monkeypatch.setattr(near_dedup, "_verified", verified)
    assert near_dedup.connect(banded, lambda ids: sets.join(ids, "rep"), 80, 100, within=64).count() == 12
    assert sorted(seen) == [(10 * p + 1, 10 * p + 2) for p in range(6)]


def test_bucket_words_travel_as_their_differences():
    w = common.distinct(np.random.default_rng(0).integers(0, 1 << 52, 6000))
    assert (near_dedup._words(near_dedup._steps(w)) == w).all()
    raw = np.frombuffer(near_dedup._steps(w), np.uint8).reshape(7, -1)
    assert not raw[6].any()
    keys = np.random.default_rng(1).integers(0, 1 << 63, (3, 5), dtype=np.uint64)
    assert all(len(x) == 25 for x in near_dedup.packed(keys))


def test_distinct_is_what_unique_says():
    x = np.random.default_rng(2).integers(0, 50, 200).astype(np.uint64)
    assert (common.distinct(x) == np.unique(x)).all() and len(common.distinct(x[:0])) == 0


def test_line_stage_leaves_no_table_of_lines(spark, monkeypatch):
    made, gone = [], []
    stage, discard = common.stage, common.discard
    monkeypatch.setattr(common, "stage", lambda df, name: made.append((name, t := stage(df, name))) or t)
    monkeypatch.setattr(common, "discard", lambda *ts: gone.extend(t._lexigrain_path for t in ts) or discard(*ts))
    text = "the quick brown fox jumps over the lazy dog near the old river bank"
    docs = spark.createDataFrame([(1, text), (2, "x\n" + text + "!"), (3, text)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.lines) for r in line_dedup.removed(docs).collect()) == [(2, [1]), (3, [0])]
    left = {name for name, t in made if t._lexigrain_path not in gone}
    assert not left & {"lines", "classes", "repeated", "sets", "marks"}


def test_rewriting_lines_moves_only_texts_that_lose_some(spark):
    docs = spark.createDataFrame([(i, f"text {i} of its own\nand more {i}") for i in range(2000)] + [(None, "text")], "doc_id bigint, text string")
    gone = common.stage(docs.where("doc_id in (3, 5)").select("doc_id", F.xxhash64("text").alias("tkey"), F.array(F.lit(0)).alias("lines")), "t")
    moved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = line_dedup.rewrite(docs, gone)
        got = {r.doc_id: r.text for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", moved)
    assert out.columns == docs.columns and len(got) == 2001 and got[None] == "text"
    assert {i: t for i, t in got.items() if t is not None and "\n" not in t and i is not None} == {3: "and more 3", 5: "and more 5"}
    rows = [int(x) for x in re.findall(r"shuffle records written: (\d+)", _metrics(plan))]
    assert rows and max(rows) < 20


def _metrics(node) -> str:
    """``name: value`` of all nodes of a plan that has run."""
    found, todo = [], [node]
    while todo:
        x = todo.pop()
        it = x.metrics().iterator()
        while it.hasNext():
            m = it.next()._2()
            found.append(f"{m.name().get()}: {m.value()}")
        kind = x.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(x.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(x.plan())
        children = x.children().iterator()
        while children.hasNext():
            todo.append(children.next())
    return "\n".join(found)


def test_small_graph_is_solved_in_one_task_as_by_rounds(spark):
    rng = np.random.default_rng(5)
    edges = common.stage(spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(-90, 90, (70, 2))] + [(i, i + 1) for i in range(1000, 1040)], "a bigint, b bigint"), "t")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("small", "small")
    got = common.small_components(edges)
    n = len(jobs.getJobIdsForGroup("small"))
    spark.sparkContext.setJobGroup("", "")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, common.components(edges).collect()))
    assert n == 1


def test_shingle_numbers_decide_as_shingles_do():
    forms = ["abc", "abc\0", "abcd", "the quick brown fox jumps over", "the quick brown fox jumps over!", "smile \U0001f600 and the world smiles", "smile \U0001f601 and the world smiles", "aaaaaaaa", "aaaa"]
    pairs = [(x, y) for x in forms for y in forms]
    test = line_dedup._alike(4, 80, 100)()
    want = [len(a & b) * 100 >= 80 * len(a | b) for a, b in ((line_dedup._shingles(x, 4), line_dedup._shingles(y, 4)) for x, y in pairs)]
    assert test([x for x, _ in pairs], [y for _, y in pairs]) == want


def test_sieve_has_what_was_put_in(spark):
    ids = spark.range(0, 3000).selectExpr("id * 7919 as x")
    sieve = common.Sieve(ids, common.key_slot("x"))
    x = np.arange(0, 3000) * 7919
    assert sieve.passes(x).all() and not sieve.passes(x + 1).any() and sieve.passes(np.array([0]))[0]


def test_rows_dealt_to_slots_come_back(spark):
    t = np.arange(12).reshape(3, 4) - 5
    rows = list(common.deal(iter([t]), 1, 5, 1))
    empty, back = common.gathered(iter([{"kind": pa.array(r["kind"]), "cells": pa.array(r["cells"])} for r in rows]), 2, 3)
    assert empty.shape == (2, 0) and sorted(map(tuple, back.T)) == sorted(map(tuple, t.T))
    sets = [np.array([1, 2, 3], np.uint64), np.array([9], np.uint64)]
    assert (near_dedup.all_parities(sets) == np.stack([near_dedup.parities(x) for x in sets])).all()


def test_rows_dealt_follow_the_members_and_not_the_square_of_the_partitions(spark, monkeypatch):
    rng = np.random.default_rng(3)
    reps = [int(x) for x in rng.integers(-(2**62), 2**62, 600)]
    keys = rng.integers(0, 2**63, (600, 3), dtype=np.uint64)
    keys[:, 0] = keys[np.arange(600) // 3 * 3, 0]
    names = near_dedup.packed(keys)
    banded = spark.createDataFrame([([r], b) for r, b in zip(reps, names)], "reps array<bigint>, bands binary")
    monkeypatch.setattr(common, "partitions", lambda _: 150)
    members, n = near_dedup._members(banded)
    rows = members.collect()
    t = np.concatenate([common.table(r.cells, 5) for r in rows], axis=1)
    assert len(rows) <= n < 10 and sorted(t[1].tolist()) == sorted(reps)
    # A bucket whose size the bits do not tell takes all slots.
    assert near_dedup._spread(spark.createDataFrame([(1, 4090)], "h bigint, m bigint")) == 600
    assert near_dedup._spread(spark.createDataFrame([(i, 3000) for i in range(20)], "h bigint, m bigint")) == 1 + int(-20 * 4096 * np.log1p(-3000 / 4096)) // 4096


def test_only_sets_that_pairs_name_are_moved(spark, monkeypatch):
    sets = spark.range(2000).selectExpr("id as rep", "'x' as items")
    pairs = spark.createDataFrame([(3, 5), (7, 5)], "a bigint, b bigint")
    for few in (0, 1 << 16):
        monkeypatch.setattr(near_dedup, "_FEW", few)
        got = {r.rep for r in near_dedup._asked(sets, pairs, 2, 2000).collect()}
        assert {3, 5, 7} <= got and len(got) < 20
    assert near_dedup._asked(sets, pairs, 1500, 2000) is sets


def test_rewritten_text_moves_once_and_compressed(spark):
    docs = spark.createDataFrame([(i, f"gone\nline {i}" + f"\nsome words {i} and more" * 900) for i in range(200)] + [(900, "gone\n \t"), (901, "\u00e9\ngone\n\n"), (902, None)], "doc_id bigint, text string")
    lost = F.when(F.col("doc_id") == 901, F.array(F.lit(1))).otherwise(F.array(F.lit(0)))
    kept = line_dedup._packed(np.array([True, True, False]), pa.array(["", None, "x"]))
    assert line_dedup._without(kept, pa.array([None, None, None], pa.list_(pa.int32()))).to_pylist() == ["", None, None] and kept[2].as_py() is None
    gone = common.stage(docs.where("doc_id <> 902").select("doc_id", F.xxhash64("text").alias("tkey"), lost.alias("lines")), "t")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = line_dedup.rewrite(docs, gone)
        got = {r.doc_id: r.text for r in out.collect()}
        sizes = [int(x) for x in re.findall(r"data size: (\d+)", _metrics(out._jdf.queryExecution().executedPlan()))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == {r.doc_id: r.text.removeprefix("gone\n") for r in docs.where("doc_id < 900").collect()} | {901: "\u00e9\n\n", 902: None}
    plan = line_dedup.rewrite(docs, gone)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and re.search(r"_without.*REPARTITION_BY_COL.*<lambda>", plan, re.S)
    # 200 texts of over 20,000 characters.
    assert sizes and sum(sizes) < 400_000


def test_lines_that_are_spaced_already_keep_their_form():
    lines = ["", " ", "a b", "a  b", " a", "a ", "a\tb", "a\xa0b", "a b", "a\x1cb", "a\x85b", "　", "a​b", "a\rb", "a b", "é \U0001f600", "\ud800 x"]
    lines += [f"x{chr(c)}y" for c in range(0x3100)]
    assert [line_dedup.form(x) for x in lines] == [" ".join(x.lower().split()) for x in lines]
