"""Markdown relations on files whose values can be told by eye."""

import pytest

from lexigrain.functions.dialect import SPARK
from lexigrain.operators import documents

HEAD = """# Title

Some words [here](#deep) and [a file](b.md) or [none](c.md) <https://github.com/o/r/issues/12> [^n].

### Deep

| a | b |
|---|:--|
| 1 | |

```
x = 1
```

- [ ] TODO it
- see https://doi.org/10.1/x

# Title

$$
\\alpha + \\beta
$$

[^n]: a note"""
BASE = "# Title\n\nSome words.\n"


@pytest.fixture(scope="module")
def ask(spark):
    rows = [(rev, path, i, line) for rev, path, text in (("base", "a.md", BASE), ("head", "a.md", HEAD), ("head", "b.md", "")) for i, line in enumerate(text.split("\n"), 1)]
    spark.createDataFrame(rows, "rev string, path string, line bigint, raw string").createOrReplaceTempView("given_lines")

    def run(result):
        return [tuple(r) for r in spark.sql(documents.plan(SPARK, {}, result, {"marked": "given_lines"})).collect()]

    return run


def test_sections(ask):
    got = ask("SELECT id, level, start_line, parent, skip, end_line FROM parents WHERE path = 'a.md' AND rev = 'head' ORDER BY id")
    assert got == [(1, 1, 1, 0, 0, 17), (2, 3, 5, 1, 1, 17), (3, 1, 18, 0, 0, 24)]
    assert ask("SELECT slug FROM anchors WHERE rev = 'head' ORDER BY line") == [("title",), ("deep",), ("title-1",)]


def test_links(ask):
    got = ask("SELECT class, dest, ok FROM resolved WHERE rev = 'head' ORDER BY line, class, dest")
    assert got == [("footnote", "n", 1), ("internal", "#deep", 1), ("issue_pr", "https://github.com/o/r/issues/12", None), ("relative", "b.md", 1), ("relative", "c.md", 0), ("scholarly", "https://doi.org/10.1/x", None)]
    assert ask("SELECT total, broken, internal, relative, external, footnote, described FROM link_counts WHERE rev = 'head'") == [(6, 1, 1, 2, 2, 1, 3)]


def test_artifacts(ask):
    assert ask("SELECT rows_, cols, cells, empties, header FROM tables WHERE rev = 'head'") == [(1, 2, 4, 1, 1)]
    assert ask("SELECT loc, tag FROM fence_records WHERE rev = 'head'") == [(1, "")]
    assert ask("SELECT tokens, commands FROM formulas WHERE rev = 'head'") == [(3, 2)]
    assert ask("SELECT kind FROM artifact_ids WHERE rev = 'head' ORDER BY id") == [(2,), (1,), (4,)]
    assert ask("SELECT cloc, tloc, mloc, headings FROM loc WHERE rev = 'head' AND path = 'a.md'") == [(3, 3, 3, 3)]


def test_scores_stay_in_their_ranges_and_empty_files_have_rows(ask):
    got = ask("SELECT path, dmi, rci, filler_risk, grounding, evidence, section_balance FROM documents_ WHERE rev = 'head' ORDER BY path")
    assert [r[0] for r in got] == ["a.md", "b.md"]
    for _, dmi, rci, *shares in got:
        assert 0 <= dmi <= 100 and 0 <= rci <= 100 and all(0 <= x <= 1 for x in shares)
    # Sections 1 and 2 hang together, the two links' targets and the note hang on them.
    assert ask("SELECT sections, linked, domains, notes, large_artifacts FROM graph WHERE rev = 'head' AND path = 'a.md'") == [(3, 2, 2, 1, 0)]


def test_shared_steps_lie_in_buckets_by_path_and_text_is_kept_once(spark, sf):
    """A plan over the shared steps does not shuffle files again, and only one of them holds their text."""
    from lexigrain.plans import documents as md

    out = md.run(spark, sf, md.results(SPARK)["md_section_balance"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    held = next(h for k, h in md._held.items() if any(sf in str(f) for f in k))
    assert len({held[n] for n in ("marked", "blocks", "prose", "counted", "placed")}) == 1


def test_base_lacks_the_last_line_of_every_text_and_numbers_lines_as_the_head_does(spark, sf):
    from lexigrain.plans import documents as md

    spark.createDataFrame([(1, "One two\nthree\nfour five"), (2, "x"), (3, None)], "doc_id bigint, text string").createOrReplaceTempView("few_docs")
    spark.createDataFrame([(7, "<h1>A</h1><p>b</p>")], "page_id bigint, html string").createOrReplaceTempView("few_pages")
    held = {"documents": "few_docs", "pages": "few_pages"}
    known = md.source(SPARK)
    plain = {k: v for k, v in known.items() if k not in ("marked", "numbered")} | {"marked": "SELECT rev, path, raw, row_number() OVER (PARTITION BY rev, path ORDER BY i, part) AS line FROM revised"}
    ask = lambda given: sorted(map(tuple, spark.sql(documents.plan(SPARK, given, "SELECT rev, path, line, raw FROM marked", held)).collect()))
    got = ask(known)
    assert got == ask(plain) and {r[0] for r in got} == {"head", "base"}
    assert {r[1] for r in got if r[0] == "base"} == {"docs/1.md", "pages/7.md"}


def test_text_is_written_once_for_both_revisions(spark, sf):
    """The base's lines are read from the head's rows, and are what the plan without tables says."""
    import re

    from lexigrain.plans import documents as md

    out = md.run(spark, sf, md.results(SPARK)["md_tokens"])
    held = next(h for k, h in md._held.items() if any(sf in str(f) for f in k))
    plan = spark.table(held["placed"])._jdf.queryExecution().optimizedPlan().toString()
    text = spark.table(re.search(r"lexigrain_placed_[0-9a-f]+", plan)[0])
    assert "toks" not in text.columns and text.count() == text.select("path", "line").distinct().count() == spark.table(held["placed"]).where("rev = 'head'").count()
    base = {t: f"plain_{t}" for t in ("documents", "pages")}
    for t, name in base.items():
        spark.read.parquet(f"{sf}/{t}.parquet").createOrReplaceTempView(name)
    for step, cols in (("placed", "rev, path, line, kind, s, toks, fence, formula, fm, raw, words, section"), ("tokens", "rev, path, line, section, tok, class")):
        plain = spark.sql(documents.plan(SPARK, md.source(SPARK), f"SELECT {cols} FROM {step}", base))
        kept = spark.sql(f"SELECT {cols} FROM {held[step]}")
        assert kept.exceptAll(plain).isEmpty() and plain.exceptAll(kept).isEmpty()
    assert out.count() > 0


def test_text_is_sorted_in_as_many_parts_as_it_has_buckets(spark, monkeypatch):
    """Put together by their size in the shuffle, parts would be too large for the sorts of their lines."""
    from lexigrain.plans import documents as md

    seen = []

    def dealt(df, *rest):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        raise InterruptedError

    monkeypatch.setattr(md.stages, "dealt", dealt)
    spark.createDataFrame([(1, "One two")], "doc_id bigint, text string").createOrReplaceTempView("part_docs")
    spark.createDataFrame([(7, "<p>b</p>")], "page_id bigint, html string").createOrReplaceTempView("part_pages")
    with pytest.raises(InterruptedError):
        md._text(spark, md.source(SPARK), {"documents": "part_docs", "pages": "part_pages"}, {}, "parts")
    assert seen[0].count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in seen[0]


def test_only_tokens_that_look_like_paths_leave_their_file(spark):
    rows = [("head", "a.md", 1, "see b.md, b.md and c.md or b"), ("head", "b.md", 1, "x"), ("base", "a.md", 1, "see b.md")]
    spark.createDataFrame(rows, "rev string, path string, line bigint, raw string").createOrReplaceTempView("path_lines")
    out = spark.sql(documents.plan(SPARK, {}, "SELECT rev, path, toks, types, paths, found_paths FROM token_counts", {"marked": "path_lines"}))
    assert sorted(map(tuple, out.collect())) == [("base", "a.md", 2, 2, 1, 0), ("head", "a.md", 7, 6, 3, 2), ("head", "b.md", 1, 1, 0, 0)]
    found = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "tok#" in x]
    assert found and all("Inner" in x for x in found)


def test_sentences_are_counted_once_a_text_and_not_once_a_word(spark):
    from lexigrain.operators import prose

    docs = spark.createDataFrame([(1, "One two. Three!"), (2, None), (3, "")], "doc_id bigint, text string")
    counts = prose.counts(docs)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("[^.!?]*")
    assert [(r.doc_id, r.w, r.s) for r in counts.collect()] == [(1, 3, 2)]
