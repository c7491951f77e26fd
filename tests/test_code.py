from lexigrain.operators import code, corpus, markdown
from lexigrain.sources.files import glob_pattern
import re

PY = "def f(x, y):\n    if x and y:\n        return 1\n    elif x:\n        return 2\n    else:\n        return 3\n\n\nclass A:\n    n = 1\n    _m = 2\n\n    def g(self):\n        return [i for i in range(3) if i]\n"


def counts(text, lang):
    names = [c.split()[0] for c in code.SCHEMA.split(", ")]
    return [dict(zip(names, r)) for r in code.analyze("p", text, lang)]


def test_python_spaces():
    unit, f, a, g = counts(PY, "python")
    assert [s["kind"] for s in (unit, f, a, g)] == ["unit", "function", "class", "function"]
    assert (f["decisions"], f["args"], f["exits"]) == (3, 2, 3)
    assert f["cognitive"] == 1 + 1 + 1 + 1  # if, boolean sequence, elif, else
    assert (a["attributes"], a["public_attributes"], a["methods"], a["public_methods"]) == (2, 1, 1, 1)
    assert g["decisions"] == 2 and g["parent_id"] == a["space_id"]


def test_broken_python_is_reported():
    (unit,) = counts("def f(:\n", "python")
    assert unit["error"].startswith("python.parse_error")


def test_go():
    rows = counts("package p\n\nfunc f(a int, b int) int {\n\tif a > b && b > 0 {\n\t\treturn a\n\t}\n\treturn b\n}\n", "go")
    assert [r["kind"] for r in rows] == ["unit", "function"]
    assert (rows[1]["decisions"], rows[1]["args"], rows[1]["exits"]) == (2, 2, 2)


def test_c_arguments_at_any_distance():
    rows = counts("int f(void) { return a ? 1 : 0; } int g(int a, int b) { return a; }\nint h(" + ", ".join(f"const struct item *p{i}" for i in range(9)) + ") { return 0; }\n", "c")
    assert [r["args"] for r in rows if r["kind"] == "function"] == [0, 2, 9]


def test_nesting_belongs_to_the_keywords_own_block():
    long = " + ".join(f"a{i}" for i in range(40))
    (f,) = counts("int f(int a) { if (" + long + ") { if (a) { a = 1; } } else { a = 2; } }\n", "c")[1:]
    assert f["cognitive"] == 1 + 2 + 1
    (f,) = counts("int f(int a) { if (a) a = 1; { if (a) { a = 2; } } for (;;) { while (a) a--; } }\n", "c")[1:]
    assert f["cognitive"] == 1 + 1 + 1 + 2


def test_markdown_blocks():
    kinds = [b["kind"] for b in markdown.blocks("---\na: 1\n---\n# T\n\npara\n\n- x\n\n> q\n\n| a | b |\n|--|--|\n| 1 | |\n\n```py\nx\n```\n")]
    assert [k for k in kinds if k != "blank"] == ["metadata", "heading", "paragraph", "item", "quote", "table", "code"]
    assert markdown.blocks("a\r\n\r\nb\r\n") == markdown.blocks("a\n\nb\n")


def test_diagram_cycle():
    assert markdown.diagram("graph TD\nA-->B\nB-->C\nC-->A") == (3, 3, 1)


def test_globs():
    assert re.match(glob_pattern("*.py"), "/a/b.py") and not re.match(glob_pattern("*.py"), "/a/b.pyc")
    assert re.match(glob_pattern("src/**/x?.{rs,go}"), "/r/src/a/b/x1.go")


def test_change_fold(spark):
    rows = [(1, "a", "added"), (2, "a", "modified"), (1, "b", "deleted"), (2, "b", "added"), (1, "c", "added"), (2, "c", "deleted"), (1, "d", "modified")]
    got = corpus.fold_changes(spark.createDataFrame(rows, "ord int, path string, status string")).collect()
    assert {r.path: r.status for r in got} == {"a": "added", "b": "modified", "d": "modified"}


def test_deepest(spark):
    t = spark.createDataFrame([("p", 1, 5, 6), ("p", 2, 0, 1)], "path string, token int, start int, end int")
    s = spark.createDataFrame([("p", 0, 0, 9), ("p", 1, 4, 8), ("p", 2, 5, 7)], "path string, space_id int, start int, end int")
    assert {r.token: r.space_id for r in corpus.deepest(t, s).collect()} == {1: 2, 2: 0}


def test_selectors():
    assert [s[0] for s in corpus.parse_selectors(["abc", "unknown", "-mi.visual_studio"])] == ["abc", "mi.visual_studio"]
    assert corpus.parse_selectors(["-mi.visual_studio"])[0][2] is False


def _heads(path, text):
    names = [f.split()[0] for f in code.SCHEMA.split(", ")]
    rows = [dict(zip(names, r)) for r in code.analyze(path, text, code.EXTENSIONS[path.rpartition(".")[2]])]
    return [(r["kind"], r["name"], r["parent_id"], r["start_line"], r["end_line"], r["args"]) for r in rows[1:]], rows


def test_ruby_blocks_end_with_their_keyword():
    heads, rows = _heads("a.rb", "class A\n  def m(a, b)\n    if a\n      b\n    end\n    return a if b\n  end\n\n  def n x\n    [1].each do |i|\n      i\n    end\n  end\nend\n")
    assert heads == [("class", "A", 0, 1, 14, 0), ("function", "m", 1, 2, 7, 2), ("function", "n", 1, 9, 13, 1)]
    assert rows[0]["error"] is None and rows[1]["methods"] == 2 and rows[2]["decisions"] == 2


def test_script_methods_and_arrows_open_spaces():
    heads, _ = _heads("a.js", "class A {\n  m(x, y) { if (x) { return y; } }\n}\nconst f = (a, b) => { return a; }\nconst g = x => x + 1\n")
    assert heads == [("class", "A", 0, 1, 3, 0), ("function", "m", 1, 2, 2, 2), ("closure", None, 0, 4, 4, 2), ("closure", None, 0, 5, 5, 1)]


def test_go_receivers_are_no_names_and_powershell_parameters_count():
    heads, _ = _heads("a.go", "package main\n\nfunc (r T) Name(a int, b int) int {\n\treturn a\n}\nfunc plain() { go func(z int) { return }(1) }\n")
    assert heads == [("function", "Name", 0, 3, 5, 2), ("function", "plain", 0, 6, 6, 0), ("closure", None, 2, 6, 6, 1)]
    assert _heads("a.ps1", "function Show {\n  param($a, $b)\n  if ($a) { return 1 }\n}\n")[0][0][-1] == 2


def test_file_vocabulary_is_a_union_and_trailing_comments_leave_no_blank(spark):
    text = "x = 1  # c\n\ndef f(a):\n    return a\n\ndef g(a):\n    return a\n"
    r = code.metrics(spark.createDataFrame([("a.py", text)], "path string, text string")).first()
    # def ( : return =; x 1 f a g
    assert r.halstead_vocabulary == 10 and r.blank == 2 and r.cloc == 1
