"""Code metrics: one vectorised parsing pass emits spaces, closed formulas make metrics of them.

``spaces`` holds one row for every unit, class, function and closure with its own counts; the
values of a file are sums, extremes and averages over its spaces, computed by Catalyst.  Python is read
by its own ``ast`` and ``tokenize``; brace languages by a table-driven lexer.
"""

from __future__ import annotations

import ast
import bisect
import io
import re
import tokenize
from itertools import accumulate
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..session import ship

# Fixed values.
EXTENSIONS = {
    "py": "python", "pyi": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "mjs": "javascript", "cjs": "javascript", "php": "php", "rb": "ruby", "rs": "rust", "go": "go",
    "c": "c", "h": "c", "kt": "kotlin", "kts": "kotlin", "ps1": "powershell", "psm1": "powershell", "md": "markdown", "markdown": "markdown",
}
COUNTS = ("decisions", "cognitive", "exits", "assignments", "branches", "conditions", "args", "attributes", "public_attributes", "methods", "public_methods", "n1", "n2", "t1", "t2", "sloc", "ploc", "blank", "lloc", "cloc")
SCHEMA = "path string, language string, space_id int, parent_id int, depth int, kind string, name string, start_line int, end_line int, error string, " + ", ".join(f"{c} int" for c in COUNTS)


def language(path) -> "F.Column":
    """Language by lower-cased extension, null where unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), ext)


class _Space:
    def __init__(self, sid: int, parent: int | None, depth: int, kind: str, name: str | None, start: int, end: int) -> None:
        self.head = (sid, parent, depth, kind, name, start, end)
        self.n = dict.fromkeys(COUNTS, 0)
        self.ops: list[str] = []
        self.operands: list[str] = []

    def row(self) -> tuple:
        self.n |= {"n1": len(set(self.ops)), "n2": len(set(self.operands)), "t1": len(self.ops), "t2": len(self.operands)}
        return (*self.head, *[self.n[c] for c in COUNTS], sorted(set(self.ops)), sorted(set(self.operands)))


# ------------------------------------------------------------------ Python
_NEST = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match, ast.ExceptHandler, ast.match_case, ast.IfExp)


class _Python(ast.NodeVisitor):
    def __init__(self, text: str) -> None:
        self.rows: list[_Space] = []
        self.stack: list[_Space] = []
        self.nest = 0
        self.depth = 0
        self.open("unit", None, 1, max(1, text.count("\n") + (not text.endswith("\n"))))

    @property
    def at(self) -> dict:
        return self.stack[-1].n

    def open(self, kind: str, name: str | None, start: int, end: int) -> None:
        parent = self.stack[-1].head[0] if self.stack else None
        s = _Space(len(self.rows), parent, len(self.stack), kind, name, start, end)
        s.n["sloc"] = end - start + 1
        self.rows.append(s)
        self.stack.append(s)

    def scope(self, node, kind: str, name: str | None, args: int, body) -> None:
        inside = self.stack[-1]
        if kind == "function" and inside.head[3] == "class":
            public = not name.startswith("_") or name.startswith("__") and name.endswith("__")
            inside.n["methods"] += 1
            inside.n["public_methods"] += public
        self.open(kind, name, node.lineno, node.end_lineno)
        self.at["args"] = args
        saved = self.nest, self.depth
        if kind == "function":
            self.nest, self.depth = 0, self.depth + (1 if any(s.head[3] == "function" for s in self.stack[:-1]) else 0)
        elif kind == "closure":
            self.depth += 1
        for b in body:
            self.visit(b)
        self.nest, self.depth = saved
        self.stack.pop()

    def visit_FunctionDef(self, node) -> None:  # noqa: N802
        for d in node.decorator_list:
            self.visit(d)
        a = node.args
        self.scope(node, "function", node.name, len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg), node.body)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Lambda(self, node) -> None:  # noqa: N802
        self.scope(node, "closure", None, len(node.args.args) + len(node.args.kwonlyargs), [node.body])

    def visit_ClassDef(self, node) -> None:  # noqa: N802
        self.scope(node, "class", node.name, 0, node.body)

    def generic_visit(self, node) -> None:
        n = self.at
        if isinstance(node, ast.stmt):
            n["lloc"] += 1
            if self.stack[-1].head[3] == "class" and isinstance(node, (ast.Assign, ast.AnnAssign)):
                for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(t, ast.Name):
                        n["attributes"] += 1
                        n["public_attributes"] += not t.id.startswith("_")
        if isinstance(node, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.ExceptHandler, ast.match_case)):
            n["decisions"] += 1
            n["conditions"] += 1
            n["decisions"] += isinstance(node, (ast.For, ast.AsyncFor, ast.While)) and bool(node.orelse)
        if isinstance(node, ast.BoolOp):
            n["decisions"] += len(node.values) - 1
            n["cognitive"] += 1
        if isinstance(node, ast.comprehension):
            n["decisions"] += 1 + len(node.ifs)
        if isinstance(node, ast.Compare):
            n["conditions"] += len(node.ops)
        if isinstance(node, (ast.Return, ast.Raise)):
            n["exits"] += 1
        if isinstance(node, (ast.Assign, ast.AugAssign, ast.NamedExpr)) or isinstance(node, ast.AnnAssign) and node.value:
            n["assignments"] += 1
        if isinstance(node, ast.Call):
            n["branches"] += 1
        if isinstance(node, ast.If) and getattr(node, "elif_", False):
            n["cognitive"] += 1
            self.parts(node)
        elif isinstance(node, _NEST):
            n["cognitive"] += 1 + self.nest + self.depth
            self.nest += 1
            self.parts(node)
            self.nest -= 1
        else:
            super().generic_visit(node)

    def parts(self, node) -> None:
        """Children; an else that holds just an if is an elif, any other else or finally costs one."""
        orelse = getattr(node, "orelse", None)
        if isinstance(orelse, list) and orelse:
            if isinstance(node, ast.If) and len(orelse) == 1 and isinstance(orelse[0], ast.If):
                orelse[0].elif_ = True
            else:
                self.at["cognitive"] += 1
        if getattr(node, "finalbody", None):
            self.at["cognitive"] += 1
        super().generic_visit(node)


def _python(text: str) -> tuple[list[_Space], str | None]:
    tree = ast.parse(text)
    v = _Python(text)
    for s in tree.body:
        v.visit(s)
    return v.rows, None


def _python_tokens(text: str, rows: list[_Space]) -> None:
    docs = set()
    for n in ast.walk(ast.parse(text)):
        if isinstance(n, (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and n.body and isinstance(n.body[0], ast.Expr) and isinstance(n.body[0].value, ast.Constant) and isinstance(n.body[0].value.value, str):
            docs.add((n.body[0].lineno, n.body[0].col_offset))
    code, comments, owner = set(), set(), _owners(rows)
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        lines = range(t.start[0], t.end[0] + 1)
        if t.type == tokenize.COMMENT or t.type == tokenize.STRING and t.start in docs:
            comments.update(lines)
        elif t.type in (tokenize.OP, tokenize.NAME, tokenize.NUMBER, tokenize.STRING):
            code.update(lines)
            s = owner[t.start[0]] if t.start[0] < len(owner) else rows[0]
            import keyword

            if t.type == tokenize.OP and t.string not in ")]}" or t.type == tokenize.NAME and keyword.iskeyword(t.string) and t.string not in ("True", "False", "None"):
                s.ops.append(t.string)
            elif t.type != tokenize.OP:
                s.operands.append(t.string)
    _fill_lines(rows, code, comments)


def _owners(rows: list[_Space]) -> list[_Space]:
    """The innermost space of every line; spaces come outer ones first."""
    out = [rows[0]] * (max(s.head[6] for s in rows) + 1)
    for s in rows:
        out[s.head[5] : s.head[6] + 1] = [s] * (s.head[6] + 1 - s.head[5])
    return out


def _fill_lines(rows: list[_Space], code: set[int], comments: set[int]) -> None:
    last = max(s.head[6] for s in rows)
    of = {n: [0, *accumulate(test(i) for i in range(1, last + 1))] for n, test in (("ploc", code.__contains__), ("cloc", comments.__contains__), ("blank", lambda i: i not in code and i not in comments))}
    for s in rows:
        for n, sums in of.items():
            s.n[n] = sums[s.head[6]] - sums[max(0, s.head[5] - 1)]


# ------------------------------------------------------------------ brace languages
# What each language counts.
_RULES = {
    "go": {"fn": r"\bfunc\b", "decide": {"if", "for", "case", "&&", "||"}, "nest": {"if", "for", "switch", "select"}, "exit": {"return"}, "kw": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"},
    "c": {"fn": None, "decide": {"if", "for", "while", "do", "case", "?", "&&", "||"}, "nest": {"if", "for", "while", "do", "switch", "?"}, "exit": {"return"}, "kw": "auto break case const continue default do else enum extern for goto if inline register return sizeof static struct switch typedef union volatile while"},
    "rust": {"fn": r"\bfn\b", "decide": {"if", "for", "while", "loop", "=>", "?", "&&", "||"}, "nest": {"if", "for", "while", "loop", "match"}, "exit": {"return", "?"}, "kw": "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait type unsafe use where while"},
    "javascript": {"fn": r"\bfunction\b", "decide": {"if", "for", "while", "do", "case", "catch", "?", "&&", "||"}, "nest": {"if", "for", "while", "do", "switch", "try", "catch", "?"}, "exit": {"return", "throw"}, "kw": "async await break case catch class const continue default delete do else export extends finally for from function if import in instanceof let new of return static super switch this throw try typeof var void while yield"},
    "php": {"fn": r"\bfunction\b|\bfn\b", "decide": {"if", "elseif", "for", "foreach", "while", "do", "case", "catch", "?", "&&", "||", "and", "or"}, "nest": {"if", "for", "foreach", "while", "do", "switch", "match", "try", "catch", "?"}, "exit": {"return", "throw", "exit", "die"}, "kw": "abstract and as break case catch class const continue default do echo else elseif extends final finally fn for foreach function if implements interface match namespace new or private protected public return static switch throw trait try use while xor"},
    "kotlin": {"fn": r"\bfun\b", "decide": {"if", "for", "while", "do", "->", "&&", "||"}, "nest": {"if", "for", "while", "do", "when", "catch"}, "exit": {"return", "throw"}, "kw": "as break class companion continue data do else enum false for fun if import in interface internal is null object open override package private protected public return sealed super this throw true try typealias val var when while"},
    "ruby": {"fn": r"\bdef\b", "decide": {"if", "unless", "while", "until", "for", "when", "in", "rescue", "&&", "||"}, "nest": {"if", "unless", "while", "until", "for", "case", "rescue"}, "exit": {"return", "break", "next", "redo"}, "kw": "alias and begin break case class def do else elsif end ensure for if in module next nil not or redo rescue retry return self super then undef unless until when while yield"},
    "powershell": {"fn": r"(?i)\bfunction\b", "decide": {"if", "elseif", "for", "foreach", "while", "do", "catch", "trap", "??", "-and", "-or", "&&", "||"}, "nest": {"if", "for", "foreach", "while", "do", "switch", "catch", "??"}, "exit": {"return", "throw", "exit"}, "kw": "begin break catch class continue data do dynamicparam else elseif end exit filter finally for foreach from function if in param process return switch throw trap try until using while"},
}
_RULES |= {k: _RULES["javascript"] for k in ("typescript", "tsx", "jsx")}
_TOKEN = re.compile(r"(?P<comment>//[^\n]*|/\*.*?\*/|(?<![\w$])#(?![\[!{])[^\n]*)|(?P<text>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<num>\d[\w.]*)|(?P<name>[A-Za-z_$@][\w$]*)|(?P<op>-and\b|-or\b|<=>|===|!==|\?\?|\?\.|=>|->|&&|\|\||[-+*/%&|^]=|\+\+|--|[<>=!]=|:=|::|[^\s\w])", re.S)
_HASH = {"php", "ruby", "powershell"}


def _ruby_marks(toks: list[tuple[int, str, str]], starts: list[int]) -> list[tuple[int, str, str]]:
    """Ruby's blocks as braces (of kind ``mark``, which count for nothing else): after the line of what opens one, and at ``end``."""
    out: list[tuple[int, str, str]] = []
    line, head, loop = -1, False, False
    for i, (at, kind, t) in enumerate(toks):
        here = bisect.bisect_left(starts, at)
        if here != line:
            out += [(at, "mark", "{")] * head
            line, head, loop = here, False, False
            first = True
        before = toks[i - 1][2] if i and not first else ""
        if kind == "name" and t == "end" and before != ".":
            out += [(at, "mark", "{")] * head
            head = False
            out.append((at, "mark", "}"))
        out.append((at, kind, t))
        if kind == "name" and before != ".":
            # A condition after a statement opens nothing.
            opens = t in ("def", "class", "module", "begin", "case") or t in ("if", "unless", "while", "until", "for") and (first or before in ("=", "(", ",", "{", "return"))
            head = head or opens and not (t == "class" and before == "<<")
            loop = loop or opens and t in ("while", "until", "for")
            if t == "do" and not loop:
                out.append((at, "mark", "{"))
        first = False
    return out + [(toks[-1][0], "mark", "{")] * head if toks else out


def _closing(toks: list[tuple[int, str, str]], opened: int) -> int:
    """The place of the bracket that ends the one at ``opened``."""
    level = 0
    for i in range(opened, len(toks)):
        level += (toks[i][2] == "(") - (toks[i][2] == ")")
        if level == 0:
            return i
    return len(toks) - 1


def _braces(text: str, lang: str) -> tuple[list[_Space], str | None]:
    rule, keywords = _RULES[lang], set(_RULES[lang]["kw"].split())
    n_lines = max(1, text.count("\n") + (not text.endswith("\n")))
    unit = _Space(0, None, 0, "unit", None, 1, n_lines)
    unit.n["sloc"] = n_lines
    rows, stack = [unit], [(unit, -1)]  # open spaces with the brace depth that ends them
    code, comments, depth, nest, pending = set(), set(), 0, [], None
    toks = []
    for m in _TOKEN.finditer(text):
        if m.lastgroup == "comment" and m[0][0] == "#" and lang not in _HASH:
            toks.append((m.start(), "op", "#"))
            continue
        toks.append((m.start(), m.lastgroup, m[0]))
    starts = [i for i, c in enumerate(text) if c == "\n"]
    if lang == "ruby":
        toks = _ruby_marks(toks, starts)
    script = _RULES[lang] is _RULES["javascript"]
    # Keywords whose block has not opened, each as the round brackets and braces around it.
    waiting, paren = [], 0
    bare = lang in ("go", "rust")  # conditions need no brackets

    def after(i: int) -> str:
        return next((x[2] for x in toks[i + 1 :] if x[1] != "comment"), "") if i + 1 < len(toks) and toks[i + 1][1] == "comment" else toks[i + 1][2] if i + 1 < len(toks) else ""

    is_fn = re.compile(rule["fn"]) if rule["fn"] else None
    last_op = None
    for i, (at, kind, t) in enumerate(toks):
        line = bisect.bisect_left(starts, at) + 1
        span = range(line, line + t.count("\n") + 1)
        if kind == "comment":
            comments.update(span)
            continue
        code.update(span)
        space = stack[-1][0]
        n = space.n
        nxt = toks[i + 1][2] if i + 1 < len(toks) else ""
        if lang == "go" and t == "func" and nxt == "(":
            # A method's receiver stands before its name; a literal has none.
            close = _closing(toks, i + 1)
            named = close + 1 < len(toks) and toks[close + 1][1] == "name" and close + 2 < len(toks) and toks[close + 2][2] == "("
            pending = ("function", toks[close + 1][2], line, close + 1) if named else ("closure", None, line, i)
        elif script and t == "=>":
            first = _opening(toks, i - 1) if toks[i - 1][2] == ")" else i - 1
            pending = ("closure", None, line, first)
            if nxt != "{":  # an expression: its tokens stay with the space around it
                s = _Space(len(rows), space.head[0], len(stack), "closure", None, line, line)
                s.n["args"], s.n["sloc"] = _arrow_args(toks, first, i), 1
                rows.append(s)
                pending = None
        elif script and kind == "name" and nxt == "(" and len(stack) > 1 and space.head[3] == "class" and depth == stack[-1][1] and after(_closing(toks, i + 1)) == "{" and t not in ("if", "for", "while", "switch", "catch", "function"):
            pending = ("function", t, line, i)
        elif lang == "powershell" and t.lower() == "param" and nxt == "(" and space.head[3] == "function":
            space.n["args"] = _args([x[2] for x in toks[i : _closing(toks, i + 1) + 1] if x[1] != "comment"])
        elif kind == "name" and is_fn and is_fn.fullmatch(t) or lang == "c" and t == "{" and depth == 0 and i and toks[i - 1][2] == ")":
            pending = ("function", nxt if lang != "c" else None, line, i)
        elif kind == "name" and t in ("class", "interface", "trait", "impl", "object", "module") and t in keywords:
            pending = (t if t not in ("object", "module") else "class", nxt, line, i)
        if kind in ("op", "mark") and t == "{":
            depth += 1
            if pending:
                what, name, start, from_tok = pending
                s = _Space(len(rows), space.head[0], len(stack), what, name, start, start)
                first = from_tok if lang != "c" or what != "function" else _opening(toks, i - 1)
                head = [x[2] for x in toks[first:i] if x[1] != "comment"]
                s.n["args"] = _arrow_args(toks, first, i - 1) if script and what == "closure" else _bare_args(head) if lang == "ruby" and what == "function" and "(" not in head else _args(head)
                if what == "function" and space.head[3] in ("class", "interface", "trait", "impl"):
                    hidden = {"private", "protected"} & {x[2] for x in toks[max(0, from_tok - 3) : from_tok]}
                    n["methods"] += 1
                    n["public_methods"] += not hidden
                rows.append(s)
                stack.append((s, depth))
                nest.append((depth, "space"))
                pending = None
            else:
                while waiting and waiting[-1] == (paren, depth - 1):
                    waiting.pop()
                    nest.append((depth, "block"))
        elif kind in ("op", "mark") and t == "}":
            while nest and nest[-1][0] == depth:
                nest.pop()
            while waiting and waiting[-1][1] >= depth:
                waiting.pop()
            if len(stack) > 1 and stack[-1][1] == depth:
                s, _ = stack.pop()
                s.head = (*s.head[:6], line)
                s.n["sloc"] = line - s.head[5] + 1
            depth = max(0, depth - 1)
        elif kind == "op" and t == "(":
            paren += 1
        elif kind == "op" and t == ")":
            paren = max(0, paren - 1)
            if not bare and after(i) != "{" and after(i) not in rule["nest"]:  # a body without braces
                while waiting and waiting[-1] == (paren, depth):
                    waiting.pop()
        elif kind == "op" and t == ";":
            while not bare and waiting and waiting[-1] == (paren, depth):
                waiting.pop()
        elif kind == "name" and (t in rule["nest"] and (i == 0 or toks[i - 1][2] != "else") or t in ("else", "elseif", "elsif") and (after(i) in ("{", "if") or t != "else")):
            waiting.append((paren, depth))
        level = 0
        for _, what in reversed(nest):
            if what == "space":
                break
            level += 1
        prev = toks[i - 1][2] if i else ""
        if t in rule["decide"] and not (t == "?" and lang in ("kotlin",)):
            n["decisions"] += 1
            n["conditions"] += 1
        if t in rule["nest"]:
            n["cognitive"] += 1 if prev == "else" and t == "if" and lang != "javascript" else 1 + level
        elif t == "else" and nxt != "if" or t in ("elseif", "elsif", "finally"):
            n["cognitive"] += 1
        if t in ("&&", "||", "-and", "-or"):
            n["cognitive"] += t != last_op
            last_op = t
        elif t in (";", "{", "}"):
            last_op = None
        if t in rule["exit"]:
            n["exits"] += 1
        if t in ("=", ":=", "++", "--") or len(t) == 2 and t[1] == "=" and t[0] in "+-*/%&|^":
            n["assignments"] += 1
        if t in ("==", "!=", "<=", ">=", "===", "!==", "<", ">"):
            n["conditions"] += 1
        if t == "(" and i and toks[i - 1][1] == "name" and prev not in keywords and not (i > 1 and is_fn and is_fn.fullmatch(toks[i - 2][2])):
            n["branches"] += 1
        if t == ";" or t in rule["exit"] and nxt not in (";",):
            n["lloc"] += 1
        if kind == "mark":
            continue
        if kind == "op" and t not in ")]}" or kind == "name" and t in keywords:
            space.ops.append(t)
        else:
            if kind in ("name", "num", "text"):
                space.operands.append(t)
    _fill_lines(rows, code, comments)
    return rows, "unbalanced braces" if depth else None


def _opening(toks: list[tuple[int, str, str]], close: int) -> int:
    """The place of the bracket that the one at ``close`` ends."""
    level = 0
    for i in range(close, -1, -1):
        level += (toks[i][2] == ")") - (toks[i][2] == "(")
        if level == 0:
            return i
    return 0


def _arrow_args(toks: list[tuple[int, str, str]], first: int, arrow: int) -> int:
    """Arguments of an arrow function: in brackets, or one name."""
    return _args([x[2] for x in toks[first:arrow] if x[1] != "comment"]) if toks[first][2] == "(" else 1


def _bare_args(head: list[str]) -> int:
    """Arguments that follow a name without brackets."""
    return 1 + head[2:].count(",") if len(head) > 2 else 0


def _args(head: list[str]) -> int:
    if "(" not in head:
        return 0
    level, n, seen = 0, 0, False
    for t in head[head.index("(") :]:
        level += t in "([{"
        level -= t in ")]}"
        seen = seen or level >= 1 and t not in "()" and t != "void"
        n += t == "," and level == 1
        if level == 0:
            break
    return n + 1 if seen else 0


# ------------------------------------------------------------------ operators
def analyze(path: str, text: str, lang: str) -> list[tuple]:
    """Space rows of one file; a file that cannot be parsed has one unit with the error."""
    error = None
    try:
        if lang == "python":
            rows, error = _python(text)
            _python_tokens(text, rows)
        else:
            rows, error = _braces(text, lang)
    except (SyntaxError, ValueError, RecursionError, tokenize.TokenError) as e:
        rows, error = [_Space(0, None, 0, "unit", None, 1, max(1, text.count("\n")))], f"{lang}.parse_error: {type(e).__name__}"
    out = []
    for s in rows:
        sid, parent, depth, kind, name, start, end = s.head
        out.append((path, lang, sid, parent, depth, kind, name, start, end, error, *s.row()[7:]))
    return out


def spaces(files: DataFrame) -> DataFrame:
    """All spaces of the files ``(path, text)`` whose language is known; others are dropped before parsing."""
    return _spaces(files).drop("op_set", "operand_set")


def _spaces(files: DataFrame) -> DataFrame:
    ship(files.sparkSession)
    schema = SCHEMA + ", op_set array<string>, operand_set array<string>"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for p, t, lang in zip(f["path"], f["text"], f["language"]) for r in analyze(p, t or "", lang)]
            out = pd.DataFrame(rows, columns=names)
            out["parent_id"] = out["parent_id"].astype("Int32")
            yield out

    known = files.select("path", "text", language("path").alias("language")).where("language is not null and language <> 'markdown'")
    return known.mapInPandas(run, schema)


def metrics(files: DataFrame) -> DataFrame:
    """One row of metrics for every file, rolled up from its spaces."""
    s = _spaces(files)
    fn, cl = F.col("kind") == "function", F.col("kind") == "closure"
    cyclo = F.col("decisions") + 1
    total = {c: F.sum(c).alias(c) for c in ("cognitive", "exits", "assignments", "branches", "conditions", "lloc", "t1", "t2", "methods", "public_methods", "attributes", "public_attributes")}
    unit = lambda c: F.max(F.when(F.col("space_id") == 0, F.col(c)))
    per = s.groupBy("path", "language").agg(
        *total.values(), F.first("error").alias("error"), F.count("*").alias("spaces"), F.sum(fn.cast("long")).alias("functions"), F.sum(cl.cast("long")).alias("closures"),
        F.sum(cyclo).alias("cyclomatic_sum"), F.max(cyclo).alias("cyclomatic_max"), F.min(cyclo).alias("cyclomatic_min"), F.sum(F.when(fn | cl, F.col("args")).otherwise(0)).alias("nargs"),
        unit("sloc").alias("sloc"), unit("ploc").alias("ploc"), unit("cloc").alias("cloc"), unit("blank").alias("blank"),
        # A file's vocabulary is the union of those of its spaces.
        *[F.size(F.array_distinct(F.flatten(F.collect_list(c)))).alias(n) for c, n in (("op_set", "n1"), ("operand_set", "n2"))],
    )
    parents = s.select("path", F.col("space_id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    wmc = s.where(fn).join(parents, ["path", "parent_id"]).where("parent_kind in ('class', 'impl')").groupBy("path").agg(F.sum(cyclo).alias("wmc"))
    j = per.join(wmc, "path", "left")
    h = expr.halstead("n1", "n2", "t1", "t2")
    j = j.select("*", *[v.alias(f"halstead_{k}") for k, v in h.items()])
    mi = expr.maintainability("halstead_volume", "cyclomatic_sum", "sloc", expr.ratio("cloc", "sloc"))
    return j.select(
        "path", "language", "error", "spaces", "functions", "closures", "nargs", "cyclomatic_sum", "cyclomatic_min", "cyclomatic_max", F.round(F.col("cyclomatic_sum") / F.col("spaces"), 6).alias("cyclomatic_avg"),
        "cognitive", F.round(expr.ratio("cognitive", F.col("functions") + F.col("closures")), 6).alias("cognitive_avg"), F.col("exits").alias("nexit"), F.round(expr.abc("assignments", "branches", "conditions"), 6).alias("abc"),
        "sloc", "ploc", "cloc", "lloc", "blank", F.coalesce("wmc", F.lit(0)).alias("wmc"), F.col("public_methods").alias("npm"), F.col("public_attributes").alias("npa"),
        *[F.round(f"halstead_{k}", 6).alias(f"halstead_{k}") for k in h], *[F.round(v, 6).alias(k) for k, v in mi.items()],
    )
