"""Markdown documents as relations: lines, blocks, sections, links, artifacts, and the scores of a document.

The plans are SQL over ``marked(rev, path, line, raw)``, the lines of Markdown files in two revisions, and build on each
other as named steps; :func:`plan` joins the steps that a result needs.  Blocks are told by their lines: fences,
``$$`` math, pipe tables, headings, lists, quotes, raw HTML; everything else is prose.  All grouping is by
``(rev, path)``, the lines of one file.

Where the relations stand for less than a full parser: emphasis and nested blocks are not told apart, reference-style
links that lack a definition are not sought, and a relative link resolves if its path, taken from the
root or from the linking file's folder, is the path of a file.
"""

from __future__ import annotations

import re

from ..functions.dialect import Spark, clamp, flag, num, per, sat, weighted

# What the classes of links, placeholders and diagrams are told by, and the limits of artifacts.
SCHOLARLY = ("doi.org", "dx.doi.org", "arxiv.org", "www.arxiv.org", "datatracker.ietf.org", "rfc-editor.org", "www.rfc-editor.org", "tools.ietf.org", "www.w3.org", "w3.org", "pubmed.ncbi.nlm.nih.gov", "www.ncbi.nlm.nih.gov", "ncbi.nlm.nih.gov")
CODE_HOSTS = ("github.com", "www.github.com", "gitlab.com", "www.gitlab.com")
VAGUE = ("here", "link", "click here", "this", "read more", "more", ">", "...", "…")
PLACEHOLDERS = ("TODO", "TBD", "FIXME", "XXX", "LOREM", "PLACEHOLDER")
DIAGRAMS = ("mermaid", "plantuml", "dot", "d2", "vega")
SHELLS = ("bash", "sh", "shell", "zsh")
MOST_CODE_LINES, MOST_CELLS, MOST_DIAGRAM, MOST_MATH = 120, 300, 80, 50
EXPECTED_DEPTH = 3


def _among(x: str, values: tuple[str, ...]) -> str:
    return f"{x} IN ({', '.join(repr(v) for v in values)})"


PROSE = "kind IN ('heading', 'list', 'quote', 'para')"


def toks(d: Spark) -> str:
    """The words of a line ``s`` of prose, of its kind by ``kind``."""
    word = r"[\p{L}\p{N}]+(?:[_./:@-]+[\p{L}\p{N}]+)*"
    bare = d.replace(d.replace("s", r"\]\([^)]*\)", "]"), r"<?https?://[^\s>]*>?", " ")
    return f"CASE WHEN {PROSE} THEN {d.every(bare, word)} END"


def steps(d: Spark) -> dict[str, str]:
    """Every step's SQL by name; a step may use those before it."""
    k = "rev, path"
    before = f"OVER (PARTITION BY {k} ORDER BY line)"
    host = d.extract("lower(dest)", r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    out: dict[str, str] = {}
    # ---------------------------------------------------------------- lines and blocks
    out["fences"] = f"SELECT {k}, line, raw, trim(raw) AS s, {flag(d.like('raw', '^ {0,3}```'))} AS fm, {flag(d.like('trim(raw)', '^[$][$]$'))} AS mm FROM marked"
    out["opened"] = f"SELECT *, sum(fm) {before} AS fc FROM fences"
    out["coded"] = f"SELECT *, {flag('fm = 1 OR fc % 2 = 1')} AS code, CAST((fc + fc % 2) / 2 AS BIGINT) AS fence FROM opened"
    out["mathed"] = f"SELECT *, sum(CASE WHEN code = 0 THEN mm ELSE 0 END) {before} AS mc FROM coded"
    out["blocks"] = f"""SELECT {k}, line, raw, s, fm, fence, CAST((mc + mc % 2) / 2 AS BIGINT) AS formula,
      CASE WHEN code = 1 THEN 'code' WHEN mm = 1 OR mc % 2 = 1 THEN 'math' WHEN s = '' THEN 'blank' WHEN {d.like('s', '^[|]')} THEN 'table' WHEN {d.like('s', '^#{1,6} ')} THEN 'heading'
        WHEN {d.like('s', '^([-*+]|[0-9]+[.]) ')} THEN 'list' WHEN {d.like('s', '^>')} THEN 'quote' WHEN {d.like('s', '^<(!--|/?[A-Za-z])') + ' AND NOT ' + d.like('s', '^<[a-z]+://')} THEN 'html' ELSE 'para' END AS kind FROM mathed"""
    prose = PROSE
    out["prose"] = f"SELECT {k}, line, kind, s, {toks(d)} AS toks, fence, formula, fm, raw FROM blocks"
    out["counted"] = f"SELECT *, CASE WHEN toks IS NULL THEN 0 ELSE {d.size('toks')} END AS words FROM prose"
    # ---------------------------------------------------------------- sections
    out["headings"] = f"SELECT {k}, line, s, length({d.extract('s', '^(#{1,6}) ', 1)}) AS level, row_number() OVER (PARTITION BY {k} ORDER BY line) AS id FROM blocks WHERE kind = 'heading'"
    past = f"OVER (PARTITION BY {k} ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    next_ = f"OVER (PARTITION BY {k} ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    ups = ", ".join(f"coalesce(max(CASE WHEN level = {n} THEN id END) {past}, 0) AS u{n}" for n in range(1, 6))
    downs = ", ".join(f"min(CASE WHEN level <= {n} THEN line END) {next_} AS e{n}" for n in range(1, 7))
    out["nested"] = f"SELECT *, {ups}, {downs}, lag(level) {before} AS prev FROM headings"
    parent = "CASE level " + " ".join(f"WHEN {n} THEN greatest({', '.join(['0', *(f'u{m}' for m in range(1, n))])})" for n in range(2, 7)) + " ELSE 0 END"
    last = "CASE level " + " ".join(f"WHEN {n} THEN e{n}" for n in range(1, 7)) + " END"
    out["sizes"] = f"SELECT {k}, max(line) AS dloc FROM marked GROUP BY {k}"
    out["placed"] = f"SELECT c.*, coalesce(max(h.id) OVER (PARTITION BY c.rev, c.path ORDER BY c.line), 0) AS section FROM counted c LEFT JOIN headings h ON c.rev = h.rev AND c.path = h.path AND c.line = h.line"
    if type(d) is Spark:  # the same without a join: ids of headings count them
        out["placed"] = f"SELECT *, CAST(sum({flag("kind = 'heading'")}) {before} AS INT) AS section FROM counted"
    out["own"] = f"SELECT {k}, section, sum(words) AS words FROM placed WHERE section > 0 AND kind <> 'heading' GROUP BY {k}, section"
    out["sections"] = f"""SELECT n.rev, n.path, n.id, n.level, n.line AS start_line, coalesce({last} - 1, z.dloc) AS end_line, {parent} AS parent, coalesce(o.words, 0) AS words, n.s AS heading,
      {flag('n.prev IS NOT NULL AND n.level > n.prev + 1')} AS skip, n.prev FROM nested n JOIN sizes z ON n.rev = z.rev AND n.path = z.path LEFT JOIN own o ON n.rev = o.rev AND n.path = o.path AND n.id = o.section"""
    out["parents"] = f"SELECT s.*, p.level AS parent_level, {flag('s.parent > 0 AND s.level > p.level + 1')} AS jump, row_number() OVER (PARTITION BY s.rev, s.path, s.parent ORDER BY s.id) AS nth FROM sections s LEFT JOIN sections p ON s.rev = p.rev AND s.path = p.path AND s.parent = p.id"
    out["docs"] = f"""SELECT c.rev, c.path, max(c.line) AS dloc, sum(c.words) AS words, sum({flag("kind = 'code'")}) AS cloc, sum({flag("kind = 'table'")}) AS tloc, sum({flag("kind = 'math'")}) AS mloc, sum({flag("kind = 'html'")}) AS hloc,
      sum({flag("kind = 'blank'")}) AS bloc, sum({flag(prose)}) AS ploc, sum({flag("kind = 'heading'")}) AS headings FROM counted c GROUP BY c.rev, c.path"""
    out["loc"] = "SELECT *, cloc + tloc + mloc + hloc AS aloc FROM docs"
    out["balance"] = f"""SELECT {k}, count(*) AS sections, {d.quantile('words', 0.95)} AS p95, {d.quantile('words', 0.5)} AS median_words, avg(CAST({flag('words > 1200')} AS DOUBLE)) AS large, avg(CAST({flag('words < 40')} AS DOUBLE)) AS tiny,
      avg(CAST(jump AS DOUBLE)) AS skips, sum(skip) AS skip_count, max(level) AS depth, count(nth) - sum({flag('nth = 1')}) AS follow, sum({flag('parent > 0')}) AS below FROM parents GROUP BY {k}"""
    out["balanced"] = f"SELECT *, {clamp('1e0 - ' + ' - '.join([f'0.3e0 * {sat("p95", 900, 2000)}', f'0.25e0 * {sat("large", 0.05, 0.40)}', f'0.15e0 * {sat("tiny", 0.20, 0.70)}', f'0.2e0 * {sat("skips", 0.02, 0.20)}', f'0.1e0 * {sat(f"abs(depth - {EXPECTED_DEPTH})", 2, 5)}']))} AS section_balance FROM balance"
    # ---------------------------------------------------------------- slugs
    text = d.replace("s", "^#+ +", "")
    out["slugs"] = f"""SELECT {k}, line, id, {d.replace(d.replace(f'lower({text})', '[^a-z0-9 _-]', ''), '[ _]', '-')} AS graph_slug, {d.replace(d.replace(f'lower({text})', r'[^\p{L}\p{N} _-]', ''), ' ', '-')} AS base FROM headings"""
    out["anchors"] = f"SELECT *, CASE WHEN again = 0 THEN base ELSE base || '-' || CAST(again AS {d.text}) END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY {k}, base ORDER BY line) - 1 AS again FROM slugs) t"
    # ---------------------------------------------------------------- links
    inline = r"!?\[[^\]]*\]\([^)\s]*[^)]*\)"
    loose = r"<?https?://[^\s<>)]+>?"
    hidden = d.replace("s", inline, " ")
    out["found"] = " UNION ALL ".join(
        "SELECT rev, path, line, n, " + cols + " FROM (" + d.exploded(f"(SELECT * FROM blocks WHERE kind NOT IN ('code', 'math', 'blank') AND {when})", f"{k}, line", d.every(what, p), "hit", "n") + ") t"
        for cols, when, what, p in (
            (f"{flag(d.like('hit', '^!'))} AS image, 0 AS bare, {d.extract('hit', r'^!?\[([^\]]*)\]', 1)} AS text, {d.extract('hit', r'\]\(([^)\s]*)', 1)} AS dest, 'inline' AS form", "instr(s, '](') > 0", "s", inline),
            (f"0 AS image, 1 AS bare, {d.replace('hit', '[<>]', '')} AS text, {d.replace('hit', '[<>]', '')} AS dest, 'auto' AS form", "instr(s, '://') > 0", hidden, loose),
            (f"0 AS image, 0 AS bare, hit AS text, {d.replace('hit', r'[\[\]^]', '')} AS dest, 'footnote' AS form", "instr(s, '[^') > 0", d.replace("s", r"^\[\^[^\]]+\]:", ""), r"\[\^[^\]]+\]"),
        )
    )
    absolute = d.like("dest", r"^([A-Za-z0-9+]+://[^\s]|data:|mailto:|tel:)")
    out["classed"] = f"""SELECT *, {host} AS host, CASE WHEN form = 'footnote' THEN 'footnote' WHEN dest = '' THEN 'relative' WHEN substr(dest, 1, 1) = '#' THEN 'internal' WHEN NOT {absolute} THEN 'relative'
      WHEN {_among(host, SCHOLARLY)} THEN 'scholarly' WHEN {_among(host, CODE_HOSTS)} AND {d.like('dest', '^[a-z]+://[^/]+/[^/]+/[^/]+/(issues|pull|pulls|merge_requests)/[0-9]+(/|$)')} THEN 'issue_pr'
      WHEN {_among(host, CODE_HOSTS)} THEN 'external_vendor' ELSE 'external' END AS class FROM found WHERE NOT (dest = '' AND text = '')"""
    out["notes"] = f"SELECT DISTINCT {k}, {d.extract('s', r'^\[\^([^\]]+)\]:', 1)} AS label FROM blocks WHERE kind = 'para' AND {d.like('s', r'^\[\^[^\]]+\]:')}"
    out["targets"] = f"SELECT {k}, line, n, form, image, bare, text, dest, class, host, {d.replace('dest', '^#', '')} AS fragment, {d.replace(d.replace('dest', '[#?].*$', ''), '^(/|[.]/)', '')} AS file FROM classed"
    out["resolved"] = f"""SELECT t.rev, t.path, t.line, t.n, t.form, t.image, t.bare, t.text, t.dest, t.class, t.host, t.file,
      CASE t.class WHEN 'internal' THEN {flag('a.slug IS NOT NULL')} WHEN 'relative' THEN {flag("t.dest <> '' AND (f.path IS NOT NULL OR g.path IS NOT NULL)")} WHEN 'footnote' THEN {flag('o.label IS NOT NULL')} END AS ok
      FROM targets t LEFT JOIN (SELECT DISTINCT {k}, slug FROM anchors) a ON t.class = 'internal' AND t.rev = a.rev AND t.path = a.path AND lower(t.fragment) = a.slug
      LEFT JOIN sizes f ON t.class = 'relative' AND t.rev = f.rev AND t.file = f.path LEFT JOIN sizes g ON t.class = 'relative' AND t.rev = g.rev AND {d.extract('t.path', '^(.*/)[^/]*$', 1)} || t.file = g.path
      LEFT JOIN notes o ON t.class = 'footnote' AND t.rev = o.rev AND t.path = o.path AND t.dest = o.label"""
    out["links"] = f"SELECT r.*, p.section FROM resolved r JOIN placed p ON r.rev = p.rev AND r.path = p.path AND r.line = p.line"
    far = "class IN ('external', 'external_vendor', 'scholarly', 'issue_pr')"
    vague = f"trim(text) = '' OR {d.like('lower(trim(text))', '^([a-z]+://|www[.]|mailto:|tel:|data:)')} OR {_among('lower(trim(text))', VAGUE)}"
    out["link_counts"] = f"""SELECT {k}, count(*) AS total, sum({flag("class = 'internal'")}) AS internal, sum({flag("class = 'relative'")}) AS relative, sum({flag(far)}) AS external, sum({flag("class = 'external_vendor'")}) AS vendor,
      sum({flag("class = 'scholarly'")}) AS scholarly, sum({flag("class = 'issue_pr'")}) AS issues, sum({flag("class = 'footnote'")}) AS footnote, sum(image) AS images, sum(bare) AS bare, sum({flag('ok = 0')}) AS broken,
      sum({flag("class = 'internal' AND ok = 0")}) AS missed, sum({flag("class = 'internal' AND ok = 1")}) AS reached, sum({flag("class = 'relative' AND ok = 1")}) AS files, sum({flag(f'NOT ({vague})')}) AS described,
      sum({flag("class IN ('external', 'external_vendor', 'scholarly', 'footnote')")}) AS refs, sum({flag("class IN ('external', 'external_vendor', 'scholarly') OR class = 'footnote' AND ok = 1")}) AS verifiable,
      sum({flag("lower(dest) IN ('', 'tbd', 'todo', '#', 'placeholder')")}) AS empty_dests, count(DISTINCT CASE WHEN {far} THEN host END) AS domains, count(DISTINCT CASE WHEN class = 'relative' AND file <> '' THEN file END) AS linked, count(DISTINCT CASE WHEN class = 'footnote' THEN dest END) AS notes,
      sum({flag("section > 0 AND class = 'internal'")}) AS e_int, sum({flag("section > 0 AND class = 'footnote'")}) AS e_foot, sum({flag("section > 0 AND class = 'relative'")}) AS e_rel, sum({flag(f'section > 0 AND {far}')}) AS e_ext FROM links GROUP BY {k}"""
    section_words = f"(SELECT {k}, sum(words) AS sw FROM sections GROUP BY {k})"
    out["linked"] = f"""SELECT l.*, {clamp(weighted((0.45, sat(per('broken', 'total'), 0, 0.10)), (0.20, sat(per('missed', 'internal'), 0, 0.10)), (0.15, sat(per('bare', 'total'), 0.05, 0.30)), (0.10, sat(per('external', 'total'), 0.60, 0.90)), (0.10, sat("total / greatest(1e0, greatest(coalesce(sw, 0), 1) / 100e0)", 6, 14))))} AS link_debt,
      {clamp(weighted((0.30, per('described', 'total')), (0.30, per('files', 'relative')), (0.20, per('reached', 'internal'))))} AS information_scent, {weighted((0.3, 'internal'), (0.8, 'relative'), (1.0, 'external'), (2.5, 'broken'), (0.5, 'footnote'))} AS review_burden
      FROM link_counts l LEFT JOIN {section_words} w ON l.rev = w.rev AND l.path = w.path"""
    # ---------------------------------------------------------------- artifacts
    out["table_rows"] = f"""SELECT *, sum(first) {before} AS tbl FROM (SELECT {k}, line, s, {flag(d.like('s', '^[|][ :|-]+$'))} AS rule, {d.replace(d.replace('s', '^[|]', ''), '[|]$', '')} AS inner_,
      {flag(f"coalesce(lag(line) {before}, -1) <> line - 1")} AS first FROM blocks WHERE kind = 'table') t"""
    cells = f"length(inner_) - length(replace(inner_, '|', '')) + 1"
    empty = d.size(d.every("'|' || replace(inner_, '|', '|;|') || '|'", r"[|] *[|]"))
    out["tables"] = f"""SELECT {k}, tbl, min(line) AS start_line, max(line) AS end_line, sum({flag('rule = 0')}) - 1 AS rows_, max(CASE WHEN rule = 0 THEN {cells} ELSE 0 END) AS cols, sum(CASE WHEN rule = 0 THEN {cells} ELSE 0 END) AS cells,
      sum(CASE WHEN rule = 0 THEN {empty} ELSE 0 END) AS empties, max(rule) AS header, max({flag('rule = 1 AND ' + d.like('s', '(^|[^:-]):-+($|[^:-])'))}) + max({flag('rule = 1 AND ' + d.like('s', '(^|[^:-])-+:'))}) + max({flag('rule = 1 AND ' + d.like('s', '(^|[|] *)-+ *[|]'))}) AS aligns FROM table_rows GROUP BY {k}, tbl"""
    out["table_records"] = f"""SELECT *, {clamp(weighted((0.25, sat('cols', 5, 12)), (0.25, sat('rows_', 20, 100)), (0.25, sat('cells', 60, 300)), (0.15, '1 - header'), (0.05, sat(per('empties', 'cells'), 0.10, 0.50)), (0.05, 'aligns / CAST(greatest(cols, 1) AS DOUBLE)')))} AS burden,
      {flag('cells > 300 OR cols > 12 OR rows_ > 100')} AS hard, header * (CASE WHEN cells < 6 THEN 0.2e0 WHEN cells <= 60 THEN 1e0 ELSE {clamp('1e0 - (cells - 60) / 120e0')} END) AS scaffold FROM tables"""
    out["fence_lines"] = f"SELECT {k}, fence, line, raw, fm, lower({d.extract('s', '^```+ *([A-Za-z0-9_+-]*)', 1)}) AS tag FROM blocks WHERE kind = 'code'"
    out["fence_records"] = f"""SELECT {k}, fence, min(line) AS start_line, max(line) AS end_line, sum(1 - fm) AS loc, max(CASE WHEN fm = 1 THEN tag ELSE '' END) AS tag, coalesce({d.ranked('CASE WHEN fm = 0 THEN length(raw) END', 0.95)}, 0) AS p95 FROM fence_lines GROUP BY {k}, fence"""
    out["code_records"] = f"SELECT *, 1e0 + 0.08e0 * greatest(0, loc - 12) + 0.5e0 * {sat('loc', 40, 120)} + 0.4e0 * {sat('p95', 100, 180)} + 1.5e0 * {flag('tag = ' + repr(''))} AS burden FROM fence_records WHERE NOT {_among('tag', DIAGRAMS)}"
    out["edges"] = f"""SELECT f.rev, f.path, f.fence, {d.extract('trim(f.raw)', r'^(\w+)', 1)} AS a, {d.extract('trim(f.raw)', r'(?:-->|---|->|--) *(\w+)', 1)} AS b FROM fence_lines f JOIN fence_records r ON f.rev = r.rev AND f.path = r.path AND f.fence = r.fence
      WHERE f.fm = 0 AND {_among('r.tag', DIAGRAMS)} AND {d.like('trim(f.raw)', r'^\w+ *(-->|---|->|--) *\w+')}"""
    out["vertices"] = f"SELECT rev, path, fence, count(DISTINCT v) AS nodes FROM (SELECT rev, path, fence, a AS v FROM edges UNION ALL SELECT rev, path, fence, b FROM edges) t GROUP BY rev, path, fence"
    out["formula_lines"] = f"SELECT {k}, formula, line, {d.size(d.every('raw', r'[^\s]+'))} - {flag(d.like('s', '^[$][$]$'))} AS toks, raw FROM blocks WHERE kind = 'math'"
    out["commands"] = f"SELECT {k}, formula, count(DISTINCT cmd) AS commands FROM ({d.exploded('formula_lines', f'{k}, formula', d.every('raw', r'\\[A-Za-z]+'), 'cmd', 'n')}) t GROUP BY {k}, formula"
    out["formulas"] = f"SELECT m.rev, m.path, m.formula, min(m.line) AS start_line, max(m.line) AS end_line, sum(m.toks) AS tokens, max(coalesce(c.commands, 0)) AS commands FROM formula_lines m LEFT JOIN commands c ON m.rev = c.rev AND m.path = c.path AND m.formula = c.formula GROUP BY m.rev, m.path, m.formula"
    # Blocks are runs of lines of one kind between blank lines; an artifact is explained by prose within two blocks.
    out["runs"] = f"SELECT {k}, line, kind, sum(new) {before} AS block FROM (SELECT {k}, line, kind, {flag(f'coalesce(lag(kind) {before}, {repr("")}) <> kind OR kind IN ({repr("heading")}, {repr("list")})')} AS new FROM blocks) t WHERE kind <> 'blank'"
    out["block_rows"] = f"SELECT {k}, block, min(line) AS start_line, max(line) AS end_line, max(kind) AS kind, row_number() OVER (PARTITION BY {k} ORDER BY min(line)) AS ord FROM runs GROUP BY {k}, block"
    near = f"max({flag(repr('para') + ' = kind')}) OVER (PARTITION BY {k} ORDER BY ord ROWS BETWEEN"
    out["neighbours"] = f"SELECT *, greatest(coalesce({near} 2 PRECEDING AND 1 PRECEDING), 0), coalesce({near} 1 FOLLOWING AND 2 FOLLOWING), 0)) AS explained FROM block_rows"
    at = lambda t: f"LEFT JOIN neighbours b ON b.rev = {t}.rev AND b.path = {t}.path AND b.start_line <= {t}.start_line AND b.end_line >= {t}.start_line"
    ex = "coalesce(b.explained, 0)"
    out["diagrams"] = f"""SELECT t.*, {ex} AS explained, coalesce(v.nodes, 0) AS nodes, coalesce(e.edges, 0) AS edges FROM (SELECT * FROM fence_records WHERE {_among('tag', DIAGRAMS)}) t LEFT JOIN vertices v ON t.rev = v.rev AND t.path = v.path AND t.fence = v.fence
      LEFT JOIN (SELECT rev, path, fence, count(*) AS edges FROM edges GROUP BY rev, path, fence) e ON t.rev = e.rev AND t.path = e.path AND t.fence = e.fence {at('t')}"""
    out["artifacts"] = f"""SELECT t.rev, t.path, t.start_line, t.end_line, 1 AS kind, t.loc AS size, {flag("t.tag <> ''")} AS label, {flag(f't.loc > {MOST_CODE_LINES}')} AS oversized, {ex} AS explained FROM code_records t {at('t')}
      UNION ALL SELECT t.rev, t.path, t.start_line, t.end_line, 2, t.cells, t.header, {flag(f't.cells > {MOST_CELLS}')}, {ex} FROM table_records t {at('t')}
      UNION ALL SELECT rev, path, start_line, end_line, 3, nodes + edges, explained, {flag(f'nodes + edges > {MOST_DIAGRAM}')}, explained FROM diagrams
      UNION ALL SELECT t.rev, t.path, t.start_line, t.end_line, 4, t.tokens, 0, {flag(f't.tokens > {MOST_MATH}')}, {ex} FROM formulas t {at('t')}
      UNION ALL SELECT t.rev, t.path, t.start_line, t.start_line, 5, 1, {flag("trim(t.text) <> ''")}, 0, 1 FROM (SELECT *, line AS start_line FROM resolved WHERE image = 1) t"""
    out["artifact_ids"] = f"SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY start_line, kind, end_line, size) - 1 AS id FROM artifacts"
    out["artifact_counts"] = f"""SELECT {k}, count(*) AS artifacts, sum({flag('kind = 1')}) AS codes, sum({flag('kind = 1 AND label = 0')}) AS unlabelled, sum({flag('kind = 1 AND label = 1')}) AS labelled, sum(oversized) AS oversized, sum(1 - explained) AS unexplained,
      sum({flag('kind = 1 AND label = 1 AND oversized = 0 AND explained = 1')}) AS bounded, sum({flag('kind = 5')}) AS images, sum({flag('kind = 5 AND label = 0')}) AS no_alt, sum({flag('kind = 3')}) AS diagrams, sum({flag('kind = 3 AND explained = 0')}) AS no_caption,
      sum({flag('kind = 1 AND size >= 12 OR kind = 2 AND size >= 12 OR kind = 3')}) AS large FROM artifacts GROUP BY {k}"""
    out["table_sums"] = f"SELECT {k}, count(*) AS tables, max(cells) AS max_cells, sum(cells) AS cells, sum(hard) AS hard, min(CASE WHEN hard = 1 THEN start_line END) AS first_hard, 0.5e0 * avg(burden) + 0.5e0 * max(burden) AS table_burden, {clamp('sum(scaffold * explained) / greatest(1e0, sqrt(CAST(count(*) AS DOUBLE)))')} AS table_scaffold FROM (SELECT t.*, {ex} AS explained FROM table_records t {at('t')}) t GROUP BY {k}"
    out["visual_parts"] = f"""SELECT rev, path, weight, explained * (1e0 - {sat('weight', 20, 80)}) AS scaffold, nodes, edges FROM (SELECT *, 0.4e0 * nodes + 0.55e0 * edges + 1.5e0 * greatest(0, edges - nodes + {flag('nodes > 0')}) + (1 - explained) AS weight FROM diagrams) t
      UNION ALL SELECT r.rev, r.path, 1e0, {flag("trim(r.text) <> '' AND (r.class <> 'relative' OR r.ok = 1)")} * 1e0, 0, 0 FROM resolved r WHERE r.image = 1"""
    out["visuals"] = f"SELECT {k}, sum(weight) AS weight, sum(scaffold) AS scaffold, sum(nodes) AS nodes, sum(edges) AS edges FROM visual_parts GROUP BY {k}"
    # ---------------------------------------------------------------- tokens
    out["tokens"] = f"""SELECT {k}, line, section, tok, CASE WHEN {d.like('tok', '^[0-9]+([.,:][0-9]+)*$')} THEN 'number' WHEN instr(tok, '/') > 0 OR {d.like('tok', '[.][A-Za-z0-9]{1,8}$')} THEN 'path' WHEN {d.like('tok', '_|::|@|[0-9]|[a-z][A-Z]')} THEN 'identifier' ELSE 'word' END AS class
      FROM ({d.exploded("(SELECT * FROM placed WHERE words > 0)", f'{k}, line, section', 'toks', 'tok', 'n')}) t"""
    out["token_counts"] = f"""SELECT {k}, count(*) AS toks, sum({flag("class = 'identifier'")}) AS identifiers, sum({flag("class = 'path'")}) AS paths, sum({flag("class = 'number'")}) AS numbers, sum({flag(d.like('tok', '^[vV]?[0-9]+[.][0-9]+([.][0-9]+)?$'))}) AS versions,
      sum({flag(_among('upper(tok)', PLACEHOLDERS))}) AS placeholders, count(DISTINCT tok) AS types, sum({flag('f.path IS NOT NULL')}) AS found_paths FROM (SELECT t.rev, t.path, t.tok, t.class FROM tokens t) t LEFT JOIN (SELECT rev AS r, path AS p, path FROM sizes) f ON t.class = 'path' AND t.rev = f.r AND t.tok = f.p GROUP BY {k}""".replace("SELECT rev, path, count(*)", "SELECT t.rev, t.path, count(*)").replace("GROUP BY rev, path", "GROUP BY t.rev, t.path")
    if type(d) is Spark:  # the same, where only the tokens that look like paths leave their file to be sought
        out["token_hits"] = "SELECT t.rev, t.path, count(*) AS found_paths FROM (SELECT rev, path, tok FROM tokens WHERE class = 'path') t JOIN sizes f ON t.rev = f.rev AND t.tok = f.path GROUP BY t.rev, t.path"
        sums = out["token_counts"]
        sums = sums[: sums.index(f", sum({flag('f.path IS NOT NULL')})")].replace("SELECT t.rev, t.path,", f"SELECT {k},")
        out["token_counts"] = f"SELECT c.*, coalesce(h.found_paths, 0) AS found_paths FROM ({sums} FROM tokens GROUP BY {k}) c LEFT JOIN token_hits h ON c.rev = h.rev AND c.path = h.path"
    marks = [("heading", "kind = 'heading'", None), ("list", "kind = 'list'", None), ("quote", "kind = 'quote'", None), ("rule", "kind = 'para' AND " + d.like("s", "^(---+|[*][*][*]+)$"), None), ("task", "kind = 'list' AND " + d.like("s", r"^[-*+] \[[ xX]\]"), None), ("para", "kind = 'para'", None), ("html", "kind = 'html'", None)]
    out["operators"] = " UNION ALL ".join([f"SELECT {k}, '{n}' AS op, count(*) AS n FROM blocks WHERE {w} GROUP BY {k}" for n, w, _ in marks] + [f"SELECT {k}, 'artifact' || CAST(kind AS {d.text}), count(*) FROM artifacts GROUP BY {k}, kind", f"SELECT {k}, 'link:' || class, count(*) FROM resolved GROUP BY {k}, class"])
    out["operands"] = f"SELECT {k}, lower(tok) AS x, count(*) AS n FROM tokens GROUP BY {k}, lower(tok) UNION ALL SELECT {k}, 'to:' || dest, count(*) FROM resolved GROUP BY {k}, dest UNION ALL SELECT {k}, 'code:' || CAST(fence AS {d.text}), 1 FROM fence_records"
    out["halstead"] = f"""SELECT p.rev, p.path, n1, t1, n2, t2, (t1 + t2) * log2(CAST(greatest(n1 + n2, 2) AS DOUBLE)) AS volume, CASE WHEN n2 > 0 THEN n1 / 2e0 * t2 / n2 ELSE 0e0 END AS difficulty FROM (SELECT rev, path, count(*) AS n1, sum(n) AS t1 FROM operators GROUP BY rev, path) p
      JOIN (SELECT rev, path, count(*) AS n2, sum(n) AS t2 FROM operands GROUP BY rev, path) q ON p.rev = q.rev AND p.path = q.path"""
    # ---------------------------------------------------------------- evidence, repetition, risk
    out["section_anchors"] = f"""SELECT rev, path, section, sum(n) AS anchors FROM (SELECT rev, path, section, 1 AS n FROM links WHERE class IN ('external', 'external_vendor', 'scholarly', 'issue_pr') OR class IN ('relative', 'internal') AND ok = 1
      UNION ALL SELECT a.rev, a.path, p.section, 1 FROM artifacts a JOIN placed p ON a.rev = p.rev AND a.path = p.path AND a.start_line = p.line WHERE a.kind IN (1, 2, 5) AND a.label = 1 OR a.kind = 3 AND a.label = 1 AND a.oversized = 0 OR a.kind = 4 AND a.explained = 1) t WHERE section > 0 GROUP BY rev, path, section"""
    out["evidence"] = f"SELECT {k}, 0.5e0 * avg(ev) + 0.5e0 * {d.quantile('ev', 0.25)} AS evidence, sum(CASE WHEN anchors > 0 THEN words ELSE 0 END) AS anchored FROM (SELECT s.rev, s.path, s.words, coalesce(a.anchors, 0) AS anchors, {sat('coalesce(a.anchors, 0) / greatest(1e0, s.words / 250e0)', 0.2, 1.5)} AS ev FROM sections s LEFT JOIN section_anchors a ON s.rev = a.rev AND s.path = a.path AND s.id = a.section) t GROUP BY {k}"
    out["repeats"] = f"SELECT {k}, sum(n) AS paras, sum(n - 1) AS repeated FROM (SELECT {k}, lower(s) AS x, count(*) AS n FROM counted WHERE kind = 'para' AND words >= 5 GROUP BY {k}, lower(s)) t GROUP BY {k}"
    zero = lambda t, *cols: ", ".join(f"coalesce({t}.{c}, 0) AS {c}" for c in cols)
    join = lambda t, a: f"LEFT JOIN {t} {a} ON d.rev = {a}.rev AND d.path = {a}.path"
    out["inputs"] = f"""SELECT d.rev, d.path, d.dloc, d.words, d.ploc, d.cloc, d.tloc, d.mloc, d.hloc, d.bloc, d.aloc, d.headings, {zero('b', 'sections', 'large', 'follow', 'below', 'skip_count', 'depth')}, coalesce(b.section_balance, 1e0) AS section_balance,
      {zero('l', 'total', 'broken', 'external', 'internal', 'relative', 'footnote', 'files', 'reached', 'refs', 'verifiable', 'empty_dests', 'domains', 'linked', 'notes', 'e_int', 'e_foot', 'e_rel', 'e_ext', 'link_debt', 'information_scent', 'review_burden')},
      {zero('a', 'artifacts', 'codes', 'unlabelled', 'labelled', 'oversized', 'unexplained', 'bounded', 'images', 'no_alt', 'diagrams', 'no_caption')}, coalesce(a.large, 0) AS large_artifacts, {zero('t', 'tables', 'max_cells', 'cells', 'hard', 'table_burden', 'table_scaffold')}, t.first_hard,
      {zero('v', 'weight', 'scaffold', 'nodes', 'edges')}, {zero('k', 'identifiers', 'paths', 'numbers', 'versions', 'placeholders', 'found_paths')}, {zero('h', 'volume', 'n1', 'n2', 't1', 't2', 'difficulty')}, {zero('e', 'evidence', 'anchored')}, {zero('r', 'paras', 'repeated')}, {zero('c', 'code_burden')}
      FROM loc d {join('balanced', 'b')} {join('linked', 'l')} {join('artifact_counts', 'a')} {join('table_sums', 't')} {join('visuals', 'v')} {join('token_counts', 'k')} {join('halstead', 'h')} {join('evidence', 'e')} {join('repeats', 'r')} {join(f'(SELECT {k}, sum(burden) AS code_burden FROM code_records GROUP BY {k})', 'c')}"""
    w = lambda n: f"greatest(1e0, words / {num(n)})"
    nodes = "(sections + large_artifacts + linked + domains + notes)"
    p = f"({flag('sections + linked + domains + notes > 0')} + large_artifacts)"
    out["graph"] = f"""SELECT *, CASE WHEN {nodes} = 0 THEN 0e0 ELSE greatest(1e0, {weighted((0.15, 'below'), (0.20, 'follow'), (0.50, 'e_int'), (0.65, 'e_foot'), (0.80, 'e_rel'), (1.0, 'e_ext'))} - {nodes} + 2 * {p}) END AS reading_path,
      CASE WHEN {nodes} = 0 THEN 0e0 ELSE below + follow + e_int + e_foot + e_rel + e_ext - {nodes} + 2e0 * {p} END AS reading_path_raw,
      words / 240e0 + 0.35e0 * cloc + 0.06e0 * cells + 0.4e0 * nodes + 0.25e0 * edges + 0.12e0 * mloc + 0.2e0 * hloc AS ecu,
      CASE WHEN artifacts = 0 THEN {clamp('0.15e0 * ' + sat(per('hloc', 'dloc'), 0.05, 0.25))} ELSE {clamp(weighted((0.25, sat(per('unlabelled', 'codes'), 0.05, 0.50)), (0.15, sat(per('oversized', 'artifacts'), 0.05, 0.30)), (0.15, sat(per('unexplained', 'artifacts'), 0.10, 0.60)), (0.15, sat(per('hloc', 'dloc'), 0.05, 0.25)), (0.10, sat(per('external', 'artifacts'), 0.10, 0.60))))} END AS artifact_debt,
      {clamp(weighted((0.25, sat(f"files / {w(500)}", 0.5, 4)), (0.25, per('found_paths', 'paths')), (0.20, sat(f"labelled / {w(800)}", 0.5, 3)), (0.15, sat('identifiers / greatest(1e0, words)', 0.02, 0.12)), (0.15, sat('versions / greatest(1e0, words)', 0.01, 0.08))))} AS grounding,
      {clamp('scaffold / greatest(1e0, sqrt(words / 500e0 + 1))')} AS visual_scaffold, weight - 2 * scaffold AS visual_net_effect FROM inputs"""
    # Cognitive load by lines and blocks: heading steps, long leaf sections, lists, quotes, links and artifacts.
    out["steps_"] = f"SELECT {k}, sum(CASE WHEN prev IS NOT NULL AND level > prev + 1 THEN 1e0 WHEN prev IS NOT NULL AND level > prev THEN 0.2e0 ELSE 0e0 END) + 2e0 * sum({flag('words > 800')}) AS load FROM sections GROUP BY {k}"
    out["line_load"] = f"SELECT {k}, sum(CASE WHEN kind = 'list' THEN 0.5e0 + 0.35e0 * {flag(d.like('s', r'^[-*+] \[[ xX]\]'))} WHEN kind = 'quote' THEN 0.5e0 WHEN kind = 'para' AND words > 160 THEN 1.25e0 ELSE 0e0 END) AS load FROM counted GROUP BY {k}"
    out["cognitive"] = f"""SELECT g.*, coalesce(s.load, 0e0) + coalesce(n.load, 0e0) + 0.25e0 * total + 0.3e0 * external + 0.6e0 * footnote + 0.5e0 * images + 1.5e0 * diagrams + code_burden + 1.5e0 * mloc / 3e0 + 0.75e0 * tables + least(8e0, 0.3e0 * hloc) AS load FROM graph g
      LEFT JOIN steps_ s ON g.rev = s.rev AND g.path = s.path LEFT JOIN line_load n ON g.rev = n.rev AND g.path = n.path"""
    out["risk"] = f"""SELECT *, {sat(per('greatest(0, words - anchored)', 'words'), 0.35, 0.85)} AS unanchored, 1e0 - {sat(f'artifacts / {w(800)}', 0.5, 2)} AS few_artifacts, 1e0 - grounding AS ungrounded,
      {clamp(weighted((0.35, f"1e0 - {sat(f'sections / {w(700)}', 0.6, 2)}"), (0.35, sat('large', 0.10, 0.60)), (0.30, flag('words > 2500 AND depth <= 2'))))} AS lazy_sectioning, 0.75e0 * {sat(per('repeated', 'paras'), 0.02, 0.20)} AS repetition,
      1e0 - {sat('(identifiers + paths + numbers) / greatest(1e0, words)', 0.03, 0.15)} AS vague, CASE WHEN refs = 0 THEN 0e0 ELSE 1e0 - {per('verifiable', 'refs')} END AS hollow, {sat(f'(placeholders + empty_dests) / {w(1000)}', 0.5, 4)} AS placeholder,
      {clamp(weighted((0.25, 'visual_scaffold'), (0.20, 'table_scaffold'), (0.20, per('bounded', 'codes')), (0.15, 'information_scent'), (0.10, per('reached', 'internal'))))} AS good_scaffold FROM cognitive"""
    out["scored"] = f"""SELECT *, CASE WHEN words = 0 THEN 0e0 ELSE {clamp(weighted((0.20, 'unanchored'), (0.15, 'few_artifacts'), (0.20, 'ungrounded'), (0.15, 'lazy_sectioning'), (0.12, 'repetition'), (0.12, 'vague'), (0.04, 'hollow'), (0.02, 'placeholder')))} END AS filler_risk FROM risk"""
    out["documents_"] = f"""SELECT *, 100e0 * {clamp('1e0 - ' + weighted((0.18, sat('ln(1e0 + volume)', 8, 15)), (0.18, sat('load', 15, 80)), (0.10, sat('reading_path', 8, 40)), (0.16, 'link_debt'), (0.10, 'table_burden'), (0.10, 'artifact_debt'), (0.10, '1e0 - section_balance'), (0.12, 'filler_risk')) + ' + 0.1e0 * good_scaffold')} AS dmi,
      100e0 * {clamp('0.65e0 * ' + clamp(weighted((0.25, sat(f'load / {w(500)}', 4, 18)), (0.20, sat('volume / greatest(1e0, words)', 20, 120)), (0.20, 'grounding'), (0.15, 'evidence'), (0.10, sat(f'review_burden / {w(500)}', 2, 10)))))} AS rci FROM scored"""
    return out


#: Steps that several others build on; they are written once and read by all.
SHARED = ("sections", "parents", "anchors", "resolved", "fence_records", "table_records", "formulas", "neighbours", "diagrams", "artifacts", "tokens", "inputs", "cognitive", "documents_")


def needed(known: dict[str, str], text: str, held: dict[str, str]) -> list[str]:
    """The steps that ``text`` builds on, each after those that it builds on itself; what lies behind a held one is not followed."""
    out: list[str] = []

    def follow(t: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN)\s+\(?([a-z_]+)\b", t):
            if name in known and name not in out:
                if name not in held:
                    follow(known[name])
                if name not in out:
                    out.append(name)

    follow(text)
    return out


def plan(d: Spark, source: dict[str, str], result: str, held: dict[str, str] | None = None) -> str:
    """One statement: the source's steps, those of this module, and the result, as far as the result needs them.

    ``held`` names tables that hold steps already.
    """
    known, held = source | steps(d), held or {}
    # A step that stands nowhere but after FROM or JOIN can be renamed there.
    named = lambda t: re.sub(r"\b(FROM|JOIN)(\s+\(?)([a-z_]+)\b", lambda m: m[1] + m[2] + held.get(m[3], m[3]), t)
    own = [n for n in needed(known, result, held) if n not in held]
    return ("WITH " + ",\n".join(f"{n} AS ({named(known[n])})" for n in own) + "\n" if own else "") + named(result)
