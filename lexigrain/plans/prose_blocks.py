"""Queries over prose blocks of Markdown files and over Japanese text, written once for Spark and DuckDB.

Runs of a script are taken by expressions over whole texts, not by one row a character.  Sentences end at the usual
marks, but not after common abbreviations and single capital initials.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import DUCK, SPARK, Spark, clamp, flag, per, sat, weighted
from . import documents as md

# Abbreviations that do not end a sentence, and Japanese phrases.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "vs", "etc", "e[.]g", "i[.]e", "cf", "Fig", "No")
WEAK_JA = ("と思います", "かもしれません", "と考えられます", "ようです", "らしいです")
REDUNDANT_JA = ("することができます", "することができる", "ということ", "を行う", "を行います")
JOSHI = ("は", "が", "を", "に", "で", "と", "も")


def _count(d: Spark, s: str, p: str) -> str:
    return d.size(d.every(s, p))


def _mean_length(d: Spark, s: str, p: str) -> str:
    """The mean length of the runs that match."""
    return per(f"length({s}) - length({d.replace(s, p, '')})", _count(d, s, p))


def steps(d: Spark) -> dict[str, str]:
    han, hira, kata = (f"[{d.script(n)}]" for n in ("Han", "Hiragana", "Katakana"))
    kana = f"[{d.script('Hiragana')}{d.script('Katakana')}]"
    out = md.source(d)
    plain = d.replace("s", "`[^`]*`", "￼")
    for p, r in ((r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[\^[^\]]*\]", " "), (r"<?https?://[^\s>]*>?", " "), ("^(#+|[-*+>]|[0-9]+[.)]) +", ""), (r"^\[[ xX]\] +", ""), (r"[ \t]+", " ")):
        plain = d.replace(plain, p, r)
    out["plain_lines"] = f"SELECT rev, path, line, kind, trim({plain}) AS t FROM blocks WHERE rev = 'head' AND kind IN ('heading', 'list', 'quote', 'para')"
    letters = {"latin": "[A-Za-zＡ-Ｚａ-ｚ]", "kana": kana, "han": han, "letters": r"\p{L}"}
    out["counted_lines"] = "SELECT *, " + ", ".join(f"{_count(d, 't', p)} AS {n}" for n, p in letters.items()) + " FROM plain_lines"
    out["classed_lines"] = "SELECT *, CASE WHEN letters = 0 THEN 'other' WHEN kana >= 0.15e0 * letters THEN 'ja' WHEN han >= 0.4e0 * letters AND kana = 0 THEN 'other' WHEN latin >= 0.8e0 * letters THEN 'en' ELSE 'other' END AS lang FROM counted_lines"
    # A heading without a language of its own takes the next one, else the one before.
    near = lambda f, frame: f"{f}(CASE WHEN lang <> 'other' AND kind <> 'heading' THEN line END) OVER (PARTITION BY rev, path ORDER BY line ROWS BETWEEN {frame})"
    out["near_lines"] = f"SELECT *, {near('min', '1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS after_, {near('max', 'UNBOUNDED PRECEDING AND 1 PRECEDING')} AS before_ FROM classed_lines"
    out["heading_langs"] = """SELECT h.path, h.line, h.lang AS own, CASE WHEN h.lang <> 'other' THEN h.lang ELSE coalesce(a.lang, b.lang, 'other') END AS lang FROM near_lines h
      LEFT JOIN classed_lines a ON h.path = a.path AND h.after_ = a.line LEFT JOIN classed_lines b ON h.path = b.path AND h.before_ = b.line WHERE h.kind = 'heading'"""
    # ------------------------------------------------------------ whole texts
    safe = d.replace("coalesce(text, '')", rf"\b({'|'.join(ABBREVIATIONS)}|[A-Z])[.]", r"\1")
    out["split_docs"] = f"SELECT doc_id, {d.every(safe, r'[^.!?\n]*[\p{L}\p{N}][^.!?\n]*')} AS sents FROM documents".replace("\\n", "\n" if d is DUCK else "\\n")
    words = d.every("lower(coalesce(text, ''))", "[a-z]+")
    out["fog_words"] = d.exploded("(SELECT doc_id, text FROM documents)", "doc_id", words, "w", "n")
    stem = d.replace("w", "(ing|ed|es)$", "")
    out["fog_parts"] = f"SELECT doc_id, w, greatest(1, {_count(d, stem, '[aeiouy]+')}) AS fog FROM fog_words"
    t = "coalesce(text, '')"
    out["ja_counts"] = f"""SELECT doc_id, length({t}) AS chars, {_count(d, t, '[。！？!?]+')} AS sents, {_count(d, t, '[、，]')} AS commas, {_count(d, t, hira)} AS hiragana, {_count(d, t, kata)} AS katakana, {_count(d, t, han)} AS kanji, {_count(d, t, '[A-Za-z]')} AS latin,
      {_mean_length(d, t, f'{hira}+')} AS lh, {_mean_length(d, t, f'{han}+')} AS lc, {_mean_length(d, t, f'{kata}+')} AS lk, {_mean_length(d, t, '[A-Za-z]+')} AS la, {_count(d, t, f'{han}{{7,}}')} AS long_runs,
      {_count(d, t, '|'.join(WEAK_JA))} AS weak, {_count(d, t, '|'.join(REDUNDANT_JA))} AS redundant, {_count(d, t, '(です|ます|ました|ません)[。！？!?]')} AS polite, {_count(d, t, '(だ|である|だった)[。！？!?]')} AS plain,
      {_count(d, t, '[^。！？!?、]*、[^。！？!?、]*、[^。！？!?、]*、[^。！？!?、]*、')} AS many_commas, {_count(d, t, '[^。！？!?]{101,}')} AS long_sents, {' + '.join(_count(d, t, f'[^。！？!?]{j}[^。！？!?{j}]{{2,}}{j}') for j in JOSHI)} AS doubled,
      {_count(d, t, '[！？][^ 　\n」』）！？]'.replace(chr(10), ''))} AS jtf_marks, {_count(d, t, '[０-９Ａ-Ｚａ-ｚ]')} AS jtf_wide, {_count(d, t, f'{kana}[,.]')} AS jtf_points, {_count(d, t, '[(][^)]*' + kana)} AS jtf_brackets FROM documents"""
    return out


def results(d: Spark) -> dict[str, str]:
    r6 = md.r6
    rate = lambda c: per(c, "sents")
    en, ja = (flag(f"lang = '{x}'") for x in ("en", "ja"))
    kinds = ", ".join(f"CAST(max({flag(f"kind = '{x}'")}) AS BIGINT) AS {x}" for x in ("code", "table", "math", "html"))
    jtf = "(jtf_marks + jtf_wide + jtf_points + jtf_brackets)"
    loss = [(0.15, sat(rate("long_sents"), 0.05, 0.30)), (0.12, sat(rate("weak"), 0.01, 0.05)), (0.12, sat(rate("redundant"), 0.01, 0.05)), (0.10, sat(rate("doubled"), 0.02, 0.10)), (0.10, sat(rate("long_runs"), 0.05, 0.25)),
            (0.10, sat(per("least(polite, plain)", "polite + plain"), 0.02, 0.20)), (0.08, sat(rate("many_commas"), 0.02, 0.15)), (0.07, sat(f"{jtf} * 1000e0 / greatest(1, chars)", 0.5, 5))]
    return {
        "prose_blocks": "SELECT path, CAST(line AS BIGINT) AS line, kind, t AS text, lang FROM classed_lines WHERE t <> ''",
        "prose_languages": f"SELECT path, CAST(sum({en}) AS BIGINT) AS en, CAST(sum({ja}) AS BIGINT) AS ja, CASE WHEN sum({en}) > 0 AND sum({ja}) > 0 THEN 'mixed' WHEN sum({en}) > 0 THEN 'en' WHEN sum({ja}) > 0 THEN 'ja' ELSE 'other' END AS dominant FROM classed_lines GROUP BY path",
        "prose_heading_languages": "SELECT path, CAST(line AS BIGINT) AS line, own, lang FROM heading_langs",
        "prose_stripped_kinds": f"SELECT path, {kinds} FROM blocks WHERE rev = 'head' GROUP BY path",
        "prose_sentences": f"SELECT doc_id, CAST({d.size('sents')} AS BIGINT) AS sentences FROM split_docs",
        "fog_syllables": "SELECT doc_id, CAST(sum(fog) AS BIGINT) AS syllables, CAST(sum(CASE WHEN fog >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS complex FROM fog_parts GROUP BY doc_id",
        "ja_script_runs": f"SELECT doc_id, {md.ints('hiragana', 'katakana', 'kanji', 'latin', 'long_runs')}, {r6('lh', 'lc', 'lk', 'la')} FROM ja_counts",
        "ja_tateishi": f"SELECT doc_id, CAST(sents AS BIGINT) AS sentences, CASE WHEN sents >= 5 AND chars >= 300 AND hiragana <= 0.9e0 * chars THEN round(115.79e0 - 0.12e0 * chars / sents - 1.37e0 * la + 7.4e0 * lh - 23.18e0 * lc - 5.4e0 * lk - 4.67e0 * commas / sents, 4) END AS readability FROM ja_counts",
        "ja_style_rules": f"SELECT doc_id, {md.ints('jtf_marks', 'jtf_wide', 'jtf_points', 'jtf_brackets')}, round({jtf} * 1000e0 / greatest(1, chars), 6) AS density FROM ja_counts",
        "ja_wording": f"SELECT doc_id, {md.ints('weak', 'redundant', 'doubled', 'many_commas', 'long_sents', 'polite', 'plain')}, round({clamp('1e0 - ' + weighted(*loss))}, 6) AS quality FROM ja_counts",
    }


def _runner(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return md.run(spark, sf_dir, results(SPARK)[name], steps(SPARK))

    query.__name__ = name
    return query


QUERIES = {name: _runner(name) for name in results(SPARK)}
ORACLE_SQL = {name: md.documents.plan(DUCK, steps(DUCK), sql) for name, sql in results(DUCK).items()}
