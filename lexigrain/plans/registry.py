"""All registered queries: name -> plan builder, and name -> DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr, vocab
from ..operators import code, corpus, lines, links, markdown, prose
from . import documents, prose_blocks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", "text")


def _list(items) -> str:
    return ", ".join(f"'{i}'" for i in items)


# --------------------------------------------------------------------- shared SQL
WORDS = r"SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1) - 1 AS pos FROM documents"
SENTS = r"SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]*[\p{L}\p{N}][^.!?]*')) AS sentence FROM documents"
SYL = "greatest(1, g - CASE WHEN g > 1 AND word LIKE '%e' AND word NOT LIKE '%le' THEN 1 ELSE 0 END - CASE WHEN g > 1 AND word LIKE '%ed' AND NOT regexp_matches(word, '[td]ed$') THEN 1 ELSE 0 END)"
COUNTS = f"""
w AS (SELECT *, len(regexp_extract_all(word, '[aeiouy]+')) AS g FROM ({WORDS})),
y AS (SELECT *, {SYL} AS y FROM w),
per AS (SELECT doc_id, count(*) AS w, sum(y) AS y, sum(least(20, length(word))) AS l, sum((y >= 3)::INT) AS poly, sum((pos < 150 AND y = 1)::INT) AS mono, sum((length(word) >= 7)::INT) AS longw FROM y GROUP BY doc_id),
s AS (SELECT doc_id, len(regexp_extract_all(text, '[^.!?]*[\\p{{L}}\\p{{N}}][^.!?]*')) AS s FROM documents),
c AS (SELECT doc_id, w::DOUBLE AS w, y::DOUBLE AS y, l::DOUBLE AS l, poly::DOUBLE AS poly, mono::DOUBLE AS mono, longw::DOUBLE AS longw, s::DOUBLE AS s FROM per JOIN s USING (doc_id) WHERE w > 0 AND s > 0)"""
_IF = "CASE WHEN w >= 100 AND s >= 5 THEN round({0}, 3) END"
READ = {
    "flesch": "206.835 - 1.015 * w / s - 84.6 * y / w", "fkgl": "0.39 * w / s + 11.8 * y / w - 15.59", "fog": "0.4 * (w / s + 100.0 * poly / w)",
    "ari": "4.71 * l / w + 0.5 * w / s - 21.43", "cli": "0.0588 * (100.0 * l / w) - 0.296 * (100.0 * s / w) - 15.8", "lix": "w / s + 100.0 * longw / w", "rix": "longw / s",
}


@query(
    f"WITH {COUNTS} SELECT doc_id, CAST(w AS BIGINT) AS words, CAST(s AS BIGINT) AS sentences, " + ", ".join(f"{_IF.format(v)} AS {k}" for k, v in READ.items())
    + ", CASE WHEN w >= 100 AND s >= 30 THEN round(1.043 * sqrt(30.0 * poly / s) + 3.1291, 3) END AS smog, CASE WHEN w >= 150 AND s >= 5 THEN round(20 - mono / 10, 3) END AS forcast FROM c"
)
def readability_by_doc(spark, d):
    return prose.readability(_docs(spark, d))


@query(f"WITH {COUNTS}, f AS (SELECT doc_id, {_IF.format(READ['flesch'])} AS flesch, {_IF.format(READ['fkgl'])} AS fkgl FROM c) SELECT * FROM f WHERE flesch IS NOT NULL ORDER BY flesch, doc_id LIMIT 10")
def flesch_top10(spark, d):
    return prose.hardest(_docs(spark, d))


@query(f"WITH w AS (SELECT *, len(regexp_extract_all(word, '[aeiouy]+')) AS g FROM ({WORDS})) SELECT CAST({SYL} AS INTEGER) AS syllables, count(*) AS words FROM w GROUP BY 1")
def syllable_histogram(spark, d):
    return prose.word_rows(_docs(spark, d)).groupBy(prose.syllables("word").alias("syllables")).agg(F.count("*").alias("words"))


_SLEN = rf"SELECT doc_id, len(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}]+')) AS n FROM ({SENTS})"


@query(f"SELECT doc_id, count(*) AS sentences, round(avg(n), 6) AS mean_words, CAST(quantile_disc(n, 0.9) AS BIGINT) AS p90_words, CAST(max(n) AS BIGINT) AS max_words, round(stddev_pop(n), 6) AS sd_words, round(avg((n > 30)::INT), 6) AS long_rate FROM ({_SLEN}) WHERE n > 0 GROUP BY doc_id")
def sentence_lengths(spark, d):
    return prose.sentence_lengths(_docs(spark, d))


@query(
    f"""WITH p AS (SELECT doc_id, word, count(*) AS n FROM ({WORDS}) GROUP BY ALL)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS words, count(*) AS types, round(avg((n = 1)::INT), 6) AS hapax, round(avg((n = 2)::INT), 6) AS dis,
round(1 - sum(CASE WHEN word IN ({_list(vocab.STOPWORDS)}) THEN n ELSE 0 END) / sum(n), 6) AS density FROM p GROUP BY doc_id"""
)
def lexical_variety(spark, d):
    return prose.variety(_docs(spark, d))


@query(
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents)
SELECT doc_id, round(list_avg(list_transform(range(1, greatest(len(ws) - 50, 0) + 2), lambda i: len(list_distinct(ws[i:i + 49])))) / least(len(ws), 50), 6) AS mattr FROM t WHERE len(ws) > 0"""
)
def mattr50(spark, d):
    return prose.mattr(_docs(spark, d))


def _grams(phrases, name):
    g = " + ".join(f"len(list_filter(range(1, len(ws) - {n} + 2), lambda i: array_to_string(ws[i:i + {n - 1}], ' ') IN ({_list(phrases)})))" for n in range(1, 5))
    return rf"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM documents) SELECT doc_id, CAST({g} AS BIGINT) AS {name}_hits, round(({g}) / len(ws), 6) AS {name}_density FROM t WHERE len(ws) > 0"


@query(_grams(vocab.HEDGES, "hedge"))
def wording_hedges(spark, d):
    return prose.ngram_hits(_docs(spark, d), vocab.HEDGES, "hedge")


@query(_grams(vocab.WEASELS, "weasel"))
def wording_weasels(spark, d):
    return prose.ngram_hits(_docs(spark, d), vocab.WEASELS, "weasel")


def _presence(phrases, name):
    return f"SELECT doc_id, CAST(sum({' + '.join(f'contains(lower(sentence), {chr(39)}{p}{chr(39)})::INT' for p in phrases)}) AS BIGINT) AS {name} FROM ({SENTS}) GROUP BY doc_id"


@query(_presence(vocab.WORDY, "wordy"))
def wordy_presence(spark, d):
    return prose.phrase_presence(_docs(spark, d), vocab.WORDY, "wordy")


@query(_presence(vocab.CLICHES, "cliches"))
def cliche_presence(spark, d):
    return prose.phrase_presence(_docs(spark, d), vocab.CLICHES, "cliches")


@query(f"SELECT doc_id, round(avg(regexp_matches(lower(sentence), '(^|[^a-z])({'|'.join(vocab.BE_FORMS)}) +([a-z]+ed|{'|'.join(vocab.IRREGULAR)})($|[^a-z])')::INT), 6) AS passive_ratio FROM ({SENTS}) GROUP BY doc_id")
def passive_ratio(spark, d):
    return prose.passive(_docs(spark, d))


@query(r"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents) SELECT doc_id, len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS illusions FROM t WHERE len(ws) > 0")
def lexical_illusions(spark, d):
    return prose.illusions(_docs(spark, d))


_ADV = f"word LIKE '%ly' AND length(word) > 3 AND word NOT IN ({_list(vocab.ADVERB_EXCEPTIONS)})"
_NOM = f"length(word) > 5 AND regexp_matches(word, '({'|'.join(vocab.NOMINAL_ENDS)})$')"


@query(f"SELECT doc_id, CAST(sum(({_ADV})::INT) AS BIGINT) AS adverbs, CAST(sum(({_NOM})::INT) AS BIGINT) AS nominals, CAST(sum((word IN ({_list(vocab.NONWORDS)}))::INT) AS BIGINT) AS nonwords, round(avg(({_ADV})::INT), 6) AS adverb_density, round(avg(({_NOM})::INT), 6) AS nominal_density FROM ({WORDS}) GROUP BY doc_id")
def word_kinds(spark, d):
    return prose.word_kinds(_docs(spark, d))


@query()
def wording_quality(spark, d):
    return prose.wording(_docs(spark, d))


@query("SELECT doc_id, CAST(" + " + ".join(f"len(regexp_extract_all(lower(text), '\\b{a}\\b'))" for a, _ in vocab.INCLUSIVE) + " AS BIGINT) AS flags, greatest(0.0, least(1.0, CAST(1 - 0.05 * (" + " + ".join(f"len(regexp_extract_all(lower(text), '\\b{a}\\b'))" for a, _ in vocab.INCLUSIVE) + ") AS DOUBLE))) AS score FROM documents")
def inclusive_flags(spark, d):
    return prose.inclusive(_docs(spark, d))


_SHARE = lambda c: f"CASE WHEN {c} > 0 THEN -({c} / letters) * log2({c} / letters) ELSE 0 END"


@query(
    r"""WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-zＡ-Ｚａ-ｚ]'))::DOUBLE AS latin, len(regexp_extract_all(text, '\p{Hiragana}'))::DOUBLE AS hiragana, len(regexp_extract_all(text, '\p{Katakana}'))::DOUBLE AS katakana,
len(regexp_extract_all(text, '\p{Han}'))::DOUBLE AS han, len(regexp_extract_all(text, '\p{L}'))::DOUBLE AS letters FROM documents),
o AS (SELECT *, letters - latin - hiragana - katakana - han AS other FROM n)
SELECT doc_id, CAST(letters AS BIGINT) AS letters, round(CASE WHEN letters > 0 THEN latin / letters ELSE 0 END, 6) AS latin_share,
CASE WHEN letters = 0 THEN 'other' WHEN (hiragana + katakana) / letters >= 0.15 THEN 'ja' WHEN han / letters >= 0.4 THEN 'other' WHEN latin / letters >= 0.8 THEN 'en' ELSE 'other' END AS language, round("""
    + " + ".join(map(_SHARE, ("latin", "hiragana", "katakana", "han", "other")))
    + ", 6) AS script_entropy FROM o"
)
def script_classes(spark, d):
    return prose.scripts(_docs(spark, d))


@query(
    r"""WITH n AS (SELECT source, len(regexp_extract_all(text, '[A-Za-z]')) AS latin, len(regexp_extract_all(text, '[\p{Hiragana}\p{Katakana}]')) AS kana, len(regexp_extract_all(text, '\p{L}')) AS letters FROM documents),
c AS (SELECT source, CASE WHEN letters > 0 AND kana >= 0.15 * letters THEN 1 ELSE 0 END AS ja, CASE WHEN letters > 0 AND kana < 0.15 * letters AND latin >= 0.8 * letters THEN 1 ELSE 0 END AS en FROM n)
SELECT source, CASE WHEN sum(en) > 0 AND sum(ja) > 0 THEN 'mixed' WHEN sum(en) > 0 THEN 'en' WHEN sum(ja) > 0 THEN 'ja' ELSE 'other' END AS dominant FROM c GROUP BY source"""
)
def dominant_language(spark, d):
    """The vote of a source's texts: English and Japanese together are mixed, other languages do not count."""
    n = _t(spark, d, "documents").select("source", *(F.regexp_count("text", F.lit(p)).alias(c) for c, p in (("latin", "[A-Za-z]"), ("kana", r"[\p{IsHiragana}\p{IsKatakana}]"), ("letters", r"\p{L}"))))
    ja = (F.col("letters") > 0) & (F.col("kana") >= 0.15 * F.col("letters"))
    en = (F.col("letters") > 0) & (F.col("kana") < 0.15 * F.col("letters")) & (F.col("latin") >= 0.8 * F.col("letters"))
    g = n.groupBy("source").agg(F.coalesce(F.sum(en.cast("int")), F.lit(0)).alias("e"), F.coalesce(F.sum(ja.cast("int")), F.lit(0)).alias("j"))
    return g.select("source", F.when((F.col("e") > 0) & (F.col("j") > 0), "mixed").when(F.col("e") > 0, "en").when(F.col("j") > 0, "ja").otherwise("other").alias("dominant"))


_LINES = "SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n\\z', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\n\\z', ''), chr(10)), 1) - 1 AS line_no FROM documents WHERE text <> ''"


@query(f"SELECT doc_id, count(*) AS dloc, CAST(sum((trim(line) = '')::INT) AS BIGINT) AS bloc, CAST(sum((trim(line) <> '')::INT) AS BIGINT) AS ploc, count(DISTINCT CASE WHEN trim(line) <> '' THEN line END) AS distinct_lines, round(avg((trim(line) = '')::INT), 6) AS blank_ratio, round(quantile_cont(length(line), 0.95), 6) AS p95_length FROM ({_LINES}) GROUP BY doc_id")
def line_family(spark, d):
    return lines.line_family(_docs(spark, d))


@query(f"SELECT line, count(DISTINCT doc_id) AS docs FROM ({_LINES}) WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT doc_id) > 1")
def repeated_lines(spark, d):
    return lines.repeated_lines(_docs(spark, d))


@query(
    r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(unnest(regexp_extract_all(text, '[^ \t\n]+')), '^[-_.,;:!?|]+', ''), '[-_.,;:!?|]+$', '') AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '^[0-9][0-9.,]*$') THEN 'numeric' WHEN regexp_matches(t, '[/\\]') THEN 'path' WHEN regexp_matches(t, '[_@0-9]|::|[a-z][A-Z]') THEN 'identifier' ELSE 'word' END AS kind,
count(*) AS tokens, count(DISTINCT t) AS distinct_tokens FROM t WHERE t <> '' GROUP BY ALL"""
)
def token_classes(spark, d):
    return lines.token_classes(_docs(spark, d))


_HAL = "total1 + total2"
_VOL = f"CASE WHEN n1 + n2 > 0 THEN ({_HAL}) * log2(n1 + n2) ELSE 0 END"
_DIF = "CASE WHEN n2 > 0 THEN n1 / 2 * (total2 / n2) ELSE 0 END"


@query(
    rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+|[.,;:!?|#$%&*]')) AS t FROM documents), p AS (SELECT doc_id, t, count(*) AS n, regexp_matches(t, '^[.,;:!?|#$%&*]$') AS op FROM t GROUP BY ALL),
c AS (SELECT doc_id, sum(op::INT) AS n1, sum((NOT op)::INT) AS n2, sum(CASE WHEN op THEN n ELSE 0 END) AS total1, sum(CASE WHEN op THEN 0 ELSE n END) AS total2 FROM p GROUP BY doc_id)
SELECT doc_id, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, CAST(total1 AS BIGINT) AS total1, CAST(total2 AS BIGINT) AS total2, round({_VOL}, 4) AS volume, round({_DIF}, 4) AS difficulty,
round(CASE WHEN ({_DIF}) <> 0 THEN 1 / ({_DIF}) ELSE 0 END, 4) AS level, round(({_DIF}) * ({_VOL}), 4) AS effort, round(pow(({_DIF}) * ({_VOL}), 2.0 / 3) / 3000, 4) AS bugs FROM c"""
)
def halstead_text(spark, d):
    return lines.halstead_text(_docs(spark, d))


@query(
    rf"""WITH l AS (SELECT doc_id, line_no, regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}]+') AS ws FROM ({_LINES})),
g AS (SELECT doc_id, line_no, list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS sh FROM l WHERE len(ws) >= 5),
e AS (SELECT doc_id, line_no, len(sh) AS n, unnest(sh) AS g FROM g), p AS (SELECT a.doc_id, a.line_no AS la, b.line_no AS lb, count(*) AS i, max(a.n) AS na, max(b.n) AS nb FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.g = b.g AND a.line_no < b.line_no GROUP BY ALL)
SELECT doc_id, la AS line_a, lb AS line_b, round(i / (na + nb - i), 6) AS jaccard FROM p WHERE i / (na + nb - i) > 0.82"""
)
def near_paragraphs(spark, d):
    return lines.near_paragraphs(_docs(spark, d))


# --------------------------------------------------------------------- links
_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1))"
_LINKS = f"SELECT *, {_HOST} AS h FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS url FROM pages)"
_CLASS = f"CASE WHEN url LIKE '#%' THEN 'internal' WHEN url LIKE 'mailto:%' THEN 'mail' WHEN h IN ({_list(links.SCHOLARLY)}) THEN 'scholarly' WHEN h IN ({_list(links.CODE_HOSTS)}) AND regexp_matches(url, '/(issues|pull|merge_requests)/[0-9]+') THEN 'issue' WHEN h IN ({_list(links.CODE_HOSTS)}) THEN 'vendor' WHEN h <> '' THEN 'external' ELSE 'relative' END"


@query(f"SELECT page_id, {_CLASS} AS class, count(*) AS links FROM ({_LINKS}) GROUP BY ALL")
def link_classes(spark, d):
    return links.classes(_t(spark, d, "pages"))


_SAT = lambda x, lo, hi: f"greatest(0.0, least(1.0, (({x}) - {lo}) / ({hi} - {lo})))"


@query(
    rf"""WITH l AS (SELECT page_id, url, {_CLASS} AS c FROM ({_LINKS})), p AS (SELECT page_id, count(*) AS links, sum((url = '')::INT) AS broken, sum((c IN ('external', 'scholarly', 'issue', 'vendor'))::INT) AS ext, sum((c = 'internal')::INT) AS int_, sum((c = 'relative')::INT) AS rel FROM l GROUP BY page_id),
w AS (SELECT page_id, len(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\p{{L}}\p{{N}}]+')) AS words FROM pages)
SELECT page_id, links, CAST(broken AS BIGINT) AS broken, CAST(ext AS BIGINT) AS external, round(0.45 * {_SAT('broken / links', 0, '0.1')} + 0.1 * {_SAT('ext / links', '0.6', '0.9')} + 0.1 * {_SAT('CASE WHEN words <> 0 THEN 100 * links / words ELSE 0 END', 6, 14)}, 6) AS link_debt, round(0.3 * int_ + 0.8 * rel + ext + 2.5 * broken, 4) AS review_burden FROM p JOIN w USING (page_id)"""
)
def link_debt(spark, d):
    return links.debt(_t(spark, d, "pages"))


# --------------------------------------------------------------------- corpus operators
_BASE = "SELECT doc_id, lang, length(text) AS chars, length(text) - length(replace(text, ' ', '')) AS blanks FROM documents"


def _revisions(spark, d):
    """Two revisions of the documents' sizes, each of all rows: in the head every text stands five ids later."""
    t = _docs(spark, d).select("doc_id", F.length("text").alias("chars"), (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("blanks"))
    return t, t.withColumn("doc_id", F.col("doc_id") + 5)


_REV = f"t AS ({_BASE}), b AS (SELECT * FROM t), h AS (SELECT doc_id + 5 AS doc_id, chars, blanks FROM t), j AS (SELECT coalesce(h.doc_id, b.doc_id) AS doc_id, b.doc_id IS NULL AS is_new, h.doc_id IS NULL AS is_deleted, b.chars AS bc, h.chars AS hc, b.blanks AS bb, h.blanks AS hb FROM b FULL JOIN h ON b.doc_id = h.doc_id), m AS (SELECT doc_id, 'chars' AS metric, coalesce(hc, 0)::DOUBLE AS current, coalesce(bc, 0)::DOUBLE AS baseline, is_new, is_deleted FROM j UNION ALL SELECT doc_id, 'blanks', coalesce(hb, 0)::DOUBLE, coalesce(bb, 0)::DOUBLE, is_new, is_deleted FROM j), dd AS (SELECT doc_id, metric, current, baseline, current - baseline AS delta, is_new, is_deleted FROM m)"


@query(f"WITH {_REV} SELECT * FROM dd")
def diff_full_outer(spark, d):
    return corpus.compare(*_revisions(spark, d), ["chars", "blanks"], "doc_id")


@query(f"WITH {_REV} SELECT * FROM dd WHERE doc_id IN (SELECT doc_id FROM dd WHERE delta <> 0)")
def diff_changed_only(spark, d):
    return corpus.changed_only(corpus.compare(*_revisions(spark, d), ["chars", "blanks"], "doc_id"), "doc_id")


@query(f"WITH {_REV} SELECT doc_id, metric, CASE WHEN delta < 0 THEN 'better' WHEN delta > 0 THEN 'worse' ELSE 'same' END AS trend, greatest(0.0, delta) AS adverse, greatest(0.0, delta) > 50 AS violates FROM dd WHERE NOT is_deleted")
def gate_adverse_delta(spark, d):
    x = corpus.compare(*_revisions(spark, d), ["chars", "blanks"], "doc_id").where("not is_deleted")
    a = expr.adverse("delta", False)
    return x.select("doc_id", "metric", expr.trend("delta", False).alias("trend"), a.alias("adverse"), (a > 50).alias("violates"))


@query(f"SELECT doc_id, chars, blanks FROM ({_BASE}) ORDER BY chars DESC, blanks ASC, doc_id LIMIT 10")
def rank_multikey(spark, d):
    return corpus.rank(_revisions(spark, d)[0], [("chars", False), ("blanks", True)], "doc_id")


@query(f"WITH t AS ({_BASE}), m AS (SELECT doc_id, 'chars' AS metric, chars::DOUBLE AS value FROM t UNION ALL SELECT doc_id, 'blank_share', blanks / chars FROM t WHERE chars > 0) SELECT doc_id, metric, value FROM m WHERE (metric = 'chars' AND value > 5000) OR (metric = 'blank_share' AND value < 0.1)")
def threshold_violations(spark, d):
    t = _docs(spark, d).select("doc_id", F.length("text").cast("double").alias("c"), (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("b"))
    m = t.select("doc_id", F.lit("chars").alias("metric"), F.col("c").alias("value")).unionByName(t.where("c > 0").select("doc_id", F.lit("blank_share").alias("metric"), (F.col("b") / F.col("c")).alias("value")))
    rules = spark.createDataFrame([("chars", 5000.0, False), ("blank_share", 0.1, True)], "metric string, limit_value double, higher_is_better boolean")
    return corpus.violations(m, rules).select("doc_id", "metric", "value")


@query("WITH h AS (SELECT user_id, event_type, count(*) AS nh FROM events WHERE event_id % 2 = 1 GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS nb FROM events WHERE event_id % 2 = 0 GROUP BY ALL) SELECT user_id, event_type, nh - coalesce(nb, 0) AS surplus FROM h LEFT JOIN b USING (user_id, event_type) WHERE nh > coalesce(nb, 0)")
def multiset_increase(spark, d):
    """New occurrences of a key between two halves of the events, as of broken links between revisions."""
    e = _t(spark, d, "events")
    return corpus.multiset_increase(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"])


@query(
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS path, list(CASE event_id % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE 'deleted' END ORDER BY event_id) AS steps FROM events GROUP BY user_id),
f AS (SELECT path, list_reduce(list_prepend('none', steps), lambda acc, x: CASE x WHEN 'added' THEN CASE acc WHEN 'deleted' THEN 'modified' ELSE 'added' END WHEN 'modified' THEN CASE acc WHEN 'added' THEN 'added' ELSE 'modified' END ELSE CASE acc WHEN 'added' THEN 'none' ELSE 'deleted' END END) AS status FROM e)
SELECT path, status FROM f WHERE status <> 'none'"""
)
def change_fold(spark, d):
    """Net change by user of an ordered stream of additions, modifications and deletions."""
    e = _t(spark, d, "events").select(F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("path"), F.element_at(F.array(F.lit("added"), F.lit("modified"), F.lit("deleted")), (F.pmod("event_id", F.lit(3)) + 1).cast("int")).alias("status"))
    return corpus.fold_changes(e)


@query(
    """WITH s AS (SELECT 'tpch' AS path, -1 AS space_id, NULL AS parent_id, 0.0 AS v UNION ALL SELECT 'tpch', r_regionkey, -1, 1.0 FROM region UNION ALL SELECT 'tpch', 100 + n_nationkey, n_regionkey, 2.0 FROM nation UNION ALL SELECT 'tpch', 1000 + c_custkey, 100 + c_nationkey, c_acctbal::DOUBLE FROM customer),
c AS (SELECT space_id AS a, v FROM s UNION ALL SELECT parent_id, v FROM s WHERE parent_id IS NOT NULL UNION ALL SELECT p.parent_id, s.v FROM s JOIN s p ON s.parent_id = p.space_id WHERE p.parent_id IS NOT NULL UNION ALL SELECT q.parent_id, s.v FROM s JOIN s p ON s.parent_id = p.space_id JOIN s q ON p.parent_id = q.space_id WHERE q.parent_id IS NOT NULL)
SELECT CAST(a AS BIGINT) AS ancestor, round(sum(v), 2) AS total, min(v) AS least, max(v) AS most, count(*) AS spaces FROM c GROUP BY a"""
)
def ancestor_rollup(spark, d):
    """Roll-up over a tree: regions, nations and customers as nested spaces."""
    b = F.lit("tpch").alias("path")
    root = spark.range(1).select(b, F.lit(-1).cast("long").alias("space_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0.0).alias("value"))
    r = _t(spark, d, "region").select(b, F.col("r_regionkey").cast("long").alias("space_id"), F.lit(-1).cast("long").alias("parent_id"), F.lit(1.0).alias("value"))
    n = _t(spark, d, "nation").select(b, (F.col("n_nationkey") + 100).cast("long").alias("space_id"), F.col("n_regionkey").cast("long").alias("parent_id"), F.lit(2.0).alias("value"))
    c = _t(spark, d, "customer").select(b, (F.col("c_custkey") + 1000).cast("long").alias("space_id"), (F.col("c_nationkey") + 100).cast("long").alias("parent_id"), F.col("c_acctbal").cast("double").alias("value"))
    x = corpus.roll_up(root.union(r).union(n).union(c))
    return x.select("ancestor", F.round("total", 2).alias("total"), "least", "most", "spaces")


@query("SELECT doc_id, CASE WHEN n < 200 THEN 0 WHEN n < 1000 THEN 1 WHEN n < 5000 THEN 2 ELSE 3 END AS band FROM (SELECT doc_id, length(text) AS n FROM documents)")
def size_bands(spark, d):
    return _docs(spark, d).select("doc_id", expr.band(F.length("text"), [200, 1000, 5000]).alias("band"))


@query(f"WITH l AS (SELECT doc_id, line_no, length(line) AS n FROM ({_LINES})) SELECT doc_id, line_no, round(avg(n) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS around, n - coalesce(lag(n) OVER (PARTITION BY doc_id ORDER BY line_no), 0) AS jump FROM l")
def neighbour_lines(spark, d):
    w = Window.partitionBy("doc_id").orderBy("line_no")
    n = F.length("line")
    return lines.line_rows(_docs(spark, d)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.round(F.avg(n).over(w.rowsBetween(-2, 2)), 6).alias("around"), (n - F.coalesce(F.lag(n).over(w), F.lit(0))).cast("long").alias("jump"))


@query("SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def corpus_summary(spark, d):
    x = _t(spark, d, "documents").rollup("lang", "source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))
    return x.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "docs", "chars")


_FORM = [(3, 5, 20, 30, 4, 40, 0.1), (10, 12, 100, 90, 11, 120, 0.25), (0, 0, 0, 0, 1, 1, 0.0)]


@query(
    "WITH v(n1, n2, t1, t2, g, s, c) AS (VALUES " + ", ".join(map(str, _FORM)) + """), x AS (SELECT *, CASE WHEN n1 + n2 > 0 THEN (t1 + t2) * log2(n1 + n2) ELSE 0 END AS v FROM v)
SELECT n1, round(v, 6) AS volume, round(CASE WHEN v > 0 THEN 171 - 5.2 * ln(v) - 0.23 * g - 16.2 * ln(s) ELSE 0 END, 6) AS mi_original, round(CASE WHEN v > 0 THEN 171 - 5.2 * log2(v) - 0.23 * g - 16.2 * log2(s) + 50 * sin(sqrt(2.4 * c)) ELSE 0 END, 6) AS mi_sei, round(greatest(0, CASE WHEN v > 0 THEN (171 - 5.2 * ln(v) - 0.23 * g - 16.2 * ln(s)) * 100 / 171 ELSE 0 END), 6) AS mi_visual_studio FROM x"""
)
def maintainability_formula(spark, d):
    x = spark.createDataFrame(_FORM, "n1 int, n2 int, t1 int, t2 int, g int, s int, c double")
    x = x.withColumn("v", expr.halstead("n1", "n2", "t1", "t2")["volume"])
    return x.select("n1", F.round("v", 6).alias("volume"), *[F.round(e, 6).alias(k) for k, e in expr.maintainability("v", "g", "s", "c").items()])


# --------------------------------------------------------------------- code and Markdown
_CODE = [
    ("a.py", "import os\n\n# helper\ndef f(x, y=1):\n    if x and y or x:\n        return x\n    for i in range(3):\n        if i:\n            y += i\n    return y\n\n\nclass C:\n    size = 1\n    _hidden = 2\n\n    def m(self):\n        return [i for i in range(3) if i]\n"),
    ("b.go", "package main\n\n// add\nfunc add(a int, b int) int {\n\tif a > b && b > 0 {\n\t\treturn a\n\t} else {\n\t\tb++\n\t}\n\tfor i := 0; i < 3; i++ {\n\t\ta = a + i\n\t}\n\treturn a + b\n}\n"),
    ("c.js", "function g(a, b) {\n  const h = (x) => x ? 1 : 2;\n  while (a < b) { a += h(a); }\n  switch (a) { case 1: return 1; default: return b; }\n}\n"),
    ("d.rs", "fn main() {\n    let x = foo()?;\n    match x { 1 => bar(), _ => baz() }\n}\n"),
    ("e.c", "int f(void) {\n  int a = 1;\n  return a ? 1 : 0; /* done */\n}\n"),
    ("broken.py", "def f(:\n"), ("notes.txt", "plain"),
]
_MD = [("r.md", "# Title\n\nSome words here with a [link](#part) and [file](a/b.md).\n\n### Deep\n\n```py\nx = 1\ny = 2\n```\n\n| a | b |\n|---|---|\n| 1 | |\n\n- one\n- two\n\n## Part\n\nTODO: more. ![](p.png) <https://example.org/x>\n\n```mermaid\ngraph TD\nA-->B\nB-->C\nC-->A\n```\n"), ("empty.md", "")]


@query()
def code_metrics(spark, d):
    return code.metrics(spark.createDataFrame(_CODE, "path string, text string"))


@query()
def code_spaces(spark, d):
    return code.spaces(spark.createDataFrame(_CODE, "path string, text string"))


@query()
def markdown_metrics(spark, d):
    return markdown.metrics(spark.createDataFrame(_MD, "path string, text string"))


QUERIES |= documents.QUERIES | prose_blocks.QUERIES
ORACLE_SQL |= documents.ORACLE_SQL | prose_blocks.ORACLE_SQL
