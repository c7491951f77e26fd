"""Prose: words, sentences, readability, lexical variety, wording.

Shredding stays in built-in array functions.  A document's words are exploded where they are
counted by kind and summed again by ``doc_id``; rows of one document lie in one task, so the partial
aggregation leaves one row for each document before the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr, vocab

WORD, SENTENCE = r"[\p{L}\p{N}]+", r"[^.!?]*[\p{L}\p{N}][^.!?]*"
#: Fewer words or sentences give no readability.
LEAST_WORDS, LEAST_SENTENCES = 100, 5


def words_of(text: "Column | str" = "text") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def sentences_of(text: "Column | str" = "text") -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def syllables(w: "Column | str") -> Column:
    """Vowel groups, less a silent final e and -ed, at least 1."""
    w = F.col(w) if isinstance(w, str) else w
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    silent_e = F.when((groups > 1) & w.endswith("e") & ~w.endswith("le"), 1).otherwise(0)
    silent_ed = F.when((groups > 1) & w.endswith("ed") & ~w.rlike("[td]ed$"), 1).otherwise(0)
    return F.greatest(F.lit(1), groups - silent_e - silent_ed)


def word_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(words_of()).alias("pos", "word"))


def sentence_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(sentences_of()).alias("sent", "sentence"))


def counts(docs: DataFrame) -> DataFrame:
    """``doc_id, w, s, y, l, poly, mono150, longw``: what the readability formulas need."""
    y, n = syllables("word"), F.length("word")
    # One scan: the number of sentences goes along with the words, which are summed before they are moved.
    # Sentences are counted first: beside posexplode they would be sought again for every word.
    rows = docs.select("doc_id", "text", F.size(sentences_of()).alias("s")).select("doc_id", "s", F.posexplode(words_of()).alias("pos", "word"))
    return rows.groupBy("doc_id").agg(
        F.max("s").alias("s"), F.count("*").alias("w"), F.sum(y).alias("y"), F.sum(F.least(F.lit(20), n)).alias("l"), F.sum(F.when(y >= 3, 1).otherwise(0)).alias("poly"),
        F.sum(F.when((F.col("pos") < 150) & (y == 1), 1).otherwise(0)).alias("mono150"), F.sum(F.when(n >= 7, 1).otherwise(0)).alias("longw"),
    )


def readability(docs: DataFrame) -> DataFrame:
    w, s, y, n = (F.col(c).cast("double") for c in ("w", "s", "y", "l"))
    poly, mono, longw = (F.col(c).cast("double") for c in ("poly", "mono150", "longw"))
    enough = (F.col("w") >= LEAST_WORDS) & (F.col("s") >= LEAST_SENTENCES)
    f = {
        "flesch": 206.835 - 1.015 * w / s - 84.6 * y / w,
        "fkgl": 0.39 * w / s + 11.8 * y / w - 15.59,
        "fog": 0.4 * (w / s + 100 * poly / w),
        "ari": 4.71 * n / w + 0.5 * w / s - 21.43,
        "cli": 0.0588 * (100 * n / w) - 0.296 * (100 * s / w) - 15.8,
        "lix": w / s + 100 * longw / w,
        "rix": longw / s,
    }
    out = {k: F.when(enough, F.round(v, 3)) for k, v in f.items()}
    out["smog"] = F.when(enough & (F.col("s") >= 30), F.round(1.043 * F.sqrt(30 * poly / s) + 3.1291, 3))
    out["forcast"] = F.when(enough & (F.col("w") >= 150), F.round(20 - mono / 10, 3))
    return counts(docs).where("w > 0 and s > 0").select("doc_id", F.col("w").alias("words"), F.col("s").cast("long").alias("sentences"), *[v.alias(k) for k, v in out.items()])


def hardest(docs: DataFrame, k: int = 10) -> DataFrame:
    return readability(docs).where("flesch is not null").orderBy("flesch", "doc_id").limit(k).select("doc_id", "flesch", "fkgl")


def sentence_lengths(docs: DataFrame) -> DataFrame:
    """Mean, nearest-rank 90th percentile, largest and population deviation of words a sentence; share over 30."""
    n = F.size(words_of("sentence"))
    rows = sentence_rows(docs).select("doc_id", n.alias("n")).where("n > 0")
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("sentences"), F.round(F.avg("n"), 6).alias("mean_words"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY n)").cast("long").alias("p90_words"), F.max("n").cast("long").alias("max_words"),
        F.round(F.stddev_pop("n"), 6).alias("sd_words"), F.round(F.avg(F.when(F.col("n") > 30, 1.0).otherwise(0.0)), 6).alias("long_rate"),
    )


def variety(docs: DataFrame) -> DataFrame:
    """Types, share of words seen once and twice, content-word density."""
    per = word_rows(docs).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    stop = F.col("word").isin(*vocab.STOPWORDS)
    return per.groupBy("doc_id").agg(
        F.sum("n").alias("words"), F.count("*").alias("types"), F.round(F.avg((F.col("n") == 1).cast("double")), 6).alias("hapax"), F.round(F.avg((F.col("n") == 2).cast("double")), 6).alias("dis"),
        F.round(1 - F.sum(F.when(stop, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("density"),
    )


def mattr(docs: DataFrame, window: int = 50) -> DataFrame:
    """Mean type/token ratio over all windows of ``window`` words; plain ratio of shorter texts.

    A word is a new type in every window from its place back to just after its previous place, so the
    types of all windows sum up from the distance to the previous equal word: one pass, no window lists.
    """
    w = Window.partitionBy("doc_id", "word").orderBy("pos")
    rows = word_rows(docs).withColumn("prev", F.lag("pos").over(w))
    size = docs.select("doc_id", F.size(words_of()).alias("n")).where("n > 0")
    # Windows that begin in (prev, pos] and contain pos; begins run from 0 to n - width.
    j = rows.join(size, "doc_id")
    last = F.greatest(F.col("n") - window, F.lit(0))
    lo = F.greatest(F.coalesce(F.col("prev") + 1, F.lit(0)), F.col("pos") - (window - 1), F.lit(0))
    hi = F.least(F.col("pos"), last)
    per = j.groupBy("doc_id", "n").agg(F.sum(F.greatest(F.lit(0), hi - lo + 1)).alias("types"))
    width = F.least(F.col("n"), F.lit(window))
    return per.select("doc_id", F.round(F.col("types") / (F.greatest(F.col("n") - window, F.lit(0)) + 1) / width, 6).alias("mattr"))


def ngram_hits(docs: DataFrame, phrases: tuple[str, ...], name: str) -> DataFrame:
    """How many 1- to 4-grams of a document are in a phrase list, and their share of its words."""
    text = F.concat(F.lit(" "), F.array_join("ws", " "), F.lit(" "))
    by_size: dict[int, list[str]] = {}
    for p in phrases:
        by_size.setdefault(len(p.split()), []).append(p)
    # Places where a phrase of one size begins: look-around consumes nothing, so overlaps all count.
    hit = sum((F.regexp_count(text, F.lit(f"(?<= )(?=(?:{'|'.join(ps)}) )")) for ps in by_size.values()), F.lit(0))
    return docs.select("doc_id", words_of().alias("ws")).where(F.size("ws") > 0).select("doc_id", hit.cast("long").alias(f"{name}_hits"), F.round(hit / F.size("ws"), 6).alias(f"{name}_density"))


def phrase_presence(docs: DataFrame, phrases: tuple[str, ...], name: str) -> DataFrame:
    """Pairs of sentence and phrase it contains; each counts once whatever the number of occurrences."""
    s = F.lower("sentence")
    hit = sum((s.contains(p).cast("int") for p in phrases), F.lit(0))
    return sentence_rows(docs).groupBy("doc_id").agg(F.sum(hit).alias(name))


def passive(docs: DataFrame) -> DataFrame:
    """Share of sentences with a form of be before an -ed word or irregular participle."""
    pattern = rf"(^|[^a-z])({'|'.join(vocab.BE_FORMS)}) +([a-z]+ed|{'|'.join(vocab.IRREGULAR)})($|[^a-z])"
    return sentence_rows(docs).groupBy("doc_id").agg(F.round(F.avg(F.lower("sentence").rlike(pattern).cast("double")), 6).alias("passive_ratio"))


def illusions(docs: DataFrame) -> DataFrame:
    """Words that repeat the word right before them."""
    ws = words_of()
    n = F.size(F.filter(F.zip_with(F.slice("ws", 1, F.greatest(F.size("ws") - 1, F.lit(0))), F.slice("ws", 2, F.greatest(F.size("ws") - 1, F.lit(0))), lambda a, b: a == b), lambda x: x))
    return docs.select("doc_id", ws.alias("ws")).where(F.size("ws") > 0).select("doc_id", n.cast("long").alias("illusions"))


def word_kinds(docs: DataFrame) -> DataFrame:
    """Adverbs in -ly, nominalisations and non-words, as counts and shares."""
    w = F.col("word")
    adverb = w.endswith("ly") & (F.length(w) > 3) & ~w.isin(*vocab.ADVERB_EXCEPTIONS)
    nominal = (F.length(w) > 5) & w.rlike(f"({'|'.join(vocab.NOMINAL_ENDS)})$")
    return word_rows(docs).groupBy("doc_id").agg(
        F.sum(adverb.cast("long")).alias("adverbs"), F.sum(nominal.cast("long")).alias("nominals"), F.sum(w.isin(*vocab.NONWORDS).cast("long")).alias("nonwords"),
        F.round(F.avg(adverb.cast("double")), 6).alias("adverb_density"), F.round(F.avg(nominal.cast("double")), 6).alias("nominal_density"),
    )


def wording(docs: DataFrame) -> DataFrame:
    """All wording measures and the quality score."""
    n = docs.select("doc_id", F.size(words_of()).alias("w")).where("w > 0")
    j = n.join(passive(docs), "doc_id").join(ngram_hits(docs, vocab.HEDGES, "hedge"), "doc_id").join(ngram_hits(docs, vocab.WEASELS, "weasel"), "doc_id")
    j = j.join(phrase_presence(docs, vocab.WORDY, "wordy"), "doc_id").join(phrase_presence(docs, vocab.CLICHES, "cliche"), "doc_id").join(word_kinds(docs), "doc_id").join(illusions(docs), "doc_id").join(sentence_lengths(docs).select("doc_id", "long_rate"), "doc_id")
    score = expr.english_wording("passive_ratio", "hedge_density", "weasel_density", F.col("wordy") / F.col("w"), "adverb_density", "nominal_density", "long_rate", F.col("cliche") / F.col("w"), "illusions", "nonwords")
    return j.select("doc_id", "passive_ratio", "hedge_density", "weasel_density", "long_rate", "illusions", F.round(score, 4).alias("wording_quality"))


def inclusive(docs: DataFrame) -> DataFrame:
    """Word-bounded hits of discouraged terms and the score that falls by 0.05 a hit."""
    t = F.lower("text")
    hits = sum((F.regexp_count(t, F.lit(rf"\b{a}\b")) for a, _ in vocab.INCLUSIVE), F.lit(0))
    return docs.select("doc_id", hits.cast("long").alias("flags")).select("doc_id", "flags", expr.clamp01(1 - 0.05 * F.col("flags")).alias("score"))


def scripts(docs: DataFrame) -> DataFrame:
    """Letters by script, the language class they suggest, and the entropy of the classes."""
    kinds = {"latin": "[A-Za-zＡ-Ｚａ-ｚ]", "hiragana": r"\p{Hiragana}", "katakana": r"\p{Katakana}", "han": r"\p{Han}"}
    java = kinds | {"hiragana": r"\p{IsHiragana}", "katakana": r"\p{IsKatakana}", "han": r"\p{IsHan}"}
    n = {k: F.regexp_count("text", F.lit(p)).cast("double") for k, p in java.items()}
    base = docs.select("doc_id", *[v.alias(k) for k, v in n.items()], F.regexp_count("text", F.lit(r"\p{L}")).cast("double").alias("letters"))
    base = base.withColumn("other", F.col("letters") - F.col("latin") - F.col("hiragana") - F.col("katakana") - F.col("han"))
    share = lambda c: expr.ratio(c, "letters")
    kana = (F.col("hiragana") + F.col("katakana")) / F.col("letters")
    lang = F.when(F.col("letters") == 0, "other").when(kana >= 0.15, "ja").when(share("han") >= 0.40, "other").when(share("latin") >= 0.80, "en").otherwise("other")
    h = sum((F.when(F.col(c) > 0, -share(c) * F.log2(share(c))).otherwise(0.0) for c in ("latin", "hiragana", "katakana", "han", "other")), F.lit(0.0))
    return base.select("doc_id", F.col("letters").cast("long").alias("letters"), F.round(share("latin"), 6).alias("latin_share"), lang.alias("language"), F.round(h, 6).alias("script_entropy"))
