"""Links of web pages: extraction, classes, debt and review burden."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr

# Fixed values.
SCHOLARLY = ("doi.org", "arxiv.org", "pubmed.ncbi.nlm.nih.gov")
CODE_HOSTS = ("github.com", "gitlab.com", "bitbucket.org")


def host(url: Column) -> Column:
    """Lower-cased host without userinfo and port."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def link_rows(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("ord", "url"))


def link_class(url: Column) -> Column:
    h = host(url)
    return (
        F.when(url.startswith("#"), "internal").when(url.startswith("mailto:"), "mail").when(h.isin(*SCHOLARLY), "scholarly")
        .when(h.isin(*CODE_HOSTS) & url.rlike("/(issues|pull|merge_requests)/[0-9]+"), "issue").when(h.isin(*CODE_HOSTS), "vendor").when(h != "", "external").otherwise("relative")
    )


def classes(pages: DataFrame) -> DataFrame:
    return link_rows(pages).groupBy("page_id", link_class(F.col("url")).alias("class")).agg(F.count("*").alias("links"))


def debt(pages: DataFrame) -> DataFrame:
    """Link debt and review burden; without a file listing no link counts as broken but empty ones."""
    c = link_class(F.col("url"))
    per = link_rows(pages).groupBy("page_id").agg(
        F.count("*").alias("links"), F.sum((F.col("url") == "").cast("long")).alias("broken"), F.sum(c.isin("external", "scholarly", "issue", "vendor").cast("long")).alias("external"),
        F.sum((c == "internal").cast("long")).alias("internal"), F.sum((c == "relative").cast("long")).alias("relative"),
    )
    words = pages.select("page_id", F.size(F.regexp_extract_all(F.regexp_replace("html", "<[^>]*>", " "), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("words"))
    j = per.join(words, "page_id")
    n = F.col("links")
    score = expr.link_debt(F.col("broken") / n, F.lit(0.0), F.lit(0.0), F.col("external") / n, expr.ratio(100 * n, "words"))
    burden = 0.3 * F.col("internal") + 0.8 * F.col("relative") + 1.0 * F.col("external") + 2.5 * F.col("broken")
    return j.select("page_id", "links", "broken", "external", F.round(score, 6).alias("link_debt"), F.round(burden, 4).alias("review_burden"))
