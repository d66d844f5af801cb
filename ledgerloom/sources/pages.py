"""Fetched pages and search results: what is kept of them, and who found it first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.functions.values import host, html_text, source_class, under_any

# Least text of a page, characters that are kept, results of a search.
LEAST_TEXT, KEPT_TEXT, RESULTS = 200, 20_000, 10
ALIASES = {"sec": ["sec.gov"], "ctgov": ["clinicaltrials.gov"]}


def denylist(names: list[str]) -> list[str]:
    """Host suffixes of a list of hosts and aliases: no leading dots, each once; a bare word that is no alias is an error."""
    out: list[str] = []
    for name in (n.strip().lower().lstrip(".") for n in names):
        if name not in ALIASES and "." not in name:
            raise ValueError(f"neither a host nor a known list: {name}")
        out += [s for s in ALIASES.get(name, [name]) if s not in out]
    return out


def first_found(results: DataFrame) -> DataFrame:
    """One row a URL of ``results(url, step, rank, ...)``: the search that found it first keeps it, fetched or not."""
    w = Window.partitionBy("url").orderBy("step", "rank", "formulation_id")
    return results.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def top_results(results: DataFrame, k: int = RESULTS) -> DataFrame:
    """The first k results of each search, with missing titles and snippets as empty text."""
    w = Window.partitionBy("formulation_id").orderBy("rank", "url")
    r = results.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    return r.withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "snippet")})


def fetched(pages: DataFrame, denied: list[str]) -> DataFrame:
    """``pages(url, landed, status, content_type, html)`` with ``outcome, text, domain, source_class, anchored``.

    The first rule that applies says what became of a page: denied by its
    own host or by the one where it landed, an error status, not HTML, too little text; else kept.
    """
    where = F.coalesce("landed", "url")
    text = html_text(F.col("html"))
    outcome = (
        F.when(under_any(host(F.col("url")), denied), "denied").when(F.col("status") != 200, "status").when(under_any(host(where), denied), "denied_after_redirect")
        .when(~F.coalesce(F.lower("content_type").startswith("text/html"), F.lit(False)), "not_html").when(F.length(text) < LEAST_TEXT, "too_short").otherwise("kept")
    )
    d = pages.withColumn("outcome", outcome)
    kept = F.col("outcome") == "kept"
    h = host(where)
    return d.withColumns({"text": F.when(kept, F.substring(text, 1, KEPT_TEXT)), "domain": F.when(kept, F.regexp_replace(h, r"^www\.", "")), "source_class": F.when(kept, source_class(h)), "anchored": F.when(kept, source_class(h) == "regulatory")})


def split_relevant(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources ``(..., relevant, conf)`` that are kept, and those rejected with their score, which stay for audits."""
    return judged.where("relevant"), judged.where("not coalesce(relevant, false)").withColumn("rejection_score", 1 - F.col("conf"))


def denied_sources(sources: DataFrame, rejected: DataFrame, denied: list[str]) -> DataFrame:
    """Sources, kept or rejected, from hosts that were to be left out."""
    both = sources.select("source_id", "url").unionByName(rejected.select("source_id", "url"))
    return both.where(under_any(host(F.col("url")), denied))


def assert_undenied(sources: DataFrame, rejected: DataFrame, denied: list[str]) -> None:
    """Raises if any source comes from a denied host."""
    n = denied_sources(sources, rejected, denied).count()
    if n:
        raise AssertionError(f"{n} sources from denied hosts")


def survival(pages: DataFrame) -> DataFrame:
    """One row ``n, survived, rate, verdict``: share of pages that are kept; STARVED below 0.3."""
    a = pages.agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "kept").alias("survived"))
    return a.withColumn("rate", F.try_divide("survived", "n")).withColumn("verdict", F.when(F.coalesce("rate", F.lit(0.0)) < 0.3, "STARVED").otherwise("ok"))
