"""Registry documents as rows: filing indexes, filings in XML, nested studies, result lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.values import number_text

_BLOCK = "accessionNumber array<string>, form array<string>, filingDate array<string>, primaryDocument array<string>"
INDEX = f"cik string, name string, filings struct<recent: struct<{_BLOCK.replace(' array', ': array')}>>"
ACCESSION = r"\d{10}-\d{2}-\d{6}"


def wanted_keys(index: DataFrame, ciks: list[str] | None = None, tickers: list[str] | None = None, name: str | None = None) -> DataFrame:
    """Keys of ``index(cik, ticker, name)``, ten digits each: the given ones, else by ticker, else by part of the name, else all."""
    if ciks:
        index = index.where(F.lpad("cik", 10, "0").isin([c.zfill(10) for c in ciks]))
    elif tickers:
        index = index.where(F.upper("ticker").isin([t.upper() for t in tickers]))
    elif name:
        index = index.where(F.lower("name").contains(name.lower()))
    return index.select(F.lpad("cik", 10, "0").alias("cik"), "ticker", "name")


def block_rows(df: DataFrame, block: str) -> DataFrame:
    """A row an accession number of the struct ``block`` of parallel arrays; arrays that are shorter give nulls."""
    rest = [c for c in df.columns if c != block]
    rows = df.select(*rest, F.col(block), F.posexplode(F.col(f"{block}.accessionNumber")).alias("_i", "accession"))
    at = lambda c: F.get(F.col(f"{block}.{c}"), F.col("_i"))
    return rows.select(*rest, "accession", at("form").alias("form"), at("filingDate").alias("filing_date"), at("primaryDocument").alias("document"))


def all_filings(submissions: DataFrame, shards: DataFrame) -> DataFrame:
    """``cik, name, accession, form, filing_date, document`` of ``submissions(cik, doc)`` and of the older pages ``shards(cik, doc)``.

    Text that is no JSON gives no rows of its own.
    """
    recent = submissions.select("cik", F.from_json("doc", INDEX).alias("j")).select("cik", F.col("j.name").alias("name"), F.col("j.filings.recent").alias("b"))
    names = recent.select("cik", "name").distinct()
    older = shards.select("cik", F.from_json("doc", _BLOCK).alias("b")).join(names, "cik", "left").select("cik", "name", "b")
    return block_rows(recent.unionByName(older), "b")


def wanted_filings(filings: DataFrame, forms: list[str], since: str | None = None) -> DataFrame:
    """Filings of the forms, from a day or year on; a missing date is before all."""
    f = filings.where(F.col("form").isin(forms))
    return f if since is None else f.where(F.coalesce("filing_date", F.lit("")) >= (f"{since}-01-01" if len(since) == 4 else since))


def filing_sources(filings: DataFrame) -> DataFrame:
    """Filings with the stamps of a source: url, title, class, type, chain and publishing time."""
    base = F.regexp_replace("form", "/A$", "")
    bare = F.regexp_replace("accession", "-", "")
    return filings.select(
        F.concat_ws("/", F.lit("https://www.sec.gov/Archives/edgar/data"), F.regexp_replace("cik", "^0+", ""), bare, "document").alias("url"),
        F.concat_ws(" ", "form", "accession").alias("title"), F.lit("sec.gov").alias("domain"), F.lit("regulatory").alias("source_class"), F.lit(True).alias("anchored"),
        F.concat(F.lit("Form "), F.col("form")).alias("doc_type"), F.concat(F.lit("edgar:"), F.col("cik"), F.lit(":"), base).alias("chain"), F.col("filing_date").try_cast("date").alias("published"),
    )


def accession_of(title: Column, url: Column) -> Column:
    """A filing's number from its source's title, else from the 18 digits in its path; empty if neither has it."""
    digits = F.regexp_extract(F.coalesce(url, F.lit("")), r"/(\d{18})/", 1)
    cut = F.concat_ws("-", F.substr(digits, F.lit(1), F.lit(10)), F.substr(digits, F.lit(11), F.lit(2)), F.substr(digits, F.lit(13)))
    named = F.regexp_extract(F.coalesce(title, F.lit("")), f"({ACCESSION})", 1)
    return F.when(named != "", named).when(digits != "", cut).otherwise("")


FORM = """primaryIssuer struct<cik: string, entityName: string>, offeringData struct<typeOfFiling: struct<newOrAmendment: struct<isAmendment: string, previousAccessionNumber: string>,
dateOfFirstSale: struct<value: string, yetToOccur: string>>, offeringSalesAmounts: struct<totalOfferingAmount: string, totalAmountSold: string>>"""


def _money(text: Column) -> Column:
    return F.regexp_replace(text, "[,$]", "").try_cast("double")


def parsed_forms(sources: DataFrame) -> DataFrame:
    """``source_id, accession, cik, entity, is_amendment, previous, first_sale, amount, offered, indefinite, flags`` of ``sources(source_id, title, url, doc)``.

    A document that is not well-formed XML stops the query: a table of truth is
    whole or loudly broken. What is missing or unreadable is flagged.
    """
    # Each document is read once, into a struct.
    d = sources.select("source_id", accession_of(F.col("title"), F.col("url")).alias("accession"), F.from_xml("doc", FORM, {"mode": "FAILFAST"}).alias("x"))
    x = lambda path: F.nullif(F.btrim(F.col(f"x.{path}")), F.lit(""))
    at, sales = "offeringData.typeOfFiling", "offeringData.offeringSalesAmounts"
    d = d.select(
        "source_id", "accession", x("primaryIssuer.cik").alias("cik"), x("primaryIssuer.entityName").alias("entity"),
        (F.lower(F.coalesce(x(f"{at}.newOrAmendment.isAmendment"), F.lit(""))) == "true").alias("is_amendment"), x(f"{at}.newOrAmendment.previousAccessionNumber").alias("previous"),
        x(f"{at}.dateOfFirstSale.value").alias("first_sale"), (F.lower(F.coalesce(x(f"{at}.dateOfFirstSale.yetToOccur"), F.lit(""))) == "true").alias("yet"),
        x(f"{sales}.totalAmountSold").alias("sold"), x(f"{sales}.totalOfferingAmount").alias("offer"),
    )
    indefinite = lambda c: F.coalesce(F.lower(c) == "indefinite", F.lit(False))
    flags = F.array_compact(F.array(
        F.when(F.col("cik").isNull(), F.lit("missing_cik")), F.when(F.col("entity").isNull(), F.lit("missing_entity_name")),
        F.when(F.col("previous").isNotNull() & ~F.replace(F.col("previous"), F.lit(" "), F.lit("")).rlike(f"^{ACCESSION}$"), F.lit("odd_previous_accession")),
        F.when(F.col("first_sale").isNull() & ~F.col("yet"), F.lit("missing_date_of_first_sale")),
        F.when(_money(F.col("sold")).isNull(), F.when(indefinite(F.col("sold")), F.lit("indefinite_amount_sold")).otherwise(F.lit("unreadable_amount_sold"))),
    ))
    return d.select("source_id", "accession", F.lpad("cik", 10, "0").alias("cik"), "entity", "is_amendment", "previous", "first_sale", _money(F.col("sold")).alias("amount"), _money(F.col("offer")).alias("offered"), indefinite(F.col("offer")).alias("indefinite"), flags.alias("flags"))


def form_mentions(forms: DataFrame) -> DataFrame:
    """Three mentions a filing at most: ``source_id, entity, attribute, value, value_num``, certain because a tag says them."""
    one = lambda a, v, n: F.when(v.isNotNull() & (v != ""), F.struct(F.lit(a).alias("attribute"), v.alias("value"), n.alias("value_num")))
    none = F.lit(None).cast("double")
    three = F.array(one("amount", number_text(F.col("amount")), F.col("amount")), one("date", F.col("first_sale"), none), one("registry_key", F.col("accession"), none))
    return forms.select("source_id", "entity", F.inline(F.array_compact(three)))


STUDY = """protocolSection struct<identificationModule: struct<nctId: string, briefTitle: string, officialTitle: string>,
statusModule: struct<lastUpdatePostDateStruct: struct<date: string>, studyFirstPostDateStruct: struct<date: string>, startDateStruct: struct<date: string>>,
descriptionModule: struct<briefSummary: string>, conditionsModule: struct<conditions: array<string>>>"""


def flat_studies(studies: DataFrame) -> DataFrame:
    """``key, title, published, text, updated, chain, doc_type`` of nested studies ``(doc)``; text that is no JSON gives nulls.

    Published: the last update, else the first post, else the start.
    """
    p = F.col("s.protocolSection")
    i, st = p["identificationModule"], p["statusModule"]
    updated = st["lastUpdatePostDateStruct"]["date"]
    parts = F.concat_ws("\n", i["officialTitle"], p["descriptionModule"]["briefSummary"], F.concat_ws("; ", p["conditionsModule"]["conditions"]))
    return studies.select(F.from_json("doc", STUDY).alias("s")).select(
        i["nctId"].alias("key"), F.coalesce(i["briefTitle"], i["officialTitle"]).alias("title"), F.coalesce(updated, st["studyFirstPostDateStruct"]["date"], st["startDateStruct"]["date"]).alias("published"),
        parts.alias("text"), updated.alias("updated"), F.concat(F.lit("ctgov:"), i["nctId"]).alias("chain"), F.lit("study record (updated)").alias("doc_type"),
    )


def browse_matches(results: DataFrame) -> DataFrame:
    """``candidate, cik, registered`` of result pages ``(candidate, atom, html)``.

    Atom: entries with a title and a key in their link, else the one company's
    block; where that gives nothing, the rows of the page as HTML.
    """
    local = lambda *names: "//" + "/".join(f"*[local-name()='{n}']" for n in names)
    ok = "*[local-name()='link'][contains(@href,'CIK=')] and normalize-space(*[local-name()='title'])"
    entry = f"//*[local-name()='entry'][{ok}]"
    titles, links = F.xpath("atom", F.lit(f"{entry}/*[local-name()='title']/text()")), F.xpath("atom", F.lit(f"{entry}/*[local-name()='link'][1]/@href"))
    many = F.transform(F.arrays_zip(titles.alias("t"), links.alias("l")), lambda x: F.struct(F.regexp_extract(x["l"], r"CIK=(\d+)", 1).alias("cik"), F.btrim(x["t"]).alias("registered")))
    block = local("company-info")
    single = F.array(F.struct(F.btrim(F.xpath_string("atom", F.lit(f"{block}//*[local-name()='cik']"))).alias("cik"), F.btrim(F.xpath_string("atom", F.lit(f"{block}//*[local-name()='conformed-name']"))).alias("registered")))
    row = r"CIK=(\d{1,10})[^>]*>[^<]*</a>\s*</td>\s*<td[^>]*>([^<]+)"
    html = F.coalesce("html", F.lit(""))
    rows = F.zip_with(F.regexp_extract_all(html, F.lit(row), F.lit(1)), F.regexp_extract_all(html, F.lit(row), F.lit(2)), lambda c, n: F.struct(c.alias("cik"), F.btrim(n).alias("registered")))
    filled = lambda a: F.filter(a, lambda x: (x["cik"] != "") & (x["registered"] != ""))
    d = results.select("candidate", filled(many).alias("many"), filled(single).alias("single"), filled(rows).alias("rows"))
    best = F.when(F.size("many") > 0, F.col("many")).when(F.size("single") > 0, F.col("single")).otherwise(F.col("rows"))
    return d.select("candidate", F.inline(best)).select("candidate", F.lpad("cik", 10, "0").alias("cik"), "registered")


def form_counts(filings: DataFrame) -> DataFrame:
    """``cik, n_formd, n_original, first, last``: offerings and their amendments of each filer."""
    own = F.col("form").isin("D", "D/A")
    return filings.groupBy("cik").agg(F.count_if(own).alias("n_formd"), F.count_if(F.col("form") == "D").alias("n_original"), F.min(F.when(own, F.col("filing_date"))).alias("first"), F.max(F.when(own, F.col("filing_date"))).alias("last"))
