"""Queries over what comes in: pages and search results, registry documents, readings and their validation, stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import values as V
from ledgerloom.operators import screening
from ledgerloom.plans.bindings import bound
from ledgerloom.plans.catalogue import _CUR, _HOST, _RATE, _SCALE_CASE, _SPELL, _SUFFIXES, _TOL, _class_case, _t, query  # noqa: F401
from ledgerloom.sources import pages, registry, store
from ledgerloom.storage import fresh

# Pages

_TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<script\b.*?</script>|<style\b.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'gs'), '[ \t\n\r\f\v]+', ' ', 'g'))"
_DENIED = ["sec.gov", "clinicaltrials.gov"]
_FETCHED = f"""ft AS (SELECT *, {_TEXT} AS t, {_HOST} AS h0, lower(regexp_extract(coalesce(landed, url), '^[a-zA-Z]+://([^/:?#]+)', 1)) AS h1 FROM v_hits),
fo AS (SELECT *, CASE WHEN {_SUFFIXES.replace("h ", "h0 ").replace("(h,", "(h0,")} THEN 'denied' WHEN status <> 200 THEN 'status' WHEN {_SUFFIXES.replace("h ", "h1 ").replace("(h,", "(h1,")} THEN 'denied_after_redirect'
        WHEN NOT coalesce(starts_with(lower(content_type), 'text/html'), false) THEN 'not_html' WHEN length(t) < 200 THEN 'too_short' ELSE 'kept' END AS outcome, regexp_replace(h1, '^www\\.', '') AS h FROM ft)"""


def _fetched(spark, d):
    return pages.fetched(bound(spark, d, "hits"), pages.denylist(["sec", ".ctgov", "sec.gov"]))


@query(f"{_FETCHED} SELECT page_id, outcome, CASE WHEN outcome = 'kept' THEN sha256(left(t, 20000)) END AS text_sha, CASE WHEN outcome = 'kept' THEN h END AS domain, CASE WHEN outcome = 'kept' THEN {_class_case()} END AS source_class FROM fo", "hits")
def fetch_pages(spark, d):
    return _fetched(spark, d).select("page_id", "outcome", F.sha2("text", 256).alias("text_sha"), "domain", "source_class")


@query(f"{_FETCHED}, a AS (SELECT count(*) AS n, count(*) FILTER (outcome = 'kept') AS survived FROM fo) SELECT n, survived, round(survived / n, 9) AS rate, CASE WHEN survived / n < 0.3 THEN 'STARVED' ELSE 'ok' END AS verdict FROM a", "hits")
def preflight(spark, d):
    return pages.survival(_fetched(spark, d)).withColumn("rate", F.round("rate", 9))


@query("f AS (SELECT shared AS url, step, rank, formulation_id, row_number() OVER (PARTITION BY shared ORDER BY step, rank, formulation_id) AS r FROM v_hits) SELECT url, step, rank, formulation_id FROM f WHERE r = 1", "hits")
def url_first_found(spark, d):
    return pages.first_found(bound(spark, d, "hits").select(F.col("shared").alias("url"), "step", "rank", "formulation_id"))


@query("f AS (SELECT page_id, formulation_id, row_number() OVER (PARTITION BY formulation_id ORDER BY rank, url) AS r FROM v_hits) SELECT page_id, formulation_id FROM f WHERE r <= 4", "hits")
def search_results(spark, d):
    r = bound(spark, d, "hits").withColumns({"title": F.lit(None).cast("string"), "snippet": F.lit(None).cast("string")})
    return pages.top_results(r, 4).select("page_id", "formulation_id")


@query(f"{_FETCHED}, j AS (SELECT page_id, url, page_id % 3 = 0 AS relevant, (page_id % 100) / 100.0E0 AS conf FROM v_hits) SELECT page_id, coalesce(relevant, false) AS kept, CASE WHEN NOT relevant THEN round(1 - conf, 9) END AS rejection_score FROM j", "hits")
def relevance_split(spark, d):
    j = bound(spark, d, "hits").select("page_id", (F.col("page_id") % 3 == 0).alias("relevant"), ((F.col("page_id") % 100) / 100.0).alias("conf"))
    kept, rejected = pages.split_relevant(j)
    return kept.select("page_id", F.lit(True).alias("kept"), F.lit(None).cast("double").alias("rejection_score")).unionByName(rejected.select("page_id", F.lit(False).alias("kept"), F.round("rejection_score", 9).alias("rejection_score")))


@query(f"x AS (SELECT page_id AS source_id, {_HOST} AS h FROM v_hits) SELECT source_id FROM x WHERE h = 'example.org' OR ends_with(h, '.example.org') OR h = 'sec.gov' OR ends_with(h, '.sec.gov')", "hits")
def contamination(spark, d):
    h = bound(spark, d, "hits").withColumnRenamed("page_id", "source_id")
    return pages.denied_sources(h.where("source_id % 3 = 0"), h.where("source_id % 3 <> 0"), pages.denylist(["sec", "example.org"])).select("source_id")


# Registry documents

_ACC = "lpad(CAST(c_custkey AS STRING), 10, '0') || '-{}'"
_FILED = f"""fl AS (SELECT lpad(CAST(c_custkey AS STRING), 10, '0') AS cik, c_name AS name, {_ACC.format("98-000001")} AS accession, 'D' AS form, '1998-01-05' AS filing_date, 'a.xml' AS document FROM customer
UNION ALL SELECT lpad(CAST(c_custkey AS STRING), 10, '0'), c_name, {_ACC.format("98-000002")}, 'D/A', '1998-02-0' || (1 + c_custkey % 9), 'b.xml' FROM customer
UNION ALL SELECT lpad(CAST(c_custkey AS STRING), 10, '0'), c_name, {_ACC.format("98-000003")}, '8-K', CASE WHEN c_custkey % 5 <> 0 THEN '1998-03-05' END, 'c.htm' FROM customer
UNION ALL SELECT lpad(CAST(c_custkey AS STRING), 10, '0'), c_name, {_ACC.format("90-000001")}, 'D', '1990-07-01', 'o.xml' FROM customer WHERE c_custkey % 3 = 0)"""


def _filed(spark, d):
    return registry.all_filings(bound(spark, d, "submissions"), bound(spark, d, "shards"))


@query(f"WITH {_FILED} SELECT cik, accession, form, filing_date, document FROM fl")
def registry_filings(spark, d):
    return _filed(spark, d).drop("name")


@query(f"""WITH {_FILED} SELECT 'https://www.sec.gov/Archives/edgar/data/' || ltrim(cik, '0') || '/' || replace(accession, '-', '') || '/' || document AS url, form || ' ' || accession AS title, 'Form ' || form AS doc_type,
'edgar:' || cik || ':' || regexp_replace(form, '/A$', '') AS chain, CAST(filing_date AS DATE) AS published FROM fl WHERE form IN ('D', 'D/A') AND filing_date >= '1998-01-01' AND ltrim(cik, '0') LIKE '%7%'""")
def registry_sources(spark, d):
    index = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("cik"), F.lit("x").alias("ticker"), F.col("c_custkey").cast("string").alias("name"))
    f = registry.wanted_filings(_filed(spark, d).join(registry.wanted_keys(index, name="7").select("cik"), "cik"), ["D", "D/A"], "1998")
    return registry.filing_sources(f).select("url", "title", "doc_type", "chain", "published")


@query(f"WITH {_FILED} SELECT cik, count(*) FILTER (form IN ('D', 'D/A')) AS n_formd, count(*) FILTER (form = 'D') AS n_original, min(filing_date) FILTER (form IN ('D', 'D/A')) AS first, max(filing_date) FILTER (form IN ('D', 'D/A')) AS last FROM fl GROUP BY cik")
def form_counts(spark, d):
    return registry.form_counts(_filed(spark, d))


_ACCESSION = "CASE WHEN o_orderkey % 8 = 4 THEN '' ELSE lpad(CAST(o_custkey AS STRING), 10, '0') || '-98-' || lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0') END"
_PARSED = f"""pf AS (SELECT o_orderkey AS source_id, {_ACCESSION} AS accession, CASE WHEN o_orderkey % 19 <> 0 THEN lpad(CAST(o_custkey AS STRING), 10, '0') END AS cik, 'Customer ' || o_custkey AS entity, o_orderkey % 5 = 0 AS is_amendment,
CASE WHEN o_orderkey % 10 = 0 THEN 'unknown' WHEN o_orderkey % 5 = 0 THEN '0000000001-98-000001' END AS previous, CASE WHEN o_orderkey % 3 = 1 THEN '1998-01-02' END AS first_sale, CASE WHEN o_orderkey % 17 > 1 THEN CAST(floor(o_totalprice) AS DOUBLE) END AS amount,
CASE WHEN o_orderkey % 6 <> 0 THEN 1000.0E0 END AS offered, o_orderkey % 6 = 0 AS indefinite,
array_to_string(list_filter([CASE WHEN o_orderkey % 19 = 0 THEN 'missing_cik' END, CASE WHEN o_orderkey % 10 = 0 THEN 'odd_previous_accession' END, CASE WHEN o_orderkey % 3 = 2 THEN 'missing_date_of_first_sale' END, CASE o_orderkey % 17 WHEN 0 THEN 'unreadable_amount_sold' WHEN 1 THEN 'indefinite_amount_sold' END], lambda x: x IS NOT NULL), ',') AS flags FROM orders)"""


@query(f"WITH {_PARSED} SELECT * FROM pf")
def form_filings(spark, d):
    return registry.parsed_forms(bound(spark, d, "forms")).withColumn("flags", F.array_join("flags", ","))


@query(f"WITH {_PARSED} SELECT source_id, 'amount' AS attribute, CAST(CAST(amount AS BIGINT) AS STRING) AS value FROM pf WHERE amount IS NOT NULL UNION ALL SELECT source_id, 'date', first_sale FROM pf WHERE first_sale IS NOT NULL UNION ALL SELECT source_id, 'registry_key', accession FROM pf WHERE accession <> ''")
def form_mentions(spark, d):
    return registry.form_mentions(registry.parsed_forms(bound(spark, d, "forms"))).select("source_id", "attribute", "value")


@query("""SELECT 'NCT' || lpad(CAST(s_suppkey AS STRING), 8, '0') AS key, CASE WHEN s_suppkey % 4 <> 0 THEN s_name ELSE 'Study of ' || s_name END AS title, CASE WHEN s_suppkey % 3 = 0 THEN '2020-05-05' WHEN s_suppkey % 2 = 0 THEN '2019-01-01' ELSE '2018-02' END AS published,
'Study of ' || s_name || chr(10) || 'About it' || chr(10) || 'one; two' AS text, 'ctgov:NCT' || lpad(CAST(s_suppkey AS STRING), 8, '0') AS chain FROM supplier""")
def study_sources(spark, d):
    return registry.flat_studies(bound(spark, d, "studies")).select("key", "title", "published", "text", "chain")


_FOUND = """bm AS (SELECT s_suppkey AS candidate, lpad(CAST(s_suppkey AS STRING), 10, '0') AS cik, s_name || ' One' AS registered FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, lpad('9' || s_suppkey, 10, '0'), s_name || ' Two' FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey, lpad(CAST(s_suppkey AS STRING), 10, '0'), s_name FROM supplier WHERE s_suppkey % 3 = 1 UNION ALL SELECT s_suppkey, lpad('77' || s_suppkey, 10, '0'), s_name || ' Html' FROM supplier WHERE s_suppkey % 3 = 2)"""


@query(f"WITH {_FOUND} SELECT * FROM bm")
def browse_matches(spark, d):
    return registry.browse_matches(bound(spark, d, "results"))


@query(f"""WITH {_FOUND}, pr AS (SELECT candidate, cik, registered FROM bm WHERE candidate % 3 <> 2)
SELECT s_suppkey AS candidate, CASE s_suppkey % 3 WHEN 0 THEN 'weak_match' WHEN 1 THEN 'ok' ELSE 'no_match' END AS verdict, CASE s_suppkey % 3 WHEN 0 THEN lpad(CAST(s_suppkey AS STRING), 10, '0') WHEN 1 THEN lpad(CAST(s_suppkey AS STRING), 10, '0') END AS cik,
CASE s_suppkey % 3 WHEN 0 THEN 0.75E0 WHEN 1 THEN 1.0E0 END AS score, CASE s_suppkey % 3 WHEN 0 THEN s_name || ' Two' ELSE '' END AS alternates FROM supplier""")
def screen_names(spark, d):
    """Suppliers looked up by their own names; every third has no result at all."""
    names = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("candidate"), F.concat(F.lit("The "), F.col("s_name"), F.lit(", Inc.")).alias("name"))
    found = registry.browse_matches(bound(spark, d, "results")).where("candidate % 3 <> 2")
    return screening.screened(names, found).select("candidate", "verdict", "cik", "score", F.array_join("alternates", ";").alias("alternates"))


# Readings

_A = V.AMOUNT_SPELLING
_VALID = f"""rd AS (SELECT *, lower(regexp_extract(value, '{_A}', 2)) AS u, TRY_CAST(replace(regexp_extract(value, '{_A}', 1), ',', '') AS DOUBLE) AS x, currency AS c FROM v_readings),
rm AS (SELECT *, attribute IN ('amount', 'post_money', 'valuation', 'raised') AS money, x * {_SCALE_CASE} * {_RATE} AS usd,
       CASE WHEN x IS NULL THEN 'amount_unparseable' WHEN {_SCALE_CASE} IS NULL THEN 'amount_unit_unknown' WHEN c IS NULL THEN 'currency_missing' WHEN {_RATE} IS NULL THEN 'fx_unknown_currency:' || c END AS bad FROM rd),
rv AS (SELECT *, money AND attribute = 'amount' AND starts_with(kind, 'funding_round') AS round_, CASE lower(stage) WHEN 'pre-seed' THEN usd BETWEEN 5e4 AND 3e6 WHEN 'seed' THEN usd BETWEEN 1e5 AND 1.5e7 WHEN 'series a' THEN usd BETWEEN 2e6 AND 8e7 WHEN 'series b' THEN usd BETWEEN 1e7 AND 3e8 WHEN 'series c' THEN usd BETWEEN 2e7 AND 8e8 ELSE true END AS fits FROM rm),
vv AS (SELECT *, CASE WHEN money AND bad IS NOT NULL THEN bad WHEN round_ AND regexp_matches(passage, '{V.CUMULATIVE_CUE}') THEN 'cumulative_not_round' WHEN round_ AND usd > cumulative * 1.001 THEN 'round_exceeds_cumulative' END AS reject FROM rv)"""


@query(f"""{_VALID} SELECT mention_id, reject, CASE WHEN money AND reject IS NULL THEN round(usd, 2) END AS value_num,
CASE WHEN reject IS NULL THEN array_to_string(list_filter([CASE WHEN money AND c <> 'USD' THEN 'fx:' || c || ',fx_static_rate' END, CASE WHEN round_ AND regexp_matches(passage, '{V.EXTENSION_CUE}') THEN 'series_extension' END, CASE WHEN round_ AND usd > 0.8 * post_money THEN 'amount_near_postmoney' END,
     CASE WHEN round_ AND NOT coalesce(fits, true) THEN 'magnitude_outlier' END, CASE WHEN attribute IN ('date', 'announced', 'closed', 'filed') AND date_role IS NULL THEN 'date_role_missing' END], lambda x: x IS NOT NULL), ',') END AS flags FROM vv""", "readings")
def validate_mentions(spark, d):
    m = bound(spark, d, "readings")
    col = lambda *names: {n: F.col(n) for n in names}
    v = m.select("mention_id", V.validated(col("attribute", "kind", "value", "currency", "passage", "date_role"), col("stage", "post_money", "cumulative")).alias("v"))
    return v.select("mention_id", "v.reject", F.round("v.value_num", 2).alias("value_num"), F.array_join("v.flags", ",").alias("flags"))


@query(f"{_VALID}, f AS (SELECT coalesce(reject, 'accepted') AS outcome FROM vv) SELECT regexp_replace(outcome, ':.*', '') AS outcome, count(*) AS n FROM f GROUP BY ALL", "readings")
def reject_mix(spark, d):
    v = validate_mentions(spark, d)
    return v.groupBy(F.regexp_replace(F.coalesce("reject", F.lit("accepted")), ":.*", "").alias("outcome")).agg(F.count("*").alias("n"))


_RAW = "CASE o_orderkey % 6 WHEN 0 THEN '$' || (o_orderkey % 90) || 'M raised' WHEN 1 THEN (o_orderkey % 50) || ' points' WHEN 2 THEN 'lost -' || (o_orderkey % 30) || '.5k' WHEN 3 THEN 'none' WHEN 4 THEN '1,' || (100 + o_orderkey % 900) ELSE 'in ' || (1950 + o_orderkey % 60) END"


@query(f"""WITH r AS (SELECT o_orderkey, {_RAW} AS s FROM orders), n AS (SELECT *, regexp_replace(lower(s), '[,$]', '', 'g') AS t FROM r),
m AS (SELECT *, TRY_CAST(regexp_extract(t, '-?\\d+(?:\\.\\d+)?', 0) AS DOUBLE) AS x, regexp_extract(t, '-?\\d+(?:\\.\\d+)?([kmb]?)', 1) AS u, TRY_CAST(regexp_extract(s, '-?\\d+(?:\\.\\d+)?', 0) AS DOUBLE) AS f, TRY_CAST(nullif(regexp_extract(s, '\\b((?:19|20)\\d{{2}})\\b', 1), '') AS INTEGER) AS year FROM n),
k AS (SELECT *, x * CASE u WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1 END AS v FROM m)
SELECT o_orderkey, f AS first_number, v AS scaled, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS STRING) ELSE CAST(v AS STRING) END AS key, coalesce(f, -1) AS or_default, year FROM k""")
def loose_numbers(spark, d):
    s = F.expr(_RAW)
    return _t(spark, d, "orders").select("o_orderkey", V.first_number(s).alias("first_number"), V.scaled_number(s).alias("scaled"), V.aggregate_key(s).alias("key"), V.first_number(s, F.lit(-1.0)).alias("or_default"), V.year_of(s).alias("year"))


_WHEN = "CASE o_orderkey % 5 WHEN 0 THEN '1998-03-0' || (1 + o_orderkey % 9) || 'T10:00' WHEN 1 THEN '199803' || (10 + o_orderkey % 20) WHEN 2 THEN '3/' || (1 + o_orderkey % 28) || '/1998' WHEN 3 THEN 'Mar ' || (1 + o_orderkey % 28) || ', 1998' ELSE 'soon' END"


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN make_date(1998, 3, CAST(1 + o_orderkey % 9 AS INTEGER)) WHEN 1 THEN make_date(1998, 3, CAST(10 + o_orderkey % 20 AS INTEGER)) WHEN 2 THEN make_date(1998, 3, CAST(1 + o_orderkey % 28 AS INTEGER)) WHEN 3 THEN make_date(1998, 3, CAST(1 + o_orderkey % 28 AS INTEGER)) END AS day FROM orders")
def loose_dates(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", V.instant(F.expr(_WHEN)).cast("date").alias("day"))


@query("""_x AS (SELECT 1) SELECT mention_id, coalesce(CASE WHEN mention_id % 4 = 0 THEN 'R' || mention_id END, CASE WHEN date_role IS NOT NULL THEN split_part(kind, '/', 1) || '|' || date_role END) AS truth_key, left(sha256(mention_id || '|' || attribute || '|' || value), 16) AS id,
left(sha1(least(kind, attribute) || '|' || greatest(kind, attribute)), 16) AS pair_id, coalesce(post_money, TRY_CAST(replace(replace(value, ',', ''), '$', '') AS DOUBLE)) AS usd FROM v_readings""", "readings")
def keys_and_ids(spark, d):
    m = bound(spark, d, "readings")
    key = V.truth_key(F.when(F.col("mention_id") % 4 == 0, F.concat(F.lit("R"), F.col("mention_id").cast("string"))), F.col("kind"), F.col("date_role"))
    return m.select("mention_id", key.alias("truth_key"), V.hashed_id(F.col("mention_id"), F.col("attribute"), F.col("value")).alias("id"), V.pair_id(F.col("kind"), F.col("attribute")).alias("pair_id"), V.dollars(F.col("value"), F.col("post_money")).alias("usd"))


@query("_x AS (SELECT 1) SELECT mention_id, btrim_ AS surface FROM (SELECT mention_id, trim(regexp_replace(lower(value), '[^a-z0-9 ]', '', 'g')) AS btrim_ FROM v_readings)", "readings")
def reader_surface(spark, d):
    return bound(spark, d, "readings").select("mention_id", V.match_surface(F.col("value")).alias("surface"))


# Stores: what is appended twice is there once, labels that were given stay, the latest version counts.


@query("_x AS (SELECT 1) SELECT o_orderkey AS pair_id, CASE WHEN o_orderkey % 3 = 0 THEN '1' ELSE '' END AS label FROM orders")
def pair_file(spark, d):
    o = _t(spark, d, "orders")
    old = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("pair_id"), F.lit("1").alias("label"))
    return store.with_new_pairs(old, o.select(F.col("o_orderkey").alias("pair_id")).unionAll(o.select("o_orderkey")))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 0")
def review_queue(spark, d):
    """Two appends of a queue that overlap, less what calibration holds already."""
    s = store.RunStore(spark, fresh(spark, "runs"), "r1")
    ids = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    s.append("calibration", ids.where("id % 4 = 0"))
    s.append_unseen("queue", ids.where("id % 2 = 0"), ["id"], "calibration")
    s.append_unseen("queue", ids, ["id"], "calibration")
    return s.table("queue")


@query("SELECT l_orderkey, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey")
def formulation_upsert(spark, d):
    """A formulation logged at several steps counts as it was last."""
    s = store.RunStore(spark, fresh(spark, "runs"), "r2")
    for k in (0, 1):
        s.append("formulations", _t(spark, d, "lineitem").where(F.col("l_linenumber") % 2 == k).select("l_orderkey", "l_linenumber"))
    return store.latest(s.table("formulations"), ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber")


@query("_x AS (SELECT 1) SELECT mention_id, stratum FROM v_mentions WHERE source_class <> 'blog'", "mentions")
def run_rehydrate(spark, d):
    s = store.RunStore(spark, fresh(spark, "runs"), "r3")
    s.append("mentions", bound(spark, d, "mentions").select("mention_id", "stratum", (F.col("source_class") != "blog").alias("accepted")))
    return s.mentions(accepted_only=True).select("mention_id", "stratum")


@query("SELECT conv_id, turn, length(text) % 3 <> 0 AS relevant, CASE WHEN length(text) % 3 <> 0 THEN 0.5E0 END AS confidence, length(text) % 3 = 0 AS bad FROM conversations")
def reader_payloads(spark, d):
    """Replies of a reader as it sends them: fields within prose, or prose alone."""
    c = _t(spark, d, "conversations")
    good = F.concat(F.lit('Here it is: {"relevant": true, "confidence": 0.5} as asked'))
    r = store.payloads(c.select(F.struct("conv_id", "turn").alias("id"), F.when(F.length("text") % 3 != 0, good).otherwise("I can not tell").alias("reply")), "relevance")
    return r.select("id.conv_id", "id.turn", F.coalesce("payload.relevant", F.lit(False)).alias("relevant"), "payload.confidence", "bad")


@query("f AS (SELECT * FROM v_filings) SELECT accession, row_number() OVER (PARTITION BY entity ORDER BY coalesce(strftime(first_sale, '%Y-%m-%d'), '9999'), accession) AS place FROM f", "filings")
def truth_rounds(spark, d):
    f = bound(spark, d, "filings").select("entity", F.col("accession").alias("root"), F.date_format("first_sale", "yyyy-MM-dd").alias("first_sale"))
    return store.truth_rounds(f).select(F.col("root").alias("accession"), "place")
