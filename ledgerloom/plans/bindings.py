"""Inputs of the catalogue's queries, made from the test tables.

The statements run unchanged in Spark and in DuckDB, so a query and its check
start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CLASS = "CASE {x} % 6 WHEN 0 THEN 'regulatory' WHEN 1 THEN 'vendor' WHEN 2 THEN 'news' WHEN 3 THEN 'investor' WHEN 4 THEN 'social' ELSE 'other' END"

BINDINGS: dict[str, str] = {
    # Three sources say an order's amount: a registry always, a news page often, a blog sometimes and 10 % too high.
    "mentions": """
SELECT concat(CAST(o.o_orderkey AS STRING), '/', s.k) AS mention_id, concat(s.k, '/', CAST(o.o_orderkey AS STRING)) AS source_id,
       c.c_name AS stratum, o.o_orderkey AS record, o.o_orderkey AS cell, 'amount' AS attribute, s.k AS source_class, s.k = 'regulatory' AS anchored,
       CASE WHEN s.k = 'blog' THEN floor(o.o_totalprice * 1.1) ELSE floor(o.o_totalprice) END AS amount,
       CAST(year(o.o_orderdate) * 12 + month(o.o_orderdate) AS BIGINT) AS step
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN (VALUES ('regulatory'), ('news'), ('blog')) AS s(k)
  ON s.k = 'regulatory' OR (s.k = 'news' AND o.o_orderkey % 3 <> 0) OR (s.k = 'blog' AND o.o_orderkey % 5 = 0)
WHERE o.o_orderkey % 10 <> 0""",
    # Two or three sources state each customer's number of orders and their sum.
    "claims": """
SELECT concat(t.functional, '/', CAST(t.c_custkey AS STRING), '/', CAST(s.k AS STRING)) AS claim_id, concat('s', CAST((t.c_custkey + s.k) % 50 AS STRING)) AS source_id,
       t.c_name AS stratum, t.functional, CASE WHEN s.k = 2 THEN t.v + 1 ELSE t.v END AS value_num, CAST(0 AS DOUBLE) AS tolerance,
       CASE WHEN (t.c_custkey + s.k) % 13 = 0 THEN 'equity and debt' WHEN (t.c_custkey + s.k) % 7 = 0 THEN 'grants' WHEN t.c_custkey % 2 = 0 THEN 'equity round' ELSE '' END AS scope,
       'as reported' AS passage, CASE WHEN s.k = 0 THEN 'a' ELSE NULL END AS chain, t.last AS t_asof
FROM (SELECT c.c_custkey, c.c_name, f.functional, max(o.o_orderdate) AS last,
             CASE WHEN f.functional = 'COUNT' THEN CAST(count(*) - CASE WHEN c.c_custkey % 11 = 0 THEN 1 ELSE 0 END AS DOUBLE) ELSE sum(floor(o.o_totalprice)) END AS v
      FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN (VALUES ('COUNT'), ('SUM')) AS f(functional) ON TRUE
      GROUP BY c.c_custkey, c.c_name, f.functional) t
JOIN (VALUES (0), (1), (2)) AS s(k) ON s.k < 2 OR t.c_custkey % 4 = 0""",
    # As claims, but sums differ a little from source to source, and some strata have sums alone.
    "statements": """
SELECT concat(t.functional, '/', CAST(t.c_custkey AS STRING), '/', CAST(s.k AS STRING)) AS claim_id, concat('s', CAST((t.c_custkey + s.k * 7) % 50 AS STRING)) AS source_id,
       t.c_name AS stratum, t.functional, CASE WHEN t.functional = 'COUNT' THEN t.v + CASE WHEN s.k = 2 THEN 1 ELSE 0 END ELSE t.v * (1 + s.k * 0.004E0) END AS value_num,
       CASE WHEN t.functional = 'SUM' AND t.c_custkey % 4 = 1 THEN 1000.0E0 ELSE 0.0E0 END AS tolerance,
       CASE WHEN t.functional = 'COUNT' AND t.c_custkey % 3 = 0 THEN 'grants' WHEN (t.c_custkey + s.k) % 13 = 0 THEN 'equity and debt' ELSE 'equity round' END AS scope,
       'as reported' AS passage, CAST(NULL AS STRING) AS chain, t.last AS t_asof
FROM (SELECT c.c_custkey, c.c_name, f.functional, max(o.o_orderdate) AS last,
             CASE WHEN f.functional = 'COUNT' THEN CAST(count(*) - CASE WHEN c.c_custkey % 11 = 0 THEN 1 ELSE 0 END AS DOUBLE) ELSE CAST(sum(floor(o.o_totalprice)) AS DOUBLE) END AS v
      FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN (VALUES ('COUNT'), ('SUM')) AS f(functional) ON TRUE
      GROUP BY c.c_custkey, c.c_name, f.functional) t
JOIN (VALUES (0), (1), (2), (3)) AS s(k) ON s.k < 2 OR t.c_custkey % 4 = s.k % 4""",
    # Twenty documents speak of one cell; some cite the one before, some have no date.
    "witnesses": f"""
SELECT CAST(floor(doc_id / 20) AS BIGINT) AS cell, CAST(floor(doc_id / 2) AS BIGINT) % 3 AS value, doc_id AS source_id, doc_id AS mention_id,
       concat('https://', source, '.example/', CAST(doc_id AS STRING)) AS url, concat(source, '.example') AS domain, coalesce(CASE WHEN doc_id % 9 <> 0 THEN CAST(doc_id AS BIGINT) END, CASE WHEN doc_id % 27 <> 0 THEN CAST(doc_id AS BIGINT) END) AS ts,
       {_CLASS.format(x="doc_id")} AS source_class, doc_id % 6 = 0 AS anchored, CASE WHEN doc_id % 4 = 0 THEN concat('c', CAST(doc_id % 40 AS STRING)) END AS chain,
       CASE WHEN doc_id % 8 = 0 THEN 'Form D/A' ELSE 'Form D' END AS doc_type,
       CASE WHEN doc_id % 110 = 0 THEN concat('corrected: ', text) WHEN doc_id % 5 < 2 THEN concat(text, ' see https://src', CAST((doc_id - 1) % 20 AS STRING), '.example/', CAST(doc_id - 1 AS STRING), ' for more') WHEN doc_id % 11 = 0 THEN concat(text, ' as src', CAST(doc_id % 20 AS STRING), '.example has it') ELSE text END AS text
FROM documents""",
    # Suppliers state a coarse quantity for each part.
    "cells": f"""
SELECT concat(CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING), '/', CAST(l_suppkey AS STRING), '/', CAST(l_partkey AS STRING)) AS mention_id,
       CAST(l_partkey AS BIGINT) AS cell, CAST(floor(l_quantity / 10) AS BIGINT) AS value, CAST(l_suppkey AS STRING) AS source_id,
       {_CLASS.format(x="l_suppkey")} AS source_class, l_suppkey % 6 = 0 AS anchored,
       concat(CAST(l_partkey AS STRING), '/', CAST(l_suppkey AS STRING)) AS chain, l_shipdate AS ts, CASE WHEN l_linenumber > 3 THEN 'Form X/A' ELSE 'Form X' END AS doc_type
FROM lineitem""",
    # A record is a user's bucket of ten; a search is a day.
    "covered": """
SELECT DISTINCT event_type AS stratum, concat(CAST(user_id AS STRING), ':', CAST(CAST(floor(event_id % 97 / 10) AS BIGINT) AS STRING)) AS record_key,
       CAST(datediff('day', TIMESTAMP '2024-01-01 00:00:00', ts) AS BIGINT) + 1 AS step, CAST(datediff('day', TIMESTAMP '2024-01-01 00:00:00', ts) AS STRING) AS formulation_id
FROM events""",
    "formulations": """
SELECT CAST(p_partkey AS STRING) AS formulation_id, concat(p_name, ' ', p_brand) AS query, (p_partkey % 10) / 10.0E0 AS p_success, CAST(p_size AS DOUBLE) / 10 AS yield_if_success,
       0.02E0 AS cost, CASE p_partkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'error' WHEN 3 THEN 'purchase' ELSE NULL END AS stratum,
       p_partkey % 17 = 0 AS gap_directed, p_partkey % 3 = 0 AS issued, CAST(p_partkey % 4 AS BIGINT) AS realized_yield, (p_partkey % 10) / 10.0E0 AS p0
FROM part""",
    "names": """
SELECT p_partkey AS mention_id, concat(p_name, ' ', replace(p_brand, '#', ' '), CASE p_partkey % 5 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' LLC' WHEN 2 THEN ' Corporation' WHEN 3 THEN '' ELSE ' GmbH' END) AS surface,
       concat('https://www.', replace(p_name, ' ', '-'), CASE p_partkey % 6 WHEN 0 THEN '.sec.gov' WHEN 1 THEN 'ventures.com' WHEN 2 THEN '.reuters.com' WHEN 3 THEN '.crunchbase.com' WHEN 4 THEN '-sec.gov.example.com' ELSE '.org' END, '/', CAST(p_partkey AS STRING)) AS url,
       p_partkey % 7 AS entity
FROM part""",
    # Documents as sources; every seventh cites the one before it.
    "sources": f"""
SELECT doc_id AS source_id, concat('https://', source, '.example/', CAST(doc_id AS STRING)) AS url, concat(source, '.example') AS domain, CAST(doc_id AS BIGINT) AS ts,
       {_CLASS.format(x="doc_id")} AS source_class, doc_id % 6 = 0 AS anchored, CASE WHEN doc_id % 4 = 0 THEN concat('c', CAST(doc_id % 40 AS STRING)) END AS chain,
       CASE WHEN doc_id % 8 = 0 THEN 'Form D/A' ELSE 'Form D' END AS doc_type,
       CASE WHEN doc_id % 7 = 0 THEN concat(text, ' see https://', (CASE WHEN doc_id > 0 THEN concat('src', CAST((doc_id - 1) % 20 AS STRING)) ELSE 'none' END), '.example/', CAST(doc_id - 1 AS STRING), CASE WHEN doc_id % 21 = 0 THEN ' corrected' ELSE '' END)
            ELSE text END AS text
FROM documents""",
    # Registry documents as text: an index of three filings a customer, an older page for every third, filings in XML, studies, result pages.
    "submissions": """
SELECT lpad(CAST(c_custkey AS STRING), 10, '0') AS cik, concat('{"cik": "', CAST(c_custkey AS STRING), '", "name": "', c_name, '", "filings": {"recent": {"accessionNumber": ["',
       lpad(CAST(c_custkey AS STRING), 10, '0'), '-98-000001", "', lpad(CAST(c_custkey AS STRING), 10, '0'), '-98-000002", "', lpad(CAST(c_custkey AS STRING), 10, '0'), '-98-000003"], "form": ["D", "D/A", "8-K"], "filingDate": ["1998-01-05", "1998-02-0',
       CAST(1 + c_custkey % 9 AS STRING), '"', CASE WHEN c_custkey % 5 <> 0 THEN ', "1998-03-05"' ELSE '' END, '], "primaryDocument": ["a.xml", "b.xml", "c.htm"]}}}') AS doc
FROM customer""",
    "shards": """
SELECT lpad(CAST(c_custkey AS STRING), 10, '0') AS cik, concat('{"accessionNumber": ["', lpad(CAST(c_custkey AS STRING), 10, '0'), '-90-000001"], "form": ["D"], "filingDate": ["1990-07-01"], "primaryDocument": ["o.xml"]}') AS doc
FROM customer WHERE c_custkey % 3 = 0""",
    "forms": """
SELECT o_orderkey AS source_id, CASE WHEN o_orderkey % 4 = 0 THEN 'Form D' ELSE concat('D ', lpad(CAST(o_custkey AS STRING), 10, '0'), '-98-', lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0')) END AS title,
       concat('https://www.sec.gov/Archives/', CASE WHEN o_orderkey % 8 = 4 THEN 'x' ELSE concat(lpad(CAST(o_custkey AS STRING), 10, '0'), '98', lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0')) END, '/a.xml') AS url,
       concat('<edgarSubmission><primaryIssuer>', CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE concat('<cik>', CAST(o_custkey AS STRING), '</cik>') END, '<entityName>Customer ', CAST(o_custkey AS STRING), '</entityName></primaryIssuer><offeringData><typeOfFiling><newOrAmendment><isAmendment>',
              CASE WHEN o_orderkey % 5 = 0 THEN 'true' ELSE 'false' END, '</isAmendment>', CASE WHEN o_orderkey % 5 = 0 THEN concat('<previousAccessionNumber>', CASE WHEN o_orderkey % 10 = 0 THEN 'unknown' ELSE '0000000001-98-000001' END, '</previousAccessionNumber>') ELSE '' END,
              '</newOrAmendment><dateOfFirstSale>', CASE o_orderkey % 3 WHEN 0 THEN '<yetToOccur>true</yetToOccur>' WHEN 1 THEN '<value>1998-01-02</value>' ELSE '' END, '</dateOfFirstSale></typeOfFiling><offeringSalesAmounts><totalOfferingAmount>',
              CASE WHEN o_orderkey % 6 = 0 THEN 'Indefinite' ELSE '1,000' END, '</totalOfferingAmount><totalAmountSold>', CASE o_orderkey % 17 WHEN 0 THEN 'n/a' WHEN 1 THEN 'Indefinite' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END, '</totalAmountSold></offeringSalesAmounts></offeringData></edgarSubmission>') AS doc
FROM orders""",
    "studies": """
SELECT s_suppkey, concat('{"protocolSection": {"identificationModule": {"nctId": "NCT', lpad(CAST(s_suppkey AS STRING), 8, '0'), '"', CASE WHEN s_suppkey % 4 <> 0 THEN concat(', "briefTitle": "', s_name, '"') ELSE '' END, ', "officialTitle": "Study of ', s_name, '"}, "statusModule": {',
       CASE WHEN s_suppkey % 3 = 0 THEN '"lastUpdatePostDateStruct": {"date": "2020-05-05"}, ' ELSE '' END, CASE WHEN s_suppkey % 2 = 0 THEN '"studyFirstPostDateStruct": {"date": "2019-01-01"}, ' ELSE '' END, '"startDateStruct": {"date": "2018-02"}}, "descriptionModule": {"briefSummary": "About it"}, "conditionsModule": {"conditions": ["one", "two"]}}}') AS doc
FROM supplier""",
    "results": """
SELECT s_suppkey AS candidate, CASE s_suppkey % 3 WHEN 0 THEN concat('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>', s_name, ' One</title><link href="/b?CIK=', CAST(s_suppkey AS STRING), '&amp;x=1"/></entry><entry><link href="/b?x=2"/></entry><entry><title>', s_name, ' Two</title><link href="/b?CIK=9', CAST(s_suppkey AS STRING), '"/></entry></feed>')
         WHEN 1 THEN concat('<feed xmlns="http://www.w3.org/2005/Atom"><company-info><cik>', CAST(s_suppkey AS STRING), '</cik><conformed-name> ', s_name, ' </conformed-name></company-info></feed>') ELSE '<feed xmlns="http://www.w3.org/2005/Atom"/>' END AS atom,
       concat('<table><tr><td><a href="/b?CIK=77', CAST(s_suppkey AS STRING), '&amp;y">77</a></td><td scope="row"> ', s_name, ' Html </td></tr></table>') AS html
FROM supplier""",
    # What readers wrote down of orders, to be validated.
    "readings": """
SELECT o_orderkey AS mention_id, CASE o_orderkey % 5 WHEN 0 THEN 'date' WHEN 1 THEN 'raised' WHEN 2 THEN 'note' ELSE 'amount' END AS attribute, CASE WHEN o_orderkey % 2 = 0 THEN 'funding_round/series_a' ELSE 'acquisition' END AS kind,
       CASE o_orderkey % 6 WHEN 0 THEN concat('$', CAST(CAST(floor(o_totalprice / 100) AS BIGINT) AS STRING), 'K') WHEN 1 THEN 'undisclosed' WHEN 2 THEN '12 moons' ELSE concat(CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), 'M') END AS value,
       CASE o_orderkey % 7 WHEN 0 THEN 'EUR' WHEN 1 THEN NULL WHEN 2 THEN 'XXX' ELSE 'USD' END AS currency,
       CASE WHEN o_orderkey % 11 = 0 THEN 'it has raised this to date' WHEN o_orderkey % 13 = 0 THEN 'an extension of the round' ELSE o_orderpriority END AS passage, CASE WHEN o_orderkey % 3 = 0 THEN 'closed' END AS date_role,
       CASE o_orderkey % 4 WHEN 0 THEN 'Seed' WHEN 1 THEN 'series c' WHEN 2 THEN 'growth' END AS stage, CASE WHEN o_orderkey % 8 = 3 THEN 1.0E8 WHEN o_orderkey % 8 = 4 THEN 1.0E13 END AS post_money, CASE WHEN o_orderkey % 9 = 4 THEN 1.0E7 END AS cumulative
FROM orders""",
    # Pages as a fetcher got them.
    "hits": """
SELECT page_id, url, CASE WHEN page_id % 23 = 0 THEN 'https://data.sec.gov/moved' END AS landed, CASE WHEN page_id % 9 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN page_id % 7 = 0 THEN 'application/pdf' WHEN page_id % 31 = 0 THEN NULL ELSE 'text/html; charset=utf-8' END AS content_type, html,
       CAST(floor(page_id / 10) AS BIGINT) AS step, CAST(page_id % 10 AS INT) AS rank, concat('f', CAST(floor(page_id / 10) AS BIGINT)) AS formulation_id, concat('u', CAST(page_id % 137 AS STRING)) AS shared
FROM pages""",
    # Amounts that the web tells of filings: as filed, a little off, far off, or no number.
    "told": """
SELECT o_orderkey AS mention_id, o_custkey AS entity, CASE o_orderkey % 5 WHEN 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) WHEN 1 THEN CAST(CAST(floor(o_totalprice * 1.01) AS BIGINT) AS STRING) WHEN 2 THEN CAST(CAST(floor(o_totalprice * 1.3) AS BIGINT) AS STRING) WHEN 3 THEN 'undisclosed' ELSE CAST(CAST(floor(o_totalprice / 2) AS BIGINT) AS STRING) END AS value,
       CAST(floor(o_totalprice) AS DOUBLE) AS filed, o_orderkey % 3 <> 0 AS is_filed
FROM orders""",
    # Two mentions of most orders, a day or some per cent apart.
    "sightings": """
SELECT concat(CAST(o.o_orderkey AS STRING), '/', CAST(s.k AS STRING)) AS mention_id, o.o_custkey % 200 AS entity, CAST(o.o_orderdate AS DATE) + CASE WHEN s.k = 1 AND o.o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS date,
       CAST(floor(o.o_totalprice) AS DOUBLE) * (1 + s.k * (o.o_orderkey % 5) / 20.0E0) AS number
FROM orders o JOIN (VALUES (0), (1)) AS s(k) ON s.k = 0 OR o.o_orderkey % 7 <> 0""",
    "reader_a": "SELECT concat(CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING), '/', CAST(l_suppkey AS STRING)) AS id, l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) AS value, 1 - l_discount AS conf FROM lineitem",
    "reader_b": "SELECT concat(CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING), '/', CAST(l_suppkey AS STRING), '/', CAST(d.k AS STRING)) AS id, l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) + CASE WHEN l_linenumber % 4 = 0 THEN 1 ELSE 0 END AS value, 1 - l_tax AS conf FROM lineitem JOIN (VALUES (0), (1)) AS d(k) ON d.k = 0 OR l_linenumber % 6 = 0 WHERE l_linenumber % 5 <> 0",
    "scores": "SELECT d.doc_id AS id, CASE WHEN l.quality = 1 THEN (d.n_chars % 100) / 100.0E0 ELSE 1 + (d.n_chars % 10) / 10.0E0 END AS score, (d.n_chars % 97) / 97.0E0 AS conf FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
    # An order's predecessor is the customer's order before it, every fourth order starting a new chain.
    "filings": """
SELECT o_orderkey AS accession, CASE WHEN o_orderkey % 4 <> 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS previous,
       o_custkey AS entity, o_orderdate AS filing_date, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS first_sale, floor(o_totalprice) AS amount
FROM orders""",
    "graded": """
SELECT o_custkey AS entity, o_orderkey AS record, CASE WHEN o_orderkey % 9 = 0 THEN floor(o_totalprice * 1.05) ELSE floor(o_totalprice) END AS amount,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE floor(o_totalprice) END AS true_amount, sum(floor(o_totalprice)) OVER (PARTITION BY o_custkey) AS true_sum
FROM orders""",
}


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding over the tables of a folder, without registering any view."""
    sql, frames = BINDINGS[name].replace("{", "{{").replace("}", "}}"), {}
    import re

    for t in ("orders", "customer", "lineitem", "events", "part", "supplier", "documents", "labels", "embeddings", "pages", "benchmark", "conversations"):
        if re.search(rf"\b(FROM|JOIN) {t}\b", sql):
            frames[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            sql = re.sub(rf"\b(FROM|JOIN) {t}\b( [a-z]\b)?", lambda m, t=t: f"{m[1]} {{{t}}}{m[2] or ''}", sql)
    sql = sql.replace("datediff('day', TIMESTAMP '2024-01-01 00:00:00', ts)", "datediff(ts, TIMESTAMP '2024-01-01 00:00:00')")
    return spark.sql(sql, **frames)


def ctes(*names: str) -> str:
    return ",\n".join(f"v_{n} AS ({BINDINGS[n]})" for n in names)
