"""Queries that assemble answers: live evidence, resolution, evaluation, harvest of labels, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import values as V
from ledgerloom.operators import claims as C, corroborate as B, fragments, frontier as N, gate, harvest, matching as M, provenance as P, records, report as R, resolve as E, truth as T
from ledgerloom.plans.bindings import bound
from ledgerloom.plans.catalogue import _BELIEF, _CASES, _FIX, _FREQ, _LOSS, _PRIOR, _RNAME, _SEEN, _SUMS, _THAT, _TOK, _amounts, _beliefs, _losses, _seen, _statements, _t, query  # noqa: F401

# Live evidence

_COPIES = f"""wt AS (SELECT DISTINCT cell, source_id AS id, url, domain, text, ts, chain FROM v_witnesses), wk AS (SELECT cell, id, {_TOK} AS w FROM wt),
s5 AS (SELECT cell, id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) ELSE [] END AS s FROM wk),
e5 AS (SELECT cell, id, len(s) AS n, unnest(s) AS g FROM s5),
g25 AS (SELECT DISTINCT cell, id, array_to_string(w[i:i + 24], ' ') AS g FROM (SELECT cell, id, w, unnest(range(1, len(w) - 23)) AS i FROM wk WHERE len(w) >= 25)),
alike AS (SELECT a.cell, a.id AS a, b.id AS b FROM e5 a JOIN e5 b ON a.cell = b.cell AND a.g = b.g AND a.id < b.id GROUP BY a.cell, a.id, b.id HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.85
          UNION SELECT a.cell, a.id, b.id FROM g25 a JOIN g25 b ON a.cell = b.cell AND a.g = b.g AND a.id < b.id),
dirs AS (SELECT cell, a, b FROM alike UNION SELECT cell, b, a FROM alike UNION SELECT a.cell, a.id, b.id FROM wt a JOIN wt b ON a.cell = b.cell AND a.id <> b.id AND (contains(b.text, a.url) OR contains(b.text, a.domain))),
okd AS (SELECT d.cell, a, b FROM dirs d JOIN wt x ON x.cell = d.cell AND x.id = a JOIN wt y ON y.cell = d.cell AND y.id = b WHERE NOT coalesce(y.ts <= x.ts, false) AND NOT coalesce(x.chain = y.chain, false)),
ed AS (SELECT cell, min(a) AS src, CASE WHEN min(a) = least(a, b) THEN greatest(a, b) ELSE least(a, b) END AS dst FROM okd GROUP BY cell, least(a, b), greatest(a, b))"""


def _witnesses(spark, d):
    return B.with_reliability(bound(spark, d, "witnesses"))


@query(f"{_COPIES} SELECT cell, src, dst FROM ed", "witnesses")
def derivation_full(spark, d):
    return P.derivation_full(bound(spark, d, "witnesses"))


_STALE = f"""{_COPIES}, v AS (SELECT *, CASE WHEN anchored THEN {_PRIOR} ELSE least({_PRIOR}, 0.3E0) END AS q FROM v_witnesses),
lagged AS (SELECT *, lag(source_id) OVER (PARTITION BY chain ORDER BY ts NULLS FIRST, source_id) AS old_id FROM v WHERE chain IS NOT NULL),
dead AS (SELECT old_id AS id FROM lagged WHERE old_id IS NOT NULL AND regexp_matches(doc_type, '(?i)(/A\\b|amend|updated)') AND q >= 0.5
         UNION SELECT a.source_id FROM v a JOIN v b ON a.domain = b.domain AND b.ts > a.ts WHERE {_FIX.replace("text", "b.text")} AND b.q >= 0.5),
walk(cell, id) AS (SELECT cell, id FROM wt JOIN dead USING (id) UNION SELECT ed.cell, ed.dst FROM walk JOIN ed ON ed.cell = walk.cell AND ed.src = walk.id),
stale AS (SELECT w.cell, w.id FROM walk w JOIN wt ON wt.cell = w.cell AND wt.id = w.id WHERE wt.chain IS NULL OR w.id IN (SELECT id FROM dead))"""


def _stale(spark, d, edges):
    w = _witnesses(spark, d)
    dead = P.dead_sources(P.superseded_in_chain(w).unionByName(P.superseded_by_correction(w)), w)
    return P.stale_sources(edges, dead, w)


@query(f"{_STALE} SELECT DISTINCT cell, id AS source_id FROM stale", "witnesses")
def stale_sources(spark, d):
    return _stale(spark, d, derivation_full(spark, d))


_LIVE = f"""{_STALE}, mm AS (SELECT v.*, s.id IS NOT NULL AS dead, count(*) FILTER (s.id IS NOT NULL) OVER (PARTITION BY v.cell) AS n_dead, bool_and(s.id IS NOT NULL) OVER (PARTITION BY v.cell) AS every FROM v LEFT JOIN (SELECT DISTINCT * FROM stale) s ON s.cell = v.cell AND s.id = v.source_id),
al AS (SELECT cell, value, source_id, mention_id, q, anchored, CASE WHEN every THEN 0 ELSE n_dead END AS n_dead FROM mm WHERE NOT dead OR every),
el AS (SELECT x.cell, x.value, src, dst FROM ed JOIN al x ON x.cell = ed.cell AND x.source_id = src JOIN al y ON y.cell = ed.cell AND y.source_id = dst AND y.value = x.value),
ll AS (SELECT cell, value, src AS a, dst AS b FROM el UNION SELECT cell, value, dst, src FROM el),
rr(cell, value, a, b) AS (SELECT cell, value, source_id, source_id FROM al UNION SELECT rr.cell, rr.value, rr.a, ll.b FROM rr JOIN ll ON ll.cell = rr.cell AND ll.value = rr.value AND ll.a = rr.b),
cp AS (SELECT cell, value, a, min(b) AS root FROM rr GROUP BY cell, value, a),
og AS (SELECT al.cell, al.value, n_dead, root, CASE WHEN bool_or(anchored) THEN max(q) ELSE least(max(q), 0.3E0) END AS q, count(DISTINCT source_id) AS size, count(*) AS said, min(mention_id) AS first_id FROM al JOIN cp ON cp.cell = al.cell AND cp.value = al.value AND cp.a = al.source_id GROUP BY al.cell, al.value, n_dead, root),
bl AS (SELECT cell, value, n_dead, 1 - product(1 - q) AS belief, count(*) AS nu, array_to_string(list_sort(list(size)), ',') AS sizes, CAST(sum(said) AS BIGINT) AS supporting, min(first_id) AS first_id FROM og GROUP BY cell, value, n_dead)"""


def _live(spark, d):
    edges = derivation_full(spark, d)
    return B.live_beliefs(_witnesses(spark, d), edges, _stale(spark, d, edges))


@query(f"{_LIVE} SELECT cell, value, round(belief, 9) AS belief, nu, sizes, supporting, n_dead FROM bl", "witnesses")
def live_beliefs(spark, d):
    return _live(spark, d).select("cell", "value", F.round("belief", 9).alias("belief"), "nu", F.array_join("sizes", ",").alias("sizes"), "supporting", "n_dead")


@query(f"""{_LIVE}, kk AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY round(belief, 9) DESC, first_id, value) AS r FROM bl),
ad AS (SELECT cell, max(n_dead) AS n_dead, max(CASE WHEN r = 1 THEN value END) AS value, max(CASE WHEN r = 1 THEN belief END) AS belief, coalesce(max(CASE WHEN r = 2 THEN belief END), 0) AS b2,
       array_to_string(list(CAST(value AS STRING) ORDER BY r) FILTER (r > 1), ',') AS competing FROM kk GROUP BY cell),
ver AS (SELECT source_id, row_number() OVER (PARTITION BY chain ORDER BY ts NULLS FIRST, source_id) - 1 AS version FROM v_witnesses WHERE chain IS NOT NULL)
SELECT ad.cell, ad.value, round(belief, 9) AS belief, coalesce(competing, '') AS competing, n_dead, CASE WHEN round(belief, 9) >= 1 THEN 1000000 ELSE CAST(greatest(0, ceil(ln((1 - round(belief, 9)) / greatest(1 - round(b2, 9), 1e-12)) / ln(0.7)) - 1) AS BIGINT) END AS kappa,
       (SELECT max(version) FROM ver JOIN v_witnesses x USING (source_id) WHERE x.cell = ad.cell AND x.value = ad.value) AS version FROM ad""", "witnesses")
def live_adopted(spark, d):
    """The adopted value with everything that is kept beside it: live rivals, what did not count, margin and version."""
    b, w = _live(spark, d), bound(spark, d, "witnesses")
    a = B.adopted(b).select("cell", "value", F.round("belief", 9).alias("belief"), "kappa")
    rank = F.struct(-F.round("belief", 9), "first_id", "value")
    rivals = b.join(a.select("cell", F.col("value").alias("best")), "cell").groupBy("cell").agg(F.max("n_dead").alias("n_dead"), F.array_sort(F.collect_list(F.when(F.col("value") != F.col("best"), F.struct(rank.alias("k"), F.col("value").alias("v"))))).alias("r"))
    v = w.join(P.versions(w), "source_id").groupBy("cell", "value").agg(F.max("version").alias("version"))
    out = a.join(rivals, "cell").join(v, ["cell", "value"], "left")
    return out.select("cell", "value", "belief", F.array_join(F.transform("r", lambda x: x["v"].cast("string")), ",").alias("competing"), "n_dead", "kappa", "version")


# Labels for the gate

_LEGIT = "lg AS (SELECT DISTINCT entity, filed AS amount FROM v_told WHERE is_filed)"
_LABELS = f"""{_LEGIT}, tm AS (SELECT mention_id, entity, value, TRY_CAST(value AS DOUBLE) AS x FROM v_told WHERE entity IN (SELECT entity FROM lg)),
nr AS (SELECT mention_id, amount AS near, row_number() OVER (PARTITION BY mention_id ORDER BY abs(x - amount), amount) AS r FROM tm JOIN lg USING (entity) WHERE x IS NOT NULL),
lb AS (SELECT tm.mention_id, value, x, near, (SELECT min(amount) FROM lg WHERE lg.entity = tm.entity) AS least, x = near AS same, abs(x - near) / near AS off FROM tm LEFT JOIN nr ON nr.mention_id = tm.mention_id AND r = 1),
lc AS (SELECT *, CASE WHEN same THEN 'registry_exact' WHEN off <= 0.02 THEN 'registry_tol' ELSE 'review' END AS label FROM lb),
ld AS (SELECT mention_id, value, label, CASE WHEN label = 'registry_tol' THEN value ELSE CAST(CAST(coalesce(near, least) AS BIGINT) AS STRING) END AS true_value, off FROM lc)"""


def _told(spark, d):
    t = bound(spark, d, "told")
    legit = harvest.legitimate(t.where("is_filed").select("entity", F.col("filed").alias("amount")))
    return t, legit, harvest.labelled(t.withColumn("value_num", F.lit(None).cast("double")), legit)


@query(f"{_LEGIT} SELECT entity, count(*) AS n, round(sum(amount), 2) AS total FROM lg GROUP BY entity", "told")
def legit_amounts(spark, d):
    return _told(spark, d)[1].groupBy("entity").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


@query(f"{_LABELS} SELECT mention_id, label, true_value, round(off, 9) AS distance FROM ld", "told")
def label_mentions(spark, d):
    return _told(spark, d)[2].withColumn("distance", F.round("distance", 9))


@query(f"{_LABELS} SELECT label, count(*) AS n FROM ld GROUP BY label", "told")
def harvest_mix(spark, d):
    return _told(spark, d)[2].groupBy("label").agg(F.count("*").alias("n"))


@query(f"{_LABELS} SELECT mention_id, value AS pred, CASE WHEN mention_id % 2 = 0 THEN value ELSE true_value END AS true_value FROM ld WHERE label = 'review' AND mention_id % 7 <> 0", "told")
def human_labels(spark, d):
    t, _, found = _told(spark, d)
    queue = found.where("label = 'review'").join(t.select("mention_id", "value"), "mention_id")
    verdicts = t.select("mention_id", F.when(F.col("mention_id") % 7 != 0, F.col("mention_id") % 2 == 0).alias("faithful"))
    return harvest.human_labels(queue, verdicts)


@query(f"{_LABELS} SELECT mention_id, round(CASE WHEN value = true_value THEN 1 - 0.75 WHEN TRY_CAST(value AS DOUBLE) IS NOT NULL THEN least(1 + abs(CAST(value AS DOUBLE) - CAST(true_value AS DOUBLE)) / CAST(true_value AS DOUBLE), 2) ELSE 2 END, 9) AS score FROM ld", "told")
def calibration_scores(spark, d):
    t, _, found = _told(spark, d)
    return found.join(t.select("mention_id", "value"), "mention_id").select("mention_id", F.round(gate.nonconformity(F.col("value"), F.col("true_value"), F.lit(0.75)), 9).alias("score"))


@query(f"{_THAT} SELECT (SELECT n FROM t) AS n, round((SELECT t_hat FROM t), 9) AS t_hat, round(1 - (SELECT t_hat FROM t), 9) AS least_conf, (SELECT count(*) FROM v_scores WHERE score >= 1) AS wrong", "scores")
def gate_preview(spark, d):
    s = bound(spark, d, "scores")
    return gate.preview(s, gate.threshold(s)).select("n", F.round("t_hat", 9).alias("t_hat"), F.round("least_conf", 9).alias("least_conf"), "wrong")


@query("_x AS (SELECT 1) SELECT mention_id, contains('widgets' || surface, 'gadget') AS ok FROM (SELECT mention_id, '' AS surface FROM v_names) x WHERE false UNION ALL SELECT mention_id, contains(k, 'almond') OR contains('brand 12 trading', k) FROM (SELECT mention_id, array_to_string(list_filter(regexp_extract_all(lower(surface), '[\\p{L}\\p{N}_]+'), lambda w: w NOT IN ('inc', 'incorporated', 'corp', 'corporation', 'llc', 'ltd', 'limited', 'co', 'company', 'gmbh', 'plc', 'sa', 'ag')), ' ') AS k FROM v_names) y", "names")
def surface_scope(spark, d):
    return bound(spark, d, "names").select("mention_id", V.in_scope(F.col("surface"), F.array(F.lit("Almond Inc."), F.lit("Brand 12 Trading Co"))).alias("ok"))


# Audits, samples and halves

_UPPER = """au AS (SELECT CAST(score * 10 AS BIGINT) AS grade, count(*) AS audited, count(*) FILTER (conf > 0.9) AS misses FROM v_scores GROUP BY ALL),
bi(grade, misses, audited, lo, hi, k) AS (SELECT grade, misses, audited, 1e-15, 1 - 1e-15, 0 FROM au UNION ALL
  SELECT grade, misses, audited, CASE WHEN c > 0.05 THEN mid ELSE lo END, CASE WHEN c > 0.05 THEN hi ELSE mid END, k + 1
  FROM (SELECT *, (lo + hi) / 2 AS mid, list_sum(list_transform(range(0, misses + 1), lambda i: exp(lgamma(audited + 1) - lgamma(i + 1) - lgamma(audited - i + 1) + i * ln((lo + hi) / 2) + (audited - i) * ln(1 - (lo + hi) / 2)))) AS c FROM bi WHERE k < 60) q)"""


@query(f"{_UPPER} SELECT grade, misses, audited, round(CASE WHEN misses >= audited THEN 1 ELSE hi END, 6) AS upper FROM bi WHERE k = 60", "scores")
def fn_upper(spark, d):
    c = bound(spark, d, "scores").groupBy((F.col("score") * 10).cast("decimal(20,6)").cast("double").alias("g")).agg(F.count("*").alias("n"), F.count_if(F.col("conf") > 0.9).alias("m"))
    c = c.groupBy(F.bround("g").cast("bigint").alias("grade")).agg(F.sum("m").alias("misses"), F.sum("n").alias("audited"))
    return gate.upper_bounds(c).withColumn("upper", F.round("upper", 6))


@query("""th AS (SELECT mention_id AS a, mention_id + 1 AS b, (mention_id % 100) / 100.0E0 AS theta FROM v_names), bn AS (SELECT *, CASE WHEN theta <= 0.15 THEN 'low' WHEN theta >= 0.85 THEN 'high' ELSE 'middle' END AS band FROM th),
r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5('0|' || a || '|' || b), a, b) AS r FROM bn) SELECT a, b, band FROM r WHERE (band = 'low' AND r <= 6) OR (band = 'high' AND r <= 6) OR (band = 'middle' AND r <= 8)""", "names")
def pair_sample(spark, d):
    p = bound(spark, d, "names").select(F.col("mention_id").alias("a"), (F.col("mention_id") + 1).alias("b"), ((F.col("mention_id") % 100) / 100.0).alias("theta"))
    return gate.pair_sample(p, {"low": 6, "high": 6, "middle": 8}).select("a", "b", "band")


_HALVES = "hv AS (SELECT entity, CASE WHEN row_number() OVER (ORDER BY md5('0|' || entity), entity) <= floor(count(*) OVER () / 2) THEN 'calibration' ELSE 'validation' END AS half FROM (SELECT DISTINCT entity FROM v_graded) e)"


@query(f"{_HALVES} SELECT * FROM hv", "graded")
def cohort_halves(spark, d):
    return gate.halves(bound(spark, d, "graded").select("entity").distinct())


@query(f"{_HALVES}, {_LOSS}, h AS (SELECT loss FROM ls JOIN hv USING (entity) WHERE half = 'validation'), a AS (SELECT count(*) AS n, avg(loss) AS m, avg(CAST(loss <= 0.2 AS INTEGER)) AS w FROM h) SELECT n, round(m, 9) AS mean_loss, round(w, 9) AS rate_within, round(CASE WHEN m < 0.2 THEN exp(-2 * n * pow(0.2 - m, 2)) ELSE 1 END, 9) AS p FROM a", "graded")
def holdout_report(spark, d):
    h = gate.holdout(gate.halves(_losses(spark, d)).where("half = 'validation'"), 0.2)
    return h.select("n", *(F.round(c, 9).alias(c) for c in ("mean_loss", "rate_within", "p")))


@query("SELECT 150 AS needed, round(sqrt(ln(20) / (2 * 50)), 9) AS floor_50, round(0.05 + 0.1 + 0.02 * 0.3 + 0.04 * 0.2 + 0.01 + 0.02, 9) AS fallback")
def certificate_sizes(spark, d):
    """Entities that a certificate needs at least, the level that 50 without a loss reach, and a fallback level from its parts."""
    level = T.fallback_level(0.05, 0.1, 0.02, 30.0, 0.04, 20.0, 0.01, 0.02, 100.0)
    return spark.createDataFrame([(T.cohort_needed(), round(T.floor_of(50), 9), round(level, 9))], "needed int, floor_50 double, fallback double")


# Records and the matcher

_LINKS = """sl AS (SELECT a.mention_id AS a, b.mention_id AS b, 0.7 * greatest(0, 1 - abs(datediff('day', a.date, b.date)) / 1.5E0) + 0.3 * greatest(0, 1 - abs(a.number - b.number) / greatest(1, abs(a.number), abs(b.number))) AS score
FROM v_sightings a JOIN v_sightings b ON a.entity = b.entity AND a.mention_id < b.mention_id)"""


@query(f"{_LINKS} SELECT a, b, round(score, 6) AS score FROM sl WHERE round(score, 9) >= 0.5", "sightings")
def record_links(spark, d):
    return records.record_links(bound(spark, d, "sightings"), 0.5).select("a", "b", F.round("score", 6).alias("score"))


_REACH = "l AS (SELECT a, b FROM sl WHERE round(score, 9) >= {t} UNION SELECT b, a FROM sl WHERE round(score, 9) >= {t}), r(a, b) AS (SELECT mention_id, mention_id FROM v_sightings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)"


@query(f"{_LINKS}, {_REACH.format(t=0.85)} SELECT a AS mention_id, min(b) AS record FROM r GROUP BY a", "sightings")
def record_components(spark, d):
    return records.components_at(bound(spark, d, "sightings"), 0.85)


@query(f"{_LINKS} " + " UNION ALL ".join(f"SELECT {t}E0 AS tau, (SELECT count(*) FROM (WITH RECURSIVE {_REACH.format(t=t)} SELECT a, min(b) AS m FROM r GROUP BY a HAVING min(b) = a) c) AS records, round(greatest(0.05, 0.05 + 0.75 * (0.9 - {t})), 9) AS eps_er" for t in (0.6, 0.75, 0.9, 0.97)), "sightings")
def tau_sweep(spark, d):
    return records.sweep_at(bound(spark, d, "sightings"), [0.6, 0.75, 0.9, 0.97]).withColumn("eps_er", F.round("eps_er", 9))


def _named(spark, d):
    n = bound(spark, d, "names").select("mention_id", "surface", V.host(F.col("url")).alias("domain"))
    return n.withColumns({"vec": F.lit(None).cast("array<float>"), "at": F.when(F.col("mention_id") % 3 == 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("mention_id") % 400).cast("int")))})


def _feature_pairs(spark, d):
    n = _named(spark, d)
    name = V.resolver_name(F.col("surface"))
    blocked = M.bounded_blocks(n.select("mention_id", F.replace(name, F.lit(" "), F.lit("")).alias("solid"), E.name_blocks(F.col("surface")).alias("blocks")))
    return M.block_features(blocked, n)


@query()
def pair_features(spark, d):
    f = _feature_pairs(spark, d)
    return f.select("a", "b", *(F.round(c, 6).alias(c) for c in M.FEATURES), F.round(M.cold_theta(), 6).alias("theta"))


@query()
def matcher_alpha(spark, d):
    """Error and mean score of a matcher fitted on pairs that the parts' numbers label."""
    f = _feature_pairs(spark, d)
    theta, alpha = M.fit_matcher(f.withColumn("label", F.when((F.col("a") + F.col("b")) % 11 == 0, "").otherwise((F.col("name") > 0.8).cast("int").cast("string"))))
    return f.agg(F.count("*").alias("pairs"), F.avg(theta).alias("mean_theta")).withColumn("alpha", F.lit(alpha).cast("double"))


@query()
def resolved_entities(spark, d):
    return M.resolve_entities(_named(spark, d))["entities"]


# Frontier, report and what else is decided


@query("_x AS (SELECT 1) SELECT formulation_id, round(p_success * yield_if_success, 9) AS residual FROM v_formulations WHERE NOT issued ORDER BY p_success * yield_if_success DESC, formulation_id LIMIT 1", "formulations")
def fallback_search(spark, d):
    return N.fallback_search(bound(spark, d, "formulations")).select("formulation_id", F.round("residual", 9).alias("residual"))


@query("_x AS (SELECT 1) SELECT formulation_id, CASE WHEN stratum IN ('click', 'view') AND NOT issued THEN 0 ELSE p_success END AS p_success FROM v_formulations", "formulations")
def pruned_searches(spark, d):
    f = bound(spark, d, "formulations")
    return N.pruned(f, spark.createDataFrame([("click",), ("view",)], "stratum string")).select("formulation_id", "p_success")


@query("""_x AS (SELECT 1) SELECT formulation_id, CASE WHEN regexp_matches(q, 'crunchbase|pitchbook|dealroom|vendor') THEN 'vendor' WHEN regexp_matches(q, 'filing|10-k|10k|8-k|form d|sec |edgar|nct') THEN 'regulatory' WHEN regexp_matches(q, 'press release|announce|news|techcrunch|reuters') THEN 'news'
WHEN regexp_matches(q, 'portfolio|fund page|investor page') THEN 'investor' WHEN regexp_matches(q, 'linkedin|employees|headcount') THEN 'social' ELSE 'other' END AS class FROM (SELECT formulation_id, lower(query || CASE CAST(formulation_id AS BIGINT) % 7 WHEN 0 THEN ' Pitchbook' WHEN 1 THEN ' Form D' WHEN 2 THEN ' news' WHEN 3 THEN ' portfolio' WHEN 4 THEN ' headcount' ELSE '' END) AS q FROM v_formulations) x""", "formulations")
def query_classes(spark, d):
    f = bound(spark, d, "formulations")
    k = F.col("formulation_id").cast("long") % 7
    more = F.when(k == 0, " Pitchbook").when(k == 1, " Form D").when(k == 2, " news").when(k == 3, " portfolio").when(k == 4, " headcount").otherwise("")
    return f.select("formulation_id", V.query_class(F.concat("query", more)).alias("class"))


@query(f"{_SEEN}, c AS (SELECT stratum, step * 0.16E0 AS cost, found / max(found) OVER (PARTITION BY stratum) AS recall FROM seen), n AS (SELECT *, lead(cost) OVER w AS c2, lead(recall) OVER w AS r2 FROM c WINDOW w AS (PARTITION BY stratum ORDER BY cost)) SELECT stratum, b.b AS budget, round(coalesce(r2, recall) * 0 + CASE WHEN c2 IS NULL THEN recall ELSE recall + (b.b - cost) / (c2 - cost) * (r2 - recall) END, 9) AS recall FROM n JOIN (VALUES (0.5E0), (1.0E0), (3.0E0)) b(b) ON b.b >= cost AND (c2 IS NULL OR b.b < c2)", "covered")
def recall_at_budget(spark, d):
    c = N.recall(_seen(spark, d)).select("stratum", (F.col("step") * 0.16).alias("cost"), "recall")
    return N.interpolated(c, spark.createDataFrame([(0.5,), (1.0,), (3.0,)], "budget double"), ["stratum"]).withColumn("recall", F.round("recall", 9))


@query(f"{_FREQ}, {_SEEN}, vv AS (SELECT stratum, sum(pow(24.0 / greatest(found, 1), 2)) AS v FROM seen GROUP BY stratum), st AS (SELECT f.stratum, n, f1 / n AS u, sqrt(2 * v * ln((SELECT count(*) FROM vv) / 0.05)) AS psi FROM f JOIN vv USING (stratum)) SELECT stratum, u + psi < 1.5 AND (n >= 300 OR stratum <> 'click') AS passed, round(u + psi, 6) AS achieved FROM st", "covered")
def statistical_status(spark, d):
    f = N.frequency_of_frequencies(bound(spark, d, "covered"))
    v = N.realized_variance(_seen(spark, d)).groupBy("stratum").agg(F.max("v").alias("v"))
    k = v.agg(F.count("*").alias("k"))
    s = f.join(v, "stratum").join(F.broadcast(k))  # one row
    s = s.select("stratum", "n", (F.col("f1") / F.col("n")).alias("u_hat"), N.radius(F.col("n"), F.col("k"), F.col("v"), F.lit(200)).alias("psi"), F.when(F.col("stratum") == "click", 300).alias("claimed"))
    return R.statistical_status(s, 1.5).withColumn("achieved", F.round("achieved", 6))


@query(f"{_SUMS} SELECT c_name AS stratum, coalesce(n, 0) AS n, round(coalesce(total, 0), 4) AS total FROM customer LEFT JOIN sums ON stratum = c_name", "mentions")
def known_strata(spark, d):
    strata = _t(spark, d, "customer").select(F.col("c_name").alias("stratum"))
    return R.with_known_strata(R.stratum_sums(_amounts(spark, d)).select("stratum", "n", "total"), strata).withColumn("total", F.round("total", 4))


@query("_x AS (SELECT 1) SELECT stratum, array_to_string(list_sort(list(DISTINCT CAST(floor((step - 1) / 12) AS BIGINT))), ',') AS eras FROM v_mentions GROUP BY stratum", "mentions")
def eras_covered(spark, d):
    return N.eras(bound(spark, d, "mentions").select("stratum", F.floor((F.col("step") - 1) / 12).cast("bigint").alias("year"))).withColumn("eras", F.array_join("eras", ","))


@query("""st AS (SELECT formulation_id, min(step) AS step FROM v_covered WHERE step % 3 <> 0 GROUP BY formulation_id), ev AS (SELECT DISTINCT formulation_id, CAST(formulation_id AS BIGINT) AS proposed FROM v_covered)
SELECT formulation_id, coalesce(step, nullif(proposed, 0), 1) AS step, st.step IS NULL AS fell_back FROM ev LEFT JOIN st USING (formulation_id)""", "covered")
def step_attribution(spark, d):
    c = bound(spark, d, "covered")
    m = c.select("formulation_id").distinct()
    return N.attributed_steps(m, c.where("step % 3 <> 0").select("formulation_id", "step"), m.select("formulation_id", F.col("formulation_id").cast("long").alias("proposed")))


@query(f"{_BELIEF}, ps AS (SELECT cell, bool_or(l_suppkey % 5 = 0) AS named FROM (SELECT cell, CAST(source_id AS BIGINT) AS l_suppkey FROM v_cells) x GROUP BY cell) SELECT a.cell AS record, round(CASE WHEN named THEN belief ELSE belief * 0.5 END, 9) AS belief, CASE WHEN NOT named THEN 'weak_entity_link' END AS flag FROM a JOIN ps USING (cell)", "cells")
def weak_link_guard(spark, d):
    a = B.adopted(_beliefs(spark, d)).select(F.col("cell").alias("record"), "belief")
    pages = bound(spark, d, "cells").select(F.col("cell").alias("record"), F.when(F.col("source_id").cast("long") % 5 == 0, "News of ACME Widgets today").otherwise("no name here").alias("text"), F.array(F.lit("Acme Widgets"), F.lit("ne")).alias("surfaces"))
    return fragments.weak_links(a, pages).withColumn("belief", F.round("belief", 9))


@query("ok AS (SELECT stratum, CAST(round_even(value_num, 0) AS BIGINT) AS v, count(DISTINCT source_id) AS s FROM v_statements WHERE functional = 'COUNT' GROUP BY ALL) SELECT stratum, min(v) AS provisional FROM ok WHERE s >= 2 GROUP BY stratum", "statements")
def provisional_count(spark, d):
    return C.provisional_count(bound(spark, d, "statements"))


@query("""_x AS (SELECT 1) SELECT a.claim_id, CASE WHEN bool_or(abs(a.value_num - b.value_num) <= greatest(a.tolerance, b.tolerance, 0.005 * abs(a.value_num))) THEN 'agreed' ELSE 'a_only' END AS status
FROM v_statements a LEFT JOIN (SELECT source_id, stratum, functional, value_num * (1 + (length(claim_id) % 3) * 0.004) AS value_num, tolerance FROM v_statements WHERE claim_id NOT LIKE '%3') b USING (source_id, stratum, functional) GROUP BY a.claim_id""", "statements")
def claim_agreement(spark, d):
    a = bound(spark, d, "statements")
    b = a.where(~F.col("claim_id").endswith("3")).withColumn("value_num", F.col("value_num") * (1 + (F.length("claim_id") % 3) * 0.004))
    return C.agreed_claims(a, b)


@query("_x AS (SELECT 1) SELECT stratum, CAST(min(k) AS BIGINT) AS min_kappa FROM (SELECT stratum, cell, CASE WHEN bmax >= 1 THEN 1000000 ELSE greatest(0, ceil(ln((1 - bmax) / greatest(1 - b2, 1e-12)) / ln(0.7)) - 1) END AS k FROM (SELECT stratum, cell, max(b) AS bmax, coalesce(max(b) FILTER (r = 2), 0) AS b2 FROM (SELECT stratum, cell, amount, b, row_number() OVER (PARTITION BY cell ORDER BY b DESC, first_id, amount) AS r FROM (SELECT stratum, cell, amount, round(1 - product(1 - q), 9) AS b, min(mention_id) AS first_id FROM (SELECT *, CASE WHEN anchored THEN 0.95E0 ELSE 0.3E0 END AS q FROM v_mentions) m GROUP BY ALL) g) h GROUP BY ALL) i) j GROUP BY stratum", "mentions")
def report_kappa(spark, d):
    """The least forgery margin of a stratum's records, shown beside its interval."""
    m = B.with_reliability(bound(spark, d, "mentions").withColumn("value", F.col("amount").cast("double")))
    a = B.adopted(B.origin_beliefs(m)).select("cell", "kappa")
    return m.select("stratum", "cell").distinct().join(a, "cell").groupBy("stratum").agg(F.min("kappa").alias("min_kappa"))


@query("_x AS (SELECT 1) SELECT mention_id, source_class, stratum FROM v_mentions WHERE attribute IN ('amount', 'date')", "mentions")
def source_lookup(spark, d):
    """Mentions of the asked attributes with their source's columns, by an equi-join."""
    m = bound(spark, d, "mentions")
    s = m.select("source_id", F.col("source_class")).distinct()
    return m.where(F.col("attribute").isin("amount", "date")).select("mention_id", "source_id", "stratum").join(s, "source_id").select("mention_id", "source_class", "stratum")
