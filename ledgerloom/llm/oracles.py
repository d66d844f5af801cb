"""DuckDB statements of the operators that SQL can express."""

#: Words, shingle sets, links by a plain join on shingles, components by recursion.
NGRAM_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.b, s.doc_id)) AS component_id
FROM s LEFT JOIN c ON c.a = s.doc_id
"""

#: Payload digests by SHA-1; the largest page_id of equal long payloads is the response.
WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS last FROM q WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM q LEFT JOIN m USING (payload_digest)
"""

#: Every query with every candidate.
TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_TOKENS = r"""
  SELECT id, list_filter(list_transform(w, lambda x, i: struct_pack(
      v := lower(trim(x, '.!?')),
      t := CASE WHEN regexp_matches(trim(x, '.!?'), '[0-9]') THEN '#num'
                WHEN list_contains(UNITS, lower(trim(x, '.!?'))) THEN '#unit'
                WHEN length(trim(x, '.!?')) > 1 AND left(trim(x, '.!?'), 1) <> left(lower(trim(x, '.!?')), 1)
                     AND substr(trim(x, '.!?'), 2) = substr(lower(trim(x, '.!?')), 2)
                     AND NOT (i = 1 OR regexp_matches(w[i - 1], '[.!?]$')) THEN '#name'
                ELSE lower(trim(x, '.!?')) END)), lambda x: x.v <> '') AS k
  FROM (SELECT id, list_filter(string_split_regex(translate(replace(coalesce(text, ''), chr(10), ' . '), 'DELETED', ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM SOURCE)
"""


def _decontamination() -> str:
    from ledgerloom.llm.decontam import DELETED, ENOUGH, K, LITERAL, UNITS

    def tokens(source: str) -> str:
        units = "[" + ", ".join(f"'{u}'" for u in UNITS) + "]"
        return _TOKENS.replace("UNITS", units).replace("DELETED", DELETED.replace("'", "''")).replace("SOURCE", source)

    windows = f"SELECT id, unnest(list_transform(range(greatest(len(k) - {K - 1}, 1)), lambda i: struct_pack(p := i, k := k[i + 1:i + {K}]))) AS x FROM KEYS WHERE len(k) > 0"
    return f"""
WITH bk AS ({tokens("(SELECT item_id AS id, text FROM benchmark WHERE text IS NOT NULL)")}),
dk AS ({tokens("(SELECT doc_id AS id, text FROM documents)")}),
bw AS (SELECT id AS item_id, x.p AS ipos, x.k AS ik, list_transform(x.k, lambda y: y.t) AS it FROM ({windows.replace("KEYS", "bk")})),
b AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS windows FROM bw
      WHERE len(list_filter(it, lambda t: NOT starts_with(t, '#'))) >= least({LITERAL}, greatest(1, len(it) - 1))),
d AS (SELECT id AS doc_id, x.p AS pos, x.k AS dk, list_transform(x.k, lambda y: y.t) AS dt FROM ({windows.replace("KEYS", "dk")})),
m AS (SELECT doc_id, item_id, windows, ipos, pos - ipos AS diagonal, ik, dk FROM d JOIN b ON d.dt = b.it),
s AS (SELECT DISTINCT doc_id, item_id, diagonal, ik[j].v AS i, dk[j].v AS d
      FROM (SELECT *, unnest(range(1, len(ik) + 1)) AS j FROM m) WHERE starts_with(ik[j].t, '#')),
c AS (SELECT doc_id, item_id, diagonal, count(*) = count(DISTINCT i) AND count(*) = count(DISTINCT d) AS consistent, bool_or(i <> d) AS renamed
      FROM s GROUP BY doc_id, item_id, diagonal),
g AS (SELECT m.doc_id, m.item_id, m.windows, m.ipos, coalesce(c.renamed, false) AS renamed
      FROM m LEFT JOIN c USING (doc_id, item_id, diagonal) WHERE coalesce(c.consistent, true))
SELECT doc_id, item_id, count(DISTINCT ipos) AS matched, windows, bool_or(renamed) AS renamed
FROM g GROUP BY doc_id, item_id, windows HAVING count(DISTINCT ipos) >= least({ENOUGH}, ceil(windows / 2))
"""


DECONTAMINATION = _decontamination()
