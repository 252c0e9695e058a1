"""The catalog's rules and each query again, as DuckDB SQL over the driver's tables."""

from __future__ import annotations

from conceptlake.functions import tsquery

BUNDLE = "CAST(substr(source, 4) AS BIGINT) + 1"

CATALOG = f"""WITH RECURSIVE
bundles AS (SELECT bundle_id, source AS name, '/bundles/' || source AS path, count(*) AS file_count, bundle_id % 7 <> 0 AS enabled, CASE WHEN bundle_id % 11 = 0 THEN TIMESTAMP '2024-01-20 00:00:00' END AS retired_at,
  1704067200 + bundle_id * 7200 AS synced_s, bundle_id * 3 % 5 AS catalog_generation, 't' || (bundle_id % 3) AS tenant_id FROM (SELECT source, {BUNDLE} AS bundle_id FROM documents) GROUP BY source, bundle_id),
active AS (SELECT * FROM bundles WHERE enabled AND retired_at IS NULL),
concepts AS (SELECT {BUNDLE} AS bundle_id, 'doc/' || d.doc_id AS concept_id, 'doc/' || d.doc_id || '.md' AS path, lang AS type, split_part(text, chr(10), 1) AS title, 'language ' || lang AS description,
  CASE WHEN d.doc_id % 10 <> 9 THEN list_filter([lang, CASE quality WHEN 1 THEN 'curated' WHEN 0 THEN 'rough' END, CASE toxic WHEN 1 THEN 'toxic' END], lambda x: x IS NOT NULL) END AS tags, text AS body_text, sha256(text) AS file_hash, d.doc_id, 't' || (({BUNDLE}) % 3) AS tenant_id
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
seen AS (SELECT c.* FROM concepts c SEMI JOIN active USING (bundle_id)),
prov AS (SELECT {BUNDLE} AS bundle_id, 'doc/' || d.doc_id AS concept_id, CASE WHEN quality = 1 THEN 'stable' ELSE 'draft' END AS status, CASE WHEN toxic = 1 THEN 'unverified' WHEN quality = 1 THEN 'human-reviewed' ELSE 'machine-confirmed' END AS trust_tier,
  'agent:' || (d.doc_id % 5) AS generated_by, 1704067200 + d.doc_id % 400 * 86400 AS stale_after_s, d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
verif AS (SELECT bundle_id, concept_id, ordinal, CASE WHEN (doc_id + ordinal) % 2 = 0 THEN 'human:' || (doc_id % 7) ELSE 'bot:check' END AS verified_by, 1704067200 + (doc_id * 31 + ordinal * 17) % 1000 * 3600 AS verified_at_s
  FROM (SELECT *, unnest(range(0, doc_id % 3 + 1)) AS ordinal FROM prov)),
placed AS (SELECT doc_id, {BUNDLE} AS bundle_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
links AS (SELECT s.bundle_id, 'doc/' || s.doc_id AS source_id, coalesce('doc/' || t.doc_id, 'gone/' || s.bundle_id || '/' || s.t) AS target_id, s.ordinal, t.doc_id IS NOT NULL AS resolved, CASE WHEN s.ordinal = 3 THEN 'reference' ELSE 'inline' END AS link_kind
  FROM (SELECT *, (i * (2 * ordinal + 1) + ordinal) % (n + n // 10 + 1) AS t FROM placed, (SELECT unnest([1, 2, 3]) AS ordinal)) s LEFT JOIN placed t ON s.bundle_id = t.bundle_id AND s.t = t.i),
edges AS (SELECT DISTINCT source_id, target_id FROM links WHERE resolved AND source_id <> target_id),
rels AS (SELECT *, s % 20 + 1 AS sb, t % 20 + 1 AS tb, sk || s AS source, tk || t AS target FROM (
  SELECT 1 AS publication_id, o_custkey AS s, 'c/' AS sk, 'sales:placed' AS relation_type, 'directed' AS direction, o_orderkey AS t, 'o/' AS tk, o_orderkey % 13 = 0 AS unresolved FROM orders
  UNION ALL SELECT DISTINCT 2, l_orderkey, 'o/', 'sales:supplied_by', 'directed', l_suppkey, 's/', false FROM lineitem
  UNION ALL SELECT 3, f, 'c/', 'geo:same_nation', 'undirected', c_custkey, 'c/', false FROM (SELECT *, min(c_custkey) OVER (PARTITION BY c_nationkey) AS f FROM customer) WHERE c_custkey <> f
  UNION ALL SELECT 4, o_custkey, 'c/', 'sales:asked_for', 'directed', o_orderkey, 'o/', false FROM orders)),
current_rels AS (SELECT rels.*, sb || ' ' || source AS source_id, tb || ' ' || target AS target_id FROM rels SEMI JOIN active ON sb = bundle_id WHERE publication_id < 4 AND NOT unresolved),
emb AS (SELECT {BUNDLE} AS bundle_id, 'doc/' || vec_id AS concept_id, vec_id, CAST(embedding AS DOUBLE[]) AS embedding, CASE WHEN vec_id % 5 = 4 THEN 'v0' ELSE 'v1' END AS contract FROM embeddings JOIN documents ON vec_id = doc_id),
changes AS (SELECT 'user/' || user_id AS concept_id, epoch_us(ts) AS at_us, event_id, CASE WHEN event_type = 'purchase' THEN 'removed' ELSE 'updated' END AS change_kind, event_type AS title FROM events),
versions AS (SELECT concept_id, version, at_us AS valid_from, CASE WHEN change_kind = 'removed' THEN at_us ELSE nxt END AS valid_to, change_kind, title FROM (SELECT *, row_number() OVER w AS version, lead(at_us) OVER w AS nxt FROM changes WINDOW w AS (PARTITION BY concept_id ORDER BY at_us, event_id))),
fb AS (SELECT bundle_id, CASE WHEN bundle_id % 3 <> 0 THEN 'fresh' WHEN bundle_id % 2 = 0 THEN 'stale' ELSE 'reconciling' END AS state FROM bundles),
fc AS (SELECT bundle_id, concept_id, CASE WHEN doc_id % 2 = 0 THEN 'blocked' ELSE 'fresh' END AS state FROM concepts WHERE doc_id % 17 = 13),
fp AS (SELECT bundle_id, path, 'stale' AS state FROM concepts WHERE doc_id % 19 = 5)"""

TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def posts(rows: str = "seen") -> str:
    """All postings of ``rows``."""
    labels = "left(concat_ws(' ', array_to_string(tags, ' '), type, description), 16000)"
    a, b, d = (TOKENS.format(x) for x in ("left(title, 4000)", labels, "left(body_text, 200000)"))
    return f"""(SELECT bundle_id, concept_id, (ta || tb || td)[pos] AS lexeme, pos,
  CASE WHEN pos <= len(ta) THEN 1.0::DOUBLE WHEN pos <= len(ta) + len(tb) THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END AS weight
  FROM (SELECT *, generate_subscripts(ta || tb || td, 1) AS pos FROM (SELECT bundle_id, concept_id, {a} AS ta, {b} AS tb, {d} AS td FROM {rows})))"""


def rank_sql(text: str, rows: str = "seen") -> str:
    """(bundle_id, concept_id, rank), covers summed by joining each with the units inside it."""
    query = tsquery.parse(text)
    parts = []
    for clause in query.clauses:
        if not clause.must:  # exclusions alone: all others, at rank 0
            barred = " UNION ".join(f"SELECT bundle_id, concept_id FROM {rank_sql(chr(34) + ' '.join(p) + chr(34), rows)}" for p in clause.never)
            parts.append(f"(SELECT bundle_id, concept_id, 0.0 AS r FROM {rows} ANTI JOIN ({barred}) USING (bundle_id, concept_id))")
            continue
        units = [*clause.must, *clause.never]
        words = ", ".join(f"'{w}'" for u in units for w in u)

        def at(u: tuple[str, ...]) -> str:
            more = "".join(f" AND EXISTS (SELECT 1 FROM q p{k} WHERE p{k}.bundle_id = q.bundle_id AND p{k}.concept_id = q.concept_id AND p{k}.pos = q.pos + {k} AND p{k}.lexeme = '{w}')" for k, w in enumerate(u[1:], 1))
            return f"(lexeme = '{u[0]}'{more})"

        n = len(clause.must)
        occ = " UNION ALL ".join(f"SELECT bundle_id, concept_id, pos, weight, {i} AS u FROM q WHERE {at(u)}" for i, u in enumerate(units))
        last = ", ".join(f"max(CASE WHEN u = {i} THEN pos END) OVER w AS l{i}" for i in range(n))
        starts = ", ".join(f"l{i}" for i in range(n))
        known = " AND ".join(f"l{i} IS NOT NULL" for i in range(n))
        parts.append(f"""(WITH q AS MATERIALIZED (SELECT * FROM {posts(rows)} WHERE lexeme IN ({words})), occ AS MATERIALIZED ({occ}),
ent AS MATERIALIZED (SELECT * FROM occ WHERE u < {n} AND (bundle_id, concept_id) NOT IN (SELECT (bundle_id, concept_id) FROM occ WHERE u >= {n})),
ends AS (SELECT DISTINCT bundle_id, concept_id, pos, CASE WHEN {known} THEN least({starts}) END AS s FROM (SELECT *, {last} FROM ent WINDOW w AS (PARTITION BY bundle_id, concept_id ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))),
cov AS (SELECT * FROM (SELECT *, lag(s) OVER (PARTITION BY bundle_id, concept_id ORDER BY pos) AS was FROM ends) WHERE s IS NOT NULL AND s IS DISTINCT FROM was)
SELECT bundle_id, concept_id, sum(n / inv / (1 + greatest(pos - s - (n - 1), 0))) AS r FROM (SELECT c.bundle_id, c.concept_id, c.pos, c.s, count(*) AS n, sum(1 / e.weight) AS inv FROM cov c JOIN ent e ON c.bundle_id = e.bundle_id AND c.concept_id = e.concept_id AND e.pos BETWEEN c.s AND c.pos GROUP BY ALL) GROUP BY ALL)""")
    return f"(SELECT bundle_id, concept_id, CAST(sum(r) AS FLOAT) AS rank FROM ({' UNION ALL '.join('SELECT * FROM ' + p for p in parts)}) GROUP BY ALL)"


def search_sql(text: str, rows: str = "seen", limit: int = 20, offset: int = 0) -> str:
    return f"{CATALOG} SELECT bundle_id, concept_id, path, title, type, round(r::DOUBLE, 4) AS rank FROM (SELECT bundle_id, concept_id, rank AS r FROM {rank_sql(text, rows)}) JOIN concepts USING (bundle_id, concept_id) ORDER BY r DESC, bundle_id, concept_id LIMIT {limit} OFFSET {offset}"


def sub(where: str) -> str:
    return f"(SELECT * FROM seen WHERE {where})"


def facet_sql(text: str, facet: str) -> str:
    hits = f"(SELECT s.* FROM seen s SEMI JOIN {rank_sql(text)} h USING (bundle_id, concept_id))"
    value = {"type": f"SELECT type AS value FROM {hits}", "tag": f"SELECT unnest(tags) AS value FROM {hits}", "bundle": f"SELECT name AS value FROM {hits} JOIN bundles USING (bundle_id)", "status": f"SELECT status AS value FROM {hits} JOIN prov USING (bundle_id, concept_id)", "trust_tier": f"SELECT trust_tier AS value FROM {hits} JOIN prov USING (bundle_id, concept_id)"}[facet]
    return f"{CATALOG} SELECT value, count(*) AS n FROM ({value}) WHERE value IS NOT NULL GROUP BY value"


def walk_sql(edges: str, seeds: str, hops: int) -> str:
    """(seed, node, hops) with the least number of hops, seed excluded."""
    return f"(SELECT seed, node, min(hops) AS hops FROM (WITH RECURSIVE walk AS (SELECT seed, seed AS node, 0 AS hops FROM ({seeds}) UNION SELECT w.seed, e.target_id, w.hops + 1 FROM walk w JOIN {edges} e ON w.node = e.source_id WHERE w.hops < {hops}) SELECT * FROM walk) WHERE node <> seed GROUP BY seed, node)"


FRESH = "coalesce(fc.state, fp.state, fb.state, 'fresh')"
FRESH_JOIN = "LEFT JOIN fc ON x.bundle_id = fc.bundle_id AND x.concept_id = fc.concept_id LEFT JOIN fp ON x.bundle_id = fp.bundle_id AND x.path = fp.path LEFT JOIN fb ON x.bundle_id = fb.bundle_id"
COS = "CASE WHEN list_dot_product(e.embedding, v.embedding) IS NOT NULL THEN list_cosine_similarity(e.embedding, v.embedding) END"
SEM = f"""(SELECT c.bundle_id, c.concept_id, c.path, c.title, c.type, CAST({COS} AS FLOAT) AS s FROM emb e JOIN seen c USING (bundle_id, concept_id)
  SEMI JOIN (SELECT * FROM fb WHERE state = 'fresh') f ON c.bundle_id = f.bundle_id
  ANTI JOIN (SELECT * FROM fc WHERE state <> 'fresh') n ON c.bundle_id = n.bundle_id AND c.concept_id = n.concept_id ANTI JOIN fp p ON c.bundle_id = p.bundle_id AND c.path = p.path,
  (SELECT embedding FROM emb WHERE vec_id = 0) v WHERE e.contract = 'v1')"""


def headline_sql(terms: list[str]) -> str:
    """The headline of ``body_text``: 35 words around the first match, matches marked."""
    hit = f"len(list_intersect({TOKENS.format('w')}, {terms})) > 0"
    words = "regexp_extract_all(body_text, '\\S+')"
    start = "greatest(1, coalesce(list_position(h, true), 0) - 11)"
    shown = f"list_transform(range({start}, least(len(p), {start} + 34) + 1), lambda i: CASE WHEN h[i] THEN '<b>' || p[i] || '</b>' ELSE p[i] END)"
    return f"(SELECT array_to_string({shown}, ' ') FROM (SELECT {words} AS p, list_transform({words}, lambda w: {hit}) AS h))"
