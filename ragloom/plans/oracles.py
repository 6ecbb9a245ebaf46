"""DuckDB SQL for the queries of the catalogue."""

from __future__ import annotations

from ragloom.functions import ontology as O
from ragloom.plans.derived import LEXICON

WS = r"[\s\x0B ﻿  -     　]+"


def listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def compact(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}', ' ', 'g'), ' ')"


def normalize(x: str) -> str:
    return compact(f"regexp_replace({x}, '[•·◦●]', ' ', 'g')")


def terms(x: str) -> str:
    """Distinct terms; the order differs from Spark's, so results sort them."""
    found = f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+(?:-[a-z0-9]+)?'), lambda t: length(t) > 2)"
    return f"list_distinct(flatten(list_transform({found}, lambda t: CASE WHEN t[-1] = 's' AND length(t) > 4 THEN [t, t[1:length(t) - 1]] ELSE [t] END)))"


def without(x: str, words: str) -> str:
    return f"list_filter({x}, lambda u: NOT list_contains({words}, u))"


def hits(x: str, words) -> str:
    return f"len(list_intersect({x}, {words if isinstance(words, str) else listed(words)}))"


def expanded(source: str, key: str, text: str) -> str:
    """CTEs ``e0 .. eN``: terms after each expansion, then ``expanded`` without stop words."""
    stop = listed(LEXICON.stop)
    steps = [f"e0 AS (SELECT {key}, {text} AS text, lower({text}) AS low, {without(terms(text), stop)} AS t FROM {source})"]
    for i, (word, more) in enumerate(LEXICON.expansions):
        steps.append(f"e{i + 1} AS (SELECT {key}, text, low, CASE WHEN list_contains(t, '{word}') OR contains(low, '{word}') THEN list_distinct(list_concat(t, {listed(more)})) ELSE t END AS t FROM e{i})")
    n = len(LEXICON.expansions)
    steps.append(f"expanded AS (SELECT {key}, text, low, {without('t', stop)} AS t FROM e{n})")
    return ",\n".join(steps)


def lexical(x: str, t: str) -> str:
    phrases = " + ".join(f"CAST(contains(lower({x}), '{p}') AS INTEGER)" for p in LEXICON.phrases)
    return f"CASE WHEN len({t}) = 0 THEN 0.0 ELSE least(1.0, CAST({hits(terms(x), t)} AS DOUBLE) / len({t}) + ({phrases}) * CAST(0.04 AS DOUBLE)) END"


def flags(low: str, t: str) -> dict[str, str]:
    out = {k: "(" + " OR ".join(f"contains({low}, '{p}')" for p in v) + ")" for k, v in LEXICON.flag_phrases.items()}
    out["asks_conflict"] = f"({out['asks_conflict']} OR {hits(t, LEXICON.conflict)} > 0)"
    out["asks_explanation"] = f"({out['asks_explanation']} OR starts_with({low}, 'why'))"
    return out


def cue(own: str, on: dict[str, str]) -> str:
    parts = [f"CASE WHEN {on[k]} THEN CAST(0.08 AS DOUBLE) * {hits(own, w)} ELSE 0.0 END" for k, w in LEXICON.flag_cues.items()]
    return f"least(1.0, {' + '.join(parts)} + CAST(0.03 AS DOUBLE) * {hits(own, LEXICON.evidence)} + CAST(0.03 AS DOUBLE) * {hits(own, LEXICON.alliance)})"


def sentences(x: str) -> str:
    return f"list_filter(string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


WINDOWS = f"""
    cut AS (SELECT doc_id, text, {sentences(compact('text'))} AS s FROM documents),
    windows AS (
        SELECT doc_id, text, list_concat(s, list_transform(list_filter(range(1, len(s)), lambda i: length(s[i]) < 220), lambda i: s[i] || ' ' || s[i + 1])) AS w FROM cut
    )"""

GRAPH = """
    edges AS (
        SELECT 'nation:' || n_nationkey AS subject_id, 'IN_REGION' AS relation, 'region:' || n_regionkey AS object_id, CAST(1 AS BIGINT) AS count FROM nation
        UNION ALL SELECT 'customer:' || c_custkey, 'IN_NATION', 'nation:' || c_nationkey, 1 FROM customer
        UNION ALL SELECT 'supplier:' || s_suppkey, 'IN_NATION', 'nation:' || s_nationkey, 1 FROM supplier
        UNION ALL SELECT 'customer:' || o_custkey, 'PLACED', 'order:' || o_orderkey, 1 FROM orders
        UNION ALL SELECT 'order:' || l_orderkey, 'CONTAINS', 'part:' || l_partkey, count(*) FROM lineitem GROUP BY ALL
        UNION ALL SELECT 'supplier:' || l_suppkey, 'SUPPLIES', 'part:' || l_partkey, count(*) FROM lineitem GROUP BY ALL
    ),
    plain AS (
        SELECT 'region:' || r_regionkey AS id, r_name AS name, 'Region' AS type FROM region
        UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'Nation' FROM nation
        UNION ALL SELECT 'customer:' || c_custkey, c_name, 'Customer' FROM customer
        UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'Supplier' FROM supplier
        UNION ALL SELECT 'order:' || o_orderkey, 'Order ' || o_orderkey, 'Order' FROM orders
        UNION ALL SELECT 'part:' || p_partkey, p_name, 'Part' FROM part
    ),
    ends AS (SELECT subject_id AS id, count FROM edges UNION ALL SELECT object_id, count FROM edges),
    nodes AS (SELECT id, name, type, CAST(coalesce(m, 0) AS BIGINT) AS mentions FROM plain LEFT JOIN (SELECT id, sum(count) AS m FROM ends GROUP BY id) USING (id)),
    allowed(relation, subject_type, object_type) AS (VALUES ('IN_REGION', 'Nation', 'Region'), ('IN_NATION', 'Customer', 'Nation'), ('IN_NATION', 'Supplier', 'Nation'), ('PLACED', 'Customer', 'Order'), ('CONTAINS', 'Order', 'Part'), ('SUPPLIES', 'Supplier', 'Part'))"""

REPLIES = "replies AS (SELECT DISTINCT 'user:' || user_id AS subject_id, event_type AS relation, 'user:' || (event_id % 100) AS object_id FROM events)"
COSINE = "list_sum(list_transform(list_zip(a.e, b.e), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
VEC = "vec AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
COS = "coalesce(list_inner_product(a.e, b.e) / nullif(sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e)), 0), 0)"
SLUG = "CASE WHEN {0} = '' THEN 'unknown' ELSE {0} END"


def slug(x: str) -> str:
    s = f"substr(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[''’]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60)"
    return SLUG.format(s)


def proper(x: str) -> str:
    roles, holders = listed(O.GENERIC_ROLES.split()), listed(O.PLACEHOLDERS.split("|"))
    return f"(regexp_matches({x}, '^[A-Z0-9]') AND NOT list_contains({roles}, lower(trim({x}))) AND NOT regexp_matches({x}, '''s\\s+[a-z]') AND NOT regexp_matches({x}, '{O.DESCRIPTORS}') AND NOT list_contains({holders}, lower(trim({x}))))"


BAD = "(VALUES ('nobody', 'Customer', 'PLACED', 'Order 1', 'Order'), ('Deserter', 'Customer', 'PLACED', 'Order 1', 'Order'), ('Ned''s brother', 'Customer', 'PLACED', 'Order 1', 'Order'), ('Order 1', 'Order', 'PLACED', 'Customer 1', 'Customer'), ('A Name', 'Customer', 'KNOWS', 'B Name', 'Customer'))"

QUESTION = "Why does ation follow the eran que"

ORACLES: dict[str, str] = {
    "vector_topk": f"WITH {VEC} SELECT b.vec_id, round({COS}, 6) AS score FROM vec a JOIN vec b ON a.vec_id = 0 AND b.vec_id <> 0 ORDER BY {COS} DESC, b.vec_id LIMIT 10",
    "vector_topk_batch": f"WITH {VEC}, s AS (SELECT a.vec_id AS query_id, b.vec_id, {COS} AS score FROM vec a JOIN vec b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10",
    "compact_sha1_dedupe": f"SELECT sha1({compact('text')}) AS text_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "normalize_text": f"SELECT doc_id, sha1({normalize('text')}) AS text_hash, CAST(length({normalize('text')}) AS INTEGER) AS n_chars FROM documents",
    "word_terms": f"SELECT doc_id, CAST(len({terms('text')}) AS INTEGER) AS n_terms, sha1(array_to_string(list_sort({terms('text')}), ',')) AS terms_hash FROM documents",
    "question_terms": f"SELECT conv_id, turn, array_to_string(list_sort({without(terms('text'), listed(LEXICON.stop))}), ',') AS terms FROM conversations WHERE role = 'user'",
    "expanded_terms": f"WITH q AS (SELECT * FROM conversations WHERE role = 'user'), {expanded('q', 'conv_id, turn', 'text')} SELECT conv_id, turn, array_to_string(list_sort(t), ',') AS terms FROM expanded",
    "question_profile": f"WITH q AS (SELECT * FROM conversations WHERE role = 'user'), {expanded('q', 'conv_id, turn', 'text')} SELECT conv_id, turn, {', '.join(f'{v} AS {k}' for k, v in flags('low', 't').items())} FROM expanded",
    "chunk_documents": f"""
        WITH RECURSIVE cut AS (SELECT doc_id, {sentences(normalize('text'))} AS s FROM documents),
        sums AS (SELECT doc_id, s, list_transform(range(0, len(s) + 1), lambda i: CAST(coalesce(list_sum(list_transform(s[1:i], lambda x: length(x) + 1)), 0) AS BIGINT)) AS p FROM cut WHERE len(s) > 0),
        steps AS (
            SELECT doc_id, CAST(1 AS BIGINT) AS chunk_no, CAST(0 AS BIGINT) AS b, greatest(CAST(1 AS BIGINT), len(list_filter(p, lambda x: x <= 1001)) - 1) AS e, len(s) AS n, p FROM sums
            UNION ALL
            SELECT doc_id, chunk_no + 1, nb, greatest(nb + 1, len(list_filter(p, lambda x: x <= p[nb + 1] + 1001)) - 1), n, p FROM (
                SELECT doc_id, chunk_no, n, p, CASE WHEN k > b AND k < e THEN k ELSE e END AS nb FROM (
                    SELECT *, len(list_filter(p, lambda x: x <= p[e + 1] - 150)) - 1 AS k FROM steps WHERE e < n))
        )
        SELECT CAST(doc_id AS VARCHAR) || '_' || CASE WHEN chunk_no < 10000 THEN lpad(CAST(chunk_no AS VARCHAR), 4, '0') ELSE CAST(chunk_no AS VARCHAR) END AS chunk_id, sha1(array_to_string(s[b + 1:e], ' ')) AS text_hash
        FROM steps JOIN cut USING (doc_id)""",
    "segment_by_marker": "SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM conversations",
    "sentence_windows": f"WITH {WINDOWS} SELECT doc_id, CAST(len(w) AS INTEGER) AS n_windows, sha1(array_to_string(w, chr(10))) AS windows_hash FROM windows",
    "evidence_snippet": f"""
        WITH {WINDOWS}, q AS (SELECT 0 AS qid, '{QUESTION}' AS text), {expanded('q', 'qid', 'text')},
        each AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM windows),
        scored AS (SELECT doc_id, w, i, {terms('w')} AS own FROM each),
        ranked AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY 4 * {hits('own', 't')} + {hits('own', LEXICON.evidence)} + 2 * {hits('own', LEXICON.conflict)} + 2 * {hits('own', LEXICON.alliance)} DESC, i) AS r FROM scored, expanded),
        best AS (SELECT d.doc_id, coalesce(w, text) AS b FROM documents d LEFT JOIN (SELECT * FROM ranked WHERE r = 1) USING (doc_id))
        SELECT doc_id, CASE WHEN length(b) <= 320 THEN b ELSE rtrim(substr(b, 1, 317), ' ') || '...' END AS snippet FROM best""",
    "lexical_score": f"WITH q AS (SELECT 0 AS qid, '{QUESTION}' AS text), {expanded('q', 'qid', 'text')} SELECT doc_id, round({lexical('d.text', 'e.t')}, 6) AS score FROM documents d, expanded e",
    "cue_score": f"WITH q AS (SELECT 0 AS qid, '{QUESTION}' AS text), {expanded('q', 'qid', 'text')}, own AS (SELECT doc_id, {terms('text')} AS own FROM documents) SELECT doc_id, round({cue('own', flags('low', 't'))}, 6) AS score FROM own, expanded",
    "hybrid_rerank": f"""
        WITH {VEC}, q AS (SELECT 0 AS qid, '{QUESTION}' AS text), {expanded('q', 'qid', 'text')},
        near AS (SELECT b.vec_id AS ord, {COS} AS score, {compact("' ' || d.text")} AS text FROM vec a JOIN vec b ON a.vec_id = 0 JOIN documents d ON d.doc_id = b.vec_id ORDER BY score DESC, ord LIMIT 30),
        scored AS (SELECT ord, score, CAST(0.62 AS DOUBLE) * score + CAST(0.25 AS DOUBLE) * ({lexical('near.text', 'e.t')}) + CAST(0.13 AS DOUBLE) * ({cue(terms('near.text'), flags('e.low', 'e.t'))}) AS rerank_score, list_sort(list_intersect(e.t, {terms('near.text')})) AS matched FROM near, expanded e)
        SELECT ord AS doc_id, round(rerank_score, 6) AS rerank_score, array_to_string(matched, ',') AS matched_terms FROM scored ORDER BY scored.rerank_score DESC, score DESC, ord LIMIT 10""",
    "majority_type_vote": "WITH v AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT CAST(user_id AS VARCHAR) AS surface, CAST(sum(n) AS BIGINT) AS count, arg_max(event_type, n * 1000000000 - f) AS type FROM v GROUP BY user_id",
    "proper_name_filter": f"WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]+ [A-Za-z]+')) AS name FROM documents) SELECT name FROM n WHERE {proper('name')}",
    "validate_triples": f"""
        WITH {GRAPH}, t AS (
            SELECT s.name AS subject, s.type AS subject_type, relation, o.name AS object, o.type AS object_type FROM edges JOIN nodes s ON s.id = subject_id JOIN nodes o ON o.id = object_id
            UNION ALL SELECT * FROM {BAD} AS bad(subject, subject_type, relation, object, object_type))
        SELECT relation, count(*) AS n FROM t SEMI JOIN allowed USING (relation, subject_type, object_type) WHERE {proper('subject')} AND {proper('object')} GROUP BY relation""",
    "drop_counters": f"""
        WITH {GRAPH}, t AS (
            SELECT subject_id, relation, object_id FROM edges
            UNION ALL SELECT object_id, relation, subject_id FROM edges WHERE relation = 'IN_REGION'
            UNION ALL SELECT subject_id, relation, subject_id FROM edges WHERE relation = 'IN_NATION'
            UNION ALL SELECT subject_id, relation, 'nowhere' FROM edges WHERE relation = 'PLACED'
            UNION ALL SELECT subject_id, 'KNOWS', object_id FROM edges WHERE relation = 'IN_REGION'),
        m AS (SELECT CASE WHEN t.relation NOT IN (SELECT relation FROM allowed) THEN 'unknown_relation' WHEN s.id IS NULL OR o.id IS NULL THEN 'unknown_id' WHEN subject_id = object_id THEN 'self_loop' WHEN a.relation IS NULL THEN 'type_violation' ELSE 'kept' END AS reason
            FROM t LEFT JOIN plain s ON s.id = subject_id LEFT JOIN plain o ON o.id = object_id LEFT JOIN allowed a ON a.relation = t.relation AND a.subject_type = s.type AND a.object_type = o.type)
        SELECT reason, count(*) AS n FROM m GROUP BY reason""",
    "resolve_entities": f"""
        WITH m AS (SELECT surface, count(*) AS n, min(ord) AS f FROM (SELECT c_mktsegment AS surface, 2 * c_custkey AS ord FROM customer UNION ALL SELECT lower(c_mktsegment), 2 * c_custkey + 1 FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'nobody', 2 * c_custkey + 1 FROM customer WHERE c_custkey % 3 = 1) GROUP BY surface),
        g AS (SELECT lower({compact('surface')}) AS key, arg_min(surface, -n * 1000000000 + f) AS canonical_name, list(surface ORDER BY n DESC, f) AS aliases, CAST(sum(n) AS BIGINT) AS mentions FROM m WHERE surface <> 'nobody' GROUP BY 1)
        SELECT 'group:' || {slug('canonical_name')} AS id, canonical_name, array_to_string(aliases, ',') AS aliases, mentions FROM g""",
    "slug_ids": f"SELECT p_partkey, 'part:' || {slug('p_name')} AS id, p_brand, {slug('p_type')} AS type_slug FROM part",
    "merge_closure": "WITH RECURSIVE up AS (SELECT CAST(p_partkey AS BIGINT) AS node, CAST(p_partkey AS BIGINT) AS k FROM part UNION ALL SELECT node, k // 3 FROM up WHERE k % 7 <> 0 AND k > 0), good AS (SELECT * FROM up WHERE k > 0 AND k % 7 <> 0), reached AS (SELECT node, min(k) AS root FROM good WHERE node % 7 <> 0 GROUP BY node), every AS (SELECT node, root FROM reached UNION SELECT root, root FROM reached), sized AS (SELECT node, root, count(*) OVER (PARTITION BY root) AS n FROM every) SELECT 'p' || node AS node, min('p' || node) OVER (PARTITION BY root) AS component FROM sized WHERE n > 1",
    "edge_aggregate": """
        WITH t AS (SELECT 'supplier:' || l_suppkey AS subject_id, 'part:' || l_partkey AS object_id, l_orderkey * 10 + l_linenumber AS ord, 'o' || l_orderkey || '_' || l_linenumber AS chunk_id, 'o' || l_orderkey AS document_id, l_returnflag || l_linestatus AS description FROM lineitem),
        c AS (SELECT subject_id, object_id, array_to_string(list(chunk_id ORDER BY o, chunk_id), ',') AS x FROM (SELECT subject_id, object_id, chunk_id, min(ord) AS o FROM t GROUP BY ALL) GROUP BY 1, 2),
        d AS (SELECT subject_id, object_id, array_to_string(list(document_id ORDER BY o, document_id), ',') AS x FROM (SELECT subject_id, object_id, document_id, min(ord) AS o FROM t GROUP BY ALL) GROUP BY 1, 2),
        e AS (SELECT subject_id, object_id, array_to_string(list(description ORDER BY o, description), ',') AS x FROM (SELECT subject_id, object_id, description, min(ord) AS o FROM t GROUP BY ALL) GROUP BY 1, 2),
        n AS (SELECT subject_id, object_id, count(*) AS count FROM t GROUP BY ALL)
        SELECT subject_id, object_id, c.x AS chunk_ids, d.x AS episodes, e.x AS descriptions, count FROM n JOIN c USING (subject_id, object_id) JOIN d USING (subject_id, object_id) JOIN e USING (subject_id, object_id)""",
    "graph_counts": f"WITH {GRAPH} SELECT 'nodes' AS what, 'all' AS key, count(*) AS n FROM nodes UNION ALL SELECT 'edges', 'all', count(*) FROM edges UNION ALL SELECT 'type', type, count(*) FROM nodes GROUP BY type UNION ALL SELECT 'relation', relation, count(*) FROM edges GROUP BY relation",
    "triple_summary": f"WITH {GRAPH} SELECT 'total' AS what, 'total' AS key, count(*) AS n FROM edges UNION ALL SELECT 'total', 'subjects', count(DISTINCT subject_id) FROM edges UNION ALL SELECT 'total', 'objects', count(DISTINCT object_id) FROM edges UNION ALL SELECT 'relation', relation, count(*) FROM edges GROUP BY relation",
    "one_hop": f"WITH {GRAPH} SELECT s.name AS a, o.name AS b FROM edges JOIN nodes s ON s.id = subject_id JOIN nodes o ON o.id = object_id WHERE relation = 'IN_REGION'",
    "one_hop_undirected": f"WITH {GRAPH}, b AS (SELECT subject_id, relation, object_id FROM edges UNION ALL SELECT object_id, relation, subject_id FROM edges) SELECT s.name AS a, count(*) AS n FROM b JOIN nodes s ON s.id = subject_id WHERE relation = 'IN_NATION' GROUP BY s.id, s.name",
    "rel_alternation": f"WITH {GRAPH} SELECT subject_id AS a, count(*) AS n FROM edges WHERE relation IN ('PLACED', 'SUPPLIES') GROUP BY 1",
    "structural_join": "WITH t AS (SELECT 'customer:' || o_custkey AS a, 'part:' || l_partkey AS b, l_returnflag = 'R' AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT a, b FROM t GROUP BY a, b HAVING bool_or(r) AND bool_or(NOT r)",
    "multi_hop": f"WITH {GRAPH} SELECT a.object_id AS region, count(*) AS paths, count(DISTINCT d.object_id) AS parts FROM edges a JOIN edges b ON b.object_id = a.subject_id AND b.relation = 'IN_NATION' JOIN edges c ON c.subject_id = b.subject_id AND c.relation = 'PLACED' JOIN edges d ON d.subject_id = c.object_id AND d.relation = 'CONTAINS' WHERE a.relation = 'IN_REGION' GROUP BY 1",
    "two_hop_cycle": f"WITH {REPLIES} SELECT x.relation, x.subject_id AS a, x.object_id AS b FROM replies x JOIN replies y ON x.subject_id = y.object_id AND x.object_id = y.subject_id AND x.relation = y.relation WHERE x.subject_id <> x.object_id AND x.relation = (SELECT min(relation) FROM replies)",
    "self_loops": f"WITH {REPLIES} SELECT subject_id, relation FROM replies WHERE subject_id = object_id",
    "isolated_nodes": "SELECT 'customer:' || c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "name_containment": "SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_nationkey <> y.n_nationkey AND contains(lower(x.n_name), lower(y.n_name)) ORDER BY a, b LIMIT 20",
    "with_pipeline": f"WITH {GRAPH}, v AS (SELECT DISTINCT subject_id FROM edges WHERE relation = 'PLACED') SELECT o.name AS a, count(*) AS c FROM v JOIN edges e ON e.subject_id = v.subject_id AND e.relation = 'IN_NATION' JOIN nodes o ON o.id = e.object_id GROUP BY o.name ORDER BY c DESC, a LIMIT 10",
    "top_n_per_type": f"WITH {GRAPH} SELECT type, id, mentions, CAST(row_number() OVER (PARTITION BY type ORDER BY mentions DESC, id) AS INTEGER) AS rank FROM nodes QUALIFY row_number() OVER (PARTITION BY type ORDER BY mentions DESC, id) <= 12",
    "top_n_per_relation": f"WITH {GRAPH} SELECT relation, subject_id, object_id, count, CAST(row_number() OVER (PARTITION BY relation ORDER BY count DESC, subject_id, object_id) AS INTEGER) AS rank FROM edges QUALIFY row_number() OVER (PARTITION BY relation ORDER BY count DESC, subject_id, object_id) <= 4",
    "regex_match": "SELECT DISTINCT n_name AS a FROM nation WHERE regexp_full_match(n_name, '(?i).*nation_1.*')",
    "subgraph": f"WITH {GRAPH} SELECT DISTINCT subject_id, relation, object_id FROM edges WHERE subject_id IN ('nation:1', 'customer:1', 'part:1') OR object_id IN ('nation:1', 'customer:1', 'part:1') ORDER BY 1, 2, 3 LIMIT 80",
    "shortest_path_len": f"WITH RECURSIVE {GRAPH}, b AS (SELECT subject_id AS x, object_id AS y FROM edges UNION SELECT object_id, subject_id FROM edges), bfs AS (SELECT 'customer:1' AS node, 0 AS hops UNION SELECT y, hops + 1 FROM bfs JOIN b ON x = node WHERE hops < 6), m AS (SELECT node, min(hops) AS hops FROM bfs GROUP BY node) SELECT CAST(hops AS INTEGER) AS hops, count(*) AS n FROM m GROUP BY hops",
    "entity_linking": """
        WITH text AS (SELECT 'part:' || p_partkey AS id, lower(p_name || ' ' || p_type) AS x FROM part),
        tok AS (SELECT id, unnest(regexp_extract_all(x, '[a-z0-9]+')) AS token FROM text),
        tf AS (SELECT id, token, count(*) AS tf FROM tok GROUP BY ALL),
        len AS (SELECT id, sum(tf) AS length FROM tf GROUP BY id),
        st AS (SELECT count(*) AS n, avg(length) AS mean FROM len),
        df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
        inv AS (SELECT token, id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS s FROM tf JOIN len USING (id) JOIN df USING (token), st),
        q AS (SELECT DISTINCT p_brand || ' ' || p_type AS mention FROM part),
        qt AS (SELECT DISTINCT mention, unnest(regexp_extract_all(lower(mention), '[a-z0-9]+')) AS token FROM q),
        sc AS (SELECT mention, id, sum(s) AS score FROM qt JOIN inv USING (token) GROUP BY ALL)
        SELECT mention, id, round(score, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY mention ORDER BY round(score, 9) DESC, id) = 1""",
    "page_link_graph": "WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT href, count(*) AS n FROM l GROUP BY href",
    "scoreboard": """
        WITH s AS (SELECT doc_id, unnest(['Vector', 'Graph', 'Hybrid']) AS system, unnest([0, 1, 2]) AS k FROM labels),
        t AS (SELECT system, (doc_id + k) % 3 + (doc_id * 7 + k) % 3 + (doc_id // 2 + k) % 3 + (doc_id // 5) % 3 + k % 3 AS total FROM s)
        SELECT system, count(*) AS questions, CAST(sum(total) AS BIGINT) AS total, round(avg(total), 6) AS mean FROM t GROUP BY system""",
    "winner": """
        WITH s AS (SELECT doc_id, [(doc_id + k) % 3 + (doc_id * 7 + k) % 3 + (doc_id // 2 + k) % 3 + (doc_id // 5) % 3 + k % 3 for k in [0, 1, 2]] AS t FROM labels),
        w AS (SELECT list_filter(['Vector', 'Graph', 'Hybrid'], lambda n, i: t[i] = list_max(t)) AS w FROM s)
        SELECT CASE WHEN len(w) = 1 THEN w[1] ELSE 'tie (' || array_to_string(w, '/') || ')' END AS winner, count(*) AS n FROM w GROUP BY 1""",
    "parse_reply": "SELECT event_id, CAST(user_id AS VARCHAR) AS subject, event_type AS relation, CAST(event_id % 4 AS INTEGER) AS shape FROM events WHERE event_id % 4 < 3",
    "serialize_rows": "SELECT 'n_nationkey=' || n_nationkey || '  n_name=\"' || n_name || '\"  n_regionkey=' || n_regionkey AS line FROM nation",
    "context_block": f"SELECT doc_id, '[Chunk 1]' || chr(10) || 'document_id: ' || doc_id || chr(10) || 'chunk_id: ' || doc_id || '_0001' || chr(10) || 'title: ' || lang || chr(10) || 'retrieval_score: 0.500000' || chr(10) || 'matched_terms: a, b' || chr(10) || 'text: ' || {compact('text')} AS block FROM documents",
    "upsert_nodes": "SELECT 'customer:' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) || '!' ELSE c_name END AS name FROM customer",
    "csv_lines": f"SELECT doc_id || ',' || CASE WHEN regexp_matches(x, '[\",\r\n]') THEN '\"' || replace(x, '\"', '\"\"') || '\"' ELSE x END || ',' || lang AS value FROM (SELECT doc_id, lang, {compact('text')} AS x FROM documents)",
    "jsonl_roundtrip": "SELECT CAST(doc_id AS VARCHAR) AS document_id, lang AS title, sha1(text) AS text_hash FROM documents",
}
ORACLES["evidence_rows"] = """
        WITH t AS (SELECT 'supplier:' || l_suppkey AS s, 'part:' || l_partkey AS o, l_orderkey * 10 + l_linenumber AS ord, 'o' || l_orderkey || '_' || l_linenumber AS c, 'o' || l_orderkey AS d, l_returnflag || l_linestatus AS x FROM lineitem),
        c AS (SELECT s, o, c, row_number() OVER (PARTITION BY s, o ORDER BY min(ord), c) AS i FROM t GROUP BY s, o, c),
        d AS (SELECT s, o, list(d ORDER BY m, d) AS ds FROM (SELECT s, o, d, min(ord) AS m FROM t GROUP BY ALL) GROUP BY s, o),
        x AS (SELECT s, o, list(x ORDER BY m, x) AS xs FROM (SELECT s, o, x, min(ord) AS m FROM t GROUP BY ALL) GROUP BY s, o)
        SELECT c.c AS chunk_id, coalesce(ds[i], ds[1], '') AS episode, coalesce(xs[i], xs[1], '') AS description FROM c JOIN d USING (s, o) JOIN x USING (s, o) QUALIFY row_number() OVER (PARTITION BY c.c ORDER BY s, o, i) = 1"""

ORACLES["context_blocks"] = f"""
        WITH {VEC}, near AS (SELECT b.vec_id, {COS} AS score FROM vec a JOIN vec b ON a.vec_id = 0 AND b.vec_id <> 0 ORDER BY score DESC, b.vec_id LIMIT 10),
        ranked AS (SELECT near.*, text, lang, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM near JOIN documents ON doc_id = vec_id),
        blocks AS (SELECT r, '[Chunk ' || r || ']' || chr(10) || 'document_id: ' || vec_id || chr(10) || 'chunk_id: ' || vec_id || '_0001' || chr(10) || 'title: ' || lang || chr(10) || 'retrieval_score: ' || printf('%.6f', score) || chr(10) || 'matched_terms: ' || lang || chr(10) || 'text: ' || {compact('text')} AS b FROM ranked)
        SELECT string_agg(b, chr(10) || chr(10) ORDER BY r) AS context FROM blocks"""
ORACLES["entity_summary"] = f"""
        WITH {GRAPH}, top AS (SELECT type, name, mentions, id FROM nodes ORDER BY mentions DESC, id LIMIT 15)
        SELECT 'total' AS what, 'entities' AS key, count(*) AS n, '' AS detail FROM nodes
        UNION ALL SELECT 'type', type, count(*), '' FROM nodes GROUP BY type
        UNION ALL SELECT 'top', '[' || type || '] ' || name, mentions, id || ', ' || name || '!, ' || name || '?, ' || type || ' …' FROM top"""
ORACLES["evaluation_rows"] = f"""
        WITH s AS (SELECT DISTINCT doc_id, [[(doc_id + k) % 3, (doc_id * 7 + k) % 3, (doc_id // 2 + k) % 3, (doc_id // 5) % 3, k % 3] for k in [0, 1, 2]] AS t FROM labels)
        SELECT CAST(doc_id AS INTEGER) AS index, 'q' || doc_id AS id, 'c' || (doc_id % 5) AS category, 'question ' || doc_id AS question, 'Vector says ' || doc_id AS vector_answer, 'Graph says ' || doc_id AS graph_answer, 'Hybrid says ' || doc_id AS hybrid_answer,
            {", ".join(f"CAST(list_sum(t[{i + 1}]) AS INTEGER) AS {name}_total" for i, name in enumerate(("vector_rag", "graph_rag", "hybrid_rag")))},
            {", ".join(f"CAST(t[{i + 1}][{j + 1}] AS INTEGER) AS {name}_{d}" for i, name in enumerate(("vector_rag", "graph_rag", "hybrid_rag")) for j, d in enumerate(("relevance", "constraint_handling", "evidence_grounding", "reasoning_transparency", "hallucination_resistance")))},
            'verdict ' || doc_id AS verdict, CAST(NULL AS VARCHAR) AS error FROM s"""
ORACLES["cypher_path"] = f"WITH RECURSIVE {GRAPH}, b AS (SELECT subject_id AS x, object_id AS y, relation FROM edges UNION SELECT object_id, subject_id, relation FROM edges), start AS (SELECT 'region:' || n_regionkey AS id FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_custkey = 1), walk AS (SELECT id AS node, 0 AS hops, [id] AS ids, CAST([] AS VARCHAR[]) AS rels FROM start UNION ALL SELECT y, hops + 1, list_append(ids, y), list_append(rels, '[' || relation || ']') FROM walk JOIN b ON x = node WHERE hops < 3 AND NOT list_contains(ids, y)), best AS (SELECT * FROM walk WHERE node = 'customer:1' ORDER BY hops, list_reverse(ids) LIMIT 1), steps AS (SELECT unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM best) SELECT (SELECT string_agg(name, ' > ' ORDER BY i) FROM steps JOIN plain USING (id)) AS chain, array_to_string(rels, ',') AS rels, CAST(hops AS INTEGER) AS hops FROM best"
ORACLES["cypher_isolated"] = f"WITH {GRAPH}, used AS (SELECT * FROM edges WHERE relation IN ('PLACED', 'IN_REGION')) SELECT type AS t, name AS a FROM plain WHERE id NOT IN (SELECT subject_id FROM used UNION SELECT object_id FROM used)"
ORACLES["cypher_pairs"] = "SELECT x.r_name AS a, y.r_name AS b FROM region x JOIN region y ON 'region:' || x.r_regionkey < 'region:' || y.r_regionkey AND NOT contains(lower(x.r_name), lower(y.r_name)) ORDER BY a, b LIMIT 20"
ORACLES["cypher_unaliased"] = f"WITH {GRAPH} SELECT o.name AS \"b.name\", '[' || relation || ']' AS r, s.name AS \"a.name\" FROM edges e JOIN nodes s ON s.id = subject_id JOIN nodes o ON o.id = object_id WHERE relation = 'IN_NATION' ORDER BY o.name DESC, e.subject_id, e.relation, e.object_id LIMIT 30"
ORACLES["cypher_two_hops"] = f"WITH {REPLIES}, both_ways AS (SELECT subject_id AS x, object_id AS y, subject_id AS s, relation AS r, object_id AS o FROM replies WHERE subject_id <> object_id UNION ALL SELECT object_id, subject_id, subject_id, relation, object_id FROM replies WHERE subject_id <> object_id UNION ALL SELECT subject_id, object_id, subject_id, relation, object_id FROM replies WHERE subject_id = object_id), kept AS (SELECT * FROM both_ways WHERE r = (SELECT min(relation) FROM replies)) SELECT a.x AS a, count(*) AS n FROM kept a JOIN kept b ON a.y = b.x AND (a.s <> b.s OR a.o <> b.o) GROUP BY a.x"
