"""Triples, resolution and graph queries on a small hand-built graph."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from ragloom.functions import ontology as O
from ragloom.operators import evaluation, graph, linking, resolve, triples
from ragloom.plans import cypher, derived
from ragloom.sources import workers

NODES = [("c:nilo", "Nilo Thorn", "Character"), ("c:rufo", "Rufo Thorn", "Character"), ("c:ana", "Ana Thorn", "Character"), ("h:thorn", "House Thorn", "House"), ("c:joru", "Jorun", "Character"), ("c:lone", "Lone", "Character"), ("l:wm", "Westmoor", "Location")]
EDGES = [("c:nilo", "PARENT_OF", "c:rufo"), ("c:nilo", "PARENT_OF", "c:ana"), ("c:rufo", "MEMBER_OF_HOUSE", "h:thorn"), ("c:joru", "KILLED", "c:nilo"), ("c:nilo", "RULES", "l:wm"), ("c:joru", "KILLED", "c:joru"), ("c:rufo", "SIBLING_OF", "c:ana"), ("c:ana", "SIBLING_OF", "c:rufo")]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(*n, []) for n in NODES], "id string, name string, type string, aliases array<string>").withColumn("mentions", F.lit(1).cast("long"))


@pytest.fixture(scope="module")
def edges(spark):
    proof = lambda e: (["k1", "k2"], ["s1"], ["at dawn"]) if e[1:] == ("KILLED", "c:nilo") else (["k1"], ["s2"], [])
    return spark.createDataFrame([(*e, 1, *proof(e)) for e in EDGES], "subject_id string, relation string, object_id string, count long, chunk_ids array<string>, episodes array<string>, descriptions array<string>")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("MATCH (k)-[:KILLED]->(v {name:'Nilo Thorn'}) RETURN k.name AS a", [("Jorun",)]),
        ("MATCH (a {name:'Rufo Thorn'})-[:SIBLING_OF]-(s) RETURN DISTINCT s.name AS a", [("Ana Thorn",)]),
        ("MATCH (a)-[r:KILLED]->(a) RETURN a.name AS a", [("Jorun",)]),
        ("MATCH (a)-[:SIBLING_OF]->(b)-[:SIBLING_OF]->(a) RETURN a.name AS a, b.name AS b", [("Ana Thorn", "Rufo Thorn"), ("Rufo Thorn", "Ana Thorn")]),
        ("MATCH (x)-[:KILLED]->(v) WITH DISTINCT v MATCH (v)-[r:KILLED|PARENT_OF]->(o) RETURN v.name AS a, count(r) AS c ORDER BY c DESC LIMIT 10", [("Jorun", 2), ("Nilo Thorn", 2)]),
        ("MATCH (a)-[r]->(o) WHERE NOT o:Character AND r.count = 1 RETURN type(r) AS t, o.name AS o", [("MEMBER_OF_HOUSE", "House Thorn"), ("RULES", "Westmoor")]),
        ("MATCH (n) WHERE n.name =~ '(?i).*thorn.*' AND n.type <> 'House' RETURN count(*) AS n", [(3,)]),
        ("MATCH (n) WHERE toLower(n.name) CONTAINS 'westm' OR n.id IN ['c:lone'] RETURN n.name AS a", [("Lone",), ("Westmoor",)]),
        ("MATCH p = shortestPath((a {name:'House Thorn'})-[*..6]-(b {name:'Jorun'})) RETURN p", [("House Thorn -> Rufo Thorn -> Nilo Thorn -> Jorun",)]),
        ('MATCH p = shortestPath((a:Entity {name:"House Thorn"})-[*..6]-(b:Entity {name:"Jorun"})) RETURN [n IN nodes(p) | n.name] AS chain, relationships(p) AS rels', [(["House Thorn", "Rufo Thorn", "Nilo Thorn", "Jorun"], ["[MEMBER_OF_HOUSE]", "[PARENT_OF]", "[KILLED: at dawn]"])]),
        ("MATCH (a {name:'Ana Thorn'}), (b {name:'Westmoor'}), p = shortestPath((a)-[*..6]-(b)) RETURN length(p) AS n, a.name, [x IN relationships(p) | type(x)] AS t", [(2, "Ana Thorn", ["PARENT_OF", "RULES"])]),
        ("MATCH p = shortestPath((a {name:'Lone'})-[*..6]-(b {name:'Jorun'})) RETURN p", []),
        ("MATCH (a)-[:KILLED]->(b)-[:KILLED]->(a) RETURN a.name, b.name", []),
        ("MATCH (a {name:'Jorun'})-[:KILLED]-(b)-[:KILLED]-(c) RETURN b.name, c.name", [("Jorun", "Nilo Thorn")]),
        ("MATCH (a {name:'Jorun'})-[:KILLED]->(b) RETURN b.name, a ORDER BY b.name DESC LIMIT 1", [("Nilo Thorn", "Jorun")]),
        ("MATCH (a)-[r:KILLED]->(b) RETURN b.name, r LIMIT 5", [("Jorun", "[KILLED]"), ("Nilo Thorn", "[KILLED: at dawn]")]),
        ("MATCH (a)-[r:KILLED]->(b) RETURN DISTINCT a.name, r.episodes AS e, r.descriptions[0] AS d ORDER BY d DESC LIMIT 1", [("Jorun", ["s1"], "at dawn")]),
        ("MATCH (n) WHERE NOT (n)--() RETURN n.type AS t, n.name AS a", [("Character", "Lone")]),
        ("MATCH (n:Character) WHERE (n)-[:KILLED]->(:Character) OR (n)<-[:PARENT_OF]-() RETURN n.name", [("Ana Thorn",), ("Jorun",), ("Rufo Thorn",)]),
        ("MATCH (a:Character), (b:Character) WHERE a.id < b.id AND toLower(a.name) CONTAINS toLower('o T') AND b.name STARTS WITH 'R' RETURN a.name AS a, b.name AS b LIMIT 20", [("Nilo Thorn", "Rufo Thorn")]),
        ("MATCH (a)-[r:PARENT_OF]->(b) WITH a, count(r) AS c, collect(b.name) AS names WHERE c > 1 RETURN a.name, c, names[0..1] AS n", [("Nilo Thorn", 2, ["Ana Thorn"])]),
        ("MATCH (a)-[r:PARENT_OF|KILLED]->() RETURN a.name, count(DISTINCT r) AS n, collect(type(r)) AS t ORDER BY a.name LIMIT 1", [("Jorun", 2, ["KILLED", "KILLED"])]),
        ("MATCH (n:Entity) WHERE n.name IS NOT NULL AND n:Entity RETURN count(n) AS n", [(7,)]),
    ],
)
def test_cypher(nodes, edges, query, want):
    assert rows(cypher.run(query, nodes, edges)) == want


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("MATCH (a)-[r:KILLED]->(b) RETURN b.name, r ORDER BY b.name DESC LIMIT 5", [("k1", "s1", "at dawn"), ("k2", "s1", "at dawn")]),
        ("MATCH (a)-[r:RULES]->(b) RETURN a.name, collect(r) AS rs", [("k1", "s2", "")]),
        ("MATCH p = shortestPath((a {name:'Westmoor'})-[*..6]-(b {name:'Jorun'})) RETURN p", [("k1", "s2", ""), ("k2", "s1", "at dawn")]),
        ("MATCH (a)-[r:KILLED]->(b) RETURN b.name", []),
    ],
)
def test_evidence_comes_from_the_rows(nodes, edges, query, want):
    assert rows(cypher.run_with_evidence(query, nodes, edges, 10)[1]) == want


@pytest.mark.parametrize("query", ["CREATE (n)", "MATCH (n) DELETE n", "MATCH (n) SET n.x = 1 RETURN n.x", "CALL gds.run()", "MATCH (n) RETURN n.name; DROP x", "", "MATCH (a)<-[r]->(b) RETURN a.name", "MATCH (n) RETURN apoc(n.name)", "MATCH (n", "MATCH (n) RETURN", "MATCH (n) RETURN n.nothing", "MATCH (n) RETURN m.name", "MATCH (n) RETURN n.name LIMIT x"])
def test_only_reading_is_accepted(nodes, edges, query):
    with pytest.raises(cypher.QueryError):
        cypher.run(query, nodes, edges)


def test_only_writing_is_a_write():
    assert cypher.writes("MATCH (n) SET n.x = 1 RETURN n") and cypher.writes("call db.labels()")
    assert not cypher.writes("MATCH (n) WHERE n.name = 'set delete' RETURN n.name AS created LIMIT") and not cypher.writes("MATCH (n")


def test_words_in_strings_are_harmless(nodes, edges):
    assert rows(cypher.run("MATCH (n) WHERE n.name = 'set delete' RETURN n.name AS a", nodes, edges)) == []


def test_patterns(nodes, edges):
    assert rows(graph.isolated(nodes, edges).select("id")) == [("c:lone",)]
    assert graph.undirected(edges).count() == 2 * len(EDGES) - 1
    assert rows(graph.chain(edges, ["PARENT_OF", "MEMBER_OF_HOUSE"])) == [("c:nilo", "c:rufo", "h:thorn")]
    assert rows(graph.subgraph(edges, nodes.where("id = 'h:thorn'"))) == [("c:rufo", "MEMBER_OF_HOUSE", "h:thorn")]
    assert rows(graph.shortest_path(edges, "c:lone", "c:nilo")) == []
    assert rows(graph.chain_counts(edges, ["PARENT_OF", "<PARENT_OF"])) == [("c:nilo", "c:nilo", 2)]
    assert rows(graph.two_hop_cycles(edges, "KILLED")) == [] and len(rows(graph.two_hop_cycles(edges, "SIBLING_OF"))) == 2
    probes = graph.inspect(nodes, edges, O.DEFAULT)
    assert probes["violations"].count() == 0 and probes["self_loops"].count() == 1 and probes["isolated"].count() == 1


def test_names_within_names_equal_brute_force(spark):
    names = ["Ana", "Ana Thorn", "Thorn", "an", "Mor-Ana", "", "??", "Ana  Thorn", "thorny", "Nilo"]
    own = spark.createDataFrame([(f"{i:02}", n, "Character") for i, n in enumerate(names)] + [("99", "Ana", "House")], "id string, name string, type string")
    want = sorted((a, b) for i, a in enumerate(names) for b in names[i + 1 :] if b.lower() in a.lower())
    assert rows(graph.names_within_names(own, "Character", 100)) == want


def test_path_of_seven_hops_is_too_long(spark):
    chain = spark.createDataFrame([(f"n{i}", "R", f"n{i + 1}", 1) for i in range(7)], "subject_id string, relation string, object_id string, count long")
    assert graph.shortest_path(chain, "n0", "n6").count() == 7
    assert graph.shortest_path(chain, "n0", "n7").count() == 0


TRIPLES = [(0, "Nilo Thorn", "Character", "PARENT_OF", "Rufo", "Character", "x", "d1", "k1"), (1, "Nilo Thorn", "Character", "PARENT_OF", "Rufo", "Character", "", "d1", "k1"), (2, "Nilo Thorn", "House", "PARENT_OF", "Rufo", "Character", None, "d2", "k2"), (3, "Nilo's sister", "Character", "PARENT_OF", "Rufo", "Character", "", "d", "k"), (4, "Dawn's Guard", "Group", "KILLED", "Rufo", "Character", "", "d", "k"), (5, "deserter", "Character", "KILLED", "Rufo", "Character", "", "d", "k"), (6, "Rufo", "Character", "KILLED", "N/A", "Character", "", "d", "k"), (7, "Rufo", "Character", "LOVES", "Nilo Thorn", "Character", "", "d", "k")]


def test_validation_and_reconciliation(spark):
    raw = spark.createDataFrame(TRIPLES, "ord long, subject string, subject_type string, relation string, object string, object_type string, description string, document_id string, chunk_id string")
    assert sorted(r["ord"] for r in triples.validate(raw).collect()) == [0, 1, 4]
    nodes = spark.createDataFrame([("Nilo Thorn", "Character"), ("Rufo", "Character"), ("Dawn's Guard", "Group")], "id string, type string")
    marked = triples.with_drop_reason(raw.withColumnsRenamed({"subject": "subject_id", "object": "object_id"}), nodes)
    counts = {r["drop_reason"]: r["count"] for r in marked.groupBy("drop_reason").count().collect()}
    assert sum(counts.values()) == len(TRIPLES) and counts["unknown_relation"] == 1 and counts["unknown_id"] == 3
    edge = [r for r in graph.aggregate_edges(marked.where("drop_reason is null")).collect() if r["relation"] == "PARENT_OF"]
    assert len(edge) == 1 and edge[0]["count"] == 3 and edge[0]["chunk_ids"] == ["k1", "k2"] and edge[0]["descriptions"] == ["x"]


def test_votes_overrides_and_merges(spark):
    found = resolve.mentions(spark.createDataFrame([(0, "A", "House"), (1, "A", "Character"), (2, "A", "Bogus"), (3, "halfhand", "House"), (4, "a ", "House"), (5, "nobody", "House")], "ord long, surface string, type string"))
    kinds = {r["surface"]: r["type"] for r in found.collect()}
    assert kinds["A"] == "House"  # the first seen of equals
    ents = {r["id"]: r for r in resolve.entities(resolve.decide(found)).collect()}
    assert ents["house:a"]["aliases"] == ["A", "a "] and ents["house:a"]["mentions"] == 4
    assert ents["character:qhorin-halfhand"]["canonical_name"] == "Qhorin Halfhand" and len(ents) == 2
    three = spark.createDataFrame([("x", "X", "House", ["X"], 1), ("y", "Y", "House", ["Y"], 5), ("z", "Z", "House", ["Z"], 2)], "id string, canonical_name string, type string, aliases array<string>, mentions long")
    merged = resolve.merge(three, spark.createDataFrame([("x", "y"), ("y", "z")], "a string, b string")).collect()
    assert [(r["id"], r["mentions"], r["aliases"]) for r in merged] == [("y", 8, ["Y", "Z", "X"])]


def test_chosen_names_win_merges(spark):
    three = spark.createDataFrame([("x", "X", "House", ["X"], 1), ("y", "Y", "House", ["Y"], 5), ("z", "Z", "House", ["Z"], 2)], "id string, canonical_name string, type string, aliases array<string>, mentions long")
    merge = lambda name: [(r["id"], r["canonical_name"]) for r in resolve.merge(three, spark.createDataFrame([("x", "y", name)], "a string, b string, canonical string")).collect() if r["id"] != "z"]
    assert merge(" x") == [("x", " x")] and merge("Great Y") == [("y", "Great Y")] and merge("") == [("y", "Y")]
    top = [tuple(r) for r in resolve.summary(three, 1).collect()]
    assert sorted(top) == [("top", "[House] Y", 5, ""), ("total", "entities", 3, ""), ("type", "House", 3, "")]


def test_linking(spark, nodes):
    asked = spark.createDataFrame([("nilo",), ("House (Thorn)",), ("???",), ("zzz",)], "mention string")
    assert sorted((r["mention"], r["id"]) for r in linking.link(asked, linking.index(nodes)).collect()) == [("House (Thorn)", "h:thorn"), ("nilo", "c:nilo")]


def test_replies(spark):
    replies = ['[{"subject":"A"}]', '{"triples":[{"subject":"B"}]}', '```json\n[{"subject":"C"}]\n```', "[{", "", None, '{"other":[]}']
    got = spark.createDataFrame([(r,) for r in replies], "r string").select(triples.parse_reply(F.col("r"), "triples", triples.TRIPLE).alias("t")).collect()
    assert [[x["subject"] for x in r["t"]] for r in got] == [["A"], ["B"], ["C"], [], [], [], []]


def test_evaluation(spark):
    scores = spark.createDataFrame([("q", s, 2, 1, 1, 1, n, None) for s, n in (("Vector", 1), ("Graph", 1), ("Hybrid", 0))] + [("r", "Vector", 0, 0, 0, 0, 0, "failed")], f"question string, system string, {', '.join(f'{d} int' for d in evaluation.DIMENSIONS)}, error string")
    totals = evaluation.with_total(evaluation.validated(scores))
    assert evaluation.wins(totals.where("question = 'q'"), "question").first()["winner"] == "tie (Vector/Graph)"
    assert {r["system"]: r["mean"] for r in evaluation.scoreboard(totals).collect()} == {"Vector": 6.0, "Graph": 6.0, "Hybrid": 5.0}
    with pytest.raises(Exception, match="rubric"):
        evaluation.validated(scores.withColumn("relevance", F.lit(3))).collect()


@pytest.mark.parametrize("ways", ["--", "->", "<-"])
def test_last_hops_that_are_only_counted_make_no_rows(spark, ways):
    rng = random.Random(6)
    links = {(f"n{rng.randrange(12)}", rng.choice("RS"), f"n{rng.randrange(12)}") for _ in range(60)} | {("n3", "R", "n3"), ("hub", "R", "n1")}
    links |= {(f"m{i}", "R", "hub") for i in range(200)}
    edges = spark.createDataFrame(sorted(links), "subject_id string, relation string, object_id string")
    names = sorted({x for s, _, o in links for x in (s, o)} - {"n7"}) + ["alone"]
    nodes = spark.createDataFrame([(n, n, "M" if n[0] == "m" else "N") for n in names], "id string, name string, type string")
    left, right = {"--": ("-", "-"), "->": ("-", "->"), "<-": ("<-", "-")}[ways]

    def steps(at):
        for x in links:
            if x[1] == "R" and ways != "<-" and x[0] == at:
                yield x, x[2]
            if x[1] == "R" and ways != "->" and x[2] == at and (ways == "<-" or x[0] != x[2]):
                yield x, x[0]

    def paths(a, used, hops):
        if not hops:
            yield used
        for e, b in steps(a) if hops else ():
            if e not in used and b in names:
                yield from paths(b, [*used, e], hops - 1)

    hop = f"{left}[:R]{right}"
    for hops in (1, 2, 3):
        chain = "".join(f"{hop}(v{i})" for i in range(hops))
        want = {a: n for a in names if (n := sum(1 for _ in paths(a, [], hops)))}
        found = cypher.run(f"MATCH (a){chain} RETURN a.id AS a, count(*) AS n", nodes, edges)
        assert dict(map(tuple, found.collect())) == want
        assert "_paths" in found._jdf.queryExecution().optimizedPlan().toString()
        assert cypher.run(f"MATCH (a){chain} RETURN count(*) AS n", nodes, edges).first()["n"] == sum(want.values())
    # What a last hop is needed for keeps its rows.
    for last in ("count(v1)", "min(v1.id)", "count(*) AS k, v1.id"):
        assert "_paths" not in cypher.run(f"MATCH (a){hop}(v0){hop}(v1) RETURN a.id AS a, {last}", nodes, edges)._jdf.queryExecution().optimizedPlan().toString()
    assert cypher.run(f"MATCH (a){hop}(v0){hop}(v1:Nothing) RETURN count(*) AS n", nodes, edges).first()["n"] == 0


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_search_by_levels_copies_no_edges_and_leaves_no_shuffles(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(13)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] * 2 + [(5, 5), (None, 5), (5, None)] + [(1, i) for i in range(400, 450)]
    near: dict[int, set[int]] = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want, now = {1: (0, None)}, [1]
    for level in range(1, 7):
        step = {}
        for a in sorted(now, reverse=True):
            step |= {b: (level, a) for b in near.get(a, ()) if b not in want}
        want, now = want | step, list(step)
    files = lambda: [f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split() if "/shuffle_" in f]
    before, setting = set(files()), spark.conf.get(workers.CLEAR, None)
    edges = spark.createDataFrame(links, "subject_id long, object_id long").withColumn("relation", F.lit("R"))
    monkeypatch.setattr(graph, "undirected", None)
    found = graph.hop_distances(edges, 1)
    left = sum(os.path.getsize(f) for f in set(files()) - before if f.endswith(".data"))
    assert left < 3000 and spark.conf.get(workers.CLEAR, None) == setting
    assert {r["node"]: (r["hops"], r["parent"]) for r in found.collect()} == want and max(h for h, _ in want.values()) > 3


def test_links_have_the_ends_of_the_derived_edges(spark):
    folder = "/root/testdata/sf0.001"
    by_name = graph.hop_distances(derived.edges(spark, folder), "customer:1")
    by_number = graph.hop_distances(derived.links(spark, folder), derived.number("customer", 1))
    kinds = F.array(*[F.lit(k) for k in derived.KINDS])
    name = F.concat(F.get(kinds, F.pmod("node", F.lit(8)).cast("int")), F.lit(":"), F.floor(F.col("node") / 8).cast("string"))
    assert rows(by_number.select(name, "hops")) == rows(by_name.select("node", "hops"))
    keys = spark.createDataFrame([(5,), (-3,), (None,)], "k long")
    assert [r[0] for r in keys.select(derived.number("part", F.col("k"))).collect()] == [45, -19, None]
    with pytest.raises(Exception, match="too large"):
        keys.select(derived.number("part", F.col("k") + F.lit(1 << 60))).collect()
