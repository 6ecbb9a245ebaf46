"""Sources, sinks, providers, whole pipelines, the stream, and the entry module."""

from __future__ import annotations

import json

import numpy as np
import pytest

from ragloom.functions import ontology as O
from ragloom.operators import evaluation, projection
from ragloom.plans import ask, catalogue
from ragloom.plans import providers as P
from ragloom.sources import readers, sinks
from ragloom.streaming.ingest import chunk_stream

CORPUS = "S1, Ep1\nWinter\nNilo Thorn rules Westmoor. Rufo Thorn is his son.\nS1, Ep2\nRoad\nJorun killed Nilo Thorn in the capital."


def replies():
    """A model that reads two sentences; a closure, so that workers need no test module."""

    def reply(text: str) -> str:
        import json

        found = []
        if "rules" in text:
            found += [{"subject": "Nilo Thorn", "subject_type": "Character", "relation": "RULES", "object": "Westmoor", "object_type": "Location"}, {"subject": "Nilo Thorn", "subject_type": "Character", "relation": "PARENT_OF", "object": "Rufo Thorn", "object_type": "Character"}]
        if "killed" in text:
            found.append({"subject": "Jorun", "subject_type": "Character", "relation": "KILLED", "object": "Nilo Thorn", "object_type": "Character", "description": "a death"})
        return json.dumps({"triples": found})

    return reply


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus") / "corpus.txt"
    path.write_text(CORPUS)
    chunks = ask.build_chunks(readers.lines(spark, str(path)))
    own = P.Providers(extract=replies(), query=lambda q, s, linked, e: "MATCH (k)-[r:KILLED]->(v) RETURN k.name AS killer, v.name AS victim, r")
    entities, resolved = ask.resolve_entities(ask.extract_triples(chunks, own), own)
    nodes, edges, drops = ask.build_graph(entities, resolved)
    return own, ask.build_vectors(chunks, own).cache(), nodes.cache(), edges.cache(), drops


def test_graph_from_text(built):
    _, store, nodes, edges, drops = built
    assert store.count() == 2 and drops.count() == 0
    assert {r["id"] for r in nodes.collect()} == {"character:nilo-thorn", "character:rufo-thorn", "character:jorun", "location:westmoor"}
    assert {(r["relation"], r["count"]) for r in edges.collect()} == {("RULES", 1), ("PARENT_OF", 1), ("KILLED", 1)}


def test_three_ways_to_ask(spark, built):
    own, store, nodes, edges, _ = built
    found = ask.compare(store, nodes, edges, "Who killed Nilo Thorn?", own)
    assert found["Graph"].rows == ['killer="Jorun"  victim="Nilo Thorn"  r="[KILLED: a death]"']
    assert found["Graph"].evidence == [{"chunk_id": "s01e02_0001", "episode": "s01e02", "description": "a death"}]
    assert [e["name"] for e in found["Graph"].linked] == ["Nilo Thorn"] and len(found["Graph"].subgraph) == 3
    assert found["Vector"].evidence[0]["document_id"] == "s01e02" and found["Graph"].evidence
    assert len(found["Hybrid"].rows) == len(found["Graph"].rows) + len(found["Vector"].rows)
    asked = [{"id": "q1", "category": "c", "question": "Who killed Nilo Thorn?"}, {"id": "q2", "category": "d", "question": "Who?"}]
    table = ask.evaluate_batch(spark, asked, store, nodes, edges, own, category="c")
    row = table.first()
    assert tuple(table.columns) == evaluation.COLUMNS and len(table.columns) == 27 and table.count() == 1
    assert (row["index"], row["id"], row["category"], row["error"]) == (1, "q1", "c", None) and row["verdict"]
    assert row["graph_rag_total"] == sum(row[f"graph_rag_{d}"] for d in evaluation.DIMENSIONS)
    assert evaluation.scoreboard(evaluation.table_scores(table)).count() == 3
    bad = P.Providers(**{**own.__dict__, "judge": lambda q, shown: {"verdict": "none"}})
    failed = ask.evaluate_batch(spark, asked, store, nodes, edges, bad, limit=1).first()
    assert "relevance" in failed["error"] and failed["graph_rag_total"] is None and failed["graph_answer"]
    events = {e["type"]: e["payload"] for e in map(json.loads, sinks.events(ask.ask_events(store, nodes, edges, "Who killed Nilo Thorn?", own, spark.createDataFrame([("1", "k", "Who killed Nilo Thorn?")], "id string, category string, question string"))))}
    assert events["result"]["category"] == "k" and set(events["scatter"]["query"]) == {"x", "y"} and events["scatter"]["points"][0]["label"]
    kinds = [json.loads(line)["type"] for line in sinks.events(ask.ask_events(store, nodes, edges, "Who killed Nilo Thorn?", own))]
    assert kinds[0] == "stage" and kinds[-1] == "result"


def test_refusal_and_repair(built):
    own, _, nodes, edges, _ = built
    refused = ask.ask_graph(nodes, edges, "q", P.Providers(query=lambda q, s, linked, e: "MATCH (n) DELETE n"))
    assert refused.error and not refused.rows
    asked = []
    replies_ = iter(["MATCH (n", "MATCH (n) RETURN n.nothing AS a", "MATCH (n:Location) RETURN n.name AS a"])
    mending = P.Providers(query=lambda q, s, linked, before: asked.append((linked, before)) or next(replies_))
    found = ask.ask_graph(nodes, edges, "Where is Westmoor?", mending)
    assert found.rows == ['a="Westmoor"'] and len(asked) == 3 and not found.error
    assert asked[0][0] == [{"id": "location:westmoor", "name": "Westmoor", "type": "Location"}] and asked[0][1] is None
    assert asked[1][1]["query"] == "MATCH (n" and "nothing" in asked[2][1]["error"]
    lost = ask.ask_graph(nodes, edges, "q", P.Providers(query=lambda q, s, linked, before: "MATCH (n"))
    assert "3 times" in lost.text and lost.error and not lost.rows


def test_groups_of_a_provider_are_merged(spark, built):
    own, *_ = built
    chunks = spark.createDataFrame([("d1", "d1_0001", "t", "Nilo Thorn rules Westmoor."), ("d2", "d2_0001", "t", "killed")], "document_id string, chunk_id string, title string, text string")
    grouping = P.Providers(extract=own.extract, groups=lambda kind, names: [{"canonical": "Nilo Thorn", "members": ["Jorun", " nilo thorn", "Nobody"]}] if kind == "Character" else [])
    entities, resolved = ask.resolve_entities(ask.extract_triples(chunks, grouping), grouping)
    assert {r["canonical_name"]: sorted(r["merged_ids"]) for r in entities.collect()}["Nilo Thorn"] == ["character:jorun", "character:nilo-thorn"]
    assert {r["relation"] for r in resolved.collect()} == {"RULES", "PARENT_OF"}  # the killing is a loop now


def test_providers_of_one_completion_service():
    asked = []

    def complete(instructions, text, temperature=0.0, schema=None):
        asked.append((schema, temperature))
        return {"decisions": '```json\n[{"surface": "A"}]\n```', "groups": "broken", "mentions": '{"mentions": ["A"]}', None: "```cypher\nMATCH (n) RETURN n.name\n```", "evaluation": '{"verdict": "v"}', "triples": "[]"}[schema]

    p = P.completing(complete)
    assert p.decide(["A"]) == [{"surface": "A"}] and p.groups("House", ["A"]) == [] and p.mentions("A?") == ["A"]
    assert p.query("q", "schema", [{"name": "A", "type": "House"}], None) == "MATCH (n) RETURN n.name"
    assert p.judge("q", {})["verdict"] == "v" and p.answer("q", ["e"]).startswith("```") and asked[-1] == (None, 0.2)
    assert P.pooled(lambda x: 1 // x, [1, 0, 1]) == [1, None, 1]


def test_judge_sees_what_is_displayed():
    passage, fact = {"document_id": "d", "chunk_id": "k", "snippet": "s", "score": 1.0}, {"chunk_id": "k", "episode": "e", "description": "x"}
    assert evaluation.shown_to_judge("vector", "a", ["row"], [passage]) == {"answer": "a", "evidence": [{"document_id": "d", "chunk_id": "k", "snippet": "s"}]}
    assert evaluation.shown_to_judge("graph", "a", ["row"], [fact], "q")["evidence"] == [{"episode": "e", "chunk_id": "k", "description": "x"}]
    assert set(evaluation.shown_to_judge("hybrid", "a", [], [fact, passage])) == {"answer", "graph_evidence", "text_evidence"}
    with pytest.raises(ValueError, match="relevance"):
        evaluation.checked_scores({d: 3 for d in evaluation.DIMENSIONS})


def test_build_pipeline(spark, built, tmp_path):
    own, *_ = built
    (tmp_path / "corpus.txt").write_text(CORPUS)
    stores = ask.build_pipeline(readers.lines(spark, f"{tmp_path}/corpus.txt"), own)
    assert stores["chunks"].count() == stores["vectors"].count() == 2 and stores["nodes"].count() == 4 and stores["edges"].count() == 3
    sinks.entities(stores["entities"], f"{tmp_path}/entities.json")
    assert readers.entities(spark, f"{tmp_path}/entities.json", O.DEFAULT.node_types).count() == 4
    assert json.loads((tmp_path / "entities.json").read_text())["count"] == 4


def test_embedding_ignores_batches(spark):
    rows = spark.createDataFrame([(i, f"term{i} word") for i in range(150)], "i int, t string")
    one = {r["i"]: r["embedding"] for r in P.embed(rows.coalesce(1), "t").collect()}
    assert one == {r["i"]: r["embedding"] for r in P.embed(rows.repartition(5), "t").collect()}


def test_sinks(spark, built, tmp_path):
    _, store, nodes, edges, _ = built
    sinks.graph(nodes, edges, f"{tmp_path}/graph", reset=False)
    sinks.graph(nodes, edges, f"{tmp_path}/graph")
    assert sorted(p.name for p in (tmp_path / "graph").iterdir()) == ["edges", "nodes"]
    sinks.graph(nodes.limit(1).withColumn("mentions", nodes["mentions"] + 10), edges.limit(0), f"{tmp_path}/graph", reset=False)
    again = spark.read.parquet(f"{tmp_path}/graph/nodes")
    assert again.count() == nodes.count() and again.where("mentions > 10").count() == 1
    assert spark.read.parquet(f"{tmp_path}/graph/edges").count() == edges.count()
    sinks.vector_store(store, f"{tmp_path}/vectors", "hashed", 256)
    assert readers.vector_store(spark, f"{tmp_path}/vectors").count() == 2
    sinks.vector_store(store, f"{tmp_path}/wrong", "hashed", 255)
    with pytest.raises(Exception, match="length"):
        readers.vector_store(spark, f"{tmp_path}/wrong").collect()
    rows = spark.createDataFrame([('a "b"', "x,\n y")], "one string, two string")
    sinks.spreadsheet(rows, f"{tmp_path}/report.csv")
    assert (tmp_path / "report.csv").read_bytes() == b'\xef\xbb\xbfone,two\r\n"a ""b""","x, y"\r\n'
    sinks.csv(rows, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True, escape='"').first()["one"] == 'a "b"'
    sinks.json_lines(rows.withColumn("ord", rows["one"]), f"{tmp_path}/json", "ord")
    assert readers.json_lines(spark, f"{tmp_path}/json", "one string, two string").first()["two"] == "x,\n y"


def test_sources(spark, tmp_path):
    (tmp_path / "questions.json").write_text(json.dumps({"questions": [{"id": "1", "question": "Who?"}, {"id": "2", "question": " "}]}))
    assert [r["id"] for r in readers.questions(spark, f"{tmp_path}/questions.json").collect()] == ["1"]
    assert readers.questions(spark, f"{tmp_path}/missing.json", strict=False).collect() == []
    (tmp_path / "entities.json").write_text(json.dumps({"count": 2, "entities": [{"id": "a", "type": "House"}, {"id": "b", "type": "Dragon"}]}))
    assert [r["id"] for r in readers.entities(spark, f"{tmp_path}/entities.json", O.DEFAULT.node_types).collect()] == ["a"]
    (tmp_path / "meta.json").write_text(json.dumps({"embedding_model": "m", "dim": 2, "count": 2, "chunks": [{"chunk_id": "a"}, {"chunk_id": "b"}]}))
    (tmp_path / "v.bin").write_bytes(np.array([[1, 2], [3, 4]], "<f4").tobytes())
    store = readers.split_vector_store(spark, f"{tmp_path}/meta.json", f"{tmp_path}/v.bin", 2)
    assert [(r["chunk_id"], r["embedding"]) for r in store.orderBy("ord").collect()] == [("a", [1.0, 2.0]), ("b", [3.0, 4.0])]
    (tmp_path / "env").write_text("# note\nRAGLOOM_A='x y'\nRAGLOOM_B=2\n")
    assert readers.settings(f"{tmp_path}/env") == {"RAGLOOM_A": "x y", "RAGLOOM_B": "2"}


def test_projection_is_centred_and_signed(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)) * [5, 3, 1, 0.5, 0.1] + 7
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, embedding array<double>")
    got = projection.fit(rows).project(rows).orderBy("i").select("x", "y").toPandas().to_numpy()
    axes = np.linalg.svd(x - x.mean(0))[2][:2]
    axes *= np.sign(axes[np.arange(2), np.abs(axes).argmax(1)])[:, None]
    assert np.allclose(got, (x - x.mean(0)) @ axes.T, atol=1e-8)


def test_stream_takes_new_files_once(spark, tmp_path):
    source = f"{tmp_path}/in"
    for part in (["One. Two."], ["Three."]):
        spark.createDataFrame([(p, p) for p in part], "id string, text string").write.mode("append").parquet(source)
        for _ in range(2):
            chunk_stream(spark, source, "id string, text string", f"{tmp_path}/out", f"{tmp_path}/state", "id", "text").awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["One. Two.", "Three."]


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalogue.ORACLES) >= len(catalogue.QUERIES) - 1
