"""The whole pipelines: building the stores, asking by vector, graph or both, comparing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import ontology as O
from ragloom.functions import text as T
from ragloom.functions.lexicon import DEFAULT as LEXICON
from ragloom.functions.lexicon import Lexicon
from ragloom.operators import chunking, evaluation, graph, linking, resolve, retrieval, triples
from ragloom.operators import projection as pca
from ragloom.plans import cypher
from ragloom.plans import providers as P
from ragloom.sources.workers import checkpoint

#: Attempts at a graph query that runs.
ATTEMPTS = 3


@dataclass(frozen=True)
class Answer:
    """What one method found and said."""

    method: str
    text: str
    rows: list[str]
    evidence: list[dict]
    query: str = ""
    error: str = ""
    linked: tuple[dict, ...] = ()
    subgraph: tuple[dict, ...] = ()


def build_chunks(lines: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """``document_id, chunk_id, title, text`` from a corpus of lines."""
    docs = chunking.split_documents(lines).withColumn("_doc", F.concat("source", F.lit("#"), "segment"))
    chunks = chunking.chunk_texts(docs.select("_doc", "body"), "_doc", "body", size, overlap).withColumnRenamed("document_id", "_doc")
    own = chunks.join(docs.select("_doc", "document_id", "title"), "_doc")
    return own.select("document_id", T.chunk_id(F.col("document_id"), F.col("chunk_no")).alias("chunk_id"), "title", "text")


def build_vectors(chunks: DataFrame, providers: P.Providers = P.DEFAULT) -> DataFrame:
    """Non-blank chunks with ``ord``, hash and embedding."""
    rows = chunks.where(T.compact(F.col("text")) != "").withColumns({"text_hash": T.text_hash(F.col("text")), "_input": T.embedding_input(F.col("title"), F.col("text")), "ord": F.struct("document_id", "chunk_id")})
    return P.embed(rows, "_input", providers).drop("_input")


def extract_triples(chunks: DataFrame, providers: P.Providers = P.DEFAULT, ontology: O.Ontology = O.DEFAULT) -> DataFrame:
    """Valid triples of all chunks with their provenance and order."""
    found = P.extract(chunks, providers).select("document_id", "chunk_id", F.posexplode(triples.parse_reply(F.col("reply"), "triples", triples.TRIPLE)).alias("place", "t"))
    rows = found.select("t.*", "document_id", "chunk_id", "place")
    return triples.validate(rows, ontology).withColumn("ord", F.struct("document_id", "chunk_id", "place")).drop("place")


def resolve_entities(found: DataFrame, providers: P.Providers = P.DEFAULT, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities, and triples rewritten to their ids.

    Entities that a provider groups are merged, as are those of ``pairs`` (``a, b`` of ids).
    """
    surfaces = resolve.mentions(resolve.both_ends(found))
    decided = resolve.decide(surfaces, P.decide(surfaces, providers))
    ents = checkpoint(resolve.entities(decided))
    keyed = decided.where("keep").select("surface", F.concat("kind", F.lit("::"), F.lower(T.compact(F.col("canonical")))).alias("key")).join(ents.select("key", "id"), "key")
    grouped = P.groups(ents, providers)
    if pairs is not None:
        grouped = grouped.unionByName(pairs.select("a", "b", F.lit("").alias("canonical")))
    grouped = checkpoint(grouped)
    merged = ents.withColumn("merged_ids", F.array("id")) if grouped.isEmpty() else resolve.merge(ents, grouped)
    final = merged.select(F.explode("merged_ids").alias("old"), F.col("id"), F.col("canonical_name").alias("name"), "type")
    by_surface = keyed.select("surface", F.col("id").alias("old")).join(final, "old").select("surface", "id", "name", "type")
    return merged, resolve.rewrite(found, by_surface)


def build_graph(entities: DataFrame, resolved: DataFrame, ontology: O.Ontology = O.DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges, and drop counts by reason."""
    nodes = entities.select("id", F.col("canonical_name").alias("name"), "type", "aliases", "mentions")
    marked = triples.with_drop_reason(resolved, nodes, ontology)
    drops = marked.where("drop_reason is not null and drop_reason != 'unknown_relation'").groupBy("drop_reason").count()
    return nodes, graph.aggregate_edges(marked.where("drop_reason is null")), drops


def build_pipeline(lines: DataFrame, providers: P.Providers = P.DEFAULT, ontology: O.Ontology = O.DEFAULT) -> dict[str, DataFrame]:
    """All stores of a corpus: ``chunks``, ``vectors``, ``triples``, ``entities``, ``nodes``, ``edges``, ``drops``."""
    chunks = checkpoint(build_chunks(lines))
    triples_ = checkpoint(extract_triples(chunks, providers, ontology))
    entities, resolved = resolve_entities(triples_, providers)
    nodes, edges, drops = build_graph(entities, resolved, ontology)
    return {"chunks": chunks, "vectors": build_vectors(chunks, providers), "triples": triples_, "entities": entities, "nodes": nodes, "edges": edges, "drops": drops}


def ask_vector(store: DataFrame, question: str, k: int = 10, candidates: int = 30, providers: P.Providers = P.DEFAULT, lexicon: Lexicon = LEXICON) -> Answer:
    """Retrieval by vectors; ``k`` rows come back, and the answer reads them as one context."""
    spark = store.sparkSession
    asked = spark.range(1).select(T.expanded_text(F.lit(question), lexicon).alias("q")).first()["q"]
    found = checkpoint(retrieval.retrieve(store, question, providers.embed([asked])[0], k, candidates, lexicon))
    terms = T.settled_terms(spark, question, lexicon)
    order = [F.desc("rerank_score"), F.desc("score"), "ord"]
    rows = found.orderBy(*order).select("document_id", "chunk_id", "matched_terms", F.round("rerank_score", 6).alias("score"), retrieval.evidence_snippet(F.col("text"), terms, lexicon=lexicon).alias("snippet")).collect()  # k rows
    context = T.context(found.withColumn("score", F.col("rerank_score")), [F.desc("rerank_score"), "ord"]).first()["context"]
    shown = [r["snippet"] for r in rows]
    return Answer("vector", providers.answer(question, [*shown, context] if shown else []), shown, [r.asDict() for r in rows])


def ask_graph(nodes: DataFrame, edges: DataFrame, question: str, providers: P.Providers = P.DEFAULT, ontology: O.Ontology = O.DEFAULT, limit: int = 100) -> Answer:
    """A generated query, repaired after any failure, three attempts in all; only one that writes ends it.

    The provider gets the linked entities, and after a failure the query and its error.
    Evidence comes from the relationships in the rows.
    """
    spark = nodes.sparkSession
    names = [(m,) for m in providers.mentions(question)]
    found = linking.link(spark.createDataFrame(names, "mention string"), linking.index(nodes)) if names else None
    linked = [r.asDict() for r in linking.first_of_each(found, "mention").join(nodes, "id").select("id", "name", "type").orderBy("id").collect()] if names else []  # a row a mention
    seeds = spark.createDataFrame([(e["id"],) for e in linked], "id string")
    near = tuple(r.asDict() for r in graph.named(graph.subgraph(edges, seeds), nodes).collect()) if linked else ()  # 80 edges at most
    previous, query = None, ""
    for _ in range(ATTEMPTS):
        query = providers.query(question, ontology.prompt(), linked, previous)
        try:
            shown, proof = cypher.run_with_evidence(query, nodes, edges, limit)
            rows = [r["row"] for r in shown.select(T.plain_row(shown.columns).alias("row")).collect()]  # ``limit`` rows
            evidence = [r.asDict() for r in proof.collect()]  # of these rows
            return Answer("graph", providers.answer(question, rows), rows, evidence, query, linked=tuple(linked), subgraph=near)
        except cypher.WriteError as e:
            return Answer("graph", "The query isn't read-only and was refused.", [], [], query, str(e), tuple(linked), near)
        except Exception as e:
            previous = {"query": query, "error": str(e)}
    return Answer("graph", f"The query failed {ATTEMPTS} times: {previous['error']}", [], [], query, previous["error"], tuple(linked), near)


def ask_hybrid(store: DataFrame, nodes: DataFrame, edges: DataFrame, question: str, providers: P.Providers = P.DEFAULT) -> Answer:
    """Graph rows and retrieved chunks together."""
    by_graph, by_vector = ask_graph(nodes, edges, question, providers), ask_vector(store, question, providers=providers)
    if by_graph.error and by_vector.error:
        raise RuntimeError(by_graph.error)
    rows = [*(by_graph.rows or ["(the graph has no rows)"]), *by_vector.rows]
    return Answer("hybrid", providers.answer(question, [*by_graph.rows, *by_vector.rows]), rows, [*by_graph.evidence, *by_vector.evidence], by_graph.query)


def compare(store: DataFrame, nodes: DataFrame, edges: DataFrame, question: str, providers: P.Providers = P.DEFAULT) -> dict[str, Answer]:
    """All three methods; the failure of one leaves the others."""
    calls: dict[str, Callable[[], Answer]] = {"Vector": lambda: ask_vector(store, question, providers=providers), "Graph": lambda: ask_graph(nodes, edges, question, providers), "Hybrid": lambda: ask_hybrid(store, nodes, edges, question, providers)}
    out = {}
    for name, call in calls.items():
        try:
            out[name] = call()
        except Exception as e:
            out[name] = Answer(name.lower(), "", [], [], error=str(e) or type(e).__name__)
    return out


def evaluate_batch(spark: SparkSession, questions: list[str | dict], store: DataFrame, nodes: DataFrame, edges: DataFrame, providers: P.Providers = P.DEFAULT, category: str = "", limit: int = 0) -> DataFrame:
    """The evaluation table (``evaluation.COLUMNS``), a row a question.

    A question is a text, or has ``id, category, question``; ``category`` keeps those of
    one, ``limit`` above 0 the first so many. A method that fails, or a judge whose scores
    aren't whole, leaves the scores empty and its error in the row.
    """
    asked = [q if isinstance(q, dict) else {"id": "", "category": "", "question": q} for q in questions]
    asked = [q for q in asked if not category or q.get("category") == category]
    rows = []
    for index, q in enumerate(asked[:limit] if limit > 0 else asked, 1):
        found = compare(store, nodes, edges, q["question"], providers)
        failed = [a.error for a in found.values() if a.error and not a.text]
        judged, error = {}, "; ".join(failed) or None
        if not failed:
            try:
                judged = providers.judge(q["question"], {evaluation.TABLE_NAMES[s]: evaluation.shown_to_judge(a.method, a.text, a.rows, a.evidence, a.query) for s, a in found.items()})
                scores = {s: evaluation.checked_scores(judged.get(evaluation.TABLE_NAMES[s])) for s in found}
            except Exception as e:
                judged, error = {}, str(e)
        for system, a in found.items():
            own = scores[system] if judged else {}
            rows.append((index, q.get("id", ""), q.get("category", ""), q["question"], system, None if failed else a.text, *(own.get(d) for d in evaluation.DIMENSIONS), judged.get("verdict"), error))
    kinds = ", ".join(f"{d} int" for d in evaluation.DIMENSIONS)
    return evaluation.table(spark.createDataFrame(rows, f"index int, id string, category string, question string, system string, answer string, {kinds}, verdict string, error string"))


def ask_events(store: DataFrame, nodes: DataFrame, edges: DataFrame, question: str, providers: P.Providers = P.DEFAULT, questions: DataFrame | None = None) -> Iterator[tuple[str, object]]:
    """Progress, answers, evidence and scatter points of a question, as they come.

    The scatter holds the retrieved chunks and the question itself, on the axes of the
    whole store. The result has the category of the gold question of this text.
    """
    if not question.strip():
        raise ValueError("a question is needed")
    spark = store.sparkSession
    yield "stage", "retrieval"
    found = compare(store, nodes, edges, question, providers)
    for a in found.values():
        yield "answer", {"method": a.method, "text": a.text, "error": a.error}
    yield "evidence", [e for a in found.values() for e in a.evidence]
    try:
        ids = [e["chunk_id"] for e in found["Vector"].evidence]
        basis = pca.fit(store)
        points = basis.project(store.where(F.col("chunk_id").isin(ids))).select("chunk_id", "document_id", "x", "y", T.point_label(F.col("text")).alias("label")).collect()  # the retrieved chunks
        asked = spark.createDataFrame([(providers.embed([question])[0],)], "embedding array<double>")
        yield "scatter", {"points": [r.asDict() for r in points], "query": basis.project(asked).select("x", "y").first().asDict()}
    except Exception as e:
        yield "scatter", {"error": str(e)}
    yield "stage", "judgement"
    named = evaluation.category(spark.createDataFrame([(question,)], "question string"), questions).first()["category"] if questions is not None else ""
    shown = {evaluation.TABLE_NAMES[s]: evaluation.shown_to_judge(a.method, a.text, a.rows, a.evidence, a.query) for s, a in found.items()}
    judged = providers.judge(question, shown)
    scores = {name: evaluation.checked_scores(judged.get(name)) for name in shown}
    yield "result", {"category": named, "scores": scores, "totals": {k: sum(v.values()) for k, v in scores.items()}, "verdict": judged.get("verdict", "")}
