"""Terms, scores and snippets against plain Python on random input."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.functions.lexicon import DEFAULT, python_terms
from ragloom.operators import nearest
from ragloom.operators import retrieval as R

WORDS = "house houses war a-b-c bus king's eddard ned stark kill betrayed ward toward because reason throne loyal who the red wedding lord commander x1 2 The And".split()


def texts(n: int) -> list[str]:
    rng = random.Random(11)
    return ["".join(rng.choice(WORDS) + rng.choice([" ", ". ", "! ", "\n", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["", " \n "]


def expanded(question: str) -> set[str]:
    terms, low = set(python_terms(question)) - set(DEFAULT.stop), question.lower()
    for key, more in DEFAULT.expansions:
        if key in terms or key in low:
            terms |= set(more)
    return terms - set(DEFAULT.stop)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts(60))], "i int, text string")


def test_terms_and_expansion(rows):
    for r in rows.select("text", T.word_terms(F.col("text")).alias("w"), T.question_terms(F.col("text")).alias("q"), T.expanded_terms(F.col("text")).alias("e"), T.question_profile(F.col("text")).alias("p")).collect():
        assert r["w"] == python_terms(r["text"])
        assert set(r["q"]) == set(r["w"]) - set(DEFAULT.stop)
        assert set(r["e"]) == expanded(r["text"])
        assert r["p"]["expanded_terms"] == sorted(r["e"])
        assert r["p"]["asks_hierarchy"] == any(p in r["text"].lower() for p in DEFAULT.flag_phrases["asks_hierarchy"])


def test_order_of_expansions_matters(spark):
    first, later = spark.range(1).select(T.expanded_terms(F.lit("toward")).alias("a"), T.expanded_terms(F.lit("Ned")).alias("b")).first()
    assert "fostered" in first  # a key counts inside a word
    assert "winterfell" in later and "seat" in later  # stark, then winterfell, are set off in turn


def test_scores(rows):
    q = "Why was Ned killed by the lord commander"
    terms, low = expanded(q), q.lower()
    flags = {k: any(p in low for p in v) for k, v in DEFAULT.flag_phrases.items()}
    flags["asks_conflict"] |= bool(terms & set(DEFAULT.conflict))
    flags["asks_explanation"] |= low.startswith("why")
    t, p = T.expanded_terms(F.lit(q)), F.col("p")
    for r in rows.withColumn("p", T.question_profile(F.lit(q))).select("text", R.lexical_score(F.col("text"), t).alias("l"), R.cue_score(F.col("text"), p).alias("c")).collect():
        own = set(python_terms(r["text"]))
        lexical = min(1, len(terms & own) / len(terms) + 0.04 * sum(x in r["text"].lower() for x in DEFAULT.phrases))
        cue = min(1, sum(0.08 * len(own & set(w)) for k, w in DEFAULT.flag_cues.items() if flags[k]) + 0.03 * len(own & set(DEFAULT.evidence)) + 0.03 * len(own & set(DEFAULT.alliance)))
        assert math.isclose(r["l"], lexical, abs_tol=1e-9) and math.isclose(r["c"], cue, abs_tol=1e-9)


def snippet(text: str, terms: set[str]) -> str:
    flat = " ".join(text.split())
    single = [s for s in re.split(r"(?<=[.!?])\s+", flat) if s]
    windows = single + [f"{a} {b}" for a, b in zip(single, single[1:], strict=False) if len(a) < 220]
    points = lambda w: sum(n * len(set(python_terms(w)) & set(x)) for n, x in ((4, terms), (1, DEFAULT.evidence), (2, DEFAULT.conflict), (2, DEFAULT.alliance)))
    best = max(windows, key=points) if windows else text
    return best if len(best) <= 320 else best[:317].rstrip() + "..."


def test_snippets(rows):
    q = "who killed ned"
    for r in rows.select("text", R.evidence_snippet(F.col("text"), T.expanded_terms(F.lit(q))).alias("s")).collect():
        assert r["s"] == snippet(r["text"], expanded(q))


def test_cosine_edges(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0, 5.0]), ([0.0, 0.0], [1.0, 1.0]), ([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    assert [round(r[0], 9) for r in rows.select(R.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.96]


def test_retrieve_checks_and_dedupes(spark):
    store = spark.createDataFrame([(i, "d", f"c{i // 2}", "t", f"ned stark {i}", "h", [1.0, float(i)]) for i in range(40)], "ord long, document_id string, chunk_id string, title string, text string, text_hash string, embedding array<float>")
    found = R.retrieve(store, "who is ned", [1.0, 0.0], 5, 20).collect()
    assert len(found) == 5 and len({r["chunk_id"] for r in found}) == 5 and found[0]["ord"] == 0
    with pytest.raises(ValueError):
        R.retrieve(store, "q", [1.0, 0.0], 10, 5)


def test_rendering(spark):
    row = spark.range(1).select(
        T.slug(F.lit("Ser Barristan's Häuser--")).alias("slug"), T.slug(F.lit("漢字")).alias("none"), T.score_bar(F.lit(7), 10).alias("bar"), T.csv_cell(F.lit('a "b",\n c')).alias("cell"), T.lucene_escape(F.lit("a+b (c)")).alias("lucene"), T.document_id(F.lit(1), F.lit(123)).alias("doc"), T.strip_fence(F.lit("```json\n[1]\n```")).alias("fence"), T.compact(F.lit(" a \t b﻿")).alias("compact")
    ).first()
    assert tuple(row) == ("ser-barristans-h-user", "unknown", "█" * 7 + "░" * 3, '"a ""b"", c"', "a b c", "s01e123", "[1]", "a b")


def test_settled_question_equals_the_expressions(spark):
    for question in ("Why did the king betray his wife's family?", "", "the of"):
        own = spark.range(1).select(T.expanded_terms(F.lit(question)), T.settled_terms(spark, question), T.question_profile(F.lit(question)), T.settled_profile(spark, question)).first()
        assert own[0] == own[1] and own[2] == own[3]


def test_batch_of_queries_meets_vectors_without_a_row_a_pair(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 3000)
    rng = random.Random(17)
    vectors = [[round(rng.gauss(0, 1), 2) for _ in range(8)] for _ in range(700)]
    vectors[100:160] = [list(vectors[3])] * 60  # ties of one score, by id
    vectors[200:210] = [[2 * x for x in vectors[5]]] * 10
    odd = [None, [], [0.0] * 8, [0.0] * 8, [None, 1.0], [0.0, 1.0], [1.0, None, 2.0], [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1e-160] * 8, [1e200] * 8, [1.0, 2.0], [0.5, 1.0, 3.0], [3.0]]
    rows = [(i, v) for i, v in enumerate(vectors + odd * 2)] + [(50, vectors[9]), (50, None), (7, vectors[8]), (None, vectors[1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    # Odd vectors ask too, by ids of their own.
    asked = df.where("vec_id % 50 = 0 or vec_id >= 700").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    score = R.cosine(F.col("query"), F.col("embedding")).alias("score")
    pairs = asked.join(df, F.col("query_id") != F.col("vec_id")).select("query_id", "vec_id", score)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    order = ["query_id", "rank", "vec_id"]
    shown = lambda rows: [(r["query_id"], r["rank"], r["vec_id"], str(r["score"] + 0.0 if r["score"] is not None else None)) for r in rows.orderBy(*order).collect()]
    found = R.top_k_batch(df, asked, 10, "vec_id")
    want = shown(pairs.withColumn("rank", F.row_number().over(w)).where("rank <= 10"))
    assert shown(found) == want and len(want) == 10 * len({r[0] for r in want})
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert R.top_k_batch(df.limit(0), asked, 10, "vec_id").collect() == R.top_k_batch(df, asked.limit(0), 10, "vec_id").collect() == []
