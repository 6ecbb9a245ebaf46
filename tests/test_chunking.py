"""Segmentation and chunking against a plain restatement."""

from __future__ import annotations

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators.chunking import chunk_texts, slices_of, split_documents
from ragloom.plans.ask import build_chunks
from ragloom.sources.readers import lines


def restated(lengths: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """The same slices by adding lengths one by one."""
    joined = lambda s, e: sum(lengths[s:e]) + e - s - 1
    at, out = 0, []
    while at < len(lengths):
        end = at + 1
        while end < len(lengths) and joined(at, end + 1) <= size:
            end += 1
        out.append((at, end))
        if end == len(lengths):
            return out
        shared = [k for k in range(at + 1, end) if sum(x + 1 for x in lengths[k:end]) >= overlap]
        at = max(shared) if shared else end
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 1500), max_size=40), st.integers(1, 1200), st.integers(0, 300))
def test_slices(lengths, size, overlap):
    assert slices_of(lengths, size, max(1, overlap)) == restated(lengths, size, max(1, overlap))


def test_worked_example():
    assert slices_of([10, 1200, 10, 10, 100], 1000, 150) == [(0, 1), (1, 2), (2, 5)]


def test_chunks_cover_all_sentences(spark):
    rng = random.Random(3)
    texts = [" ".join("w" * rng.randint(1, 30) + rng.choice([".", "!", " •"]) for _ in range(rng.randint(0, 120))) for _ in range(30)] + ["", None, "• •"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = chunk_texts(docs, "id", "text", 200, 40).collect()
    assert {int(r["document_id"]) for r in rows} == {i for i, t in enumerate(texts) if t and t.replace("•", "").strip()}
    assert all(r["chunk_id"] == f"{r['document_id']}_{r['chunk_no']:04d}" for r in rows)


CORPUS = "﻿preamble\r\nS1, Ep2\r\n\r\nThe Title\r\nFirst body. Second line!\r\n s 1 ,EP 10 \nOnly title\nS2, Ep1\n\nS1, Ep2\nAgain\nBody two.\n"


def test_documents(spark, tmp_path):
    path = tmp_path / "corpus.txt"
    path.write_bytes(CORPUS.encode())
    rows = split_documents(lines(spark, str(path))).orderBy("segment").collect()
    assert [(r["document_id"], r["title"], r["body"]) for r in rows] == [
        ("s01e02", "The Title", "First body. Second line!"), ("s01e10", "Only title", ""), ("s02e01", "S02E01", ""), ("s01e02", "Again", "Body two."),
    ]
    chunks = build_chunks(lines(spark, str(path))).orderBy("title").collect()
    assert [(r["chunk_id"], r["title"], r["text"]) for r in chunks] == [("s01e02_0001", "Again", "Body two."), ("s01e02_0001", "The Title", "First body. Second line!")]


def test_white_space_collapses_as_by_the_plain_pattern(spark):
    rng = random.Random(21)
    parts = [" ", "  ", "\t", "\n", "\x0b", " ", "﻿", " ", " ", "　", "a", "é.", "•", "·", "​", "\U0001f600", "x y"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(800)]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", T.compact(F.col("t")).alias("c"), T.normalize(F.col("t")).alias("n")).collect()
    for t, c, n in rows:
        plain = re.sub(T.SPACES, " ", t or "")
        assert c == plain.strip(" ")
        assert n == re.sub(T.SPACES, " ", re.sub(T.BULLETS, " ", t or "")).strip(" ")
