"""Operators 2 to 4 against the public library, brute force and round trips."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ragloom.llm.bpe import Chunks, codec, digest_documents, encode_documents
from ragloom.llm.packing import AT_ONCE, intervals, pack_documents, pack_histogram, text_bytes
from ragloom.llm.shared import public_path
from ragloom.llm import token_counts
from ragloom.llm.token_counts import UnigramTrie, count_tokens, fit_weights

PATH = public_path("byte_bpe_50k.json")
ODD = [chr(i) for i in (0, 9, 10, 13, 28, 31, 0x85, 0xA0, 0x1680, 0x2028, 0x3000, 0xFEFF, 0x301, 0x660, 0x2160, 0xB2, 0x1F600)] + ["<|endoftext|>", "'re", " ", " ", "  ", "\n", "a", "B", "7", "é", "漢", ".", "_", "word", "words", "the", "don't"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n: int) -> list[str]:
    rng = random.Random(7)
    return ["".join(rng.choices(ODD, k=rng.randint(0, 30))) for _ in range(n)]


def test_ids_equal_the_librarys(library):
    c = codec(PATH)
    for text in [*odd_texts(3000), "a" * 5000, "x " * 3000]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert c.encode(text) == ids, text
        assert c.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_chunks_join_to_whole_texts():
    c = codec(PATH)
    chunks = Chunks(c, lambda t: tuple(c.ids(t)), limit=50)
    for text in odd_texts(3000):
        assert [i for x in chunks(text) for i in x] == c.ids(text), text


def test_texts_at_once_equal_the_library(library):
    ids = text_bytes(PATH, public_path("byte_bpe_50k.tiktoken"))
    letters = [f"a{chr(i)}1 {chr(i)}{chr(i)}b" for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    spaces = [f"{a}{' ' * n}{b}" for a in ("", "x", "\n") for b in ("", "y", "\t", ".") for n in (1, 2, 3, 70)]
    plain = ["".join(random.Random(i).choices(["the", "don't", " ", "  ", "\n", "7", "é", "_", "'", "'ll", ".", "漢", "\t", "word"], k=40)) for i in range(2000)]
    for text in [*letters, *spaces, *plain, *odd_texts(1000), "", "ab" * 100, " " * 90_000 + "x"]:
        assert np.frombuffer(ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:60]
    long = " " * AT_ONCE + "x" + "word " * 1000
    assert np.frombuffer(ids(long), "<u4").tolist() == codec(PATH).encode(long)


ROWS = [(1, "The cat <|endoftext|> sat."), (2, None), (3, ""), (4, "word " * 3000), (4, "word " * 3000), (None, "no id"), (5, "'ll  \n x")]


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, n_tokens int, ids string")


def test_digests(spark, library):
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in digest_documents(documents(spark)).collect())
    expected = []
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i or -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(expected)
    whole = {(r["doc_id"], r["decoded"]) for r in encode_documents(documents(spark)).collect()}
    assert whole == {(i, t or "") for i, t in ROWS}
    assert digest_documents(documents(spark, [])).collect() == []


def test_packing_holds_every_id_once(spark, library):
    rows = pack_documents(documents(spark)).collect()
    per_doc, per_sequence = {}, {}
    for r in rows:
        per_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        per_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in per_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    for i, t in {(i, t) for i, t in ROWS}:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = per_doc[i, len(ids)]
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert sum(r["length"] for r in own) == len(ids) * sum(x == i for x, _ in ROWS)
    assert pack_documents(documents(spark, [])).collect() == []


def test_histogram_packs_tightly():
    rng = random.Random(1)
    for lengths in ([rng.randint(1, 2048) for _ in range(5000)], [rng.randint(1, 300) for _ in range(5000)], [2048] * 7, [1]):
        counts = {n: lengths.count(n) for n in set(lengths)}
        patterns = pack_histogram(counts)
        assert sum(n * p.count(x) for p, n in patterns for x in (lengths[0],)) == counts[lengths[0]]
        assert all(sum(p) <= 2048 for p, _ in patterns)
        used = sum(n for _, n in patterns)
        assert used <= -(-sum(lengths) // 2048) * 1.02 + 1
        intervals(patterns, counts)
    with pytest.raises(ValueError):
        pack_histogram({4000: 1})


def brute(word: bytes, scores: dict[bytes, float]) -> tuple[float, int]:
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        best.append(max((best[at][0] + scores[word[at:end]], best[at][1] - 1) for at in range(end) if word[at:end] in scores))
    return best[-1]


def test_histogram_equals_shortest_pack_first_piece_by_piece():
    rng = random.Random(3)
    for width, top, n in ((64, 64, 400), (64, 20, 500), (100, 60, 300), (16, 16, 200), (32, 5, 99)):
        lengths = [rng.randint(1, top) for _ in range(n)]
        fills = []
        for length in sorted(lengths, reverse=True):
            open_ = [i for i, fill in enumerate(fills) if fill + length <= width]
            if open_:
                fills[min(open_, key=lambda i: fills[i])] += length
            else:
                fills.append(length)
        patterns = pack_histogram({x: lengths.count(x) for x in set(lengths)}, width)
        assert sorted(sum(p) for p, n in patterns for _ in range(n)) == sorted(fills)


def test_trie_scores_equal_brute_force(spark, library):
    docs = documents(spark)
    weights = fit_weights(docs)
    own = codec(PATH)
    counts = np.array([1 if s else 0 for s in own.strings])
    for _, t in ROWS:
        for i in library.encode(t or "", add_special_tokens=False).ids:
            counts[i] += i != 50256
    counts[50256] = 0
    assert np.allclose(weights, np.log(np.maximum(counts, 1) / counts.sum()))
    trie = UnigramTrie(PATH, weights)
    scores = {s: weights[i] for i, s in enumerate(own.strings) if s and i != 50256}
    words = [" the", "ing", " straßenbahn", "漢字", "x" * 40, " antidisestablishment"]
    for w in words:
        tokens, score = trie.insert(w)
        want = brute(w.encode(), scores)
        assert (tokens, round(score, 6)) == (-want[1], round(want[0], 6))
    rows = sorted((r["doc_id"] or -1, r["n_pretokens"], r["n_tokens"], r["log_score"]) for r in count_tokens(docs).collect())
    want = []
    for i, t in ROWS:
        words, tokens, score = 0, 0, 0.0
        for part, special in own.parts(t or ""):
            for w in part:
                s, k = (0.0, -1) if special else brute(w.encode(), scores)
                words, tokens, score = words + 1, tokens - k, score + s
        want.append((i or -1, words, tokens, pytest.approx(score, abs=2e-4)))
    assert rows == sorted(want, key=lambda r: r[:3])
    assert count_tokens(documents(spark, [])).collect() == []


def test_a_crowded_trie_starts_anew(spark, monkeypatch):
    weights = fit_weights(documents(spark))
    whole = UnigramTrie(PATH, weights)
    text = " ".join(f"word{i * 7919} {i}x" for i in range(400))
    want = whole.count(text)
    monkeypatch.setattr(token_counts, "MAX_NODES", 50)
    small = UnigramTrie(PATH, weights)
    assert small.count(text) == want and len(small.parent) < 200 < len(whole.parent)


def calls_of(act) -> int:
    """Python functions and generators entered while ``act`` runs."""
    n = 0

    def note(frame, event, arg):
        nonlocal n
        n += event == "call"

    sys.setprofile(note)
    try:
        act()
    finally:
        sys.setprofile(None)
    return n


def test_distinct_words_are_scored_many_at_a_time():
    trie = UnigramTrie(PATH, -np.arange(1.0, 50258.0))
    trie.count("once")
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=9)) for _ in range(4000)]
    assert calls_of(lambda: trie.count(" ".join(words))) < len(words)


@pytest.mark.parametrize("block", [token_counts.BLOCK, 3000])
def test_many_texts_at_once_equal_one_by_one(library, monkeypatch, block):
    monkeypatch.setattr(token_counts, "BLOCK", block)
    own = codec(PATH)
    long = ["x" * 64, "x" * 65, "ab" * 90, "漢" * 70, "=" * 300, " " * 200 + "x", "a\0b \0 c\0", "\n \n", " ", "foo\n bar", "bar\n \nfoo"]
    texts = [None, "", *long, *odd_texts(1500), " ".join(long)]
    weights = np.log(np.random.default_rng(2).zipf(1.5, len(own.strings)).clip(1, 10**6) / 1e7)
    scores = {t: weights[i] for i, t in enumerate(own.strings) if t and i != 50256}
    memo: dict[str, tuple[float, int]] = {}
    trie, got, counts = UnigramTrie(PATH, weights), [], np.zeros(len(own.strings), np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 100], pa.string())], names=["t"]) for i in range(0, len(texts), 100)]
    for (column,) in token_counts.blocks(iter(batches), 0):
        got += zip(*trie.count_all(column), strict=True)
        found = token_counts.pieces(own, column)
        ids, owner = token_counts.word_ids(own, found, public_path("byte_bpe_50k.tiktoken"))
        times = np.bincount(found.word, np.bincount(found.chunk, minlength=found.chunks)[found.owner], len(found.words))
        np.add.at(counts, ids, times[owner].astype(np.int64))
    assert len(got) == len(texts)
    for text, row in zip(texts, got, strict=True):
        words = tokens = score = 0
        for part, special in own.parts(text or ""):
            for w in part:
                s, k = (0.0, -1) if special else memo.get(w) or memo.setdefault(w, brute(w.encode(), scores))
                words, tokens, score = words + 1, tokens - k, score + s
        assert row == (words, tokens, pytest.approx(score, abs=1e-6)), text
    want = np.zeros(len(own.strings), np.int64)
    for text in texts:
        np.add.at(want, library.encode(text or "", add_special_tokens=False).ids, 1)
    assert (counts == want).all()
