"""Operator 3: packing documents into sequences of bounded length.

Shortest-pack-first over the length histogram. Every document is cut into pieces
of the sequence length and a remainder; the histogram of piece lengths has at most
``width`` entries, whatever the corpus. Lengths are placed longest first, each into
the emptiest pack that still takes it, many packs of a kind at a time, so only
pattern counts are kept. Patterns are then joined back to the pieces by their rank
among pieces of equal length.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.llm.bpe import SPLIT, Chunks, codec
from ragloom.llm.shared import checkpoint, load, public_path, small_batches

#: Id that ends each document.
END_ID = 1
#: Tokens in a sequence.
WIDTH = 2048
#: Characters up to which a text is split by the library at once: its patterns keep a stack of a
#: million places, which longer runs of white space could fill.
AT_ONCE = 500_000


@lru_cache(maxsize=4)
def encoder(ranks: str, pattern: str) -> Callable[[str], list[int]]:
    """Ids of a text that a pattern splits, by the rank file's library."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def id_bytes(vocabulary: str, ranks: str) -> Chunks:
    """Chunks of texts as little-endian 32-bit ids, one reader for each Python worker.

    The pieces come from the rank file of the same vocabulary, whose library merges
    single words; its ids equal those of the tokenizers library (see the tests).
    """
    merge, own = encoder(ranks, r"(?s).+"), codec(vocabulary)

    def make(text: str) -> bytes:
        return array("I", [i for part, special in own.parts(text) for w in part for i in ((own.added[w],) if special else merge(w))]).tobytes()

    return Chunks(own, make)


@lru_cache(maxsize=2)
def text_bytes(vocabulary: str, ranks: str) -> Callable[[str], bytes]:
    """Whole texts as little-endian 32-bit ids.

    The library splits and merges a text at once where all pattern dialects agree on it:
    no added token, no odd character, at most ``AT_ONCE`` characters. Others go word by word.
    """
    whole, chunks, own = encoder(ranks, SPLIT), id_bytes(vocabulary, ranks), codec(vocabulary)

    def ids(text: str) -> bytes:
        if len(text) > AT_ONCE or any(name in text for name in own.added) or own.odd.search(text):
            return b"".join(chunks(text))
        return array("I", whole(text)).tobytes()

    return ids


def cut_documents(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Pieces of at most ``width`` ids, cut where a document fills a sequence.

    Each row also has ``part`` (the task) and ``nth`` (its number among the task's
    pieces of that length), from which ranks follow without a sort.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        seen: dict[int, int] = {}
        ids = text_bytes(public_path(vocabulary), public_path(ranks))
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = ids(text.as_py() or "") + end
                total = len(tokens) // 4
                for start in range(0, total, width):
                    own = tokens[4 * start : 4 * (start + width)]
                    n = len(own) // 4
                    seen[n] = nth = seen.get(n, -1) + 1
                    rows.append((key, start, n, zlib.crc32(own), total, part, nth))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), [batch.schema.field(0).type, *[pa.int64()] * 4, pa.int32(), pa.int64()], strict=True)], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]) if rows else pa.RecordBatch.from_pylist([], schema=pa.schema([(id_col, batch.schema.field(0).type), *[(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens")], ("part", pa.int32()), ("nth", pa.int64())]))

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long")


def pack_histogram(counts: dict[int, int], width: int = WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with their counts: shortest pack first, longest length first.

    ``counts`` maps a length to its number of pieces. Packs of one fill are held as a
    stack of (pattern, count); a step moves as many of them as both sides allow.
    """
    packs: dict[int, list[list]] = {}  # fill -> [[pattern, count], ...]
    fills: list[int] = []  # ascending; those that have packs
    done: list[tuple[tuple[int, ...], int]] = []

    def put(fill: int, pattern: tuple[int, ...], n: int) -> None:
        if fill == width:
            done.append((pattern, n))
            return
        if fill not in packs:
            packs[fill] = []
            bisect.insort(fills, fill)
        packs[fill].append([pattern, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        if not 0 < length <= width:
            raise ValueError(f"length {length} is not in 1..{width}")
        while left:
            if fills and fills[0] + length <= width:
                fill = fills[0]
                pattern, n = packs[fill].pop()
                if n > left:
                    packs[fill].append([pattern, n - left])
                if not packs[fill]:
                    del packs[fill]
                    fills.pop(0)
                n = min(n, left)
                put(fill + length, (*pattern, length), n)
                left -= n
            else:
                # As many new packs as the pieces left fill, each with as many as it holds.
                each = width // length
                n, rest = divmod(left, each)
                if n:
                    put(each * length, (length,) * each, n)
                if rest:
                    put(rest * length, (length,) * rest, 1)
                left = 0
    return [*done, *((tuple(p), n) for fill in fills for p, n in packs[fill])]


def intervals(patterns: list[tuple[tuple[int, ...], int]], counts: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks, the sequence of that rank, and the offset there."""
    used = dict.fromkeys(counts, 0)
    rows: dict[int, list[tuple[int, int, int]]] = {n: [] for n in counts}
    base = 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rows[length].append((used[length], base, offset))
            used[length] += n
            offset += length
        base += n
    if used != counts:
        raise AssertionError("a piece has no place")
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in rows.items() if r}


def pack_documents(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Where every piece of every document lies.

    Returns ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. A null
    or empty text has one id, the end; a very long one is cut wherever it fills a
    sequence; a null id stays null; repeated rows are packed each on their own; an empty
    table gives no rows. Extra columns are left out.
    """
    spark = docs.sparkSession
    pieces = checkpoint(cut_documents(docs, width, id_col, text_col, vocabulary, ranks))
    by_part = checkpoint(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``width`` rows
    where = spark.sparkContext.broadcast(intervals(pack_histogram(counts, width), counts))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["part", "length"]).select(id_col, "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = where.value
        for batch in batches:
            lengths, ranks = (np.asarray(batch.column(i)) for i in (2, 5))
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(lengths):
                own = lengths == n
                firsts, bases, offsets = table[int(n)]
                at = np.searchsorted(firsts, ranks[own], "right") - 1
                sequence[own], offset[own] = bases[at] + ranks[own] - firsts[at], offsets[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048."""
    return pack_documents(load(spark, sf_dir, "documents"))
