"""Operator 2: byte-level BPE encoding and decoding.

Merges come off a priority queue of ``(rank, position)`` over a doubly linked
list of symbols. An entry whose symbols have been merged since is stale and is
skipped. Decoding concatenates the vocabulary strings of the ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.shared import load, public_path, small_batches

#: Fixed value: how the byte-level pre-tokenizer splits text (published with the
#: vocabulary); white space is spelt out as Unicode's White_Space property.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: The same split in the standard library's twice as fast dialect, for texts in which
#: every character that counts as alphanumeric is a letter or a decimal digit.
PLAIN_SPLIT = rf" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^{SPACE}\w]|_)+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Words in each of a worker's two cache generations, and the longest word that enters.
CACHE_WORDS, CACHE_CHARS = 300_000, 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    table = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in table)
    table.update({b: chr(256 + i) for i, b in enumerate(hidden)})
    return [table[b] for b in range(256)]


@lru_cache(maxsize=1)
def odd_characters() -> re.Pattern:
    """Finds characters on which the two dialects may differ; all astral ones count."""
    odd = [i for i in range(0x10000) if (k := unicodedata.category(chr(i))) in ("Nl", "No", "Cn", "Cs") or (k[0] not in "LN" and chr(i).isalnum())]
    spans: list[list[int]] = []
    for i in odd:
        if spans and spans[-1][1] == i - 1:
            spans[-1][1] = i
        else:
            spans.append([i, i])
    return re.compile("[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans) + "\\U00010000-\\U0010ffff]")


class Recent(dict):
    """Values by string, made when missing. Two generations bound its size, whatever the corpus."""

    def __init__(self, make: Callable[[str], object], limit: int = CACHE_WORDS):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class BytePairCodec:
    """Encoder and decoder for a ``tokenizers`` JSON file of the byte-level BPE kind.

    Gives the ids of that library with ``add_special_tokens=False``. Added tokens in
    a text are matched first, leftmost, longest first, as the library does.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        self.byte_ids = [vocab[c] for c in symbols]
        self.ranks: dict[int, int] = {}  # pairs of ids: the merge's rank, and in the lowest 20 bits its id
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << 20 | vocab[b]] = rank << 20 | vocab[a + b]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.strings: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in token)
        for token, i in self.added.items():
            self.strings[i] = token.encode()
        self.split = regex.compile(SPLIT)
        names = sorted(self.added, key=len, reverse=True)
        self.plain_split, self.odd = re.compile(PLAIN_SPLIT), odd_characters()
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")")
        self.words = Recent(self.merge)

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token: the cheapest merge first, the leftmost of equals."""
        ids = [self.byte_ids[b] for b in word.encode("utf-8", "replace")]
        n = len(ids)
        if n < 2:
            return tuple(ids)
        find, pop, push = self.ranks.get, heapq.heappop, heapq.heappush
        # An entry is (rank, id, position) in one number; a rank has one id.
        place = n.bit_length()
        mask = (1 << place) - 1
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [hit << place | i for i in range(n - 1) if (hit := find(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            i, hit = entry & mask, entry >> place
            j = after[i]
            if j >= n or ids[i] < 0 or find(ids[i] << 20 | ids[j]) != hit:
                continue  # stale: one of the two symbols has changed or gone
            made = ids[i] = hit & 0xFFFFF
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if hit := find(made << 20 | ids[k]):
                    push(queue, hit << place | i)
            h = before[i]
            if h >= 0 and (hit := find(ids[h] << 20 | made)):
                push(queue, hit << place | h)
        return tuple([i for i in ids if i >= 0])

    def parts(self, text: str) -> Iterator[tuple[list[str], bool]]:
        """Runs of pre-tokens, and added tokens (marked), in order."""
        split = self.split.findall if self.odd.search(text) else self.plain_split.findall
        if not any(name in text for name in self.added):
            yield split(text), False
            return
        for part in self.special.split(text):
            if part in self.added:
                yield [part], True
            elif part:
                yield split(part), False

    def ids(self, text: str) -> list[int]:
        """Ids of a text, pre-token by pre-token."""
        words = self.words
        return [i for part, special in self.parts(text) for w in part for i in ((self.added[w],) if special else words[w])]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty one."""
        return self.ids(text or "")

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary strings of the ids, joined; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


#: A space between two other white-space characters, or before the end of the text.
BETWEEN = re.compile(rf"(?<=[{SPACE}]) (?=[{SPACE}]|\Z)")


class Chunks:
    """Values of a text's space-separated chunks, from a cache of recent ones.

    Pre-tokens never depend on what lies beyond a single space, so a chunk with the
    space before it can be looked up whole. Texts where they might (a space within a
    run of white space, added tokens) make one chunk.
    """

    def __init__(self, codec: BytePairCodec, make: Callable[[str], object], limit: int = CACHE_WORDS):
        self.added, self.make = codec.added, make
        self.spaced = Recent(lambda chunk: make(" " + chunk), limit)

    def __call__(self, text: str) -> list:
        if BETWEEN.search(text) or any(name in text for name in self.added):
            return [self.make(text)]
        first, *rest = text.split(" ")
        get = self.spaced
        return [self.make(first), *[get[c] for c in rest]]


@lru_cache(maxsize=4)
def codec(path: str) -> BytePairCodec:
    """One codec for each file and Python worker."""
    return BytePairCodec(path)


@lru_cache(maxsize=2)
def digest_chunks(path: str) -> Chunks:
    """Chunks as their number of ids, these in decimal text, and the vocabulary strings joined."""
    c = codec(path)
    string, name = c.strings.__getitem__, list(map(str, range(len(c.strings)))).__getitem__

    def make(text: str) -> tuple[int, str, bytes]:
        ids = c.ids(text)
        return len(ids), ",".join(map(name, ids)), b"".join(map(string, ids))

    return Chunks(c, make)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Ids and round-trip text of every document: ``id, ids array<int>, decoded string``.

    A null text counts as empty (no ids, empty text); a very long one is encoded whole,
    pre-token by pre-token; a null id stays null; equal rows each give a row; an empty
    table gives no rows; other columns are left out, whatever their names.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(public_path(vocabulary))
        for batch in batches:
            ids = [c.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())], names=[id_col, "ids", "decoded"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """``encode_documents`` as digests, so that no ids leave the Python worker.

    Returns ``id, n_tokens, ids_sha256, decoded_sha256``; nulls, long texts, repeated
    rows and empty tables as in ``encode_documents``.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = digest_chunks(public_path(vocabulary))
        sha = hashlib.sha256
        for batch in batches:
            n, ids_hex, text_hex = [], [], []
            for value in batch.column(1):
                counts, texts, strings = zip(*chunks(value.as_py() or ""), strict=True)
                n.append(sum(counts))
                ids_hex.append(sha(",".join(filter(None, texts)).encode()).hexdigest())
                # Decoded as a whole: a character may lie in two ids, broken ones become U+FFFD.
                text_hex.append(sha(b"".join(strings).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return digest_documents(load(spark, sf_dir, "documents"))
