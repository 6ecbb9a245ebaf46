"""Operator 4: token counts by a unigram model over a trie of pre-tokens.

Distinct pre-tokens go into a trie, level by level. Each node holds the forward score of
its prefix: the best log probability of a split of it into vocabulary strings. A prefix
that many pre-tokens share is scored once; a node where a pre-token ends keeps that
pre-token's token count and score. The strings' log probabilities are fitted to the
corpus: how often each occurs in it, summed over all documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.bpe import SPACE, BytePairCodec, codec
from ragloom.llm.packing import encoder
from ragloom.llm.shared import load, public_path, small_batches

#: Nodes after which a worker starts a new trie, levels that are laid for all pre-tokens at once
#: (the rest of a longer one goes byte by byte), and bytes of texts whose pre-tokens are told
#: apart together; they bound a worker's memory, not its results.
MAX_NODES, LEVELS, BLOCK = 500_000, 64, 12_000_000

WHITE = SPACE.encode().decode("unicode_escape")
#: ``bpe.BETWEEN`` without looking around, for Arrow: enough to know whether a text has such a space.
BETWEEN = rf"[{WHITE}] (?:[{WHITE}]|\z)"
#: ``bpe.PLAIN_SPLIT`` of many texts at once, which ``END`` divides.
END = "\0"
SPLIT_ALL = re.compile(rf" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^{SPACE}\w\0]|_)+|[{SPACE}]+(?![^{SPACE}\0])|[{SPACE}]+|\0")


class Pieces(NamedTuple):
    """Texts as chunks and these as pre-tokens, each different one named once."""

    words: pa.Array  # the distinct pre-tokens
    added: np.ndarray  # whether each is an added token
    word: np.ndarray  # the pre-tokens of all distinct chunks, as places in ``words``
    owner: np.ndarray  # the chunk of each of these
    chunks: int  # distinct chunks
    chunk: np.ndarray  # the chunks of all texts
    ends: np.ndarray  # the first of each text in ``chunk``, and their number


def strings(values: pa.Array) -> list[str]:
    """The strings of an array without nulls, several times as fast as by ``to_pylist``."""
    return values.to_numpy(zero_copy_only=False).tolist()


def pieces(own: BytePairCodec, texts: pa.Array) -> Pieces:
    """The pre-tokens of ``own.parts`` of some texts; null counts as empty.

    Chunks are as ``bpe.Chunks`` cuts them: pre-tokens never depend on what lies beyond
    a single space, and texts where they might make one chunk.
    """
    texts = texts.fill_null("")
    marked = np.zeros(len(texts), bool)
    for name in own.added:
        marked |= np.asarray(pc.match_substring(texts, name))
    whole = pa.array(marked | np.asarray(pc.match_substring_regex(texts, BETWEEN)))
    cut = pc.split_pattern(pc.if_else(whole, "", texts), " ")
    ends, flat = np.asarray(cut.offsets).astype(np.int64), cut.flatten()
    named = flat.dictionary_encode()
    chunk, spaced = np.asarray(named.indices).astype(np.int64), strings(named.dictionary)
    # A text's first chunk has no space before it.
    first = len(spaced)
    chunk[ends[:-1]] = first + np.arange(len(texts))
    names = [" " + c for c in spaced] + pc.if_else(whole, texts, flat.take(pa.array(ends[:-1]))).to_pylist()
    # Chunks that the one pattern can't split.
    apart = (first + np.flatnonzero(marked)).tolist()
    joined = END.join(names)
    if joined.count(END) >= len(names) or own.odd.search(joined):
        apart = sorted({*apart, *(i for i, c in enumerate(names) if END in c or own.odd.search(c))})
    slow = [[w for part, _ in own.parts(names[i]) for w in part] for i in apart]
    if apart:
        for i in apart:
            names[i] = ""
        joined = END.join(names)
    words = SPLIT_ALL.findall(joined)
    n = len(words)
    for own_words in slow:
        words += own_words
    named = pa.array(words, pa.large_string()).dictionary_encode()
    word = np.asarray(named.indices).astype(np.int64)
    end = word[:n] == pc.index(named.dictionary, END).as_py()
    owner = np.concatenate([np.cumsum(end)[~end], np.repeat(np.array(apart, np.int64), [len(x) for x in slow])])
    word = np.concatenate([word[:n][~end], word[n:]])
    added = np.asarray(pc.is_in(named.dictionary, pa.array([*own.added], pa.large_string())))
    return Pieces(named.dictionary, added, word, owner, len(names), chunk, ends)


def grow(flat: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The levels of a trie of distinct strings in ascending order, at most ``most`` levels.

    A level: the strings that reach it, their nodes there, and the parents and bytes of
    its nodes. Nodes are numbered in this order, the root is 0.
    """
    node, made = np.zeros(len(size), np.int64), 1
    rows = np.arange(len(size))
    for depth in range(most):
        rows = rows[size[rows] > depth]
        if not len(rows):
            return
        up, byte = node[rows], flat[start[rows] + depth]
        new = np.ones(len(rows), bool)
        new[1:] = (up[1:] != up[:-1]) | (byte[1:] != byte[:-1])
        node[rows] = own = made - 1 + np.cumsum(new)
        made = int(own[-1]) + 1
        yield rows, own, up[new], byte[new]


class Steps:
    """A trie's edges, looked up many at a time: ``node << 8 | byte`` to the child, -1 if there is none."""

    def __init__(self, keys: np.ndarray, children: np.ndarray):
        self.bits = max(4, (4 * len(keys)).bit_length())  # an eighth to a quarter are filled
        self.keys, self.children = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        at = self.place(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of keys in one place the last stays
            kept = self.keys[at] == keys
            self.children[at[kept]] = children[kept]
            keys, children, at = keys[~kept], children[~kept], (at[~kept] + 1) & (1 << self.bits) - 1

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.place(keys)
        there = self.keys[at]
        found = np.where(there == keys, self.children[at], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (1 << self.bits) - 1
            there = self.keys[at[left]]
            hit = there == keys[left]
            found[left[hit]] = self.children[at[left[hit]]]
            left = left[~hit & (there >= 0)]
        return found


class UnigramTrie:
    """Forward scores over shared prefixes of pre-tokens.

    ``weights`` has the log probability of every id. Of splits with equal scores the one
    with fewer tokens counts.
    """

    def __init__(self, path: str, weights: Sequence[float]):
        self.codec = own = codec(path)
        added = set(own.added.values())
        # Strings from their last byte to their first.
        known = sorted((token[::-1], float(weights[i])) for i, token in enumerate(own.strings) if token and i not in added)
        size = np.array([len(token) for token, _ in known], np.int64)
        self.depth = int(size.max())
        keys, last = [], np.zeros(len(known), np.int64)
        for rows, node, up, byte in grow(np.frombuffer(b"".join(token for token, _ in known), np.uint8), np.cumsum(size) - size, size, self.depth):
            last[rows] = node
            keys.append(up << 8 | byte)
        edges = np.concatenate(keys)
        self.steps = Steps(edges, np.arange(1, len(edges) + 1))
        self.one = dict(zip(edges.tolist(), range(1, len(edges) + 1), strict=True))
        self.weight = np.full(len(edges) + 1, np.nan)  # of nodes where a string ends
        self.weight[last] = [w for _, w in known]
        self.weights = [None if w != w else w for w in self.weight.tolist()]
        self.clear(0)

    def clear(self, nodes: int) -> None:
        """A trie of the root alone, with room for further nodes: for each its parent, byte, best score and tokens."""
        self.parent, self.byte = np.zeros(nodes + 1, np.int64), np.zeros(nodes + 1, np.uint8)
        self.score, self.tokens = np.zeros(nodes + 1), np.zeros(nodes + 1, np.int64)

    def forward(self, up: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and tokens of new nodes, as their ancestors give them."""
        best, fewest = np.full(len(up), -np.inf), np.full(len(up), np.iinfo(np.int64).max)
        rows, state = np.arange(len(up)), np.zeros(len(up), np.int64)
        while len(rows):
            state = self.steps(state << 8 | byte)
            on = state >= 0
            rows, state, up = rows[on], state[on], up[on]
            # No weight (NaN) is never better.
            score, tokens, now = self.score[up] + self.weight[state], self.tokens[up] + 1, best[rows]
            better = (score > now) | ((score == now) & (tokens < fewest[rows]))
            best[rows[better]], fewest[rows[better]] = score[better], tokens[better]
            on = up > 0
            rows, state, up = rows[on], state[on], up[on]
            byte, up = self.byte[up], self.parent[up]
        return best, fewest

    def lay(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and scores of distinct strings in ascending order, by a trie of them alone."""
        self.clear(int(np.minimum(size, LEVELS).sum()))
        last, made = np.zeros(len(size), np.int64), 1
        for rows, node, up, byte in grow(flat, start, size, LEVELS):
            last[rows] = node
            own = slice(made, made := made + len(up))
            self.parent[own], self.byte[own] = up, byte
            self.score[own], self.tokens[own] = self.forward(up, byte)
        self.parent, self.byte, self.score, self.tokens = (x[:made] for x in (self.parent, self.byte, self.score, self.tokens))
        tokens, scores = self.tokens[last], self.score[last]
        for i in np.flatnonzero(size > LEVELS):
            tokens[i], scores[i] = self.tail(flat[start[i] : start[i] + size[i]].tobytes(), int(last[i]))
        return tokens, scores

    def tail(self, word: bytes, node: int) -> tuple[int, float]:
        """Tokens and score of a long string, from the node of its first ``LEVELS`` bytes on."""
        best = []  # (score, -tokens) of the last prefixes, the longest last
        while node:
            best.append((float(self.score[node]), -int(self.tokens[node])))
            node = int(self.parent[node])
        best = [(0.0, 0), *best[::-1]]
        step, weights = self.one.get, self.weights
        for end in range(LEVELS, len(word)):
            found, state = None, 0
            for back in range(1, min(end + 1, self.depth) + 1):
                if (state := step(state << 8 | word[end + 1 - back])) is None:
                    break
                if (w := weights[state]) is not None:
                    score, fewer = best[-back]
                    if found is None or (score + w, fewer - 1) > found:
                        found = (score + w, fewer - 1)
            best.append(found)
            if len(best) > 64 * self.depth:
                del best[: -self.depth]
        return -best[-1][1], best[-1][0]

    def score_all(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and scores of distinct strings, in tries of at most ``MAX_NODES`` bytes or one string."""
        words = words.cast(pa.large_binary())
        order = np.asarray(pc.sort_indices(words)).astype(np.int64)
        words = words.take(pa.array(order))
        _, ends, flat = words.buffers()
        ends = np.frombuffer(ends, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
        flat = np.frombuffer(flat, np.uint8) if flat else np.zeros(0, np.uint8)
        tokens, scores = np.zeros(len(words), np.int64), np.zeros(len(words))
        at = 0
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + MAX_NODES, "right")) - 1)
            tokens[order[at:to]], scores[order[at:to]] = self.lay(flat, ends[at:to], np.diff(ends[at : to + 1]))
            at = to
        return tokens, scores

    def insert(self, word: str) -> tuple[int, float]:
        """Tokens and score of a pre-token, as its last node has them."""
        tokens, scores = self.score_all(pa.array([word.encode("utf-8", "replace")]))
        return int(tokens[0]), float(scores[0])

    def count_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[float]]:
        """Pre-tokens, tokens and log scores of texts; an added token is one token of score 0."""
        own = pieces(self.codec, texts)
        tokens, scores = self.score_all(own.words)
        tokens[own.added], scores[own.added] = 1, 0.0
        chunk_words = np.bincount(own.owner, minlength=own.chunks)
        chunk_tokens = np.bincount(own.owner, tokens[own.word], own.chunks).astype(np.int64)
        chunk_scores = np.bincount(own.owner, scores[own.word], own.chunks)
        words, tokens = (np.diff(np.concatenate([[0], np.cumsum(n[own.chunk])])[own.ends]) for n in (chunk_words, chunk_tokens))
        return words, tokens, [math.fsum(chunk_scores[own.chunk[a:b]].tolist()) for a, b in zip(own.ends[:-1], own.ends[1:], strict=True)]

    def count(self, text: str) -> tuple[int, int, float]:
        """``count_all`` of one text."""
        words, tokens, scores = self.count_all(pa.array([text]))
        return int(words[0]), int(tokens[0]), scores[0]


def blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[pa.Array]]:
    """The columns of the same rows, some ``BLOCK`` bytes of a column's texts at a time."""
    held, size = [], 0

    def joined() -> list[pa.Array]:
        return [pa.concat_arrays(own) for own in zip(*(b.columns for b in held), strict=True)]

    for batch in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64))
        at, before = 0, 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, before + BLOCK - size, "right")))
            held.append(batch.slice(at, to - at))
            size, before, at = size + int(ends[to - 1]) - before, int(ends[to - 1]), to
            if size >= BLOCK or at < len(ends):
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def word_ids(own: BytePairCodec, found: Pieces, ranks: str) -> tuple[np.ndarray, np.ndarray]:
    """The byte-pair ids of all distinct pre-tokens, and the place of each id's pre-token.

    The library merges all of them in one call; their bytes tell whose an id is.
    """
    words = strings(found.words)
    apart = np.flatnonzero(found.added | np.asarray(pc.match_substring(found.words, END)))
    size = np.asarray(pc.binary_length(found.words)).astype(np.int64)
    size[apart] = 0
    alone = encoder(ranks, r"(?s).+")
    more = [(i, n) for i in apart.tolist() for n in ([own.added[words[i]]] if found.added[i] else alone(words[i]))]
    for i in apart:
        words[i] = ""
    sizes = np.array([len(token) for token in own.strings])
    ids = np.array(encoder(ranks, r"[^\x00]+")(END.join(words)), np.int64)
    owner = np.searchsorted(np.cumsum(size), np.cumsum(sizes[ids]))
    return np.concatenate([ids, np.array([n for _, n in more], np.int64)]), np.concatenate([owner, np.array([i for i, _ in more], np.int64)])


def count_ids(docs: DataFrame, text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``token, n``: how often each id occurs in the byte-pair encoding of all texts.

    A task counts the pre-tokens of its texts and encodes each different one of a block
    once, with the library that packing uses; it gives a row for each id, so at most the
    vocabulary is shuffled from it.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(public_path(vocabulary))
        total = np.zeros(len(own.strings), np.int64)
        for columns in blocks(batches, 0):
            found = pieces(own, columns[0])
            often = np.bincount(found.chunk, minlength=found.chunks)
            times = np.zeros(len(found.words), np.int64)
            np.add.at(times, found.word, often[found.owner])
            ids, owner = word_ids(own, found, public_path(ranks))
            np.add.at(total, ids, times[owner])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["token", "n"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "token long, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def fit_weights(docs: DataFrame, text_col: str = "text", vocabulary: str = "byte_bpe_50k.json") -> np.ndarray:
    """Log probabilities of all ids, each counted once more than it occurs; added tokens have none."""
    own = codec(public_path(vocabulary))
    counts = np.array([1 if token else 0 for token in own.strings], np.int64)
    for r in count_ids(docs, text_col, vocabulary).collect():  # a row an id of the vocabulary
        counts[r["token"]] += r["n"]
    counts[list(own.added.values())] = 0
    return np.log(np.maximum(counts, 1) / max(1, counts.sum()))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", weights: Sequence[float] | None = None) -> DataFrame:
    """Token counts of every whole document: ``id, n_pretokens, n_tokens, log_score``.

    ``weights``: the log probability of each id, fitted to ``docs`` where none are given.
    ``log_score`` is rounded to 4 places. A null text counts as empty: zeros; very long
    texts are read whole, chunk by chunk; a null id stays null; repeated rows each give
    a row; an empty table gives no rows; extra columns are left out.
    """
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(np.asarray(fit_weights(docs, text_col, vocabulary) if weights is None else weights, float))  # the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = UnigramTrie(public_path(vocabulary), known.value)
        for ids, texts in blocks(batches, 1):
            words, tokens, scores = trie.count_all(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array([round(s, 4) + 0.0 for s in scores], pa.float64())], names=[id_col, "n_pretokens", "n_tokens", "log_score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_pretokens long, n_tokens long, log_score double")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(load(spark, sf_dir, "documents"))
