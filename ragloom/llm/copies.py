"""Operator 6 at a wide budget, for the pipeline: near copies by the similarity of their shingles.

Documents link where their sets of ``WORDS``-word shingles have a Jaccard similarity of
``SIMILAR`` or more. Such pairs differ in up to ``WIDE`` of the fingerprint's 64 bits, so
many that blocks of bits (``simhash.groups``) would have one or two bits each and part
nothing. So operator 6 runs as it is, blocks of bits and all, at ``EXACT`` differing bits,
within which no pair is missed; for pairs further apart groups from minima of the
shingles' hashes are added, in which the tries are joined with themselves under the wide
budget. What both lead to is verified with the exact similarity. Beyond ``EXACT`` bits
groups and budget may leave out: a pair of similarity 0.8 shares no group in 3 of a
million cases, and has more than ``WIDE`` differing bits in fewer.
Whatever is large (a group, a candidate component) is cut into blocks, and all pairs of
blocks meet, each in a task of its own. Texts are numbered, so that only their numbers,
fingerprints and groups are shuffled until they are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.components import connected_components
from ragloom.llm.shared import append_columns, checkpoint, small_batches
from ragloom.llm.simhash import SEED, labels, links, majority, shingle_hashes, traverse, words_of

#: Words in a shingle, the similarity from which documents are linked, and the bits that may
#: differ (at 0.8 some ten of 64 differ; this is five standard errors more).
WORDS, SIMILAR, WIDE = 5, 0.8, 26
#: Differing bits up to which operator 6's own blocks of bits find all pairs.
EXACT = 3
#: Groups of a document, and minima in a group's key.
BANDS, ROWS = 24, 4
#: Members of a group's block, and characters of a component's; group members and characters that
#: a task takes at once, about.
BLOCK, BLOCK_CHARS, MEMBERS, TEXTS = 8192, 1 << 23, 100_000, 1 << 24
#: Fingerprints of a group whose tries are joined at once.
TRIE = 512

_random = np.random.default_rng(SEED)
TIMES = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
PLUS = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def key_of(words: list[bytes]) -> str:
    """Equal for equal words only: 128 bits."""
    return xxhash.xxh3_128_hexdigest(b" ".join(words))


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the different shingles."""
    return np.unique(shingle_hashes(words, WORDS))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each of ``BANDS * ROWS`` families."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[i : i + 1024, None] * TIMES + PLUS).min(0))
    return least


def with_key(docs: DataFrame, text_col: str, key: str) -> DataFrame:
    """``docs`` and the key of each text."""
    return append_columns(docs, text_col, lambda: lambda texts: [pa.array([key_of(words_of(v.as_py())) for v in texts], pa.string())], f"`{key}` string")


def sketches(docs: DataFrame, text_col: str) -> DataFrame:
    """``key, bands array<long>, bits long``: the groups and the fingerprint of each text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bands, prints = [], [], []
            for v in batch.column(0):
                words = words_of(v.as_py())
                own = shingles(words)
                keys.append(key_of(words))
                least = minima(own)
                bands.append([xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63) for i in range(BANDS)] if words else [])
                prints.append(majority(own))
            bits = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.int64())], names=["key", "bands", "bits"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "key string, bands array<long>, bits long")


def in_blocks(rows: DataFrame, sizes: DataFrame, group: str, key: str, at_once: int, block: int) -> DataFrame:
    """``rows`` with ``task``: a group's number where it fits into two blocks, else one for each pair of its blocks.

    ``sizes`` has the group and ``size``; rows of other groups drop out. A row of a large
    group is repeated once for each block of it. Tasks are dealt to partitions of about
    ``at_once`` in size (``shard``).
    """
    spark = rows.sparkSession
    blocks = F.when(F.col("size") > 2 * block, F.ceil(F.col("size") / block)).cast("int")
    dealt = rows.join(sizes.select(group, blocks.alias("blocks")), group)
    own = F.coalesce(F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"), F.lit(0))
    others = F.filter(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda x: F.col("blocks").isNull() | (x != own))
    met = dealt.withColumn("other", F.explode(others)).withColumn("task", F.xxhash64(group, F.least(own, "other"), F.greatest(own, "other"))).drop("other", "blocks")
    copies = F.greatest(F.lit(1), F.coalesce(blocks, F.lit(1)) - 1)
    total = sizes.agg(F.coalesce(F.sum(F.col("size") * copies), F.lit(0))).first()[0]
    shards = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), int(total) // at_once)
    return met.withColumn("shard", F.pmod(F.xxhash64("task"), F.lit(shards * 4))).repartition(shards, "shard")


def near_prints(group: np.ndarray, bits: np.ndarray, budget: int = WIDE) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all pairs of one group within the budget connect, equal fingerprints included.

    Small groups' tries are joined together. A large group's are joined part by part, and
    parts whose members are all connected already aren't met again, so that a tight
    group costs as many joins as it has parts.
    """
    order = np.lexsort((bits, group))
    group, bits = group[order], bits[order]
    equal = np.flatnonzero((group[1:] == group[:-1]) & (bits[1:] == bits[:-1]))
    first = np.r_[True, (group[1:] != group[:-1]) | (bits[1:] != bits[:-1])]
    a, b = [order[equal]], [order[equal + 1]]
    order, group, bits = order[first], group[first], bits[first]

    def link(own: slice, x: np.ndarray, y: np.ndarray) -> None:
        label = labels(own.stop - own.start, x - own.start, y - own.start)
        at = np.flatnonzero(label != np.arange(len(label)))
        a.append(order[own.start + at])
        b.append(order[own.start + label[at]])

    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(group)]
    small = np.flatnonzero(ends - starts <= TRIE)
    cost = np.cumsum((ends - starts)[small] ** 2)
    for part in np.split(small, np.flatnonzero(np.diff(cost // (4 * TRIE * TRIE))) + 1):
        if len(part):
            x, y = traverse(bits, starts[part], ends[part], starts[part], ends[part], budget)
            own = slice(int(starts[part[0]]), int(ends[part[-1]]))
            link(own, x, y)
    for start, end in zip(starts[ends - starts > TRIE].tolist(), ends[ends - starts > TRIE].tolist(), strict=True):
        cuts = [*range(start, end, TRIE), end]
        parts = list(zip(cuts, cuts[1:], strict=False))
        label, xs, ys = np.arange(end - start), [], []
        for i, one in enumerate(parts):
            for two in parts[i:]:
                seen = np.r_[label[one[0] - start : one[1] - start], label[two[0] - start : two[1] - start]]
                if (seen == seen[0]).all() and len(seen) > 1:
                    continue
                x, y = traverse(bits, *(np.array([v]) for v in (*one, *two)), budget)
                xs.append(x - start)
                ys.append(y - start)
                if len(x):
                    label = labels(end - start, np.r_[np.arange(end - start), xs[-1]], np.r_[label, ys[-1]])
        at = np.flatnonzero(label != np.arange(len(label)))
        a.append(order[start + at])
        b.append(order[start + label[at]])
    return np.concatenate(a), np.concatenate(b)


def joined_by(n: int, similar) -> tuple[list[int], list[int]]:
    """Links of a forest that connects what all similar pairs of ``n`` members connect.

    ``similar(i, js)`` tells which of ``js`` are similar to ``i``. Pairs that are connected
    already aren't asked for, so a tight cluster costs one pass.
    """
    part, a, b = np.arange(n), [], []
    for i in range(n):
        js = i + 1 + np.flatnonzero(part[i + 1 :] != part[i])
        if not len(js):
            if (part == part[0]).all():
                break
            continue
        for j in js[similar(i, js)].tolist():
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
                a.append(i)
                b.append(j)
    return a, b


def verified(sets: list[np.ndarray]):
    """Exact similarity of sets of shingles."""
    sizes = np.array([len(s) for s in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [flat[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    mark = np.zeros(len(values), bool)

    def similar(i: int, js: np.ndarray) -> np.ndarray:
        out = np.zeros(len(js), bool)
        fit = np.flatnonzero(np.minimum(sizes[js], sizes[i]) >= SIMILAR * np.maximum(sizes[js], sizes[i]))
        if len(fit):
            near = js[fit]
            mark[own[i]] = True
            both = np.add.reduceat(mark[np.concatenate([own[j] for j in near])], np.r_[0, np.cumsum(sizes[near])[:-1]], dtype=np.int64)
            mark[own[i]] = False
            # In whole numbers: both / (all - both) >= 4 / 5.
            out[fit] = both * 100 >= round(SIMILAR * 100) * (sizes[near] + sizes[i] - both)
        return out

    return similar


def within_few_bits(classes: DataFrame) -> DataFrame:
    """``a, b``: links that connect all numbered texts within ``EXACT`` differing bits, by operator 6."""
    own = classes.where(F.size("bands") > 0).select("n", "bits")  # texts without a word are near to nothing
    first = checkpoint(own.groupBy("bits").agg(F.min("n").alias("first")))
    apart = links(first.select("bits"), EXACT)
    apart = apart.join(first.toDF("a", "one"), "a").join(first.toDF("b", "two"), "b").select(F.col("one").alias("a"), F.col("two").alias("b"))
    equal = own.join(first, "bits").where("n != first").select(F.col("n").alias("a"), F.col("first").alias("b"))
    return apart.unionByName(equal)


def copy_components(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``node, component``: keys (see ``with_key``) of texts that have near copies.

    Texts without a word, null ones included, are equal to each other and near to nothing
    else. Equal texts collapse before anything meets. Very long texts are read whole;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    once = sketches(docs, text_col).groupBy("key").agg(F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = checkpoint(once.withColumn("n", F.monotonically_increasing_id()))  # numbers are fixed by the checkpoint
    members = classes.select("n", "bits", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    small_batches(spark, 20_000)
    numbers = "a long, b long"

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["n"].to_numpy(np.int64)
        a, b = near_prints(rows["task"].to_numpy(np.int64), rows["bits"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"a": own[a], "b": own[b]}).drop_duplicates()

    tasks = in_blocks(members, sizes, "band", "n", MEMBERS, BLOCK).select("shard", "task", "n", "bits")
    near = tasks.groupBy("shard").applyInPandas(meet, numbers).unionByName(within_few_bits(classes))
    candidates = connected_components(near).withColumnRenamed("node", "n")
    known = checkpoint(classes.select("key", "n").join(candidates, "n"))
    keyed = with_key(docs.select(F.col(text_col).cast("string").alias("text")), "text", "key")
    # Equal texts differ in case and white space only, so any of them will do.
    once = keyed.join(known, "key").groupBy("n").agg(F.first("component").alias("component"), F.first("text").alias("text"))
    once = once.withColumn("chars", F.length("text").cast("long"))
    once = checkpoint(once)
    sizes = once.groupBy("component").agg(F.sum("chars").alias("size"), F.count("*").alias("members")).where("members > 1")

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, own in rows.groupby("task", sort=False):
            own_n = own["n"].to_numpy(np.int64)
            x, y = joined_by(len(own), verified([shingles(words_of(t)) for t in own["text"]]))
            a += own_n[x].tolist()
            b += own_n[y].tolist()
        return pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})

    tasks = in_blocks(once, sizes, "component", "n", TEXTS, BLOCK_CHARS).select("shard", "task", "n", "text")
    found = connected_components(tasks.groupBy("shard").applyInPandas(verify, numbers))
    names = known.select("n", "key")
    named = found.join(names.toDF("node", "own"), "node").join(names.toDF("component", "of"), "component")
    return named.select(F.col("own").alias("node"), F.col("of").alias("component"))
