"""Operator 6: SimHash near-duplicates by a self-join of binary tries.

Fingerprints of 64 bits link at ``BUDGET`` or fewer differing bits. Cut into
``BUDGET + 1`` blocks, two linked fingerprints agree on a block at least, so each
fingerprint goes to one group for each block. A group with too many members is cut
again within its free bits, which ends because fingerprints are distinct. In each
group the fingerprints, sorted from the free bits on, form a binary trie; pairs of
its nodes are traversed together from the root, their differing bits add up, and a
pair goes as soon as these exceed the budget.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.components import connected_components
from ragloom.llm.shared import checkpoint, hot_left_join, load, small_batches

#: Bits that may differ, words in a shingle, and the hash's seed.
BUDGET, SHINGLE, SEED = 2, 3, 42
#: Members above which a group is cut again.
GROUP = 4096

#: Members whose groups a task takes at once, about; bounds its memory at any size.
SHARD = 200_000

#: Fixed value: a word, in bytes of UTF-8.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
UPPER_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased; none of a null or blank one."""
    return WORD.findall((text or "").encode("utf-8", "replace").translate(UPPER_TO_LOWER))


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles, repeats included; fewer words than a shingle takes make one."""
    h = xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([h(b" ".join(words), SEED)] if words else [], "<u8")
    return np.array([h(b" ".join(x), SEED) for x in zip(*[words[i:] for i in range(size)], strict=False)], "<u8")


def fingerprint(text: str | None) -> int:
    """SimHash of a text's word shingles, repeats included; 0 if it has no word."""
    return majority(shingle_hashes(words_of(text)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, bits long``: the fingerprint as a signed integer."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(v.as_py()) for v in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.int64())], names=[id_col, "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, bits long")


def cut_free(free: int, parts: int = BUDGET + 1) -> list[int]:
    """Masks of the ``parts`` blocks into which the free bits are cut evenly, highest bits first."""
    bits = [i for i in range(63, -1, -1) if free >> i & 1]
    ends = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << i for i in bits[x:y]) for x, y in zip(ends, ends[1:], strict=False) if y > x]


def signed(x: int) -> int:
    """A 64-bit pattern as the signed integer that Spark holds."""
    return x - (1 << 64) if x >> 63 else x


def groups(prints: DataFrame, limit: int = GROUP, *, budget: int = BUDGET) -> DataFrame:
    """``fixed, held, bits``: each distinct fingerprint in its groups of at most ``limit``.

    ``fixed`` is the mask on which the group's members agree, ``held`` their value there.
    Groups that are too large are cut within their free bits until none is left: no
    fingerprint is dropped. The masks are few and depend on the number of cuts alone.
    A limit below ``2 ** budget`` is refused: a group above the limit could have so few
    free bits left that they make no block more than may differ, and would lose links.
    """
    if limit < 2**budget:
        raise ValueError(f"groups of {limit} can't hold what {budget} bits may differ in")
    done, todo, masks = [], prints.select("bits"), [0]
    while True:
        todo = todo.withColumn("old", F.col("fixed")) if "fixed" in todo.columns else todo.withColumn("old", F.lit(0).cast("long"))
        children = {m: [m | b for b in cut_free(~m & (1 << 64) - 1, budget + 1)] for m in masks}
        options = F.create_map(*[x for m, c in children.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(k)).cast("long") for k in c]))])
        dealt = todo.select("bits", F.explode(options[F.col("old")]).alias("fixed")).withColumn("held", F.col("bits").bitwiseAND(F.col("fixed"))).distinct()
        dealt = checkpoint(dealt)
        sizes = dealt.groupBy("fixed", "held").agg(F.count("*").alias("n"))
        large = checkpoint(sizes.where(F.col("n") > limit).select("fixed", "held"))
        masks = [r["fixed"] & (1 << 64) - 1 for r in large.select("fixed").distinct().collect()]  # masks, not data
        # Groups of one member hold no pair.
        done.append(dealt.join(sizes.where((F.col("n") > 1) & (F.col("n") <= limit)).select("fixed", "held"), ["fixed", "held"], "left_semi"))
        if not masks:
            break
        todo = dealt.join(large, ["fixed", "held"], "left_semi").select("bits", "fixed")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def trie_pairs(group: np.ndarray, bits: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within ``budget`` differing bits, in many tries at once.

    The rows are sorted by (group, bits), and distinct.
    """
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(bits)]
    return traverse(bits, starts, ends, starts, ends, budget)


def traverse(bits: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the budget below the given pairs of nodes.

    A node is a range of sorted rows that share a prefix. All node pairs of one depth
    are traversed together, from the highest bit down; a pair's two ranges are equal or
    apart.
    """
    err = np.zeros(len(a0), np.int8)
    for depth in range(63, -1, -1):
        ones = np.r_[0, np.cumsum((bits >> np.uint64(depth)) & np.uint64(1), dtype=np.int64)]
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        sides = [(a0, am, b0, bm, err, None), (am, a1, bm, b1, err, None), (a0, am, bm, b1, err + 1, None), (am, a1, b0, bm, err + 1, ~same)]
        kept = []
        for x0, x1, y0, y1, e, only in sides:
            ok = (x1 > x0) & (y1 > y0) & (e <= budget) & ~((x0 == y0) & (x1 - x0 == 1))
            if only is not None:
                ok &= only
            kept.append((x0[ok], x1[ok], y0[ok], y1[ok], e[ok]))
        a0, a1, b0, b1, err = (np.concatenate(c) for c in zip(*kept, strict=True))
        if not len(a0):
            break
    return a0, b0


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` members the smallest one that the links lead to, by whole-array passes."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            leap = label[label]
            if (leap == label).all():
                break
            label = leap
    return label


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect what the given ones connect: every member with its smallest."""
    label = labels(n, a, b)
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def links(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``a, b``: links that connect all distinct fingerprints within the budget.

    Of the pairs found in one task a spanning forest goes on, so that a tight cluster
    gives as many rows as members and its components stay the same.
    """
    spark = prints.sparkSession
    small_batches(spark, 20_000)
    members = groups(prints, budget=budget)
    shards = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), (budget + 1) * prints.count() // SHARD)
    dealt = members.withColumn("shard", F.pmod(F.xxhash64("fixed", "held"), F.lit(shards * 4))).repartition(shards, "shard")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        bits = rows["bits"].to_numpy(np.int64).view(np.uint64)
        _, group = np.unique(np.stack([rows["fixed"].to_numpy(), rows["held"].to_numpy()], 1), axis=0, return_inverse=True)
        order = np.lexsort((bits, group.ravel()))
        bits = bits[order]
        a, b = trie_pairs(group.ravel()[order], bits, budget)
        own, at = np.unique(bits, return_inverse=True)
        a, b = forest(len(own), at[a], at[b])
        return pd.DataFrame({"a": own[a].view(np.int64), "b": own[b].view(np.int64)})

    return dealt.select("fixed", "held", "bits", "shard").groupBy("shard").applyInPandas(run, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """``id, fingerprint, component_id`` of every document.

    ``component_id`` is the smallest id reachable by links, its own included. Null,
    empty and blank texts have fingerprint zero and link like any other. A null id
    takes part in no component's minimum, and gets its component's id (null where no
    other id is in it). Texts of any length are read whole, one at a time; repeated rows
    each give a row; an empty table gives no rows; extra columns are left out.
    """
    prints = checkpoint(fingerprints(docs, id_col, text_col))
    classes = checkpoint(prints.groupBy("bits").agg(F.min(id_col).alias("least")))
    parts = connected_components(links(classes, budget))
    joined = classes.join(parts.withColumnRenamed("node", "bits"), "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    label = joined.join(least, "component").select("bits", "component_id")
    sizes = prints.groupBy("bits").agg(F.count("*").alias("n"))
    return hot_left_join(prints, label, ["bits"], sizes).select(F.col(id_col), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents; odd rows as in ``simhash_components``."""
    return simhash_components(load(spark, sf_dir, "documents"))
