"""Near duplicates by SimHash fingerprints and a self-join over a binary trie of them.

A fingerprint has 64 bits: bit b is set where more than half of a text's shingles (three words,
repeats included) have it set in their XXH64 (seed 42). Fingerprints link when at most ``BUDGET`` bits
differ, and components of the links give the classes.

The join walks pairs of trie nodes together. A pair carries the number of differing bits of its two
prefixes; children of a pair that exceed the budget are pruned with everything below them.

1. Equal fingerprints are one leaf of the trie, however many documents have them.
2. The upper trie is built over all fingerprints by levels of ``STEP`` bits: a node with more than
   ``LEAF`` fingerprints is split, any other ends there. Distinct fingerprints of one node differ
   below it, so a crowded node is split until it is small.
3. Node pairs descend through the upper trie as rows of a table, level by level, pruned by the budget.
4. A surviving pair of end nodes is one cell: a task walks their sub-tries together, bit by bit, over
   arrays of node pairs, and leaves one row per linked fingerprint, never its pairs. The arrays are
   halved when they grow, so memory is bounded.

Nothing is dropped: every pair of fingerprints meets in exactly one cell, unless a common prefix
already shows more than ``BUDGET`` differences. A fingerprint has at most 2,080 others within two bits,
so work is bounded by that factor and not by the size of a group.

Texts of one or two words have one shingle, all their words; null texts and texts without words have
fingerprint zero, which links like any other. Null doc_ids take part and name a component only if it
has no other. Repeated rows and equal texts share a fingerprint. Very long texts are hashed in parts.
Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscape.llm.common import stored
from callscape.llm.components import connected_components

WIDTH = 3
SEED = 42
BITS = 64
BUDGET = 2
STEP = 4
LEAF = 16_384
PART = 1 << 16  # shingles hashed at a time
SMALL = 16  # node pairs with so few pairs of fingerprints are compared directly
FRONTIER = 1 << 17


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # of bytes: A-Z, and the six white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(WIDTH, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), PART):
        spans = zip(starts[at : at + PART].tolist(), ends[at : at + PART].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    over = 2 * counts > len(starts)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        found = [fingerprint(x.as_py() or b"") for x in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))],
            ["doc_id", "fp"])


class _Trie:
    """Sorted fingerprints; a node is a range that shares a prefix."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self._ones: dict[int, np.ndarray] = {}

    def middle(self, depth: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the one-child of each node at ``depth`` begins."""
        if depth not in self._ones:
            bit = (self.values >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            self._ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        ones = self._ones[depth]
        return high - (ones[high] - ones[low])


def trie_pairs(x: np.ndarray, y: np.ndarray | None, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints at most ``budget`` bits apart: of ``x`` and ``y``, or within ``x``
    (first index lower) where ``y`` is None. Both are sorted and distinct."""
    same = y is None
    left = _Trie(x)
    right = left if same else _Trie(y)
    if not len(left.values) or not len(right.values):
        return
    start = [np.array([v]) for v in (0, len(left.values), 0, len(right.values), 0)]
    stack = [(0, start)]
    while stack:
        depth, nodes = stack.pop()
        if len(nodes[0]) > FRONTIER:
            half = len(nodes[0]) // 2
            stack += [(depth, [c[:half] for c in nodes]), (depth, [c[half:] for c in nodes])]
            continue
        a0, a1, b0, b1, err = nodes
        few = ((a1 - a0) * (b1 - b0) <= SMALL) | (depth == BITS)
        if few.any():
            na, nb = (a1 - a0)[few], (b1 - b0)[few]
            each = na * nb
            node = np.repeat(np.arange(len(each)), each)
            within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            i = a0[few][node] + within // nb[node]
            j = b0[few][node] + within % nb[node]
            near = np.bitwise_count(left.values[i] ^ right.values[j]) <= budget
            if same:
                near &= i < j
            yield i[near], j[near]
        deep = ~few
        if not deep.any():
            continue
        a0, a1, b0, b1, err = (c[deep] for c in nodes)
        am, bm = left.middle(depth, a0, a1), right.middle(depth, b0, b1)
        twice = (a0 == b0) & (a1 == b1) if same else np.zeros(len(a0), bool)
        children = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1),
                    tuple(c[~twice] for c in (am, a1, b0, bm, err + 1))]
        joined = [np.concatenate(c) for c in zip(*children, strict=True)]
        alive = (joined[0] < joined[1]) & (joined[2] < joined[3]) & (joined[4] <= budget)
        if alive.any():
            stack.append((depth + 1, [c[alive] for c in joined]))


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the classes of ``i`` and ``j``; a class is named by its least member."""
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _cell_links(budget: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf["fp"].to_numpy().view(np.uint64)
        second = pdf["side"].to_numpy() == 1
        x, y = np.sort(values[~second]), np.sort(values[second])
        both = np.concatenate([x, y])
        shift = len(x) if second.any() else 0
        root, links = np.arange(len(both)), np.zeros(len(both), np.int64)
        for i, j in trie_pairs(x, y if second.any() else None, budget):
            root = merge(root, i, j + shift)
            links += np.bincount(i, minlength=len(both)) + np.bincount(j + shift, minlength=len(both))
        found = np.flatnonzero(links)
        return pd.DataFrame({"fp": both[found].view(np.int64), "root": both[root[found]].view(np.int64),
                             "links": links[found]})
    return run


def _prefix(depth: int):
    return F.call_function("shiftrightunsigned", F.col("fp"), F.lit(BITS - depth)) if depth else F.lit(0)


def upper_trie(prints: DataFrame, leaf: int) -> list[DataFrame]:
    """For each level of the upper trie its nodes (prefix, whole); ``whole`` nodes end there."""
    levels, left = [], prints
    while True:
        depth = STEP * len(levels)
        nodes = stored(
            left.groupBy(_prefix(depth).cast("long").alias("prefix")).agg(F.count("*").alias("n"))
            .select("prefix", ((F.col("n") <= leaf) | F.lit(depth == BITS)).alias("whole")), "nodes")
        levels.append(nodes)
        crowded = nodes.where(~F.col("whole"))
        if crowded.isEmpty():
            return levels
        left = left.withColumn("prefix", _prefix(depth).cast("long")).join(
            crowded.select("prefix"), "prefix", "left_semi").select("fp")


def node_pairs(levels: list[DataFrame], budget: int) -> DataFrame:
    """Pairs of end nodes (da, pa, db, pb: depths and prefixes) that the budget does not prune."""
    spark = levels[0].sparkSession
    pairs = spark.range(1).select(
        *[F.lit(0).cast(t).alias(c) for c, t in
          (("da", "int"), ("pa", "long"), ("db", "int"), ("pb", "long"), ("err", "int"))])
    done = None
    for at, nodes in enumerate(levels):
        depth = STEP * at
        ends = nodes.where("whole").select("prefix", F.lit(True).alias("whole"))
        mark = lambda d, p: (
            pairs.join(ends.withColumnsRenamed({"prefix": p, "whole": f"w{d}"}), p, "left"))
        pairs = mark("a", "pa")
        pairs = mark("b", "pb")
        here = {d: (F.col(f"d{d}") < depth) | F.coalesce(f"w{d}", F.lit(False)) for d in "ab"}
        pairs = stored(pairs.select("da", "pa", "db", "pb", "err", here["a"].alias("ea"),
                                    here["b"].alias("eb")), "pairs")
        over = pairs.where("ea and eb").select("da", "pa", "db", "pb")
        done = over if done is None else done.unionByName(over)
        if at + 1 == len(levels):
            return done
        below = levels[at + 1].select(
            F.call_function("shiftrightunsigned", F.col("prefix"), F.lit(STEP)).alias("up"),
            F.col("prefix").alias("child"))
        pairs = pairs.where("not (ea and eb)")
        for d in "ab":
            inner = pairs.where(f"not e{d}").join(
                below.withColumnsRenamed({"up": f"p{d}"}), f"p{d}").withColumns(
                {f"n{d}": F.col("child"), f"m{d}": F.lit(depth + STEP)}).drop("child")
            kept = pairs.where(f"e{d}").withColumns({f"n{d}": F.col(f"p{d}"), f"m{d}": F.col(f"d{d}")})
            pairs = inner.unionByName(kept)
        differ = F.bit_count(F.col("na").bitwiseXOR(F.col("nb")).bitwiseAND((1 << STEP) - 1))
        grown = F.when(~F.col("ea") & ~F.col("eb"), differ).otherwise(0)
        twice = (F.col("da") == F.col("db")) & (F.col("pa") == F.col("pb")) & (F.col("na") > F.col("nb"))
        pairs = pairs.where(~twice).select(
            F.col("ma").alias("da"), F.col("na").alias("pa"), F.col("mb").alias("db"),
            F.col("nb").alias("pb"), (F.col("err") + grown).cast("int").alias("err"),
        ).where(F.col("err") <= budget)


def fingerprint_links(prints: DataFrame, budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """(fp, root, links) of each linked fingerprint, from each cell; ``prints`` (fp) are distinct."""
    levels = upper_trie(prints, leaf)
    cells = stored(node_pairs(levels, budget), "cells")
    members = None
    for at, nodes in enumerate(levels):
        depth = STEP * at
        here = prints.withColumn("prefix", _prefix(depth).cast("long")).join(
            nodes.where("whole").select("prefix"), "prefix").select(
            F.lit(depth).alias("depth"), "prefix", "fp")
        members = here if members is None else members.unionByName(here)
    members = stored(members, "members")
    first = cells.join(members.withColumnsRenamed({"depth": "da", "prefix": "pa"}), ["da", "pa"])
    other = cells.where("da <> db or pa <> pb").join(
        members.withColumnsRenamed({"depth": "db", "prefix": "pb"}), ["db", "pb"])
    rows = first.withColumn("side", F.lit(0).cast("byte")).unionByName(
        other.withColumn("side", F.lit(1).cast("byte")))
    return rows.groupBy("da", "pa", "db", "pb").applyInPandas(
        _cell_links(budget), "fp long, root long, links long")


def simhash_duplicates(docs: DataFrame, budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """doc_id, fingerprint, component_id (the least doc_id reachable by links) and n_links (the number
    of other fingerprints that the document's links to)."""
    prints = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
        .mapInArrow(_fingerprint_rows, "doc_id long, fp long"), "prints")
    kinds = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "kinds")
    found = stored(fingerprint_links(kinds.select("fp"), budget, leaf), "links")
    parts = connected_components(found.select(F.col("fp").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy("fp").agg(F.sum("links").alias("n_links"))
    rooted = kinds.join(parts, kinds["fp"] == parts["v"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(least, "root").join(degree, "fp", "left").select(
        "fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "named")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
