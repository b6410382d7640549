"""Merkle manifest of a dataset: trees of arity 8 kept in van Emde Boas layout.

Every row is a leaf: the SHA-256 of its fields. The leaves of a language, in order of doc_id, form
a tree; the roots of the languages form another one, whose root stands for the table.

A tree is stored as aligned subtrees of ``HEIGHT`` levels of edges (4,096 leaves). Inside such a
block the nodes lie in van Emde Boas order: the tree is cut at half its height, the upper part comes
first, then each lower part, and every part is laid out in the same way, so a path from leaf to root
touches few stretches of memory whatever the size of a cache line. :func:`address` finds a node by
arithmetic alone; it serves building and the retrieval of siblings. The roots of the blocks are the
leaves of the next tier, on which the same is done, until one block is left.

Only digests move. A task holds one block; a tree of any size takes one pass per tier, and a tier has
4,096 times fewer nodes than the one below. Numbers come from a range partitioning whose key
ends with the place of the row in its file, so repeated rows cannot gather in one task.

Nulls are written as ``-``. Rows without a language form the first group, rows without a doc_id come
first in theirs; rows of equal doc_id follow their digests. Repeated rows are leaves of their own.
An empty table has no leaf and no root. Empty and very long texts need no care: they are hashed
where they are. Other columns of ``docs`` are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscape.llm.common import stored
from callscape.scale import lookup_join, with_row_number

BITS = 3  # of the arity
ARITY = 1 << BITS
HEIGHT = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tree_size(levels: int) -> int:
    """Nodes of a complete tree."""
    return ((1 << BITS * levels) - 1) // (ARITY - 1)


def address(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Places of the nodes ``index`` at ``depth`` in a complete tree of so many levels."""
    index = np.asarray(index, np.int64)
    place = np.zeros_like(index)
    while levels > 1:
        top = levels // 2
        if depth >= top:
            depth -= top
            below = index >> (BITS * depth)  # number of the lower part
            place = place + tree_size(top) + below * tree_size(levels - top)
            index = index & ((1 << BITS * depth) - 1)
            levels -= top
        else:
            levels = top
    return place


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def block_height(n: int) -> int:
    """Levels of edges over ``n`` leaves that form a tree of their own."""
    height = 0
    while ARITY**height < n:
        height += 1
    return height


def build_block(leaves: list[str], height: int) -> bytes:
    """A block's digests in van Emde Boas order; places without a node are zero."""
    cells = np.zeros((tree_size(height + 1), 32), np.uint8)
    level = leaves
    for depth in range(height, -1, -1):
        raw = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, 32)
        cells[address(depth, np.arange(len(level)), height + 1)] = raw
        if depth:
            level = [_hash("".join(level[i : i + ARITY])) for i in range(0, len(level), ARITY)]
    return cells.tobytes()


def block_siblings(cells: bytes, height: int, n: int, offsets: np.ndarray) -> list[list[tuple[str, str]]]:
    """For each leaf at ``offsets``: the joined digests left and right of its path, upwards."""
    nodes = np.frombuffer(cells, np.uint8).reshape(-1, 32)
    paths: list[list[tuple[str, str]]] = [[] for _ in offsets]
    width, index = n, np.asarray(offsets, np.int64)
    for depth in range(height, 0, -1):
        text = nodes[address(depth, np.arange(width), height + 1)].tobytes().hex()
        first = index & ~(ARITY - 1)
        last = np.minimum(first + ARITY, width)
        for path, a, i, b in zip(paths, first.tolist(), index.tolist(), last.tolist(), strict=True):
            path.append((text[64 * a : 64 * i], text[64 * (i + 1) : 64 * b]))
        index, width = index >> BITS, -(-width // ARITY)
    return paths


def _build(height: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        total = int(pdf["n"].iat[0])
        own = min(height, block_height(total))
        cells = build_block([bytes(d).hex() for d in pdf["digest"]], own)
        return pd.DataFrame({
            "grp": pdf["grp"].iloc[:1], "block": pdf["block"].iloc[:1], "total": [total],
            "height": [own], "n": [len(pdf)], "nodes": [cells], "digest": [cells[:32]]})
    return run


def _block_of(column: str, height: int) -> Column:
    return F.call_function("shiftright", F.col(column), F.lit(BITS * height))


_BLOCK = "grp string, block long, total long, height int, n int, nodes binary, digest binary"


def build_tiers(leaves: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The stored blocks of each tier over ``leaves`` (grp, idx, n, digest), n being the number of
    leaves of the group. ``last`` marks the block that ends its group."""
    size = ARITY**height
    largest = leaves.agg(F.max("n")).first()[0] or 0
    tiers = []
    while True:
        blocks = leaves.withColumn("block", _block_of("idx", height)).groupBy("grp", "block")
        tiers.append(stored(blocks.applyInPandas(_build(height), _BLOCK).withColumn(
            "last", F.col("total") <= size), "blocks"))
        if largest <= size:
            return tiers
        largest = -(-largest // size)
        leaves = tiers[-1].where(~F.col("last")).select(
            "grp", F.col("block").alias("idx"),
            F.ceil(F.col("total") / size).cast("long").alias("n"), "digest")


# A path is text: for every level, upwards, the digests left of it, a bar, and those right of it.


def _join_path(levels: list[tuple[str, str]]) -> str:
    return "".join(f"{left}|{right}\n" for left, right in levels)


def _split_path(path: str) -> list[tuple[str, str]]:
    return [tuple(level.split("|")) for level in path.splitlines()]


def _inherit(height: int):
    """Paths of a block's leaves: their own levels, then the block's."""

    def run(children: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        block = blocks.iloc[0]
        offsets = children["idx"].to_numpy() & ((1 << BITS * height) - 1)
        found = block_siblings(block["nodes"], block["height"], block["n"], offsets)
        return pd.DataFrame({
            "name": children["name"], "idx": children["idx"], "root": block["root"],
            "path": [_join_path(levels) + block["path"] for levels in found]})
    return run


def _beside(children: DataFrame, blocks: DataFrame, height: int):
    children = children.withColumn("block", _block_of("idx", height))
    return children.groupBy("grp", "block").cogroup(blocks.groupBy("grp", "block"))


def _paths(children: DataFrame, blocks: DataFrame, height: int) -> DataFrame:
    """(name, idx, path, root) of ``children`` (grp, name, idx), leaves of ``blocks``, which carry
    their own path and root."""
    return _beside(children, blocks, height).applyInPandas(
        _inherit(height), "name string, idx long, path string, root string")


def _descend(tiers: list[DataFrame], heads: DataFrame, height: int) -> DataFrame:
    """The blocks of the lowest tier with path and root; ``heads`` (grp, path, root) has those of
    the groups' last blocks."""
    above = None
    for blocks in reversed(tiers):
        ends = blocks.where("last").join(heads, "grp")
        if above is not None:
            inner = blocks.where(~F.col("last"))
            found = _paths(inner.select("grp", F.col("grp").alias("name"), F.col("block").alias("idx")),
                           above, height)
            found = found.select(F.col("name").alias("grp"), F.col("idx").alias("block"), "path", "root")
            ends = ends.unionByName(inner.join(found, ["grp", "block"]))
        above = stored(ends, "paths")
    return above


def _roots(tiers: list[DataFrame]) -> DataFrame:
    ends = [b.where("last").select("grp", "digest") for b in tiers]
    out = ends[0]
    for more in ends[1:]:
        out = out.unionByName(more)
    return out


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """SHA-256 of a row's fields as bytes, with ``text`` for its text."""
    head = [_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.unhex(F.sha2(F.concat(*head, _field(text)), 256))


def numbered_leaves(docs: DataFrame) -> DataFrame:
    """grp, idx, n, doc_id, digest and the digest after tampering of every row. ``grp`` is a text
    that sorts like lang, nulls first."""
    altered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lower = F.translate("text", _UPPER, _LOWER)
    rows = docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit("")).alias("grp"),
        F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(F.col("text")).alias("digest"),
        F.when(altered, leaf_digest(lower)).alias("altered"),
        F.monotonically_increasing_id().alias("tie"))
    placed = with_row_number(rows, ["grp", "doc_id", "digest", "tie"], "row").drop("tie")
    groups = stored(placed.groupBy("grp").agg(F.min("row").alias("start"), F.count("*").alias("n")),
                    "groups")
    return lookup_join(placed, groups, "grp").select(
        "grp", (F.col("row") - F.col("start")).alias("idx"), "n", "doc_id", "digest",
        F.coalesce("altered", "digest").alias("altered"))


def manifest(leaves: DataFrame, height: int = HEIGHT) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """The tiers of the groups' trees, those of the tree over the groups, and the groups' roots
    (name, idx, digest)."""
    tiers = build_tiers(leaves, height)
    subroots = with_row_number(_roots(tiers), ["grp"], "idx")
    top = build_tiers(subroots.select(
        F.lit("").alias("grp"), "idx", F.lit(subroots.count()).alias("n"), "digest"), height)
    return tiers, top, subroots.select(F.col("grp").alias("name"), "idx", "digest")


def _verify(height: int):
    def run(leaves: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        block = blocks.iloc[0]
        above = _split_path(block["path"])
        shared = "".join(left + right for left, right in above)
        offsets = leaves["idx"].to_numpy() & ((1 << BITS * height) - 1)
        found = block_siblings(block["nodes"], block["height"], block["n"], offsets)
        proofs, folded = [], []
        for levels, digest in zip(found, leaves["altered"], strict=True):
            proofs.append(_hash("".join(left + right for left, right in levels) + shared))
            node = bytes(digest).hex()
            for left, right in (*levels, *above):
                node = _hash(left + node + right)
            folded.append(node)
        return pd.DataFrame({
            "doc_id": leaves["id"], "known": leaves["known"],
            "leaf": [bytes(d).hex() for d in leaves["digest"]],
            "subroot": block["subroot"], "root": block["root"], "proof_sha256": proofs,
            "folded_root": folded, "verified": [x == block["root"] for x in folded]})
    return run


def merkle_report(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (the hash of the joined siblings), folded_root and
    verified of every row."""
    leaves = stored(numbered_leaves(docs), "leaves")
    tiers, top, subroots = manifest(leaves, height)
    last = _roots(top).select("grp", F.lit("").alias("path"),
                              F.lower(F.hex("digest")).alias("root"))
    upper = _descend(top, last, height)
    heads = _paths(subroots.select(F.lit("").alias("grp"), "name", "idx"), upper, height)
    heads = stored(heads.select(F.col("name").alias("grp"), "path", "root"), "heads")
    named = subroots.select(F.col("name").alias("grp"), F.lower(F.hex("digest")).alias("subroot"))
    blocks = _descend(tiers, heads, height).drop("digest").join(named, "grp")
    # pandas would turn a column of numbers and nulls into floats
    leaves = leaves.withColumns(
        {"id": F.coalesce("doc_id", F.lit(0)), "known": F.col("doc_id").isNotNull()}).drop("doc_id")
    checked = _beside(leaves, blocks, height).applyInPandas(
        _verify(height), "doc_id long, known boolean, leaf string, subroot string, root string, "
        "proof_sha256 string, folded_root string, verified boolean")
    return checked.withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known")
