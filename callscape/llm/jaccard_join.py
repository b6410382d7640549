"""Exact Jaccard similarity join of documents over word shingles with a token-group matrix.

Documents link when ``100 * |A n B| >= percent * |A u B|`` on their sets of distinct shingles.

1. Equal sets are one class, named by 64 bits of a digest, however many copies there are.
2. Every shingle's document frequency is counted over all classes. Shingles move packed: a task sorts
   those of many documents into ranges of the hash space and sends one row per range. Only shingles
   of two classes or more come back, also packed. A set of n shingles needs ``ceil(percent * n / 100)``
   in common with a partner, so a class with fewer shared shingles has none and is done. That is the
   fate of most documents, and no other plan is taken when it is not.
3. The rest is partitioned into groups of similar documents: neighbours in the order of their least
   shingle hashes, at most ``GROUP_ROWS`` in a group, long documents alone.
4. Shingles are ordered by document frequency, rarest first. Two linked sets share a shingle of their
   prefixes, that is, all but the ``ceil(percent * n / 100) - 1`` last ones of each. The matrix holds a
   row per shingle and group with the shingle in a member's prefix: the group's token union cut to
   what a bound can need. Probing it with a document's prefix gives the groups that the document has
   to open, among its own and later ones; other groups never see its set.
5. Where a group is opened, each query's overlap with the union of all its members' tokens bounds its
   overlap with every one of them, and only queries that reach the required overlap are counted
   against members. A group with many queries is opened in several cells of ``CELL_QUERIES``.
6. Components of the links give the answer.

No link is lost, and nothing is capped. What leaves a cell is one row per linked class, never its pairs.
Within thousands of *different* near copies every pair is a link that is counted, so that part is
quadratic; its documents move once per cell. Passages that many documents share sort last and reach no
prefix unless they make up most of a document.

Nulls and texts without words have empty sets: they link with nothing and are their own
components. A null doc_id takes part in links, but does not name a component unless nothing else
does. Rows with equal texts, repeated rows included, share a class. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscape.llm.common import stored
from callscape.llm.components import connected_components
from callscape.llm.shingles import shingle_sets
from callscape.scale import lookup_join, with_row_number

PERCENT = 90
BUCKET_TOKENS = 4_000_000  # shingles of a range of the hash space, on average
BATCH_TOKENS = 2_000_000  # shingles that a task sorts at a time
BATCH_DOCS = 60_000
GROUP_ROWS = 128
GROUP_TOKENS = 1 << 14  # a longer set is a group of its own
CELL_QUERIES = 1024
_TOKEN = 6  # bytes of a shingle hash that move; its range gives the others


def required(n, percent: int):
    """Shingles that a set of ``n`` must share with any partner."""
    return -(-n * percent // 100)


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def _named_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for s in shingle_sets(_bytes(column), width):
        digest = hashlib.blake2b(s.tobytes(), digest_size=8).digest()
        yield int.from_bytes(digest, "little", signed=True), s


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, sizes = [], []
                for key, s in _named_sets(part.column("text"), width):
                    keys.append(key)
                    sizes.append(len(s))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("place"), pa.array(sizes, pa.int64()),
                     pa.array(keys, pa.int64())], ["doc_id", "place", "n", "k"])
    return run


# Packed tokens: a row holds the shingles of several classes in one range. ``ks`` and ``ns`` have the
# classes' names and set sizes, ``counts`` how many of the row's tokens each of them has, in order.

_PACKED = "bucket int, ks binary, ns binary, counts binary, tokens binary"


def _packed_tokens(width: int, buckets: int):
    def pack(keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.concatenate(sets)
        size = np.array([len(s) for s in sets])
        doc = np.repeat(np.arange(len(sets)), size)
        bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        tokens, doc, bucket = tokens[order], doc[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows: dict[str, list] = {c: [] for c in ("bucket", "ks", "ns", "counts", "tokens")}
        names = np.array(keys, np.int64)
        for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
            first = np.flatnonzero(np.diff(doc[a:b], prepend=-1))
            mine = doc[a:b][first]
            rows["bucket"].append(int(bucket[a]))
            rows["ks"].append(names[mine].tobytes())
            rows["ns"].append(size[mine].astype("<u4").tobytes())
            rows["counts"].append(np.diff(first, append=b - a).astype("<u4").tobytes())
            rows["tokens"].append(tokens[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_TOKEN].tobytes())
        return pa.RecordBatch.from_pydict(rows, pa.schema(
            [("bucket", pa.int32()), *((c, pa.binary()) for c in ("ks", "ns", "counts", "tokens"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        total = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for key, s in _named_sets(batch.column("text").slice(at, 256), width):
                    if len(s) and key not in held:
                        held[key] = s
                        total += len(s)
                if total >= BATCH_TOKENS or len(held) >= BATCH_DOCS:
                    yield pack(list(held), list(held.values()))
                    held, total = {}, 0
        if held:
            yield pack(list(held), list(held.values()))

    return run


def _unpacked(pdf: pd.DataFrame, token: str):
    join = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in pdf[c]])
    counts = join("counts", "<u4")
    return np.repeat(join("ks", "<i8"), counts), np.repeat(join("ns", "<u4"), counts), join("tokens", token)


def _shared_tokens(parts: int):
    """Of a range, the shingles of two classes or more with their frequency, packed by class."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        join = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in pdf[c]])
        names, sizes, counts = join("ks", "<i8"), join("ns", "<u4"), join("counts", "<u4")
        doc = np.repeat(np.arange(len(names), dtype=np.uint32), counts)
        token, at = np.zeros(len(doc), "<u8"), 0
        places = token.view(np.uint8).reshape(-1, 8)
        for x in pdf["tokens"]:
            some = np.frombuffer(x, np.uint8).reshape(-1, _TOKEN)
            places[at : at + len(some), :_TOKEN] = some
            at += len(some)
        # most shingles occur once: only the others take their names and sizes along
        order = np.argsort(token)
        token = token[order]
        same = token[1:] == token[:-1]
        twice = np.zeros(len(token), bool)
        twice[1:] = same
        twice[:-1] |= same
        token, doc = token[twice], doc[order[twice]]
        del order, places, same, twice
        key = names[doc]  # then once more without the repeats of equal sets
        order = np.lexsort((key, token))
        token, key, doc = token[order], key[order], doc[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, key, doc = token[new], key[new], doc[new]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])[: len(token)])
        times = np.diff(first, append=len(token))
        df = np.repeat(times.astype(np.uint32), times)
        token, key, n, df = token[df > 1], key[df > 1], sizes[doc[df > 1]], df[df > 1]
        del order, doc, new
        token = token + (np.uint64(pdf["bucket"].iat[0]) << np.uint64(8 * _TOKEN))
        part = (key.view(np.uint64) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((key, part))
        token, key, n, df, part = token[order], key[order], n[order], df[order], part[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        out = []
        for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
            mine = np.flatnonzero(np.concatenate([[True], key[a + 1 : b] != key[a : b - 1]]))
            out.append((int(part[a]), key[a:b][mine].tobytes(), n[a:b][mine].astype("<u4").tobytes(),
                        np.diff(mine, append=b - a).astype("<u4").tobytes(),
                        token[a:b].tobytes(), df[a:b].astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["part", "ks", "ns", "counts", "tokens", "dfs"])

    return run


def _candidates(percent: int):
    """Of a part of the classes, those with enough shared shingles: the shared shingles, sorted, and
    those of the prefix."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, n, token = _unpacked(pdf, "<u8")
        df = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["dfs"]])
        order = np.lexsort((token, df, key))
        key, n, token = key[order], n[order].astype(np.int64), token[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(first, append=len(key))
        least = required(n[first], percent)
        out = []
        for at in np.flatnonzero(size >= least).tolist():
            mine = token[first[at] : first[at] + size[at]]
            whole = np.sort(mine)
            out.append((int(key[first[at]]), int(n[first[at]]), whole.tobytes(),
                        mine[: size[at] - least[at] + 1].view(np.int64),
                        int(whole[:1].view(np.int64)[0]), int(whole[1:2].view(np.int64).sum())))
        return pd.DataFrame(out, columns=["k", "n", "tokens", "prefix", "h1", "h2"])

    return run


def _links(percent: int):
    """Links between a cell's queries and the members of its group, and within the group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", ignore_index=True)
        sets = [np.frombuffer(x, np.uint64) for x in pdf["tokens"]]
        shared = np.array([len(s) for s in sets])
        size = pdf["n"].to_numpy()
        asks, belongs = pdf["query"].to_numpy(), pdf["member"].to_numpy()
        members = np.flatnonzero(belongs)
        root, links = np.arange(len(sets)), np.zeros(len(sets), np.int64)
        union, place = np.unique(np.concatenate([sets[m] for m in members]), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(shared[members])[:-1]])
        mark = np.zeros(len(union), bool)
        for q in np.flatnonzero(asks).tolist():
            at = np.searchsorted(union, sets[q])
            at[at == len(union)] = 0
            at = at[union[at] == sets[q]]
            if 100 * len(at) < percent * size[q]:  # even the whole group has too little in common
                continue
            mark[at] = True
            common = np.add.reduceat(mark[place], starts, dtype=np.int64)
            mark[at] = False
            found = members[100 * common >= percent * (size[q] + size[members] - common)]
            found = found[found > q] if belongs[q] else found
            if not len(found):
                continue
            links[q] += len(found)
            links[found] += 1
            roots = np.unique(root[np.append(found, q)])
            root[np.isin(root, roots)] = roots[0]
        found = np.flatnonzero(links)
        name = pdf["k"].to_numpy()
        return pd.DataFrame({"k": name[found], "root": name[root[found]], "links": links[found]})

    return run


def _linked(rows: DataFrame, tokens: int, percent: int, width: int, bucket_tokens: int,
            group_rows: int, cell_queries: int) -> DataFrame:
    """(k, root, links) of classes that have a link, from each cell. ``tokens`` is the number of all
    shingles."""
    buckets = -(-tokens // bucket_tokens) or 1
    packed = rows.select("text").mapInArrow(_packed_tokens(width, buckets), _PACKED)
    shared = packed.groupBy("bucket").applyInPandas(
        _shared_tokens(buckets), "part int, ks binary, ns binary, counts binary, tokens binary, dfs binary")
    able = shared.groupBy("part").applyInPandas(
        _candidates(percent), "k long, n long, tokens binary, prefix array<long>, h1 long, h2 long")
    able = stored(able, "able")
    long = F.col("n") > GROUP_TOKENS
    members = with_row_number(able.select("k", "n", "h1", "h2"), ["h1", "h2", "k"], "no").select(
        "k", F.when(long, -1 - F.col("no")).otherwise(F.expr(f"no div {group_rows}")).alias("grp"))
    members = stored(members, "members")
    prefixes = stored(able.select("k", F.explode("prefix").alias("token")).join(members, "k"), "prefixes")
    matrix = prefixes.groupBy("token").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b")
    live = stored(prefixes.join(matrix.select("token"), "token"), "live")
    probes = live.withColumnRenamed("grp", "own").join(
        live.select("token", "grp").distinct(), "token").where("own <= grp")
    probes = stored(probes.select("k", "grp", (F.col("own") == F.col("grp")).alias("member")).distinct(),
                    "probes")
    askers = probes.where(~F.col("member")).groupBy("grp").agg(F.count("*").alias("asked"))
    cells = stored(
        members.select("grp").distinct().join(askers, "grp", "left").select(
            "grp", F.greatest(F.ceil(F.coalesce("asked", F.lit(0)) / cell_queries), F.lit(1)).cast("int")
            .alias("cells")), "cells")
    opened = probes.select("grp").distinct()
    guests = probes.where(~F.col("member")).join(cells, "grp").select(
        "k", "grp", F.pmod(F.xxhash64("k"), F.col("cells")).cast("int").alias("cell"),
        F.lit(True).alias("query"), F.lit(False).alias("member"))
    hosts = members.join(opened, "grp").join(cells, "grp").select(
        "k", "grp", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell")).select(
        "k", "grp", "cell", (F.col("cell") == 0).alias("query"), F.lit(True).alias("member"))
    seats = stored(guests.unionByName(hosts), "seats")
    return seats.join(able.select("k", "n", "tokens"), "k").groupBy("grp", "cell").applyInPandas(
        _links(percent), "k long, root long, links long")


def _classes(docs: DataFrame, percent: int, width: int, bucket_tokens: int = BUCKET_TOKENS,
             group_rows: int = GROUP_ROWS, cell_queries: int = CELL_QUERIES) -> tuple[DataFrame, DataFrame]:
    """Every row's doc_id, place (a hash of id and text), set size n and class k; and the root and
    number of links of the classes that have links."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).select(
        "doc_id", "text", F.xxhash64("doc_id", "text").alias("place"))
    sets = stored(rows.mapInArrow(_set_rows(width), "doc_id long, place long, n long, k long"), "sets")
    tokens = sets.agg(F.sum("n")).first()[0] or 0
    found = stored(_linked(rows, tokens, percent, width, bucket_tokens, group_rows, cell_queries), "links")
    parts = connected_components(found.select(F.col("k").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy("k").agg(F.sum("links").alias("n_links"))
    linked = stored(degree.join(parts, degree["k"] == parts["v"], "left").select(
        "k", F.coalesce("root", "k").alias("root"), "n_links"), "linked")
    return sets, linked


def similar_documents(docs: DataFrame, percent: int = PERCENT, width: int = 3, **sizes) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) and n_links (the
    number of different shingle sets that the document links to)."""
    sets, linked = _classes(docs, percent, width, **sizes)
    classes = sets.where("n > 0").groupBy("k").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(linked, "k", "left").select(
        "k", "least", F.coalesce("root", "k").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rooted = stored(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(least, "root").select("k", "component_id", "n_links"), "named")
    full = F.col("n") > 0
    return sets.join(named, "k", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(full, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(full, F.col("n_links")).otherwise(0).alias("n_links"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, width: int = 3, **sizes) -> DataFrame:
    """``docs`` with one row of each component: that of least doc_id, rows without an id after all
    others, then by a hash of id and text. Of rows that repeat both, one stays. Texts without words
    stay."""
    sets, linked = _classes(docs, percent, width, **sizes)
    spots = sets.where("n > 0").groupBy("place", "doc_id", "k").agg(F.count("*").alias("rows"))
    spots = stored(spots.join(linked.select("k", "root"), "k", "left").select(
        "place", "doc_id", "rows", F.coalesce("root", "k").alias("root")), "spots")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "place")
    kept = spots.groupBy("root").agg(F.min(rank).alias("kept"))
    # only places to drop and places of repeated rows are looked up
    marks = stored(spots.join(kept, "root").select(
        "place", "rows", (F.col("kept.place") != F.col("place")).alias("gone"))
        .where("gone or rows > 1").select("place", "gone"), "marks")
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.xxhash64(
        F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("place"))
    rows = lookup_join(rows, marks, "place", "left")
    once = rows.where("not gone").groupBy("place").agg(F.first("_doc").alias("_doc"))
    return rows.where("gone is null").select("_doc.*").unionByName(once.select("_doc.*"))
