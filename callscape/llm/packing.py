"""Packing of tokenised documents into sequences of fixed capacity by minimum bin slack.

A document's ids, its end id included, are cut into pieces of ``capacity`` and a remainder. Full
pieces are sequences of their own. The remainders are packed by their lengths alone: for each
window the longest remaining length is taken, and a subset-sum dynamic programme over bitsets
finds the multiset of other remaining lengths that comes closest to the capacity; backtracking
yields how many of each. The same window is repeated as often as the counts allow.

Only the counts by length (at most ``capacity`` rows) reach the driver, and only the list of
windows goes back: each uses up one length's pieces, so both are bounded whatever the corpus. The
pieces are numbered within their length by a range partitioning that splits a common length, and
find their place by that number. Texts never move.

Null and empty texts have their end id only. Repeated rows and ids, null ids included, are packed
as rows of their own. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscape.llm.common import stored
from callscape.llm.tokens import default_tokenizer, encoded
from callscape.scale import with_row_number

CAPACITY = 2048
END_ID = 1
CACHE_WORDS = 400_000  # of a Python worker
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACES = "length long, low long, high long, each long, first_sequence long, first_offset long"


def _cut(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, lists in encoded(batches, path, end, CACHE_WORDS):
            owner, start, length, crc, total = [], [], [], [], []
            for k, ids in enumerate(lists):
                data = ids.astype("<u4").tobytes()
                for a in range(0, len(ids), capacity):
                    owner.append(k)
                    start.append(a)
                    length.append(min(capacity, len(ids) - a))
                    crc.append(zlib.crc32(data[4 * a : 4 * (a + capacity)]))
                    total.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [rows["doc_id"].take(pa.array(owner, pa.int64())),
                 *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return run


def fill_window(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most ``counts`` of each, with the largest sum up to ``room``."""
    mask = (1 << (room + 1)) - 1
    reach, stages = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        before, left, step = reach, min(counts[length], room // length), 1
        while left > 0:  # any number of copies, by doubling
            take = min(step, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            step *= 2
        stages.append((length, before))
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(stages):
        copies = 0
        while not before >> total & 1:
            total -= length
            copies += 1
        if copies:
            chosen[length] = copies
    return chosen


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Windows as (copies of each length, number of such windows) that use up all counts."""
    left, windows = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        window = fill_window(left, capacity - longest)
        left[longest] += 1
        window[longest] = window.get(longest, 0) + 1
        times = min(left[k] // n for k, n in window.items())
        for k, n in window.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        windows.append((window, times))
    return windows


def _places(windows: list[tuple[dict[int, int], int]]) -> list[tuple[int, ...]]:
    """Where the pieces of each length go, by their number within the length."""
    used: dict[int, int] = {}
    sequence, rows = 0, []
    for window, times in windows:
        offset = 0
        for length in sorted(window, reverse=True):
            each = window[length]
            low = used.get(length, 0)
            used[length] = low + each * times
            rows.append((length, low, used[length], each, sequence, offset))
            offset += each * length
        sequence += times
    return rows


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID,
                   capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = stored(
        rows.mapInArrow(_cut(tokenizer or default_tokenizer(), end_id, capacity), PIECES),
        "pieces")
    counts = {r["length"]: r["n"] for r in
              pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.createDataFrame(_places(plan_windows(counts, capacity)), PLACES)
    before, firsts = 0, []
    for length in sorted(counts):
        firsts.append((length, before))
        before += counts[length]
    first = spark.createDataFrame(firsts, "length long, first long")
    order = ["length", "doc_id", "start", "ids_crc32", "doc_tokens"]
    numbered = with_row_number(pieces, order, "_number")
    ranked = numbered.join(F.broadcast(first), "length").withColumn(
        "_rank", F.col("_number") - F.col("first"))
    place = F.broadcast(places.withColumnRenamed("length", "_length"))
    here = F.col("_rank") - F.col("low")
    return ranked.join(place, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("low"))
                       & (F.col("_rank") < F.col("high"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.floor(here / F.col("each"))).alias("sequence_id"),
        (F.col("first_offset") + here % F.col("each") * F.col("length")).alias("offset"),
    )
