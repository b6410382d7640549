"""Token-id files in a static range asymmetric numeral system, and their reader.

Documents are written in ascending doc_id order (null ids last). A file row is a *segment*: whole
documents of about ``SEGMENT_IDS`` ids. It holds one frequency table, shared by all its blocks.
Every block is encoded on its own, by ``LANES`` interleaved coders with 64-bit states that emit
32-bit words. Inside a block there is a checkpoint every ``SECTION_IDS`` ids: the coders' states
and the place in the block's words, from which decoding can start. Each section carries a CRC-32
of its ids, which the reader verifies. Any sections of any segment can thus be decoded apart.

Segment layout, all numbers little-endian: the magic, the number of ids, the sizes of the table
and of the words, then the table (deflated symbol steps and frequencies), the checkpoints and the
words. Frequencies sum to 2**20, and every symbol of the segment has at least 1.

Null and empty texts have their end id only. Rows with equal ids are ordered by a hash of the text;
equal rows tie and may take either place. A document is never split over segments, so a segment is
as large as its largest document. Only doc_id and text are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscape.llm.tokens import default_tokenizer, encoded
from callscape.scale import scratch_path

END_ID = 2
MAGIC = b"RANS"
HEAD = struct.Struct("<4sQII")
BITS = 20  # frequencies sum to 1 << BITS
TOTAL = 1 << BITS
LOW = np.uint64(1 << 31)  # states lie in [LOW, LOW << 32)
LANES = 128
SECTION_IDS = 1 << 15
SECTIONS = 4  # per block
SEGMENT_IDS = 1 << 21
U = np.uint64


def scaled_frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that sum to ``TOTAL``, nearly in proportion to the counts."""
    f = np.maximum(counts * TOTAL // counts.sum(), 1)
    over = int(f.sum()) - TOTAL
    for k in np.argsort(-f, kind="stable"):
        if over == 0:
            break
        change = min(over, int(f[k]) // 2) if over > 0 else over
        f[k] -= change
        over -= change
    return f


def _steps(count: int) -> int:
    return -(-count // LANES)


def encode_segment(ids: np.ndarray) -> bytes:
    """The bytes of a segment. All blocks advance together, one step of all lanes at a time."""
    if not len(ids):
        return HEAD.pack(MAGIC, 0, 0, 0)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    code = (np.cumsum(counts > 0) - 1)[ids]
    counts = counts[symbols]
    freq = scaled_frequencies(counts)
    base = (np.cumsum(freq) - freq).astype(U)
    freq = freq.astype(U)
    per_block, steps = SECTION_IDS * SECTIONS, _steps(SECTION_IDS) * SECTIONS
    blocks = -(-len(ids) // per_block)
    padded = np.full(blocks * per_block, int(np.argmax(counts)), np.int64)
    padded[: len(ids)] = code
    lanes = padded.reshape(blocks, steps, LANES)
    state = np.full((blocks, LANES), LOW)
    marks, words, owners = [], [], []
    last_steps = _steps(len(ids) - (blocks - 1) * per_block)
    for t in range(steps - 1, -1, -1):
        live = blocks if t < last_steps else blocks - 1  # the last block may be shorter
        f, x = freq[lanes[:live, t]], state[:live]
        full = x >= f << U(63 - BITS)
        words.append((x[full] & U(0xFFFFFFFF)).astype("<u4"))
        owners.append(np.nonzero(full)[0])
        x = np.where(full, x >> U(32), x)
        times = x // f
        state[:live] = (times << U(BITS)) + (x - times * f) + base[lanes[:live, t]]
        if t % _steps(SECTION_IDS) == 0:
            marks.append(state.copy())
    words, owners = words[::-1], owners[::-1]
    emitted = np.stack([np.bincount(o, minlength=blocks) for o in owners])
    order = np.argsort(np.concatenate(owners), kind="stable")
    stream = np.concatenate(words)[order]
    begun = np.cumsum(emitted.sum(axis=0)) - emitted.sum(axis=0)
    before = np.cumsum(emitted, axis=0) - emitted
    states = np.stack(marks[::-1], axis=1)  # block, section, lane
    place = (begun + before[:: _steps(SECTION_IDS)]).T  # block, section
    sums = [zlib.crc32(ids[a : a + SECTION_IDS].astype("<u4").tobytes())
            for a in range(0, len(ids), SECTION_IDS)]
    table = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes()
                          + freq.astype("<u4").tobytes(), 6)
    n = len(sums)
    return b"".join([
        HEAD.pack(MAGIC, len(ids), len(table), len(stream)), table,
        np.array(sums, "<u4").tobytes(), place.reshape(-1)[:n].astype("<u8").tobytes(),
        states.reshape(-1, LANES)[:n].astype("<u8").tobytes(), stream.tobytes()])


def decode_segment(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of sections ``first`` to ``last`` (exclusive; default: all) of a segment."""
    magic, count, table_size, n_words = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment")
    if not count:
        return np.zeros(0, np.uint32)
    n = -(-count // SECTION_IDS)
    last = n if last is None else last
    table = np.frombuffer(zlib.decompress(data[HEAD.size : HEAD.size + table_size]), "<u4")
    symbols, freq = np.split(table.astype(np.int64), 2)
    symbols = np.cumsum(symbols)
    slot = np.repeat(np.arange(len(freq)), freq)
    base, freq = (np.cumsum(freq) - freq).astype(U), freq.astype(U)
    at = HEAD.size + table_size
    sums = np.frombuffer(data, "<u4", n, at)
    place = np.frombuffer(data, "<u8", n, at + 4 * n)[first:last].astype(np.int64)
    state = np.frombuffer(data, "<u8", n * LANES, at + 12 * n).reshape(n, LANES)[first:last]
    words = np.frombuffer(data, "<u4", n_words, at + (12 + 8 * LANES) * n).astype(U)
    out = np.empty((len(place), _steps(SECTION_IDS), LANES), np.uint32)
    for t in range(out.shape[1]):
        low = (state & U(TOTAL - 1)).astype(np.int64)
        s = slot[low]
        out[:, t] = symbols[s]
        state = freq[s] * (state >> U(BITS)) + low.astype(U) - base[s]
        empty = state < LOW
        rank = np.cumsum(empty, axis=1)
        at = np.minimum(place[:, None] + rank - 1, max(n_words - 1, 0))
        state = np.where(empty, (state << U(32)) | words[at] if n_words else state, state)
        place = place + rank[:, -1]
    ids = out.reshape(len(place), -1)
    pieces = []
    for k in range(first, last):
        piece = ids[k - first][: min(SECTION_IDS, count - k * SECTION_IDS)]
        if zlib.crc32(piece.astype("<u4").tobytes()) != sums[k]:
            raise ValueError(f"section {k} does not match its checksum")
        pieces.append(piece)
    return np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)


def _segments(path: str, end: int):
    """Segments of a partition in order, each with its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, sizes, part, seg, before, size = [], [], [], 0, 0, 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = {"part": [part], "seg": [seg], "before": [before], "n_ids": [len(ids)],
                   "doc_ids": [docs], "sizes": [sizes], "data": [encode_segment(ids)]}
            return pa.RecordBatch.from_pydict(row, SEGMENT_TYPE)

        for rows, lists in encoded(batches, path, end):
            part = rows["part"][0].as_py()
            for doc, ids in zip(rows["doc_id"].to_pylist(), lists, strict=True):
                held.append(ids)
                docs.append(doc)
                sizes.append(len(ids))
                size += len(ids)
                if size >= SEGMENT_IDS:
                    yield flush()
                    before += size
                    seg += 1
                    held, docs, sizes, size = [], [], [], 0
        if held:
            yield flush()
    return run


SEGMENT_TYPE = pa.schema([
    ("part", pa.int32()), ("seg", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])
SEGMENT_ROW = ("part int, seg int, before long, n_ids long, doc_ids array<long>, "
               "sizes array<long>, data binary")


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID
              ) -> None:
    """Write all documents to ``path``, one folder of Parquet files whose rows are segments. Range
    partitions are sorted and encoded where they lie; only texts move, once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn(
        "tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "doc_id", "text", F.spark_partition_id().alias("part"))
    sorted_rows.mapInArrow(
        _segments(tokenizer or default_tokenizer(), end_id), SEGMENT_ROW).write.parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            ids = decode_segment(one["data"][0].as_py()).astype("<u4")
            sizes = np.array(one["sizes"][0].as_py(), np.int64)
            ends = np.cumsum(sizes)
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[4 * (b - n) : 4 * b]) for b, n in zip(ends, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [one["doc_ids"].flatten(),
                 pa.array(one["offset"][0].as_py() + ends - sizes), pa.array(sizes),
                 pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files.

    The ids before a partition are summed from one number per partition, which is all that meets
    in one task or is broadcast.
    """
    files = spark.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = files.join(F.broadcast(parts), "part").select(
        "doc_ids", "sizes", "data", (F.col("first") + F.col("before")).alias("offset"))
    return placed.mapInArrow(_decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")


def through_files(docs: DataFrame, **options) -> DataFrame:
    """Write the documents' ids to fresh files in the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "ids")
    write_ids(docs, path, **options)
    return read_ids(docs.sparkSession, path)
