"""Guards that keep plans safe when tables grow: checked broadcasts, salted joins,
reliable lineage cuts and distributed numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
JOIN_SALTS = 32
SALTED_MAX_ROWS = 1_000_000_000
FILTER_BITS_PER_KEY = 8
FILTER_BLOCK = 32768  # bits of one bitmap of Spark's aggregate


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of a dimension. Each task sends one row."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns),
                F.lit(0))
    seen = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return seen["n"], seen["bytes"]


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES
) -> bool:
    rows, size = measure(df)
    return rows <= max_rows and size <= max_bytes


def salts_for(spark: SparkSession, dimension_rows: int) -> int:
    """Buckets over which a key is spread: one per shuffle partition, so that a hot key can occupy
    all of them, but at least ``JOIN_SALTS`` and no more copies of the dimension than
    ``SALTED_MAX_ROWS`` in all."""
    wanted = max(JOIN_SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(JOIN_SALTS, min(wanted, SALTED_MAX_ROWS // max(dimension_rows, 1)))


def matching_facts(facts: DataFrame, dimension: DataFrame, keys: list[str],
                   dimension_rows: int) -> DataFrame:
    """The facts whose key may be in the dimension: all that are, and few others.

    Each key of the dimension sets one bit, by its hash. The bit sets are aggregated in blocks and
    broadcast; their size follows from the rows of the dimension and is at most
    ``BROADCAST_MAX_BYTES``, beyond which more facts pass. Facts do not move.
    """
    wanted = max(dimension_rows, 1) * FILTER_BITS_PER_KEY
    blocks = min(-(-wanted // FILTER_BLOCK), BROADCAST_MAX_BYTES * 8 // FILTER_BLOCK)
    hashed = F.pmod(F.xxhash64(*keys), F.lit(blocks * FILTER_BLOCK))
    block, place = F.floor(hashed / FILTER_BLOCK), hashed % FILTER_BLOCK
    bits = dimension.select(block.alias("_block"), place.alias("_place")).groupBy("_block").agg(
        F.bitmap_construct_agg("_place").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10)
    there = F.floor(byte.cast("int") / F.pow(F.lit(2), F.col("_place") % 8)) % 2 == 1
    return (
        facts.withColumns({"_block": block, "_place": place})
        .join(F.broadcast(bits), "_block")
        .filter(there)
        .drop("_block", "_place", "_bits")
    )


def lookup_join(
    facts: DataFrame,
    dimension: DataFrame,
    on: str | list[str],
    how: str = "inner",
    max_rows: int = BROADCAST_MAX_ROWS,
    salts: int | None = None,
    prefilter: bool = False,
) -> DataFrame:
    """Join facts to a dimension.

    A dimension that measures small is broadcast, so the facts do not move. A larger one is
    joined by shuffle with every dimension row copied to ``salts`` buckets and the facts
    spread over them, which splits a key that holds a large share of all facts. The salt
    depends only on the row and its input partition, so a rerun task repeats it. That join is
    hinted to merge: copies of a dimension that is too large must not be broadcast. With
    ``prefilter``, facts of an inner join that cannot match are dropped before they move, which pays
    when many have no match.
    """
    keys = [on] if isinstance(on, str) else on
    rows, size = measure(dimension)
    if rows <= max_rows and size <= BROADCAST_MAX_BYTES:
        return facts.join(F.broadcast(dimension), keys, how)
    if prefilter and how == "inner":
        facts = matching_facts(facts, dimension, keys, rows)
    salts = salts or salts_for(facts.sparkSession, rows)
    spread = F.pmod(F.xxhash64(*facts.columns) + F.spark_partition_id(), F.lit(salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return (
        facts.withColumn("_salt", spread)
        .join(dimension.withColumn("_salt", copies).hint("merge"), [*keys, "_salt"], how)
        .drop("_salt")
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate results.

    Read from ``spark.checkpoint.dir``; only a local master may fall back to a temporary
    folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="callscape-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to a table in the shared folder and go on from there.

    Later uses read columns of the stored rows, so the raw data is scanned a single time and
    a lost executor costs a re-read, not a recomputation.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_number(df: DataFrame, order_by: list[str], name: str) -> DataFrame:
    """Number all rows from 0 in the given total order, without a single-task sort.

    Rows are range-partitioned, numbered inside their partition and stored with both numbers,
    which pins them; then each partition is shifted by the sizes of those before it. Only one
    row per partition (their counts) ever meets in one task.
    """
    within = F.lit((1 << 33) - 1)  # the low bits of a monotonic id count rows in a partition
    placed = cut_lineage(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .select(
            "*",
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(within).alias("_pos"),
        )
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos"))
        .drop("_part", "_pos", "_offset")
    )
