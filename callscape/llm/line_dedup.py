"""Line deduplication across documents by a deletion-neighbourhood join, in DataFrame operations.

A line is dropped when an equal line, or one within one edit (insertion, deletion or substitution
of a character), occurs earlier. Occurrences are ordered by (doc_id, text, position), null ids
last. A dropped line still shadows later ones, so the result does not depend on any processing
order.

The method emits every single-deletion variant of a line as a hashed key, joins equal variants and
verifies the edit distance:

- two lines differ by a substitution if deleting the same position of both leaves the same text;
- a line is one character shorter than another if it equals one of the other's variants.

Both are groups in which comparing with the earliest member decides, so aggregates suffice and no
pairs within a group are emitted. Before variants are emitted, a lossless filter keeps lines that
can have a partner: cut into ``PIECES`` pieces, two lines one edit apart agree on all pieces but
one. Only lines that share such a frame with another line emit the variants of the piece left out.

- Lines are compared without surrounding white space. Lines under ``min_chars`` characters always
  stay, since short lines coincide by chance.
- Null and empty texts have no lines and pass unchanged. Rows that repeat id and text share their
  places, so both keep the same lines. Other columns of ``docs`` cannot clash: rows travel in a
  struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscape.llm.common import stored
from callscape.scale import with_row_number

PIECES = 4
CLASS = 16  # lines of CLASS * c to CLASS * c + CLASS - 1 characters have pieces of equal length
LAST = (1 << 63) - 1
BROADCAST_KEYS = 2_000_000  # 16 MB of hashed keys; more of them join by shuffle


def _row_key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
            F.xxhash64("text").alias("tie")]


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\x0b\f"))


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc, tie, pos and line of every line that takes part, with its 128-bit name (h1, h2)."""
    lines = docs.select(*_row_key(), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return lines.select("doc", "tie", "pos", _trimmed(F.col("raw")).alias("line")).where(
        F.length("line") >= min_chars
    ).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), F.col("line"))})


def _framed(lines: DataFrame) -> DataFrame:
    """A row per line, length class and piece: the hashed frame around the piece, and the piece.

    A line at the lower end of its class also counts for the class below, where a line one
    character shorter is.
    """
    n = F.length("line")
    c = F.floor(n / CLASS).cast("int")
    classes = F.when((n % CLASS == 0) & (c > 1), F.array(c, c - 1)).otherwise(F.array(c))
    rows = lines.withColumn("c", F.explode(classes)).withColumn(
        "j", F.explode(F.array(*[F.lit(j) for j in range(PIECES)])))
    step = F.lit(CLASS // PIECES) * F.col("c")
    before, after = step * F.col("j"), step * (PIECES - 1 - F.col("j"))
    return rows.withColumns({
        "frame": F.xxhash64("c", "j", F.left("line", before), F.right("line", after)),
        "piece": F.substring(F.col("line"), before + 1, n - before - after),
    })


def _near_lines(occ: DataFrame) -> DataFrame:
    """(h1, h2) of lines that have an earlier line within one edit."""
    frames = _framed(occ).groupBy("frame").agg(F.min("h1").alias("a"), F.max("h1").alias("b"))
    shared = stored(frames.where("a <> b").select("frame"), "frames")
    if shared.count() <= BROADCAST_KEYS:
        shared = F.broadcast(shared)
    mine = F.struct("doc", "tie", "pos").alias("at")
    found = stored(
        _framed(occ).join(shared, "frame")
        .groupBy("h1", "h2", "frame")
        .agg(F.first("line").alias("line"), F.first("piece").alias("piece"),
             F.min(mine).alias("at")),
        "framed",
    )
    # a candidate line's number follows its first place, so comparing numbers compares places
    lines = with_row_number(
        found.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.first("line").alias("line")),
        ["at", "h1", "h2"], "no").select("no", "h1", "h2", "line")
    lines = stored(lines, "lines")
    pieces = stored(found.select("h1", "h2", "frame", "piece").join(lines.drop("line"), ["h1", "h2"])
                    .select("no", "frame", "piece"), "pieces")
    # the hash alone shows which variants several lines have; only those meet again
    seen = _variants(pieces).groupBy("v").agg(F.min("no").alias("a"), F.max("no").alias("b"))
    common = stored(seen.where("a <> b").select("v"), "common")
    if common.count() <= BROADCAST_KEYS:
        common = F.broadcast(common)
    variants = stored(_variants(pieces).join(common, "v").select("v", "i", "no"), "variants")
    swaps = variants.where("i > 0").groupBy("v", "i").agg(F.min("no").alias("lead"))
    whole = F.col("i") == 0
    shifts = variants.groupBy("v").agg(
        F.min(F.when(whole, F.col("no"))).alias("short"), F.min(F.when(~whole, F.col("no"))).alias("long"),
    ).where("short is not null and long is not null")
    pairs = variants.where("i > 0").join(swaps, ["v", "i"]).select("no", "lead").unionByName(
        variants.join(shifts, "v").select(
            "no", F.when(whole, F.col("long")).otherwise(F.col("short")).alias("lead")))
    pairs = pairs.where("lead < no").distinct()
    lead = lines.select(F.col("no").alias("lead"), F.col("line").alias("lead_line"))
    return (
        pairs.join(lines, "no").join(lead, "lead")
        .where(F.levenshtein("line", "lead_line", 1) == 1)
        .select("h1", "h2").distinct()
    )


def _variants(pieces: DataFrame) -> DataFrame:
    """Hashed variants of each piece within its frame: i = 0 is the piece, other i lack character i."""
    size = F.length("piece")
    rows = pieces.withColumn("i", F.explode(F.sequence(F.lit(0), size)))
    cut = F.concat(F.left("piece", F.col("i") - 1), F.substring(F.col("piece"), F.col("i") + 1, size))
    return rows.select(
        "no", "i", F.xxhash64("frame", F.when(F.col("i") == 0, F.col("piece")).otherwise(cut)).alias("v"))


def dropped_lines(docs: DataFrame, max_edits: int = 1, min_chars: int = 20) -> DataFrame:
    """doc, tie and the positions of the lines to drop, for documents that have any.

    ``max_edits`` is 0 (equal lines only) or 1. Only lines that occur twice or have an earlier
    near line meet the occurrences again; a hot line's occurrences are split by adaptive
    execution, since both sides of that join come straight from storage.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    occ = _occurrences(docs, min_chars)
    firsts = occ.groupBy("h1", "h2").agg(
        F.min(F.struct("doc", "tie", "pos")).alias("first"), F.count("*").alias("n"))
    again = firsts.where("n > 1").select("h1", "h2", "first", F.lit(False).alias("near"))
    if max_edits:
        near = _near_lines(occ).select(
            "h1", "h2", F.lit(None).cast(again.schema["first"].dataType).alias("first"),
            F.lit(True).alias("near"))
        again = again.unionByName(near).groupBy("h1", "h2").agg(
            F.max("first").alias("first"), F.max("near").alias("near"))
    again = stored(again, "again")
    here = F.struct("doc", "tie", "pos")
    return (
        occ.select("doc", "tie", "pos", "h1", "h2").join(again, ["h1", "h2"])
        .where(F.col("near") | (here > F.col("first")))
        .groupBy("doc", "tie").agg(F.collect_set("pos").alias("drops"))
    )


def dedup_lines(docs: DataFrame, **limits) -> DataFrame:
    """Every row of ``docs`` as struct ``_doc``, with n_lines, n_removed and the kept ``text``."""
    drops = dropped_lines(docs, **limits)
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), "text", *_row_key())
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(
        F.transform(lines, lambda x, i: F.when(~F.array_contains("drops", i), x)),
        lambda x: x.isNotNull()), "\n")
    none = F.col("drops").isNull()
    return rows.join(drops, ["doc", "tie"], "left").select(
        "_doc",
        F.coalesce(F.size(F.when(F.col("text").isNotNull(), lines)), F.lit(0))
        .cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(F.size("drops")).cast("long").alias("n_removed"),
        F.when(none, F.col("text")).otherwise(kept).alias("text"),
    )


def line_dedup_report(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, n_lines, n_removed and the remaining text of every document."""
    return dedup_lines(docs.select("doc_id", "text"), **limits).select(
        "_doc.doc_id", "n_lines", "n_removed", "text")


def line_dedup_filter(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with the remaining texts, ``n_chars`` following where it exists. A document that
    lost lines and has no word left goes."""
    done = dedup_lines(docs, **limits)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") == 0, F.col("_doc.n_chars")).otherwise(
            F.length("text")).cast(docs.schema["n_chars"].dataType)
    return done.where(left).select(*[
        new.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns])
