"""Quality rules with cross-document line frequency, in DataFrame operations only.

The base rules look at one text: its word count and the share of words inside 3-word windows
that the text repeats. The method looks across documents: lines are normalised and hashed, the
distinct documents of a host that hold a line are counted, lines above the limits are removed,
and a document is rejected when too little of it remains.

- A host is the value of ``source``; a null host is a host of its own.
- Documents of one host with equal texts count as one, so exact copies do not make each other's
  lines common; copies get the same verdict.
- A line is above the limits when at least ``min_docs`` distinct documents of its host hold it,
  however large the host is, or when those that hold it are at least ``max_share`` of the host's
  distinct documents and at least ``min_share_docs``, so that small hosts have common lines too.
- Null and empty texts have no words and fail the base rules. Rows are judged one by one:
  repeated rows and null ids keep their rows. Columns besides the named ones pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscape.llm.common import SPACE, WORD, once, stored, text_key

SYMBOLS = "#*$%&|<>"


def normalised(line: Column) -> Column:
    """A line in lower-case ASCII letters with single spaces."""
    spaced = F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))
    return F.translate(spaced, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def rule_counts(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of ``text``.

    Windows are hashed to 64 bits. Only a text with an equal pair of windows is sorted.
    """
    null = F.array(F.lit(None).cast("long"))
    text = F.coalesce(F.col("text"), F.lit(""))
    df = once(docs, _t=text, _w=F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
              _l=_lines(text))
    n = F.size("_w")
    windows = F.transform(
        F.arrays_zip(F.slice("_w", F.lit(1), F.greatest(n - 2, F.lit(0))).alias("a"),
                     F.slice("_w", 2, F.greatest(n - 2, F.lit(0))).alias("b"),
                     F.slice("_w", 3, F.greatest(n - 2, F.lit(0))).alias("c")),
        lambda w: F.xxhash64(w["a"], w["b"], w["c"]),
    )
    df = once(df, _h=F.when(n >= 3, windows).otherwise(F.array().cast("array<long>")), _n=n)
    dups = F.size("_h") > F.size(F.array_distinct("_h"))
    placed = F.when(dups, F.sort_array(F.arrays_zip(
        F.col("_h").alias("h"), F.sequence(F.lit(0), F.size("_h") - 1).alias("p"))))
    df = once(df, _s=placed)
    hashes = F.col("_s.h")
    near = F.arrays_zip(F.col("_s.p").alias("p"), hashes.alias("h"),
                        F.concat(null, F.slice(hashes, F.lit(1), F.size(hashes) - 1)).alias("b"),
                        F.concat(F.slice(hashes, F.lit(2), F.size(hashes)), null).alias("a"))
    repeated = F.filter(near, lambda x: (x["h"] == x["b"]) | (x["h"] == x["a"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        repeated, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))
    length = F.length("_t")
    return df.select(
        *docs.columns,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.translate("_t", SPACE, "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_s").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
    )


def base_failed(min_words: int = 50, max_repeat_pct: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))


def common_lines(docs: DataFrame, min_docs: int = 20, max_share: float = 0.1,
                 min_left: float = 0.3, min_share_docs: int = 3) -> DataFrame:
    """Documents (host, text key) that hold a line above the limits: the hashes of those lines
    and whether less than ``min_left`` of the words remain without them.

    Only hashes move: a hot host or line is counted inside each task first, and the join on
    (host, line) leaves adaptive execution free to split a hot pair.
    """
    texts = docs.select(F.col("source").alias("host"), F.coalesce("text", F.lit("")).alias("_t"))
    hashed = texts.select(
        F.coalesce(F.concat(F.lit("h"), "host"), F.lit("")).alias("host"),
        text_key(F.col("_t")).alias("key"),
        F.transform(_lines(F.col("_t")), lambda x: F.struct(
            F.xxhash64(normalised(x)).alias("line"),
            F.size(F.regexp_extract_all(x, F.lit(WORD), F.lit(0))).alias("words"))).alias("lines"),
    )
    kinds = stored(hashed.groupBy("host", "key").agg(F.first("lines").alias("lines")), "lines")
    hosts = kinds.groupBy("host").agg(F.count("*").alias("n_docs"))
    held = kinds.select("host", F.explode(F.array_distinct(F.col("lines.line"))).alias("line"))
    common = (
        held.groupBy("host", "line").agg(F.count("*").alias("n_held"))
        .where(F.col("n_held") >= min(min_docs, min_share_docs))
        .join(hosts, "host")
        .where((F.col("n_held") >= min_docs) | (
            (F.col("n_held") >= min_share_docs)
            & (F.col("n_held") >= max_share * F.col("n_docs"))))
        .select("host", "line")
    )
    found = (
        kinds.select("host", "key", F.explode("lines").alias("l"))
        .select("host", "key", F.col("l.line").alias("line"), F.col("l.words").alias("words"))
        .join(common, ["host", "line"])
        .groupBy("host", "key")
        .agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed_lines"))
    )
    total = F.aggregate("lines.words", F.lit(0).cast("long"), lambda a, x: a + x)
    whole = kinds.select("host", "key", total.alias("words"))
    left = F.col("words") - F.col("removed_words")
    return found.join(whole, ["host", "key"]).select(
        "host", "key", "removed_lines", (left < min_left * F.col("words")).alias("depleted"))


def _judged(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` as struct ``_doc`` (so no column name can clash) with rule counts,
    ``removed_lines`` (null: none), ``base_failed`` and ``kept``."""
    lines = common_lines(docs, **limits)
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), "text", "source")
    keyed = rule_counts(rows).withColumns({
        "_host": F.coalesce(F.concat(F.lit("h"), "source"), F.lit("")),
        "_key": text_key(F.coalesce(F.col("text"), F.lit("")))})
    failed = base_failed()
    return keyed.join(
        lines, (keyed["_host"] == lines["host"]) & (keyed["_key"] == lines["key"]), "left"
    ).select(
        "_doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "removed_lines", failed.alias("base_failed"),
        (~failed & ~F.coalesce("depleted", F.lit(False))).alias("kept"),
    )


def quality_report(docs: DataFrame, **limits) -> DataFrame:
    """One row per document: counts, ``base_failed`` and ``kept``. Texts stay in their task."""
    judged = _judged(docs.select("doc_id", "text", "source"), **limits)
    return judged.select("_doc.doc_id", *[c for c in judged.columns[1:] if c != "removed_lines"])


def quality_filter(docs: DataFrame, **limits) -> DataFrame:
    """The documents that are kept, in the columns of ``docs``, without the lines above the
    limits. ``n_chars`` follows the text where the column exists."""
    judged = _judged(docs, **limits).where("kept")
    clean = F.array_join(F.filter(F.split("_doc.text", "\n"), lambda x: ~F.array_contains(
        F.col("removed_lines"), F.xxhash64(normalised(x)))), "\n")
    text = F.when(F.col("removed_lines").isNull(), F.col("_doc.text")).otherwise(clean)
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(
            F.col("removed_lines").isNull(), F.col("_doc.n_chars")
        ).otherwise(F.length(clean)).cast(docs.schema["n_chars"].dataType)
    return judged.select(*[
        new.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns])
