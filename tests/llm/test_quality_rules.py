import re
from collections import Counter, defaultdict

from llm.conftest import edge_texts
from pyspark.sql import functions as F

from callscape.llm.quality_rules import quality_filter, quality_report

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(win)
    covered = {i + k for i, x in enumerate(win) if n[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t),
            len(lines) - len(set(lines)), len(covered))


def expected(rows, min_docs=20):
    kinds = {(s, t or "") for _, t, s in rows}
    hosts = Counter(s for s, _ in kinds)
    norm = lambda x: " ".join(WORD.findall(x)).translate(
        str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = defaultdict(set)
    for s, t in kinds:
        for x in t.split("\n"):
            if WORD.search(x):
                held[s, norm(x)].add(t)
    common = {k for k, v in held.items() if len(v) >= min_docs and len(v) >= 0.1 * hosts[k[0]]}
    out = []
    for i, t, s in rows:
        c = counts(t)
        gone = [x for x in (t or "").split("\n") if WORD.search(x) and (s, norm(x)) in common]
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        left = c[0] - sum(len(WORD.findall(x)) for x in gone)
        kept = not failed and left >= 0.3 * c[0]
        clean = "\n".join(x for x in (t or "").split("\n") if x not in gone) if gone else t
        out.append(((i, *c, failed, kept), clean))
    return out


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]


def key(row):
    return tuple((x is not None, x) for x in row)


def test_report_and_filter_match_brute_force(edge_docs):
    want = expected(rows_of(edge_docs))
    got = sorted(map(tuple, quality_report(edge_docs).collect()), key=key)
    assert got == sorted((r for r, _ in want), key=key)
    kept = quality_filter(edge_docs)
    assert kept.columns == edge_docs.columns
    texts = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=key)
    assert texts == sorted(((r[0], t) for r, t in want if r[-1]), key=key)
    assert kept.where(F.col("n_chars") != F.length("text")).isEmpty()
    assert kept.where("n_words <> 'x' or _doc <> 'x'").isEmpty()


def test_common_lines_are_removed_and_depleted_documents_rejected(spark):
    common = "the same line on every page of this host"
    rows = [(k, common + "\n" + " ".join(f"w{k}x{j}" for j in range(60)), "h") for k in range(30)]
    rows += [(99, "\n".join([common] * 7), "h"), (98, "\n".join([common] * 7), "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    verdict = {r["doc_id"]: r["kept"] for r in quality_report(docs).collect()}
    assert verdict == {r[0][0]: r[0][-1] for r in expected(rows)}
    kept = quality_filter(docs).collect()
    assert len(kept) == 30 and not any(common in r["text"] for r in kept)


def test_more_documents_on_a_host_do_not_hide_a_common_line(spark):
    line = "a line that pages of this host repeat below their text"

    def host(name, n, held, start):
        return [(start + k, (line + "\n" if k < held else "")
                 + " ".join(f"w{start + k}x{j}" for j in range(60)), name) for k in range(n)]

    rows = host("large", 400, 20, 0) + host("rare", 400, 19, 1000) + host("small", 8, 3, 2000)
    rows += host("pair", 8, 2, 3000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = quality_filter(docs)
    assert left.count() == len(rows)
    assert {(r["source"], r["n"]) for r in left.where(F.col("text").contains(line)).groupBy(
        "source").agg(F.count("*").alias("n")).collect()} == {("rare", 19), ("pair", 2)}
    short = quality_report(docs, min_left=0.9).where("not kept")
    assert {r["doc_id"] for r in short.collect()} == {*range(20), *range(2000, 2003)}


def test_empty_table(no_docs):
    assert quality_report(no_docs).isEmpty() and quality_filter(no_docs).isEmpty()
    assert len(edge_texts()) > 60
