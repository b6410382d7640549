import random

import pytest
from llm.test_quality_rules import key

from callscape.llm.line_dedup import line_dedup_filter, line_dedup_report


def near(a, b):
    """Whether two different texts are one edit apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    k = next((i for i in range(len(short)) if short[i] != long[i]), len(short))
    return short[k + (len(short) == len(long)) :] == long[k + 1 :]


def expected(rows, min_chars=20):
    """Kept texts by row; rows are (doc_id, text) with distinct ids."""
    seen, out = [], []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        kept = []
        for line in (t or "").split("\n"):
            x = line.strip(" \t\r\x0b\f")
            if len(x) >= min_chars:
                gone = any(x == y or near(x, y) for y in seen)
                seen.append(x)
                if gone:
                    continue
            kept.append(line)
        out.append((i, None if t is None else "\n".join(kept)))
    return out


def test_lines_within_one_edit_go(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcde é", k=n)).strip().ljust(20, "z") for n in range(20, 70)]
    lines = list(base)
    for x in base:
        k = rng.randrange(len(x))
        lines += [x[:k] + x[k + 1 :], x[:k] + "Q" + x[k:], x[:k] + "R" + x[k + 1 :],
                  x[:k] + "STU" + x[k:], "short"]
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 5 : i * 5 + 5])) for i in range(len(lines) // 5 + 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in line_dedup_report(docs).collect()}
    assert got == dict(expected(rows))
    exact = {r["doc_id"]: r["n_removed"] for r in line_dedup_report(docs, max_edits=0).collect()}
    assert sum(exact.values()) < sum(
        r["n_removed"] for r in line_dedup_report(docs).collect())


def test_edges(edge_docs):
    report = sorted(map(tuple, line_dedup_report(edge_docs).collect()), key=key)
    rows = [tuple(r) for r in edge_docs.select("doc_id", "text").collect()]
    distinct = [r for r in rows if r[0] is not None]
    want = dict(expected(list(dict.fromkeys(distinct))))
    for i, n_lines, n_removed, text in report:
        if i is not None:
            assert text == want[i]
            assert n_lines == (0 if dict(distinct)[i] is None else dict(distinct)[i].count("\n") + 1)
            assert (n_removed == 0) == (text == dict(distinct)[i])
    assert len(report) == len(rows)
    assert [r[3] for r in report if r[0] is None] in ([None, ""], ["", None])
    kept = line_dedup_filter(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 20 in ids and 21 not in ids and 10 in ids and 11 in ids


def test_empty_table_and_bad_bound(no_docs):
    assert line_dedup_report(no_docs).isEmpty() and line_dedup_filter(no_docs).isEmpty()
    with pytest.raises(ValueError, match="max_edits"):
        line_dedup_report(no_docs, max_edits=2)
