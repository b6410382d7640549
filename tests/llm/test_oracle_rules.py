"""Rows that tell the SQL counterparts' rules from looser or tighter ones."""

import random

import duckdb
import pandas as pd
from llm.conftest import sentence
from llm.test_quality_rules import key

from callscape.llm.licenses import TEMPLATES, license_scan
from callscape.llm.oracle import ORACLE
from callscape.llm.quality_rules import quality_report


def both(spark, name, query, rows):
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "source"])
    db = duckdb.connect()
    db.register("documents", frame)
    found = db.execute(ORACLE[name])
    names = [c[0] for c in found.description]
    got = query(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3))
    tidy = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    want = sorted(map(tidy, found.fetchall()), key=key)
    assert sorted((tidy(r) for r in got.select(*names).collect()), key=key) == want
    return {r[names.index("doc_id")]: dict(zip(names, r, strict=True)) for r in want}


def test_a_line_is_common_by_either_limit(spark):
    rng = random.Random(12)
    rows, at = [], 0
    for host, docs, holders in (("share", 30, 4), ("number", 260, 22), ("neither", 90, 8), ("few", 12, 2)):
        line = sentence(rng, 60)
        for k in range(docs):
            own = sentence(rng, 20 if k < holders else 60)
            rows.append((at, f"{line}\n{own}" if k < holders else own, host))
            at += 1
    kept = both(spark, "op9_quality_rules", quality_report, rows)
    lost = [r[2] for r in rows if not kept[r[0]]["kept"]]
    assert {h: lost.count(h) for h in ("share", "number", "neither", "few")} == {
        "share": 4, "number": 22, "neither": 0, "few": 0}


def test_a_text_may_hold_many_licences(spark):
    rng = random.Random(13)
    texts = [text for _, text, _ in TEMPLATES]
    rows = [(0, "\n".join(texts), "s"), (1, None, "s"), (2, sentence(rng, 30), "s")]
    rows += [(10 + k, f"{a} {sentence(rng, 5)} {b}", "s") for k, (a, b) in enumerate(zip(texts, texts[5:]))]
    labels = both(spark, "op4_license_scan", license_scan, rows)
    assert labels[0]["labels"] == ",".join(sorted({label for label, _, _ in TEMPLATES}))
