import random

import numpy as np
from llm.conftest import CLASH, sentence
from pyspark.sql import functions as F

from callscape.llm.decontaminate import (
    ItemIndex,
    contamination_report,
    decontaminated,
    edit_distances,
    recall_report,
    words_of,
)


def distance(a, b):
    """Least edits that turn words ``a`` into a stretch of ``b``."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        k = rng.randrange(len(out))
        out[k : k + rng.randint(0, 1)] = [sentence(rng, 1)] * rng.randint(0, 1)
    return out


def test_distance_against_plain_programme():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(4) for _ in range(n)] for n in (rng.randint(1, 9), rng.randint(1, 20)))
        got = edit_distances(np.array([a], np.uint64), np.array([b], np.uint64))[0]
        assert got == distance(a, b)


def test_leaks_are_found_and_clean_documents_stay(spark, edge_docs, no_docs):
    rng = random.Random(9)
    items = [(k, sentence(rng, rng.randint(3, 60))) for k in range(40)]
    items += [(90, None), (91, ""), (None, sentence(rng, 20)), (92, sentence(rng, 700))]
    rows = []
    for k in range(400):
        item, text = items[rng.randrange(40)]
        words = text.split()
        edits = rng.randint(0, int(0.2 * len(words)) + 1)
        inner = edited(rng, words, edits) if k % 4 else []
        if inner and k % 3 == 0:
            inner = " ".join(inner).upper().split()
        rows.append((2000 + k, " ".join(
            sentence(rng, rng.randint(0, 80)).split() + inner + sentence(rng, 30).split())))
    rows.append((2999, "start " + " ".join(items[43][1].split()[100:690])))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit("x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {}
    for i, t in rows:
        doc = [int(x) for x in words_of(t)]
        for item, text in items[:40]:
            a = [int(x) for x in words_of(text)]
            if len(set(a) & set(doc)) >= 0.7 * len(set(a)) and (d := distance(a, doc)) <= int(
                    0.2 * len(a) + 1e-9):
                want[i, item] = d
    got = {(r["doc_id"], r["item_id"]): r["n_edits"]
           for r in contamination_report(docs, bench).collect()}
    assert (2999, 92) in got
    got = {k: v for k, v in got.items() if k[1] != 92}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) > 200
    assert all(got[k] == want[k] for k in got)
    extra = docs.withColumns({c: F.lit("x") for c in CLASH})
    kept = decontaminated(extra, bench)
    assert kept.columns == extra.columns
    assert {r["doc_id"] for r in kept.collect()} == (
        {i for i, _ in rows} - {i for i, _ in got} - {2999})
    assert decontaminated(edge_docs, bench).count() == edge_docs.count()
    assert contamination_report(no_docs, bench).isEmpty() and decontaminated(no_docs, bench).isEmpty()
    assert contamination_report(docs, bench.limit(0)).isEmpty()


def test_long_items_are_verified_whole_and_items_without_an_id_are_searched(spark):
    rng = random.Random(21)
    items = [(k, sentence(rng, n)) for k, n in enumerate((512, 513, 516, 600, 1100))]
    items += [(None, sentence(rng, 25)), (None, sentence(rng, 30))]
    rows, want = [], {}
    for k, (item, text) in enumerate(items):
        words = text.split()
        limit = int(0.2 * len(words) + 1e-9)
        docs = [words[-1:], words[-4:], words[:512] if len(words) > 700 else words[:300]]
        docs += [edited(rng, words, n) for n in (0, limit // 2, limit - 2, limit + 3, 2 * limit)]
        for j, inner in enumerate(docs):
            doc = sentence(rng, 20 * j).split() + inner + sentence(rng, 15).split()
            rows.append((100 * k + j, " ".join(doc)))
            d = distance(words_of(text).tolist(), words_of(rows[-1][1]).tolist())
            if d <= limit:
                want[100 * k + j, item] = d
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = contamination_report(docs, bench).collect()
    got = {(r["doc_id"], r["item_id"]): r["n_edits"] for r in found}
    assert len(got) == len(found) and got.items() <= want.items()
    assert len(got) >= len(want) - 1 and {i for _, i in got} == {None, 0, 1, 2, 3, 4}
    kept = {r["doc_id"] for r in decontaminated(docs, bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in got}


def test_recall_of_every_length_in_a_mixed_block():
    rng = random.Random(31)
    lengths = [20] * 600 + [100] * 25 + [500] * 25 + [2000] * 4
    items = [(k, sentence(rng, n), 0) for k, n in enumerate(lengths)]
    for max_edits in (0.1, 0.2, 0.3):
        index = ItemIndex(items, max_edits, 0.99)
        assert all(r[4] >= 0.99 for r in index.report)
        assert sum(r[2] for r in index.report) == 650 + 4 * 4
        docs, home = [], []
        for k in range(560, len(lengths)):
            inner = edited(rng, items[k][1].split(), int(max_edits * lengths[k] + 1e-9))
            docs.append(words_of(" ".join([sentence(rng, 30), *inner, sentence(rng, 30)])))
            home.append(k)
        ends = np.cumsum([len(d) for d in docs])
        first = np.repeat(ends - [len(d) for d in docs], [len(d) for d in docs])
        last = np.repeat(ends, [len(d) for d in docs])
        place, item, edits = index.matches(np.concatenate(docs), first, last)
        found = {(home[d], i) for d, i in zip(np.searchsorted(ends, place, "right"), item, strict=True)}
        assert (edits <= np.floor(np.array(lengths)[item] * max_edits + 1e-9)).all()
        for n in set(lengths):
            mine = [k for k in home if lengths[k] == n]
            assert sum((k, k) in found for k in mine) >= 0.92 * len(mine)


def test_repeated_words_and_classes_without_samples(spark):
    items = [(1, "a " * 40, 0), (2, "a " * 400, 0), (3, "b a " * 8, 0)]
    doc = words_of("a " * 60_000)
    place, item, edits = ItemIndex(items, 0.2, 0.99).matches(
        doc, np.zeros(len(doc), int), np.full(len(doc), len(doc)))
    assert sorted(zip(item, place, edits, strict=True)) == [(0, 0, 0), (1, 0, 0)]
    sure = ItemIndex([(1, sentence(random.Random(1), 40), 0)], 0.2, 1.01)
    assert sure.exact.all() and sure.report == [(40, 40, 1, 0, 1.0)]
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, None)],
                                  "item_id long, text string")
    report = recall_report(bench, recall=0.9).collect()
    assert [r["n_items"] for r in report] == [1] and report[0]["recall"] >= 0.9
    assert recall_report(bench.limit(0)).isEmpty()
