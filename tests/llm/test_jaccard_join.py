import random
import re

import pytest
from llm.conftest import sentence
from llm.test_quality_rules import key

from callscape.llm.components import connected_components
from callscape.llm.jaccard_join import one_of_each, similar_documents

LOWER = bytes(range(256)).lower()


def shingles(text, width=3):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(LOWER))
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(zip(*[w[k:] for k in range(width)], strict=False))


def expected(rows, percent=90, width=3):
    sets = [shingles(t, width) for _, t in rows]
    kinds = list({s for s in sets if s})
    root = list(range(len(kinds)))
    links = [0] * len(kinds)
    for a in range(len(kinds)):
        for b in range(a):
            i = len(kinds[a] & kinds[b])
            if 100 * i >= percent * (len(kinds[a]) + len(kinds[b]) - i):
                links[a] += 1
                links[b] += 1
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    place = {s: k for k, s in enumerate(kinds)}
    least = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            r = root[place[s]]
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(s), least.get(root[place[s]]) if s else i, links[place[s]] if s else 0)
                   for (i, _), s in zip(rows, sets, strict=True)), key=key)


def family(seed, size, words, edits):
    rng = random.Random(seed)
    base = sentence(rng, words).split()
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(copy))
            copy[k : k + rng.randint(0, 1)] = [sentence(rng, 1)] * rng.randint(0, 1)
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("percent,width,small", [(90, 3, True), (80, 5, False)])
def test_links_match_brute_force(spark, edge_docs, percent, width, small):
    texts = [t for s, n, w, e in [(1, 150, 90, 8), (2, 40, 14, 2), (3, 30, 400, 12), (4, 25, 11, 1)]
             for t in family(s, n, w, e)]
    rows = [(1000 + 7 * k, t) for k, t in enumerate(texts)]
    random.Random(5).shuffle(rows)
    rows += [tuple(r) for r in edge_docs.select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, similar_documents(docs, percent, width, **(SMALL if small else {})).collect()), key=key)
    assert got == expected(rows, percent, width)
    assert sum(r[3] > 0 for r in got) > 100


SMALL = {"bucket_tokens": 3000, "group_rows": 5, "cell_queries": 4}


def test_a_passage_in_all_and_many_different_copies(spark):
    rng = random.Random(9)
    passage = sentence(rng, 40)
    rows = [(k, f"{sentence(rng, rng.randint(5, 90))} {passage}") for k in range(150)]
    rows += [(1000 + k, t) for k, t in enumerate(family(6, 120, 80, 4))]
    rows += [(2000 + k, passage) for k in range(30)] + [(3000, sentence(rng, 20_000))]
    rows += [(3001, rows[-1][1] + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for percent, width, sizes in ((80, 5, SMALL), (90, 3, {})):
        got = sorted(map(tuple, similar_documents(docs, percent, width, **sizes).collect()), key=key)
        assert got == expected(rows, percent, width)


def test_one_of_each(edge_docs, no_docs):
    kept = one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert 20 in ids and 21 not in ids and {10, 11, 12} <= set(ids)
    assert ids.count(None) == 1 and ids.count(22) <= 1  # without a text; a repeated row
    assert one_of_each(no_docs).isEmpty() and similar_documents(no_docs).isEmpty()


def test_rows_without_an_id_are_copies_too(spark):
    text = "the same words in every row of this table"
    docs = spark.createDataFrame([(None, text)] * 50 + [(7, text + "!")] * 2 + [(None, "")] * 2,
                                 "doc_id long, text string").repartition(3)
    left = one_of_each(docs).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left) == [(0, ""), (0, ""), (0, text), (7, text + "!")]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(500, 600 + k) for k in range(60)] + [(7, 7)]
    random.Random(2).shuffle(edges)
    got = dict(map(tuple, connected_components(
        spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(1, 41)} | {600 + k: 500 for k in range(60)}
