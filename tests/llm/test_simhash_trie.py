"""Fingerprints and links against plain counting."""

import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from callscape.llm.simhash_trie import fingerprint, fingerprint_links, simhash_duplicates, trie_pairs


def plain_print(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    names = {}
    for i, f in prints:
        names.setdefault(f, []).append(i)
    root = {f: f for f in names}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    degree = dict.fromkeys(names, 0)
    for a, b in combinations(names, 2):
        if (a ^ b).bit_count() <= 2:
            degree[a] += 1
            degree[b] += 1
            root[top(a)] = top(b)
    least = {}
    for f, ids in names.items():
        known = [i for i in (*ids, least.get(top(f))) if i is not None]
        least[top(f)] = min(known, default=None)
    return [(i, f"{f:016x}", least[top(f)], degree[f]) for i, f in prints]


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def near_prints(rng, n, families):
    values = set(rng.integers(0, 1 << 64, n, dtype=np.uint64).tolist())
    for _ in range(families):
        seed = int(rng.integers(0, 1 << 64, dtype=np.uint64))
        for _ in range(40):
            values.add(seed ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)))
    return np.array(sorted(values), np.uint64)


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "A b c", "É é a\x00b  c\td e",
                                  "again " * 300, "tie odd tie odd tie odd tie"])
def test_fingerprint(text):
    assert fingerprint((text or "").encode()) == plain_print(text)


def test_long_text_in_parts():
    text = " ".join(f"w{i % 977}" for i in range(150_000))
    assert fingerprint(text.encode()) == plain_print(text)


@pytest.mark.parametrize("budget", [0, 2, 5])
def test_trie_pairs(budget):
    rng = np.random.default_rng(3)
    x, y = near_prints(rng, 300, 8), near_prints(rng, 200, 3)
    y = np.unique(np.concatenate([y, x[:50] ^ np.uint64(3)]))
    apart = np.bitwise_count(x[:, None] ^ y)
    got = [(int(i), int(j)) for a, b in trie_pairs(x, y, budget) for i, j in zip(a, b, strict=True)]
    assert sorted(got) == list(zip(*map(np.ndarray.tolist, np.nonzero(apart <= budget)), strict=True))
    own = [(int(i), int(j)) for a, b in trie_pairs(x, None, budget) for i, j in zip(a, b, strict=True)]
    within = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x) <= budget, 1))
    assert sorted(own) == [tuple(p) for p in within.tolist()]


@pytest.mark.parametrize("leaf", [8, 10_000])
def test_cells_meet_every_pair_once(spark, leaf):
    x = near_prints(np.random.default_rng(5), 150, 4)
    frame = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    links = {}
    for r in fingerprint_links(frame, 2, leaf).collect():
        links[r["fp"]] = links.get(r["fp"], 0) + r["links"]
    near = (np.bitwise_count(x[:, None] ^ x) <= 2).sum(axis=1) - 1
    assert links == {int(v): int(n) for v, n in zip(x.view(np.int64), near, strict=True) if n}


def test_components_equal_plain_ones(spark, edge_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    rows += [(None, "lone words here"), (7000, "x y"), (6999, "X  y")]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows],
                                 "doc_id long, text string, fp string, root string").repartition(3)
    got = simhash_duplicates(docs, leaf=16)
    assert got.columns == ["doc_id", "fingerprint", "component_id", "n_links"]
    assert order(got.collect()) == order(plain_components([(i, plain_print(t)) for i, t in rows]))


def test_no_documents(no_docs):
    assert simhash_duplicates(no_docs).count() == 0
