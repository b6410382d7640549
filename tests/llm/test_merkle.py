"""Trees, layout and proofs against a plain recursion."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from callscape.llm.merkle import address, merkle_report, tree_size


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(level):
    """All levels of a tree over digests."""
    levels = [level]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 8]) for i in range(0, len(last), 8)])
    return levels


def path_of(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 8 * 8
        out.append((level[a:i], level[i + 1 : a + 8]))
        i //= 8
    return out


def plain(rows):
    leaf = lambda r, t: h(*map(field, (r[0], r[3], r[2], r[4], t)))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((-1 if r[0] is None else r[0], leaf(r, r[1]), r))
    names = sorted(groups, key=lambda x: b"" if x is None else b"+" + x.encode())
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None and x[0] >= 0, x[:2]))
        trees[name] = climb([x[1] for x in groups[name]])
    top = climb([trees[n][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for i, (_, digest, r) in enumerate(groups[name]):
            path = path_of(trees[name], i) + path_of(top, k)
            altered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = r[1]
            if altered and text is not None:
                text = text.encode().lower().decode()
            node = leaf(r, text)
            for left, right in path:
                node = h(*left, node, *right)
            root = top[-1][0]
            proof = h(*[x for left, right in path for x in left + right])
            out.append((r[0], digest, trees[name][-1][0], root, proof, node, node == root))
    return out


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", "y") for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long, idx string, grp string")


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5, 7])
def test_addresses_are_a_permutation(levels):
    seen = np.concatenate([address(d, np.arange(8**d), levels) for d in range(levels)])
    assert sorted(seen) == list(range(tree_size(levels)))


def test_lower_parts_are_contiguous():
    below = [address(2, np.array([5]), 4)[0], *address(3, np.arange(40, 48), 4)]
    assert below == list(range(below[0], below[0] + 9))


@pytest.mark.parametrize("height", [1, 4])
def test_proofs_equal_plain_ones(spark, edge_docs, height):
    rows = [(i, f"Text {i}" * (i % 5), ["de", "a", None, "ü", ""][i * i % 7 % 5], "s", i)
            for i in range(700)]
    rows += [(None, None, "de", None, None), (None, "x", "de", "s", 1), (3, "Ä", "solo", "s", 1)]
    rows += [(5, "Same", "de", "s", 4)] * 9
    rows += [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in edge_docs.collect()]
    got = merkle_report(frame(spark, rows).repartition(5), height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert order(got.collect()) == order(plain(rows))


def test_no_rows_and_one_row(spark, no_docs):
    assert merkle_report(no_docs).count() == 0
    one = merkle_report(frame(spark, [(4, "A", None, None, None)])).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == h()
    assert one["verified"] == (zlib.crc32(b"4") % 3 != 0)


def test_tampering_shows(spark):
    rows = [(i, "Upper" if i % 2 else "lower", "en", "s", 5) for i in range(200)]
    for r in merkle_report(frame(spark, rows)).collect():
        assert r["verified"] == (not (r["doc_id"] % 2 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0))
