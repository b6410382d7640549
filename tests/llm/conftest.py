import random

import pytest

CLASH = ["n_words", "digest", "line", "h1", "row", "host", "key", "sig", "place", "_w", "_doc", "v"]


def sentence(rng, n):
    letters = "abcdefghilmnorstué"
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(n))


def edge_texts():
    """(doc_id, text) with nulls, empty and long texts, ties, repeated rows and near copies."""
    rng = random.Random(4)
    body = "\n".join(sentence(rng, 14) for _ in range(9))
    long = "\n".join(sentence(rng, 40) for _ in range(1500))
    rows = [(10, None), (11, ""), (12, " \n\t "), (13, "one"), (14, "One two"), (15, "one two")]
    rows += [(20, body), (21, body), (22, body.replace("a", "o", 1)), (22, body.replace("a", "o", 1))]
    rows += [(23, body + "\n" + sentence(rng, 5)), (None, body), (None, None), (30, long)]
    rows += [(31, long + " tail"), (40, "Again. " * 200), (41, "x\x00y  z퟿ é É\r\n" * 20)]
    words = sentence(rng, 120).split()
    for k in range(12):  # a group of near copies, some linked, some not
        copy = list(words)
        for _ in range(k):
            copy[rng.randrange(len(copy))] = sentence(rng, 1)
        rows.append((50 + k, " ".join(copy)))
    common = sentence(rng, 12)
    for k in range(40):  # a line that most of a host's documents share
        rows.append((100 + k, common + "\n" + sentence(rng, 60 if k % 3 else 2)))
    rows.append((150, "\n".join([common] * 3)))
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"`{c}` string" for c in CLASH)
    rows = [(i, t, None, None if i is None else f"s{i % 2 if i < 100 else 7}",
             None if t is None else len(t), *["x"] * len(CLASH)) for i, t in edge_texts()]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
