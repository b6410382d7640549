import base64
import hashlib
import math
import random
import re

import pytest
from llm.test_quality_rules import key
from pyspark.sql import functions as F

from callscape.llm.licenses import PHRASES, TEMPLATES, VOCABULARY, license_scan
from callscape.llm.warc import archive_pages, read_archive, rebuild_records, write_archive
from callscape.scale import scratch_path

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stands(words, at, phrase):
    phrase = phrase.split()
    return at >= 0 and words[at : at + len(phrase)] == phrase


def expected(rows):
    texts = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
             for _, t in rows]
    weight = {v: math.log((len(rows) + 1) / (sum(v in w for w in map(set, texts)) + 1))
              for v in VOCABULARY}
    out = []
    for (i, _), words in zip(rows, texts, strict=True):
        base = [(k, label) for label, p in PHRASES for k in range(len(words)) if stands(words, k, p)]
        top = sorted(set(VOCABULARY) & set(words), key=lambda v: (-weight[v], v))[:8]
        support = {}
        for p, w in enumerate(words):
            for t, (_, text, _) in enumerate(TEMPLATES):
                for q, v in enumerate(text.split()):
                    if w == v and w in top:
                        support[t, p - q] = support.get((t, p - q), 0) + 1
        labels, score = {label for _, label in base}, 0.5 if base else 0.0
        for (t, p), n in support.items():
            label, text, phrases = TEMPLATES[t]
            at = [len(text[: text.index(f)].split()) for f in phrases]
            if n >= 2 and all(stands(words, p + a, f) for a, f in zip(at, phrases, strict=True)):
                labels.add(label)
                score = max(score, sum(words[p + q : p + q + 1] == [v] and p + q >= 0
                                       for q, v in enumerate(text.split())) / len(text.split()))
        starts = [k for k, _ in base]
        out.append((i, len(words), len(base), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)),
                    round(score, 9)))
    return sorted(out, key=key)


def test_license_scan_matches_brute_force(spark, edge_docs, no_docs):
    texts = ["Released under the MIT License.", "the mit\nlicense? MIT-License", "Apache License",
             "x " * 5 + "Licensed under CC BY-NC 4.0. tail", "CC BY NC", "by nc 4 0 licensed cc",
             "Licensed, under the Apache License (Version 2.0) and GNU General Public License 3",
             "general public", "license general public license", "MIT licenseé",
             "This wor\u212a is licensed under the GNU General Public License version 3", *[
                 t for _, t, _ in TEMPLATES], *[t.replace("the", "a") for _, t, _ in TEMPLATES]]
    rows = [(900 + k, t) for k, t in enumerate(texts)]
    rows += [tuple(r) for r in edge_docs.select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(*r[:-1], round(r[-1], 9)) for r in map(tuple, license_scan(docs).collect())]
    assert sorted(got, key=key) == expected(rows)
    assert license_scan(no_docs).isEmpty()
    plan = license_scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def complete(words):
    """Labels and score of all placements whose key phrases stand, without any look-up."""
    labels = {label for label, p in PHRASES for k in range(len(words)) if stands(words, k, p)}
    score = 0.5 if labels else 0.0
    for label, text, phrases in TEMPLATES:
        at = [len(text[: text.index(f)].split()) for f in phrases]
        for p in range(-len(text.split()), len(words)):
            if all(stands(words, p + a, f) for a, f in zip(at, phrases, strict=True)):
                labels.add(label)
                score = max(score, sum(p + q >= 0 and words[p + q : p + q + 1] == [v]
                                       for q, v in enumerate(text.split())) / len(text.split()))
    return ",".join(sorted(labels)), round(score, 9)


def test_no_licence_of_a_file_hides_another(spark):
    sentences = {label: t for label, t, _ in TEMPLATES}
    every = [t for _, t, _ in TEMPLATES]
    rng = random.Random(3)
    texts = [" ".join(every), " filler ".join(reversed(every)), sentences["bsd"] + ". " + every[11],
             sentences["bsd"] + " " + sentences["lgpl"],
             "\n".join(sentences[x] for x in ("bsd", "isc", "mpl", "lgpl")),
             " ".join(VOCABULARY) + " " + sentences["cc-by-nd"] + " " + " ".join(VOCABULARY),
             "sa cc by nc by cc", "license " * 50 + "cc by sa " * 3]
    for _ in range(40):
        words = " ".join(rng.sample(every, rng.randint(2, 9))).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in license_scan(docs).collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    assert got == {i: complete(split(t)) for i, t in enumerate(texts)}
    assert set(got[0][0].split(",")) == set(sentences)
    assert {r["labels"] for r in license_scan(docs, min_support=99).where("n_base = 0").collect()} == {""}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b/\r\nX: y", ""),
            (4, "u", None), (5, "u", "<p>other</p>" * 4000), (6, "u", "<p>é</p>"),
            (6, "u", "<p>é</p>"), (None, "n", "<p>é</p>"), (None, "n", "lonely")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit("x") for c in ("digest", "sha1", "size", "row_key", "data")}).repartition(3)


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_archive_round_trip(pages):
    got = sorted(map(tuple, archive_pages(pages).collect()), key=key)
    e, o = "<p>é</p>", "<p>other</p>" * 4000
    want = [(None, len(e.encode()), sha(e), "revisit", 6), (None, 6, sha("lonely"), "response", None),
            (1, len(e.encode()), sha(e), "revisit", 6), (2, len(e.encode()), sha(e), "revisit", 6),
            (3, 0, sha(""), "revisit", 4), (4, 0, sha(""), "response", None),
            (5, len(o), sha(o), "response", None), (6, len(e.encode()), sha(e), "response", None),
            (6, len(e.encode()), sha(e), "revisit", 6)]
    assert got == sorted(want, key=key)
    assert archive_pages(pages.limit(0)).isEmpty()


def test_records_are_rebuilt_exactly_and_damage_is_noticed(spark, pages):
    path = scratch_path(spark, "archive")
    write_archive(pages, path)
    records = [bytes(r["record"]) for r in rebuild_records(spark, path).collect()]
    assert len(records) == 9
    for r in records:
        head, block = r.split(b"\r\n\r\n", 1)
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and b"X" not in fields
        assert int(fields[b"Content-Length"]) == len(block) - 4
        payload = block[:-4].split(b"\r\n\r\n", 1)[1]
        if fields[b"WARC-Type"] == b"response":
            assert fields[b"WARC-Payload-Digest"].decode() == "sha1:" + sha(payload.decode())
        else:
            assert payload == b"" and b"WARC-Refers-To" in fields
    ids = [re.search(rb"WARC-Record-ID: (\S+)", r)[1] for r in records]
    assert len(set(ids)) == 9
    damaged = scratch_path(spark, "damaged")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{damaged}/headers")
    spark.read.parquet(f"{path}/payloads").withColumn(
        "data", F.concat("data", F.lit(b"!"))).write.parquet(f"{damaged}/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        read_archive(spark, damaged).collect()
