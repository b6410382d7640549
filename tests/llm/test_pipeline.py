import random
from collections import defaultdict

import pytest
from llm import test_decontaminate, test_jaccard_join, test_line_dedup, test_quality_rules
from llm.conftest import sentence
from llm.test_jaccard_join import family
from pyspark.sql import functions as F

import corpus_pipeline
from callscape.llm.common import stored
from callscape.llm.decontaminate import words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    items = [(k, sentence(rng, 30)) for k in range(8)]
    texts = [None, "", "too short"] + [sentence(rng, 70) for _ in range(30)]
    texts += family(5, 12, 80, 4) + [f"{sentence(rng, 60)}\n{texts[5]}", texts[4], texts[4]]
    texts += ["\n".join(sentence(rng, 12) for _ in range(8)) + "\n" + t for t in family(6, 6, 90, 2)]
    texts += [sentence(rng, 40) + " " + t + " " + sentence(rng, 20) for _, t in items[:5]]
    texts += ["again and again and " * 30]
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(k * 3, t, "en", f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_each_stage_matches_brute_force_on_its_own_input(spark, corpus):
    folder, rows, items = corpus
    docs, last = spark.read.parquet(f"{folder}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        hosts = {r["doc_id"]: r["source"] for r in docs.collect()}
        last = stored(stage(spark, docs, folder), name)
        if name == "packing":
            break
        assert last.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in last.collect()}
        pairs = list(before.items())
        if name == "quality_rules":
            judged = test_quality_rules.expected([(i, t, hosts[i]) for i, t in pairs])
            want = {r[0]: t for r, t in judged if r[-1]}
        elif name == "line_dedup":
            want = {i: t for i, t in test_line_dedup.expected(pairs)
                    if t == before[i] or t.strip(" \t\r\n\x0b\f")}
        elif name == "near_duplicates":
            named = test_jaccard_join.expected(pairs, 80, 5)
            want = {i: before[i] for i, n, c, _ in named if n == 0 or c == i}
        else:
            words = [words_of(t).tolist() for _, t in items]
            want = {i: t for i, t in pairs if not any(
                test_decontaminate.distance(w, words_of(t).tolist()) <= int(0.2 * len(w))
                for w in words)}
        assert after == want and 0 < len(after) < len(before), name
        assert last.where(F.col("n_chars") != F.length("text")).isEmpty()
        docs = last
    pieces = defaultdict(int)
    for r in last.collect():
        pieces[r["doc_id"]] += r["length"]
        total = {r["doc_id"]: r["doc_tokens"]}
        assert pieces[r["doc_id"]] <= total[r["doc_id"]]
    assert set(pieces) == {r["doc_id"] for r in docs.collect()}
    ran = corpus_pipeline.run(spark, folder)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, ran.select(key).collect())) == sorted(
        map(tuple, last.select(key).collect()))


def test_empty_corpus(spark, corpus, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).isEmpty()
