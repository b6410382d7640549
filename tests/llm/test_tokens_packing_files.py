import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.test_quality_rules import key

from callscape.llm.packing import fill_window, pack_documents, plan_windows
from callscape.llm.range_coder import (
    SECTION_IDS, decode_segment, encode_segment, scaled_frequencies, through_files, TOTAL)
from callscape.llm.tokens import WordEncoder, default_tokenizer


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def ids_of(library, text, end):
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_words_encode_as_whole_texts(library, monkeypatch):
    rng = random.Random(1)
    alphabet = list("abcXYZ,.'!  \n\t\r\x0b\x0c\x1c\x85\xa0éÉΣςİ̱́ẖ0129ß 👍") + [
        "'s", "<|endoftext|>", "<|STARTOFTEXT|>", " don't ", "H̱"]
    latin = "".join(map(chr, range(0xA0, 0x180))) + "aAzZ.,!*"
    texts = ["", " ", *["".join(rng.choices(latin, k=rng.randint(1, 9))) for _ in range(300)],
             " ".join("".join(rng.choices("abcÉßüñÀÿ", k=5)) + m for m in "!*.,;:?#$%&|")] + ["", *["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(300)]]
    monkeypatch.setattr("callscape.llm.tokens.CACHE_WORDS", 50)
    words = WordEncoder(default_tokenizer())
    for at in range(0, len(texts), 20):
        part = texts[at : at + 20]
        ids, counts = words.encode([t.encode() for t in part], 7)
        for t, got in zip(part, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert got.tolist() == ids_of(library, t, 7).tolist(), t


def test_windows_are_best_and_use_all_pieces():
    rng = random.Random(2)
    for _ in range(60):
        counts = Counter(rng.randint(1, 30) for _ in range(rng.randint(0, 8)))
        room = rng.randint(0, 40)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        chosen = fill_window(dict(counts), room)
        assert all(n <= counts[x] for x, n in chosen.items())
        assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= room)
    counts = Counter(min(64, int(rng.expovariate(1 / 20)) + 1) for _ in range(5000))
    used = Counter()
    for window, times in plan_windows(dict(counts), 64):
        assert sum(x * n for x, n in window.items()) <= 64
        for x, n in window.items():
            used[x] += n * times
    assert used == counts


def test_pieces_cover_documents_and_sequences_have_no_gaps(edge_docs, no_docs, library):
    docs = [tuple(r) for r in edge_docs.select("doc_id", "text").collect()]
    rows = pack_documents(edge_docs).collect()
    sequences, pieces = defaultdict(list), []
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces.append((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    want = []
    for i, t in docs:
        ids = ids_of(library, t, 1)
        want += [(i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids))
                 for a in range(0, len(ids), 2048)]
    assert sorted(pieces, key=key) == sorted(want, key=key)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= total // 2048 + 2
    assert pack_documents(no_docs).isEmpty()


def test_segments_decode_whole_and_in_parts():
    rng = np.random.default_rng(3)
    for n in (1, 2, 127, 129, SECTION_IDS, SECTION_IDS * 5 + 77):
        for ids in (np.minimum(rng.geometric(0.01, n), 49407), rng.integers(0, 49408, n),
                    np.full(n, 9)):
            ids = ids.astype(np.uint32)
            data = encode_segment(ids)
            assert np.array_equal(decode_segment(data), ids)
            sections = -(-n // SECTION_IDS)
            last = decode_segment(data, sections - 1, sections)
            assert np.array_equal(last, ids[(sections - 1) * SECTION_IDS :])
    assert len(decode_segment(encode_segment(np.zeros(0, np.uint32)))) == 0
    broken = bytearray(encode_segment(np.arange(5000, dtype=np.uint32)))
    broken[-len(broken) // 4] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        decode_segment(bytes(broken))
    f = scaled_frequencies(np.array([1] * 50_000 + [10**9]))
    assert f.sum() == TOTAL and f.min() == 1


def test_files_give_back_all_ids_in_order(edge_docs, no_docs, library, monkeypatch):
    got = [tuple(r) for r in through_files(edge_docs).collect()]
    docs = [tuple(r) for r in edge_docs.select("doc_id", "text").collect()]
    want = [(i, len(ids), zlib.crc32(ids.tobytes()))
            for i, t in docs for ids in [ids_of(library, t, 2)]]
    assert sorted(((i, n, c) for i, _, n, c in got), key=key) == sorted(want, key=key)
    at = 0
    ordered = sorted(got, key=lambda r: r[1])
    for _, start, n, _ in ordered:
        assert start == at
        at += n
    ids = [r[0] for r in ordered]
    assert ids == sorted(ids, key=lambda i: (i is None, i))
    assert through_files(no_docs).isEmpty()
