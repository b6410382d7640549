"""Token ids of whole texts by the tokenizers library, with a cache of words.

``word_bpe_49k`` never joins characters across white space, so a text's ids are those of its
words in turn. Words are split at ASCII white space, looked up, and encoded by the library when
first met; the tests compare this with encoding whole texts. The path may name another tokenizer
only if this holds for it and it is byte-level with lower case.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text that are looked up together
CACHE_WORDS = 800_000
_MARKS = b".,;:!?*#$%&|"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Numbers(dict):
    """Numbers words in the order in which they are first met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _byte_letters() -> dict[int, int]:
    """The character that byte-level models use for each byte: printable ones stand for themselves,
    the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted(set(range(256)) - set(plain))
    return {b: 256 + k for k, b in enumerate(others)}


_LETTERS = _byte_letters()


class WordEncoder:
    """Word 0 is the end of a text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.marks: dict[bytes, list[int]] = {}
        self.most = CACHE_WORDS
        self._reset({b"": 0}, np.ones(1, np.int64), np.zeros(1, np.uint32))

    def _reset(self, numbers: dict, sizes: np.ndarray, flat: np.ndarray) -> None:
        self.numbers = _Numbers(numbers)
        self.sizes, self.flat = sizes, flat
        self.starts = np.cumsum(sizes) - sizes
        self.uses = np.zeros(len(sizes), np.int64)

    def _whole(self, words: list[bytes]) -> list[list[int]]:
        found = self.library.encode_batch_fast(
            [w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [e.ids for e in found]

    def _word(self, word: bytes) -> list[int] | None:
        """The ids of a word of Latin letters and closing marks, straight from the library's model:
        its normaliser and splitter only lower-case such a word and part it from its marks."""
        head = word.rstrip(_MARKS)
        if head.isalpha():  # ASCII letters
            letters = head.lower().decode()
        else:
            text = head.decode("utf-8", "replace")
            if not text.isalpha() or max(text) > "ÿ":
                return None
            letters = text.lower().encode().decode("latin-1").translate(_LETTERS)
        ids = [t.id for t in self.model.tokenize(letters)]
        if len(head) < len(word):
            tail = word[len(head) :]
            if tail not in self.marks:
                self.marks[tail] = self._whole([tail])[0]
            ids += self.marks[tail]
        return ids

    def _learn(self, words: list[bytes]) -> None:
        ids = [self._word(w) for w in words]
        rest = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(rest, self._whole([words[k] for k in rest]), strict=True):
            ids[k] = x
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat])
        self.uses = np.concatenate([self.uses, np.zeros(len(sizes), np.int64)])

    def _forget(self) -> None:
        """Keep the words that were used again, and start counting anew."""
        self.uses[0] = 1 << 40
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > self.most // 2:
            keep = np.sort(np.argsort(-self.uses, kind="stable")[: self.most // 2])
        words = list(self.numbers)
        flat = _gather(self.flat, self.starts[keep], self.sizes[keep])
        self._reset({words[k]: n for n, k in enumerate(keep)}, self.sizes[keep], flat)
        self.marks = {}

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by ``end``, and the number of each text's ids."""
        if len(self.numbers) > self.most:
            self._forget()
        self.flat[0] = end
        known = len(self.numbers)
        split = [t.split() for t in texts]
        for words in split:
            words.append(b"")
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        look = self.numbers.__getitem__
        at = np.fromiter(map(look, chain.from_iterable(split)), np.int64,
                         int(ends[-1]) if len(ends) else 0)
        if len(self.numbers) > known:
            self._learn(list(islice(self.numbers, known, None)))
        self.uses += np.bincount(at, minlength=len(self.uses))
        sizes = self.sizes[at]
        ids = _gather(self.flat, self.starts[at], sizes)
        return ids, np.diff(np.cumsum(sizes)[ends - 1], prepend=0)


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(total)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker, whose cache serves all its tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int, most: int = CACHE_WORDS
            ) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches, each with the ids of its rows' ``text`` (null: empty). The worker
    remembers about ``most`` words, some 0.3 KB each; ids do not depend on it."""
    words = encoder(path)
    words.most = most
    for batch in batches:
        column = batch["text"].cast(pa.large_binary())
        texts, size = [], 0  # only those of one slice leave the batch
        for row, text in enumerate(column):
            texts.append(text.as_py() or b"")
            size += len(texts[-1])
            if size >= CHUNK or row == len(column) - 1:
                ids, counts = words.encode(texts, end)
                first = row + 1 - len(texts)
                yield batch.slice(first, len(texts)), np.split(ids, np.cumsum(counts)[:-1])
                texts, size = [], 0
