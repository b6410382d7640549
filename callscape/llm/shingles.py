"""Word shingles of whole texts as sorted 64-bit hashes, computed with numpy on UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SEGMENT = 1 << 21  # bytes hashed at a time; a longer word extends its segment
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SEED = np.random.default_rng(20240101)
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SPACES = b"\t\n\x0b\x0c\r "
_LOWER = bytes(range(256)).lower()
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA5A3564E27F8865B, 0xC2B2AE3D27D4EB4F,
                   0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT + (1 << 16))
        tables = []
        for base in (_BASE, _UNBASE):
            steps = np.full(size, base)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers[0], _powers[1]


def _segments(data: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(data):
        end = min(start + SEGMENT, len(data))
        while end < len(data) and data[end] not in _SPACES:
            end += 1
        yield data[start:end]
        start = end


def word_hashes(data: bytes, apart: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start byte of every word of ``data``, A-Z lower-cased. A word is a run of bytes
    that ``apart`` does not mark; white space is always marked."""
    parts, starts, base = [], [], 0
    for piece in _segments(data):
        a = np.frombuffer(piece.translate(_LOWER), np.uint8)
        inside = ~apart[a]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        s, e = edge[0::2], edge[1::2]
        up, down = _power_table(len(a) + 1)
        total = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
        parts.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + base)
        base += len(piece)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(starts)


def ngrams(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of every ``width`` (at most 5) consecutive words."""
    out = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k in range(width):
        out += words[k : k + len(out)] * _PLACE[k]
    return mix(out)


def shingle_sets(texts: list[bytes], width: int = 3) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: every ``width`` consecutive words, or all
    words of a shorter text as one shingle, or nothing for a text without words."""
    batch: list[bytes] = []
    size = 0
    for text in texts:
        batch.append(text)
        size += len(text) + 1
        if size >= SEGMENT:
            yield from _batch_sets(batch, width)
            batch, size = [], 0
    if batch:
        yield from _batch_sets(batch, width)


def _batch_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    words, starts = word_hashes(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
    full = ngrams(words, width)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            s = np.sort(full[a : b - width + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            short = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64)
            yield mix(np.array([short + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
