"""Benchmark decontamination by CGK embeddings, bit-sampling LSH and exact edit verification.

A document is contaminated by a benchmark item if some stretch of its words is within
``max_edits`` (a share of the item's words, 0.2) word edits of the item. Words are runs of letters,
digits and non-ASCII characters, in lower case.

1. The random-walk embedding of Chakraborty, Goldenberg and Koucky reads a word sequence with a
   pointer that stays or advances by a random bit of (step, word). A few edits change few places of
   the output, so edit distance becomes Hamming distance.
2. Bit sampling hashes a few places of the output. A window and an item with an equal sample are
   candidates. Lengths fall into classes of a ratio of 1.41. For each class the share of ``TRIALS``
   copies with the largest number of edits that is found is measured, piece look-up included, and
   samples are added until it reaches ``recall``. A class that ``MAX_SAMPLES`` do not bring there is
   searched without sampling: every window that holds a piece is a candidate, which loses nothing.
   ``recall_report`` returns the classes, their samples and their measured recall.
3. Candidates are verified by the exact edit distance to the best stretch around the window.

Windows are as long as an item. Of all windows only those are embedded that hold one of the item's
pieces: an item of L words within k edits keeps one of k + 1 pieces whole, so no others can match.

Items are the query set: they are taken in blocks of about ``ITEM_BLOCK``, each block's index is
sent to the tasks, and the documents are scanned once per block without a shuffle. An item of over
``ITEM_WORDS`` words is searched by parts of about equal length up to that: within ``max_edits`` of
the item, one part at least is within ``max_edits`` of its own. A part that matches only says where to
look; the whole item is verified by its exact edit distance around that place. Windows of equal words
and surroundings are embedded and verified once, and ``PAIRS`` windows at a time, so a text of one
repeated word takes bounded memory. Items and documents
without words, nulls and empty texts among them, match nothing. Items without an item_id are searched
like others, each text of them an item of its own. Repeated rows give one result. Only doc_id, text,
item_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscape.llm.common import stored
from callscape.llm.shingles import SEGMENT, _power_table, mix, ngrams, word_hashes

ITEM_BLOCK = 10_000
ITEM_WORDS = 512
WALKS = 4
PLACES = 2  # places in a sample
MAX_SAMPLES = 192
TRIALS = 300  # edited copies per class of lengths
PIECE_WORDS = 5  # most words of a piece that are hashed
PAIRS = 1 << 19  # windows met at a time
CELLS = 1 << 21  # places of windows verified at a time
_APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_PAD = np.uint64(0x5DEECE66D)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> np.ndarray:
    return word_hashes((text or "").lower().encode("utf-8", "replace"), _APART)[0]


def embed_samples(rows: np.ndarray, length: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Keys of the bit samples of the embeddings of ``rows`` (padded to one width).

    ``shares[w, r, m]`` places sample r of walk w at that share of the first 2 * length steps,
    by which time a walk has read the row on average. Returns (walks * samples, rows).
    """
    n, width = rows.shape
    walks, samples, places = shares.shape
    keys = np.zeros((walks, samples, n), np.uint64)
    every = np.arange(n)
    padded = np.concatenate([rows, np.full((n, 1), _PAD)], axis=1)
    steps = 2 * int(length.max(initial=0))
    for w in range(walks):
        at = np.zeros(n, np.int64)
        trace = np.empty((steps, n), np.uint64)
        for t in range(steps):
            word = np.where(at < length, padded[every, at], _PAD)
            trace[t] = word
            coin = mix(word + np.array([t * WALKS + w + 1], np.uint64) * _STEP)
            at = np.minimum(at + (coin >> np.uint64(63)).astype(np.int64), width)
        for m in range(places if n else 0):
            spot = np.floor(shares[w, :, m, None] * (2 * length)).astype(np.int64)
            keys[w] += mix(trace[spot, every] + np.uint64(m + 1))
    name = np.arange(walks * samples, dtype=np.uint64)[:, None]
    name = mix(length.astype(np.uint64) + (name << np.uint64(20)))
    return mix(keys.reshape(walks * samples, n) + name)


def edit_distances(items: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Least word edits that turn each item (a row) into some stretch of its window (a row)."""
    n, width = windows.shape
    j = np.arange(width + 1)
    row = np.zeros((n, width + 1), np.int64)
    for i in range(items.shape[1]):
        new = row + 1
        other = windows != items[:, i : i + 1]
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + other)
        row = np.minimum.accumulate(new - j, axis=1) + j
    return row.min(axis=1)


class ItemIndex:
    """What a block of items looks like to the tasks."""

    def __init__(self, items: list[tuple[int | None, str, int]], max_edits: float, recall: float):
        self.whole = [w for _, t, _ in items for w in [words_of(t)]]
        cuts = [np.linspace(0, len(w), -(-len(w) // ITEM_WORDS) + 1).astype(np.int64)
                for w in self.whole]
        parts = [(k, self.whole[k][a:b]) for k, c in enumerate(cuts)
                 for a, b in zip(c[:-1], c[1:], strict=True)]
        self.owner = np.array([k for k, _ in parts], np.int64)
        self.offset = np.concatenate([np.zeros(0, np.int64), *[c[:-1] for c in cuts]])
        self.long = np.array([len(w) > ITEM_WORDS for w in self.whole], bool)[self.owner]
        self.limit = [int(len(w) * max_edits + 1e-9) for w in self.whole]
        self.ids = pa.array([i for i, _, _ in items], pa.int64())
        self.named = pa.array([n for _, _, n in items], pa.int64())
        self.length = np.array([len(w) for _, w in parts], np.int64)
        self.edits = np.floor(self.length * max_edits + 1e-9).astype(np.int64)
        self.words = np.full((len(parts), int(self.length.max(initial=1))), _PAD)
        for k, (_, w) in enumerate(parts):
            self.words[k, : len(w)] = w
        self._pieces()
        self._classes(recall)

    def _pieces(self) -> None:
        self.size = np.clip(self.length // (self.edits + 1), 1, PIECE_WORDS)
        self.step = np.maximum(self.length // (self.edits + 1), 1)
        self.pieces = {}
        for g in np.unique(self.size):
            found = []
            for i in np.flatnonzero(self.size == g):
                grams = ngrams(self.words[i, : self.length[i]], int(g))
                found += [(grams[p], i, p) for p in self._cuts(i)]
            hashes = np.array([f[0] for f in found], np.uint64)
            order = np.argsort(hashes)
            filled = np.zeros(1 << 20, bool)
            filled[hashes >> np.uint64(44)] = True
            self.pieces[int(g)] = (hashes[order], np.array([f[1] for f in found])[order],
                                   np.array([f[2] for f in found])[order], filled)

    def _cuts(self, i: int) -> np.ndarray:
        """Where the pieces of item ``i`` begin."""
        return np.arange(min(self.edits[i] + 1, self.length[i])) * self.step[i]

    def _classes(self, recall: float) -> None:
        """Samples of each class of lengths, its keys, or none where it is searched exactly."""
        rng = np.random.default_rng(7)
        kind = np.floor(2 * np.log2(np.maximum(self.length, 1))).astype(np.int64)
        self.kind, self.exact = kind, np.zeros(len(kind), bool)
        self.sampled, self.report = {}, []
        for c in np.unique(kind):
            members = np.flatnonzero(kind == c)
            reached, shares = self._sampling(members, recall, rng)
            samples = 0 if shares is None else shares.shape[0] * shares.shape[1]
            if shares is None:
                self.exact[members] = True
            else:
                width = int(self.length[members].max())
                keys = embed_samples(self.words[members, :width], self.length[members], shares)
                order = np.argsort(keys, axis=1)
                self.sampled[int(c)] = (shares, np.take_along_axis(keys, order, axis=1),
                                        members[order])
            self.report.append((int(self.length[members].min()), int(self.length[members].max()),
                                len(members), samples, float(reached)))

    def _sampling(self, members: np.ndarray, recall: float, rng: np.random.Generator
                  ) -> tuple[float, np.ndarray | None]:
        """Measured recall on edited copies of ``members``, and the places of as few samples as
        reach ``recall``; no places, and a recall of one, if the most allowed do not."""
        pick = rng.choice(members, TRIALS)
        lengths, width = self.length[pick], int(self.length[pick].max())
        rows, copy = [], []
        for t, i in enumerate(pick):
            windows = self._copy_windows(int(i), rng)
            rows.append(np.pad(windows, ((0, 0), (0, width - windows.shape[1])),
                               constant_values=_PAD))
            copy += [t] * len(windows)
        each = np.array(copy, np.int64)
        shares = rng.random((WALKS, MAX_SAMPLES // WALKS, PLACES))
        own = embed_samples(self.words[pick, :width], lengths, shares)
        same = embed_samples(np.concatenate(rows), lengths[each], shares) == own[:, each]
        same = same.reshape(WALKS, -1, len(each)).any(axis=0)
        samples = 2
        while samples <= MAX_SAMPLES // WALKS:
            reached = len(np.unique(each[same[:samples].any(axis=0)])) / TRIALS
            if reached >= recall:
                return reached, shares[:, :samples]
            samples += max(1, samples // 2)
        return 1.0, None

    def _copy_windows(self, i: int, rng: np.random.Generator) -> np.ndarray:
        """The windows that the pieces of item ``i`` put into a copy of it with the largest number
        of edits, among other words."""
        n, k, g = int(self.length[i]), int(self.edits[i]), int(self.size[i])
        words = self.words[i, :n]
        fresh = lambda m: rng.integers(1, 1 << 63, m, dtype=np.uint64)
        text = list(words)
        for new in fresh(k):
            at, kind = int(rng.integers(len(text) + 1)), int(rng.integers(3))
            text[at : at + (kind != 1)] = [] if kind == 0 else [new]
        doc = np.concatenate([fresh(2 * k + 1), np.array(text, np.uint64), fresh(2 * k + 1)])
        cuts = self._cuts(i)
        at, p = np.nonzero(ngrams(doc, g)[:, None] == ngrams(words, g)[cuts])
        start = np.unique(at - cuts[p])
        return _cut(doc, start, n, np.zeros(len(start), int), np.full(len(start), len(doc)))

    def _hits(self, words: np.ndarray, last: np.ndarray):
        """Start, item and a word of the windows in which pieces stand, about PAIRS at a time."""
        for g, (hashes, item, offset, filled) in self.pieces.items():
            grams = ngrams(words, g)
            at = np.flatnonzero(filled[grams >> np.uint64(44)])
            at = at[at + g <= last[at]]
            n = (np.searchsorted(hashes, grams[at], "right")
                 - np.searchsorted(hashes, grams[at], "left"))
            at, n = at[n > 0], n[n > 0]
            for some in np.split(at, np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1):
                k, hit = _expand(hashes, grams[some])
                if len(k):
                    yield some[hit] - offset[k], item[k], some[hit]

    def matches(self, words: np.ndarray, first: np.ndarray, last: np.ndarray):
        """Place in ``words``, item and edits of verified matches, the best of each document and
        item. Word p belongs to the document whose words are ``first[p]`` to ``last[p]``
        (exclusive)."""
        name = _contents(words)
        found, leads = [np.zeros((4, 0), np.int64)], [np.zeros((4, 0), np.int64)]
        for start, item, home in self._hits(words, last):
            low, high = first[home], last[home]
            around = 2 * self.edits[item]
            print_ = name(start, np.maximum(start - around, low),
                          np.minimum(start + self.length[item] + around, high))
            every = [self._exact_pairs(words, start, item, low, high, print_)]
            every += [self._sampled_pairs(c, words, start, item, low, high, print_)
                      for c in np.unique(self.kind[item]) if int(c) in self.sampled]
            at, item, edits = map(np.concatenate, zip(*every, strict=True))
            part = self.long[item]
            leads.append(np.stack([start[at] - self.offset[item], self.owner[item], low[at],
                                   high[at]])[:, part])
            place = np.maximum(start, low)[at]
            found.append(_best(np.stack([low[at], self.owner[item], edits, place])[:, ~part]))
        start, item, low, high = np.unique(np.concatenate(leads, axis=1), axis=1)
        long = self._around(words, start, item, low, high)
        found.append(np.stack([first[long[0]], long[1], long[2], long[0]]))
        _, item, edits, place = _best(np.concatenate(found, axis=1))
        return place, item, edits

    def _exact_pairs(self, words, start, item, low, high, print_):
        """Window, item and edits of the matches of items that are searched without samples."""
        mine = np.flatnonzero(self.exact[item])
        _, one, all_ = np.unique(mix(print_[mine] + item[mine].astype(np.uint64) * _STEP),
                                 return_index=True, return_inverse=True)
        r = mine[one]
        edits = self._verified(words, start[r], item[r], low[r], high[r])[all_]
        good = edits <= self.edits[item[mine]]
        return mine[good], item[mine][good], edits[good]

    def _sampled_pairs(self, c, words, start, item, low, high, print_):
        """Window, item and edits of the matches of items of class ``c`` with an equal sample."""
        shares, table, owners = self.sampled[int(c)]
        mine = np.flatnonzero(self.kind[item] == c)
        length = self.length[item[mine]]
        _, one, all_ = np.unique(mix(print_[mine] + length.astype(np.uint64) * _STEP),
                                 return_index=True, return_inverse=True)
        r, length = mine[one], length[one]
        pairs = [np.zeros(0, np.int64)]
        width = int(length.max())
        for a in range(0, len(r), max(1, CELLS // width)):
            b = slice(a, a + max(1, CELLS // width))
            rows = _cut(words, start[r[b]], width, low[r[b]], high[r[b]])
            rows[np.arange(width) >= length[b][:, None]] = _PAD
            for sample, values in enumerate(embed_samples(rows, length[b], shares)):
                k, window = _expand(table[sample], values)
                pairs.append((window + a) * len(self.length) + owners[sample][k])
        window, other = np.divmod(np.unique(np.concatenate(pairs)), len(self.length))
        same = self.length[other] == length[window]
        window, other = window[same], other[same]
        w = r[window]
        edits = self._verified(words, start[w], other, low[w], high[w])
        good = edits <= self.edits[other]
        window, other, edits = window[good], other[good], edits[good]
        k, at = _expand(window, all_)
        return mine[at], other[k], edits[k]

    def _verified(self, words, start, item, low, high) -> np.ndarray:
        """Least edits of each item around its window."""
        edits = np.zeros(len(item), np.int64)
        for n in np.unique(self.length[item]):
            mine = np.flatnonzero(self.length[item] == n)
            k = int(self.edits[item[mine[0]]])
            width = int(n) + 4 * k
            for a in range(0, len(mine), max(1, CELLS // width)):
                m = mine[a : a + max(1, CELLS // width)]
                around = _cut(words, start[m] - 2 * k, width, low[m], high[m])
                edits[m] = edit_distances(self.words[item[m], :n], around)
        return edits

    def _around(self, words: np.ndarray, start: np.ndarray, item: np.ndarray, first: np.ndarray,
                last: np.ndarray) -> np.ndarray:
        """Place, item and edits of the whole items that match where their parts put their start.
        Starts in one document up to the item's edits apart are looked at together."""
        groups: list[tuple[int, int, int, int]] = []
        for r in np.lexsort((start, first, item)):
            i, f, s = int(item[r]), int(first[r]), int(start[r])
            if not groups or groups[-1][:2] != (i, f) or s - groups[-1][2] > self.limit[i]:
                groups.append((i, f, s, int(last[r])))
        found = []
        for i, f, s, end in groups:
            whole, k = self.whole[i], self.limit[i]
            around = words[max(s - 2 * k, f) : min(s + len(whole) + 3 * k, end)]
            edits = int(edit_distances(whole[None], around[None])[0])
            if edits <= k:
                found.append((max(s, f), i, edits))
        return np.array(found, np.int64).reshape(-1, 3).T


def _best(rows: np.ndarray) -> np.ndarray:
    """Of columns (document, item, edits, place) the least of each document and item."""
    rows = rows[:, np.lexsort(rows[::-1])]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
    return rows[:, new]


def _contents(words: np.ndarray):
    """A function of start, begin and end that names the words from begin to end (exclusive) and
    where among them the start lies."""
    up, down = _power_table(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])

    def name(start: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        shape = mix((start - begin).astype(np.uint64) * _STEP + (end - begin).astype(np.uint64))
        return mix((total[end] - total[begin]) * down[begin] + shape)
    return name


def _expand(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (place in the sorted table, place in values) of equal hashes."""
    a, b = np.searchsorted(table, values, "left"), np.searchsorted(table, values, "right")
    n = b - a
    who = np.repeat(np.arange(len(values)), n)
    return np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum()), who


def _cut(words: np.ndarray, start: np.ndarray, width: int, first: np.ndarray, last: np.ndarray
         ) -> np.ndarray:
    """Windows of ``words``; places outside the document are filled with values of their own."""
    at = start[:, None] + np.arange(width)
    inside = (at >= first[:, None]) & (at < last[:, None])
    return np.where(inside, words[np.clip(at, 0, len(words) - 1)], _PAD + np.uint64(1))


def _scan(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").lower().encode("utf-8", "replace") for t in batch["text"].to_pylist()]
            size, group = 0, []
            for row, text in enumerate(texts):
                group.append(row)
                size += len(text)
                if size >= SEGMENT or row == len(texts) - 1:
                    yield _match_batch(index.value, batch, group, [texts[r] for r in group])
                    size, group = 0, []
    return run


def _match_batch(index: ItemIndex, batch: pa.RecordBatch, rows: list[int], texts: list[bytes]
                 ) -> pa.RecordBatch:
    words, starts = word_hashes(b"\n".join(texts), _APART)
    bounds = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    n = np.diff(bounds, prepend=0)
    doc = np.repeat(np.arange(len(texts)), n)
    first, last = np.repeat(bounds - n, n), np.repeat(bounds, n)
    place, item, edits = index.matches(words, first, last) if len(words) else [np.zeros(0, int)] * 3
    place = np.minimum(place, max(len(words) - 1, 0))
    owner = pa.array(np.array(rows)[doc[place]] if len(place) else np.zeros(0, int))
    return pa.RecordBatch.from_arrays(
        [batch["doc_id"].take(owner), batch["row"].take(owner),
         index.ids.take(pa.array(item)), index.named.take(pa.array(item)),
         pa.array(place - first[place] if len(place) else place), pa.array(edits)],
        ["doc_id", "row", "item_id", "item", "start_word", "n_edits"])


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str, int]]]:
    """Items of about ``ITEM_BLOCK`` at a time: item_id, text and a name for those without an id."""
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), "text",
        F.when(F.col("item_id").isNull(), F.xxhash64("text")).otherwise(0).alias("item"),
    ).where("text is not null")
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield [(r["item_id"], r["text"], r["item"]) for r in block]


def recall_report(benchmark: DataFrame, max_edits: float = 0.2, recall: float = 0.99) -> DataFrame:
    """block, least_words, most_words, n_items (parts of long items count singly), n_samples (0:
    searched exactly) and measured recall of every class of item lengths."""
    rows = [(b, *row) for b, items in enumerate(_item_blocks(benchmark))
            for row in ItemIndex(items, max_edits, recall).report]
    return benchmark.sparkSession.createDataFrame(
        rows, "block int, least_words int, most_words int, n_items int, n_samples int, recall double")


def contaminations(docs: DataFrame, benchmark: DataFrame, max_edits: float = 0.2,
                   recall: float = 0.99) -> DataFrame:
    """doc_id, row (a hash of id and text), item_id, start_word and n_edits: the best match, then
    the first, of each document with each item that contaminates it."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64("doc_id", "text").alias("row"), "text")
    out = None
    for items in _item_blocks(benchmark):
        index = spark.sparkContext.broadcast(ItemIndex(items, max_edits, recall))
        found = rows.mapInArrow(_scan(index), "doc_id long, row long, item_id long, "
                                "item long, start_word long, n_edits long")
        out = found if out is None else out.unionByName(found)
    best = F.min(F.struct("n_edits", "start_word")).alias("best")
    return out.groupBy("doc_id", "row", "item_id", "item").agg(best).select(
        "doc_id", "row", "item_id", "best.start_word", "best.n_edits")


def contamination_report(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """doc_id, item_id, start_word, n_edits, one row per document and item."""
    return contaminations(docs, benchmark, **limits).drop("row")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """``docs`` without the documents that any item contaminates."""
    bad = stored(contaminations(docs, benchmark, **limits).select("row").distinct(), "leaks")
    rows = docs.select(F.struct(*docs.columns).alias("_doc"),
                       F.xxhash64(F.col("doc_id"), F.col("text")).alias("row"))
    return rows.join(bad, "row", "left_anti").select("_doc.*")
