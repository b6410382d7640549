"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes become channels: their kind (lower case, capital, digit, space, line feed,
sentence mark, other symbol, non-ASCII), fixed random codes of the byte, and whether the next eight
bytes already stood up to ``LAGS`` bytes before. Learned filters of ``WIDTH`` bytes slide over them.
The text is covered by overlapping chunks of ``CHUNK`` filter positions; in each chunk the filters'
answers are max-pooled and averaged. Over all chunks of the whole text the largest maximum, the
largest average and the overall average of each filter are combined by a hidden layer into one
probability that the text's quality label is 1.

Training uses a bounded sample: at most ``max_docs`` labelled rows of the training folds, chosen by
a hash of their id, with texts of at most ``MAX_BYTES`` bytes, each read whole. Rows whose
crc32(doc_id as text) mod 5 is 0 are held out. Labels, lang, source and doc_id are no inputs.

Null and empty texts have no positions: all pooled answers are 0 and the combination of zeros is
their score. Without any labelled row every score is 0.5; with one label only, the network learns
that label. Repeated rows score alike; for repeated labels of an id the larger counts. Only the
named columns are read. Scoring needs no shuffle, and a long text is read in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
MAX_DOCS = 3000
MAX_BYTES = 32_000
WIDTH = 8
STRIDE = 2
FILTERS = 24
HIDDEN = 16
BLOCK = 64  # filter positions pooled together
CHUNK = 256  # positions of a chunk; chunks start every CHUNK / 2
PIECE = 1 << 18  # bytes of a text that are in memory as channels at a time
LAGS = 48
CODES = 4
THRESHOLD = 0.3


def _byte_channels() -> np.ndarray:
    table = np.zeros((256, 8 + CODES), np.float32)
    for b in range(1, 256):
        c = chr(b)
        kind = (7 if b > 127 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit()
                else 4 if c == "\n" else 3 if c.isspace() else 5 if c in ".,;:?'\"-()" else 6)
        table[b, kind] = 1
    table[1:, 8:] = np.random.default_rng(5).normal(0, 0.5, (255, CODES))
    return table


CHANNELS = _byte_channels()
DEPTH = CHANNELS.shape[1] + 1


def _recurs(data: np.ndarray) -> np.ndarray:
    """Whether the eight bytes at each place also stand up to ``LAGS`` bytes before."""
    wide = np.zeros(len(data), np.uint64)
    for k in range(8):
        wide[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(8 * k)
    out = np.zeros(len(data), bool)
    for lag in range(1, LAGS + 1):
        out[lag:] |= wide[lag:] == wide[:-lag]
    return out


def windows(texts: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The filters' inputs at every position of the texts (pieces of ``PIECE`` bytes or less, each
    with the bytes around it), and the number of positions of each text."""
    lead, tail = LAGS, WIDTH + 8
    buffer, starts, counts, at = [], [], [], 0
    for before, body, after in texts:
        n = -(-len(body) // STRIDE)
        buffer += [before.rjust(lead, b"\0"), body, after.ljust(tail, b"\0")]
        starts.append(at + lead + STRIDE * np.arange(n))
        counts.append(n)
        at += lead + len(body) + tail
    data = np.frombuffer(b"".join(buffer), np.uint8)
    channels = np.empty((len(data), DEPTH), np.float32)
    channels[:, :-1] = CHANNELS[data]
    channels[:, -1] = _recurs(data)
    place = np.concatenate(starts) if starts else np.zeros(0, int)
    seen = np.lib.stride_tricks.sliding_window_view(channels, WIDTH, axis=0)[place]
    return seen.reshape(len(place), -1), np.array(counts, np.int64)


def _pieces(text: bytes) -> list[tuple[bytes, bytes, bytes]]:
    return [(text[max(a - LAGS, 0) : a], text[a : a + PIECE], text[a + PIECE : a + PIECE + WIDTH + 8])
            for a in range(0, len(text), PIECE)]


class QualityNet:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.params = {
            "filters": rng.normal(0, (2 / (WIDTH * DEPTH)) ** 0.5, (WIDTH * DEPTH, FILTERS)),
            "shift": np.zeros(FILTERS),
            "mix": rng.normal(0, (2 / (3 * FILTERS)) ** 0.5, (3 * FILTERS, HIDDEN)),
            "mix_shift": np.zeros(HIDDEN),
            "out": rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN),
            "bias": np.zeros(1),
        }
        self.params = {k: v.astype(np.float32) for k, v in self.params.items()}

    def _answers(self, seen: np.ndarray) -> np.ndarray:
        return np.maximum(seen @ self.params["filters"] + self.params["shift"], 0)

    def _pooled(self, texts: list[bytes]) -> np.ndarray:
        """The pooled answers of whole texts, block by block and then chunk by chunk."""
        pieces = [(k, p) for k, t in enumerate(texts) for p in _pieces(t)]
        stats: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in texts]
        at = 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (end == at or size + len(pieces[end][1][1]) <= PIECE):
                size += len(pieces[end][1][1])
                end += 1
            seen, counts = windows([p for _, p in pieces[at:end]])
            answers, begin = self._answers(seen), 0
            for (k, _), n in zip(pieces[at:end], counts, strict=True):
                cut = np.arange(0, n, BLOCK)
                part = answers[begin : begin + n]
                stats[k].append((np.maximum.reduceat(part, cut), np.add.reduceat(part, cut),
                                 np.minimum(n - cut, BLOCK)))
                begin += n
            at = end
        return np.stack([_combine(s) for s in stats]) if stats else np.zeros((0, 3 * FILTERS))

    def _head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(pooled @ self.params["mix"] + self.params["mix_shift"], 0)
        return hidden, 1 / (1 + np.exp(-(hidden @ self.params["out"] + self.params["bias"])))

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self._head(self._pooled(texts))[1].astype(np.float64)

    def _gradients(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        p = self.params
        seen, counts = windows([(b"", t, b"") for t in texts])
        answers = self._answers(seen)
        ends = np.cumsum(counts)
        pooled = np.zeros((len(texts), 3 * FILTERS), np.float32)
        routes = []
        for k, (b, e) in enumerate(zip(ends - counts, ends, strict=True)):
            part = answers[b:e]
            if not len(part):
                routes.append(None)
                continue
            chunks = _chunks(len(part))
            means = np.stack([part[i:j].mean(axis=0) for i, j in chunks])
            top, best = part.argmax(axis=0), means.argmax(axis=0)
            every = np.arange(FILTERS)
            pooled[k] = np.concatenate([part[top, every], means[best, every], part.mean(axis=0)])
            routes.append((b, e, top, [chunks[c] for c in best]))
        hidden, chance = self._head(pooled)
        error = ((chance - labels) / len(labels)).astype(np.float32)
        back_hidden = np.outer(error, p["out"]) * (hidden > 0)
        back = back_hidden @ p["mix"].T
        inner = np.zeros_like(answers)
        for k, route in enumerate(routes):
            if route is None:
                continue
            b, e, top, best = route
            inner[b:e] += back[k, 2 * FILTERS :] / (e - b)
            for f in range(FILTERS):
                i, j = best[f]
                inner[b + i : b + j, f] += back[k, FILTERS + f] / (j - i)
                inner[b + top[f], f] += back[k, f]
        inner *= answers > 0
        return {"filters": seen.T @ inner, "shift": inner.sum(axis=0),
                "mix": pooled.T @ back_hidden, "mix_shift": back_hidden.sum(axis=0),
                "out": hidden.T @ error, "bias": error.sum(keepdims=True)}

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 24,
              rate: float = 4e-3) -> None:
        """Adam on the cross entropy."""
        rng = np.random.default_rng(2)
        first = {k: np.zeros_like(v) for k, v in self.params.items()}
        second = {k: np.zeros_like(v) for k, v in self.params.items()}
        steps = epochs * -(-len(texts) // batch)
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                grads = self._gradients([texts[i] for i in pick], labels[pick])
                t += 1
                slow = rate * (1 - (t - 1) / steps)
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    step = first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
                    self.params[k] = (self.params[k] - slow * step).astype(np.float32)


def _chunks(n: int) -> list[tuple[int, int]]:
    """Overlapping chunks of ``n`` positions."""
    return [(a, min(a + CHUNK, n)) for a in range(0, max(n - CHUNK // 2, 1), CHUNK // 2)]


def _combine(stats: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    if not stats:
        return np.zeros(3 * FILTERS, np.float32)
    top, total, size = (np.concatenate(x) for x in zip(*stats, strict=True))
    chunks = [(a // BLOCK, -(-b // BLOCK)) for a, b in _chunks(int(size.sum()))]
    means = [total[a:b].sum(axis=0) / size[a:b].sum() for a, b in chunks]
    return np.concatenate([top.max(axis=0), np.max(means, axis=0),
                           total.sum(axis=0) / size.sum()])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, max_docs: int) -> list:
    """Up to ``max_docs`` (text, quality) rows; at most this many ids are broadcast, and copies of
    an id are combined in the tasks before anything reaches the driver."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()
                     & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(
        F.octet_length("text") <= MAX_BYTES)
    return rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy(
        "doc_id").collect()


def train_quality_net(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS
                      ) -> QualityNet | None:
    rows = training_sample(docs, labels, max_docs)
    if not rows:
        return None
    net = QualityNet()
    net.train([r["text"].encode() for r in rows],
              np.array([r["quality"] for r in rows], np.float32))
    return net


def _scores(net: QualityNet | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                texts = [x or b"" for x in rows["text"].cast(pa.large_binary()).to_pylist()]
                score = net.score(texts) if net else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], rows["held_out"], pa.array(score)],
                    ["doc_id", "held_out", "score"])
    return run


def quality_scores(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS,
                   threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``threshold`` on) of every document."""
    net = train_quality_net(docs, labels, max_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       held_out(F.col("doc_id")).alias("held_out"))
    scored = rows.mapInArrow(_scores(net), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
