"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks. Each has features of its ancestors (tags, and words of their class,
id and role) and of its text (length, links, punctuation, case). The field scores the labels main
text and boilerplate of all blocks together, with weights for label pairs, and Viterbi finds the
best sequence. Its blocks of main text, joined by two line feeds, are the page's text.

It is trained by gradient ascent on the conditional likelihood of labelled pages: up to
``max_pages`` pages of the table, chosen by a hash, whose semantic elements label them (main text is
what an article or main element holds outside navigation, asides, forms, headers, footers and
elements named as comments, adverts or notices), and ``made_pages`` generated pages of other
layouts. In training, ancestors of pages are hidden at random, so that the other features learn to
stand in for missing semantic elements.

The sample is bounded; extraction reads every page whole, in tasks that need nothing from each
other. Null and empty pages have an empty text. Repeated rows are extracted alike. Only page_id,
url and html are read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscape.llm.html_blocks import Block, leaf_blocks

MAX_PAGES = 200
MAX_PAGE_CHARS = 200_000
MADE_PAGES = 400
EPOCHS = 12
OUTSIDE = frozenset("nav header footer aside form menu dialog select button".split())
# Words of class, id and role attributes that mark what is not the article.
NOT_MAIN = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies disqus footer form gdpr header masthead menu "
    "modal nav navbar navigation newsletter notice notices pagination popup promo promoted related "
    "reply replies respond share sharing sidebar signup social sponsor sponsored subscribe "
    "toolbar widget".split())


def block_features(b: Block) -> list[str]:
    chars = len(b.text)
    words = b.text.count(" ") + 1
    marks = sum(b.text.count(c) for c in ".,;:!?")
    out = ["bias", f"own:{b.tags[-1] if b.tags else ''}", f"chars:{min(chars.bit_length(), 12)}",
           f"words:{min(words.bit_length(), 9)}", f"links:{round(4 * b.linked)}",
           f"marks:{min(marks.bit_length(), 5)}", f"end:{b.text[-1] in '.!?:;\"”'}",
           f"upper:{b.text.isupper()}", f"sign:{'©' in b.text or '|' in b.text}"]
    out += [f"in:{t}" for t in set(b.tags)]
    out += [f"name:{n}" for n in b.names]
    if b.names & NOT_MAIN:
        out.append("named outside")
    return out


def is_main(b: Block) -> bool:
    """Label of a block on a page with semantic elements."""
    inside = [k for k, t in enumerate(b.tags) if t in ("article", "main")]
    return bool(inside) and not (OUTSIDE & set(b.tags[inside[0]:])) and not (b.names & NOT_MAIN)


def made_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A generated page and the labels of its blocks."""
    letters = "abcdefghijklmnoprstuvwéüñ"
    parts: list[tuple[str, list[bool]]] = []

    def words(n: int) -> str:
        made = ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(n)]
        return " ".join(made).capitalize()

    def sentence() -> str:
        return words(rng.randint(4, 30)) + rng.choice([".", ".", "!", "?", ","])

    def links(n: int) -> str:
        return "".join(f"<li><a href='#'>{words(rng.randint(1, 3))}</a></li>" for _ in range(n))

    def outside(tag: str, name: str, inner: str, blocks: int) -> None:
        attr = rng.choice([f' class="{name}"', f' id="{name}"', f' class="x {name} y"'])
        parts.append((f"<{tag}{attr}>{inner}</{tag}>", [False] * blocks))

    def furniture() -> None:
        n = rng.randint(2, 7)
        kind = rng.randrange(8)
        if kind == 0:
            tag = rng.choice(["nav", "div", "header"])
            outside(tag, rng.choice(["menu", "nav", "navbar"]), f"<ul>{links(n)}</ul>", n)
        elif kind == 1:
            outside(rng.choice(["aside", "div"]), rng.choice(["sidebar", "related", "widget"]),
                    f"<h3>{words(2)}</h3><p>{sentence()}</p>", 2)
        elif kind == 2:
            outside("div", rng.choice(["ad", "advert", "sponsored", "banner", "promo"]),
                    sentence(), 1)
        elif kind == 3:
            outside("div", rng.choice(["cookie-notice", "consent", "notice", "gdpr"]),
                    f"<p>{sentence()}</p><button>{words(1)}</button>", 2)
        elif kind == 4:
            outside("form", rng.choice(["newsletter", "signup", "search"]),
                    f"<p>{sentence()}</p><button>{words(1)}</button>", 2)
        elif kind == 5:
            replies = "".join(f"<div class='comment'><p>{sentence()} {sentence()}</p></div>"
                              for _ in range(n))
            outside(rng.choice(["section", "div"]), rng.choice(["comments", "replies"]), replies, n)
        elif kind == 6:
            outside(rng.choice(["footer", "div"]), "footer", f"&copy; {words(3)} | {sentence()}", 1)
        else:
            outside(rng.choice(["header", "div"]), rng.choice(["header", "masthead"]), words(3), 1)

    for _ in range(rng.randint(1, 4)):
        furniture()
    tag = rng.choice(["article", "main", "div", "section", "div"])
    name = rng.choice(["content", "post", "article", "entry", "story", "text"])
    attr = rng.choice(["", f' class="{name}"', f' id="{name}"'])
    body, labels = [f"<h1>{words(rng.randint(2, 9))}</h1>"], [True]
    for _ in range(rng.randint(1, 12)):
        kind = rng.randrange(8)
        if kind == 0:
            n = rng.randint(2, 4)
            body.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(n)) + "</ul>")
            labels += [True] * n
        elif kind == 1:
            body.append(f"<{rng.choice(['h2', 'h3', 'blockquote'])}>{words(rng.randint(1, 8))}<p>")
            labels.append(True)
        elif kind == 2 and rng.random() < 0.4:
            start = len(parts)
            furniture()
            body.append(parts[start][0])
            labels += parts[start][1]
            del parts[start:]
        else:
            text = " ".join(sentence() for _ in range(rng.randint(1, 8)))
            body.append(f"<p>{text}</p>" if rng.random() < 0.8 else f"<p><b>{words(1)}. {text}<br>")
            labels.append(True)
    parts.append((f"<{tag}{attr}>{''.join(body)}</{tag}>", labels))
    for _ in range(rng.randint(1, 4)):
        furniture()
    return "<body>" + "".join(p for p, _ in parts) + "</body>", [x for _, y in parts for x in y]


class Crf:
    """Weights of features by label, of label pairs and of the first label; label 1 is main."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.emit = np.zeros((len(names), 2))
        self.pair = np.zeros((2, 2))
        self.first = np.zeros(2)

    def scores(self, blocks: list[list[int]]) -> np.ndarray:
        return np.array([self.emit[f].sum(axis=0) for f in blocks])

    def train(self, pages: list[tuple[list[list[int]], np.ndarray]], epochs: int = EPOCHS,
              rate: float = 0.1, decay: float = 1e-4) -> None:
        """Stochastic ascent with per-weight steps (Adagrad)."""
        params = (self.emit, self.pair, self.first)
        seen = [np.full_like(p, 1e-8) for p in params]
        rng = np.random.default_rng(3)
        for _ in range(epochs):
            for k in rng.permutation(len(pages)):
                blocks, gold = pages[k]
                one, two = self.marginals(self.scores(blocks))
                error = np.eye(2)[gold] - one
                step = [np.zeros_like(p) for p in params]
                for f, e in zip(blocks, error, strict=True):
                    np.add.at(step[0], f, e)
                np.add.at(step[1], (gold[:-1], gold[1:]), 1)
                step[1] -= two
                step[2] += error[0]
                for p, g, s in zip(params, step, seen, strict=True):
                    g -= decay * p
                    s += g * g
                    p += rate * g / np.sqrt(s)

    def marginals(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label chances of every block, and expected counts of label pairs."""
        n = len(score)
        ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = score[0] + self.first
        for k in range(1, n):
            ahead[k] = np.logaddexp(*(ahead[k - 1][:, None] + self.pair)) + score[k]
        for k in range(n - 2, -1, -1):
            to = self.pair + score[k + 1] + back[k + 1]
            back[k] = np.logaddexp(to[:, 0], to[:, 1])
        total = np.logaddexp(*ahead[-1])
        pairs = np.zeros((2, 2))
        for k in range(1, n):
            pairs += np.exp(ahead[k - 1][:, None] + self.pair + score[k] + back[k] - total)
        return np.exp(ahead + back - total), pairs

    def decode(self, score: np.ndarray) -> list[int]:
        """The best labels of a page by Viterbi."""
        (aa, ab), (ba, bb) = self.pair.tolist()
        a, b = (score[0] + self.first).tolist()
        came = []
        for x, y in score[1:].tolist():
            from_a, from_b = a + aa >= b + ba, a + ab >= b + bb
            a, b = (a + aa if from_a else b + ba) + x, (a + ab if from_b else b + bb) + y
            came.append((0 if from_a else 1, 0 if from_b else 1))
        label = int(b > a)
        out = [label]
        for step in reversed(came):
            label = step[label]
            out.append(label)
        return out[::-1]

    def main_text(self, page: str) -> str:
        blocks = leaf_blocks(page)
        if not blocks:
            return ""
        get = self.names.get
        known = [[i for i in map(get, block_features(b)) if i is not None] for b in blocks]
        labels = self.decode(self.scores(known))
        return "\n\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def _hidden(features: list[str], rng: random.Random, share: float) -> list[str]:
    """Features without the ancestors, in some of the pages."""
    return [f for f in features if not f.startswith("in:") or rng.random() >= share]


def train_crf(pages: list[str], made_pages: int = MADE_PAGES, seed: int = 11) -> Crf:
    rng = random.Random(seed)
    data: list[tuple[list[list[str]], np.ndarray]] = []
    for page in pages:
        blocks = leaf_blocks(page)
        gold = np.array([is_main(b) for b in blocks], int)
        if gold.any():
            share = rng.choice([0, 0, 0.5])
            data.append(([_hidden(block_features(b), rng, share) for b in blocks], gold))
    for _ in range(made_pages):
        page, labels = made_page(rng)
        blocks = leaf_blocks(page)
        if len(blocks) == len(labels):
            share = rng.choice([0, 0, 0.5])
            data.append(([_hidden(block_features(b), rng, share) for b in blocks],
                         np.array(labels, int)))
    names: dict[str, int] = {}
    for blocks, _ in data:
        for features in blocks:
            for f in features:
                names.setdefault(f, len(names))
    crf = Crf(names)
    crf.train([([[names[f] for f in b] for b in blocks], gold) for blocks, gold in data])
    return crf


def _extract(crf: Crf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                texts = [crf.main_text(p or "") for p in rows["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows["page_id"], rows["url"], pa.array(texts, pa.string()),
                     pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"])
    return run


def main_texts(pages: DataFrame, max_pages: int = MAX_PAGES, made_pages: int = MADE_PAGES
               ) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    named = rows.where(F.length("html").between(1, MAX_PAGE_CHARS)).select(
        F.xxhash64("page_id", "url").alias("h"), "html")
    # hashes first, so that no task sends pages which are not chosen; equal rows count once
    chosen = named.select("h").distinct().orderBy("h").limit(max_pages)
    sample = named.join(F.broadcast(chosen), "h").groupBy("h").agg(
        F.min("html").alias("html")).collect()
    crf = train_crf(sorted(r["html"] for r in sample), made_pages)
    return rows.mapInArrow(_extract(crf), "page_id long, url string, text string, n_chars long")
