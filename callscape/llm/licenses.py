"""Licence scans with a positional rare-token index, in DataFrame operations only.

Base labels come from three phrases whose words stand consecutively. The method adds labels from
licence templates:

1. Each mandatory key phrase of a template is indexed by its rarest word: the one of highest inverse
   document frequency over all documents (of equal ones the first alphabetically).
2. Every occurrence of an index word in a text is met with the postings. An occurrence at word p and
   a posting at word q place the template at p - q; placements named by the index words of all the
   template's phrases survive.
3. At a surviving placement all mandatory key phrases of the template must stand where the template
   has them, and at least ``min_support`` of its words be in place.

Nothing else limits the search: a template that stands in a text has its index words in place, so it
is found whatever other licences or rare words the text holds.

The score is the largest share of a verified template's words that are in place, at least 0.5 when
a base phrase occurs, else 0.

A word is a run of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Null and empty
texts have no words, no labels (an empty string) and score 0. Everything happens in the row, so
neither hot words nor long or repeated texts meet in one task; only document frequencies of the
templates' words, as many rows as there are such words, are counted across documents and reach the
driver. Only doc_id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscape.llm.common import once

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases of the base labels.
PHRASES = (("mit", "mit license"), ("apache", "apache license"),
           ("gpl", "general public license"))

# Label, sentence of the licence, mandatory key phrases.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files", ("permission is hereby granted",
                                                            "free of charge")),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("gpl", "this work is licensed under the gnu general public license version 3",
     ("general public license",)),
    ("lgpl", "licensed under the gnu lesser general public license version 3",
     ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license version 3",
     ("affero general public license",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license version "
            "2 0", ("mozilla public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met",
     ("redistribution and use", "source and binary forms")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with "
            "or without fee is hereby granted", ("for any purpose with or without fee",)),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("free and unencumbered software",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international "
              "license", ("creative commons attribution",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc0", "to the extent possible under law the author has waived all copyright",
     ("waived all copyright",)),
)

VOCABULARY = sorted({w for _, text, _ in TEMPLATES for w in text.split()}
                    | {w for _, text in PHRASES for w in text.split()})


def _words() -> Column:
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower())
    return F.regexp_extract_all(low, F.lit(WORDS), F.lit(0))


def _strings(words: list[str] | tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def word_weights(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each template word over all documents; never seen: the
    largest."""
    seen = docs.select(F.array_intersect(_words(), _strings(VOCABULARY)).alias("seen"))
    rows = seen.select(F.explode(F.concat("seen", F.array(F.lit("")))).alias("word")).groupBy(
        "word").agg(F.count("*").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    total = counts.pop("", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in VOCABULARY}


def _place(words: list[str], phrase: str) -> int:
    """Where the template has the phrase."""
    n = len(phrase.split())
    return next(q for q in range(len(words)) if words[q : q + n] == phrase.split())


def index_places(weights: dict[str, float]) -> list[list[tuple[int, str]]]:
    """For each template, place and word of the rarest word of each key phrase."""
    places = []
    for _, text, phrases in TEMPLATES:
        words = text.split()
        spans = [range(a, a + len(f.split())) for f in phrases for a in [_place(words, f)]]
        rarest = {min(span, key=lambda q: (-weights[words[q]], words[q], q)) for span in spans}
        places.append([(q, words[q]) for q in sorted(rarest)])
    return places


def _postings(places: list[list[tuple[int, str]]]) -> Column:
    """Map from an index word to its (template, position) pairs."""
    found: dict[str, list[Column]] = {}
    for k, indexed in enumerate(places):
        for q, word in indexed:
            found.setdefault(word, []).append(F.struct(F.lit(k).alias("t"), F.lit(q).alias("q")))
    return F.create_map(*[c for w, p in found.items() for c in (F.lit(w), F.array(*p))])


def _stands(at: Column, phrase: str) -> Column:
    """The words of the phrase stand from word ``at`` on."""
    words = phrase.split()
    return (at >= 0) & (F.slice("_w", F.greatest(at + 1, F.lit(1)), len(words)) == _strings(words))


def _phrase_starts(label: str, phrase: str) -> Column:
    first = phrase.split()[0]
    found = F.filter("_hits", lambda x: (x["w"] == first) & _stands(x["i"], phrase))
    return F.transform(found, lambda x: F.struct(x["i"].alias("i"), F.lit(label).alias("label")))


def _verified(place: Column) -> Column:
    """Every key phrase of the placed template stands where the template has it."""
    result = F.lit(False)
    for k, (_, text, phrases) in enumerate(TEMPLATES):
        words = text.split()
        good = F.lit(True)
        for phrase in phrases:
            good = good & _stands(place["p"] + _place(words, phrase), phrase)
        result = F.when(place["t"] == k, good).otherwise(result)
    return result


def _in_place(place: Column) -> Column:
    """Number and share of the placed template's words that are in place."""
    texts = F.array(*[_strings(text.split()) for _, text, _ in TEMPLATES])
    words = F.element_at(texts, place["t"] + 1)
    hits = F.size(F.filter(words, lambda w, q: (place["p"] + q >= 0)
                           & F.coalesce(F.get("_w", place["p"] + q) == w, F.lit(False))))
    return F.struct(place["t"].alias("t"), hits.alias("n"), (hits / F.size(words)).alias("share"))


def license_scan(docs: DataFrame, min_support: int = 2) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score."""
    places = index_places(word_weights(docs))
    df = once(docs.select("doc_id", "text"), _w=_words())
    placed = F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    wanted = {w for indexed in places for _, w in indexed} | {p.split()[0] for _, p in PHRASES}
    df = once(df, _hits=F.filter(placed, lambda x: x["w"].isin(sorted(wanted))))
    starts = [_phrase_starts(label, phrase) for label, phrase in PHRASES]
    postings = _postings(places)
    placements = F.flatten(F.transform("_hits", lambda x: F.transform(
        F.coalesce(postings[x["w"]], F.array().cast("array<struct<t:int,q:int>>")),
        lambda y: F.struct(y["t"].alias("t"), (x["i"] - y["q"]).alias("p")))))
    df = once(df, _base=F.concat(*starts), _places=F.sort_array(placements))
    more = F.array(*[F.lit(len(indexed) - 1) for indexed in places])
    agreed = F.array_distinct(F.filter("_places", lambda x, s: F.coalesce(
        F.get("_places", s + F.element_at(more, x["t"] + 1)) == x, F.lit(False))))
    df = once(df, _good=F.filter(F.transform(F.filter(agreed, _verified), _in_place),
                                 lambda z: z["n"] >= min_support))
    names = _strings([label for label, _, _ in TEMPLATES])
    base = F.col("_base.label")
    found = F.transform("_good", lambda z: F.element_at(names, z["t"] + 1))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.coalesce(F.array_max("_good.share"), F.lit(0.0))
    return df.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min("_base.i").cast("long").alias("first_word"),
        F.array_max("_base.i").cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, found)).alias("labels"),
        F.greatest(best, F.when(F.size("_base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
