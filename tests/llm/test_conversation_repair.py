"""Repairs against a plain search over whole conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest

from callscape.llm.conversation_repair import rank_paths, repair_report

STATE = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLE = {"u": "user", "a": "assistant"}


def spaced(x):
    return " " if x is None else str(x)


def plain_damage(rows):
    for conv, turn, role, text in rows:
        role, text = spaced(role), spaced(text)
        fault = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        for _ in range((1, 2)[fault == 3] if fault else 0):
            yield conv, turn, role, text


def plain_repair(rows):
    """Costs and audits by memoised search for the least (cost, audit) from a row and a state."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else
                      "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    n = len(rows)

    @cache
    def least(i, q, inserted):
        options = [(0, "", ())] if i == n and q in (0, 3) else []
        if inserted < 2:
            new = "ua"[q == 2]
            options.append((2, "I", ((ROLE[new], ""),), (i, STATE[q, new], inserted + 1)))
        if i < n:
            role, text = rows[i][2:]
            options.append((3, "D", (), (i + 1, q, 0)))
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                if (q, role[:1]) in STATE:
                    options.append((late, "K", ((role, text),), (i + 1, STATE[q, role[:1]], 0)))
                new = "ua"[q == 2]
                options.append((2 + late, "R", ((ROLE[new], text),), (i + 1, STATE[q, new], 0)))
        full = [(999, "", ())]
        for cost, letter, kept, *rest in options:
            more = least(*rest[0]) if rest else (0, "", ())
            full.append((cost + more[0], letter + more[1], kept + more[2]))
        return min(full)

    cost, audit, kept = least(0, 0, 0)
    turns = [r[1] for r in rows if r[1] is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"),
            faults.count("duplicate"), faults.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())


def plain(rows):
    convs = defaultdict(list)
    for row in plain_damage(rows):
        convs[row[0]].append(row)
    for group in convs.values():
        group.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    return [(c, *plain_repair(convs[c])) for c in {r[0] for r in rows}]


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def corpus():
    rng = random.Random(8)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "ada"]
    texts = ["Yes.", "No", "Why?", "", None, " \n", "Go!\n", "End of\x00 it", "É", "Wait..."]
    rows = []
    for conv in range(120):
        turn = rng.choice([0, 5, -3])
        for k in range(rng.choice([1, 2, 3, 4, 6, 9, 14])):
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[k % 2]
            text = rng.choice(texts) if rng.random() < 0.5 else f"Word {conv} {k}."
            rows.append((conv, turn if rng.random() < 0.95 else None, role, text))
            turn += rng.choice([1, 1, 1, 2, 7])
    rows += [(500, t, ("user", "assistant")[t % 2], f"Turn {t}" + "." * (t % 7 > 0)) for t in range(150)]
    rows += [(501, t, rng.choice(roles), rng.choice(texts)) for t in range(90)]
    rows += [(502, 3, "user", "Same.")] * 60 + [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho.")]
    rows += [(503, None, None, None), (504, 1, "user", "long " * 50_000 + ".")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", 1) for r in rows],
        "conv_id long, turn long, role string, text string, audit string, seq long")


@pytest.mark.parametrize("chunk", [4, 32, 1024])
def test_repairs_equal_plain_ones(spark, chunk):
    rows = corpus()
    tied = {c for c, t in {(r[0], r[1]) for r in rows} if c != 502
            and sum(x[:2] == (c, t) for x in rows) > 1}  # equal turns: ordered by hash, not by text
    rows = [r for r in rows if r[0] not in tied]
    got = repair_report(frame(spark, rows).repartition(6), chunk)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                           "repaired_sha256"]
    assert order(got.collect()) == order(plain(rows))


def test_equal_turns_do_not_depend_on_partitions(spark):
    rows = [(1, t // 3, ("user", "assistant")[t % 2], f"{t}.") for t in range(30)]
    once, twice = (order(repair_report(frame(spark, rows).repartition(k), c).collect()) for k, c in ((1, 99), (4, 5)))
    assert once == twice and len(once) == 1


def test_lost_and_missing_rows(spark):
    lost = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair_report(frame(spark, [(lost, 0, "user", "Hi.")])).collect()
    assert [tuple(r) for r in got] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair_report(frame(spark, [])).count() == 0


def test_ranks_follow_the_audits():
    rng = np.random.default_rng(1)
    n = 200
    optimal, goal = rng.random((4, n + 1)) < 0.4, rng.integers(1, 4, (4, n + 1)) + np.arange(n + 1)
    optimal[:, n], goal = False, np.minimum(goal, n)

    @cache
    def audit(v):
        return min([bytes([k + 1]) + audit(goal[k, v]) for k in range(4) if optimal[k, v]], default=b"")

    rank, letter, jump = rank_paths(optimal, goal, 256)
    assert len(jump) == 9 and (letter > 0).tolist() == optimal.any(axis=0).tolist()
    names = [audit(v) for v in range(n + 1)]
    assert [sorted(set(names)).index(x) for x in names] == rank.tolist()
