"""Structure repair of conversations: cheapest edits, and of these the least audit.

A repaired conversation has the roles ``(s?(ua)+)?`` by their initials. Edits are Keep (0), Rerole to
user or assistant (2), Delete (3; blank and duplicate rows must go) and Insert of an empty user or
assistant row (2); a truncated row that stays adds 1. The audit is the edits' initials in order.

A node is a row and a state of the role pattern: nothing yet, after s, after u, after a. A cost DP from
the last row back leaves the optimal arcs. The audits of all nodes are then ranked by prefix doubling:
ranks of audits of length 1, 2, 4, ... come from sorting pairs of ranks, the second found through a
pointer that has doubled as often. Letters and ranks choose each node's arc, doubled pointers spell the
path. An initial determines the node that its arc leads to, so arcs of one node never tie.

Rows are range-partitioned by conversation and turn, so a conversation of any size is spread over
tasks, and repeated rows are spread by their place in the file. A task works through its rows in
order. A conversation of at most ``CHUNK`` rows that lies inside a task ends there. Others are cut
into chunks: a chunk is a matrix of costs from state to state; costs at chunk ends follow from a walk
over the matrices, audits per entry state from the chunk alone, and the final walk over the chunks
picks the states and feeds the digest. The walks hold one chunk at a time. (A digest of a whole
conversation has to see its bytes in order, in one task.)

Nulls in role and text count as one space, a null turn comes first and has no part in the gaps, and
rows without conv_id are one conversation. Rows of equal turn are ordered by role and a hash of role
and text; they are adjacent if equal. A role without characters fits nowhere. Conversations without
rows after the damage are empty. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscape.llm.common import SPACE, stored
from callscape.scale import lookup_join

CHUNK = 1024
FAULTS = 20  # of which the first five damage a row
_NEVER = 1 << 40
_DELETE, _INSERT, _KEEP, _REROLE = range(1, 5)
_LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
_S, _U, _A, _OTHER = range(4)
_NEXT = np.array([2, 2, 3, 2])  # state after an inserted or changed role
_AFTER = np.full((4, 4), -1)  # state after keeping a role
_AFTER[0, _S], _AFTER[0, _U], _AFTER[1, _U], _AFTER[2, _A], _AFTER[3, _U] = 1, 2, 2, 3, 2
_GOOD_END = np.array([0, _NEVER, _NEVER, 0])
_END = np.array([0, 4, 2, 0])  # cost from each state when no row is left
_EMPTY = hashlib.sha256(b"").hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """Known damage, by the checksum of ``conv_id:turn``: lost, emptied, unpunctuated, repeated and
    misattributed rows."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % FAULTS
    text = F.when(fault == 1, F.lit("")).when(
        fault == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    return conversations.where(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(part("role")).alias("role"),
        text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1)))
        .alias("copy")).drop("copy")


def _moment() -> Column:
    return F.struct(F.col("turn").isNotNull(), F.col("turn"))


def marked(rows: DataFrame) -> DataFrame:
    """Rows with what the walk needs: a hash of role and text, whether the text is blank or lacks its
    end, and whether role and text occurred at an earlier turn."""
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    keyed = rows.select(
        F.col("conv_id").isNotNull().alias("known"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("cid"),
        F.col("turn").cast("long").alias("turn"), "role", "text",
        F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(1), "role", "text").alias("k2"),
        (F.rtrim("text", F.lit(SPACE)) == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    key = ["known", "cid", "k1", "k2"]
    often = stored(
        keyed.groupBy(*key).agg(F.min(_moment()).alias("first"), F.max(_moment()).alias("final"))
        .where("first < final").drop("final"), "often")
    return lookup_join(keyed, often, key, "left").withColumn(
        "again", F.coalesce(_moment() > F.col("first"), F.lit(False))).drop("first")


def _solve(kinds, bad, cut, lengths, tails, ends):
    """Cost DP over many runs of rows side by side, padded to one length.

    ``kinds``, ``bad`` and ``cut`` are (runs, rows); ``tails`` the costs after the last row for each
    state; ``ends`` tells where the conversation ends there. Returns the cost of every node, which of
    its arcs (by letter) are optimal, and the nodes that they lead to.
    """
    runs, rows = kinds.shape
    cost = np.zeros((runs, rows + 1, 4), np.int64)
    node = np.arange(runs * (rows + 1) * 4).reshape(runs, rows + 1, 4)
    optimal = np.zeros((4, runs, rows + 1, 4), bool)
    goal = np.broadcast_to(node, (4, *node.shape)).copy()
    for i in range(rows, -1, -1):
        arcs = np.full((4, runs, 4), _NEVER)
        at_end = lengths <= i
        if i < rows:
            below, under, stay = cost[:, i + 1], node[:, i + 1], ~bad[:, i, None]
            late = cut[:, i, None].astype(np.int64)
            kept = _AFTER[:, kinds[:, i]].T
            arcs[_DELETE - 1] = 3 + below
            arcs[_KEEP - 1] = np.where(
                stay & (kept >= 0), late + np.take_along_axis(below, kept, 1), _NEVER)
            arcs[_REROLE - 1] = np.where(stay, 2 + late + below[:, _NEXT], _NEVER)
            arcs[:, at_end] = _NEVER
            goal[_DELETE - 1, :, i] = under
            goal[_KEEP - 1, :, i] = np.take_along_axis(under, np.maximum(kept, 0), 1)
            goal[_REROLE - 1, :, i] = under[:, _NEXT]
        goal[_INSERT - 1, :, i] = node[:, i][:, _NEXT]
        here = np.where(at_end[:, None], tails, arcs.min(axis=0))
        # two inserted rows lead back to the same state, so one after the other never pays twice
        new = np.where((~at_end | ends)[:, None], 2, _NEVER)
        pair = np.minimum(here[:, [2, 3]], new + here[:, [3, 2]])
        arcs[_INSERT - 1] = new + pair[:, _NEXT - 2]
        cost[:, i] = np.minimum(here, arcs[_INSERT - 1])
        stop = at_end[:, None] & (cost[:, i] == tails)
        optimal[:, :, i] = (arcs == cost[:, i]) & (cost[:, i] < _NEVER) & ~stop
    return cost, optimal.reshape(4, -1), goal.reshape(4, -1)


def rank_paths(optimal: np.ndarray, goal: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ranks of the least audits that start at each node, its first letter, and pointers over 1, 2,
    4, ... edits, until ``longest`` edits are covered. Arcs are (letter, node); nodes without one
    point to themselves."""
    n = goal.shape[1]
    letter = np.where(optimal.any(axis=0), optimal.argmax(axis=0) + 1, 0)
    step = np.where(letter > 0, goal[letter - 1, np.arange(n)], np.arange(n))
    rank, jump, reach = letter, [step], 1
    while reach < longest:
        pairs = rank * (int(rank.max(initial=0)) + 1) + rank[jump[-1]]
        rank = np.unique(pairs, return_inverse=True)[1].reshape(-1)
        jump.append(jump[-1][jump[-1]])
        reach *= 2
    # of each node's optimal arcs the one whose letter and further audit rank least
    order = np.where(optimal, np.arange(1, 5)[:, None] * (n + 1) + rank[goal], 5 * (n + 1)).argmin(axis=0)
    if (np.where(letter > 0, goal[order, np.arange(n)], np.arange(n)) != step).any():
        raise AssertionError("two optimal arcs of a node share a letter")
    return rank, letter, jump


def _paths(starts: np.ndarray, letter: np.ndarray, jump: list[np.ndarray]) -> np.ndarray:
    """Nodes of the least path from each start, spelled by the doubled pointers."""
    nodes = starts[:, None]
    for step in reversed(jump):
        nodes = np.stack([nodes, step[nodes]], axis=-1).reshape(len(starts), -1)
    return nodes


def _walk(kinds, bad, cut, lengths, tails, ends, entries):
    """Cost, audit, exit state and edited (row, state) pairs for each run and entry state."""
    runs, rows = kinds.shape
    cost, optimal, goal = _solve(kinds, bad, cut, lengths, tails, ends)
    _, letter, jump = rank_paths(optimal, goal, 2 * rows + 4)
    starts = (np.arange(runs)[:, None] * (rows + 1) * 4 + np.asarray(entries)).ravel()
    nodes = _paths(starts, letter, jump)
    edits = letter[nodes]
    return cost[:, 0][:, entries].ravel(), edits, (nodes // 4) % (rows + 1), nodes % 4


def _padded(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, fill) -> np.ndarray:
    out = np.full((len(starts), width), fill, values.dtype)
    inside = np.arange(width) < lengths[:, None]
    out[inside] = values[(starts[:, None] + np.arange(width))[inside]]
    return out


def _audit(edits: np.ndarray) -> str:
    return _LETTERS[edits[edits > 0]].tobytes().decode()


def _repaired(edits, rows, states, roles, texts) -> Iterator[str]:
    for edit, row, state in zip(edits.tolist(), rows.tolist(), states.tolist(), strict=True):
        if edit == _KEEP:
            yield f"{roles[row]}:{texts[row]}"
        elif edit in (_INSERT, _REROLE):
            role = "assistant" if state == 2 else "user"
            yield f"{role}:" if edit == _INSERT else f"{role}:{texts[row]}"


_KINDS = {"s": _S, "u": _U, "a": _A}
_FITS = np.zeros((4, 4), bool)
_FITS[_S, _U] = _FITS[_U, _A] = _FITS[_A, _U] = True


def _facts(table: pa.Table, starts, lengths, previous=None):
    """Kinds, faults and counts of runs of ordered rows. ``previous`` has turn, hashes, role kind and
    existence of the row before each run, where a run goes on from another task's rows."""
    n = table.num_rows
    turn = table.column("turn").combine_chunks()
    timed = np.asarray(turn.is_valid())
    turn = turn.fill_null(0).to_numpy()
    k1, k2 = (table.column(c).to_numpy() for c in ("k1", "k2"))
    kinds = np.array([_KINDS.get(r[:1], _OTHER) for r in table.column("role").to_pylist()], np.int64)
    flag = {c: np.asarray(table.column(c).combine_chunks().to_numpy(zero_copy_only=False), bool)
            for c in ("blank", "cut", "again")}
    before = {"turn": np.roll(turn, 1), "timed": np.roll(timed, 1), "k1": np.roll(k1, 1),
              "k2": np.roll(k2, 1), "kind": np.roll(kinds, 1), "has": np.ones(n, bool)}
    before["has"][starts] = False
    if previous is not None:
        for name, values in previous.items():
            before[name][starts] = values
    same_turn = before["has"] & (before["timed"] == timed) & (before["turn"] == turn)
    same = same_turn & (before["k1"] == k1) & (before["k2"] == k2)
    copied = ~flag["blank"] & (flag["again"] | same)
    cut = ~flag["blank"] & ~copied & flag["cut"]
    counts = {
        "blank": flag["blank"], "duplicate": copied, "truncated": cut,
        "illegal": before["has"] & ~_FITS[before["kind"], kinds],
        "turns": timed & ~(same_turn & before["timed"])}
    edges = np.stack([starts, starts + lengths], axis=1).ravel()
    each = lambda f, v: f.reduceat(np.append(v, v[-1:]), edges)[::2]
    sums = {c: each(np.add, v.astype(np.int64)) for c, v in counts.items()}
    big = np.iinfo(np.int64)
    sums["low"] = each(np.minimum, np.where(timed, turn, big.max))
    sums["high"] = each(np.maximum, np.where(timed, turn, big.min))
    return kinds, flag["blank"] | copied, cut, sums


_COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns", "low", "high"]
_ROW = "role text turn k1 k2 blank cut again".split()
_OUT = pa.schema([
    ("known", pa.bool_()), ("cid", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()),
    *[(c, pa.int64()) for c in _COUNTS], ("cost", pa.int64()), ("audit", pa.string()),
    ("repaired_sha256", pa.string()),
    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("turn", pa.list_(pa.int64())),
    ("k1", pa.list_(pa.int64())), ("k2", pa.list_(pa.int64())), ("fblank", pa.list_(pa.bool_())),
    ("fcut", pa.list_(pa.bool_())), ("fagain", pa.list_(pa.bool_()))])
_OUT_SQL = ("known boolean, cid long, part int, seq long, " + ", ".join(f"{c} long" for c in _COUNTS) +
            ", cost long, audit string, repaired_sha256 string, roles array<string>, texts array<string>, "
            "turn array<long>, k1 array<long>, k2 array<long>, fblank array<boolean>, "
            "fcut array<boolean>, fagain array<boolean>")


def _closed(table: pa.Table, starts: np.ndarray, lengths: np.ndarray) -> Iterator[dict]:
    """Finished rows of whole conversations."""
    kinds, bad, cut, sums = _facts(table, starts, lengths)
    known, cid = (table.column(c).to_pylist() for c in ("known", "cid"))
    roles, texts = (table.column(c).to_pylist() for c in ("role", "text"))
    width = 1
    while width < 2 * lengths.max(initial=1):
        mine = np.flatnonzero((lengths > width // 2) & (lengths <= width))
        if len(mine):
            first, size = starts[mine], lengths[mine]
            cost, edits, rows, states = _walk(
                _padded(kinds, first, size, width, _OTHER), _padded(bad, first, size, width, True),
                _padded(cut, first, size, width, False), size,
                np.broadcast_to(_GOOD_END, (len(mine), 4)), np.ones(len(mine), bool), [0])
            for k, run in enumerate(mine.tolist()):
                a = int(starts[run])
                b = a + int(lengths[run])
                lines = _repaired(edits[k], rows[k], states[k], roles[a:b], texts[a:b])
                yield {"known": known[a], "cid": cid[a], "cost": int(cost[k]), "audit": _audit(edits[k]),
                       "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
                       **{c: int(v[run]) for c, v in sums.items()}}
        width *= 2


def _split(chunk: int):
    """Walks a task's ordered rows: finished conversations, and chunks of those that are too long or
    that touch the task's ends."""

    def open_chunk(table: pa.Table, part: int, seq: int) -> dict:
        lists = {c: table.column(c).to_pylist() for c in _ROW}
        return {"known": table.column("known")[0].as_py(), "cid": table.column("cid")[0].as_py(),
                "part": part, "seq": seq, "roles": lists["role"], "texts": lists["text"],
                "turn": lists["turn"], "k1": lists["k1"], "k2": lists["k2"], "fblank": lists["blank"],
                "fcut": lists["cut"], "fagain": lists["again"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, seq, open_run, part = None, 0, True, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            table = pa.Table.from_batches([batch])
            table = table if carry is None else pa.concat_tables([carry, table])
            known, cid = (table.column(c).to_numpy() for c in ("known", "cid"))
            edge = np.flatnonzero((known[1:] != known[:-1]) | (cid[1:] != cid[:-1])) + 1
            starts = np.concatenate([[0], edge])
            stops = np.concatenate([edge, [table.num_rows]])
            out, whole = [], []
            for a, b in zip(starts[:-1].tolist(), stops[:-1].tolist(), strict=True):
                if open_run or b - a > chunk:
                    for at in range(a, b, chunk):
                        out.append(open_chunk(table.slice(at, min(chunk, b - at)), part, seq))
                        seq += 1
                else:
                    whole.append((a, b))
                open_run = False
            a, n = int(starts[-1]), table.num_rows
            while n - a > chunk:  # of the last run all but one chunk
                out.append(open_chunk(table.slice(a, chunk), part, seq))
                seq, a, open_run = seq + 1, a + chunk, True
            carry = table.slice(a)
            if whole:
                first = np.array([x for x, _ in whole])
                out += _closed(table, first, np.array([y for _, y in whole]) - first)
            yield from _batches(out)
        if carry is not None and carry.num_rows:
            yield from _batches([open_chunk(carry.combine_chunks(), part, seq)])

    return run


def _batches(rows: list[dict], schema: pa.Schema = _OUT) -> Iterator[pa.RecordBatch]:
    if rows:
        yield from pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=1000)


_PREVIOUS = {"turn": "p_turn", "timed": "p_timed", "k1": "p_k1", "k2": "p_k2", "kind": "p_kind", "has": "p_has"}


def _chunk_inputs(row: dict):
    n = len(row["roles"])
    names = {"role": "roles", "blank": "fblank", "cut": "fcut", "again": "fagain"}
    types = {"turn": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "role": pa.string()}
    table = pa.table({c: pa.array(row[names.get(c, c)], types.get(c, pa.bool_()))
                      for c in _ROW if c != "text"})
    previous = {c: row[p] or 0 for c, p in _PREVIOUS.items()}
    kinds, bad, cut, sums = _facts(table, np.array([0]), np.array([n]), previous)
    return n, kinds[None], bad[None], cut[None], {c: int(v[0]) for c, v in sums.items()}


_SUMMARY = pa.schema([("known", pa.bool_()), ("cid", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()),
                      *[(c, pa.int64()) for c in _COUNTS], ("matrix", pa.list_(pa.int64()))])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a chunk, and its costs from entry to exit state, exit by exit."""
    tails = np.where(np.eye(4, dtype=bool), 0, _NEVER)
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            n, kinds, bad, cut, sums = _chunk_inputs(row)
            cost, _, _ = _solve(*(np.repeat(x, 4, axis=0) for x in (kinds, bad, cut)), np.full(4, n),
                                tails, np.zeros(4, bool))
            out.append({"known": row["known"], "cid": row["cid"], "part": row["part"], "seq": row["seq"],
                        **sums, "matrix": np.minimum(cost[:, 0], _NEVER).ravel().tolist()})
        yield from _batches(out, _SUMMARY)


_TAILS = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("tail", pa.list_(pa.int64())), ("ends", pa.bool_())])


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs after each chunk, from the last chunk of a conversation back."""
    last, tail = None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            name = row["known"], row["cid"]
            if name != last:
                last, tail = name, _END
                ends = True
            else:
                ends = False
            out.append({"part": row["part"], "seq": row["seq"], "tail": tail.tolist(), "ends": ends})
            matrix = np.array(row["matrix"]).reshape(4, 4)  # exit, entry
            tail = np.minimum((matrix + tail[:, None]).min(axis=0), _NEVER)
        yield from _batches(out, _TAILS)


_SOLVED = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("costs", pa.list_(pa.int64())),
                     ("edits", pa.list_(pa.binary())), ("rows", pa.list_(pa.binary())),
                     ("states", pa.list_(pa.binary())), ("exits", pa.list_(pa.int32()))])


def _solutions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least path through a chunk from each entry state."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            n, kinds, bad, cut, _ = _chunk_inputs(row)
            tail = _GOOD_END if row["ends"] else np.array(row["tail"])
            cost, edits, rows, states = _walk(kinds, bad, cut, np.array([n]), tail[None],
                                              np.array([row["ends"]]), [0, 1, 2, 3])
            used = [e > 0 for e in edits]
            out.append({
                "part": row["part"], "seq": row["seq"], "costs": cost.tolist(),
                "edits": [e[u].astype(np.uint8).tobytes() for e, u in zip(edits, used, strict=True)],
                "rows": [r[u].astype("<u2").tobytes() for r, u in zip(rows, used, strict=True)],
                "states": [s[u].astype(np.uint8).tobytes() for s, u in zip(states, used, strict=True)],
                "exits": states[:, -1].tolist()})
        yield from _batches(out, _SOLVED)


_DONE = pa.schema([("known", pa.bool_()), ("cid", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
                   ("repaired_sha256", pa.string())])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks the chunks of each conversation in order, following the states and feeding the digest."""
    name, state, cost, audit, digest, empty = None, 0, 0, [], None, True

    def done():
        return {"known": name[0], "cid": name[1], "cost": cost, "audit": "".join(audit),
                "repaired_sha256": digest.hexdigest()}

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if (row["known"], row["cid"]) != name:
                if name is not None:
                    out.append(done())
                name, state, audit, digest, empty = (row["known"], row["cid"]), 0, [], hashlib.sha256(), True
                cost = row["costs"][0]
            edits = np.frombuffer(row["edits"][state], np.uint8)
            audit.append(_audit(edits))
            for line in _repaired(edits, np.frombuffer(row["rows"][state], "<u2"),
                                  np.frombuffer(row["states"][state], np.uint8), row["roles"], row["texts"]):
                digest.update(("" if empty else "\n").encode() + line.encode())
                empty = False
            state = row["exits"][state]
        yield from _batches(out, _DONE)
    if name is not None:
        yield from _batches([done()], _DONE)


def _sql(schema: pa.Schema) -> str:
    names = {pa.bool_(): "boolean", pa.int32(): "int", pa.int64(): "long", pa.string(): "string",
             pa.binary(): "binary"}
    kind = lambda t: f"array<{names[t.value_type]}>" if pa.types.is_list(t) else names[t]
    return ", ".join(f"{f.name} {kind(f.type)}" for f in schema)


def _long_conversations(opened: DataFrame) -> DataFrame:
    """Results of the conversations that were cut into chunks."""
    spot, conv = ["part", "seq"], ["known", "cid"]
    end = lambda c: F.element_at(c, -1)
    kind = F.coalesce(*[F.when(F.left(end("roles"), F.lit(1)) == r, k) for r, k in _KINDS.items()], F.lit(_OTHER))
    line = Window.partitionBy(*conv).orderBy(*spot)
    heads = opened.select(*spot, *conv, end("turn").alias("turn"), end("turn").isNotNull().alias("timed"),
                          end("k1").alias("k1"), end("k2").alias("k2"), kind.alias("kind"), F.lit(True).alias("has"))
    heads = stored(heads.select(*spot, *[
        F.lag(c).over(line).alias(p) for c, p in _PREVIOUS.items()]), "heads")
    facts = stored(opened.drop("texts", *_COUNTS, "cost", "audit", "repaired_sha256").join(heads, spot), "facts")
    summary = stored(facts.mapInArrow(_summaries, _sql(_SUMMARY)), "summary")
    tails = stored(
        summary.select(*conv, *spot, "matrix").repartition(*conv)
        .sortWithinPartitions(*conv, F.desc("part"), F.desc("seq")).mapInArrow(_tails, _sql(_TAILS)), "tails")
    solved = stored(facts.join(tails, spot).mapInArrow(_solutions, _sql(_SOLVED)), "solved")
    final = (
        opened.select(*conv, *spot, "roles", "texts").join(solved, spot).repartition(*conv)
        .sortWithinPartitions(*conv, *spot).mapInArrow(_finish, _sql(_DONE)))
    counts = summary.groupBy(*conv).agg(
        *[F.sum(c).alias(c) for c in _COUNTS[:5]], F.min("low").alias("low"), F.max("high").alias("high"))
    return counts.join(final, conv)


def repair_report(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Faults, cost, audit and digest of the repaired rows of every conversation, after
    :func:`damaged`."""
    conversations = conversations.select("conv_id", "turn", "role", "text")
    rows = marked(damaged(conversations)).withColumn("tie", F.monotonically_increasing_id())
    order = ["known", "cid", F.col("turn").isNotNull(), "turn", "role", "k1", "k2", "tie"]
    walked = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn(
        "part", F.spark_partition_id())
    walked = stored(walked.mapInArrow(_split(chunk), _OUT_SQL), "walked")
    conv, facts = ["known", "cid"], [*_COUNTS, "cost", "audit", "repaired_sha256"]
    whole = walked.where("seq is null").select(*conv, *facts)
    results = whole.unionByName(_long_conversations(walked.where("seq is not null")).select(*conv, *facts))
    names = conversations.select(
        "conv_id", F.col("conv_id").isNotNull().alias("known"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("cid")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    gaps = F.when(F.col("turns") > 0, F.col("high") - F.col("low") + 1 - F.col("turns"))
    return names.join(results, conv, "left").withColumn("gaps", gaps).select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(_EMPTY)).alias("repaired_sha256"))
