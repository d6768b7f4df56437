"""Conversation structure repair by prefix-doubling path ranking.

A conversation's rows, in the order of turn (nulls first, then role and a digest of the
text), must get role initials `(s?(ua)+)?`. Keep costs nothing, Rerole 1, Delete 2, Insert
of an empty turn 5; a kept or reroled row whose text breaks off costs 5 more; blank rows and
repeats of an earlier role and text must go. The audit is the list of edits by initials; of
the cheapest ones it is the least in ASCII order.

* Rows are aggregated first, so a row that stands there a million times is one row with a
  count; repeats are told by the least turn of each (conversation, role, text).
* A range sort by (conversation, turn, role, digest) spreads conversations of any length. What
  a partition holds of a conversation is a piece; its costs from each state of the pattern to
  each other state are a small matrix, all that is ever brought together of a conversation.
* Back from the end, the matrices give the cost that is still to come at each piece's end.
  With it every piece finds its optimal arcs by dynamic programming and ranks its nodes by the
  least audits of one letter, two, four and so on: the rank of twice the length is that of the
  pair (rank here, rank where that audit leads), and pointers double along. The ranks choose
  an arc at each node, doubled pointers read the path off.
* A piece does so for each state it may be entered in; the exits, followed from the start,
  tell which of them counts.
* A run of rows that must go is one arc of so many `D`: nothing sorts before it, so the
  least audit takes it at once.

Null role or text is one space. A null conv_id is a conversation of its own. Texts are never
cut; columns other than conv_id, turn, role and text are not read. An empty table gives no
rows. The repaired turns come out spread by conversation and in order. A digest over a whole
conversation is sequential by definition: the query reads its turns in a stream, in
constant memory, in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.shared import map_batches, shuffle_partitions, table, written
from lorewell.operators.sizes import broadcast_if_small

# States of the pattern: nothing yet, after s, after u, after a. Accepting: 0 and 3.
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
END = (0, 10, 5, 0)
LETTERS = np.frombuffer(b"DIKR", np.uint8)
KEEP = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
NO_KEEP = (-1, -1, -1, -1)
REROLE = (2, 2, 3, 2)  # also where an insert leads
ROLES = {USER: "user", ASSISTANT: "assistant"}
SPACE = " \t\n\x0b\x0c\r"
ORDER = ("turn", "role", "digest")
BATCH_NODES = 200_000

# A unit is one aggregated row: initial ("" if it must go), breaks off, how often it stands there.
Unit = tuple[str, bool, int]


def damage(rows: DataFrame) -> DataFrame:
    """Rows damaged by a checksum of conv_id and turn: dropped, emptied, cut, repeated, reroled."""
    space = F.lit(" ")
    key = F.concat_ws(
        ":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)
    )
    text, fault = F.coalesce("text", space), F.pmod(F.crc32(key), F.lit(20))
    hurt = rows.select(
        "conv_id", "turn",
        F.when(fault == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 3, 2).otherwise(1).alias("copies"), fault.alias("fault"),
    )
    whole = hurt.filter("fault <> 0")
    return whole.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies", "fault")


def costs_to_go(units: Sequence[Unit], end: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """Least cost from every (unit, state) to the end of the units and on, by `end`."""
    out = [tuple(end)]
    t0, t1, t2, t3 = end
    for initial, broken, n in reversed(units):
        v0, v1, v2, v3 = t0 + 2, t1 + 2, t2 + 2, t3 + 2
        if initial:
            kept = 5 if broken else 0
            to_user, to_assistant = t2 + kept + (initial != "u"), t3 + kept + (initial != "a")
            v0, v1, v3 = min(v0, to_user), min(v1, to_user), min(v3, to_user)
            v2 = min(v2, to_assistant)
            if initial == "s":
                v0 = min(v0, t1 + kept)
        else:
            more = 2 * (n - 1)
            v0, v1, v2, v3 = v0 + more, v1 + more, v2 + more, v3 + more
        t2, t3 = min(v2, v3 + 5), min(v3, v2 + 5)
        t0, t1 = min(v0, t2 + 5), min(v1, t2 + 5)
        out.append((t0, t1, t2, t3))
    out.reverse()
    return out


@dataclass
class Piece:
    """Units of a conversation side by side, the cost still to come, and whether it is the last."""

    units: list[Unit]
    end: Sequence[int]
    last: bool


def least_audits(pieces: Sequence[Piece], entries: Sequence[Sequence[int]]) -> list[list[tuple[str, int]]]:
    """For each piece and each state it is entered in: the least cheapest audit, and the state it ends in."""
    first = np.cumsum([0, *(len(p.units) + 1 for p in pieces)])[:-1]
    targets = _optimal_arcs(pieces)
    runs = np.array([n for p in pieces for n in (*(1 if u[0] else u[2] for u in p.units), 1)], np.int64)
    nodes = np.arange(len(targets))
    optimal = targets >= 0
    # Audits of one letter; an end sorts before every letter and leads to itself.
    letter = np.where(optimal.any(1), optimal.argmax(1), -1)
    pointer = np.where(letter >= 0, targets[nodes, letter], nodes)
    rank = letter + 1
    kinds = 0
    while True:
        # Twice the length: the pair of ranks here and there, renumbered in order.
        pairs = rank * (int(rank.max(initial=0)) + 1) + rank[pointer]
        ordered, rank = np.unique(pairs, return_inverse=True)
        further = pointer[pointer]
        if len(ordered) == kinds and (further == pointer).all():
            break
        kinds, pointer = len(ordered), further
    # Of the optimal arcs of a node the ranks choose the least audit.
    audit = np.where(optimal, np.arange(4) * (len(nodes) + 1) + rank[np.maximum(targets, 0)], FAR)
    best = audit.argmin(1)
    pointer = np.where(optimal.any(1), targets[nodes, best], nodes)
    doubled = [pointer]
    while (doubled[-1] != (further := doubled[-1][doubled[-1]])).any():
        doubled.append(further)
    # Pieces of about one length are read off side by side.
    starts = [(len(p.units), i, 4 * at + s) for i, (p, at, states) in enumerate(zip(pieces, first.tolist(), entries)) for s in states]
    classes: dict[int, list[tuple[int, int]]] = {}
    for n, i, start in starts:
        classes.setdefault(n.bit_length(), []).append((i, start))
    found: dict[int, tuple[str, int]] = {}
    for own in classes.values():
        path = np.array([start for _, start in own])[:, None]
        for jump in doubled:
            path = np.concatenate([path, jump[path]], axis=1)
            if (path[:, -1] == pointer[path[:, -1]]).all():
                break
        steps = optimal[path].any(2)
        counts = np.where(steps, np.where(best[path] == 0, runs[path >> 2], 1), 0)
        letters = np.repeat(LETTERS[best[path]].ravel(), counts.ravel()).tobytes().decode()
        ends = np.cumsum(counts.sum(1)).tolist()
        for (_, start), a, b, last in zip(own, [0, *ends], ends, path[:, -1].tolist()):
            found[start] = letters[a:b], last & 3
    out: list[list[tuple[str, int]]] = [[] for _ in pieces]
    for _, i, start in starts:
        out[i].append(found[start])
    return out


def _optimal_arcs(pieces: Sequence[Piece]) -> np.ndarray:
    """Targets of the optimal arcs of every node by letter, -1 if there is none.

    Nodes are numbered 4 * place + state, the places of all pieces one after the other; a piece
    has one place more than units.
    """
    go = np.array([c for p in pieces for c in costs_to_go(p.units, p.end)], np.int64).reshape(-1, 4)
    units = [u for p in pieces for u in (*p.units, None)]
    place = np.arange(len(units))
    after = np.minimum(place + 1, len(units) - 1)
    ended = np.array([u is None for u in units], bool)
    forced = np.array([u is not None and not u[0] for u in units], bool)
    kept = np.array([5 if u and u[1] else 0 for u in units], np.int64)
    lost = np.array([2 if u and u[0] else 2 * u[2] if u else 0 for u in units], np.int64)
    keep = np.array([KEEP.get(u[0], NO_KEEP) if u else NO_KEEP for u in units], np.int64).reshape(-1, 4)
    # inserts are made before a unit, and after the last unit of a conversation
    open_ = ~ended
    open_[np.cumsum([len(p.units) + 1 for p in pieces])[[p.last for p in pieces]] - 1] = True
    out = np.full((len(units), 4, 4), -1, np.int64)
    for s in range(4):
        to = np.maximum(keep[:, s], 0)
        for letter, cost, state, allowed in (
            (0, lost, s, ~ended),
            (2, kept, to, ~ended & ~forced & (keep[:, s] >= 0)),
            (3, kept + 1, REROLE[s], ~ended & ~forced),
        ):
            fits = allowed & (go[:, s] == cost + go[after, state])
            out[:, s, letter] = np.where(fits, 4 * (place + 1) + state, -1)
        fits = open_ & (go[:, s] == 5 + go[:, REROLE[s]])
        out[:, s, 1] = np.where(fits, 4 * place + REROLE[s], -1)
    return out.reshape(-1, 4)


UNITS = (
    "conv_id bigint, part int, turn bigint, role string, digest binary, n bigint, initial string, broken boolean, "
    "piece struct<blank: bigint, duplicate: bigint, truncated: bigint, illegal: bigint, turns: bigint, "
    "low: bigint, high: bigint, head: string, tail: string, matrix: array<bigint>>"
)
LEGAL = ("su", "ua", "au")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The units of a sorted partition as they are, and after those of a conversation their piece."""
    now, units, part = None, [], 0

    def piece() -> tuple:
        (conv,) = now
        body: list[Unit] = [(u[6], u[7], u[5]) for u in units]
        go = [costs_to_go(body, [0 if s == e else FAR for s in range(4)])[0] for e in range(4)]
        blank = sum(u[5] for u in units if u[8])
        copies = sum(u[5] for u in units)
        firsts = sum(1 for u in units if u[9])
        pairs = [(a[3] + b[3]) for a, b in zip(units, units[1:])]
        illegal = sum(p not in LEGAL for p in pairs) + copies - len(units)
        turns = [u[2] for u in units if u[2] is not None]
        return (
            conv, part, units[0][2], units[0][10], units[0][4], None, None, None,
            {
                "blank": blank, "duplicate": copies - blank - firsts,
                "truncated": sum(1 for u in units if u[9] and u[7]), "illegal": illegal,
                "turns": len(set(turns)), "low": min(turns, default=None), "high": max(turns, default=None),
                "head": units[0][3], "tail": units[-1][3],
                "matrix": [min(go[e][s], FAR) for s in range(4) for e in range(4)],
            },
        )

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            conv, part, turn, role, digest, n, blank, broken, is_first = row
            if now is None or now != (conv,):
                if units:
                    yield piece()
                now, units = (conv,), []
            chosen = is_first and not blank
            head = role[:1]
            if chosen:
                # the first of them has a choice, the others must go
                units.append((conv, part, turn, head, digest, 1, head or "?", broken, False, True, role))
                yield conv, part, turn, role, digest, 1, head or "?", broken, None
                n -= 1
            if n:
                units.append((conv, part, turn, head, digest, n, "", False, blank, False, role))
                yield conv, part, turn, role, digest, n, "", False, None
    if units:
        yield piece()


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Costs to come at the end of each piece of a conversation, and the sums over its pieces."""
    for batch in batches:
        for conv, pieces in zip(*(c.to_pylist() for c in batch.columns)):
            pieces.sort(key=lambda p: p["part"])
            ends, end = [], list(END)
            for p in reversed(pieces):
                ends.append(end)
                m = p["piece"]["matrix"]
                end = [min(m[4 * s + e] + end[e] for e in range(4)) for s in range(4)]
            ends.reverse()
            own = [p["piece"] for p in pieces]
            sums = {c: sum(p[c] for p in own) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
            high = None
            for before, p in zip([None, *own], own):
                sums["illegal"] += before is not None and before["tail"] + p["head"] not in LEGAL
                sums["turns"] -= high is not None and p["low"] == high  # one turn on both sides of a border
                high = p["high"] if p["high"] is not None else high
            low = min((p["low"] for p in own if p["low"] is not None), default=None)
            gaps = 0 if low is None else high - low + 1 - sums["turns"]
            report = gaps, sums["blank"], sums["duplicate"], sums["truncated"], sums["illegal"], end[START]
            for i, (p, after) in enumerate(zip(pieces, ends)):
                yield conv, p["part"], after, i, i + 1 == len(pieces), *report


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Audits of the pieces, each opened by the row that tells its end, for the states it may be entered in."""
    held: list[tuple] = []
    size = 0

    def flush() -> Iterator[tuple]:
        entries = [(START,) if h[2] else range(4) for h in held]
        for (conv, part, _, key, _), found in zip(held, least_audits([h[4] for h in held], entries)):
            yield conv, part, *key, [a for a, _ in found], [s for _, s in found]

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            conv, part, mark, turn, role, digest, n, initial, broken, end, number, last = row
            if mark == 0:
                if size >= BATCH_NODES:
                    yield from flush()
                    held, size = [], 0
                held.append((conv, part, number == 0, [turn, role, digest], Piece([], end, last)))
            else:
                held[-1][4].units.append((initial, broken, n))
            size += 4
    if held:
        yield from flush()


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The state in which each piece of a conversation is entered."""
    for batch in batches:
        for conv, pieces in zip(*(c.to_pylist() for c in batch.columns)):
            state = START
            for p in sorted(pieces, key=lambda p: p["part"]):
                yield conv, p["part"], state
                state = p["exits"][state if len(p["exits"]) > 1 else 0]


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Repaired turns, from audits, units and texts in the order of the conversation."""
    now, state, place, audit, at, held = None, START, 0, "", 0, None

    def inserts() -> Iterator[tuple]:
        nonlocal state, place, at
        while audit[at : at + 1] == "I":
            state, place, at = REROLE[state], place + 1, at + 1
            yield now[0], place, "I", ROLES[state], ""

    for batch in batches:
        for conv, mark, role, n, initial, text in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now != (conv,):
                if now:
                    yield from inserts()
                now, state, place, audit, at, held = (conv,), START, 0, "", 0, None
            if mark == 0:
                audit, at = text, 0
            elif mark == 1:
                if initial:
                    yield from inserts()
                    held = audit[at]
                    at += 1
                else:
                    at += n
            elif held:
                edit, held = held, None
                if edit != "D":
                    state = KEEP[role[:1]][state] if edit == "K" else REROLE[state]
                    place += 1
                    yield conv, place, edit, role if edit == "K" else ROLES[state], text
    if now:
        yield from inserts()


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Equal in all columns, nulls too."""
    out = F.lit(True)
    for c in names:
        out = out & left[c].eqNullSafe(right[c])
    return out


@dataclass(frozen=True)
class Repair:
    """turns (conv_id, place, edit, role, text; in order inside each partition) and one report a conversation."""

    turns: DataFrame
    report: DataFrame


def repair_conversations(rows: DataFrame) -> Repair:
    """Repaired turns and, for each conversation that has rows, its faults, cost and audit."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    body = F.rtrim("text", F.lit(SPACE))
    spoken = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    texts = written(
        spoken.groupBy("conv_id", *ORDER).agg(F.count("*").alias("n"), F.min("text").alias("text"))
        .withColumns({"blank": body == "", "broken": ~F.right(body, F.lit(1)).isin(".", "!", "?")}),
        "texts",
    )
    slim = texts.select("conv_id", *ORDER, "n", "blank", "broken", F.lit(False).alias("first"))
    firsts = (
        texts.filter("not blank").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("t"))
        .select("conv_id", "t.turn", "role", "digest", F.lit(0).cast("bigint").alias("n"),
                F.lit(False).alias("blank"), F.lit(False).alias("broken"), F.lit(True).alias("first"))
    )
    marked = slim.unionByName(firsts).groupBy("conv_id", *ORDER).agg(
        F.sum("n").alias("n"), F.max("blank").alias("blank"), F.max("broken").alias("broken"),
        F.max("first").alias("first"),
    )
    parts = shuffle_partitions(rows)
    ranged = marked.repartitionByRange(parts, "conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    placed = ranged.select(
        "conv_id", F.spark_partition_id().alias("part"), *ORDER, "n", "blank", "broken", "first"
    )
    units = written(map_batches(placed, _pieces, UNITS), "units")

    def by_conversation(pieces: DataFrame, *columns: str) -> DataFrame:
        """All pieces of a conversation in a row: one for each range partition at most."""
        return pieces.groupBy("conv_id").agg(F.collect_list(F.struct(*columns)).alias("pieces"))

    pieces = by_conversation(units.filter("piece is not null"), "part", "piece")
    ends = written(
        map_batches(
            pieces, _chained,
            "conv_id bigint, part int, end array<bigint>, number int, last boolean, gaps bigint, blank bigint, "
            "duplicate bigint, truncated bigint, illegal bigint, cost bigint",
        ),
        "ends",
    )
    body_rows = units.filter("piece is null").select(
        "conv_id", "part", F.lit(1).alias("mark"), *ORDER, "n", "initial", "broken",
        F.lit(None).cast("array<bigint>").alias("end"), F.lit(None).cast("int").alias("number"),
        F.lit(None).cast("boolean").alias("last"),
    )
    # the row of a piece carries the key of its first unit
    heads = units.filter("piece is not null").select("conv_id", "part", *ORDER)
    openings = heads.join(ends, _same(heads, ends, ("conv_id", "part"))).select(
        heads["conv_id"], heads["part"], F.lit(0).alias("mark"), *ORDER, F.lit(None).cast("bigint").alias("n"),
        F.lit(None).cast("string").alias("initial"), F.lit(None).cast("boolean").alias("broken"),
        "end", "number", "last",
    )
    spread = body_rows.unionByName(openings).repartition(parts, "conv_id", "part")
    audited = written(
        map_batches(
            spread.sortWithinPartitions("conv_id", "part", "mark", *ORDER, F.desc("initial")), _audited,
            "conv_id bigint, part int, turn bigint, role string, digest binary, audits array<string>, exits array<int>",
        ),
        "audits",
    )
    # only conversations of several pieces can be entered in another state than the first
    several = audited.join(
        ends.filter("not last or number > 0").select(F.col("conv_id").alias("c"), F.col("part").alias("p")),
        F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left_semi",
    )
    entered = broadcast_if_small(
        written(
            map_batches(
                by_conversation(several, "part", "exits"), _entered, "conv_id bigint, part int, state int"
            ),
            "entered",
        )
    )
    # a first piece holds the audit from the start only
    joined = audited.join(entered, _same(audited, entered, ("conv_id", "part")), "left")
    chosen = joined.select(
        audited["conv_id"], audited["part"], *ORDER,
        F.when(F.size("audits") == 1, F.get("audits", F.lit(0))).otherwise(F.get("audits", F.col("state"))).alias("audit"),
    )
    stream = (
        chosen.select("conv_id", F.lit(0).alias("mark"), *ORDER, F.lit(None).cast("bigint").alias("n"),
                      F.lit(None).cast("string").alias("initial"), F.col("audit").alias("text"))
        .unionByName(units.filter("piece is null").select(
            "conv_id", F.lit(1).alias("mark"), *ORDER, "n", "initial", F.lit(None).cast("string").alias("text")))
        .unionByName(texts.filter("not blank").select(
            "conv_id", F.lit(2).alias("mark"), *ORDER, "n", F.lit(None).cast("string").alias("initial"), "text"))
    )
    # a unit that has a choice comes before the rest of its row, which is shorter by one letter
    ordered = stream.repartition(parts, "conv_id").sortWithinPartitions(
        "conv_id", *ORDER, "mark", F.desc("initial")
    )
    turns = map_batches(
        ordered.select("conv_id", "mark", "role", "n", "initial", "text"), _edited,
        "conv_id bigint, place bigint, edit string, role string, text string",
    )
    parts_of = F.array_sort(F.collect_list(F.struct("part", "audit")))
    audits = chosen.groupBy("conv_id").agg(F.array_join(F.transform(parts_of, lambda p: p["audit"]), "").alias("audit"))
    sums = ends.filter("last").drop("part", "end", "number", "last")
    report = sums.join(audits, _same(sums, audits, ("conv_id",))).select(
        sums["conv_id"], "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"
    )
    return Repair(turns, report)


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Digest of the lines `role:text` of each conversation; `turns` as repair_conversations gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, digest = None, hashlib.sha256()
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now != (conv,):
                    if now:
                        yield *now, digest.hexdigest()
                    now, digest = (conv,), hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if now:
            yield *now, digest.hexdigest()

    return map_batches(turns.select("conv_id", "role", "text"), run, "conv_id bigint, repaired_sha256 string")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    repair = repair_conversations(damage(rows))
    every = rows.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    report, digests = repair.report, conversation_digests(repair.turns)
    joined = every.join(report, _same(every, report, ("conv_id",)), "left")
    joined = joined.join(digests, every["conv_id"].eqNullSafe(digests["conv_id"]), "left")
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
            for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select(
        every["conv_id"], *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )


def _add(state: str, cost: int, letter: str, line: str) -> str:
    """SQL: a state (cost and audit as one sortable text; repaired lines) after one more edit."""
    spent = f"lpad(CAST(CAST(left({state}.k, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0')"
    return f"{{'k': {spent} || substr({state}.k, 10) || '{letter}', 't': {state}.t || {line}}}"


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


_USER, _ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
_SAID = "chr(10) || role || ':' || text"


def _keep(to: str, initial: str, *states: str) -> list[str]:
    line = {"u": f"{_USER} || text", "a": f"{_ASSISTANT} || text"}.get(to)
    out = []
    for s in states:
        moves = [_add(s, 0, "K", _SAID)] if initial else []
        cost = "CASE WHEN fault = 't' THEN 5 ELSE 0 END"
        if moves:
            kept = f"{{'k': lpad(CAST(CAST(left({s}.k, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({s}.k, 10) || 'K', 't': {s}.t || {_SAID}}}"
            out.append(f"CASE WHEN left(role, 1) = '{initial}' AND fault IN ('', 't') THEN {kept} ELSE far END")
        if line:
            moved = f"{{'k': lpad(CAST(CAST(left({s}.k, 9) AS BIGINT) + 1 + {cost} AS VARCHAR), 9, '0') || substr({s}.k, 10) || 'R', 't': {s}.t || {line}}}"
            out.append(f"CASE WHEN fault IN ('', 't') THEN {moved} ELSE far END")
    return out


_CRC_BIT = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
_CRC = f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  list_transform(string_split(key, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, j: {_CRC_BIT})), 4294967295)"""
OP13_SQL = f"""WITH RECURSIVE
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations),
hit AS (SELECT *, {_CRC} % 20 AS d FROM src),
hurt AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE d <> 0),
placed AS (
  SELECT *, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM hurt),
row_ AS (
  SELECT conv_id, turn, role, text, i, CASE
      WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM placed),
dp AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'k': '000000000', 't': ''}} AS s0,
    {{'k': '900000000', 't': ''}} AS s1, {{'k': '900000000', 't': ''}} AS s2, {{'k': '900000000', 't': ''}} AS s3
  FROM row_
  UNION ALL
  SELECT conv_id, i, {_add("s0", 2, "D", "''")} AS s0,
    {_least(_add("s1", 2, "D", "''"), *_keep("", "s", "s0"))} AS s1,
    {_least(_add("c2", 2, "D", "''"), *_keep("u", "u", "s0", "s1", "c3"))} AS s2,
    {_least(_add("c3", 2, "D", "''"), *_keep("a", "a", "c2"))} AS s3
  FROM (
    SELECT *, {_least("s3", _add("c2", 5, "I", _ASSISTANT))} AS c3 FROM (
      SELECT dp.conv_id, row_.i, role, text, fault, s0, s1, s3, {{'k': '900000000', 't': ''}} AS far,
        {_least("s2", _add("s0", 5, "I", _USER), _add("s1", 5, "I", _USER), _add("s3", 5, "I", _USER))} AS c2
      FROM dp JOIN row_ ON row_.conv_id IS NOT DISTINCT FROM dp.conv_id AND row_.i = dp.i + 1))),
final AS (
  SELECT conv_id, {_least("s0", "s3", _add("c2", 5, "I", _ASSISTANT))} AS s FROM (
    SELECT *, {_least("s2", _add("s0", 5, "I", _USER), _add("s1", 5, "I", _USER), _add("s3", 5, "I", _USER))} AS c2
    FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM row_ GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(left(s.k, 9) AS BIGINT), 0) AS cost, coalesce(substr(s.k, 10), '') AS audit,
  sha256(coalesce(substr(s.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN final ON final.conv_id IS NOT DISTINCT FROM c.conv_id"""
