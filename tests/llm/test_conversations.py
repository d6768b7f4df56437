"""Conversation repair against a plain search of edits and its SQL."""

import hashlib
import heapq
import random
import zlib

import duckdb
import pytest

from lorewell.llm import conversations as C

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
HARD = "conv_id bigint, turn bigint, role string, text string, n int, part int, digest string, audit string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(SPACE)
        if not body:
            out.append("b")
        elif (role, text) in seen:
            out.append("d")
        else:
            out.append("" if body[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def plain_repair(rows, faults):
    """Cheapest edits first, least audit among equals: a plain search over (row, state)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, "\n".join(lines)
        wanted = "ua"[last == "u"]
        name = {"u": "user", "a": "assistant"}[wanted]
        heapq.heappush(heap, (cost + 5, audit + "I", i, wanted, (*lines, f"{name}:")))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, lines))
            if faults[i] in ("", "t"):
                more = cost + 5 * (faults[i] == "t")
                heapq.heappush(heap, (more + 1, audit + "R", i + 1, wanted, (*lines, f"{name}:{text}")))
                if role[:1] == wanted or (role[:1] == "s" and last == ""):
                    heapq.heappush(heap, (more, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))


def plain(rows):
    out = []
    hurt = plain_damage(rows)
    for conv in {r[0] for r in rows}:
        own = [r for r in hurt if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        faults = faults_of(own)
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        cost, audit, said = plain_repair(own, faults)
        out.append((
            conv, gaps, *(faults.count(x) for x in "bdt"), sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256(said.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def hard_rows():
    draw = random.Random(8)
    texts = ["Yes.", "No", "Why?", "", " \t", "So!  ", "half a", "x.", "日本。", "Hm...", None, "z" * 50_000 + "."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    rows = []
    for conv in range(150):
        for turn in range(draw.randrange(12)):
            place = turn if draw.random() < 0.9 else draw.choice([None, turn + 5, max(turn - 1, 0), -3])
            rows.append((conv, place, draw.choice(roles), draw.choice(texts)))
            if draw.random() < 0.1:
                rows += [rows[-1]] * draw.randrange(4)
    rows += [(1000, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(300)]  # a long one
    rows += [(1001, 0, "user", "again")] * 40 + [(1001, None, "assistant", "again.")] * 40
    rows += [(1002, t, "assistant", "same words.") for t in range(60)]
    rows += [(None, 1, "user", "a."), (None, None, None, None), (None, 1, "assistant", "b.")]
    return rows


@pytest.mark.parametrize("parts", ["3", "64"])
def test_hard_rows(spark, tmp_path, parts):
    rows = hard_rows()
    path = f"{tmp_path}/conversations.parquet"
    wide = [(*r, 1, 2, "d", "a") for r in rows]
    spark.createDataFrame(wide, HARD).repartition(4).write.parquet(path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted((tuple(r) for r in C.op13_conversation_repair(spark, str(tmp_path)).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain(rows)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(db.execute(C.OP13_SQL).fetchall(), key=repr) == got


def test_empty_table(spark):
    none = spark.createDataFrame([], HARD)
    repair = C.repair_conversations(C.damage(none))
    assert repair.report.count() == 0 and C.conversation_digests(repair.turns).count() == 0


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in C.op13_conversation_repair(spark, SF).collect()), key=repr)
    assert got == plain(rows)


def test_pieces_follow_each_other():
    """However a conversation is cut, its pieces make the same audit."""
    draw = random.Random(4)
    for _ in range(200):
        units = []
        for _ in range(draw.randrange(1, 9)):
            kind = draw.choice(["s", "u", "a", "a", "u", "?", ""])
            units.append((kind, bool(kind) and draw.random() < 0.4, 1 if kind else draw.randrange(1, 4)))
        whole = C.costs_to_go(units, C.END)
        wanted = C.least_audits([C.Piece(units, C.END, True)], [(0,)])[0][0]
        cuts = sorted({0, len(units), *(draw.randrange(len(units) + 1) for _ in range(2))})
        state, audit = 0, ""
        for a, b in zip(cuts, cuts[1:]):
            piece = C.Piece(units[a:b], whole[b], b == len(units))
            (found,) = C.least_audits([piece], [range(4)])
            more, state = found[state]
            audit += more
        assert (audit, state) == wanted


def test_long_conversation_has_long_audits():
    units = [("u", False, 1), ("a", False, 1)] * 5000 + [("", False, 7)] + [("a", False, 1)]
    ((audit, state),) = C.least_audits([C.Piece(units, C.END, True)], [(0,)])[0]
    # of two neighbouring turns of the assistant the earlier one goes
    assert audit == "K" * 9_999 + "D" * 8 + "K" and state == 3
