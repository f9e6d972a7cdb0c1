import functools
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest

from pavescope.llm import conversations as cv

FAULTS = "-td"


def cheapest(codes):
    """Every edit sequence of a short conversation, by the grammar's expression."""
    n, best = len(codes) // 2, None

    def walk(at, roles, cost, audit, inserted):
        nonlocal best
        if at == n and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, audit), (cost, audit))
        if inserted < 2:
            for c in "ua":
                walk(at, roles + c, cost + 2, audit + "I", inserted + 1)
        if at < n:
            initial, fault = codes[2 * at], codes[2 * at + 1]
            walk(at + 1, roles, cost + 3, audit + "D", 0)
            if fault != "d":
                walk(at + 1, roles + initial, cost + (fault == "t"), audit + "K", 0)
                for c in "ua":
                    walk(at + 1, roles + c, cost + 2 + (fault == "t"), audit + "R", 0)

    walk(0, "", 0, "", 0)
    return best


def test_lattice_against_all_edits():
    for codes in ["".join(x) for n in range(4) for x in itertools.product([a + b for a in "suax" for b in FAULTS], repeat=n)][::3]:
        assert cv.repair(codes) == cheapest(codes), codes


def test_pieces_join_exactly():
    rng = random.Random(5)
    for _ in range(60):
        codes = "".join(rng.choice("suuaaax") + rng.choice("---td") for _ in range(rng.randint(5, 40)))
        pieces = [codes[a : a + 14] for a in range(0, len(codes), 14)]
        assert cv.joined([cv.crossing(p) for p in pieces]) == cv.repair(codes)


def by_layers(codes):
    """Least (cost, audit) by plain relaxation over rows."""
    best = {0: (0, "")}
    steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def put(to, state, label):
        if state not in to or label < to[state]:
            to[state] = label

    def inserted(have):
        for _ in range(3):
            for q, (c, a) in list(have.items()):
                put(have, steps[q, "a" if q == 2 else "u"], (c + 2, a + "I"))
        return have

    for k in range(0, len(codes), 2):
        inserted(best)
        after = {}
        for q, (c, a) in best.items():
            put(after, q, (c + 3, a + "D"))
            if codes[k + 1] != "d":
                t = codes[k + 1] == "t"
                put(after, steps[q, "a" if q == 2 else "u"], (c + 2 + t, a + "R"))
                if (q, codes[k]) in steps:
                    put(after, steps[q, codes[k]], (c + t, a + "K"))
        best = after
    return min(v for q, v in inserted(best).items() if q in (0, 3))


def brute(rows):
    space = lambda v: " " if v is None else str(v)
    convs = {r[0] for r in rows}
    out = []
    for conv in convs:
        own = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            role, text, k = space(role), space(text), zlib.crc32(f"{space(c)}:{space(turn)}".encode()) % 20
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            own += [] if k == 0 else [(turn is not None, turn or 0, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
        own.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        turns = {r[1] for r in own if r[0]}
        faults, seen = [], set()
        for _, _, role, text in own:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        codes = "".join((i if i and i in "sua" else "x") + {"": "-", "truncated": "t"}.get(f, "d") for i, f in zip(initials, faults))
        cost, audit = by_layers(codes)
        lines, last, at = [], "", 0
        for e in audit:
            made = "assistant" if last == "u" else "user"
            if e in "IR":
                lines.append(made + ":" + (own[at][3] if e == "R" else ""))
            elif e == "K":
                lines.append(own[at][2] + ":" + own[at][3])
            last = lines[-1][0] if e != "D" else last
            at += e != "I"
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


@functools.cache
def made():
    rng, rows = random.Random(8), []
    for conv in [*range(150), None]:
        for turn in range(rng.choice((1, 2, 5, 9, 30))):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None))
            rows.append((conv, rng.choice((turn, turn, turn + 1, None)), role, rng.choice(("Yes.", "No!", "Why?  \n", "cut off", "", " \t", "é", "Ça va. ", "...", None, "A" * 3000 + "."))))
    rows += rows[:40]
    return rows + [(1000, t, r, "ok.") for t in range(400) for r in ("user", "assistant")]


@pytest.mark.parametrize("piece", [cv.PIECE, 4])
def test_brute_force(spark, piece):
    frame = spark.createDataFrame([(*r, 1, "x") for r in made()], "conv_id long, turn long, role string, text string, pos int, code string").repartition(6)
    got = sorted((tuple(r) for r in cv.conversation_repair(frame, piece).collect()), key=str)
    assert got == brute(made())


def test_oracle_on_ties_and_nulls():
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(made(), columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    assert sorted(con.sql(cv.ORACLE).fetchall(), key=str) == brute(made())


def test_turns_fit_the_grammar(spark):
    frame = spark.createDataFrame(made(), "conv_id long, turn long, role string, text string")
    rows = cv.judged(cv.damaged(frame))
    turns = cv.repaired(rows, cv.decisions(rows)).collect()
    by = {}
    for t in sorted(turns, key=lambda t: (t.pos, t.nth)):
        by.setdefault(t.conv_id, []).append(t)
        assert t.edit != "Insert" or t.text == ""
    assert all(re.fullmatch("s?(ua)+", "".join(t.role[0] for t in own)) for own in by.values())


def test_empty_table(spark):
    frame = spark.createDataFrame(made()[:3], "conv_id long, turn long, role string, text string")
    assert cv.conversation_repair(frame.limit(0)).count() == 0
