"""Conversation repair: enumeration of all edits, long conversations through the tree, awkward rows."""

import itertools
import random
from functools import cache
from hashlib import sha256
from zlib import crc32

from leafproof.llm import convrepair as C
from leafproof.llm.common import prepare

SCHEMA = "conv_id long, turn long, role string, text string, cost string"


def brute(turns):
    """(cost, audit) by a search over every edit of every turn, with up to two inserts in each gap."""

    def walk(i, said, run):
        """The best from turn i on, the last output's initial being said, after `run` inserts in this gap."""
        out = [(0, "")] if i == len(turns) and said in ("", "a") else []
        if run < 3:
            to = "a" if said == "u" else "u"
            c, a = walk(i, to, run + 1)
            out.append((5 + c, "I" + a))
        if i < len(turns):
            role, fault = turns[i]
            c, a = go(i + 1, said)
            out.append((2 + c, "D" + a))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                for edit, cost, to in [("K", 0, role), ("R", 1, "u"), ("R", 1, "a")]:
                    if to and said + to in ("s", "u", "su", "ua", "au"):
                        c, a = go(i + 1, to)
                        out.append((cost + more + c, edit + a))
        return min(out) if out else (10**9, "")

    @cache
    def go(i, said):
        return walk(i, said, 0)

    return go(0, "")


def folded(turns):
    m = C.UNIT
    for role, fault in turns:
        m = C.product(m, C.turn_matrix(role, fault))
    return C.best(m)


KINDS = [(r, f) for r in ("s", "u", "a", "") for f in C.FAULTS]


def test_matrices_equal_enumeration():
    for n in (0, 1, 2):
        for turns in itertools.product(KINDS, repeat=n):
            assert folded(turns) == brute(list(turns)), turns
    rng = random.Random(2)
    for _ in range(300):
        turns = rng.choices(KINDS, k=rng.randint(3, 9))
        assert folded(turns) == brute(turns), turns


def test_products_are_associative():
    rng = random.Random(4)
    for _ in range(200):
        a, b, c = (C.turn_matrix(*rng.choice(KINDS)) for _ in range(3))
        assert C.product(C.product(a, b), c) == C.product(a, C.product(b, c))
    assert C.product(C.CLOSED, C.CLOSED) == C.CLOSED


def expected(rows):
    """conv_id -> (report, repaired lines) of rows (conv_id, turn, role, text)."""
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", sha256((r[3] or "").encode()).digest())
    for conv in {r[0] for r in rows}:
        own, seen, turns = sorted((r for r in rows if r[0] == conv), key=order), set(), []
        for _, _, role, text in own:
            role, text = role or "", text or ""
            solid = text.strip(" \t\n\v\f\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            turns.append((role[:1] if role[:1] in ("s", "u", "a") else "", fault))
        cost, audit = brute(turns)
        numbers = {r[1] for r in own if r[1] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") or len(a + b) < 2 for (a, _), (b, _) in zip(turns, turns[1:]))
        count = lambda f: sum(x == f for _, x in turns)
        lines, it, n = [], iter(own), len(audit) - audit.count("D")
        for edit in audit:
            row = None if edit == "I" else next(it)
            if edit != "D":
                place = len(lines) - n % 2
                new = ("user", "assistant")[place % 2]
                lines.append((row[2] or "" if edit == "K" else new) + ":" + ("" if row is None else row[3] or ""))
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit), lines
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    r = C.repair(df)
    report = {x.conv_id: (x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit) for x in r.report.collect()}
    lines = {c: [] for c in report}
    for x in sorted(r.turns.collect(), key=lambda x: (repr(x.conv_id), x.place)):
        lines[x.conv_id].append(f"{x.role}:{x.text}")
    digests = {x.conv_id: x.sha256 for x in C.digests(r.turns).collect()}
    for c, one in lines.items():
        assert digests.get(c) == (sha256("\n".join(one).encode()).hexdigest() if one else None), c
    return {c: (report[c], lines[c]) for c in report}


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "assistant", "Hi!"), (2, 0, "user", "Cut off"), (2, 1, "assistant", "Yes."), (2, 5, "assistant", "Yes."),
    (3, None, None, None), (3, None, "user", "A turn."), (3, 2, "tool", "out."), (3, 2, "tool", "out."), (3, 2, "assistant", "Same turn, other role."),
    (None, 1, "assistant", "An id that is null."), (None, 2, "user", "It is one conversation. "), (4, 0, "user", " \t\n\v\f\r"), (5, 7, "supporter", "Keeps its name?"), (5, 8, "usher", "Too."), (5, 9, "a", "."),
    (6, None, "", ""), (6, None, "", ""), (7, 0, "user", "x" * 300_000), (7, 1, "assistant", "y" * 300_000 + "."),
]


def test_repair_equals_brute_force(spark):
    prepare(spark)
    assert found(spark, ROWS) == expected(ROWS)
    assert found(spark, []) == {}


def test_long_conversations_go_through_the_tree(spark, monkeypatch):
    prepare(spark)
    rng = random.Random(8)
    text = lambda n: rng.choice(["", f"Said {n}.", f"Cut {n}", "Again.", "Again."])
    rows = [(c, n, rng.choice(["user", "assistant", "system", "user", "assistant", "tool"]), text(n)) for c, size in ((1, 120), (2, 70), (3, 3)) for n in range(size)]
    monkeypatch.setattr(C, "RUN", 8)
    monkeypatch.setattr(C, "FAN", 3)  # 15 runs: levels of 5, 2 and 1
    assert found(spark, rows) == expected(rows)


def test_damage(spark):
    rows = [(c, t, r, x) for c in (1, 2, None) for t in (*range(40), None) for r, x in (("assistant", "One. Two! Three?"),)] + [(9, 9, None, None)]
    got = sorted(((r.conv_id, r.turn, r.role, r.text) for r in C.damage(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()), key=repr)
    want = []
    for c, t, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        f = crc32(f"{name(c)}:{name(t)}".encode()) % 20
        text = "" if f == 1 else "".join(x for x in name(text) if x not in ".!?") if f == 2 else name(text)
        want += [(c, t, "user" if f == 4 else name(role), text)] * (0 if f == 0 else 2 if f == 3 else 1)
    assert got == sorted(want, key=repr) and len(got) != len(rows)
