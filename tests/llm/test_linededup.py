"""Line dedup: brute force, the cuckoo filter, and documents put in and taken out again."""

import random

import numpy as np
import pytest

from leafproof.llm import linededup as L
from leafproof.llm.common import prepare

SCHEMA = "doc_id long, text string, kept string"
LONG = "This line is long enough to be told"


def brute(rows, least=3):
    def key(line):
        k = line.strip(" \t\n\v\f\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k) if len(k) >= 20 else None

    held = {}
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if key(line) is not None:
                held.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        largest = lambda ids: max(ids, key=lambda i: (i is not None, i or 0))
        keep = [x for x in lines if not (key(x) in held and len(held[key(x)]) >= least and doc != largest(held[key(x)]))]
        out.append((doc, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=repr)


def result(spark, rows, index=None, own=True):
    docs = spark.createDataFrame(rows, SCHEMA)
    out = L.drop_lines(docs, index or L.build(docs), own)
    return sorted(((r.doc_id, r.kept, r.counted.n_lines, r.counted.n_dropped) for r in out.collect()), key=repr)


CASES = [
    (1, f"{LONG}\nown line of the first document", "x"), (2, f"  {LONG.upper()}\t\r\nshort\nshort", "x"), (3, f"{LONG}\n{LONG}\n", "x"), (4, None, None), (5, "", ""),
    (6, "short\n" + "é" * 19 + "\n" + "é" * 20, ""), (7, "short\n" + "é" * 20 + "\n" + "é" * 19, ""), (8, "é" * 20 + "\n" + "é" * 19, ""), (9, "É" * 20, ""),
    (None, LONG, ""), (None, LONG + "\nsomething else that is long enough", ""), (3, f"{LONG}\nother text of the same document", ""), (3, f"{LONG}\nother text of the same document", ""),
    (10, "\n".join(["a line said very often in one text"] * 5000), ""), (11, " \v\f\n\n", ""),
]


def test_equals_brute_force(spark):
    prepare(spark)
    assert result(spark, CASES) == brute(CASES)
    rng = random.Random(3)
    said = [f"{w} is a line that many documents may hold {n}" for n, w in enumerate("abcdefghij")] + ["brief", "", "  Brief  "]
    rows = [(rng.randint(0, 60), "\n".join(rng.choices(said, k=rng.randint(0, 8))), "") for _ in range(80)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, [], L.build(spark.createDataFrame([], SCHEMA))) == []


def test_heavy_lines_and_no_filter_give_the_same(spark, monkeypatch):
    prepare(spark)
    rows = [(n, f"{LONG}\nthe line of pair number {n // 3} is here\nmine alone is number {n}", "") for n in range(120)]
    want = brute(rows)
    assert result(spark, rows) == want
    monkeypatch.setattr(L, "HEAVY", 3)  # one key is heavy
    assert result(spark, rows) == want
    monkeypatch.setattr(L, "FILTER_BYTES", -1)
    assert result(spark, rows) == want
    monkeypatch.setattr(L, "SHARD_KEYS", 5)
    monkeypatch.setattr(L, "FILTER_BYTES", 1 << 20)
    index = L.build(spark.createDataFrame(rows, SCHEMA))
    assert index.shards > 8 and result(spark, rows, index) == want


def test_filters_hold_what_they_hold(spark):
    keys = np.arange(5000, dtype=np.int64) * 7_919
    f = L.Cuckoo.of(keys)
    assert f.has(keys).all() and f.has(keys + 1).mean() < 0.001
    for a, b, m in zip(*f.places(keys[:2500])):
        assert f.remove(int(a), int(b), int(m))
    assert f.has(keys[2500:]).all() and f.has(keys[:2500]).mean() < 0.001  # nothing that is left was lost
    assert int((f.table != 0).sum()) == 2500
    tiny = L.Cuckoo.empty(1)
    many = [tiny.insert(int(a), int(b), int(m)) for a, b, m in zip(*tiny.places(keys[:50]))]
    assert not all(many)  # full: it says so
    assert len(L.Cuckoo.of(keys[:50]).table) * L.SLOTS >= 50


def state(index):
    pairs = sorted(((r.hi, r.lo, r.doc_id) for r in index.refs.collect()), key=repr)
    counts = sorted(((r.hi, r.lo, r.n, r.keeper) for r in index.counts.collect()), key=repr)
    hot = {(r.hi, r.lo) for r in index.counts.collect() if r.n >= index.least_docs}
    marks = sum(int((np.frombuffer(r.table, dtype=np.uint16) != 0).sum()) for r in index.filters.collect())
    assert marks == len(hot)
    return pairs, counts


def test_documents_go_in_and_out_again(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(L, "SHARD_KEYS", 2)
    lines = lambda n: "\n".join(f"line number {k} that several documents hold" for k in range(n % 9))
    old, new = [(n, lines(n), "") for n in range(20)], [(n, f"{lines(n)}\nnew line that comes with the second batch", "") for n in range(20, 40)]
    first = L.build(spark.createDataFrame(old, SCHEMA))
    before = state(first)
    both = L.insert(first, spark.createDataFrame(new, SCHEMA))
    assert state(both) == state(L.build(spark.createDataFrame(old + new, SCHEMA)))
    assert result(spark, old + new, both) == brute(old + new)
    assert state(L.insert(both, spark.createDataFrame(new, SCHEMA))) == state(both)  # a second time changes nothing
    ids = spark.createDataFrame([(n,) for n in [*range(20, 40), 999]], "doc_id long")
    back = L.delete(both, ids)
    assert state(back) == before and state(first) == before  # and the earlier state is untouched
    assert result(spark, old, back) == brute(old)
    none = L.delete(back, spark.createDataFrame([(n,) for n in range(20)], "doc_id long"))
    assert state(none) == ([], [])
    # documents that are not in the index are judged by it
    asked = [(100, lines(8), ""), (5, lines(5), "")]
    got = dict((d, n) for d, _, _, n in result(spark, asked, both, own=False))
    assert got[100] == 8 and got[5] == 5


@pytest.mark.parametrize("least", [1, 2])
def test_other_limits(spark, least):
    prepare(spark)
    rows = [(1, LONG, ""), (2, LONG, ""), (3, "another line that is long enough", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id, r.kept) for r in L.drop_lines(docs, L.build(docs, least)).collect())
    assert got == [(1, ""), (2, LONG), (3, "another line that is long enough")]
