"""Ranked lexical search against a direct computation."""

import math
import random
import re
from collections import Counter

from leafproof.llm import lexical as X
from leafproof.llm.common import prepare

DOCS, ITEMS = "doc_id long, text string, term string", "item_id long, text string, score string"
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    rows = [(d, Counter(terms(t))) for d, t in docs]
    rows = [(d, c) for d, c in rows if c]
    n_docs, total = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(w for _, c in rows for w in c)
    asked = {}
    for item, text in set(items):
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, words in asked.items():
        found = []
        for d, c in rows:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w, q in words.items() if c[w])
            if s > 0:
                found.append((-s, d is not None, d or 0, d))
        out += [(item, n, d, -s) for n, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k=10):
    index = X.index(spark.createDataFrame([(*d, "x") for d in docs], DOCS))
    out = X.search(index, spark.createDataFrame([(*i, "x") for i in items], ITEMS), k)
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in out.collect()), key=repr)


def sample(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(k)}" for k in range(40)] + ["Übung", "übung", "A1", "a1", "naïve", "日本"]
    return [" ".join(rng.choices(words, weights=[1 / (1 + k) for k in range(len(words))], k=rng.randint(0, 30))) for _ in range(n)]


def test_search_equals_brute_force(spark, monkeypatch):
    prepare(spark)
    docs = list(enumerate(sample(1, 150))) + [(7, "w1 w2 again under one id"), (None, "w3 w4"), (None, "w3 w4"), (500, None), (501, ""), (502, " .,-"), (503, "w1." * 20_000)]
    docs += [(n, "the very same text w5 w6") for n in range(600, 640)]
    items = list(enumerate(sample(2, 12))) + [(3, "w9 W9"), (90, "w5 w6 same"), (91, ""), (92, None), (93, "unheard words"), (None, "w3"), (90, "w5 w6 same")]
    want = brute(docs, items)
    assert found(spark, docs, items) == want and len(want) > 100
    assert found(spark, docs, items, k=3) == brute(docs, items, 3)
    monkeypatch.setattr(X, "BROADCAST_TERMS", 20)  # items in blocks
    assert found(spark, docs, items) == want


def test_small_chunks_and_slices_change_nothing(monkeypatch):
    text = "Ab cd-EF  gh_ij 日本 Übung " * 50 + "x" * 500
    want = terms(text)
    for size in (1, 7, 64, 10**6):
        monkeypatch.setattr(X, "SLICE", size)
        assert [w for part in X.terms_of(text) for w in part] == want


def test_empty_tables(spark):
    prepare(spark)
    assert found(spark, [], [(1, "w1")]) == [] and found(spark, [(1, "w1")], []) == [] and found(spark, [(1, "  ")], [(1, "w1")]) == []


def test_a_word_in_every_document_scores_nothing(spark):
    prepare(spark)
    docs = [(n, "all w%d" % n) for n in range(2000)]
    assert found(spark, docs, [(1, "all")]) == brute(docs, [(1, "all")])
