"""The string kernel, its machine and its scores against enumeration, and what training may see."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafproof.llm import common, toxicity

SYLLABLES = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu ma me mi mo mu na ne ni no nu".split()
BAD = ["grobnik", "zwalfer", "plotzy", "vox"]


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def labelled(n=320, seed=4):
    rng, texts, y = random.Random(seed), [], []
    for k in range(n):
        words = prose(rng, 60).split()
        if k % 4 == 0:
            words[rng.randrange(60)] = BAD[k // 4 % len(BAD)]
        words[20] += "."
        texts.append(" ".join(words) + ".")
        y.append(int(k % 4 == 0))
    return texts, np.array(y)


def features(k, string):
    """The weights of a string's subsequences, by enumeration."""
    s = [int(x) for x in k.codes(string) if x > 0]
    s += [toxicity.END] if len(s) == 3 else []
    out = {}
    for places in itertools.combinations(range(len(s)), 4):
        span = places[-1] - places[0] + 1
        if span <= toxicity.SPAN:
            key = tuple(s[p] for p in places)
            out[key] = out.get(key, 0) + toxicity.DECAY ** (span - 4)
    return out


def cosine(a, b):
    norm = lambda x: np.sqrt(sum(v * v for v in x.values()))
    return sum(v * b.get(key, 0) for key, v in a.items()) / (norm(a) * norm(b)) if a and b else 0.0


STRINGS = ["grobnik", "g.r.o.b", "gro--bnik", "xgroxbnik", "abc", "a", "", "GRÖBNIK7", "\u4e00\u4e01\u4e02\u4e03x", "aaaaaaa", "banana", "a1b2c3d4e5", "\U0001f600abcd"]


def test_the_kernel_equals_an_enumeration_of_subsequences():
    k = toxicity.Kernel()
    dense, used = k.dense(STRINGS)
    want = np.array([[cosine(features(k, a), features(k, b)) for b in STRINGS] for a in STRINGS])
    assert np.allclose(dense @ dense.T, want, atol=1e-5)
    marks, used = k.dense(["grobnik", "banana"])
    assert np.allclose(k.against(STRINGS, marks, used), want[:, [0, 10]], atol=1e-5)


def test_a_margin_is_the_machine_on_the_kernel():
    """A table that is a landmark's features gives the kernel with it, in one lookup a subsequence."""
    k = toxicity.Kernel()
    land, used = k.dense(["grobnik", "banana"])
    table = np.zeros(toxicity.SIZE)
    table[used] = 2 * land[0] - land[1]
    values = k.against(STRINGS, land, used)
    assert np.allclose(k.margins(STRINGS, table), np.maximum(2 * values[:, 0] - values[:, 1], 0), atol=1e-5)
    assert k.margins([], table).shape == (0,)


def test_a_long_string_has_the_margin_of_its_worst_window():
    k = toxicity.Kernel()
    land, used = k.dense(["grobnik"])
    table = np.zeros(toxicity.SIZE)
    table[used] = land[0]
    long = "ba" * 500 + "grobnik" + "du" * 3000
    parts = k.windows(long)
    assert all(len(p) <= toxicity.LONG for p in parts) and "".join(p[: toxicity.LONG // 2] for p in parts) in long
    assert k.margins([long], table)[0] == max(k.margins(parts, table)) > 0.1
    assert k.windows("short") == ["short"]


@pytest.fixture(scope="module")
def model():
    return toxicity.train(*labelled())


def rate(model, texts):
    k = toxicity.Kernel()
    return np.mean([model.score(k.margins(sorted(toxicity.strings_of(t)), model.table).max(keepdims=True))[0] >= 0.5 for t in texts])


def test_unseen_texts_are_told_apart(model):
    rng = random.Random(8)
    assert rate(model, [prose(rng, 50) for _ in range(80)]) == 0
    assert rate(model, [f"{prose(rng, 30)} {w} {prose(rng, 20)}" for w in BAD for _ in range(5)]) == 1


def test_separators_change_nothing(model):
    k, rng = toxicity.Kernel(), random.Random(9)
    for w in BAD:
        forms = [w.upper() + "!", ".".join(w), "..".join(w), "-*-".join(w), w.replace("o", "0").replace("i", "1")]
        assert np.allclose(k.margins([*forms, w], model.table), k.margins([w], model.table)[0])
        assert rate(model, [f"{prose(rng, 9)} {' '.join(w)} {prose(rng, 9)}", f"{prose(rng, 9)} {'  '.join(w)} {prose(rng, 9)}"]) == 1


def test_letters_put_in_at_random_places_are_mostly_tolerated(model):
    rng, forms = random.Random(10), []
    for _ in range(120):
        w = rng.choice(BAD[:3])
        a = rng.randrange(1, len(w))
        forms.append(f"{prose(rng, 20)} {w[:a]}{rng.choice('abcdefghijklmnopqrstuvwxyz')}{w[a:]} {prose(rng, 20)}")
    assert rate(model, forms) >= 0.6  # 0.68 when written; the README has figures on labelled texts


def docs_of(spark, texts):
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[0], "x"), (5, texts[5], "x"), (9000, None, None), (9001, "", None)]
    return common.prepare(spark).createDataFrame(rows, "doc_id long, text string, score string")


def test_learning_sees_no_held_out_label_and_stands_odd_ones(spark):
    texts, y = labelled()
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)] + [(None, 1), (3, None), (4, 7), (9000, 1), (99999, 1)], "doc_id long, toxic int")
    base = toxicity.learn(docs, labels)
    held = toxicity.held_out(F.col("doc_id"))
    other = toxicity.learn(docs, labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert base.to_bytes() == other.to_bytes()
    changed = toxicity.learn(docs, labels.withColumn("toxic", F.when(held, F.col("toxic")).otherwise(1 - F.col("toxic"))))
    assert base.to_bytes() != changed.to_bytes()
    assert toxicity.learn(docs.repartition(7), labels.repartition(5)).to_bytes() == base.to_bytes()  # the order of rows plays no part
    both = toxicity.learn(docs, labels.unionByName(labels.withColumn("toxic", 1 - F.col("toxic"))))  # contradicting labels
    assert np.isfinite(both.table).all() and both.slope > 0


def test_the_sample_is_bounded(spark, monkeypatch):
    texts, y = labelled()
    docs, labels = docs_of(spark, texts), spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "doc_id long, toxic int")
    rows = toxicity.sample(docs, labels, per_class=30, longest=20_000).collect()
    assert all(0 < sum(r.y == v for r in rows) <= 30 for v in (0, 1))
    assert toxicity.sample(docs, labels, per_class=2000, longest=10).count() == 0


def test_scores_cover_every_row(spark, model):
    texts, _ = labelled(40)
    got = toxicity.score(docs_of(spark, texts), model)  # the clashing column is replaced
    rows = got.collect()
    assert got.columns == ["doc_id", "text", "score"] and len(rows) == 44 and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[9000] == by[9001] < 0.5 and by[None] == by[0] >= 0.5 and sum(r.doc_id == 5 for r in rows) == 2
    assert toxicity.score(docs_of(spark, texts).limit(0), model).count() == 0


def test_without_labels_the_score_is_constant(spark):
    docs = docs_of(spark, ["some text"] * 6)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert len({r.score for r in toxicity.score(docs, toxicity.learn(docs, none)).collect()}) == 1
    one = toxicity.learn(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert {r.score < 0.5 for r in toxicity.score(docs, one).collect()} == {True}
