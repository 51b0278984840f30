"""Pseudo-likelihood scores against direct computations, and that training helps."""

import collections
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafproof.llm import common, lmscore

SMALL = lmscore.Settings(words=32, buckets=8, listed=40, slots=256, part=3000)


def token_hash(token):
    """The hash of one token, by the definition."""
    h = sum((ord(c) + 1) * lmscore.Hasher.BASE**i for i, c in enumerate(token)) % 2**64
    return int(common.mix64(np.array([h], dtype=np.uint64))[0]) >> 32


def test_hashes_are_those_of_the_tokens():
    texts = ["", None, "Ab_c d1,e!  ", "\u0130\U0001f600x \U00010400y", "é" * 70_000 + "\x85 a\x1cb", " ", "one"]
    hashes, sizes = lmscore.Hasher()(texts)
    want = [[token_hash(w) for w in lmscore.tokens_of(t)] if len(t or "") < 99 else None for t in texts]
    assert sizes.tolist() == [len(lmscore.tokens_of(t)) for t in texts]
    for got, w in zip(np.split(hashes, np.cumsum(sizes)[:-1]), want):
        assert w is None or got.tolist() == w


def log_softmax(z):
    z = z - z.max()
    return z - np.log(np.exp(z).sum())


def one_by_one(net, ids):
    """The log-probability of each class, by the definition: both levels of the softmax, every other class summed."""
    out = []
    for t in range(len(ids)):
        h = net.b.astype(float)
        for j, k in enumerate(lmscore.OFFSETS):
            h = h + net.e[j][ids[t + k] if 0 <= t + k < len(ids) else net.size]
        h = np.tanh(h)
        own = int(net.group[ids[t]])
        members = np.flatnonzero(net.group == own)
        inner = log_softmax(np.array([net.o[net.place[m]] @ h + net.c[net.place[m]] for m in members]))
        out.append(log_softmax(net.g @ h + net.gc)[own] + inner[list(members).index(ids[t])])
    return np.array(out)


def random_net(seed=3, size=40, scale=1.0):
    rng = np.random.default_rng(seed)
    net = lmscore.Network.fresh(rng.dirichlet(np.ones(size)), seed)
    net.flat[:] += rng.normal(0, scale, len(net.flat)).astype(np.float32)
    return net


def test_log_probs_equal_a_token_by_token_computation():
    rng, net = np.random.default_rng(2), random_net()
    texts = [rng.integers(0, 40, n) for n in (37, 1, 0, 2, 300)]
    line, at = net.joined(texts)
    assert np.allclose(net.log_probs(line, at), np.concatenate([one_by_one(net, t) for t in texts]), atol=1e-3)
    assert np.allclose(sum(np.exp(one_by_one(net, np.array([3, k, 5]))[1]) for k in range(40)), 1, atol=1e-5)


def test_rows_with_far_apart_logits_keep_their_probability():
    net = random_net()
    net.c[:] *= 60
    net.g[0] *= 200
    ids = np.random.default_rng(5).integers(0, 40, 200)
    line, at = net.joined([ids])
    want = one_by_one(net, ids)
    assert want.min() < -80 and np.allclose(net.log_probs(line, at), want, rtol=1e-3, atol=1e-2)


def test_long_texts_are_scored_in_steps(monkeypatch):
    net, ids = random_net(), np.random.default_rng(7).integers(0, 40, 5000)
    whole = net.log_probs(*net.joined([ids]))
    monkeypatch.setattr(lmscore, "STEP", 333)
    assert np.allclose(net.log_probs(*net.joined([ids])), whole, atol=1e-4)


def test_learning_follows_the_numerical_gradient():
    net = random_net(scale=0.3)
    line, at = net.joined([np.random.default_rng(9).integers(0, 40, 25)])
    base, loss = net.flat.copy(), lambda f: -lmscore.Network(f, net.group).log_probs(line, at).mean()
    seen = lmscore.Network(np.zeros_like(base), net.group)
    net.learn(line, at, 0.0, seen)  # the squared gradient is left in seen
    for k in np.random.default_rng(1).choice(np.flatnonzero(seen.flat > 1e-6), 40, replace=False):
        up, down = base.copy(), base.copy()
        up[k] += 1e-2
        down[k] -= 1e-2
        assert abs(abs(loss(up) - loss(down)) / 2e-2 - np.sqrt(seen.flat[k])) < 2e-3


def corpus(spark, parts):
    rng = random.Random(1)
    phrases = ["the cat sat on the mat .", "a dog ran to the old house .", "we saw many small red birds ."]
    rows = [(k, " ".join(rng.choices(phrases, k=20)), 1) for k in range(150)]
    mixed = rows[0][1].split()
    rng.shuffle(mixed)
    rows += [(900, " ".join(mixed), 1), (901, "", 1), (902, None, 1), (None, "the cat", 1), (0, rows[0][1], 1), (903, "the cat sat " * 8000, 1), (2**60 + 1, "\U0001f600 é", 1)]
    return common.prepare(spark).createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(parts)


@pytest.fixture(scope="module")
def scored(spark):
    got = collections.defaultdict(list)
    for r in lmscore.score(corpus(spark, 3), SMALL).collect():
        got[r.doc_id].append(r)
    return got


def test_scores_tell_likely_from_shuffled_texts(spark, scored):
    got = scored
    assert len(got[0]) == 2 and abs(got[0][0].log_prob - got[0][1].log_prob) < 1e-3 and len(got[None]) == 1
    assert got[900][0].n_tokens == got[0][0].n_tokens and got[900][0].mean_log_prob < got[0][0].mean_log_prob - 1
    assert [got[k][0].n_tokens for k in (901, 902, 903, 2**60 + 1)] == [0, 0, 24000, 2] and got[901][0].mean_log_prob is None and got[901][0].log_prob == 0
    assert lmscore.score(corpus(spark, 3).limit(0), SMALL).count() == 0


def test_scores_do_not_depend_on_partitions(spark, scored):
    for r in lmscore.score(corpus(spark, 11), SMALL).collect():
        assert abs(r.log_prob - scored[r.doc_id][0].log_prob) < 1e-3 + 1e-5 * abs(r.log_prob)


def test_the_whole_operator_equals_a_direct_computation(spark, scored):
    """Counting, dealing, training and averaging in plain loops over the whole corpus."""
    rows = corpus(spark, 1).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key")).collect()
    texts = [np.array([token_hash(w) for w in lmscore.tokens_of(r.text)], dtype=np.uint32) for r in rows]
    counts = collections.Counter(int(x) for t in texts for x in t)
    v, share, total = lmscore.learn_vocabulary(spark.createDataFrame(list(counts.items()), "h long, n long"), SMALL)
    assert total == sum(counts.values())
    parts = -(-total // SMALL.part)
    assert parts > 1
    net = lmscore.Network.fresh(share, SMALL.seed)
    flat = net.flat
    for turn in range(SMALL.stride):
        mean, n = 0.0, 0
        for p in range(parts):
            own = sorted((r.key, v.encode(t)[0].astype("<u2").tobytes()) for r, t in zip(rows, texts) if r.key % parts == p)
            new, k = lmscore.train_part(flat, net.group, [np.frombuffer(t, "<u2") for _, t in own], SMALL, turn)
            mean, n = mean + new.astype(float) * k, n + k
        assert abs(n - total / SMALL.stride) <= parts
        flat = (mean / n).astype(np.float32)
    net = lmscore.Network(flat, net.group)
    for r, t in zip(rows, texts):
        classes, *where = v.encode(t)
        inside = v.shares(*where)
        want = one_by_one(net, classes[:40]) if len(t) <= 40 else net.log_probs(*net.joined([classes]))
        assert abs(want.sum() + inside.sum() - scored[r.doc_id][0].log_prob) < 0.02 + 1e-4 * len(t)


def test_production_training_reaches_short_texts_and_both_edges(spark):
    rows = [(k, "one two three four") for k in range(20000)] + [(50000 + k, "five six seven eight") for k in range(20000)]
    docs = common.prepare(spark).createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.mean_log_prob for r in lmscore.score(docs).collect()}
    assert min(got.values()) > -1  # untrained: log(1/8) = -2.1 a token


def test_shares_in_a_bucket_add_up_to_one_with_an_unseen_token(spark):
    s = lmscore.Settings(words=3, buckets=2, listed=20, slots=64)
    hashes = {token_hash(f"t{k}"): 60 // (k + 1) for k in range(60)}
    v, share, total = lmscore.learn_vocabulary(spark.createDataFrame(list(hashes.items()), "h long, n long"), s)
    assert total == sum(hashes.values()) and abs(share.sum() - 1) < 1e-9
    classes, *where = v.encode(np.array(list(hashes), dtype=np.uint32))
    inside = v.shares(*where)
    left = [h for h in hashes if h not in set(v.listed.tolist())]
    assert left and len(v.listed) <= s.words + s.listed
    for b in range(s.buckets):
        seen = np.exp(inside[classes == s.words + b]).sum()
        unseen = sum(np.exp(v.slot_inside[x]) for x in range(b, s.slots, s.buckets))  # each slot has room for one more
        assert abs(seen + unseen - 1) < 1e-2  # slots keep half precision
    assert np.allclose(inside[classes < s.words], 0)


def test_a_softmax_takes_a_maximum_off_only_where_logits_may_be_large():
    share = np.arange(40, 0, -1) / 820
    texts = [np.random.default_rng(3).integers(0, 40, 300).astype("<u2")]

    def plain(net, line, at):
        h = net.hidden(line, at).astype(np.float64)
        whole = lambda w, c: h @ w.T.astype(np.float64) + c
        soft = lambda z: z - z.max(axis=1, keepdims=True) - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True))
        top, low, out = soft(whole(net.g, net.gc)), whole(net.o, net.c), []
        for n, k in enumerate(line[at]):
            i, j = net.first[net.group[k]], net.first[net.group[k] + 1]
            out.append(top[n, net.group[k]] + soft(low[n : n + 1, i:j])[0, net.place[k] - i])
        return np.array(out)

    for scale, safe in ((1, True), (400, False)):
        net = lmscore.Network.fresh(share, 5)
        for w in (net.g, net.o):
            w *= scale
        assert net.safe() is safe
        line, at = net.joined(texts)
        assert np.allclose(net.log_probs(line, at), plain(net, line, at), rtol=1e-3, atol=1e-3)
        assert np.isfinite(lmscore.train_part(net.flat, net.group, texts, lmscore.Settings(), 0)[0]).all()


def test_rows_of_a_key_are_added_up_however_many_there_are():
    rng = np.random.default_rng(4)
    for keys in (rng.zipf(1.3, (6, 900)) % 500, np.zeros((2, 1), int), np.full((1, 8), 3), np.arange(40).reshape(2, 20), np.repeat(np.arange(9), np.arange(1, 10))[None], rng.integers(0, 2**40, (2, 300))):
        x = np.zeros((keys.shape[1] + 1, 4), dtype=np.float32)
        x[:-1] = rng.normal(size=(keys.shape[1], 4))
        got, which = lmscore.sums_of(x, keys)
        assert sorted(which.tolist()) == np.unique(keys).tolist()
        for row, k in zip(got, which):
            assert np.allclose(row, sum(x[:-1][r == k].sum(axis=0, dtype=float) for r in keys), atol=1e-4)


def test_a_batch_of_texts_is_looked_up_once(monkeypatch):
    h = np.array([5, 9, 70, 133], dtype=np.uint32)
    at = np.full(64, -1, dtype=np.int32)
    at[h[:3] % 64] = np.arange(3)  # 133 falls into the slot of 5
    v = lmscore.Vocabulary(h[:3], np.array([0, 1, 3]), np.array([0, 0, -0.5]), at, np.arange(64).astype(np.float16), 2, 4)
    texts = [np.random.default_rng(k).choice(h, k) for k in (7, 0, 1, 0, 30)]
    want, calls, encode = [v.encode(t)[0].astype("<u2").tobytes() for t in texts], [], lmscore.Vocabulary.encode
    monkeypatch.setattr(lmscore.Vocabulary, "encode", lambda self, x: calls.append(len(x)) or encode(self, x))
    assert v.encode_texts(pd.Series([t.tobytes() for t in texts], index=[4, 4, 0, 2, 9])).tolist() == want and calls == [38]
    assert v.encode_texts(pd.Series([], dtype=object)).tolist() == []
    classes, *where = encode(v, h)
    assert classes.tolist() == [0, 1, 3, 2 + 5 % 4] and v.shares(*where).tolist() == [0, 0, -0.5, 5]


@pytest.mark.filterwarnings("error")
def test_a_step_has_the_gradient_of_the_definition_also_where_logits_are_far_apart():
    ids = np.random.default_rng(11).integers(0, 40, 60)
    for far in (1, 300):
        net = random_net(scale=0.3)
        net.g[:] *= far
        net.o[:] *= far
        net.b[0] = 50 * far  # the hidden value is 1
        assert net.safe() is (far == 1)
        line, at = net.joined([ids])
        base, seen = net.flat.copy(), lmscore.Network(np.zeros_like(net.flat), net.group)
        net.learn(line, at, 0.0, seen)
        assert (net.flat == base).all()
        want = lmscore.Network(np.zeros(len(base)), net.group)
        for t in at:
            h, own = net.b.astype(float), int(net.group[line[t]])
            for j, k in enumerate(lmscore.OFFSETS):
                h = h + net.e[j][line[t + k]]
            h, (i, j) = np.tanh(h), net.first[own : own + 2]
            top, low = np.exp(log_softmax(net.g @ h + net.gc)), np.exp(log_softmax(net.o[i:j] @ h + net.c[i:j]))
            top[own] -= 1
            low[net.place[line[t]] - i] -= 1
            dh = (top @ net.g + low @ net.o[i:j]) * (1 - h * h)
            for value, d in ((want.g, np.outer(top, h)), (want.gc, top), (want.o[i:j], np.outer(low, h)), (want.c[i:j], low), (want.b, dh)):
                value += d / len(at)
            for j, k in enumerate(lmscore.OFFSETS):
                want.e[j][line[t + k]] += dh / len(at)
        assert np.allclose(np.sqrt(seen.flat), np.abs(want.flat), atol=1e-5 * far, rtol=1e-3)
