"""Toxicity, quality, near duplicates, decontamination and the pipeline against brute force on small fixtures."""

import base64
import collections
import itertools
import random
import re
import sys

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from leafproof.llm import bpe, common, decontam, neardup, quality

SYLLABLES = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu ma me mi mo mu na ne ni no nu".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(30, 90)) for _ in range(60)]
    for k in range(12):  # near copies of various distance, chains included
        words = texts[k % 4].split()
        for _ in range(k % 5):
            words[rng.randrange(len(words))] = "changed" + str(rng.randrange(99))
        texts.append(" ".join(words))
    texts += [texts[0].upper(), texts[1], "", None, "one", "One", "two words", "a b c d e f g h " * 8, " x " * 3]
    rows = [(k, t, "en", f"s{k % 3}", 0, "clash") for k, t in enumerate(texts)] + [(1, texts[1], None, None, None, "x"), (None, texts[2], None, None, None, None)]
    return common.prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string")


def brute_components(rows, k, limit):
    low = str.maketrans(common.ASCII_UPPER, common.ASCII_LOWER)
    sets = []
    for r in rows:
        w = re.findall(common.WORD, (r.text or "").translate(low))
        n = min(k, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= limit * (len(sets[a]) + len(sets[b]) - both):
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    least = collections.defaultdict(list)
    for r, g in zip(rows, group):
        if r.doc_id is not None:
            least[g].append(r.doc_id)
    return sorted((str(r.doc_id), len(s), min(least[g], default=None)) for r, s, g in zip(rows, sets, group))


@pytest.mark.parametrize(("k", "limit", "pivots"), [(3, 85, True), (5, 80, False)])
def test_near_duplicates_equal_brute_force(corpus, monkeypatch, k, limit, pivots):
    if not pivots:  # no pivot links anything: all is left to the prefix join
        every = neardup._pivot_pairs
        monkeypatch.setattr(neardup, "_pivot_pairs", lambda members, limit: every(members, limit).limit(0))
        monkeypatch.setattr(neardup, "LEAST_OPEN", 1)
    got = neardup.near_duplicates(corpus, k, limit).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == brute_components(corpus.collect(), k, limit)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


@pytest.fixture(scope="module")
def crowd(spark):
    """A large group of copies of one text, most of them further from each other than the limit, and long texts."""
    rng = random.Random(11)
    base, rows = prose(rng, 150).split(), []
    for k in range(150):
        words = list(base)
        for _ in range(k % 13):
            words[rng.randrange(len(words))] = "own" + str(rng.randrange(400))
        rows.append((k, " ".join(words)))
    long = prose(rng, 30_000)
    rows += [(500, long), (501, long + " end"), (502, "short " + long[:2000])]
    return common.prepare(spark).createDataFrame(rows, "doc_id long, text string").repartition(6)


@pytest.mark.parametrize(("k", "limit", "pivots"), [(3, 85, True), (5, 80, True), (3, 85, False)])
def test_large_groups_just_under_the_limit_equal_brute_force(crowd, monkeypatch, k, limit, pivots):
    if not pivots:
        every = neardup._pivot_pairs
        monkeypatch.setattr(neardup, "_pivot_pairs", lambda members, limit: every(members, limit).limit(0))
        monkeypatch.setattr(neardup, "LEAST_OPEN", 1)
    got = neardup.near_duplicates(crowd, k, limit).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == brute_components(crowd.collect(), k, limit)


def test_near_duplicates_without_a_bitmap_and_of_empty_tables(corpus, monkeypatch):
    want = sorted(map(str, neardup.near_duplicates(corpus).collect()))
    monkeypatch.setattr(common, "MAX_BITS", 5)  # none has room for more than eight keys
    assert sorted(map(str, neardup.near_duplicates(corpus).collect())) == want
    assert neardup.near_duplicates(corpus.limit(0)).count() == 0 == neardup.keep_one(corpus.limit(0)).count()


def test_one_row_of_each_component_is_kept(spark, corpus):
    shared = [(7, "this id is that of another text as well " * 3, "de", "s", 1, "other"), (None, "no id but a text of its own that nothing else is like at all", None, None, None, None)]
    docs = corpus.unionByName(spark.createDataFrame(shared, corpus.schema))
    kept = neardup.keep_one(docs, 3, 85)
    assert kept.columns == docs.columns
    rows, got = docs.collect(), kept.collect()
    texts = collections.Counter(r.text or "" for r in got)
    assert texts[shared[0][1]] == texts[shared[1][1]] == 1
    found = {(r.doc_id, r.n_shingles): r.component_id for r in neardup.near_duplicates(docs, 3, 85).collect()}
    groups = {c for (d, n), c in found.items() if n}
    empty = {(r.doc_id, r.text or "") for r in rows if not (r.text or "").strip()}
    # the text without an id has no component_id; two components have 7 as their least id
    assert len(got) == len(groups) + 1 + len(empty) and None in groups


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 150, 3000):
        assert (neardup.sketch(rng.integers(1, 2**63, n).astype(np.uint64), 150) != neardup.EMPTY).all()
    a = rng.integers(1, 2**63, 2000).astype(np.uint64)
    b = np.concatenate([a[:1600], rng.integers(1, 2**63, 400).astype(np.uint64)])
    same = np.mean(neardup.sketch(a, 2000) == neardup.sketch(b, 2000))
    assert abs(same - 1600 / 2400) < 0.04


def brute_fits(bands, raw):
    """Whether a text lies in its band, from the definition."""
    ratio = len(zstandard.ZstdCompressor(level=3).compress(raw)) / len(raw)
    limit = [x for x in bands.limits if x[0] <= len(raw)]
    even = False
    counts = collections.Counter(raw)
    if len(raw) >= bands.limits[0][0] and sum(counts[b] for b in b"0123456789") >= bands.digits * len(raw) and len(counts) > 1:
        entropy = -sum(n / len(raw) * np.log2(n / len(raw)) for n in counts.values())
        even = entropy > bands.even * np.log2(len(counts))
    return (not limit or limit[-1][1] <= ratio <= limit[-1][2]) and not even, ratio


def test_quality_equals_brute_force(corpus, spark):
    rng = random.Random(12)
    long = prose(rng, 40_000) + "\n" + "x7" * 3000 + "\n" + base64.b64encode(rng.randbytes(30_000)).decode()
    extra = [(800, long, None, None, None, "k"), (801, "a#b $5 <|>\n a\n\na \n a\n\t\n", None, None, None, None), (802, "0123456789" * 90, "en", "s", 1, "x"), (803, "\u2003word\u00a0word " * 30, None, None, None, None)]
    docs = corpus.unionByName(spark.createDataFrame(extra, corpus.schema)).withColumn("judged", F.lit("mine")).withColumn("ratio", F.lit(1))
    bands = quality.Bands(chunk=256)
    got = quality.judge(docs, bands).collect()
    assert len(got) == docs.count()
    for r in got:
        text = r.text or ""
        w = re.findall(common.WORD, text)
        count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(common.WORD, x)]
        j, raw = r.judged, text.encode()
        failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
        assert (j.n_words, j.word_chars, j.n_repeat_words) == (len(w), sum(map(len, w)), len(inside))
        assert (j.n_symbols, j.n_dup_lines, j.base_failed) == (sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), failed)
        parts = [raw[a : a + 256] for a in range(0, len(raw), 256)] if len(raw) > 256 else []
        out = sum(len(p) for p in parts if not brute_fits(bands, p)[0]) / len(raw) if parts else 0.0
        fits, ratio = brute_fits(bands, raw) if raw else (True, 1.0)
        assert (j.ratio, j.chunk_share) == pytest.approx((ratio, out)) and j.in_band == (fits and out <= bands.share)
        assert j.kept == (not failed and j.in_band)
    assert quality.judge(corpus.limit(0)).count() == 0


def test_quality_rejects_extremes_only():
    rng = random.Random(2)
    compress = zstandard.ZstdCompressor(level=3).compress
    ok = lambda t: quality.compression(t.encode(), quality.Bands(), compress)[2]
    assert all(ok(prose(rng, n)) for n in (40, 100, 400, 3000))
    assert not ok("same words again and again " * 200)
    assert not ok(prose(rng, 3000) + "spam spam " * 4000)  # a repetitive part
    assert not ok("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(4000)))
    assert quality.statistics("a b\n\nc\n c\nc\n")[3] == 1


@pytest.mark.parametrize("n", [128, 200, 256, 400, 512, 1000, 1024, 1500, 2048, 3000, 4096, 6000, 8192, 20_000, 40_000])
def test_quality_rejects_encoded_text_of_each_length(n):
    rng = random.Random(n)
    compress = zstandard.ZstdCompressor(level=3).compress
    for text in (base64.b64encode(rng.randbytes(n)).decode(), rng.randbytes(n).hex(), "".join(rng.choices("0123456789", k=n))):
        raw = "\n".join(text[i : i + 76] for i in range(0, n, 76)).encode()[:n]
        assert not quality.compression(raw, quality.Bands(), compress)[2], text[:20]


def brute_tiles(p, t, least):
    used_p, used_t, total = [False] * len(p), [False] * len(t), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not used_p[i + k] and not used_t[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < least:
            return total
        used_p[i : i + k] = used_t[j : j + k] = [True] * k
        total += k


def test_tiling_equals_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        p, t = [rng.choices("abcdef", k=rng.randint(1, 40)) for _ in range(2)]
        if rng.random() < 0.6:
            c = rng.randrange(len(p))
            t = t[:5] + p[c:] + t[5:9] + p[:c]
        tiles = decontam.tile(p, [t], 3)
        for i, j, k in tiles:
            assert p[i : i + k] == t[j : j + k] and k >= 3
        assert sum(k for _, _, k in tiles) == brute_tiles(p, t, 3)
        assert len({x for i, _, k in tiles for x in range(i, i + k)}) == sum(k for _, _, k in tiles)


def test_leaks_catch_reordered_passages(spark, corpus):
    rng = random.Random(9)
    items = [(k, prose(rng, 40)) for k in range(4)] + [(7, None), (8, "too short"), (None, prose(rng, 30)), (0, None)]
    a, b = items[0][1].split(), items[1][1].split()
    rows = [(100, prose(rng, 50) + " " + items[0][1] + " " + prose(rng, 9)), (101, " ".join(b[20:] + prose(rng, 6).split() + b[:20])), (102, " ".join(a[:12]) + " " + prose(rng, 40)), (103, items[0][1]), (103, items[0][1]), (104, items[6][1].upper())]
    docs = corpus.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("item_id", F.lit(1)).withColumn("seeds", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit("k"))
    got = sorted((r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect())
    assert got == [(100, 0), (101, 1), (103, 0), (104, None)]
    left = decontam.remove_leaks(docs, bench)
    assert left.count() == docs.count() - 5 and left.columns == docs.columns
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 == decontam.leaks(docs.limit(0), bench).count()


def test_leaks_equal_brute_force(spark):
    """Short alphabets, repeated passages and a phrase that every item and document holds."""
    rng = random.Random(21)
    shared = "this very phrase is everywhere"
    words = [f"w{k}" for k in range(9)]
    items = [(k, f"{shared} " + " ".join(rng.choices(words, k=rng.randint(1, 30)))) for k in range(25)]
    items += [(50, " ".join(rng.choices("ab", k=40))), (51, "a b c d e " * 9), (52, prose(rng, 60)), (53, items[3][1])]
    docs = []
    for k in range(60):
        parts = [prose(rng, 20), shared]
        for _ in range(rng.randint(0, 3)):
            w = items[rng.randrange(len(items))][1].split()
            a = rng.randrange(len(w))
            parts.append(" ".join(w[a : a + rng.randint(3, 30)]))
        rng.shuffle(parts)
        docs.append((k, " ".join(parts)))
    docs += [(90, "a b c d e " * 4), (91, (prose(rng, 9000) + " ") + items[27][1]), (92, None), (93, "")]
    want = set()
    for d, text in docs:
        for i, item in items:
            p, t = decontam.tokens_of(item), decontam.tokens_of(text)
            if len(t) < 2000 and len(p) >= decontam.LEAST and brute_tiles(p, t, decontam.LEAST) >= 0.5 * len(p):
                want.add((d, i))
    want.add((91, 52))
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 20


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    import corpus_pipeline

    rng = random.Random(6)
    docs, labels, passage = [], [], prose(rng, 40)
    for k in range(160):
        t = prose(rng, 60) + "."
        if k % 4 == 0:
            t = t.replace(" ", " grobnik ", 1)
        docs.append((k, t, "en", "s", len(t)))
        labels.append((k, 1, int(k % 4 == 0)))
    lone, shared = prose(rng, 50), prose(rng, 55)
    docs += [(200, docs[1][1] + " end", "en", "s", 0), (201, docs[2][1], "en", "s", 0), (202, prose(rng, 20) + " " + passage, "en", "s", 0), (203, "one two " * 90, "en", "s", 0), (204, None, None, None, None), (205, "", None, None, None)]
    docs += [(None, lone, "en", "s", 0), (None, docs[3][1], "en", "s", 0), (5, shared, "en", "s", 0), (6, docs[6][1], "de", None, None)]
    tables = (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, passage)], "item_id long, text string"))
    for name, rows, schema in tables:
        clash = spark.createDataFrame(rows, schema).withColumn("_score", F.lit("mine")).withColumn("judged", F.lit(1)).withColumn("key", F.lit("k"))
        clash.write.parquet(f"{tmp_path}/{name}.parquet")
    # clean, not too short, nothing that is in another's group, no passage: but the text without an id and the one that shares an id
    want = sorted([(str(k), docs[k][1]) for k in range(160) if k % 4] + [("None", lone), ("5", shared)])
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), encoding.decode(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    for name, stage in corpus_pipeline.STAGES:
        table = common.table(spark, str(tmp_path), "documents")
        out = stage(spark, table, str(tmp_path))
        none = stage(spark, table.limit(0), str(tmp_path))
        assert none.count() == 0 and none.columns == out.columns
        if name != "byte_bpe":
            assert out.columns == table.columns


def test_entry_does_without_the_subpackage(monkeypatch):
    import __spark_entry__

    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    names = set(__spark_entry__.queries())
    assert "lookup" in names and "op6_minhash_dedup" in names and "pipeline" not in names
