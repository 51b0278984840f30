"""Token counts, byte-level BPE, sharding and chat formatting against brute force on small fixtures."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from leafproof.llm import bpe, chat, common, resync, sharding, tokens

TEXTS = [
    None, "", " ", "\n\n \n", "a", "it's  here\n\n\nagain", "x" * 900, "ab" + " " * 700 + "cd", "<|endoftext|>", "pre<|endoftext|>post " * 60,
    "é漢字 🙂 naïve " * 80, "word " * 400 + "\n\n" + "tail", "12345 67,89!? " * 90, "<|endof" + "text|>" * 50, " ".join(f"w{k}" for k in range(500)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "junk", 0) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 1), (11, TEXTS[11], "x", 1), (11, TEXTS[11], "x", 1), (None, TEXTS[13], None, None), (11, TEXTS[14], "x", 0)]
    return common.prepare(spark).createDataFrame(rows, "doc_id long, text string, key string, n_tokens int")


def test_token_counts_equal_the_library(docs):
    tok = tokens.load(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r.doc_id is not None, r.doc_id or 0, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    for huge, chunk, overlap in ((10**6, 10**6, 10**5), (100, 200, 40)):
        for pattern in (None, public_tokenizers.PATTERN):
            got = tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), pattern, huge, chunk, overlap).collect()
            assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want


def test_bpe_round_trip_equals_tiktoken(docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = sorted((str(r.doc_id), enc.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect())
    for huge, chunk, overlap in ((10**6, 10**6, 10**5), (100, 200, 40)):
        got = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN, huge, chunk, overlap), path).collect()
        assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got) == want


def test_chunks_cover_a_text_with_full_overlaps():
    for n in (0, 1, 199, 240, 241, 1000):
        parts = list(resync.cut("x" * n, 200, 40))
        assert [p[1] for p in parts] == [False] * (len(parts) - 1) + [True]
        assert all(len(p[3]) == 240 for p in parts[:-1])
        assert parts[-1][2] + len(parts[-1][3]) == n


def test_empty_tables(docs):
    none = docs.limit(0)
    assert tokens.count_tokens(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert bpe.encode(none, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    assert sharding.shard(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000])
def test_feistel_is_a_permutation_with_an_inverse(n):
    there = [sharding.permute_one(x, n, 7) for x in range(n)]
    assert sorted(there) == list(range(n))
    assert [sharding.invert_one(y, n, 7) for y in there] == list(range(n))


def test_feistel_expression_equals_the_scalar_form(spark):
    for n in (1, 5, 1000):
        got = spark.range(n).select("id", sharding.permute(F.col("id"), n, 7).alias("to")).collect()
        assert all(r.to == sharding.permute_one(r.id, n, 7) for r in got)


def test_shards_are_even_and_gapless(docs):
    got = sharding.shard(docs, 7, seed=3).collect()
    assert len(got) == docs.count()
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in {r.shard for r in got}}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    ranked = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, zlib.crc32((r.text or "").encode()), len((r.text or "").encode())))
    for k, (r, row) in enumerate(zip(sorted(got, key=lambda r: r.row_number), ranked)):
        assert r.row_number == k and r.doc_id == row.doc_id
        assert r.text_crc32 == zlib.crc32((row.text or "").encode()) and r["size"] == len((row.text or "").encode()) + 8
        to = sharding.permute_one(k, len(got), 3)
        assert (r.shard, r.slot) == (to % 7, to // 7)


CHATS = [
    (1, 0, "system", "be [SYS] brief"), (1, 1, "user", "a\\[INST]b"), (1, 2, "user", ""), (1, 3, "assistant", "<s>x</s>\\"), (1, 4, "assistant", "[SEP]y\\\\"),
    (2, 0, None, None), (2, None, "tool[SEP]er", "t[/ROLE]"), (2, 1, "assistant", None), (3, 5, "user", "same"), (3, 5, "user", "same"), (None, 0, "assistant", "z[\\INST]\n"),
]


def test_chats_read_back_and_mask_the_assistant(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("pieces", F.lit(1))
    out = chat.format_chats(df)
    out = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: r for r in out.collect()}
    for conv in {c[0] for c in CHATS}:
        turns = sorted(((c[1] is not None, c[1] or 0), c[2] or "", c[3] or "") for c in CHATS if c[0] == conv)
        assert [(t.role, t.text) for t in got[conv].turns] == [t[1:] for t in turns]
        assert got[conv].loss == "".join(t for _, r, t in turns if r == "assistant")
    assert got[1].formatted.count("[INST]") == 1  # two user turns are one block
    assert chat.format_chats(df.limit(0)).count() == 0


def test_digest_of_the_probe(spark):
    text = "</s>[INST] ok [/INST]"
    df = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    r = chat.format_chats(df).select(chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert hashlib.sha256(r.loss.encode()).hexdigest() == hashlib.sha256(text.encode()).hexdigest()


def test_groups_of_equal_texts_and_null_ids_are_spread(spark):
    rows = [(None, None)] * 300 + [(k, "same text") for k in range(400)] + [(7, "same text")] * 200
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 24).collect()
    counts = [sum(r.shard == s for r in got) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == 900
    same = [sum(r.shard == s and r.size > 8 for r in got) for s in range(24)]
    assert min(same) > 10  # no shard holds the group, none is without it
    slots = sorted((r.shard, r.slot) for r in got)
    assert slots == [(s, k) for s in range(24) for k in range(counts[s])]


def test_a_walk_that_does_not_end_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(sharding, "WALK", 2)
    with pytest.raises(Exception, match="cycle walk has not ended"):
        spark.range(962).select(sharding.permute(F.col("id"), 962, 7)).collect()  # of 1024 numbers: some are outside twice


def test_long_conversations_and_texts(spark):
    long = "word </s> " * 60_000
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k} [INST]") for k in range(3000)] + [(2, 0, "user", long), (2, 1, "assistant", long), (2, 1, "assistant", None), (3, None, None, None)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3]) for r in rows[:3000]] and got[1].loss == "".join(r[3] for r in rows[1:3000:2])
    assert [t.text for t in got[2].turns if t.text] == [long, long] and got[2].loss == long
