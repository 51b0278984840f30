"""Leases in a batch and as a stream, admission against a loop, snapshots that are killed, near misses by the plain rule."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from leafproof.operators import ingest, nearmiss, phrases
from leafproof.sources import snapshots, store
from leafproof.streaming import control as C

HOUR = 3_600_000


def states(rows):
    return sorted((r.run, r.event_id, r.ms, r.kind, r.outcome, r.state, r.owner, r.expires) for r in rows)


def test_leases_step_by_step(spark):
    log = [("start", 0, "a", False, "", "ok"), ("claim", 1, "b", False, "", "lease_held"), ("renew", 2, "b", False, "", "not_the_holder"), ("renew", HOUR - 1, "a", False, "", "ok"),
           ("claim", HOUR + 5, "b", True, "", "stolen"), ("stop", HOUR + 6, "a", False, "", "not_the_holder"), ("override", HOUR + 7, "a", False, " ", "override_reason_required"),
           ("override", HOUR + 8, "a", False, "seen", "ok"), ("claim", 3 * HOUR, "a", False, "", "ok"), ("fail", 3 * HOUR + 1, "a", False, "", "ok"), ("renew", 3 * HOUR + 2, "a", False, "", "not_the_holder")]
    rows = [("r", n, ms, kind, owner, steal, why) for n, (kind, ms, owner, steal, why, _) in enumerate(log)] + [("q", 50, 5, "claim", "a", False, ""), ("q", 51, 6, "start", "a", False, "")]
    got = states(C.replayed(spark.createDataFrame(rows, C.COMMANDS), horizon=9 * HOUR).collect())
    assert [r[4] for r in got if r[0] == "r" and r[1] >= 0] == [x[-1] for x in log]
    lapses = [r for r in got if r[1] == -1]
    assert [(r[0], r[2]) for r in lapses] == [("q", HOUR + 6), ("r", 2 * HOUR + 5)]  # at the end of the log, and before the next command
    assert ("r", 9, 3 * HOUR + 1, "fail", "ok", "failed", "", 0) in got and ("q", 50, 5, "claim", "run_unknown", None, "", 0) in got


def test_stream_and_batch_end_alike(spark, tmp_path):
    rng = random.Random(6)
    rows, at = [], 1_700_000_000_000
    for n in range(300):
        at += rng.randint(1, 20) * 60_000
        rows.append((f"r{rng.randint(0, 5)}", n, at, rng.choice(["start", "claim", "renew", "stop", "fail", "override"]), rng.choice("ab"), rng.random() < 0.2, rng.choice(["", "why"])))
    log = spark.createDataFrame(rows, C.COMMANDS).withColumn("at", F.timestamp_millis("ms"))
    for k in range(3):  # three files in order of time, so three batches or fewer
        log.filter(f"event_id >= {k * 100} and event_id < {k * 100 + 100}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = C.streamed(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = states(spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == states(C.replayed(log, horizon=at).collect()) and any(r[1] == -1 for r in got)


def test_admission_equals_a_loop(spark):
    rng = random.Random(9)
    rows = [(rng.randint(1, 3), rng.choice(["d1", "d2"]), rng.randint(0, 3), rng.randint(0, 40), n) for n in range(200)]
    got = {r.call_id: (r.admitted, r.reason, r.reads_remaining) for r in C.admitted(spark.createDataFrame(rows, "caller long, period string, question long, at long, call_id long"), 5, 2).collect()}
    spent, asked = {}, {}
    for caller, period, question, _, n in sorted(rows, key=lambda r: (r[3], r[4])):
        who, q = (caller, period), (caller, period, question)
        ok = spent.get(who, 0) < 5 and asked.get(q, 0) < 2
        if ok:
            spent[who], asked[q] = spent.get(who, 0) + 1, asked.get(q, 0) + 1
        assert got[n][0] == ok, n
        assert (got[n][1] is None) == ok and got[n][2] == min(5 - spent.get(who, 0), 2 - asked.get(q, 0)), n


PAGE = "page_id string, doc_id string, revision string, n int"


def run_pages(spark, revision, pages, docs=("A", "B")):
    return spark.createDataFrame([(f"{d}@{revision}#{n}", d, revision, n) for d in docs for n in pages], PAGE)


def verdict(spark, *rows):
    return spark.createDataFrame([(d, r, ok, ["f"]) for d, r, ok in rows], "doc_id string, revision string, publish boolean, flags array<string>")


def seen(shots):
    return sorted((r.page_id, r.run, r.is_current) for r in shots.pages().collect())


def fresh(spark, name):
    return snapshots.Snapshots(spark, f"{store.shared_dir(spark)}/leafproof/{name}-{time.time_ns()}", PAGE)


def publish_all(spark, shots):
    ok1 = verdict(spark, ("A", "1", True), ("B", "1", True))
    ok2 = verdict(spark, ("A", "2", True), ("B", "2", False))
    shots.publish("r1", run_pages(spark, "1", [1, 2]), ok1)
    shots.publish("r2", run_pages(spark, "2", [1, 2, 3]), ok2)
    return shots.publish("r3", run_pages(spark, "2", [1, 2]), ok2)


def test_publish_flips_retires_and_records(spark):
    shots = fresh(spark, "pub")
    record = {r.doc_id: r for r in publish_all(spark, shots).collect()}
    want = [("A@1#1", "r1", False), ("A@1#2", "r1", False), ("A@2#1", "r3", True), ("A@2#2", "r3", True), ("B@1#1", "r1", True), ("B@1#2", "r1", True)]
    assert seen(shots) == want  # B's new revision is held back: its old one stays current
    a, b = record["A"], record["B"]
    assert (a.published, a.pages_indexed, a.deleted_stale, a.superseded_demoted, a.other_revision_kept) == (True, 2, 1, 0, 2)
    assert (b.published, b.pages_indexed, b.deleted_stale) == (False, 0, 0)
    versions = shots.versions()
    publish_all(spark, shots)  # once more: nothing changes, and an old run does not come back
    assert seen(shots) == want and shots.versions() == versions and shots.stale_runs() == ["r2"]
    assert sorted(r.page_id for r in shots.pages(1).collect()) == ["A@1#1", "A@1#2", "B@1#1", "B@1#2"]  # earlier versions can be read


@pytest.mark.parametrize("killed_at", ["stage", "commit", "record"])
def test_a_killed_run_shows_nothing_until_it_is_run_again(spark, monkeypatch, killed_at):
    shots, ok = fresh(spark, killed_at), verdict(spark, ("A", "1", True), ("B", "1", True))
    real = store.put

    def dies(session, path, df, *args, **kw):
        if {"stage": "/pages/", "commit": "/pointer/", "record": "/runs/"}[killed_at] in path:
            raise KeyboardInterrupt
        return real(session, path, df, *args, **kw)

    monkeypatch.setattr(store, "put", dies)
    with pytest.raises(KeyboardInterrupt):
        shots.publish("r1", run_pages(spark, "1", [1]), ok)
    assert len(seen(shots)) == (2 if killed_at == "record" else 0)
    monkeypatch.setattr(store, "put", real)
    record = shots.publish("r1", run_pages(spark, "1", [1]), ok)
    assert [p for p, _, _ in seen(shots)] == ["A@1#1", "B@1#1"] and record.count() == 2 and len(shots.versions()) == 1


def test_two_runs_that_commit_at_once(spark):
    shots, bad = fresh(spark, "race"), []

    def go(doc):
        try:
            shots.publish(f"r{doc}", run_pages(spark, "1", [1], [doc]), verdict(spark, (doc, "1", True)))
        except Exception as e:  # noqa: BLE001
            bad.append(e)

    threads = [threading.Thread(target=go, args=(d,)) for d in "ABC"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not bad and [p for p, _, _ in seen(shots)] == ["A@1#1", "B@1#1", "C@1#1"]


def test_near_misses_follow_the_sequential_rule(spark):
    tokens = ["k78", "k79", "k7", "abc1", "555", "556", "x9z"]
    texts = ["k78 k79", "k 75 and k77", "555 x9z 55a"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string").withColumn("norm", F.concat(F.lit(" "), "text", F.lit(" ")))
    inventory = spark.createDataFrame([(t,) for t in tokens], "token string")
    printed = lambda f: any(f" {s} " in f" {t} " for t in texts for s in {" ".join(w) for w in phrases.label_words(f)})

    def mutations(token):
        return [(token[:p] + ch + token[p + 1 :], p) for ch in "0123456789abcdefghijklmnopqrstuvwxyz" for p in reversed(range(len(token))) if ch != token[p]]

    lists, want, taken, turn = {t: mutations(t) for t in sorted(tokens) if len(t) >= 3}, [], set(), 0
    while len(want) < 40 and lists:
        turn += 1
        for t in sorted(lists):
            ok = next(((f, p) for f, p in lists[t] if f not in tokens and f not in taken and not printed(f)), None)
            if ok and len(want) < 40:
                taken.add(ok[0])
                want.append((t, *ok, turn))
    positions = phrases.positions_of(df, "row_id")
    got = sorted(((r.source, r.fake, r.position, r.turn) for r in nearmiss.near_misses(inventory, positions, 40).collect()), key=lambda r: (r[3], r[0]))
    assert got == want and "k75" not in {g[1] for g in got}  # printed as two tokens
    assert [r.turn for r in nearmiss.near_misses(inventory, positions, 2).collect()] == [1, 1]


def test_two_thousand_windows_find_their_places(spark):
    n, width = 2000, 30
    rows = spark.range(n * width).select(F.lit("d").alias("doc_id"), (F.col("id") + 1).cast("int").alias("page_no"), F.when(F.col("id") % 5 != 0, F.col("id").cast("string")).alias("label"))
    forms = rows.select("doc_id", F.floor((F.col("page_no") - 1) / width).alias("win"), ((F.col("page_no") - 1) % width + 1).alias("at"), F.when((F.col("page_no") - 1) / width < n - 1, F.col("label")).alias("label"))
    known = rows.filter(f"label is not null and page_no <= {(n - 1) * width}")  # nothing is known of the last window
    out = ingest.tilings(forms, known, spark.createDataFrame([("d", n * width)], "doc_id string, pages long"))
    r = out.agg(F.count("*").alias("n"), F.min("found").alias("a"), F.max("found").alias("b"), F.count_if(F.col("start") == F.col("win") * width + 1).alias("right")).first()
    assert (r.n, r.a, r.b, r.right) == (n, 1, 1, n)
