"""Offsets, reattribution, extraction by halves, gates' decisions and numbering, on literal pages."""

import pytest
from pyspark.sql import functions as F

from leafproof.functions import text as T
from leafproof.operators import ingest
from leafproof.sources import store


def forms(spark, pages):
    """pages: (page_no, text, codes, label)."""
    df = spark.createDataFrame([("D", "1.0", *p) for p in pages], "doc_id string, revision string, page_no int, text string, codes array<string>, printed_label string")
    df = df.withColumn("page_id", T.page_id(F.col("doc_id"), F.col("revision"), F.col("page_no"))).withColumn("has_text", F.col("text") != "")
    return df.withColumn("norm", T.normal(F.col("text")))


def check(spark, labels, texts):
    rows = [(k + 1, t, [], label) for k, (t, label) in enumerate(zip(texts, labels))]
    r = ingest.offset_check(forms(spark, rows)).first()
    return r.confirmed, r.witnesses, r.shifted


@pytest.mark.parametrize(
    ("labels", "texts", "want"),
    [
        (["1", "2", "3"], ["p 1", "p 2", "p 3"], (3, 0, False)),
        (["2", "3", "4"], ["p 1", "p 2", "p 3"], (0, 2, True)),  # each label is on the page after
        (["1", "3", "3"], ["p 1", "p 2", "p 3"], (2, 1, False)),  # a lone witness among pages that confirm themselves
        (["", "3", None], ["p 1", "p 2", "p 3"], (0, 1, True)),  # a lone witness and nothing that speaks for the window
        (["9", "9", "9"], ["p 1", "p 2", "p 3"], (0, 0, False)),  # printed nowhere: misread
        (["1", "2", "3"], ["", "", ""], (0, 0, False)),
    ],
)
def test_offsets_are_told_by_labels(spark, labels, texts, want):
    assert check(spark, labels, texts) == want


def test_codes_move_to_the_one_neighbour_that_prints_them(spark):
    pages = [(1, "K1 here", ["K1", "K2", "K7"], None), (2, "K2 and K5", ["k2", "K9"], None), (3, "K3", ["K5", "K4", "K2"], None), (4, "K5 on both sides", [], None)]
    got = {(r.page_id[-1], r.code, r.moved_from and r.moved_from[-1], r.added, r.flag) for r in ingest.reattribute(forms(spark, pages)).collect()}
    assert got == {
        ("1", "K1", None, True, None), ("1", "K7", None, True, None), ("2", "k2", None, True, None), ("2", "K9", None, True, None), ("3", "K4", None, True, None),
        ("2", "K2", "1", False, "codes_reattributed"), ("2", "K2", "3", False, "codes_reattributed"), ("3", "K5", None, True, "ambiguous_reattribution"),
    }
    apart = ingest.reattribute(forms(spark, [(30, "x", ["K2"], None), (31, "K2", [], None)])).collect()
    assert [(r.page_id[-2:], r.moved_from) for r in apart] == [("30", None)]  # another window's page


def test_failing_windows_are_halved_down_to_single_pages(spark):
    windows = spark.createDataFrame([(1, 1, 8), (2, 1, 30)], "doc_id long, start int, stop int")
    bad = spark.createDataFrame([(1, 3), (1, 99)], "doc_id long, page_no int")
    got = sorted((r.doc_id, r.start, r.stop, r.state, r.calls) for r in ingest.extracted(windows, bad).collect())
    assert got == [(1, 1, 2, "ok", 3), (1, 3, 3, "window_unsplittable", 4), (1, 4, 4, "ok", 4), (1, 5, 8, "ok", 2), (2, 1, 30, "ok", 1)]


def test_windows_meet_bad_pages_without_a_row_for_each_page(spark):
    windows = [(d, s, min(s + 29, s + d % 30)) for d in range(40) for s in (1 + d, 31 + d, 90 - d)]
    bad = {(d, n) for d in range(40) for n in range(1, 130) if (d * 7 + n * n) % 23 == 0}

    def halved(d, a, b, calls=1):
        if not any((d, n) in bad for n in range(a, b + 1)):
            return [(d, a, b, "ok", calls)]
        if a == b:
            return [(d, a, b, "window_unsplittable", calls)]
        return halved(d, a, (a + b) // 2, calls + 1) + halved(d, (a + b) // 2 + 1, b, calls + 1)

    got = ingest.extracted(spark.createDataFrame(windows * 2, "doc_id long, start int, stop int"), spark.createDataFrame([*bad, *bad], "doc_id long, page_no int"))
    assert sorted((r.doc_id, r.start, r.stop, r.state, r.calls) for r in got.collect()) == sorted(x for w in set(windows) for x in halved(*w))
    wide = [(d, 1 + d, 97) for d in range(40)]  # more bits than one column has
    got_wide = ingest.extracted(spark.createDataFrame(wide, "doc_id long, start int, stop int"), spark.createDataFrame([*bad], "doc_id long, page_no int"), 97).collect()
    assert sorted((r.doc_id, r.start, r.stop, r.state, r.calls) for r in got_wide) == sorted(x for w in wide for x in halved(*w))
    assert "sequence(start" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_run_within_each_group_whatever_the_ranges(spark):
    rows = [(k, "a" if k % 3 else "b", None if k % 50 == 0 else "r") for k in range(500)]
    df = spark.createDataFrame(rows, "id long, d string, r string").repartition(7)
    got = {r.id: r.n for r in store.numbered(df, ["d", "r"], "id", "n").collect()}
    seen = {}
    for k, d, r in rows:
        seen[(d, r)] = seen.get((d, r), 0) + 1
        assert got[k] == seen[(d, r)]
    assert store.numbered(df.limit(0), ["d", "r"], "id", "n").count() == 0


def test_windows_find_their_places_by_labels(spark):
    def place(windows, labels, pages):
        forms = [(1, w, k + 1, x) for w, ls in enumerate(windows) for k, x in enumerate(ls)]
        f = spark.createDataFrame(forms, "doc_id long, win long, at int, label string")
        e = spark.createDataFrame([(1, n, x) for n, xs in labels.items() for x in xs], "doc_id long, page_no int, label string")
        got = ingest.tilings(f, e, spark.createDataFrame([(1, pages)], "doc_id long, pages long")).collect()
        return {r.win: r.start for r in got}, got[0].found

    assert place([["3", None], ["1", "2"], ["5"]], {1: ["1"], 3: ["x", "3"], 5: ["5"]}, 5) == ({0: 3, 1: 1, 2: 5}, 1)
    assert place([["a"], ["b"]], {}, 2) == ({0: None, 1: None}, 2)  # nothing tells them apart
    assert place([["a"], ["b"]], {1: ["b"]}, 2) == ({0: 2, 1: 1}, 1)
    assert place([["a"], [None]], {1: ["b"], 2: ["a"]}, 2) == ({0: None, 1: None}, 0)  # page 1 is known to be neither
    assert place([["a"]], {}, 3) == ({0: None}, 0)  # pages are left over


def test_scopes_are_read_from_words():
    from leafproof.operators import exact

    assert exact.parse_scope(["doc_id=D-1", "page_no=5", "lang=['en', 'de']", "a=b=c"]) == {"doc_id": "D-1", "page_no": 5, "lang": ["en", "de"], "a": "b=c"}
    for bad in ("doc_id", "=x"):
        with pytest.raises(exact.ScopeError):
            exact.parse_scope([bad])
