"""The file scan and the audit stream."""

import hashlib
import json

from leafproof.sources import files
from leafproof.streaming import audit


def test_files_become_pages(spark, tmp_path):
    (tmp_path / "M1@1.0.txt").write_text("first\fsecond")
    (tmp_path / "M2@0.9.txt").write_text("")
    got = {(r.page_id, r.text, r.sha256) for r in files.scan(spark, str(tmp_path)).collect()}
    one = hashlib.sha256(b"first\fsecond").hexdigest()
    assert got == {("M1@1.0#p001", "first", one), ("M1@1.0#p002", "second", one)}  # an empty file has no page


def test_budget_stream_counts_paid_calls_by_day(spark, tmp_path):
    lines = [{"event_id": k, "ts": f"2024-01-0{1 + k % 2}T10:00:00Z", "user_id": k % 3, "event_type": "purchase" if k % 4 else "view", "value": 1.0, "props": "{}"} for k in range(24)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    stream = audit.spent(audit.read(spark, str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("spent").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {}
    for e in lines:
        if e["event_type"] == "purchase":
            key = (e["user_id"], e["ts"][:10])
            want[key] = want.get(key, 0) + 1
    assert {(r.user_id, r.period): r.spent for r in spark.table("spent").collect()} == want


def test_audit_lines_have_ten_fields_and_are_written_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    calls = [{"user_id": f"u{k}", "tool": t, "page_ids": ["a", "b"], "dpi": 150 if k else None, "secret": "x"} for k, t in enumerate(["read", "fetch", "lookup", "read"])]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, calls)))
    schema = "user_id string, tool string, page_ids array<string>, dpi int, secret string"
    for _ in range(2):  # a second run finds nothing new
        audit.sink(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted(r["user_id"] for r in got) == ["u0", "u1", "u3"] and all(len(r) == 10 and "secret" not in r for r in got)
    assert {r["user_id"]: r["dpi"] for r in got} == {"u0": 0, "u1": 150, "u3": 150}


def test_uploads_are_judged_by_their_bytes(spark, tmp_path):
    for name, body in (("a.pdf", b"%PDF-1.7 x"), ("b.pdf", b"hello"), ("c.pdf", b""), ("d.pdf", b"%PDF-" + b"x" * 200)):
        (tmp_path / name).write_bytes(body)
    got = {r.path[-5:]: r.error for r in files.check_uploads(spark, str(tmp_path), most=100).collect()}
    assert got == {"a.pdf": None, "b.pdf": "not_a_pdf", "c.pdf": "empty_upload", "d.pdf": "upload_too_large"}
    assert files.spool_name("../My file (2).PDF", "r1") == "My-file-2.pdf" and files.spool_name("...", "r1") == files.spool_name("", "r1") == "r1.pdf"


def test_hand_written_pages_answer_as_their_table_says(spark, tmp_path):
    """An acceptance table over pages in files: expected and observed rows are compared by one join."""
    from pyspark.sql import functions as F

    from leafproof.operators import exact

    (tmp_path / "document.json").write_text(json.dumps({"doc_id": "T-1", "revision": "2", "doc_type": "list", "title": "t"}, indent=1))
    pages = [
        {"page_no": 1, "section": "s", "text": "Stop AB 2.2C by relay R77"}, {"page_no": 2, "section": "s", "text": "2.2C is not AB here"}, {"page_no": 3, "section": "s", "text": "", "codes": ["R9"]},
        {"page_no": 4, "section": "s", "text": "R500 R77x", "text_trust": "untrusted"}, {"page_no": 1, "section": "s", "text": "old R88", "revision": "1"}, {"page_no": 5, "section": "s", "text": "switch G 12"},
    ]
    for k, p in enumerate(pages):
        (tmp_path / f"page-{k:03d}.json").write_text(json.dumps(p, indent=1))
    p = files.fixture(spark, str(tmp_path)).withColumn("lang", F.lit("en"))
    rows = [("AB 2.2C", "ok", 1, 0), ("R 77", "ok", 1, 0), ("R500", "not_found", 0, 1), ("R88", "not_found", 0, 0), ("G12", "ok", 1, 0), ("AB2.2C", "not_found", 0, 0), ("R9", "not_found", 0, 0)]
    expected = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "item_id long, claim string, status string, total long, unverified long")
    observed = exact.lookup_summary(p, expected.select("item_id", "claim"))
    both = expected.alias("e").join(observed.alias("o"), "item_id").select("e.claim", *[(F.col(f"e.{c}") == F.col(f"o.{c}")).alias(c) for c in ("status", "total", "unverified")])
    assert {tuple(r)[1:] for r in both.collect()} == {(True, True, True)}
    for page, want in ((3, "not_searchable"), (4, "not_searchable"), (2, "not_found"), (9, "out_of_scope")):
        scoped = exact.lookup_summary(exact.scope(p, {"page_no": page}), expected.filter("item_id = 2").select("item_id", "claim"))
        assert [r.status for r in scoped.collect()] == [want]
    assert [r.page_id for r in exact.lookup_hits(p, "AB 2.2C").collect()] == ["T-1@2#p001"]


def test_page_tables_replace_documents_and_refuse_doubles(spark):
    from leafproof.sources import tables

    tables.create(spark, "pages_t", "page_id string, text string, doc_id string", replace=True)
    tables.create(spark, "pages_t", "page_id string, text string, doc_id string")  # stays
    df = lambda rows: spark.createDataFrame(rows, "page_id string, doc_id string, text string")
    tables.upsert(df([("a1", "a", "x"), ("a2", "a", "y"), ("b1", "b", "z")]), "pages_t")
    tables.upsert(df([("a1", "a", "new")]), "pages_t")
    assert sorted((r.page_id, r.text) for r in spark.table("pages_t").collect()) == [("a1", "new"), ("b1", "z")]
    for bad in ([("c1", "c", "x"), ("c1", "c", "y")], [(None, "c", "x")]):
        try:
            tables.upsert(df(bad), "pages_t")
            raise AssertionError("a double was written")
        except tables.DuplicatePage:
            pass
    assert spark.table("pages_t").count() == 2
    spark.sql("DROP TABLE pages_t")


def test_the_cache_keeps_the_first_answer(spark):
    import datetime

    from leafproof.sources import tables

    tables.create(spark, "cache_t", tables.CACHE_SCHEMA, partition=None, replace=True)
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    entries = spark.createDataFrame([("k", "late", at(5)), ("k", "first", at(1)), ("j", "only", at(2))], tables.CACHE_SCHEMA)
    tables.put(entries, "cache_t")
    got = {r.key: r.body for r in tables.get(spark.createDataFrame([("k",), ("x",), ("j",)], "key string"), "cache_t").collect()}
    assert got == {"k": "first", "j": "only", "x": None}
    spark.sql("DROP TABLE cache_t")


def test_calls_are_refused_by_the_first_bound_they_break(spark):
    from pyspark.sql import functions as F

    from leafproof.operators import caps

    base = {"tool": "read", "pages": 1, "question": "q", "reads": 1, "dpi": 150, "region": None, "megapixels": 1.0, "claims": 1, "limit": 10, "cap": 20, "label": "K1", "scope": ["doc_id"]}
    cases = [
        ({}, None), ({"pages": 0}, "read_empty"), ({"pages": 4}, "read_page_cap_exceeded"), ({"question": " "}, "read_question_missing"), ({"reads": 0}, "budget_exhausted"),
        ({"tool": "fetch", "pages": 0}, "fetch_empty"), ({"tool": "fetch", "pages": 6}, "fetch_budget_exceeded"), ({"tool": "fetch", "dpi": 100}, "dpi_not_allowed"), ({"tool": "fetch", "dpi": 300}, "dpi_requires_region"),
        ({"tool": "fetch", "dpi": 300, "region": [0.0, 0.0, 1.0, 1.0]}, None), ({"tool": "fetch", "region": [0.0, 0.0, 2.0, 1.0]}, "region_invalid"), ({"tool": "fetch", "region": [0.5, 0.0, 0.5, 1.0]}, "region_invalid"),
        ({"tool": "fetch", "region": [0.0, 0.1]}, "region_invalid"), ({"tool": "fetch", "megapixels": 12.1}, "fetch_budget_exceeded"), ({"tool": "fetch", "question": " ", "reads": 0}, None),
        ({"tool": "verify", "claims": 0}, "verify_empty"), ({"tool": "verify", "claims": 100, "pages": 3}, "verify_budget_exceeded"), ({"tool": "skim", "limit": 26}, "limit_out_of_range"), ({"tool": "skim", "limit": 0}, "limit_out_of_range"),
        ({"tool": "skim", "question": ""}, "query_required"), ({"tool": "skim", "scope": ["colour"]}, "filter_unknown_key"), ({"tool": "lookup", "label": ""}, "label_empty"), ({"tool": "lookup", "cap": 0}, "cap_out_of_range"),
    ]
    schema = "k int, tool string, pages int, question string, reads int, dpi int, region array<double>, megapixels double, claims int, limit int, cap int, label string, scope array<string>"
    df = spark.createDataFrame([(k, *(base | c).values()) for k, (c, _) in enumerate(cases)], schema)
    got = {r.k: r.e for r in df.select("k", caps.refusal({c: F.col(c) for c in base}).alias("e")).collect()}
    assert [got[k] for k in range(len(cases))] == [w for _, w in cases]
