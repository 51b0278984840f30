"""Host reputation against a direct computation, and the edges of the rules."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from leafproof.llm import urls

RULES = [urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/")]


def prior(groups, least=1.0, most=1000.0):
    """groups: (n, bad, parent's mean)."""
    g = [(n, b, m) for n, b, m in groups if n and 0 < m < 1]
    if not g:
        return most
    s = sum(n * (b / n - m) ** 2 / (m * (1 - m)) for n, b, m in g)
    t, t2, k = sum(x[0] for x in g), sum(x[0] ** 2 for x in g), len(g)
    room = t - t2 / t - (k - 1)
    rho = (s - (k - 1)) / room if room > 0 else 0
    return min(most, max(least, (1 - rho) / rho)) if rho > 0 else most


def brute(rows, p):
    host = collections.defaultdict(lambda: [0, 0])
    for h, b in rows:
        if b is not None:
            host[h][0] += 1
            host[h][1] += b
    up = {h: (".".join(h.split(".")[-2:]), h.split(".")[-1]) for h in host}
    dom, suf = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(lambda: [0, 0])
    for h, (n, b) in host.items():
        for d, k in ((dom, up[h]), (suf, up[h][1])):
            d[k][0] += n
            d[k][1] += b
    n, b = (sum(x[i] for x in suf.values()) for i in (0, 1))

    def level(groups, parent):
        w = prior([(*v, parent[k][0]) for k, v in groups.items()])
        out = {}
        for k, (n, b) in groups.items():
            m, weight = parent[k]
            own = min(w, max(0.0, weight - n))  # a prior rests on other pages than the group's
            out[k] = ((b + own * m) / (n + own), n + own)
        return out

    s = level(suf, {k: (b / n, n) for k in suf})
    d = level(dom, {k: s[k[1]] for k in dom})
    out = {h: (m, max(0.0, m - p.z * math.sqrt(m * (1 - m) / (k + 1)))) for h, (m, k) in level(host, {h: d[up[h]] for h in host}).items()}
    return out


def test_reputation_equals_a_direct_computation(spark):
    rows = [(f"h{k % 7}.d{k % 3}.{'net' if k % 2 else 'org'}", int(k % 7 == 3 or k % 11 == 0) if k % 5 else None) for k in range(300)]
    hosts, _ = urls.host_reputation(spark.createDataFrame(rows, "host string, bad int"))
    want = brute(rows, urls.Reputation())
    got = {r.host: (r.bad_mean, r.bad_bound) for r in hosts.collect()}
    assert got.keys() == want.keys()
    for h in want:
        assert got[h] == pytest.approx(want[h], abs=1e-9)


def test_edges(spark):
    rows = [
        (1, "http://A.Example.COM/en/x?q", "com rule loses"), (2, "http://www.example.com/en/", ""), (3, "https://a.b.com/", ""), (4, "https://a.b.com", ""),
        (5, None, ""), (6, "no scheme", ""), (7, "x://h#f", ""), (8, "http://notexample.com/en/1", ""), (9, "a://b://c/en/", ""), (None, "http://z.net/p", ""), (1, "http://A.Example.COM/en/x?q", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").withColumn("n", F.lit(1))
    outcomes = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (77, None)], "page_id long, bad int")
    got = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, outcomes, RULES).collect())
    assert len(got) == len(rows)
    by = {g[0]: g[1:] for g in got}
    assert by["1"] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert by["2"][2:] == ("www.example.com/en/", "allow") and by["3"][2] == "com/" and by["4"][2] is None
    assert by["5"][:2] == ("", "") == by["6"][:2] and by["7"][:2] == ("h", "") and by["8"][2] == "com/"
    assert by["9"][:2] == ("b:", "//c/en/") and by["None"][:2] == ("z.net", "/p")
    none = urls.filter_urls(pages, outcomes.limit(0), RULES)
    assert {r.verdict for r in none.filter("rule is null").collect()} == {"allow"}
    assert urls.filter_urls(pages.limit(0), outcomes, RULES).count() == 0


def test_a_bad_host_is_blocked_and_a_small_one_is_not(spark):
    pages = [(k, f"http://{'spam.x.net' if k < 40 else 'ok.y.org' if k < 300 else 'new.z.org'}/p") for k in range(302)]
    bad = [(k, int(k < 40 or k == 301)) for k in range(302)]
    out = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int"), RULES)
    assert {(r.host, r.verdict) for r in out.collect()} == {("spam.x.net", "block"), ("ok.y.org", "allow"), ("new.z.org", "allow")}


def test_an_unlabelled_host_has_its_parents_posterior(spark):
    at = lambda k: "a.spam.net" if k < 60 else "b.spam.net" if k < 120 else "ok.fine.org"
    pages = [(k, f"http://{at(k)}/p") for k in range(600)] + [(900, "http://new.spam.net/p"), (901, "http://new.other.net/p"), (902, "http://new.fine.org/p"), (903, "http://x.y.zz/p")]
    bad = [(k, int(k < 120)) for k in range(600)]
    out = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int"), RULES)
    got = {r.page_id: r for r in out.collect()}
    assert len(got) == len(pages) and [got[k].verdict for k in (900, 901, 902, 903)] == ["block", "block", "allow", "allow"]
    assert got[900].bad_mean > 0.9 and got[901].bad_mean > 0.5 and got[902].bad_mean < 0.1 and got[903].bad_mean == pytest.approx(0.2)
    assert all(got[k].n_labelled == got[k].n_bad == 0 for k in (900, 901, 902, 903))


def test_the_query_equals_its_sql_with_second_level_suffixes(spark, tmp_path):
    import duckdb

    from leafproof.llm import oracles, queries

    hosts = ["a.x.co.uk", "b.x.co.uk", "c.y.co.uk", "co.uk", "new.x.co.uk", "z.uk", "d.w.com.au", "e.w.com.au", "w.com.au", "plain", "", "a.b.net", "c.b.net", "q.r.s.t.net", "n.t.net"]
    pages = [(k, f"http://{hosts[k % len(hosts)]}/{'en' if k % 2 else 'es'}/p{k}") for k in range(600)] + [(700, None), (701, "x"), (702, "HTTP://A.X.CO.UK"), (None, "http://unseen.w.com.au/"), (703, "http://unseen.zz/")]
    labels = [(k, int(k % 4 != 1), int(hosts[k % len(hosts)].endswith("x.co.uk") and k % 3 > 0)) for k in range(0, 600, 2)] + [(701, 0, None), (702, None, None), (None, 0, 1)]
    spark.createDataFrame(pages, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    duck = duckdb.connect()
    for t in ("pages", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.op5_url_filters(spark, str(tmp_path))
    want = duck.execute(oracles.OP5)
    names = [d[0] for d in want.description]
    shown = lambda row: tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in row)
    assert sorted(map(shown, got.select(names).collect())) == sorted(map(shown, want.fetchall()))
    by = {r.page_id: r for r in got.collect()}
    assert by[702].n_labelled == by[0].n_labelled > 0 and len(by) == len({p for p, _ in pages})
    r = spark.createDataFrame([(h,) for h in ("a.x.co.uk", "co.uk", "z.uk", "w.com.au", "h", "")], "h string").select(urls.domain_of(F.col("h")).alias("d"), urls.suffix_of(F.col("h")).alias("s")).collect()
    assert [(x.d, x.s) for x in r] == [("x.co.uk", "co.uk"), ("co.uk", "co.uk"), ("z.uk", "uk"), ("w.com.au", "com.au"), ("h", "h"), ("", "")]


def test_of_rules_of_one_length_the_first_decides(spark):
    rules = [urls.Rule("block", "b.net", "/x/"), urls.Rule("allow", "b.net", "/x/"), urls.Rule("allow", "net", "/xy/x")]
    rule, verdict = urls.best_rule(F.lit("a.b.net"), F.lit("/x/y"), rules)
    other, allowed = urls.best_rule(F.lit("a.b.net"), F.lit("/x/y"), rules[::-1])
    r = spark.range(1).select(rule.alias("r"), verdict.alias("v"), other.alias("o"), allowed.alias("a")).first()
    assert (r.r, r.v, r.o, r.a) == ("b.net/x/", "block", "b.net/x/", "allow")


def test_the_plan_stays_small(spark):
    rows = [(f"h{k % 7}.d{k % 3}.net", k % 2) for k in range(50)]
    hosts, _ = urls.host_reputation(spark.createDataFrame(rows, "host string, bad int"), names=spark.createDataFrame([("new.d1.net",)], "host string"))
    plan = hosts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 30
