import duckdb

from tripweave.llm import url_filters as uf

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host, tail = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    for c in "?#":
        tail = tail.split(c)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail


def plain_rule(host, path):
    fits = []
    for _, rule in RULES:
        domain, _, start = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            fits.append(rule)
    return max(fits, key=len, default=None)


URLS = [
    "https://a.example.org/es/1", "http://EXAMPLE.org/en/12?x=1", "http://example.org/en/2", "https://notexample.org/es/1", "http://x.com/fr/1",
    "http://com/fr/", "http://x.com/de", "http://x.com/de/#a", "no scheme", None, "", "://", "http://", "http://h?q=/fr/", "a://b://c/d", "http://ÀB.com/fr/é\nx",
    "http://x.com/de/1", "http://x.com/de/1", "ftp://user@X.org:80/p//q/", "http://example.org?en/1", "x\ny://m.example.org/en/1\n2",
]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(URLS)], "page_id long, url string, path string")
    rows = uf.judge(pages, spark.createDataFrame([], "page_id long, bad int"), RULES).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        host, path = plain_parts(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, plain_rule(host, path))
        assert r.verdict == (dict((b, a) for a, b in RULES)[r.rule] if r.rule else "allow")


def plain_templates(rows, min_labels, merge_z):
    """rows: (page, host, path, bad or None) -> template of each page."""
    work = {p: (h, [s for s in path.split("/") if s], "", bad) for p, h, path, bad in rows}
    for level in range(max(len(seg) for _, seg, _, _ in work.values())):
        kids, parents = {}, {}
        for h, seg, t, bad in work.values():
            if len(seg) > level:
                for d, key in ((kids, (h, t, seg[level])), (parents, (h, t))):
                    n = d.setdefault(key, [0, 0, 0])
                    n[0] += 1
                    n[1] += bad is not None
                    n[2] += bad or 0
        kept = set()
        for (h, t, s), (n, k, b) in kids.items():
            an, ak, ab = parents[h, t]
            if k >= min_labels and ak > k and 0 < ab < ak:
                p = ab / ak
                if abs(b / k - (ab - b) / (ak - k)) >= merge_z * (p * (1 - p) * (1 / k + 1 / (ak - k))) ** 0.5:
                    kept.add((h, t, s))
        work = {
            p: (h, seg, (t + "/" + (seg[level] if (h, t, seg[level]) in kept else "*")) if len(seg) > level else t, bad) for p, (h, seg, t, bad) in work.items()
        }
    return {p: (h, t) for p, (h, seg, t, _) in work.items()}


def test_template_tree_is_the_plain_one(spark):
    rows, n = [], 0
    for i in range(300):
        for path, bad in ((f"/spam/{i}/buy", 1 if i % 10 else 0), (f"/news/{i}", 0 if i % 12 else 1), (f"/news/{i}/a/b/c/d", None), ("/", 0)):
            rows.append((n, "site.net", path, bad))
            n += 1
    pages = spark.createDataFrame([(p, f"http://{h}{path}") for p, h, path, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(p, b) for p, _, _, b in rows if b is not None] + [(None, 1), (10**9, 1), (0, None)], "page_id long, bad int")
    got = {r.page_id: r for r in uf.judge(pages, labels, ()).collect()}
    want = plain_templates(rows, uf.MIN_LABELS, uf.MERGE_Z)
    assert {p: (r.host, r.template) for p, r in got.items()} == want
    assert got[0].template == "/spam/*/*" and got[0].verdict == "block" and got[1].verdict == "allow" and got[2].template == "/news/*/*/*/*/*"


def test_small_branches_and_deep_ones_are_judged_by_their_labels(spark):
    """One bad branch in a hundred, and a bad branch that begins at the fifth segment."""
    rows = [(f"http://wide.net/b{i}/{k}", int(i in (7, 70)), k % 2 == 0) for i in range(100) for k in range(60)]
    rows += [(f"http://deep.net/a/{k}/c/d/{'bad' if k % 40 == 0 else 'good'}/x/{k}", int(k % 40 == 0), True) for k in range(2000)]
    pages = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, bad) for i, (_, bad, shown) in enumerate(rows) if shown], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in uf.judge(pages, labels, ()).collect()}
    assert got == {i: "block" if bad else "allow" for i, (_, bad, _) in enumerate(rows)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert uf.judge(none, spark.createDataFrame([], "page_id long, bad int")).count() == 0


def test_plan_runs_no_python(spark, data):
    from tripweave.llm.queries import QUERIES

    plan = QUERIES["op2_url_filters"](spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_queries_with_sql(spark, data):
    from tripweave.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, data)
        cur = con.execute(sql)
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, cur.fetchall()))
