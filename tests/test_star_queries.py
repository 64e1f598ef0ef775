import random
import re

from loomgraph.plans.star_queries import QUERIES


def stored(spark, folder, **tables):
    """The folder with each table, (rows, schema), as the queries read it."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_intervals_hold_all_events(spark, tmp_path):
    rnd = random.Random(5)
    events = [(i, rnd.randrange(3), rnd.choice("abc") if i < 150 else rnd.choice("cde"), i // 2, rnd.random() * 100) for i in range(300)]
    rnd.shuffle(events)
    want = []
    for user in range(3):
        own = [(e, kind) for e, u, kind, _, _ in sorted(events, key=lambda x: (x[3], x[0])) if u == user]
        assert len(own) > 60
        at = {}
        for nth, (_, kind) in enumerate(own):
            at.setdefault(kind, []).append(nth)
        want += [(e, kind) for nth, (e, _) in enumerate(own) for kind, where in at.items() if where[0] <= nth <= where[-1]]
    folder = stored(spark, tmp_path, events=(events, "event_id long, user_id long, event_type string, ts long, value double"))
    assert sorted(map(tuple, QUERIES["interval_assign"](spark, folder).collect())) == sorted(want)


def test_all_calls_are_possible_callers(spark, tmp_path):
    rnd = random.Random(6)
    items = [(rnd.randrange(40), rnd.randrange(200), rnd.randrange(1, 30)) for _ in range(200)]
    orders = [(k,) for k in range(35)]
    confirmed = {o for o, _, s in items if s == 3}
    want = {}
    for o, _, _ in items:
        if o < 35 and o not in confirmed:
            want[o] = want.get(o, 0) + 1
    folder = stored(spark, tmp_path, lineitem=(items, "l_orderkey long, l_partkey long, l_suppkey long"), orders=(orders, "o_orderkey long"))
    assert confirmed and dict(map(tuple, QUERIES["possible_callers_anti"](spark, folder).collect())) == want


def test_suffixes_of_all_paths_are_asked(spark, tmp_path):
    customers = [(i, i % 3, f"s{i % 2}", f"name {i % 8}") for i in range(1, 25)]
    paths = [f"r{n % 2}/n{n}/{segment}/{name}" for _, n, segment, name in customers]
    asked = {"/".join(p.split("/")[2:]) for p in paths}
    want = sorted((w, p, False) for w in asked for p in paths if p.endswith("/" + w))
    folder = stored(
        spark,
        tmp_path,
        customer=(customers, "c_custkey long, c_nationkey long, c_mktsegment string, c_name string"),
        nation=([(n, f"n{n}", n % 2) for n in range(3)], "n_nationkey long, n_name string, n_regionkey long"),
        region=([(r, f"r{r}") for r in range(2)], "r_regionkey long, r_name string"),
    )
    assert len(want) > len(asked) and sorted(map(tuple, QUERIES["lookup_suffix_match"](spark, folder).collect())) == want


def fit(call, folded, route):
    """The score of a pair by its definition; 0 for none."""
    if call == route:
        return 100
    if "{id}" in route and folded == route:
        return 95
    if "/" in (call, route):
        return 0
    a, b = call + "/", route + "/"
    return 50 if a.startswith(b) else 40 if b.startswith(a) else 35 if call.endswith(route) else 30 if route.endswith(call) else 0


def test_urls_and_hrefs_meet_the_routes_of_all_pages(spark, tmp_path):
    rnd = random.Random(8)
    path = lambda least: "".join(f"/{rnd.choice(['a', 'b', 'c', 'd', 'en', '7', '12'])}" for _ in range(rnd.randint(least, 4))) or "/"
    pages = [(i, path(2 * (i > 0)), [path(0) for _ in range(rnd.randint(0, 6))]) for i in range(40)]
    fold = lambda p: re.sub(r"(?<=/)[0-9]+(?=/|$)", "{id}", p)
    routes = {p for _, p, _ in pages} | {fold(p) for _, p, _ in pages}
    want = set()
    for i, own, hrefs in pages:
        for call in {own, *hrefs}:
            top = max(fit(call, fold(call), r) for r in routes)
            best = [r for r in routes if fit(call, fold(call), r) == top]
            if top:
                want.add((i, call, best[0] if len(best) == 1 else None, top))
    assert {s for *_, s in want} >= {100, 95, 50, 40, 35, 30} and any(r is None for _, _, r, _ in want)
    quote = ['href="%s"', "HREF='https://h.example%s?q=1'", "href = %s "]
    html = [" ".join(f"<a {quote[k % 3] % h}>x</a>" for k, h in enumerate(hrefs)) or None for *_, hrefs in pages]
    rows = [(i, f"http://h{i}.example{own}#top", h) for (i, own, _), h in zip(pages, html)]
    folder = stored(spark, tmp_path, pages=(rows, "page_id long, url string, html string"))
    got = [tuple(r) for r in QUERIES["url_match_scored"](spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_more_inherited_callers_than_an_answer_shows(spark, tmp_path):
    import duckdb

    from loomgraph.plans import workspace_queries

    folder = stored(
        spark,
        tmp_path,
        supplier=([(k, 3) for k in range(1, 61)], "s_suppkey long, s_nationkey int"),
        nation=([(3, 1)], "n_nationkey int, n_regionkey int"),
        region=([(1, "r")], "r_regionkey int, r_name string"),
    )
    db = duckdb.connect()
    for t in ("supplier", "nation", "region"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    for name in ("lookup_inherited_callers", "graph_calls_by_name"):
        got = sorted(map(tuple, workspace_queries.QUERIES[name](spark, folder).collect()))
        assert got == sorted(db.execute(workspace_queries.ORACLE_SQL[name]).fetchall()) and len(got) > 60
