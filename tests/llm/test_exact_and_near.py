import hashlib
import random
import re

from loomgraph.llm import near_dedup
from loomgraph.llm.components import components
from loomgraph.llm.exact_dedup import exact_groups, without_copies
from tests.llm.helpers import ODD, by_id, documents, empty, rows


def test_exact_groups_equal_plain_grouping(spark):
    got = rows(exact_groups(documents(spark)))
    assert len(got) == len(ODD)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for r in got:
        if r["doc_id"] is None:
            assert r["kept"] is True and r["keep_id"] is None
            continue
        text = next(t for i, t, *_ in ODD if i == r["doc_id"])
        mates = [(-len(t or ""), i) for i, t, *_ in ODD if i is not None and norm(t) == norm(text)]
        assert r["group_size"] == len(mates)
        assert r["keep_id"] == min(mates)[1]
        assert r["kept"] == (r["keep_id"] == r["doc_id"])
        assert r["text_sha256"] == hashlib.sha256(norm(text).encode()).hexdigest()


def test_without_copies_keeps_one_of_each(spark):
    assert sorted(r["doc_id"] for r in rows(without_copies(documents(spark))) if r["doc_id"]) == [2, 3, 6, 7, 9, 10, 11]
    assert [r["text"] for r in rows(without_copies(documents(spark))) if r["doc_id"] is None] == ["no id"]
    assert rows(exact_groups(empty(spark))) == []


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def plain_components(docs, n):
    sets = {i: shingles(t, n) for i, t in docs}
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_groups_equal_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for base in range(12):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice((6, 40, 120)))]
        for _ in range(rnd.choice((1, 4, 25))):
            copy = list(words)
            for _ in range(rnd.randint(0, max(1, len(copy) // 12))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            docs.append((len(docs) * 3 % 1009, " ".join(copy)))
    docs += [(5000, ""), (5001, None), (5002, "One"), (5003, "one"), (5004, "two")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for settings in (near_dedup.Settings(words=2), near_dedup.Settings(words=2, block=4, few_bytes=0), near_dedup.Settings()):
        want = plain_components(docs, settings.words)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(near_dedup.near_groups(df, settings))}
        assert got == want


def test_near_groups_take_odd_rows(spark):
    got = rows(near_dedup.near_groups(documents(spark), near_dedup.Settings(words=2)))
    assert len(got) == len(ODD)
    own = {r["doc_id"]: r for r in got}
    assert own[4]["component_id"] == 4 and own[5]["component_id"] == 5 and own[4]["n_shingles"] == 0
    assert own[8]["component_id"] == 7 and own[2]["component_id"] == 1
    assert own[None]["component_id"] is None and own[None]["kept"]
    assert rows(near_dedup.near_groups(empty(spark))) == []


def test_index_keys_find_all_signatures_below_the_threshold():
    import numpy as np

    s = near_dedup.Settings()
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, (200, s.chunks * s.slots), dtype=np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(len(row), s.chunks * (s.errors + 1) - 1, replace=False)] += 1
    assert all(set(x) & set(y) for x, y in zip(near_dedup.index_keys(a, s).tolist(), near_dedup.index_keys(b, s).tolist()))


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["part"] for r in rows(components(spark.createDataFrame(links, "a long, b long")))}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
    assert rows(components(spark.createDataFrame([], "a long, b long"))) == []
    assert by_id  # imported for other tests


def test_without_copies_keeps_each_text_of_a_repeated_id(spark):
    docs = [(1, "alpha"), (1, "beta"), (2, "gamma"), (2, "al pha"), (3, "beta"), (None, "delta"), (None, "delta"), (None, "gamma"), (1, "be  ta"), (1, "be  ta")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS __hash", "'y' AS norm", "1 AS id")
    got = without_copies(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in rows(got)), key=str) == [(1, "be  ta"), (2, "al pha"), (2, "gamma"), (None, "delta")]


def test_near_dedup_takes_an_id_with_different_texts(spark):
    one, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = [(2, one + " x"), (5, one), (5, other), (5, one), (7, other + " y"), (8, "alone"), (8, "alone"), (8, "and another"), (9, None), (None, one)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS mark", "2 AS node")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in rows(near_dedup.near_groups(df, near_dedup.Settings(words=2))))
    assert got == [(0, 0, True), (2, 2, True), (5, 2, False), (5, 2, False), (5, 5, True), (7, 5, False), (8, 8, True), (8, 8, True), (8, 8, True), (9, 9, True)]
    left = near_dedup.without_near_copies(df, near_dedup.Settings(words=2))
    assert left.columns == df.columns
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in rows(left))
    assert left == [(0, one), (2, one + " x"), (5, other), (8, "alone"), (8, "and another"), (9, "")]
    twice = spark.createDataFrame([(5, one), (5, one + " x"), (6, one + " y"), (6, "word")], "doc_id long, text string")
    least = min((one, one + " x"), key=lambda t: hashlib.md5(t.encode()).digest())
    assert sorted((r["doc_id"], r["text"]) for r in rows(near_dedup.without_near_copies(twice))) == [(5, least), (6, "word")]


def test_all_links_of_a_whole_table_are_found(spark):
    """Every link of sf0.01, by brute force over all pairs that can be links by their sizes."""
    from loomgraph.llm.common import table

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = by_id(near_dedup.near_groups(docs, near_dedup.Settings(words=2)))
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        w = re.findall("[^\x20\x09-\x0d]+", (r["text"] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[r["doc_id"]] = {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()
    order = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            if 100 * len(sets[a]) < 80 * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(v), top(i)) for i, v in sets.items()}
    assert sum(top(i) != i for i in sets) > 50


def test_unlike_documents_that_share_keys_make_no_candidate_part(spark, monkeypatch):
    """keys that chain unlike documents together join no sets to compare; whole sets were dealt out for each block of such a part."""
    import numpy as np

    from loomgraph.llm import near_dedup

    ok = np.zeros((6, 6), bool)
    for i, j in ((0, 3), (3, 5), (1, 2)):
        ok[i, j] = ok[j, i] = True
    assert sorted(near_dedup.spanned(ok)) == [(0, 3), (0, 5), (1, 2)]
    sizes, confirmed = [], near_dedup.confirmed
    monkeypatch.setattr(near_dedup, "confirmed", lambda c, *rest: sizes.append(c.count()) or confirmed(c, *rest))
    docs = [(i, " ".join(f"w{k}" for k in range(i * 86, i * 86 + 200))) for i in range(60)]  # 40 percent shared with the next
    got = near_dedup.near_groups(spark.createDataFrame(docs, "doc_id long, text string"), near_dedup.Settings(words=2)).collect()
    assert all(r["kept"] for r in got) and len(got) == 60 and sum(sizes) < 10
