import random

import pytest

from loomgraph.operators import intervals, traverse


def plain(pairs):
    up = {}
    for c, p in pairs:
        if c != p:
            up.setdefault(c, set()).add(p)
    out = {}
    for start in up:
        level, seen, d = {start}, {start}, 0
        while level:
            d += 1
            level = {p for c in level for p in up.get(c, ())} - seen
            seen |= level
            out.update({(start, p): d for p in level})
    return out


@pytest.mark.parametrize("seed,several", [(1, 0.0), (2, 0.15)])
def test_labels_tell_who_is_above_whom(spark, monkeypatch, seed, several):
    monkeypatch.setattr(intervals, "FAMILY", 3)
    rnd = random.Random(seed)
    pairs = [(f"n{i}", f"n{rnd.randrange(i)}") for i in range(1, 60) if rnd.random() < 0.9]
    pairs += [(f"n{i}", f"n{rnd.randrange(i)}") for i in range(1, 60) if rnd.random() < several] + [("n3", "n3")]
    found = intervals.labels(spark.createDataFrame(pairs, "child string, parent string"))
    nodes = sorted({n for p in pairs for n in p})
    every = spark.createDataFrame([(a, b) for a in nodes for b in nodes], "node string, ancestor string")
    assert {(r["node"], r["ancestor"]): r["distance"] for r in intervals.above(every, found).collect()} == plain(pairs)
    assert found.intervals.count() == len(nodes)
    if not several:
        assert found.over.count() == 0


def test_cycles_have_no_interval(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("y", "z"), ("m", "a"), ("m", "z")]
    found = intervals.labels(spark.createDataFrame(pairs, "child string, parent string"))
    assert {r["node"] for r in found.intervals.collect()} == {"y", "z", "m"}
    asked = spark.createDataFrame([("y", "z"), ("m", "c"), ("m", "z"), ("x", "a"), ("z", "y")], "node string, ancestor string")
    assert {(r["node"], r["ancestor"], r["distance"]) for r in intervals.above(asked, found).collect()} == {("y", "z", 1), ("m", "c", 3), ("m", "z", 1)}
    none = intervals.labels(spark.createDataFrame([], "child string, parent string"))
    assert intervals.above(asked, none).count() == 0 and traverse.closure(none.over.toDF("child", "parent", "d")).count() == 0


def test_leaves_make_no_steps_of_the_tour(spark, monkeypatch):
    """where most nodes are leaves, round by round, pointer jumping is over the few that are left."""
    monkeypatch.setattr(intervals, "FAMILY", 4)
    pairs = [(f"o{i}", f"c{i % 40}") for i in range(400)] + [(f"c{i}", f"n{i % 4}") for i in range(40)] + [(f"n{i}", "r") for i in range(4)] + [("x", "r"), ("x", "n1"), ("p", "q"), ("q", "p"), ("o401", "q"), ("o402", "x")]
    seen, plain_ranks = [], intervals.ranked
    monkeypatch.setattr(intervals, "ranked", lambda steps: plain_ranks(seen.append(steps.count()) or steps))
    found = intervals.labels(spark.createDataFrame(pairs, "child string, parent string"))
    assert seen[0] < 20
    own = found.intervals.collect()
    ends = [r[e] for r in own if r["root"] == "r" for e in ("first", "last")]
    assert len(own) == 447 and len(set(ends)) == len(ends) == 2 * 445
    every = spark.createDataFrame([(a["node"], b) for a in own for b in ("r", "n0", "n1", "n2", "n3", "c1", "c5", "x", "o1", "q")], "node string, ancestor string")
    known = {k: d for k, d in plain(pairs).items() if k[1] in ("r", "n0", "n1", "n2", "n3", "c1", "c5", "x", "o1") and k[0] not in ("p", "q", "o401")}
    assert {(r["node"], r["ancestor"]): r["distance"] for r in intervals.above(every, found).collect()} == known
