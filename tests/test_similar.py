"""Closest names against a plain loop."""

import random

from columbine.operators import similar
from columbine.operators.similar import closest_match


def plain(target, names):
    """names in order; (closest, score or None)"""
    best, score = None, 0.5
    for c in names:
        u, t = c.upper(), (target or "").upper()
        s = sum(ch in u for ch in t) / max(len(t), len(u), 1)
        if s > score:
            best, score = c, s
    if best is not None:
        return best, score
    return (names[0] if names else None), None


def check(spark, blocks, targets):
    cand = [(b, i, n) for b, names in blocks.items() for i, n in enumerate(names)]
    random.Random(3).shuffle(cand)
    c = spark.createDataFrame(cand, "tab string, ordinal int, candidate string")
    t = spark.createDataFrame([(i, *x) for i, x in enumerate(targets)], "id int, tab string, target string")
    got = {r.id: (r.closest, r.score) for r in closest_match(t, c, ["tab"]).collect()}
    assert len(got) == len(targets)
    for i, (b, target) in enumerate(targets):
        assert got[i] == plain(target, [n for n in blocks.get(b, []) if n is not None]), (b, target)


def test_random_names(spark):
    rnd = random.Random(7)
    word = lambda k: "".join(rnd.choice("ABCDEab_1é") for _ in range(rnd.randint(1, k)))
    blocks = {f"T{k}": [word(9) for _ in range(rnd.randint(1, 60))] for k in range(8)}
    check(spark, blocks, [(f"T{rnd.randrange(8)}", word(12)) for _ in range(400)])


def test_edges(spark):
    blocks = {"A": ["FIRST", None, "CUST_ID", "cust_id", "TSUC_DI", "X" * 300, ""], "Q": ["ONLY"]}
    check(spark, blocks, [("A", "CUSTID"), ("A", "cust_id"), ("A", "ZZZ"), ("A", ""), ("A", None), ("A", "XXXX"),
                          ("Q", "OTHER"), ("NONE", "X"), (None, "X"), ("A", "CUSTID"), ("A", "X" * 700)])


def test_no_candidates(spark):
    t = spark.createDataFrame([("A", "X")], "tab string, target string")
    c = spark.createDataFrame([], "tab string, ordinal int, candidate string")
    assert closest_match(t, c, ["tab"]).collect()[0][2:] == (None, None)
    assert closest_match(t.limit(0), c, ["tab"]).count() == 0


def test_no_all_pairs(spark):
    """Names without a rare character in common never meet."""
    names = [chr(65 + k // 5) * 6 + str(k % 5) for k in range(100)]
    c = spark.createDataFrame([("T", k, n) for k, n in enumerate(names)], "tab string, ordinal int, candidate string")
    t = spark.createDataFrame([("T", n) for n in names], "tab string, target string")
    got = closest_match(t, c, ["tab"])
    assert got.where("closest = target and score = 1").count() == 100
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_tiles_and_chunks(spark, monkeypatch):
    """Blocks of many tiles give what one tile gives, ties by order included."""
    monkeypatch.setattr(similar, "TILE", 7)
    monkeypatch.setattr(similar, "CHUNK", 3)
    rnd = random.Random(11)
    word = lambda k: "".join(rnd.choice("ABCD_\U0001F600é") for _ in range(rnd.randint(1, k)))
    blocks = {"T": [word(8) for _ in range(150)], "U": [word(5) for _ in range(20)]}
    check(spark, blocks, [(rnd.choice("TU"), word(10)) for _ in range(200)])


def test_pairs_are_no_rows(spark):
    """Names of the same letters: every pair is compared, none becomes a row of a join."""
    rnd = random.Random(2)
    names = sorted({"".join(rnd.sample("ABCDEFGHIJKLMNOP", 10)) + "X" * rnd.randrange(9) for _ in range(1500)})
    c = spark.createDataFrame([("T", k, n) for k, n in enumerate(names)], "tab string, ordinal int, candidate string")
    got = closest_match(c.selectExpr("tab", "candidate as target"), c, ["tab"])
    assert got.where("score = 1").count() == len(names)
    assert "FlatMapCoGroupsInPandas" in got._jdf.queryExecution().toString()
