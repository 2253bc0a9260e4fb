import hashlib
import math
import random

import pytest

from escalade.operators import sampling as S


def brute(rows, ratio, seed):
    """Groups one by one in seeded order; a group is taken if all its classes are short of their quotas."""
    size = {}
    for _, c in rows:
        size[c] = size.get(c, 0) + 1
    n = math.ceil(len(rows) * ratio)
    exact = {c: n * k / len(rows) for c, k in size.items()}
    quota = {c: math.floor(x) for c, x in exact.items()}
    for c in sorted(size, key=lambda c: (quota[c] - exact[c], c))[:n - sum(quota.values())]:
        quota[c] += 1
    groups = {}
    for g, c in rows:
        groups.setdefault("" if g is None else str(g), []).append(c)
    had, test = dict.fromkeys(size, 0), set()
    for g in sorted(groups, key=lambda g: hashlib.md5(f"{seed}:{g}".encode()).hexdigest() + ":" + g):
        if all(had[c] < quota[c] for c in groups[g]):
            test.add(g)
            for c in groups[g]:
                had[c] += 1
    return test, quota, had, {c: max(g.count(c) for g in groups.values()) for c in size}


@pytest.mark.parametrize("seed", range(6))
def test_same_as_groups_one_by_one(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(200), rnd.choice("aaabbc")) for _ in range(900)]  # crossing groups
    rows += [(1000 + rnd.randrange(60), "d") for _ in range(100)] + [(None, "a")] * 3
    if seed % 2:
        rows += [(7, "a")] * 500  # a hot group
    test, quota, had, largest = brute(rows, 0.2, seed)
    df = spark.createDataFrame([(i, g, c) for i, (g, c) in enumerate(rows)], "i long, g long, c string")
    out = S.group_split(df, "c", "g", 0.2, seed)
    assert out.columns == ["i", "g", "c", "split"]
    back = out.collect()
    assert len(back) == len(rows)
    sides = {}
    for r in back:
        sides.setdefault("" if r.g is None else str(r.g), set()).add(r.split)
    assert all(len(s) == 1 for s in sides.values())
    assert {g for g, s in sides.items() if s == {"test"}} == test
    for c in quota:
        assert had[c] < quota[c] + largest[c]


def test_each_class_is_within_one_group_of_its_quota(spark):
    rnd = random.Random(11)
    rows = [(g, c) for g in range(400) for c in rnd.choices("abcd", k=rnd.randrange(1, 4))]
    _, quota, _, largest = brute(rows, 0.25, 42)
    got = S.group_split(spark.createDataFrame(rows, "g long, c string"), "c", "g", 0.25).where("split = 'test'").groupBy("c").count().collect()
    for r in got:
        assert abs(r["count"] - quota[r.c]) <= largest[r.c], (r, quota)


def test_errors_and_an_empty_table(spark):
    empty = spark.createDataFrame([], "g long, c string")
    assert S.group_split(empty, "c", "g", 0.2).columns == ["g", "c", "split"]
    with pytest.raises(ValueError, match="no c"):
        S.group_split(spark.createDataFrame([(1, None), (2, "a")], "g long, c string"), "c", "g", 0.5)
    with pytest.raises(ValueError, match="fewer than 2"):
        S.group_split(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "g long, c string"), "c", "g", 0.5)
    with pytest.raises(ValueError):
        S.group_split(empty, "c", "g", 1.0)
