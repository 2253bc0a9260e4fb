import re
from collections import defaultdict

from escalade.llm import chat as H
from escalade.llm import common as C


def brute(rows):
    """conv_id -> (n_turns, n_copies) of the maximal conversations."""
    talks = defaultdict(set)
    for conv, turn, role, text in rows:
        if conv is not None:
            talks[conv].add((-1 if turn is None else turn, role or "", text or ""))
    import hashlib
    lists = {c: tuple(sorted(t, key=lambda x: (x[0], x[1], hashlib.md5(x[2].encode()).hexdigest()))) for c, t in talks.items()}
    same = defaultdict(list)
    for c, t in lists.items():
        same[t].append(c)
    begun = {t[:k] for t in same for k in range(1, len(t))}
    return {min(c): (len(t), len(c), t) for t, c in same.items() if t not in begun}


def check(frame, rows):
    want = brute(rows)
    got = defaultdict(list)
    for r in H.render(frame, H.maximal(frame)).collect():
        got[r.conv_id].append(r)
    assert set(got) == set(want)
    for c, own in got.items():
        n, copies, turns = want[c]
        assert all((r.n_turns, r.n_copies) == (n, copies) for r in own)
        text = "".join(f"<|{role}|>\n{x.replace('<|', '< |')}<|end|>\n" for _, role, x in turns)
        assert "".join(r.rendered for r in sorted(own, key=lambda r: r.segment)) == text


SCHEMA = "conv_id long, turn long, role string, text string"


def test_query_against_brute_force(spark):
    frame = C.table(spark, "/root/testdata/sf0.01", "conversations")
    check(frame, [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])


def test_edges(table):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", "<|user|>\nbye")]
    rows = []
    for conv, n in ((1, 1), (2, 2), (3, 4), (4, 3), (5, 4), (6, 2)):  # snapshots of one talk, and a copy
        rows += [(conv, t, *talk[t]) for t in range(n)]
    rows += [(7, 0, "user", "hi"), (7, 1, "assistant", "other"), (8, 1, "user", "hi")]      # another branch; other numbers
    rows += [(9, 0, "user", "twice"), (9, 0, "user", "twice"), (10, 0, "user", "b"), (10, 0, "user", "a"), (10, 0, "tool", None)]
    rows += [(11, None, None, None), (12, None, "user", "x"), (12, 2, "user", ""), (None, 0, "user", "nobody")]
    rows += [(13, t, "user", f"turn {t}") for t in range(2500)] + [(14, t, "user", f"turn {t}") for t in range(1300)]  # over blocks
    check(table(rows, SCHEMA), rows)
    extra = table([(*r, "x") for r in rows[:5]], SCHEMA + ", digest string")
    check(extra, rows[:5])
    empty = table([], SCHEMA)
    assert H.render(empty, H.maximal(empty)).count() == 0


def test_no_python_on_the_executors(spark):
    plan = H.op9_chat_formatting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
