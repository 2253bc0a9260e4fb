import re
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from escalade.llm import common as C
from escalade.llm import line_dedup as L


def n_words(line):
    unspaced = sum(any(a <= ord(c) <= b for a, b in L.UNSPACED) for c in line)
    return max(1, len(C.words(line)) + unspaced // 2)


def brute(texts, min_words=L.MIN_WORDS):
    """Deleted line numbers of texts in order, from the definition: of the runs that are as short as ``min_words``
    words allow, every occurrence goes that no chain of overlaps ties to the first."""
    docs = [[x.strip(" \t\r") for x in (t or "").split("\n")] for t in texts]
    docs = [[x for x in d if x] for d in docs]
    size = [[n_words(x) for x in d] for d in docs]
    runs = set()
    for d, own in enumerate(docs):
        for i in range(len(own)):
            after = [e for e in range(i + 1, len(own) + 1) if sum(size[d][i:e]) >= min_words]
            before = [a for a in range(i + 1) if sum(size[d][a:i + 1]) >= min_words]
            runs |= {(d, i, after[0])} if after else set()
            runs |= {(d, before[-1], i + 1)} if before else set()
    gone, chain = defaultdict(set), {}  # of a run's lines: the document and the end of its first chain
    for d, a, b in sorted(runs):
        key = tuple(docs[d][a:b])
        if key not in chain or (chain[key][0] == d and a < chain[key][1]):
            chain[key] = (d, b)
        else:
            gone[d] |= set(range(a, b))
    return [sorted(gone[d]) for d in range(len(docs))]


LINES = ["w1 w2 w3 w4 w5 w6 w7 w8 w9 w10", "a b c", "d e f g", "h", "i j k l m", "", "  ", "long line with more than ten words in it for sure yes"]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.lists(st.sampled_from(LINES), max_size=14).map("\n".join), min_size=1, max_size=8))
def test_against_the_definition(table, texts):
    out = L.apply(table(list(enumerate(texts)), parts=1)).orderBy("doc_id").collect()
    assert [list(r["_gone"]) for r in out] == brute(texts)


def test_query_against_the_definition(spark, docs):
    rows = L.op6_line_dedup(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    texts = [docs[r.doc_id] for r in rows]
    for r, gone, text in zip(rows, brute(texts), texts):
        assert r.removed == ",".join(map(str, gone)) and r.n_removed == len(gone)
        lines, n, kept = text.split("\n"), -1, []
        for x in lines:
            n += bool(x.strip(" \t\r"))
            if not x.strip(" \t\r") or n not in gone:
                kept.append(x)
        assert r.text == "\n".join(kept)


def test_edges(table):
    long = "this line is repeated and it has more than ten words in all"
    rows = [(1, f"{long}\nown line", 5, "r"), (2, long, 5, "r"), (None, long, 5, "r"), (3, None, 0, None), (4, "", 0, ""),
            (5, f"A\n\n{long}\n\nB", 5, "r"), (1, f"{long}\nown line", 5, "r"), (6, "x\n" * 3000, 5, "r"), (7, "word " * 20000, 5, "r")]
    docs = table(rows, "doc_id long, text string, n_chars int, gone string", parts=1)
    out = L.dedup(docs)
    assert out.columns == docs.columns
    kept = defaultdict(list)
    for r in out.collect():
        kept[r.doc_id].append(r)
    assert kept[None][0].text == long                       # null ids come first and keep the line
    assert [x.text for x in kept[1]] == ["own line"]        # two words make no run; the repeated row is a later copy as a whole
    assert 2 not in kept                                    # lost all its lines
    assert kept[3][0].text is None and kept[4][0].text == ""
    assert kept[5][0].text == "A\n\n\nB" and kept[5][0].n_chars == 5
    assert kept[6][0].text.count("x") == 3000               # occurrences that overlap are one
    assert kept[7][0].text == "word " * 20000
    assert L.dedup(table([])).count() == 0


def test_first_copies_stay_whole(table):
    """A column of equal lines in one document loses nothing; its copy in another does; copies that only touch go."""
    column = "\n".join(["intro", *["0"] * 30, "end"])
    verse = "one two three four\nfive six seven eight\nnine ten eleven twelve"
    rows = [(1, column), (2, "A\n" + "\n".join(["0"] * 12) + "\nB"), (3, "\n".join([verse] * 3) + "\nlast"), (4, "C\n" + "\n".join(["1", "2"] * 40))]
    out = {r.doc_id: r.text for r in L.dedup(table(rows, parts=1)).collect()}
    assert out[1] == column and out[4] == rows[3][1]
    assert out[2] == "A\nB" and out[3] == verse + "\nlast"
    assert brute([t for _, t in rows]) == [[], list(range(1, 13)), list(range(3, 9)), []]


def test_scripts_without_blanks(table):
    """Three lines without blanks go where they come again; two words with many blanks between make no run."""
    passage = "今天的天气非常好\n我们一起去公园散步\n晚上回家吃饭看书"
    rows = [(1, f"甲\n{passage}"), (2, f"乙\n{passage}\n丙"), (3, "two" + " " * 9 + "words\nx"), (4, "y\ntwo" + " " * 9 + "words")]
    out = {r.doc_id: r.text for r in L.dedup(table(rows, parts=1)).collect()}
    assert out == {**dict(rows), 2: "乙\n丙"}


def test_no_python_on_the_executors(spark):
    plan = L.op6_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
