import hashlib

from escalade.llm import common as C
from escalade.llm import decontam as D


def brute(text, items, n=10):
    w = C.words(text)
    hit, found = [False] * len(w), set()
    for item_id, item in items:
        x = C.words(item)
        k = min(n, len(x))
        if not k:
            continue
        for window in {tuple(x[i:i + k]) for i in range(len(x) - k + 1)}:
            for s in range(len(w) - k + 1):
                if tuple(w[s:s + k]) == window:
                    hit[s:s + k] = [True] * k
                    found.add(str(item_id))
    return len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)


def test_query_against_brute_force(spark, docs):
    items = [tuple(r) for r in C.table(spark, "/root/testdata/sf0.001", "benchmark").select("item_id", "text").collect()]
    rows = D.op10_benchmark_decontamination(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs) and any(r.contaminated for r in rows)
    for r in rows:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(docs[r.doc_id], items)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short ITEM"), (10, "Short, item!"),
         (3, None), (4, ""), (5, "..."), (None, "nobody's own item"), (1, "a b a b a b a b a b a b"), (6, "é È é")]
TEXTS = [(1, "x one two, THREE four five six seven eight nine ten eleven y"), (2, "two three four five six seven eight nine ten eleven twelve"),
         (3, "a short item here and a short item"), (4, None), (5, ""), (6, "?!"), (7, "nobody s own item"), (None, "short item"),
         (8, "a b " * 400), (9, "É È é é È é"), (3, "a short item here and a short item"), (11, "shortitem " + "word " * 3000 + "short item")]


def found(frame):
    return sorted((str(r.doc_id), r["_hits"].n_words, [tuple(s) for s in r["_hits"].spans], list(r["_hits"]["items"])) for r in frame.collect())


def test_edges_and_the_way_beyond_the_broadcast_bound(table):
    docs, bench = table(TEXTS), table(ITEMS, "item_id long, text string")
    small = found(D.scan(docs, bench))
    assert small == found(D.scan(docs, bench, max_words=1))
    by_text = {}
    for (doc_id, n, spans, items) in small:
        by_text[doc_id] = (n, sum(b - a for a, b in spans), len(items))
    for doc_id, text in TEXTS:
        want = brute(text, [i for i in ITEMS])
        named = {str(i) for i, _ in ITEMS if i is not None}
        assert by_text[str(doc_id)][:2] == want[:2]
        assert by_text[str(doc_id)][2] <= len(named)


def test_empty_tables(table):
    none = table([], "item_id long, text string")
    assert all(not r["_hits"].spans for r in D.scan(table(TEXTS), none).collect())
    assert D.scan(table([]), table(ITEMS, "item_id long, text string")).count() == 0


def test_remove_spans_keeps_columns_and_clean_documents(table):
    rows = [(i, t, len(t or ""), "x", 1) for i, t in TEXTS]
    docs = table(rows, "doc_id long, text string, n_chars int, _hits string, item_id int")
    out = D.remove_spans(docs, table(ITEMS, "item_id long, text string"))
    assert out.columns == docs.columns
    kept = {str(r.doc_id): r for r in out.collect()}
    assert kept["1"].text == "x  y" and kept["1"].n_chars == 4
    assert "2" not in kept and "None" not in kept
    assert kept["4"].text is None and kept["5"].text == "" and kept["6"].text == "?!"
    again = D.scan(out, table(ITEMS, "item_id long, text string"))
    assert all(not r["_hits"].spans for r in again.collect())
