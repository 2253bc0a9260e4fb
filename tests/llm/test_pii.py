import hashlib
import re

from escalade.llm import pii as P

FORMS = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
         "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(text):
    out = []
    for i, (kind, form) in enumerate(FORMS.items()):
        for m in form.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), i, m.end()))
    return sorted(out)


def test_query_against_brute_force(spark, docs):
    rows = P.op1_pii(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = [f"{P.BASE[k]}:{a}:{b}" for a, k, b in base(docs[r.doc_id])]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in P.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [x for x in spans if x.split(":")[0] in P.BASE] == want


HARD = ["a@b", "a@b.c%d@e.f", "x..y@-.-", "1.2.3.4.5.6.7.8", "300.1.1.1 007.08.09.1", "0000000001.2.3.4", "1.2.3.4.", "4173893178530722",
        "4173 8931-7853 0722", "4173  893178530722", "4173893178530722-", "41738931785307224173893178530722", "+1 (755) 555-9729.", "+1",
        "++12 345 678 90", "+1234567890123456", "🙂é +1 (755) 555-9729 x@y.zé 1.1.1.1🙂", "12345678901234567890", "0 0 0 0 0 0 0 0 0 0 0 0 0 0",
        "a@" + "b." * 3000, "9" * 30000, "a" * 30000 + "@x.y", "1." * 2000, "+" + "1 " * 3000, "", None, "key token = \"69760a67bd64a3a7e9ecd68ae8373485c8942606\""]


def test_edges(table):
    rows = [(i, t, "mine", i) for i, t in enumerate(HARD)] + [(0, HARD[0], "mine", 0), (None, HARD[1], None, None)]
    out = P.find(table(rows, "doc_id long, text string, kind string, start int"))
    assert {"doc_id", "kind", "start", "base", "spans"} == set(out.columns)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        text = HARD[1] if r.doc_id is None else HARD[r.doc_id]
        assert [(s.start, s.kind, s.stop) for s in r.base] == base(text)
        kept = {(s.start, s.kind, s.stop) for s in r.spans}
        assert kept >= set(base(text))
    assert P.find(table([])).count() == 0


def test_classifier_adds_keys_and_leaves_words(table):
    secret = 'token = "69760a67bd64a3a7e9ecd68ae8373485c894{:04x}" and'
    rows = [(i, f"some words {secret.format(i)} more abcdefghijklmnopqrstuvwxyz") for i in range(40)]
    for r in P.find(table(rows)).collect():
        assert [P.KINDS[s.kind] for s in r.spans] == ["secret"]


def test_no_python_on_the_executors(spark):
    plan = P.op1_pii(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
