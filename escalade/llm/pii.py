"""Personal data by weak supervision (operator 1); DataFrame and SQL functions only.

Regular expressions propose candidate spans in every whole text: the four base
kinds (email, ip, card, phone) by their exact rules, and looser ones: ``secret`` (keys
and tokens), ``number`` (digit groups that are no base span) and ``handle`` (addresses
without a proper domain). Five labelers vote on each candidate (+1 personal, -1 not,
0 abstains): its form, a gazetteer of known prefixes and endings, the words before it,
the marks around it and its make-up. Expectation-maximisation over the counts of the
vote patterns estimates each kind's prior and each labeler's reliability; the posteriors
then train the final span classifier, a naive Bayes model over span features. Base
spans always stay; the classifier adds the other kinds' candidates that it accepts.

Scale: one map-side pass over the texts; only spans (no texts) are kept in a table
in the shared folder. Vote patterns (at most 7 x 3^5) and feature values (at most a
few hundred) have a proven bound, are summed with map-side combine, and alone reach the
driver. No shuffle grows with a text, a kind or a source.

Defined results: a null text is empty; an empty text or table has no spans and gives
its rows; repeated rows are judged row by row; spans of one kind never overlap, those
of different kinds may; the order of equal starts is KINDS; extra columns are kept by
``find`` under their own names, apart from ``spans`` and ``base``, which it sets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escalade.llm import common as C

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "number", "handle")
KINDS = BASE + ADDED

# Candidate patterns. Possessive quantifiers and look-behinds only keep matching
# linear in the text; they find the same leftmost spans.
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a maximal run of 14 to 19 digits; shorter and longer runs would fail and are no candidates
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+",
    "number": r"(?<![A-Za-z0-9.+-])[0-9](?:[\x20().-]{0,2}[0-9]){6,18}+(?![A-Za-z0-9])",
    "handle": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?![A-Za-z0-9.-])",
}
# A text without these can't hold the kind
_NEEDS = {"email": "@", "phone": "+", "handle": None, "ip": None, "card": None, "secret": None, "number": None}

# Fixed values of the labelers
WORDS_BEFORE = {
    "email": "e-?mail|mail|contact|write|address", "ip": r"\bip\b|host|server|address|client",
    "card": "card|visa|credit|payment|karte|carte|tarjeta", "phone": r"phone|\btel|call|mobile|fax|telefon",
    "secret": "token|key|secret|password|passwd|credential|auth", "number": r"phone|\btel|ssn|passport|account|iban|card|call",
    "handle": "e-?mail|mail|contact|write|reach",
}
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|info)$", "ip": r"^(?:10|127|172|192|0)\.",
    "card": "^(?:4|5[1-5]|3[47]|6)", "phone": r"^\+(?:1|33|34|44|49)\D",
    "secret": "^(?:AKIA|ghp_|gho_|sk-|xox|AIza|eyJ)", "number": r"^(?:0|1[ .-]|\(?[2-9][0-9]{2}\)?[ .-])", "handle": r"(?:gmail|mail|yahoo|outlook)",
}
FORM = {
    "email": r"^[A-Za-z0-9][^@]*@[^@]+\.[A-Za-z]{2,}$", "ip": r"^[1-9][0-9]{0,2}(?:\.[0-9]{1,3}){3}$",
    "card": r"^[0-9]{4}(?:[ -]?[0-9]{4}){2,3}", "phone": r"^\+[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?[ -]",
    "secret": r"^(?:[0-9a-f]{32,64}|[A-Z0-9]{16,24}|[A-Za-z0-9_-]{20,})$", "number": r"^[0-9]{3}[ .-][0-9]{2,4}[ .-][0-9]{4}$", "handle": r"^[A-Za-z0-9._-]{2,}@[a-z]+$",
}
LABELERS = ("form", "gazetteer", "before", "around", "make")
ROUNDS = 10
# How many characters before a span the context labeler reads.
CONTEXT = 24

_SPAN = "struct<kind:string,start:int,stop:int,form:int,gazetteer:int,before:int,around:int,make:int,bucket:string>"


def _sql_text(x: str) -> str:
    return "r'" + x + "'"


def _spans(kind: str, text: str) -> str:
    """SQL: the matches of a kind as array<struct<start,stop,match>>, in code points."""
    return f"""
    aggregate(
      arrays_zip(slice(split({text}, {_sql_text(PATTERNS[kind])}, -1), 1, size(_m_{kind})), _m_{kind}),
      named_struct('at', 0, 'out', cast(array() as array<struct<start:int,stop:int,match:string>>)),
      (a, x) -> named_struct(
        'at', a.at + length(x['0']) + length(x._m_{kind}),
        'out', concat(a.out, array(named_struct('start', a.at + length(x['0']),
               'stop', a.at + length(x['0']) + length(x._m_{kind}), 'match', x._m_{kind})))),
      a -> a.out)"""


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _valid(kind: str) -> str:
    """SQL condition on a match ``s.match`` of a base kind."""
    if kind == "ip":
        return f"s.match rlike {_sql_text(f'^{_OCTET}(?:[.]{_OCTET}){{3}}$')}"
    if kind == "phone":
        return f"length({_digits('s.match')}) between 10 and 15"
    if kind == "card":  # Luhn: from the right, every second digit doubled
        d = f"reverse({_digits('s.match')})"
        return f"""aggregate(sequence(1, length({d})), 0, (a, i) -> a + case
            when i % 2 = 1 then int(substring({d}, i, 1))
            else int(substring({d}, i, 1)) * 2 - if(int(substring({d}, i, 1)) > 4, 9, 0) end) % 10 = 0"""
    return "true"


def _voted(kind: str, text: str) -> str:
    """SQL: a span ``s`` with its votes and feature bucket."""
    before = f"lower(substring({text}, greatest(s.start - {CONTEXT} + 1, 1), least(s.start, {CONTEXT})))"
    left = f"if(s.start = 0, ' ', substring({text}, s.start, 1))"
    right = f"substring({text}, s.stop + 1, 1)"
    share = "length(regexp_replace(s.match, '[^0-9]', '')) / length(s.match)"
    make = {
        "email": "if(length(s.match) between 6 and 64, 1, -1)", "handle": "if(length(s.match) between 6 and 40, 0, -1)",
        "ip": "if(s.match rlike '(^|[.])0[0-9]', -1, 1)",
        "card": "if(length(regexp_replace(s.match, '[^0-9]', '')) in (15, 16), 1, 0)",
        "phone": "if(length(regexp_replace(s.match, '[^0-9]', '')) = 11, 1, 0)",
        "secret": f"if({share} between 0.15 and 0.95, 1, -1)",
        "number": "if(length(regexp_replace(s.match, '[^0-9]', '')) between 9 and 11, 1, -1)",
    }[kind]
    return f"""named_struct('kind', '{kind}', 'start', s.start, 'stop', s.stop,
      'form', if(s.match rlike {_sql_text(FORM[kind])}, 1, -1),
      'gazetteer', if(s.match rlike {_sql_text(GAZETTEER[kind])}, {-1 if kind == 'ip' else 1}, 0),
      'before', if({before} rlike {_sql_text('(?:' + WORDS_BEFORE[kind] + ')[^0-9]{0,20}$')}, 1, 0),
      'around', case when {left} rlike '[\\\\s"(<\\\\[:=,;]' and ({right} = '' or {right} rlike '[\\\\s")>\\\\],;.!?]') then 1
                     when {left} rlike '[A-Za-z0-9/_]' or {right} rlike '[A-Za-z0-9/_]' then -1 else 0 end,
      'make', {make},
      'bucket', concat_ws('|', cast(least(ceil(length(s.match) / 4.0), 12) as string), cast(round({share} * 5) as string)))"""


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: the base spans, and all candidates with votes."""
    text = "_text"
    out = docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    some = out.withColumn("_digit", F.col(text).rlike("[0-9]"))
    gate = {"email": f"contains({text}, '@')", "phone": f"_digit and contains({text}, '+')",
            "handle": f"(contains({text}, '@') or contains({text}, 'at)') or contains({text}, 'at]'))"}
    found = some.withColumns({f"_m_{k}": F.expr(
        f"if({gate.get(k, '_digit')}, regexp_extract_all({text}, {_sql_text(PATTERNS[k])}, 0), cast(array() as array<string>))")
        for k in KINDS})
    # the look-behinds see a span's neighbours, so split() meets the same matches
    with_spans = found.withColumns({f"_s_{k}": F.expr(
        f"if(size(_m_{k}) = 0, cast(array() as array<struct<start:int,stop:int,match:string>>), filter({_spans(k, text)}, s -> {_valid(k)}))")
        for k in KINDS})
    clear = "not exists({other}, b -> b.start < s.stop and s.start < b.stop)"
    free = {"number": " and ".join(clear.format(other=f"_s_{b}") for b in ("ip", "card", "phone", "secret")),
            "handle": clear.format(other="_s_email"), "secret": clear.format(other="_s_email")}
    each = [f"transform(filter(_s_{k}, s -> {free.get(k, 'true')}), s -> {_voted(k, text)})" for k in KINDS]
    base = [f"transform(_s_{k}, s -> named_struct('start', s.start, 'kind', {i}, 'stop', s.stop))" for i, k in enumerate(BASE)]
    return with_spans.withColumns({
        "spans": F.expr(f"cast(concat({', '.join(each)}) as array<{_SPAN}>)"),
        "base": F.expr(f"array_sort(concat({', '.join(base)}))"),
    }).select(*[c for c in docs.columns if c not in ("spans", "base")], "base", "spans")


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Posterior ``p`` of each vote pattern (kind, votes, n) by expectation-maximisation.

    ``patterns`` has at most 7 x 3^5 rows. Labelers vote independently given the truth;
    the start is the share of positive votes.
    """
    votes = sum((F.col(c) for c in LABELERS), F.lit(0))
    posterior = F.lit(1) / (F.lit(1) + F.exp(-votes.cast("double")))
    for _ in range(rounds):
        p = patterns.withColumn("p", posterior)
        sums = [F.sum(F.col("n") * F.col("p")).alias("t1"), F.sum(F.col("n") * (1 - F.col("p"))).alias("t0")]
        for c in LABELERS:
            for v in (-1, 0, 1):
                hit = (F.col(c) == v).cast("double") * F.col("n")
                sums += [F.sum(hit * F.col("p")).alias(f"{c}{v}_1"), F.sum(hit * (1 - F.col("p"))).alias(f"{c}{v}_0")]
        logit = F.lit(0.0)
        for r in p.groupBy("kind").agg(*sums).orderBy("kind").collect():  # one row a kind
            own = F.lit(math.log((r["t1"] + 1) / (r["t0"] + 1)))
            for c in LABELERS:
                for v in (-1, 0, 1):
                    ratio = (r[f"{c}{v}_1"] + 0.5) / (r["t1"] + 1.5) * (r["t0"] + 1.5) / (r[f"{c}{v}_0"] + 0.5)
                    own = own + F.when(F.col(c) == v, F.lit(math.log(ratio))).otherwise(F.lit(0.0))
            logit = F.when(F.col("kind") == r["kind"], own).otherwise(logit)
        posterior = F.lit(1) / (F.lit(1) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))
    return patterns.withColumn("p", posterior)


def classifier(spans: DataFrame) -> dict[str, float]:
    """Log-ratios of the final classifier by "kind|feature|value", and "kind" for the prior.

    ``spans`` has one row per candidate; only counts by vote pattern and bucket are gathered.
    """
    counted = C.spill(spans.groupBy("kind", *LABELERS, "bucket").agg(F.count("*").alias("n")), "pii-counts")
    patterns = counted.groupBy("kind", *LABELERS).agg(F.sum("n").alias("n"))
    posterior = C.spill(reliabilities(C.spill(patterns, "pii-votes")).drop("n"), "pii-posteriors")
    soft = counted.join(F.broadcast(posterior), ["kind", *LABELERS])  # at most 7 x 3^5 rows
    features = F.array(*[F.concat_ws("|", F.lit(c), F.col(c).cast("string")) for c in LABELERS],
                       F.concat_ws("|", F.lit("bucket"), F.col("bucket")))
    sums = soft.select("kind", "n", "p", F.explode(F.concat(features, F.array(F.lit("")))).alias("feature")) \
        .groupBy("kind", "feature").agg(F.sum(F.col("n") * F.col("p")).alias("t1"), F.sum(F.col("n") * (1 - F.col("p"))).alias("t0"))
    rows = sums.orderBy("kind", "feature").collect()  # kinds x (15 votes + 13 x 6 buckets + 1) at most
    prior = {r["kind"]: r for r in rows if r["feature"] == ""}
    out = {}
    for r in rows:
        t = prior[r["kind"]]
        if r["feature"]:
            out[f"{r['kind']}|{r['feature']}"] = math.log((r["t1"] + 0.5) / (t["t1"] + 1) * (t["t0"] + 1) / (r["t0"] + 0.5))
        else:
            out[r["kind"]] = math.log((r["t1"] + 0.5) / (r["t0"] + 0.5))
    return out


def find(docs: DataFrame) -> DataFrame:
    """``docs`` (text not kept) with ``base``: array<struct<start,kind,stop>> of the base
    spans, and ``spans``: base and accepted spans as array<struct<start,kind,stop,score>>.

    ``kind`` is the number in KINDS; ``score`` the classifier's log-odds.
    """
    held = C.spill(candidates(docs).drop("text"), "pii-spans")
    weights = classifier(held.select(F.explode("spans").alias("s")).select("s.*"))
    number = "case s.kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS)) + " end"
    keys = ["s.kind", *[f"concat(s.kind, '|{c}|', s.{c})" for c in LABELERS], "concat(s.kind, '|bucket|', s.bucket)"]
    table = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair]) if weights else \
        F.expr("cast(map() as map<string,double>)")
    # the sum in fixed point, so that no order of terms can change it
    odds = " + ".join(f"coalesce(element_at(_w, {k}), 0D)" for k in keys)
    scored = held.withColumn("_w", table).withColumn("spans", F.expr(f"""
        array_sort(filter(transform(spans, s -> named_struct('start', s.start, 'kind', {number}, 'stop', s.stop, 'score', {odds})),
                          s -> s.kind < {len(BASE)} or s.score > 0))"""))
    return scored.drop("_w")


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the spans of every document."""
    found = find(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = "element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), s.kind + 1)"
    listed = "array_join(transform({}, s -> concat(" + names + ", ':', s.start, ':', s.stop)), ',')"
    return found.select(
        "doc_id", *[F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(F.expr(listed.format("base")).cast("binary"), 256).alias("base_sha256"),
        F.expr(listed.format("spans")).alias("spans"))
