"""Plans for text preparation on the driver tables (documents, benchmark,
conversations, part)."""

from __future__ import annotations

from pyspark.sql import functions as F

from escalade.functions.proba import pseudo_proba
from escalade.operators import features as FT
from escalade.operators import prompts as P
from escalade.operators import sampling as S
from escalade.operators.label_lookup import parse_label_many
from escalade.operators.labels import label_dictionary, label_encode
from escalade.plans.registry import plan, rounded
from escalade.session import materialize
from escalade.sources.tables import balanced, read_table

# Fixed values used by the text plans.
VOCAB_N = 1000
SPLIT_RATIO, SPLIT_SEED = 0.2, 42
FEW_SHOT_K, FEW_SHOT_SEED = 3, 7
MAX_LEN = 128
LENGTH_LIMIT = 300
CONV_LABELS = ["en", "de", "fr", "es"]
PART_LABELS = ["Standard", "Medium", "Promo", "Large", "Small", "Economy"]
TASK = "Identify the language of the text. Answer with one label only."

TOKENS_SQL = ("list_filter(regexp_split_to_array(strip_accents(lower({t})), '[^\\p{{L}}\\p{{N}}_]+'), "
              "lambda x: regexp_full_match(x, '[a-z]{{2,}}'))")


def _tok_sql(col: str) -> str:
    return TOKENS_SQL.format(t=col)


def _docs(spark, sf_dir):
    return balanced(read_table(spark, sf_dir, "documents"), "doc_id")


def _doc_tokens(spark, sf_dir):
    """(doc_id, lang, terms): the session's shared, materialised token table."""
    from escalade.plans.cascade import corpus_tokens
    return corpus_tokens(spark, sf_dir).select(F.col("sample_id").alias("doc_id"), "lang", "terms")


TC_SQL = f"""tc AS (SELECT doc_id, term, count(*) AS n
  FROM (SELECT doc_id, unnest({_tok_sql('text')}) AS term FROM documents) GROUP BY ALL)"""
VOC_SQL = f"""voc AS (SELECT (row_number() OVER (ORDER BY term_count DESC, term) - 1)::INT AS term_id, term, term_count
  FROM (SELECT term, sum(n)::BIGINT AS term_count FROM tc GROUP BY term ORDER BY term_count DESC, term LIMIT {VOCAB_N}))"""


@plan("tokenize", f"WITH {TC_SQL} SELECT doc_id, term, n FROM tc")
def q_tokenize(spark, sf_dir):
    return FT.tokenize(_doc_tokens(spark, sf_dir), "doc_id")


@plan("vocabulary", f"WITH {TC_SQL}, {VOC_SQL} SELECT * FROM voc")
def q_vocabulary(spark, sf_dir):
    return FT.vocabulary(FT.tokenize(_doc_tokens(spark, sf_dir), "doc_id"), VOCAB_N)


IDF_SQL = f"""idf AS (
  SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0 AS idf
  FROM tc WHERE term IN (SELECT term FROM voc) GROUP BY term)"""


@plan("tfidf", f"""WITH {TC_SQL}, {VOC_SQL}, {IDF_SQL},
raw AS (SELECT doc_id, term, (1.0 + ln(n)) * idf AS w FROM tc JOIN idf USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw""")
def q_tfidf(spark, sf_dir):
    docs = _doc_tokens(spark, sf_dir)
    tc = FT.tokenize(docs, "doc_id")
    return rounded(FT.tfidf_top(tc, "doc_id", VOCAB_N, docs))


@plan("tfidf_transform", f"""WITH {TC_SQL}, {VOC_SQL}, {IDF_SQL},
bc AS (SELECT item_id, term, count(*) AS n
  FROM (SELECT item_id, unnest({_tok_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
raw AS (SELECT item_id, term, (1.0 + ln(n)) * idf AS w FROM bc JOIN idf USING (term))
SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM raw""")
def q_tfidf_transform(spark, sf_dir):
    docs = _doc_tokens(spark, sf_dir)
    tc = FT.tokenize(docs, "doc_id")
    idf = FT.tfidf_fit(tc, "doc_id", FT.vocabulary(tc, VOCAB_N), documents=docs)
    bc = FT.tokenize(read_table(spark, sf_dir, "benchmark"), "item_id")
    return rounded(FT.tfidf_transform(bc, "item_id", idf, broadcast_idf=True))


@plan("label_encode", """
SELECT conv_id, turn, role, (dense_rank() OVER (ORDER BY role) - 1)::INT AS role_id FROM conversations""")
def q_label_encode(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    return label_encode(conv, "role", label_dictionary(conv, "role"), out="role_id") \
        .select("conv_id", "turn", "role", "role_id")


@plan("label_encode_quality", """
SELECT doc_id, quality, (dense_rank() OVER (ORDER BY quality::VARCHAR) - 1)::INT AS quality_id FROM labels""")
def q_label_encode_quality(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels").withColumn("q", F.col("quality").cast("string"))
    return label_encode(lab, "q", label_dictionary(lab, "q"), out="quality_id").select("doc_id", "quality", "quality_id")


SPLIT_SQL = f"""cls AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
q0 AS (SELECT lang, n, sum(n) OVER () AS big_n, ceil(sum(n) OVER () * {SPLIT_RATIO}) AS t FROM cls),
q1 AS (SELECT *, t * n / big_n AS ex, floor(t * n / big_n) AS fl FROM q0),
q2 AS (SELECT *, ex - fl AS rem, t - sum(fl) OVER () AS lft FROM q1),
quota AS (SELECT lang, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, lang) <= lft THEN 1 ELSE 0 END AS quota FROM q2),
ranked AS (SELECT d.doc_id, d.lang, d.text,
  row_number() OVER (PARTITION BY d.lang ORDER BY md5('{SPLIT_SEED}:' || d.doc_id::VARCHAR) || ':' || d.doc_id::VARCHAR) AS r
  FROM documents d),
split AS (SELECT r.doc_id, r.lang, r.text, CASE WHEN r.r <= q.quota THEN 'test' ELSE 'train' END AS split
  FROM ranked r JOIN quota q USING (lang))"""


def _split(spark, sf_dir):
    return S.stratified_split(_docs(spark, sf_dir), "lang", "doc_id", SPLIT_RATIO, SPLIT_SEED)


@plan("stratified_split", f"WITH {SPLIT_SQL} SELECT doc_id, lang, split FROM split")
def q_stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select("doc_id", "lang", "split")


GSPLIT_SQL = f"""cls AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
q0 AS (SELECT lang, n, sum(n) OVER () AS big_n, ceil(sum(n) OVER () * {SPLIT_RATIO}) AS t FROM cls),
q1 AS (SELECT *, t * n / big_n AS ex, floor(t * n / big_n) AS fl FROM q0),
q2 AS (SELECT *, ex - fl AS rem, t - sum(fl) OVER () AS lft FROM q1),
quota AS (SELECT lang, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, lang) <= lft THEN 1 ELSE 0 END AS quota FROM q2),
grp AS (SELECT lang, md5(text) AS g, count(*) AS c FROM documents GROUP BY lang, md5(text)),
gcum AS (SELECT lang, g, sum(c) OVER (PARTITION BY lang ORDER BY md5('{SPLIT_SEED}:' || g) || ':' || g
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - c AS before FROM grp),
gsplit AS (SELECT d.doc_id, d.lang, CASE WHEN c.before < q.quota THEN 'test' ELSE 'train' END AS split
  FROM documents d JOIN gcum c ON c.lang = d.lang AND c.g = md5(d.text) JOIN quota q ON q.lang = d.lang)"""


@plan("stratified_split_grouped", f"WITH {GSPLIT_SQL} SELECT doc_id, lang, split FROM gsplit")
def q_stratified_split_grouped(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("text_key", F.md5("text"))
    return S.stratified_split(d, "lang", "doc_id", SPLIT_RATIO, SPLIT_SEED, group_col="text_key") \
        .select("doc_id", "lang", "split")


# customers are the groups (nearly every one has orders of several priorities); the SQL goes through them one by one
GROUP_SPLIT_SQL = f"""WITH RECURSIVE cls AS (SELECT o_orderpriority AS lab, count(*) AS n FROM orders GROUP BY 1),
q0 AS (SELECT lab, n, sum(n) OVER () AS big_n, ceil(sum(n) OVER () * {SPLIT_RATIO}) AS t FROM cls),
q1 AS (SELECT *, t * n / big_n AS ex, floor(t * n / big_n) AS fl FROM q0),
q2 AS (SELECT *, ex - fl AS rem, t - sum(fl) OVER () AS lft FROM q1),
quota AS (SELECT lab, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, lab) <= lft THEN 1 ELSE 0 END AS quota FROM q2),
qs AS (SELECT list(quota::BIGINT ORDER BY lab) AS q FROM quota),
cells AS (SELECT o_custkey AS g, lab, count(o.o_orderkey) AS n FROM (SELECT DISTINCT o_custkey FROM orders) CROSS JOIN cls
  LEFT JOIN orders o USING (o_custkey) WHERE o.o_orderpriority = lab GROUP BY ALL),
dense AS (SELECT g.o_custkey AS g, list(coalesce(c.n, 0)::BIGINT ORDER BY k.lab) AS v
  FROM (SELECT DISTINCT o_custkey FROM orders) g CROSS JOIN cls k LEFT JOIN cells c ON c.g = g.o_custkey AND c.lab = k.lab GROUP BY 1),
placed AS (SELECT g, v, row_number() OVER (ORDER BY md5('{SPLIT_SEED}:' || g::VARCHAR) || ':' || g::VARCHAR) AS r FROM dense),
walk AS (
  SELECT 0::BIGINT AS r, NULL::BIGINT AS g, false AS taken, list_transform(q, lambda x: 0::BIGINT) AS had FROM qs
  UNION ALL
  SELECT r, g, ok, CASE WHEN ok THEN list_transform(list_zip(had, v), lambda x: x[1] + x[2]) ELSE had END
  FROM (SELECT p.r, p.g, w.had, p.v,
          len(list_filter(list_zip(p.v, w.had, qs.q), lambda x: x[1] > 0 AND x[2] >= x[3])) = 0 AS ok
        FROM walk w JOIN placed p ON p.r = w.r + 1 CROSS JOIN qs))
SELECT o_orderkey, CASE WHEN w.taken THEN 'test' ELSE 'train' END AS split FROM orders o JOIN walk w ON w.g = o.o_custkey"""


@plan("group_split", GROUP_SPLIT_SQL)
def q_group_split(spark, sf_dir):
    """Orders split by priority, all orders of a customer on one side."""
    orders = read_table(spark, sf_dir, "orders")
    return S.group_split(orders, "o_orderpriority", "o_custkey", SPLIT_RATIO, SPLIT_SEED).select("o_orderkey", "split")


FS_SAMPLED_SQL = f"""pool AS (SELECT * FROM (
  SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang
    ORDER BY md5('{FEW_SHOT_SEED}:' || doc_id::VARCHAR) || ':' || doc_id::VARCHAR) AS rank
  FROM split WHERE split = 'train') WHERE rank <= {FEW_SHOT_K})"""
FS_HEAD_SQL = f"""pool AS (SELECT * FROM (
  SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank
  FROM split WHERE split = 'train') WHERE rank <= {FEW_SHOT_K})"""


@plan("few_shot_sampled", f"WITH {SPLIT_SQL}, {FS_SAMPLED_SQL} SELECT lang, doc_id, rank::INT AS rank FROM pool")
def q_few_shot_sampled(spark, sf_dir):
    tr = _split(spark, sf_dir).where(F.col("split") == "train")
    return S.few_shot_sampled(tr, "lang", "doc_id", FEW_SHOT_K, FEW_SHOT_SEED).select("lang", "doc_id", "rank")


@plan("few_shot_head", f"WITH {SPLIT_SQL}, {FS_HEAD_SQL} SELECT lang, doc_id, rank::INT AS rank FROM pool")
def q_few_shot_head(spark, sf_dir):
    tr = _split(spark, sf_dir).where(F.col("split") == "train")
    return S.few_shot_head(tr, "lang", "doc_id", FEW_SHOT_K).select("lang", "doc_id", "rank")


def _prompts(spark, sf_dir):
    """(preamble: one row, samples: every document outside the few-shot pool)."""
    sp = _split(spark, sf_dir)
    pool = materialize(S.few_shot_head(sp.where(F.col("split") == "train"), "lang", "doc_id", FEW_SHOT_K), "few-shot-pool")
    lead = P.preamble(pool, TASK, sorted(CONV_LABELS), pool_text="text", pool_label="lang", pool_order=["lang", "rank"])
    samples = _docs(spark, sf_dir).select("doc_id", "text") \
        .join(F.broadcast(pool.select("doc_id")), "doc_id", "left_anti")  # k x classes ids
    return materialize(lead, "prompt-preamble"), samples


MSG_SQL = f"""asked AS (SELECT doc_id, text FROM split WHERE doc_id NOT IN (SELECT doc_id FROM pool)),
ex AS (SELECT lang, text, row_number() OVER (ORDER BY lang, rank) - 1 AS i FROM pool),
msgs AS (
  SELECT t.doc_id, 0 AS msg_idx, 'system' AS role, '{P.system_message(TASK, sorted(CONV_LABELS)).replace(chr(10), "' || chr(10) || '")}' AS content
  FROM asked t
  UNION ALL SELECT t.doc_id, 2 * e.i + 1, 'user', e.text FROM asked t, ex e
  UNION ALL SELECT t.doc_id, 2 * e.i + 2, 'assistant', e.lang FROM asked t, ex e
  UNION ALL SELECT t.doc_id, 2 * (SELECT count(*) FROM ex) + 1, 'user', t.text FROM asked t)"""


def _message_rows(df, *keys):
    return df.select(*keys, F.posexplode("messages").alias("msg_idx", "m")).select(
        *keys, F.col("msg_idx").cast("int").alias("msg_idx"), F.col("m.role").alias("role"), F.col("m.content").alias("content"))


@plan("prompt_preamble", f"""WITH {SPLIT_SQL}, {FS_HEAD_SQL}, {MSG_SQL}
SELECT msg_idx::INT AS msg_idx, role, content FROM msgs
WHERE doc_id = (SELECT min(doc_id) FROM asked) AND msg_idx <= 2 * (SELECT count(*) FROM ex)""")
def q_prompt_preamble(spark, sf_dir):
    """The messages that all prompts share, once."""
    return _message_rows(_prompts(spark, sf_dir)[0])


@plan("chat_messages", f"""WITH {SPLIT_SQL}, {FS_HEAD_SQL}, {MSG_SQL}
SELECT doc_id, msg_idx::INT AS msg_idx, role, content FROM msgs WHERE msg_idx = 2 * (SELECT count(*) FROM ex) + 1""")
def q_chat_messages(spark, sf_dir):
    """Every document's own message, after the shared preamble (``prompt_preamble``)."""
    lead, samples = _prompts(spark, sf_dir)
    return P.user_messages(samples, "text", lead).select("doc_id", "msg_idx", "role", "content")


@plan("prompt_render", f"""WITH {SPLIT_SQL}, {FS_HEAD_SQL}, {MSG_SQL}
SELECT doc_id, string_agg('<|' || role || '|>' || chr(10) || content || chr(10) || '<|end|>' || chr(10), '' ORDER BY msg_idx)
       || '<|assistant|>' || chr(10) AS prompt
FROM msgs GROUP BY doc_id""")
def q_prompt_render(spark, sf_dir):
    lead, samples = _prompts(spark, sf_dir)
    return P.prompt_render(P.chat_messages(samples, "text", lead)).select("doc_id", "prompt")


def _label_list_sql(labels):
    return "[" + ", ".join(f"'{l}'" for l in labels) + "]"


def _parse_sql(col: str, labels: list[str]) -> str:
    ll = _label_list_sql(labels)
    s = f"lower(regexp_replace({col}, '^\\s+|\\s+$', '', 'g'))"
    return f"""CASE WHEN {col} IS NULL THEN 'unknown'
  WHEN len(list_filter({ll}, lambda l: lower(l) = {s})) > 0 THEN list_filter({ll}, lambda l: lower(l) = {s})[1]
  WHEN len(list_filter({ll}, lambda l: contains({s}, lower(l)))) = 1 THEN list_filter({ll}, lambda l: contains({s}, lower(l)))[1]
  ELSE 'unknown' END"""


@plan("parse_label", f"SELECT conv_id, turn, {_parse_sql('text', CONV_LABELS)} AS label FROM conversations")
def q_parse_label(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    return conv.select("conv_id", "turn", P.parse_label(F.col("text"), CONV_LABELS).alias("label"))


@plan("parse_label_exact", f"SELECT p_partkey, {_parse_sql('p_type', PART_LABELS)} AS label FROM part")
def q_parse_label_exact(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    return part.select("p_partkey", P.parse_label(F.col("p_type"), PART_LABELS).alias("label"))


# labels of at least so many letters; answers are the sentences of the conversations
LABEL_LETTERS = 10


@plan("parse_label_many", f"""WITH lab AS (SELECT DISTINCT w AS l FROM (
  SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS w FROM documents) WHERE length(w) >= {LABEL_LETTERS}),
s AS (SELECT conv_id, turn, unnest(range(len(string_split(text, '.')))) AS part, unnest(string_split(text, '.')) AS raw FROM conversations),
hit AS (SELECT conv_id, turn, part, raw, l, lower(regexp_replace(raw, '^\\s+|\\s+$', '', 'g')) = l AS same
  FROM s LEFT JOIN lab ON contains(lower(raw), l))
SELECT conv_id, turn, part::INT AS part, CASE WHEN bool_or(same) THEN min(l) FILTER (WHERE same) WHEN count(l) = 1 THEN min(l) ELSE 'unknown' END AS label
FROM hit GROUP BY conv_id, turn, part""")
def q_parse_label_many(spark, sf_dir):
    """Every sentence of the conversations against all long words of the documents."""
    words = read_table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("w"))
    dictionary = words.where(F.char_length("w") >= LABEL_LETTERS)
    conv = read_table(spark, sf_dir, "conversations")
    answers = conv.select("conv_id", "turn", F.posexplode(F.split("text", r"\.")).alias("part", "raw"))
    return parse_label_many(answers, "raw", dictionary, "w").select("conv_id", "turn", "part", "label")


def _pseudo_sql(fill: str) -> str:
    n = len(CONV_LABELS)
    ll = _label_list_sql(CONV_LABELS)
    return f"""WITH p AS (SELECT conv_id, turn, (list_position({ll}, {_parse_sql('text', CONV_LABELS)}) - 1)::INT AS label_id
  FROM conversations)
SELECT conv_id, turn, coalesce(label_id, -1) AS label_id,
  CASE WHEN label_id IS NULL THEN {fill}::DOUBLE ELSE 1.0::DOUBLE END AS confidence,
  CASE WHEN label_id IS NULL THEN list_transform(range({n}), lambda i: {fill}::DOUBLE)
       ELSE list_transform(range({n}), lambda i: CASE WHEN i = label_id THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) END AS proba
FROM p"""


def _pseudo(spark, sf_dir, mode):
    conv = read_table(spark, sf_dir, "conversations")
    lab = F.array(*[F.lit(l) for l in CONV_LABELS])
    idx = (F.array_position(lab, P.parse_label(F.col("text"), CONV_LABELS)) - 1).cast("int")
    d = conv.select("conv_id", "turn", idx.alias("label_id"))
    d = d.withColumn("proba", pseudo_proba(F.col("label_id"), len(CONV_LABELS), mode))
    return rounded(d.select("conv_id", "turn", "label_id", F.array_max("proba").alias("confidence"), "proba"))


@plan("pseudo_proba_uniform", _pseudo_sql(f"round({1.0 / len(CONV_LABELS)}, 6)"))
def q_pseudo_proba_uniform(spark, sf_dir):
    return _pseudo(spark, sf_dir, "uniform")


@plan("pseudo_proba_zero", _pseudo_sql("0.0"))
def q_pseudo_proba_zero(spark, sf_dir):
    return _pseudo(spark, sf_dir, "zero")


@plan("fixed_length_ids", f"""WITH {TC_SQL}, {VOC_SQL},
occ AS (SELECT doc_id, unnest(tk) AS term, unnest(range(len(tk))) AS pos
  FROM (SELECT doc_id, {_tok_sql('text')} AS tk FROM documents)),
ids AS (SELECT o.doc_id, o.pos, coalesce(v.term_id + {FT.FIRST_ID}, {FT.UNK_ID})::BIGINT AS tid
  FROM occ o LEFT JOIN voc v USING (term)),
win AS (SELECT doc_id, (pos // {MAX_LEN})::INT AS window,
  list_resize(list(tid ORDER BY pos), {MAX_LEN}, 0::BIGINT) AS input_ids,
  list_resize(list(1::BIGINT ORDER BY pos), {MAX_LEN}, 0::BIGINT) AS attention_mask
FROM ids GROUP BY doc_id, pos // {MAX_LEN}),
wins AS (SELECT * FROM win UNION ALL
  SELECT doc_id, 0::INT, list_transform(range({MAX_LEN}), lambda i: 0::BIGINT), list_transform(range({MAX_LEN}), lambda i: 0::BIGINT)
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM win))
SELECT w.*, d.lang AS labels FROM wins w JOIN documents d USING (doc_id)""")
def q_fixed_length_ids(spark, sf_dir):
    docs = _doc_tokens(spark, sf_dir)
    voc = FT.vocabulary(FT.tokenize(docs, "doc_id"), VOCAB_N)
    return FT.fixed_length_ids(docs, "doc_id", voc, MAX_LEN, label_col="lang")


@plan("flatten_utterance", """
SELECT conv_id, regexp_replace(string_agg(text, '' ORDER BY turn), '^\\s+|\\s+$', '', 'g') AS text
FROM conversations GROUP BY conv_id""")
def q_flatten_utterance(spark, sf_dir):
    from escalade.sources.corpus import flatten_turns
    return flatten_turns(read_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


_LINEAR: dict = {}


def _linear(spark, sf_dir):
    """(sparse rows with doc_id, fold, gold; their cross-fitted model; class names), kept for the session's last input."""
    from escalade.operators import linear as LN
    from escalade.operators.labels import collect_labels, encode_with_list
    from escalade.plans.cascade import N_FOLDS, _session_key, _signature, corpus_tokens

    key = (*_session_key(spark), sf_dir, _signature(spark, f"{sf_dir}/documents.parquet"))
    if key not in _LINEAR:
        toks = corpus_tokens(spark, sf_dir).withColumnRenamed("sample_id", "doc_id")
        tc = FT.tokenize(toks, "doc_id")
        voc = materialize(FT.vocabulary(tc, VOCAB_N), "vocabulary")
        labels = collect_labels(label_dictionary(toks, "lang"))
        samples = toks.select("doc_id", "fold", encode_with_list(F.col("lang"), labels).alias("gold"))
        rows = LN.sparse_rows(samples, FT.tfidf(tc, "doc_id", voc, documents=toks), voc, "doc_id")
        rows = materialize(rows, "linear-rows")
        model = LN.fit(rows, voc.count(), len(labels), N_FOLDS)
        _LINEAR.clear()
        _LINEAR[key] = rows, model, labels
    return _LINEAR[key]


@plan("lr_fit_score", f"""WITH {TC_SQL}, {VOC_SQL},
cls AS (SELECT DISTINCT dense_rank() OVER (ORDER BY lang) - 1 AS id FROM documents),
weights AS (SELECT term_id FROM voc UNION ALL SELECT count(*) FROM voc)
SELECT 'gold' AS what, doc_id AS id, (dense_rank() OVER (ORDER BY lang) - 1)::DOUBLE AS value FROM documents
UNION ALL SELECT 'norm', doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM tc JOIN voc USING (term)) THEN 1.0 ELSE 0.0 END::DOUBLE FROM documents
UNION ALL SELECT 'weight', (f.fold * 100 + c.id) * 1000000 + w.term_id, 0.0::DOUBLE FROM range(5) f(fold), cls c, weights w""")
def q_lr_fit_score(spark, sf_dir):
    """What holds at the optimum of each fold's fit: the gradient of every weight and intercept is
    0; with the gold labels and feature norms that the fits read."""
    from escalade.operators import linear as LN
    from escalade.operators.learned import norm

    rows, model, _ = _linear(spark, sf_dir)
    number = (F.col("fold") * 100 + F.col("class")).cast("long") * 1_000_000 + F.col("position")
    weights = LN.conditions(rows, model, "doc_id").select(
        F.lit("weight").alias("what"), number.alias("id"), (F.round("value", 6) + 0.0).alias("value"))
    return rows.select(F.lit("gold").alias("what"), F.col("doc_id").alias("id"), F.col("gold").cast("double").alias("value")) \
        .unionByName(rows.select(F.lit("norm").alias("what"), F.col("doc_id").alias("id"), F.round(norm(F.col("values")), 4).alias("value"))) \
        .unionByName(weights)


@plan("lr_predictions")
def q_lr_predictions(spark, sf_dir):
    """Cross-fitted predictions of the learned tier for every document; ``lr_fit_score`` states
    that every weight they come from is at its optimum."""
    from escalade.operators import linear as LN

    rows, model, _ = _linear(spark, sf_dir)
    scored = LN.score(rows, model, ["doc_id", "gold"])
    return scored.select("doc_id", F.col("gold").alias("gold_label"), "label", F.round("confidence", 6).alias("confidence"))
