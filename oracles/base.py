"""SQL building blocks shared by the DuckDB oracles: the derived views and word lists.

Everything is written separately from the Spark code, on purpose.
"""

from __future__ import annotations

QUESTION_STOP = (
    "the a an is are was were be been being have has had do does did will would could should "
    "may might shall can what how why when where who which"
).split()
KEYWORD_STOP = (
    "what how why when where which who does have been from with that this will about into "
    "your some than"
).split()


def exact_avg(x: str) -> str:
    """Mean to the millionth, halves up, from whole billionths."""
    units = f"sum(CAST(round({x} * 1e9) AS HUGEINT))"
    return f"(((2 * {units} + 1000 * count({x})) // (2000 * count({x})))::DOUBLE / 1e6)"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def ws(x: str) -> str:
    """Lower-case whitespace tokens with repeats."""
    return (
        f"list_filter(string_split_regex(lower(coalesce({x}, '')), '\\s+'), lambda w: w <> '')"
    )


def cased_ws(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '\\s+'), lambda w: w <> '')"


def wset(x: str) -> str:
    return f"list_distinct({ws(x)})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def norm_ctx(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '\\s+', ' ', 'g'))"


def minus(x: str, words: list[str]) -> str:
    return f"list_filter({x}, lambda w: NOT list_contains({sql_list(words)}, w))"


def question_words(x: str) -> str:
    found = f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]+'))"
    return minus(found, QUESTION_STOP)


def keywords(x: str) -> str:
    """Word tokens of four or more characters."""
    found = f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]+'))"
    return minus(f"list_filter({found}, lambda w: length(w) >= 4)", KEYWORD_STOP)


def jaccard(a: str, b: str) -> str:
    return (
        f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE "
        f"len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"
    )


PRICES = """prices(pos, provider, model, input_rate, output_rate) AS (VALUES
  (0, 'openai', 'gpt-4o', 2.50::DOUBLE, 10.00::DOUBLE), (1, 'openai', 'gpt-4o-mini', 0.15, 0.60),
  (2, 'openai', 'gpt-4-turbo', 10.00, 30.00), (3, 'openai', 'gpt-3.5-turbo', 0.50, 1.50),
  (4, 'anthropic', 'claude-3-opus', 15.00, 75.00), (5, 'anthropic', 'claude-3-sonnet', 3.00, 15.00),
  (6, 'anthropic', 'claude-3-haiku', 0.25, 1.25), (7, 'gemini', 'gemini-pro', 0.50, 1.50),
  (8, 'gemini', 'gemini-1.5-pro', 3.50, 10.50), (9, 'groq', 'llama-3-70b', 0.59, 0.79),
  (10, 'groq', 'llama-3-8b', 0.05, 0.08))"""

ITEMS = f"""{PRICES},
spans AS (
  SELECT c.conv_id, c.turn, c.text AS answer,
    max(p.turn) FILTER (p.role = 'assistant') AS last_answer, max(p.turn) FILTER (p.role = 'user') AS asked
  FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn < c.turn
  WHERE c.role = 'assistant' GROUP BY c.conv_id, c.turn, c.text),
turns AS (
  SELECT s.conv_id, s.turn, s.answer, any_value(q.text) AS question,
    any_value(p.text) FILTER (p.turn = s.last_answer) AS ground_truth,
    coalesce(list(p.text ORDER BY p.turn) FILTER (p.text IS NOT NULL), []) AS contexts
  FROM spans s LEFT JOIN conversations p
    ON p.conv_id = s.conv_id AND p.turn < s.turn AND p.turn >= coalesce(s.last_answer, -1)
  LEFT JOIN conversations q ON q.conv_id = s.conv_id AND q.turn = s.asked
  GROUP BY s.conv_id, s.turn, s.answer),
items AS (
  SELECT t.conv_id || ':' || t.turn AS item_id, t.conv_id, question, answer, ground_truth, contexts,
    p.provider, p.model,
    list_filter([replace(ground_truth, chr(10), '  '), replace(question, chr(10), '  '),
      replace(answer, chr(10), '  ')], lambda x: x IS NOT NULL) AS ground_truth_contexts,
    contexts[1] AS context,
    len({cased_ws('question')}) + len({cased_ws("array_to_string(contexts, ' ')")}) AS prompt_tokens,
    len({cased_ws('answer')}) AS completion_tokens,
    CASE WHEN p.provider IS NOT NULL THEN length(answer) * 1.5::DOUBLE END AS latency_ms,
    CASE WHEN question IS NULL THEN 'invalid item'
         WHEN length(answer) < 350 THEN 'no full answer' END AS error_type
  FROM turns t LEFT JOIN prices p ON p.pos = t.conv_id % 12)"""


def prompt_sql(q: str, ctx: str) -> str:
    numbered = (
        f"array_to_string(list_transform({ctx}, lambda c, i: '[' || i || '] ' || c), "
        "chr(10) || chr(10))"
    )
    return (
        f"CASE WHEN len({ctx}) = 0 THEN '' ELSE 'Context:' || chr(10) || {numbered} || chr(10) || "
        f"chr(10) END || 'Question: ' || coalesce({q}, '') || chr(10) || chr(10) || 'Answer:'"
    )


def echo_sql(gt: str, prompt: str) -> str:
    return (
        f"coalesce(nullif({gt}, ''), '[mock-answer] ' || substr({strip(prompt)}, 1, 200))"
    )


def prep(source: str, extra: str = "") -> str:
    """Token lists and multiset overlap over ``source``; needs item_id to be unique in it."""
    ctx_text = "array_to_string(contexts, ' ')"
    return f"""prep AS (
  SELECT *, {ws('answer')} AS aw, {ws('ground_truth')} AS tw, {wset('answer')} AS aset,
    {wset('ground_truth')} AS tset, {wset(ctx_text)} AS cset,
    {question_words('question')} AS qk, {question_words('answer')} AS ak,
    list_transform(contexts, lambda c: {norm_ctx('c')}) AS ret,
    list_transform(ground_truth_contexts, lambda c: {norm_ctx('c')}) AS rel
  FROM {source}),
aw_counts AS (SELECT run_id, item_id, w, count(*) AS n FROM
  (SELECT run_id, item_id, unnest(aw) AS w FROM prep) GROUP BY ALL),
tw_counts AS (SELECT run_id, item_id, w, count(*) AS n FROM
  (SELECT run_id, item_id, unnest(tw) AS w FROM prep) GROUP BY ALL),
shared AS (SELECT a.run_id, a.item_id, sum(least(a.n, t.n))::DOUBLE AS common
  FROM aw_counts a JOIN tw_counts t USING (run_id, item_id, w) GROUP BY ALL),
full_prep AS (SELECT p.*, coalesce(s.common, 0.0) AS common
  FROM prep p LEFT JOIN shared s USING (run_id, item_id)){extra}"""


ONE_RUN = f"""{ITEMS},
one_run AS (SELECT 'logged' AS run_id, * FROM items),
{prep('one_run')}"""

ECHO_ITEMS = f"""echo_base AS (
  SELECT * REPLACE ({echo_sql('ground_truth', prompt_sql('question', 'contexts'))} AS answer)
  FROM items),
echo_items AS (
  SELECT * REPLACE (len({cased_ws('answer')}) AS completion_tokens,
    CASE WHEN question IS NULL THEN 'invalid item' END AS error_type) FROM echo_base)"""

TWO_RUNS = f"""{ITEMS},
{ECHO_ITEMS},
both_runs AS (SELECT 'logged' AS run_id, * FROM items
  UNION ALL BY NAME SELECT 'echo' AS run_id, * FROM echo_items),
{prep('both_runs')}"""


def _hits(listed: str, wanted: str) -> str:
    return f"len(list_filter({listed}, lambda x: list_contains({wanted}, x)))"


def _dcg(marks: str) -> str:
    return (
        f"coalesce(list_sum(list_transform({marks}, lambda m, i: "
        "CASE WHEN NOT m THEN 0.0 WHEN i = 1 THEN 1.0 ELSE 1.0 / log2(i) END)), 0.0)"
    )


def raw_ndcg(k: str) -> str:
    marks = f"list_transform(ret[1:({k})], lambda x: list_contains(rel, x))"
    ideal = f"list_transform(range(1, least(len(list_distinct(rel)), {k}) + 1), lambda x: true)"
    return (
        f"CASE WHEN len(ret) = 0 OR len(rel) = 0 OR ({k}) = 0 THEN 0.0 "
        f"ELSE {_dcg(marks)} / {_dcg(ideal)} END"
    )


def metric_sql(name: str, k: int | None = None) -> str:
    """A metric over ``full_prep``, as SQL."""
    depth = "len(ret)" if k is None else str(k)
    top = "ret" if k is None else f"ret[1:{k}]"
    empty = "len(ret) = 0 OR len(rel) = 0"
    no_gt = "coalesce(ground_truth, '') = ''"
    no_answer = "coalesce(answer, '') = ''"
    table = {
        "context_precision": f"CASE WHEN {empty} THEN 0.0 ELSE {_hits('ret', 'rel')}::DOUBLE / len(ret) END",
        "context_recall": f"CASE WHEN {empty} THEN 0.0 ELSE {_hits('rel', 'ret')}::DOUBLE / len(rel) END",
        "precision_at_k": f"CASE WHEN {depth} = 0 OR len(rel) = 0 THEN 0.0 ELSE {_hits(top, 'rel')}::DOUBLE / {depth} END",
        "recall_at_k": f"CASE WHEN {empty} THEN 0.0 ELSE len(list_intersect(list_distinct(rel), list_distinct({top})))::DOUBLE / len(list_distinct(rel)) END",
        "hit_rate": "CASE WHEN list_has_any(ret, rel) THEN 1.0 ELSE 0.0 END",
        "mrr": "coalesce(1.0::DOUBLE / nullif(list_position(list_transform(ret, lambda x: list_contains(rel, x)), true), 0), 0.0)",
        "ndcg": f"CASE WHEN {raw_ndcg(depth)} > 1.0 THEN 0.0 ELSE {raw_ndcg(depth)} END",
        "exact_match": f"CASE WHEN {no_gt} THEN 0.0 WHEN lower({strip('answer')}) = lower({strip('ground_truth')}) THEN 1.0 ELSE 0.0 END",
        "f1_score": f"CASE WHEN {no_answer} AND {no_gt} THEN 1.0 WHEN {no_gt} THEN 0.0 WHEN len(aw) + len(tw) = 0 THEN 1.0 "
        "WHEN common = 0 THEN 0.0 ELSE 2 * (common / len(aw)) * (common / len(tw)) / (common / len(aw) + common / len(tw)) END",
        "bleu": f"CASE WHEN {no_answer} OR {no_gt} OR len(aw) = 0 OR len(tw) = 0 THEN 0.0 ELSE common / len(aw) * least(1.0, len(aw)::DOUBLE / len(tw)) END",
        "rouge": "CASE WHEN len(tset) = 0 THEN 0.0 ELSE len(list_intersect(tset, aset))::DOUBLE / len(tset) END",
        "semantic_similarity": jaccard("aset", "tset"),
        "bertscore": jaccard("aset", "tset"),
        "faithfulness": "CASE WHEN len(aset) = 0 OR len(contexts) = 0 THEN 0.0 ELSE len(list_intersect(aset, cset))::DOUBLE / len(aset) END",
        "answer_relevancy": f"CASE WHEN coalesce(question, '') = '' OR {no_answer} THEN 0.0 WHEN len(qk) = 0 THEN 1.0 ELSE len(list_intersect(qk, ak))::DOUBLE / len(qk) END",
        "hallucination": f"CASE WHEN {no_answer} THEN 0.0 WHEN len(contexts) = 0 THEN 1.0 WHEN len(aset) = 0 THEN 0.0 ELSE 1.0 - len(list_intersect(aset, cset))::DOUBLE / len(aset) END",
        "latency": "CASE WHEN latency_ms IS NULL OR latency_ms < 0 THEN 0.0 ELSE greatest(0.0, 1.0 - latency_ms / 2000.0) END",
        "token_count": "greatest(0.0, 1.0 - (prompt_tokens + completion_tokens)::DOUBLE / 20000)",
    }
    return f"({table[name]})::DOUBLE"


RUN_METRICS = [
    "context_precision", "context_recall", "mrr", "ndcg", "faithfulness", "answer_relevancy",
    "hallucination", "f1_score", "exact_match", "latency", "token_count",
]

RUN_WIDE = f"""{TWO_RUNS},
wide AS (SELECT *, {', '.join(
    f"CASE WHEN error_type IS NOT NULL THEN 0.0::DOUBLE ELSE {metric_sql(m)} END AS m_{m}"
    for m in RUN_METRICS)} FROM full_prep)"""

RUN_LONG = f"""{RUN_WIDE},
long AS ({' UNION ALL '.join(
    f"SELECT run_id, item_id, '{m}' AS metric, m_{m} AS score FROM wide" for m in RUN_METRICS)})"""

CORPUS = """corpus AS (
  SELECT doc_id, lang, source, coalesce('Last updated: ' || CASE doc_id % 5
      WHEN 0 THEN strftime(d, '%Y-%m-%dT08:30:00')
      WHEN 1 THEN strftime(d, '%Y-%m-%d')
      WHEN 2 THEN month(d) || '/' || day(d) || '/' || year(d)
      WHEN 3 THEN monthname(d) || ' ' || day(d) || ', ' || year(d) END || chr(10) || text, text)
    AS content,
    CASE doc_id % 5 WHEN 4 THEN NULL WHEN 0 THEN d::TIMESTAMP + INTERVAL '8 hours 30 minutes'
      ELSE d::TIMESTAMP END AS planted
  FROM (SELECT *, DATE '2020-01-01' + (doc_id * 7 % 1700)::INTEGER AS d FROM documents))"""
