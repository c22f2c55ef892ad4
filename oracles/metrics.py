"""DuckDB SQL for the metric, prompt and summary queries."""

from __future__ import annotations

from oracles.base import (
    exact_avg,
    ITEMS,
    ONE_RUN,
    RUN_LONG,
    RUN_METRICS,
    RUN_WIDE,
    TWO_RUNS,
    cased_ws,
    echo_sql,
    metric_sql,
    prompt_sql,
    strip,
    wset,
)

CLAIM_SQL = """list_filter(list_transform(flatten(list_transform(
  list_filter(string_split(regexp_replace({strip_a}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
    lambda s: s <> ''),
  lambda s: CASE WHEN len(string_split_regex(s, '(?i),\\s*(?:and|but|also|moreover|furthermore|however)\\s+')) > 1
    THEN string_split_regex(s, '(?i),\\s*(?:and|but|also|moreover|furthermore|however)\\s+')
    ELSE string_split_regex(s, ';\\s*') END)),
  lambda p: regexp_replace(regexp_replace({strip_p}, '^[.,;:!?]+|[.,;:!?]+$', '', 'g'), '\\s+', ' ', 'g')),
  lambda p: p <> '')"""


def claims_sql(x: str) -> str:
    """Claims of a text column, without look-behind (a marker is put after sentence ends)."""
    return CLAIM_SQL.format(strip_a=strip(f"coalesce({x}, '')"), strip_p=strip("p"))


def _metric(name: str, k: int | None = None) -> str:
    return f"WITH {ONE_RUN} SELECT item_id, round({metric_sql(name, k)}, 6) AS {name} FROM full_prep"


def _hash_vec(x: str) -> str:
    raw = (
        f"list_transform(range(0, 32), lambda i: ('0x' || substr(sha256(i || ':' || coalesce({x}, '')), 1, 4))"
        "::INTEGER::DOUBLE / 65535.0::DOUBLE * 2.0::DOUBLE - 1.0::DOUBLE)"
    )
    return raw


HASH_SIM = f"""WITH {ITEMS},
raw AS (SELECT item_id, {_hash_vec('answer')} AS a, {_hash_vec('ground_truth')} AS g FROM items),
sim AS (SELECT item_id, list_cosine_similarity(a, g)::DOUBLE AS s FROM raw)
SELECT item_id, round(greatest(0.0, least(1.0, (s + 1) / 2)), 6)::DOUBLE AS semantic_similarity,
  round(s, 6)::DOUBLE AS bertscore FROM sim"""

JUDGE_PROMPTS = f"""WITH {ITEMS},
criteria(criteria, task, label, scale) AS (VALUES
  ('faithfulness', 'Judge how far the context backs the answer.', 'Context',
   '0.0 means nothing is backed, 1.0 means everything is backed'),
  ('relevancy', 'Judge how well the answer responds to the question.', 'Question',
   '0.0 means it misses the question, 1.0 means it settles it'),
  ('comprehensiveness', 'Judge how completely the answer treats the topic.', 'Topic',
   '0.0 means hardly at all, 1.0 means every important side is covered'))
SELECT item_id, criteria, CASE WHEN coalesce(question, '') <> '' AND coalesce(answer, '') <> '' THEN
  task || chr(10) || 'Scale: ' || scale || '.' || chr(10) || chr(10) || label || ': ' || question
  || chr(10) || chr(10) || 'Answer: ' || answer || chr(10) || chr(10) || 'Score:' END AS prompt
FROM items CROSS JOIN criteria"""

JUDGE_RESPONSES = """judged AS (SELECT doc_id, CASE doc_id % 7
  WHEN 0 THEN 'The score is 0.' || (n_chars % 100)
  WHEN 1 THEN (n_chars % 101) || '%'
  WHEN 2 THEN 'I rate it ' || (n_chars % 10) || '.5 out of ten'
  WHEN 3 THEN 'Yes, it is Excellent'
  WHEN 4 THEN 'No, not at all'
  WHEN 5 THEN 'unclear; see below'
  ELSE text END AS response FROM documents)"""

JUDGE_SCORE = f"""WITH {JUDGE_RESPONSES},
num AS (SELECT doc_id, lower(response) AS r,
  try_cast(nullif(regexp_extract(response, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS n FROM judged)
SELECT doc_id, round(CASE
  WHEN n IS NOT NULL THEN CASE WHEN n <= 1 THEN n WHEN n <= 10 THEN n / 10 ELSE least(n / 100, 1.0) END
  WHEN regexp_matches(r, 'yes|true|fully|completely|excellent') THEN 1.0
  WHEN regexp_matches(r, 'no|false|not at all|poor') THEN 0.0 ELSE 0.5 END, 6)::DOUBLE AS score FROM num"""

NLI_LABEL = """WITH s AS (SELECT event_id, event_type = 'error' AS blank,
  round(fmod(value, 7) / 7, 6) AS e, round(fmod(value, 5) / 5, 6) AS c, round(fmod(value, 3) / 3, 6) AS n
  FROM events)
SELECT event_id, CASE WHEN blank THEN 'neutral' WHEN e = greatest(e, c, n) THEN 'entailment'
    WHEN c = greatest(e, c, n) THEN 'contradiction' ELSE 'neutral' END AS label,
  round(CASE WHEN blank THEN 1.0 ELSE greatest(e, c, n) END, 6) AS score,
  round(CASE WHEN blank THEN 0.0 ELSE e END, 6) AS entailed_score FROM s"""

CLAIM_BEST = f"""{ITEMS},
claim_lists AS (SELECT item_id, contexts, {claims_sql('answer')} AS cl FROM items),
claim_rows AS (SELECT item_id, contexts, unnest(cl) AS claim, unnest(range(len(cl))) AS claim_idx
  FROM claim_lists),
claim_ctx AS (SELECT item_id, claim_idx, claim, unnest(contexts) AS ctx,
  unnest(range(len(contexts))) AS ctx_idx FROM claim_rows),
entailed AS (SELECT item_id, claim_idx, ctx_idx, CASE WHEN len({wset('claim')}) = 0 THEN 0.0 ELSE
  len(list_intersect({wset('claim')}, {wset('ctx')}))::DOUBLE / len({wset('claim')}) END AS s FROM claim_ctx),
best AS (SELECT * FROM entailed QUALIFY row_number() OVER
  (PARTITION BY item_id, claim_idx ORDER BY s DESC, ctx_idx) = 1)"""

NLI_FAITHFULNESS = f"""WITH {CLAIM_BEST}
SELECT c.item_id, len(c.cl)::BIGINT AS n_claims,
  count(b.claim_idx) FILTER (b.s >= 0.5) AS n_supported,
  round(CASE WHEN len(c.cl) = 0 THEN 1.0 ELSE (count(b.claim_idx) FILTER (b.s >= 0.5))::DOUBLE / len(c.cl) END, 6)
    AS faithfulness_nli
FROM claim_lists c LEFT JOIN best b USING (item_id) GROUP BY c.item_id, len(c.cl)"""

NLI_EVIDENCE = f"""WITH {CLAIM_BEST}
SELECT r.item_id, r.claim_idx, b.ctx_idx, round(b.s, 6) AS entailed_score,
  coalesce(b.s >= 0.5, false) AS supported
FROM claim_rows r LEFT JOIN best b USING (item_id, claim_idx)"""

PROMPT = prompt_sql("question", "contexts")

ORACLES = {
    "m_context_precision": _metric("context_precision"),
    "m_context_recall": _metric("context_recall"),
    "m_precision_at_k": _metric("precision_at_k", 3),
    "m_recall_at_k": _metric("recall_at_k", 3),
    "m_hit_rate": _metric("hit_rate"),
    "m_mrr": _metric("mrr"),
    "m_ndcg": _metric("ndcg"),
    "m_ndcg_at_k": f"WITH {ONE_RUN} SELECT item_id, round({metric_sql('ndcg', 3)}, 6) AS ndcg FROM full_prep",
    "m_exact_match": _metric("exact_match"),
    "m_f1": _metric("f1_score"),
    "m_bleu": _metric("bleu"),
    "m_rouge": _metric("rouge"),
    "m_similarity": _metric("semantic_similarity"),
    "m_similarity_vec": HASH_SIM,
    "m_bertscore": _metric("bertscore"),
    "m_faithfulness": _metric("faithfulness"),
    "m_relevancy": _metric("answer_relevancy"),
    "m_hallucination": _metric("hallucination"),
    "m_latency": "SELECT event_id, round(CASE WHEN value < 0 THEN 0.0 ELSE greatest(0.0, 1.0 - value / 2000.0) END, 6) "
    "AS latency FROM events",
    "m_token_cost": f"""WITH {ONE_RUN}
      SELECT f.item_id, f.prompt_tokens + f.completion_tokens AS total_tokens,
        round({metric_sql('token_count')}, 6) AS token_count,
        round(coalesce(f.prompt_tokens / 1e6::DOUBLE * p.input_rate + f.completion_tokens / 1e6::DOUBLE * p.output_rate, 0.0), 9)
          AS cost_usd
      FROM full_prep f LEFT JOIN prices p ON f.provider = p.provider AND f.model = p.model""",
    "m_word_count": f"WITH {ITEMS} SELECT item_id, round(least(len({cased_ws('answer')})::DOUBLE / 100, 1.0), 6)::DOUBLE AS word_count FROM items",
    "judge_prompts": JUDGE_PROMPTS,
    "judge_score": JUDGE_SCORE,
    "nli_label": NLI_LABEL,
    "nli_faithfulness": NLI_FAITHFULNESS,
    "nli_evidence": NLI_EVIDENCE,
    "nli_support_long": NLI_FAITHFULNESS,
    "m_faithfulness_nli": f"SELECT item_id, faithfulness_nli AS faithfulness FROM ({NLI_FAITHFULNESS})",
    "m_relevancy_nli": f"""WITH {ITEMS} SELECT item_id, CASE WHEN coalesce(question, '') = '' OR coalesce(answer, '') = ''
        OR len({wset('question')}) = 0 THEN 0.0 ELSE
        round(len(list_intersect({wset('question')}, {wset('answer')}))::DOUBLE / len({wset('question')}), 6) END AS answer_relevancy
      FROM items""",
    "build_prompt": f"WITH {ITEMS} SELECT item_id, {PROMPT} AS prompt FROM items",
    "mock_generate": f"""WITH {ITEMS},
      p AS (SELECT item_id, ground_truth, {PROMPT} AS prompt FROM items),
      a AS (SELECT item_id, prompt, {echo_sql('ground_truth', 'prompt')} AS answer FROM p)
      SELECT item_id, answer, len({cased_ws('prompt')})::BIGINT AS prompt_tokens,
        len({cased_ws('answer')})::BIGINT AS completion_tokens,
        (len({cased_ws('prompt')}) + len({cased_ws('answer')}))::BIGINT AS total_tokens FROM a""",
    "mock_retrieve": f"""WITH {ITEMS},
      known AS (SELECT item_id, unnest(ground_truth_contexts[1:2]) AS content,
        unnest(range(1, least(len(ground_truth_contexts), 2) + 1)) AS rank FROM items WHERE ground_truth IS NOT NULL),
      filler AS (SELECT item_id, question, unnest([1, 2]) AS rank FROM items WHERE ground_truth IS NULL)
      SELECT item_id, rank::BIGINT AS rank, 'gt-' || (rank - 1) AS doc_id, content, 1.0::DOUBLE AS score FROM known
      UNION ALL SELECT item_id, rank::BIGINT, 'mock-' || (rank - 1),
        'Mock context ' || rank || ' for query: ' || question, (1.0 - (rank - 1) * 0.25)::DOUBLE FROM filler""",
    "resolve_contexts": f"""WITH {ITEMS},
      r AS (SELECT item_id, CASE WHEN provider IS NOT NULL THEN contexts[1:2]
        WHEN model <> 'gpt-4o' AND coalesce(context, '') <> '' THEN [context] ELSE [] END AS c FROM items)
      SELECT item_id, array_to_string(c, '|') AS contexts, len(c)::BIGINT AS n_contexts FROM r""",
    "eval_items": f"""WITH {RUN_WIDE}
      SELECT run_id, item_id, {', '.join(f'round(m_{m}, 6) AS {m}' for m in RUN_METRICS)},
        array_to_string(list_filter([
          CASE WHEN error_type IS NULL AND latency_ms IS NULL THEN 'latency' END,
          CASE WHEN error_type IS NULL AND len(ret) > 0 AND len(list_distinct(ret)) < len(ret) AND m_ndcg = 0
            AND list_has_any(ret, rel) THEN 'ndcg' END], lambda x: x IS NOT NULL), ',') AS metric_errors FROM wide""",
    "eval_status": f"""WITH {TWO_RUNS}
      SELECT run_id, count(*) AS total_items, count(*) FILTER (error_type IS NULL) AS successful_evaluations,
        count(*) FILTER (error_type IS NOT NULL) AS failed_evaluations FROM both_runs GROUP BY run_id""",
    "run_summary": f"""WITH {TWO_RUNS}
      SELECT run_id, count(*) AS total, count(error_type) AS errors,
        sum(prompt_tokens + completion_tokens)::BIGINT AS total_tokens,
        round(avg(latency_ms), 6) AS average_latency_ms FROM both_runs GROUP BY run_id""",
    "metric_means": f"WITH {RUN_LONG} SELECT run_id, metric, {exact_avg('score')} AS mean_score, count(*) AS n FROM long GROUP BY ALL",
    "flat_metrics": f"""WITH {RUN_LONG}
      SELECT run_id, metric, {exact_avg('score')} AS value FROM long GROUP BY ALL
      UNION ALL SELECT run_id, 'total_items', count(*)::DOUBLE FROM wide GROUP BY run_id
      UNION ALL SELECT run_id, 'successful_evaluations', (count(*) - count(error_type))::DOUBLE FROM wide GROUP BY run_id
      UNION ALL SELECT run_id, 'failed_evaluations', count(error_type)::DOUBLE FROM wide GROUP BY run_id""",
    "metric_bands": f"""WITH {RUN_LONG},
      means AS (SELECT run_id, metric, {exact_avg('score')} AS s FROM long GROUP BY ALL),
      every AS (SELECT * FROM means UNION ALL SELECT run_id, 'overall', avg(s) FROM means GROUP BY run_id)
      SELECT run_id, metric, round(s, 6) AS score,
        CASE WHEN s >= 0.8 THEN 'good' WHEN s >= 0.5 THEN 'fair' ELSE 'poor' END AS band FROM every""",
    "report_errors": f"WITH {TWO_RUNS} SELECT run_id, error_type, count(*) AS n FROM both_runs WHERE error_type IS NOT NULL GROUP BY ALL",
    "report_examples": f"""WITH {RUN_WIDE} SELECT run_id, item_id, question, answer, round(m_f1_score, 6) AS f1_score
      FROM wide ORDER BY item_id, run_id LIMIT 10""",
}
