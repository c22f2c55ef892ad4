"""DuckDB SQL for diagnosis, gates, comparison, history and dataset queries."""

from __future__ import annotations

from oracles.base import (
    exact_avg,
    ITEMS,
    RUN_LONG,
    RUN_METRICS,
    RUN_WIDE,
    TWO_RUNS,
    jaccard,
    keywords,
    metric_sql,
    prep,
    strip,
    wset,
)
from oracles.corpus import PIECES

N_RETRIEVAL = 4  # context_precision, context_recall, mrr, ndcg

RULES = f"""{RUN_WIDE},
facts AS (SELECT run_id, item_id, m_context_precision AS p, m_context_recall AS r, m_faithfulness AS f,
    m_answer_relevancy AS a, len(contexts) AS n, length(answer) AS al,
    list_min(list_transform(contexts, lambda c: length(c))) AS lo,
    list_max(list_transform(contexts, lambda c: length(c))) AS hi FROM wide),
hits AS (
  SELECT run_id, item_id, 1 AS no, 'empty_retrieval' AS mode, 'retrieval' AS blame, 0.95::DOUBLE AS confidence,
    'Nothing was retrieved for the question.' AS reason FROM facts WHERE n = 0
  UNION ALL SELECT run_id, item_id, 2, 'low_context_relevance', 'retrieval', 0.8,
    'Few contexts are relevant (precision ' || floor(p * 100 + 1e-9)::BIGINT || '%' || ').' FROM facts WHERE n > 0 AND p < 0.3
  UNION ALL SELECT run_id, item_id, 3, 'missing_context', 'retrieval', 0.75,
    'Relevant contexts are missing (recall ' || floor(r * 100 + 1e-9)::BIGINT || '%' || ').' FROM facts WHERE n > 0 AND r < 0.3
  UNION ALL SELECT run_id, item_id, 4, 'off_topic_answer', 'generation', 0.7,
    'The answer is empty or very short although contexts were found.' FROM facts WHERE n > 0 AND al < 10
  UNION ALL SELECT run_id, item_id, 5, 'hallucination', 'generation', 0.85,
    'The contexts do not back the answer (faithfulness ' || floor(f * 100 + 1e-9)::BIGINT || '%' || ').' FROM facts WHERE al >= 10 AND f < 0.4
  UNION ALL SELECT run_id, item_id, 6, 'off_topic_answer', 'generation', 0.75,
    'The answer misses the question (relevancy ' || floor(a * 100 + 1e-9)::BIGINT || '%' || ').' FROM facts WHERE al >= 10 AND a < 0.4
  UNION ALL SELECT run_id, item_id, 7, 'chunking_split_info_lost', 'chunking', 0.6,
    'Context lengths are uneven (' || lo || ' to ' || hi || ').' FROM facts WHERE n >= 2 AND lo > 0 AND hi::DOUBLE / lo > 5),
per_target AS (SELECT run_id, item_id, blame, sum(confidence) AS s, min(no) AS first, max(confidence) AS top,
    array_to_string(list(reason ORDER BY no)[1:3], '; ') AS reason FROM hits GROUP BY ALL),
winner AS (SELECT * FROM per_target QUALIFY row_number() OVER (PARTITION BY run_id, item_id ORDER BY round(s, 9) DESC, first) = 1),
counts AS (SELECT blame AS target, count(*) AS n FROM hits GROUP BY blame)"""

GATES = """gates(gate, behavior, no, metric, op, value, required) AS (VALUES
  ('quality', 'fail', 0, 'faithfulness', 'gte', 0.5::DOUBLE, true), ('quality', 'fail', 1, 'f1_score', 'gt', 0.05, true),
  ('speed', 'warn', 0, 'latency', 'gte', 0.9, true), ('speed', 'warn', 1, 'token_count', 'gt', 0.9, false),
  ('sanity', 'fail', 0, 'exact_match', 'lte', 1, true), ('sanity', 'fail', 1, 'total_items', 'neq', 0, true),
  ('unknown', 'skip', 0, 'no_such_metric', 'gt', 0, true), ('unknown', 'skip', 1, 'exact_match', 'eq', 0, false))"""

THRESHOLDS = f"""{RUN_LONG},
flat AS (SELECT run_id, metric, {exact_avg('score')} AS v FROM long GROUP BY ALL
  UNION ALL SELECT run_id, 'total_items', count(*)::DOUBLE FROM wide GROUP BY run_id),
{GATES},
run_ids AS (SELECT DISTINCT run_id FROM wide),
checked AS (SELECT r.run_id, g.*, f.v AS actual, coalesce(CASE op WHEN 'gt' THEN v > value WHEN 'gte' THEN v >= value
    WHEN 'lt' THEN v < value WHEN 'lte' THEN v <= value WHEN 'eq' THEN abs(v - value) < 1e-6 ELSE abs(v - value) >= 1e-6 END, false) AS passed
  FROM run_ids r CROSS JOIN gates g LEFT JOIN flat f ON f.run_id = r.run_id AND f.metric = g.metric),
gate_rows AS (SELECT run_id, gate, behavior, bool_and(passed) AS passed, count(*) AS total_thresholds,
    count(*) FILTER (passed) AS passed_thresholds, count(*) FILTER (NOT passed AND required) > 0 AS has_reasons
  FROM checked GROUP BY ALL)"""

MEANS = f"""{RUN_LONG},
means AS (SELECT run_id, metric, {exact_avg('score')} AS m FROM long
  WHERE NOT (run_id = 'echo' AND metric = 'latency') AND NOT (run_id = 'logged' AND metric = 'exact_match') GROUP BY ALL)"""

SCORE = " + ".join(f"avg(CASE WHEN error_type IS NULL THEN {metric_sql(m)} ELSE 0.0 END)" for m in RUN_METRICS)
RUNS = f"""{ITEMS},
one_run AS (SELECT 'logged' AS run_id, * FROM items),
{prep('one_run')},
runs AS (SELECT 'run-' || conv_id AS run_id, TIMESTAMP '2024-01-01' + to_hours((conv_id * 37 % 1000)::INTEGER) AS created_at,
    ['data/a/', 'data/b/', 'data/c/'][conv_id % 3 + 1] || conv_id AS dataset_path,
    ['json', 'markdown'][conv_id % 2 + 1] AS output, count(error_type) AS errors,
    round(({SCORE}) / {len(RUN_METRICS)}, 9) AS score,
    round(sum(coalesce(f.prompt_tokens / 1e6::DOUBLE * p.input_rate + f.completion_tokens / 1e6::DOUBLE * p.output_rate, 0.0)), 12) AS cost
  FROM full_prep f LEFT JOIN prices p ON p.pos = conv_id % 12 GROUP BY conv_id)"""
LISTED = """run_id, strftime(created_at, '%Y-%m-%d %H:%M') AS created_at, dataset_path, errors,
  round(score, 6) AS score, round(cost, 9) AS cost, CASE WHEN errors > 0 THEN 'failed' ELSE 'ok' END AS status"""


def _gap(source: str, seen: str, ctx: str) -> str:
    return f"""SELECT item_id, '{seen}' AS contexts_seen, len(missing)::DOUBLE / len(wanted) AS m,
      'Question words missing from the contexts: ' || array_to_string(list_sort(missing)[1:5], ', ') || '.' AS description
      FROM (SELECT item_id, wanted, list_filter(wanted, lambda w: NOT contains(t, w)) AS missing
        FROM (SELECT item_id, {keywords('question')} AS wanted, lower(array_to_string({ctx}, ' ')) AS t
          FROM {source} WHERE len({ctx}) > 0)) WHERE len(wanted) > 0 AND len(missing) > len(wanted) * 0.6::DOUBLE"""


ORACLES = {
    "component_scores": f"""WITH {RUN_WIDE} SELECT run_id, item_id, {N_RETRIEVAL}::BIGINT AS n_retrieval,
        {len(RUN_METRICS) - N_RETRIEVAL}::BIGINT AS n_generation, round(m_context_recall, 6) AS context_recall,
        round(m_faithfulness, 6) AS faithfulness, len(contexts)::BIGINT AS context_count,
        array_to_string(list_transform(contexts, lambda c: length(c)), ',') AS context_lengths,
        length(answer)::BIGINT AS answer_length FROM wide""",
    "diag_failures": f"""WITH {RULES} SELECT run_id, item_id,
        row_number() OVER (PARTITION BY run_id, item_id ORDER BY no) - 1 AS seq, mode, blame, confidence, reason FROM hits""",
    "diag_blame": f"""WITH {RULES} SELECT f.run_id, f.item_id, coalesce(w.blame, 'unknown') AS target,
        coalesce(w.top, 0.0)::DOUBLE AS confidence, coalesce(w.reason, 'No significant failures found.') AS reason
      FROM facts f LEFT JOIN winner w USING (run_id, item_id)""",
    "diag_chunk_overlap": f"""WITH {ITEMS}, {PIECES},
      every AS (SELECT item_id, contexts FROM items UNION ALL SELECT item_id, contexts FROM chunk_items),
      c AS (SELECT item_id, unnest(contexts) AS c, unnest(range(len(contexts))) AS i FROM every),
      p AS (SELECT a.item_id, a.i AS ctx_i, b.i AS ctx_j, {jaccard(wset('a.c'), wset('b.c'))} AS m
        FROM c a JOIN c b ON a.item_id = b.item_id AND a.i < b.i)
      SELECT item_id, ctx_i, ctx_j, round(m, 6)::DOUBLE AS measure FROM p WHERE m > 0.8""",
    "diag_chunk_char_overlap": f"""WITH {PIECES},
      o AS (SELECT item_id, coalesce(list_max(list_filter(range(1, least(length(c), length(nxt)) + 1),
        lambda n: right(c, n) = left(nxt, n) OR right(nxt, n) = left(c, n))), 0) AS n FROM chunk_items WHERE nxt IS NOT NULL)
      SELECT item_id, 0::BIGINT AS ctx_i, 1::BIGINT AS ctx_j, n::DOUBLE AS measure FROM o WHERE n > 150""",
    "diag_chunk_sizes": f"""WITH {ITEMS},
      s AS (SELECT item_id, list_min(list_transform(contexts, lambda c: length(c))) AS lo,
        list_max(list_transform(contexts, lambda c: length(c))) AS hi, len(contexts) AS n FROM items)
      SELECT item_id, NULL::BIGINT AS ctx_i, NULL::BIGINT AS ctx_j, round(hi::DOUBLE / lo, 6) AS measure FROM s
      WHERE n >= 2 AND lo > 0 AND hi::DOUBLE / lo > 4""",
    "diag_chunk_deviation": f"""WITH {PIECES},
      c AS (SELECT item_id, unnest(contexts) AS c, unnest(range(len(contexts))) AS i FROM chunk_items)
      SELECT item_id, i AS ctx_i, NULL::BIGINT AS ctx_j, round(abs(length(c) - 500) / 500.0::DOUBLE, 6) AS measure
      FROM c WHERE abs(length(c) - 500) / 500.0::DOUBLE > 0.5""",
    "diag_chunk_small": f"""WITH {ITEMS}, {PIECES},
      c AS (SELECT item_id, unnest(contexts) AS c, unnest(range(len(contexts))) AS i, 50 AS least FROM chunk_items
        UNION ALL SELECT item_id, unnest(contexts), unnest(range(len(contexts))), 50 FROM items)
      SELECT item_id, i AS ctx_i, NULL::BIGINT AS ctx_j, length({strip('c')})::DOUBLE AS measure FROM c
      WHERE length({strip('c')}) < least""",
    "diag_content_gap": f"""WITH {ITEMS},
      g AS ({_gap('items', 'all', 'contexts')} UNION ALL {_gap('items', 'first', 'contexts[1:1]')})
      SELECT item_id, contexts_seen, round(m, 6) AS measure, description FROM g""",
    "diag_summary": f"""WITH {RULES},
      h AS (SELECT count(*) AS total, count(*) FILTER (w.blame IS NULL) AS good FROM facts f LEFT JOIN winner w USING (run_id, item_id))
      SELECT total AS total_items, good AS healthy_items, round(good::DOUBLE / total, 6) AS overall_health,
        CASE WHEN good::DOUBLE / total >= 0.8 THEN 'good' WHEN good::DOUBLE / total >= 0.5 THEN 'fair' ELSE 'poor' END AS health_label FROM h""",
    "diag_mode_counts": f"WITH {RULES} SELECT mode, count(*) AS n FROM hits WHERE confidence >= 0.3 GROUP BY mode",
    "diag_share": f"WITH {RULES} SELECT target, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS share FROM counts",
    "diag_recommend": f"""WITH {RULES},
      advice(target, t, a, text) AS (VALUES
        ('retrieval', 0, 0, 'Check that the index covers the questions and is up to date.'),
        ('retrieval', 0, 1, 'Try another embedding model or a hybrid of words and vectors.'),
        ('retrieval', 0, 2, 'Retrieve more contexts and re-rank them.'),
        ('retrieval', 0, 3, 'Rewrite or expand queries before searching.'),
        ('retrieval', 0, 4, 'Add filters on document metadata.'),
        ('generation', 1, 0, 'Tell the model to answer from the contexts only.'),
        ('generation', 1, 1, 'Lower the sampling temperature.'), ('generation', 1, 2, 'Use a stronger model.'),
        ('generation', 1, 3, 'Ask for citations of the contexts.'), ('generation', 1, 4, 'Add an answer check before returning.'),
        ('chunking', 2, 0, 'Use one chunk size throughout.'), ('chunking', 2, 1, 'Let chunks overlap by a tenth to a fifth.'),
        ('chunking', 2, 2, 'Split at paragraph or sentence ends.'), ('chunking', 2, 3, 'Drop or merge very small chunks.'),
        ('chunking', 2, 4, 'Keep tables and lists in one piece.')),
      r AS (SELECT row_number() OVER (ORDER BY n DESC, t, a) AS position, '[' || upper(target) || '] (' || n || ' failures) ' || text AS recommendation
        FROM counts JOIN advice USING (target))
      SELECT position, recommendation FROM r WHERE position <= 5""",
    "gate_thresholds": f"WITH {THRESHOLDS} SELECT run_id, gate, metric, op, value::DOUBLE AS value, round(actual, 6) AS actual, passed FROM checked",
    "gate_results": f"WITH {THRESHOLDS} SELECT run_id, gate, behavior, passed, total_thresholds, passed_thresholds, has_reasons FROM gate_rows",
    "gate_overall": f"""WITH {THRESHOLDS} SELECT run_id, bool_and(passed OR behavior <> 'fail') AS passed, count(*) AS total_gates,
        count(*) FILTER (passed) AS passed_gates, count(*) FILTER (NOT passed) AS failed_gates,
        sum(total_thresholds)::BIGINT AS total_thresholds, sum(passed_thresholds)::BIGINT AS passed_thresholds,
        sum(total_thresholds - passed_thresholds)::BIGINT AS failed_thresholds FROM gate_rows GROUP BY run_id""",
    "compare_runs": f"""WITH {MEANS},
      c AS (SELECT metric, coalesce(b.m, 0.0) AS b, coalesce(e.m, 0.0) AS e
        FROM (SELECT * FROM means WHERE run_id = 'logged') b FULL JOIN (SELECT * FROM means WHERE run_id = 'echo') e USING (metric))
      SELECT metric, round(b, 6)::DOUBLE AS baseline, round(e, 6)::DOUBLE AS experiment, round(e - b, 6)::DOUBLE AS delta,
        CASE WHEN e - b > 0.001 THEN 'improved' WHEN e - b < -0.001 THEN 'regressed' ELSE 'unchanged' END AS verdict,
        CASE WHEN metric = 'hallucination' THEN 'lower_is_better' ELSE 'higher_is_better' END AS direction FROM c""",
    "compare_overall": f"""WITH {MEANS},
      c AS (SELECT count(*) AS n, avg(b.m) AS b, avg(e.m) AS e FROM means b JOIN means e ON b.metric = e.metric
        AND b.run_id = 'logged' AND e.run_id = 'echo')
      SELECT n AS common_metrics, round(b, 6) AS baseline_overall, round(e, 6) AS experiment_overall, round(e - b, 6) AS delta,
        CASE WHEN e > b THEN 'echo' WHEN e < b THEN 'logged' ELSE 'tie' END AS winner FROM c""",
    "compare_counts": f"""WITH {TWO_RUNS} SELECT count(*) FILTER (run_id = 'logged') AS baseline_results,
        count(*) FILTER (run_id = 'echo') AS experiment_results, count(error_type) FILTER (run_id = 'logged') AS baseline_errors,
        count(error_type) FILTER (run_id = 'echo') AS experiment_errors FROM both_runs""",
    "run_history": f"""WITH {RUNS} SELECT {LISTED} FROM runs WHERE output = 'json' AND contains(dataset_path, 'a/')
      ORDER BY runs.score DESC NULLS LAST, run_id LIMIT 20""",
    "run_history_cost": f"WITH {RUNS} SELECT {LISTED} FROM runs ORDER BY runs.cost, run_id LIMIT 15",
    "latest_run": f"WITH {RUNS} SELECT {LISTED} FROM runs ORDER BY runs.created_at DESC, run_id LIMIT 1",
    "map_fields": f"""WITH {ITEMS} SELECT item_id AS source_row, question,
        CASE WHEN conv_id % 2 = 0 THEN ground_truth ELSE answer END AS ground_truth, context FROM items""",
    "page_items": f"""SELECT 'What does this page say?' AS question, {strip('text')} AS context, doc_id AS page, source
      FROM documents WHERE {strip('text')} <> ''""",
    "validate_items": f"""SELECT conv_id || ':' || turn AS item_id, {strip('text')} AS question,
        CASE WHEN (conv_id + turn) % 5 <> 0 AND {strip('text')} <> '' THEN text END AS ground_truth,
        CASE WHEN (conv_id + turn) % 3 <> 0 THEN role END AS context FROM conversations
      WHERE (conv_id + turn) % 7 <> 0 AND (conv_id + turn) % 11 <> 0 AND {strip('text')} <> ''""",
    "rejected_items": """SELECT conv_id || ':' || turn AS item_id, CASE WHEN (conv_id + turn) % 7 = 0 THEN 'question is blank'
        ELSE 'question is missing' END AS errors FROM conversations WHERE (conv_id + turn) % 7 = 0 OR (conv_id + turn) % 11 = 0""",
    "sample_items": f"WITH {ITEMS} SELECT item_id, question FROM items ORDER BY md5('42:' || item_id), item_id LIMIT 50",
    "latency_windowed": f"""WITH w AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS s, event_type AS stage, count(*) AS n,
        {exact_avg('(CASE WHEN value < 0 THEN 0.0 ELSE greatest(0.0, 1.0 - value / 2000.0) END)')} AS m FROM events GROUP BY ALL)
      SELECT strftime(s, '%Y-%m-%d %H:%M') AS window_start, stage, n, round(m, 6) AS mean_score, m >= 0.97 AS passed FROM w""",
}
