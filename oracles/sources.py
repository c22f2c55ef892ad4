"""SQL of the queries that write files and read them back: the tables themselves."""

from __future__ import annotations

from oracles.base import ITEMS, RUN_LONG, exact_avg, strip

ORACLES = {
    "json_items": f"WITH {ITEMS} SELECT question, ground_truth, context FROM items",
    "jsonl_items": f"WITH {ITEMS} SELECT question, ground_truth, context FROM items",
    "csv_items": f"""WITH {ITEMS} SELECT coalesce({strip('question')}, '') AS question,
        nullif({strip('ground_truth')}, '') AS ground_truth, nullif({strip('context')}, '') AS context FROM items""",
    "file_corpus": "SELECT item_id, rtrim(text, chr(10)) AS content, '.txt' AS extension FROM benchmark",
    "saved_runs": f"""WITH {RUN_LONG}, means AS (SELECT run_id, metric, {exact_avg('score')} AS s FROM long GROUP BY ALL),
      scores AS (SELECT run_id, avg(s) AS score FROM means GROUP BY run_id)
      SELECT run_id, count(*) AS total, count(error_type) AS errors,
        'data/' || run_id AS dataset_path, round(any_value(score), 6) AS score
      FROM wide JOIN scores USING (run_id) GROUP BY run_id""",
}
