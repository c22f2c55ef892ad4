"""DuckDB SQL for the text, audit and synthesis queries."""

from __future__ import annotations

from oracles.base import (
    CORPUS,
    ITEMS,
    cased_ws,
    jaccard,
    keywords,
    norm_ctx,
    question_words,
    strip,
    wset,
)
from oracles.metrics import claims_sql

CHUNK_ROWS = f"""windows AS (SELECT doc_id, s, trim(regexp_replace(substr(text, s + 1, 2000), '^\\s+|\\s+$', '', 'g')) AS c0
  FROM (SELECT doc_id, text, unnest(range(0, length(text), 1800)) AS s FROM documents)),
chunk_rows AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_idx, c0 AS chunk
  FROM windows WHERE c0 <> '')"""

PIECES = """piece_windows AS (SELECT doc_id, s, regexp_replace(substr(text, s + 1, 1000), '^\\s+|\\s+$', '', 'g') AS c
  FROM (SELECT doc_id, text, unnest(range(0, length(text), 800)) AS s FROM documents)),
pieces AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS i, c,
    lead(c) OVER (PARTITION BY doc_id ORDER BY s) AS nxt FROM piece_windows WHERE c <> ''),
chunk_items AS (SELECT doc_id || ':' || i AS item_id, c, nxt,
    list_filter([c, nxt], lambda x: x IS NOT NULL) AS contexts FROM pieces)"""

RESPONSE_PARTS = """parts AS (SELECT doc_id, doc_id % 8 AS style, 'What does document ' || doc_id || ' say?' AS q,
  trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N} .,;:!?-]', ' ', 'g'), ' +', ' ', 'g')) AS a,
  'Who wrote ' || doc_id || '?' AS q2, source AS a2 FROM documents),
cases AS (
  SELECT doc_id, 0 AS case_no, q AS question, a AS answer FROM parts WHERE style < 7 AND a <> ''
  UNION ALL SELECT doc_id, CASE WHEN a = '' THEN 0 ELSE 1 END, q2, a2 FROM parts WHERE style IN (0, 1, 2, 5))"""

KINDS = "['standard', 'unanswerable', 'ambiguous', 'misleading', 'multi_hop', 'counterfactual']"
TASKS = """types(test_type, task) AS (VALUES
  ('unanswerable', 'questions that sound related but cannot be answered from the text'),
  ('ambiguous', 'questions that can be read in more than one way'),
  ('misleading', 'questions that rest on a wrong premise'),
  ('multi_hop', 'questions that need two or more facts of the text together'),
  ('counterfactual', 'questions about what would follow if a fact of the text were different'))"""
FORMAT = "'Reply with a JSON array of objects with the fields \"question\" and \"answer\".'"
ESCAPED = "replace(replace(chunk, '{', '{{'), '}', '}}')"

STALE = f"""{CORPUS},
stale AS (SELECT doc_id, date_diff('day', DATE '2000-01-01', DATE '2024-06-30') * 86400
    - epoch(planted - TIMESTAMP '2000-01-01') AS secs FROM corpus WHERE planted IS NOT NULL),
aged AS (SELECT doc_id, floor(secs / 86400)::BIGINT AS age_days FROM stale WHERE secs > 365 * 86400),
staleness AS (SELECT doc_id, age_days, CASE WHEN age_days > 1095 THEN 'critical' WHEN age_days > 730 THEN 'high'
    WHEN age_days > 365 THEN 'medium' ELSE 'low' END AS severity FROM aged)"""


def _dups(threshold: float) -> str:
    return f"""word_sets AS (SELECT list_sort({wset('text')}) AS s, min(doc_id) AS id, count(*) AS copies
  FROM documents GROUP BY ALL),
groups AS (SELECT *, len(s) AS n FROM word_sets WHERE len(s) > 0),
inv AS (SELECT id, n, copies, unnest(s) AS w FROM groups),
overlap AS (SELECT a.id AS doc_a, b.id AS doc_b, any_value(a.n) AS na, any_value(b.n) AS nb,
    any_value(a.copies * b.copies) AS n_pairs, count(*)::DOUBLE AS c FROM inv a JOIN inv b ON a.w = b.w AND a.id < b.id
  GROUP BY a.id, b.id),
dups AS (SELECT doc_a, doc_b, c / (na + nb - c) AS similarity, n_pairs FROM overlap WHERE c / (na + nb - c) >= {threshold}
  UNION ALL SELECT id, NULL, 1.0::DOUBLE, copies * (copies - 1) // 2 FROM groups WHERE copies > 1)"""


VEC_DUPS = """WITH v AS (SELECT embedding::DOUBLE[] AS v, min(vec_id) AS id, count(*) AS copies FROM embeddings GROUP BY ALL)
SELECT doc_a, doc_b, round(s, 6) AS similarity, n_pairs, CASE WHEN s > 0.99 THEN 'exact' ELSE 'divergent' END AS kind FROM (
  SELECT a.id AS doc_a, b.id AS doc_b, list_cosine_similarity(a.v, b.v) AS s, a.copies * b.copies AS n_pairs
  FROM v a JOIN v b ON a.id < b.id) WHERE s >= 0.4
UNION ALL SELECT id, NULL, 1.0, copies * (copies - 1) // 2, 'exact' FROM v WHERE copies > 1"""

CANDIDATES = f"""sig AS (SELECT doc_id, unnest(list_filter({wset('text')}, lambda w: length(w) > 4)) AS w FROM documents),
candidates AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS shared_words
  FROM sig a JOIN sig b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY ALL HAVING count(*) >= 3
  ORDER BY doc_a, doc_b LIMIT 50)"""

VERDICTS = """verdicts AS (SELECT doc_id AS doc_a, doc_id + 1 AS doc_b, (n_chars % 100) / 100.0::DOUBLE AS confidence,
    lang || ' ' || source AS topic, CASE WHEN (n_chars % 100) > 90 THEN 'high' ELSE 'medium' END AS severity
  FROM documents WHERE doc_id % 10 <> 9 AND doc_id % 3 <> 0 AND n_chars % 100 > 70)"""

TOPICS = """points AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
centers AS (SELECT label, i, avg(x) AS c FROM points GROUP BY ALL),
dist AS (SELECT p.label, p.vec_id, round(sum((x - c) * (x - c)), 12) AS d
  FROM points p JOIN centers USING (label, i) GROUP BY ALL),
topics AS (SELECT label::BIGINT AS cluster, count(*) AS size, arg_min(vec_id, (d, vec_id)) AS representative FROM dist GROUP BY label)"""

ISSUES = f"""{STALE},
{_dups(0.92)},
{VERDICTS},
{TOPICS},
issues AS (
  SELECT 'staleness' AS chk, 'staleness' AS issue_type, severity, 1::BIGINT AS n FROM staleness
  UNION ALL SELECT 'duplicates', 'duplicate', CASE WHEN similarity > 0.99 THEN 'low' ELSE 'medium' END, n_pairs::BIGINT FROM dups
  UNION ALL SELECT 'contradictions', 'contradiction', severity, 1 FROM verdicts
  UNION ALL SELECT 'coverage', 'coverage_gap', 'low', 1 FROM topics WHERE size < 45),
names AS (SELECT unnest(['staleness', 'duplicates', 'contradictions', 'coverage']) AS chk),
counted AS (SELECT chk, (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM topics) AS n_topics,
    coalesce((SELECT sum(n) FROM issues i WHERE i.chk = names.chk), 0)::BIGINT AS n_issues FROM names),
checks AS (SELECT chk, docs, n_issues, CASE chk
    WHEN 'staleness' THEN greatest(0.0, 1.0 - n_issues::DOUBLE / docs)
    WHEN 'duplicates' THEN 1.0 - least(0.4, 0.4::DOUBLE * n_issues / greatest(docs * (docs - 1) / 2 * 0.05::DOUBLE, 1))
    WHEN 'contradictions' THEN 1.0 - least(0.5, 0.5::DOUBLE * n_issues / greatest(docs * (docs - 1) / 2 * 0.1::DOUBLE, 1))
    ELSE 1.0 - least(0.3, 0.3::DOUBLE * n_issues / n_topics) END AS health FROM counted)"""

ORACLES = {
    "claims": f"""WITH c AS (SELECT doc_id, {claims_sql('text')} AS cl FROM documents)
      SELECT doc_id, unnest(range(len(cl))) AS claim_idx, unnest(cl) AS claim FROM c""",
    "best_context": f"""WITH {ITEMS},
      r AS (SELECT item_id, answer, unnest(contexts) AS ctx, unnest(range(len(contexts))) AS pos FROM items)
      SELECT item_id, ctx AS context FROM r QUALIFY row_number() OVER (PARTITION BY item_id
        ORDER BY len(list_intersect({wset('answer')}, {wset('ctx')})) DESC, pos) = 1""",
    "text_statistics": f"""SELECT doc_id, len({wset('text')})::BIGINT AS n_word_set,
        len({question_words('text')})::BIGINT AS n_question_words, len({keywords('text')})::BIGINT AS n_keywords,
        len(list_filter(string_split(regexp_replace({strip('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''))::BIGINT AS n_sentences,
        len({cased_ws('text')})::BIGINT AS n_tokens, md5({norm_ctx('text')}) AS normalized FROM documents""",
    "word_jaccard": f"""WITH {ITEMS}, w AS (SELECT item_id, {wset('answer')} AS a, {wset('question')} AS q FROM items)
      SELECT item_id, round({jaccard('a', 'q')}, 6)::DOUBLE AS jaccard FROM w""",
    "chunks": f"WITH {CHUNK_ROWS} SELECT doc_id, chunk_idx, chunk FROM chunk_rows",
    "char_overlap": f"""WITH {PIECES}
      SELECT item_id, coalesce(list_max(list_filter(range(1, least(length(c), length(nxt)) + 1),
        lambda n: right(c, n) = left(nxt, n) OR right(nxt, n) = left(c, n))), 0)::BIGINT AS chars
      FROM chunk_items WHERE nxt IS NOT NULL""",
    "topic_label": f"""WITH h AS (SELECT doc_id, {strip('substr(text, 1, 100)')} AS t FROM documents),
      cut AS (SELECT doc_id, CASE WHEN strpos(t, '. ') > 11 THEN left(t, strpos(t, '. ') - 1)
        WHEN strpos(t, '! ') > 11 THEN left(t, strpos(t, '! ') - 1)
        WHEN strpos(t, '? ') > 11 THEN left(t, strpos(t, '? ') - 1)
        WHEN strpos(t, chr(10)) > 11 THEN left(t, strpos(t, chr(10)) - 1) ELSE t END AS t FROM h)
      SELECT doc_id, CASE WHEN length(t) > 60 THEN left(t, 57) || '...' WHEN t = '' THEN 'Untitled topic' ELSE t END AS topic FROM cut""",
    "extract_dates": f"""WITH {CORPUS} SELECT doc_id, strftime(planted, '%Y-%m-%d %H:%M:%S') AS updated_at FROM corpus""",
    "json_objects": """SELECT doc_id AS doc_a, CASE WHEN doc_id % 10 <> 9 THEN lang || ' ' || source END AS topic,
      CASE WHEN doc_id % 10 <> 9 THEN doc_id + 1 END AS second_source FROM documents""",
    "parse_qa": f"WITH {RESPONSE_PARTS} SELECT doc_id, case_no::BIGINT AS case_no, question, answer FROM cases",
    "parse_qa_errors": f"""WITH {RESPONSE_PARTS}
      SELECT doc_id, {KINDS}[doc_id % 6 + 1] AS test_type, 'no question/answer pair found' AS error FROM parts
      WHERE style = 7 OR (style IN (3, 4) AND a = '' AND doc_id % 6 = 0) OR (style = 6 AND a = '')""",
    "synth_type_counts": f"""WITH {RESPONSE_PARTS},
      typed AS (SELECT {KINDS}[doc_id % 6 + 1] AS test_type FROM cases)
      SELECT test_type, count(*) AS n FROM typed WHERE test_type IN ('standard', 'multi_hop', 'misleading') GROUP BY ALL""",
    "chunk_quota": f"""WITH {CHUNK_ROWS}, n AS (SELECT count(*) AS n, 7 * (SELECT count(*) FROM documents) AS wanted FROM chunk_rows)
      SELECT doc_id, chunk_idx, (greatest(1, wanted // n) + CASE WHEN row_number() OVER (ORDER BY doc_id, chunk_idx)
        <= wanted - greatest(1, wanted // n) * n THEN 1 ELSE 0 END)::BIGINT AS n_questions FROM chunk_rows, n""",
    "synth_prompts": f"""WITH {CHUNK_ROWS} SELECT doc_id, chunk_idx, 'standard' AS test_type,
      'Write 3 question(s) that the text below answers, each with its answer.' || chr(10) || {FORMAT} || chr(10) || chr(10)
      || 'Text:' || chr(10) || {ESCAPED} AS prompt FROM chunk_rows""",
    "adversarial_prompts": f"""WITH {CHUNK_ROWS}, {TASKS} SELECT doc_id, chunk_idx, test_type,
      'Write 2 ' || task || ', each with the answer a careful system should give.' || chr(10) || {FORMAT} || chr(10) || chr(10)
      || 'Text:' || chr(10) || {ESCAPED} AS prompt FROM chunk_rows CROSS JOIN types""",
    "audit_staleness": f"WITH {STALE} SELECT doc_id, age_days, severity FROM staleness",
    "audit_duplicates_jaccard": f"""WITH {_dups(0.8)} SELECT doc_a, doc_b, round(similarity, 6) AS similarity, n_pairs,
      CASE WHEN similarity > 0.99 THEN 'exact' ELSE 'divergent' END AS kind FROM dups""",
    "audit_duplicates_members": f"""SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort({wset('text')})) AS group_id
      FROM documents WHERE len({wset('text')}) > 0""",
    "audit_duplicates_vec": VEC_DUPS,
    "contradiction_candidates": f"WITH {CANDIDATES} SELECT * FROM candidates",
    "contradiction_prompts": f"""WITH {CANDIDATES} SELECT doc_a, doc_b, 'Do these two documents contradict each other?'
      || chr(10) || chr(10) || 'Document ' || doc_a || ':' || chr(10) || a.text || chr(10) || chr(10)
      || 'Document ' || doc_b || ':' || chr(10) || b.text || chr(10) || chr(10)
      || 'Reply with JSON only: {{"contradicts": true or false, "confidence": 0.0 to 1.0, "topic": "...", "explanation": "..."}}' AS prompt
      FROM candidates JOIN documents a ON a.doc_id = doc_a JOIN documents b ON b.doc_id = doc_b""",
    "contradiction_verdicts": f"WITH {VERDICTS} SELECT doc_a, doc_b, round(confidence, 6) AS confidence, topic, severity FROM verdicts",
    "coverage_gap_members": f"WITH {TOPICS} SELECT cluster, size, vec_id AS doc_id FROM topics JOIN embeddings ON label = cluster WHERE size < 45",
    "coverage_invariants": """SELECT count(*) AS n_documents, count(*) AS n_in_topics, true AS few_topics, true AS all_named
      FROM embeddings""",
    "audit_sorted_issues": f"""WITH {ISSUES} SELECT chk AS "check", severity FROM issues
      ORDER BY list_position(['critical', 'high', 'medium', 'low'], severity), chk LIMIT 20""",
    "coverage_by_label": f"WITH {TOPICS} SELECT cluster, size, representative FROM topics",
    "audit_checks": f"""WITH {ISSUES} SELECT chk AS "check", docs AS n_documents, n_issues, round(health, 6)::DOUBLE AS health FROM checks""",
    "audit_summary": f"""WITH {ISSUES},
      m AS (SELECT max(docs) AS total_documents, count(*) AS n_checks, round_even(avg(health), 3)::DOUBLE AS health_score FROM checks),
      s AS (SELECT sum(n)::BIGINT AS total_issues, coalesce(sum(n) FILTER (severity = 'critical'), 0)::BIGINT AS n_critical,
        coalesce(sum(n) FILTER (severity = 'high'), 0)::BIGINT AS n_high, coalesce(sum(n) FILTER (severity = 'medium'), 0)::BIGINT AS n_medium,
        coalesce(sum(n) FILTER (severity = 'low'), 0)::BIGINT AS n_low FROM issues)
      SELECT *, n_critical = 0 AND n_high = 0 AS healthy,
        total_documents || ' documents, ' || n_checks || ' checks, ' || total_issues || ' issue(s); ' || array_to_string(list_filter([
          CASE WHEN n_critical > 0 THEN 'critical: ' || n_critical END, CASE WHEN n_high > 0 THEN 'high: ' || n_high END,
          CASE WHEN n_medium > 0 THEN 'medium: ' || n_medium END, CASE WHEN n_low > 0 THEN 'low: ' || n_low END],
          lambda x: x IS NOT NULL), ', ') AS summary FROM m, s""",
    "audit_issue_counts": f"WITH {ISSUES} SELECT issue_type, severity, sum(n)::BIGINT AS n_issues FROM issues GROUP BY ALL",
}
