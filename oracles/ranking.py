"""DuckDB SQL for the ranking queries."""

from __future__ import annotations

from oracles.base import ITEMS, cased_ws, ws


def _bm25(tokens) -> str:
    return f"""doc_tok AS (SELECT doc_id, {tokens('text')} AS t FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM doc_tok),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM doc_tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw_idf AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM df, corpus),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw_idf) ELSE idf END AS idf FROM raw_idf),
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM
  (SELECT item_id, unnest({tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
matched AS (SELECT q.query_id, tf.doc_id,
    sum(qtf * idf.idf * tf.tf * 2.5::DOUBLE / (tf.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(d.t) / c.avgdl))) AS raw
  FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN doc_tok d ON d.doc_id = tf.doc_id, corpus c GROUP BY ALL),
every AS (SELECT b.item_id AS query_id, d.doc_id, coalesce(m.raw, 0.0) AS raw
  FROM benchmark b CROSS JOIN documents d LEFT JOIN matched m ON m.query_id = b.item_id AND m.doc_id = d.doc_id),
scaled AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, doc_id) AS rank,
    min(raw) OVER (PARTITION BY query_id) AS lo, max(raw) OVER (PARTITION BY query_id) AS hi FROM every)"""


TOPK = "SELECT query_id, rank, doc_id, round(CASE WHEN hi = lo THEN 1.0 ELSE (raw - lo) / (hi - lo) END, 6) AS score FROM scaled WHERE rank <= 5"

RELEVANT = """SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d
  ON contains(d.text, b.text)"""

HASH = """list_transform(range(0, {dims}), lambda i: ('0x' || substr(sha256(i || ':' || text), 1, 4))
  ::INTEGER::DOUBLE / 65535.0::DOUBLE * 2.0::DOUBLE - 1.0::DOUBLE)"""
UNIT = "list_transform(r, lambda x: x / sqrt(list_inner_product(r, r)))"

VEC_QUERIES = f"""qv AS (SELECT query_id, {UNIT} AS q FROM
  (SELECT item_id AS query_id, {HASH.format(dims=64)} AS r FROM benchmark)),
dv AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS d FROM embeddings)"""

DIST = "(list_distance(q, d))"


def _knn(near: str, score: str, source: str = "qv CROSS JOIN dv") -> str:
    return f"""SELECT query_id, rank, doc_id, round({score}, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({near}, 10) DESC, doc_id) AS rank
      FROM {source}) WHERE rank <= 5"""


SELF = "(SELECT doc_id AS query_id, d AS q FROM dv) CROSS JOIN dv"

ORACLES = {
    "bm25_topk": f"WITH {_bm25(cased_ws)} {TOPK}",
    "bm25_topk_simple": f"WITH {_bm25(ws)} {TOPK}",
    "bm25_hits_minmax": f"""WITH {_bm25(cased_ws)},
      hits AS (SELECT *, min(raw) OVER (PARTITION BY query_id) AS l, max(raw) OVER (PARTITION BY query_id) AS h
        FROM scaled WHERE rank <= 5 AND raw > 0)
      SELECT query_id, rank, doc_id, round(CASE WHEN h = l THEN 1.0 ELSE (raw - l) / (h - l) END, 6) AS score FROM hits""",
    "relevant_documents": RELEVANT,
    "retrieval_metrics_long": f"""WITH {_bm25(cased_ws)},
      rel AS ({RELEVANT}),
      lists AS (SELECT b.item_id AS query_id,
          (SELECT list(s.doc_id ORDER BY s.rank) FROM scaled s WHERE s.query_id = b.item_id AND s.rank <= 5) AS ret,
          coalesce((SELECT list(r.doc_id) FROM rel r WHERE r.query_id = b.item_id), []) AS rel FROM benchmark b),
      marks AS (SELECT *, list_transform(ret, lambda x: list_contains(rel, x)) AS m FROM lists)
      SELECT query_id,
        round(len(list_filter(m, lambda x: x))::DOUBLE / 5, 6) AS context_precision,
        round(CASE WHEN len(rel) = 0 THEN 0.0 ELSE len(list_intersect(rel, ret))::DOUBLE / len(rel) END, 6) AS context_recall,
        round(len(list_filter(m[1:3], lambda x: x))::DOUBLE / 3, 6) AS precision_at_k,
        round(CASE WHEN len(rel) = 0 THEN 0.0 ELSE len(list_intersect(rel, ret[1:3]))::DOUBLE / len(rel) END, 6) AS recall_at_k,
        CASE WHEN list_contains(m, true) THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_rate,
        round(coalesce(1.0::DOUBLE / nullif(list_position(m, true), 0), 0.0), 6) AS mrr,
        round(CASE WHEN len(rel) = 0 THEN 0.0 ELSE
          (CASE WHEN m[1] THEN 1.0 ELSE 0 END + CASE WHEN m[2] THEN 1.0 ELSE 0 END + CASE WHEN m[3] THEN 1 / log2(3) ELSE 0 END)
          / CASE least(len(rel), 3) WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 ELSE 2.0 + 1 / log2(3) END END, 6)::DOUBLE AS ndcg
      FROM marks""",
    "knn_cosine": f"WITH {VEC_QUERIES} "
    + _knn("list_inner_product(q, d)", "greatest(0.0, least(1.0, list_inner_product(q, d)))"),
    "knn_l2": f"WITH {VEC_QUERIES} " + _knn(f"-{DIST} * {DIST}", f"1.0 / (1.0 + {DIST} * {DIST})"),
    "knn_scores": f"""WITH {VEC_QUERIES},
      c AS ({_knn('list_cosine_similarity(q, d)', 'greatest(0.0, least(1.0, list_cosine_similarity(q, d)))', SELF)}),
      l AS ({_knn(f'-{DIST}', f'greatest(0.0, 1.0 - {DIST})', SELF)})
      SELECT 'cosine' AS kernel, * FROM c UNION ALL SELECT 'l2_linear', * FROM l""",
    "norm_minmax": """SELECT l_orderkey, l_linenumber, round(CASE WHEN hi = lo THEN 1.0 ELSE (s - lo) / (hi - lo) END, 6) AS score
      FROM (SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS s,
        min(l_extendedprice::DOUBLE) OVER (PARTITION BY l_orderkey) AS lo,
        max(l_extendedprice::DOUBLE) OVER (PARTITION BY l_orderkey) AS hi FROM lineitem)""",
    "norm_rank": """SELECT l_orderkey, l_linenumber, round(1.0 - (row_number() OVER
        (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) - 1)::DOUBLE
        / count(*) OVER (PARTITION BY l_orderkey), 6) AS score FROM lineitem""",
    "norm_distance": """SELECT event_id, space, round(greatest(0.0, least(1.0,
        CASE WHEN space = 'cosine' THEN d / 2 ELSE d END)), 6) AS score FROM (
        SELECT event_id, value / 100.0::DOUBLE - 0.5::DOUBLE AS d, CASE event_type WHEN 'click' THEN 'cosine' WHEN 'view' THEN 'l2'
          WHEN 'error' THEN 'ip' WHEN 'signup' THEN 'similarity' ELSE 'other' END AS space FROM events)""",
    "response_log_docs": f"""WITH {ITEMS},
      h AS (SELECT item_id, unnest(contexts[1:3]) AS c, unnest(range(1, least(len(contexts), 3) + 1)) AS rank FROM items),
      s AS (SELECT *, length(c) / 1000.0::DOUBLE AS raw, count(*) OVER w AS n, min(length(c) / 1000.0::DOUBLE) OVER w AS lo,
        max(length(c) / 1000.0::DOUBLE) OVER w AS hi FROM h WINDOW w AS (PARTITION BY item_id)),
      modes AS (SELECT unnest(['passthrough', 'minmax', 'rank']) AS mode)
      SELECT mode, item_id, rank, 'c' || (rank - 1) AS doc_id, c AS content, round(CASE mode
          WHEN 'passthrough' THEN greatest(0.0, least(1.0, raw))
          WHEN 'minmax' THEN CASE WHEN hi = lo THEN 1.0 ELSE (raw - lo) / (hi - lo) END
          ELSE 1.0 - (rank - 1)::DOUBLE / n END, 6) AS score
      FROM s CROSS JOIN modes WHERE length(c) >= 200""",
    "response_log_rejected": """SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN 'no payload' ELSE 'no list of results' END AS error
      FROM documents WHERE doc_id % 4 <> 0""",
    "hash_embed": f"""WITH raw AS (SELECT doc_id, {HASH.format(dims=32)} AS r FROM documents),
      u AS (SELECT doc_id, {UNIT} AS v FROM raw)
      SELECT doc_id, unnest(range(0, 32)) AS i, round(unnest(v), 6) AS x FROM u""",
}
