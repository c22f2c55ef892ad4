"""BM25 ranking of a document table for a table of queries.

Scores are the Okapi form with k1, b and an epsilon floor for negative idf.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scores import list_of, minmax
from plumbline.functions.text import split_words, words
from plumbline.operators import inverted_index as ix
from plumbline.operators.numbering import number_rows
from plumbline.session import cut_lineage

# --- fixed values: the usual Okapi constants ---------------------------------
K1, B, EPSILON = 1.5, 0.75, 0.25
# -----------------------------------------------------------------------------

DOC_BLOCK, QUERY_BLOCK = 4096, 256  # rows per block of the score matrix

TOKENIZERS = {"whitespace": split_words, "simple": words}


@dataclass(frozen=True)
class CorpusStats:
    """What scoring needs to know of a corpus: three numbers and ``terms(term, df)``."""

    n_docs: int
    avg_len: float
    mean_idf: float
    terms: DataFrame


def check_k(k: int) -> None:
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be an integer of at least 1")


def _raw_idf(df: Column, n_docs: Column | float) -> Column:
    return F.log(n_docs - df + 0.5) - F.log(df + 0.5)


def corpus_stats(docs: DataFrame, tokenizer: str = "whitespace") -> CorpusStats:
    """One pass over the texts. Compute it once and pass it on to rank many query tables.

    Repeats are removed inside each row and counts are combined before the
    shuffle, so a word of every document costs one row per task. The length of a
    document rides on its first term. The term table is checkpointed: it is read
    for the mean idf and again for the query terms.
    """
    tokens = docs.select(TOKENIZERS[tokenizer](F.col("content")).alias("tokens"))
    rows = tokens.select(
        F.size("tokens").alias("n"), F.posexplode(F.array_distinct("tokens")).alias("pos", "term")
    )
    terms = cut_lineage(
        rows.groupBy("term").agg(
            F.count(F.lit(1)).alias("df"),
            F.sum(F.when(F.col("pos") == 0, F.col("n")).otherwise(0)).alias("lengths"),
        )
    )
    n_docs = docs.count()
    idf = _raw_idf(F.col("df"), F.lit(float(n_docs)))
    sums = terms.agg(F.sum("lengths").alias("total"), F.avg(idf).alias("mean_idf")).first()
    avg_len = (sums["total"] or 0) / n_docs if n_docs else 0.0
    return CorpusStats(n_docs, avg_len, sums["mean_idf"] or 0.0, terms.select("term", "df"))


def _query_weights(queries: DataFrame, stats: CorpusStats, tokenizer: str) -> DataFrame:
    """(query_id, term, weight): idf times the number of times the query names the term."""
    tokenize = TOKENIZERS[tokenizer]
    query_terms = (
        queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )
    raw = _raw_idf(F.col("df"), F.lit(float(stats.n_docs)))
    idf = F.when(raw < 0, F.lit(EPSILON * stats.mean_idf)).otherwise(raw)
    weights = stats.terms.select("term", idf.alias("idf"))
    return query_terms.join(weights, "term").select(
        "query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")
    )


def _matched_tokens(docs: DataFrame, weights: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, dl, term) for every token that some query asks for. The join has no hint:
    Spark broadcasts the query terms when it measures them to be small."""
    tokenized = docs.select("doc_id", TOKENIZERS[tokenizer](F.col("content")).alias("tokens"))
    # explode_outer: a plain explode of a computed column makes Spark add a filter on
    # its size, which tokenises every text a second time.
    return tokenized.select(
        "doc_id", F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("term")
    ).join(weights.select("term").distinct(), "term", "left_semi")


def bm25_scores(
    queries: DataFrame,
    docs: DataFrame,
    stats: CorpusStats,
    tokenizer: str = "whitespace",
) -> DataFrame:
    """(query_id, doc_id, raw) for every pair with a score other than 0, as a table.

    For whole score tables; ``bm25_topk`` takes the blocked way, which never
    lists the pairs. Tokens are shuffled once, by document.
    """
    weights = _query_weights(queries, stats, tokenizer)
    postings = (
        _matched_tokens(docs, weights, tokenizer)
        .repartition("doc_id")
        .groupBy("doc_id", "term")
        .agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    )
    damp = K1 * (1.0 - B + B * F.col("dl") / F.lit(stats.avg_len or 1.0))
    part = F.col("tf") * (K1 + 1.0) / (F.col("tf") + damp)
    return (
        postings.withColumn("part", part)
        .join(weights, "term")
        .groupBy("query_id", "doc_id")
        # Rounded, so that copies of a text tie whatever order their terms were added in.
        .agg(F.round(F.sum(F.col("weight") * F.col("part")), 9).alias("raw"))
        .where(F.col("raw") != 0)
    )


def _block_scores(tokens: pd.DataFrame, weights: pd.DataFrame, avg_len: float):
    """Scores of one document block for one query block: (document ids, query ids, matrix)."""
    query_ids = np.sort(weights["query_id"].unique())
    terms = pd.Index(weights["term"].unique())
    table = np.zeros((len(terms), len(query_ids)))
    table[terms.get_indexer(weights["term"]), np.searchsorted(query_ids, weights["query_id"])] = (
        weights["weight"]
    )
    known = tokens.assign(t=terms.get_indexer(tokens["term"]))
    counts = known[known["t"] >= 0].groupby(["doc_id", "t"], as_index=False).agg(
        tf=("dl", "size"), dl=("dl", "first")
    )
    doc_ids, starts = np.unique(counts["doc_id"].to_numpy(), return_index=True)
    tf, dl = counts["tf"].to_numpy(), counts["dl"].to_numpy()
    part = tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * dl / avg_len))
    term_no = counts["t"].to_numpy()
    ends = np.append(starts[1:], len(part))
    scores = np.empty((len(doc_ids), len(query_ids)))
    for row, (lo, hi) in enumerate(zip(starts, ends)):
        scores[row] = part[lo:hi] @ table[term_no[lo:hi]]
    return doc_ids, query_ids, np.round(scores, 9) + 0.0


def _top_and_spread(
    queries: DataFrame, docs: DataFrame, k: int, stats: CorpusStats, tokenizer: str
) -> DataFrame:
    """One pass over the corpus: per block of documents and query, the k best documents
    and one row (doc_id null) with the counts and bounds of the scores.

    Documents and queries are cut into blocks of bounded size and each pair of
    blocks is one small matrix product, so neither a frequent term nor a large
    query table ever lists query x document pairs.
    """
    spark = docs.sparkSession
    spread_over = min(spark.sparkContext.defaultParallelism, math.ceil(stats.n_docs / 256))
    d_blocks = max(math.ceil(stats.n_docs / DOC_BLOCK), spread_over, 1)
    q_blocks = max(math.ceil(queries.count() / QUERY_BLOCK), 1)
    # Read twice, as terms to look for and as weights; it has one row per query term.
    weights = cut_lineage(_query_weights(queries, stats, tokenizer))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = _matched_tokens(docs, weights, tokenizer).select(
        "doc_id", "dl", "term", block("doc_id", d_blocks).alias("db"), every(q_blocks).alias("qb")
    )
    right = weights.select(
        "query_id", "term", "weight", block("query_id", q_blocks).alias("qb"),
        every(d_blocks).alias("db"),
    )
    avg_len = stats.avg_len or 1.0
    columns = ["query_id", "doc_id", "raw", "n_scored", "n_hits", "lo", "hi"]

    def best(tokens: pd.DataFrame, weighted: pd.DataFrame) -> pd.DataFrame:
        if tokens.empty or weighted.empty:
            return pd.DataFrame(columns=columns)
        doc_ids, query_ids, scores = _block_scores(tokens, weighted, avg_len)
        out = []
        for col, query in enumerate(query_ids):
            raw = scores[:, col]
            hit = np.flatnonzero(raw)
            if not len(hit):
                continue
            top = hit[np.argsort(-raw[hit], kind="stable")[:k]]
            out += [(query, doc_ids[r], raw[r], None, None, None, None) for r in top]
            found = raw[hit]
            out.append((query, None, None, len(hit), int((found > 0).sum()), found.min(), found.max()))
        return pd.DataFrame(out, columns=columns)

    types = {**dict(docs.dtypes), **dict(queries.dtypes)}
    schema = (
        f"query_id {types['query_id']}, doc_id {types['doc_id']}, raw double, "
        "n_scored double, n_hits double, lo double, hi double"
    )
    blocks = left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db"))
    return blocks.applyInPandas(best, schema)


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("raw"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unscored(
    needy: DataFrame, docs: DataFrame, scored: DataFrame, k: int, stats: CorpusStats
) -> DataFrame:
    """The first k documents, by id, that score 0 for each query that lacks hits.

    ``needy(query_id, n_scored)``: among the first k + n_scored documents at
    least k have no score, so only those are looked at.
    """
    if stats.mean_idf >= 0:
        # No negative scores, so n_scored < k and 2k ids are enough.
        first = docs.select("doc_id").orderBy("doc_id").limit(2 * k)
        numbered = first.withColumn(
            "pos", F.row_number().over(Window.orderBy("doc_id")).cast("bigint")
        )
    else:
        numbered = number_rows(docs.select("doc_id"), "doc_id", name="pos").withColumn(
            "pos", F.col("pos") + 1
        )
    reach = F.least(F.lit(stats.n_docs), F.col("n_scored") + k).cast("bigint")
    places = needy.where(reach >= 1).select(
        "query_id", F.explode(F.sequence(F.lit(1).cast("bigint"), reach)).alias("pos")
    )
    empty = places.join(numbered, "pos").join(scored, ["query_id", "doc_id"], "left_anti")
    return _best(empty.select("query_id", "doc_id", F.lit(0.0).alias("raw")), k).drop("rank")


def _index(docs: DataFrame, weights: DataFrame, stats: CorpusStats, tokenizer: str) -> ix.InvertedIndex:
    """Index of the terms that ``weights`` asks for."""
    known = stats.terms.join(weights.select("term").distinct(), "term", "left_semi").toArrow()
    tokens = docs.select("doc_id", TOKENIZERS[tokenizer](F.col("content")).alias("tokens"))
    part = partial(ix.part_of, avg_len=stats.avg_len, k1=K1, b=B)
    return ix.build_index(tokens, known["term"].combine_chunks(), part, stats.n_docs, pc.sum(known["df"]).as_py() or 0)


def bm25_index(queries: DataFrame, docs: DataFrame, stats: CorpusStats, tokenizer: str = "whitespace") -> ix.InvertedIndex:
    """Index of the terms that ``queries`` name; it serves any queries of these terms."""
    return _index(docs, _query_weights(queries, stats, tokenizer), stats, tokenizer)


def bm25_topk(
    queries: DataFrame,
    docs: DataFrame,
    k: int = 5,
    tokenizer: str = "whitespace",
    stats: CorpusStats | None = None,
    index: ix.InvertedIndex | None = None,
) -> DataFrame:
    """(query_id, rank, doc_id, raw, score) for ``queries(query_id, text)`` over
    ``docs(doc_id, content)``.

    ``score`` is min-max normalised over all documents, unmatched ones (raw 0)
    included, without listing them. ``stats`` and ``index`` can be made once and
    reused. The search skips blocks of postings that cannot reach the top. Corpora of
    so few documents that words have negative weights, and queries that match every
    document, take the dense way, which sees the least score too.
    """
    check_k(k)
    stats = stats or corpus_stats(docs, tokenizer)
    if stats.mean_idf < 0 or not stats.n_docs:
        return _dense_topk(queries, docs, k, stats, tokenizer)
    weights = cut_lineage(_query_weights(queries, stats, tokenizer).where(F.col("weight") > 0))
    index = index or _index(docs, weights, stats, tokenizer)
    sure = cut_lineage(ix.with_unmatched(queries, weights, index))
    found = _sparse_topk(sure, docs, k, stats, weights.join(sure.select("query_id"), "query_id", "left_semi"), index)
    if sure.count() == queries.count():
        return found
    rest = queries.join(sure.select("query_id"), "query_id", "left_anti")
    return found.unionByName(_dense_topk(rest, docs, k, stats, tokenizer))


def _sparse_topk(
    queries: DataFrame, docs: DataFrame, k: int, stats: CorpusStats, weights: DataFrame, index: ix.InvertedIndex
) -> DataFrame:
    """For queries that leave some document without a score, so that the least score is 0."""
    top = cut_lineage(ix.top(weights, index, k).where(F.col("raw") > 0))
    hits = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_scored"), F.max("raw").alias("hi"))
    known = queries.select("query_id").join(hits, "query_id", "left").na.fill(0, ["n_scored"]).na.fill(0.0, ["hi"])
    needy = known.where(F.col("n_scored") < k).select("query_id", "n_scored")
    filled = top.unionByName(_unscored(needy, docs, top.select("query_id", "doc_id"), k, stats))
    scale = F.when(F.col("hi") == 0, F.lit(1.0)).otherwise(F.col("raw") / F.col("hi"))
    return (
        _best(filled, k)
        .join(known.select("query_id", "hi"), "query_id")
        .select("query_id", "rank", "doc_id", "raw", scale.alias("score"))
    )


def _dense_topk(queries: DataFrame, docs: DataFrame, k: int, stats: CorpusStats, tokenizer: str) -> DataFrame:
    """Scores of all documents, block by block."""
    # Few rows (k per query and block), read three times below.
    found = cut_lineage(_top_and_spread(queries, docs, k, stats, tokenizer))
    spread = found.where(F.col("doc_id").isNull()).groupBy("query_id").agg(
        F.sum("n_scored").cast("bigint").alias("n_scored"),
        F.sum("n_hits").cast("bigint").alias("n_hits"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )
    known = queries.select("query_id").join(spread, "query_id", "left").na.fill(
        0, ["n_scored", "n_hits"]
    )
    best = found.where(F.col("doc_id").isNotNull()).select("query_id", "doc_id", "raw")
    top = _best(best, k).drop("rank")
    needy = known.where(F.col("n_hits") < k).select("query_id", "n_scored")
    # Without negative scores a query short of hits has all of them in ``top``.
    asking = queries.join(needy.select("query_id"), "query_id", "left_semi")
    scored = top if stats.mean_idf >= 0 else bm25_scores(asking, docs, stats, tokenizer)
    filled = top.unionByName(
        _unscored(needy, docs, scored.select("query_id", "doc_id"), k, stats)
    )
    some_zero = F.col("n_scored") < F.lit(stats.n_docs)
    lo = F.when(some_zero, F.least(F.coalesce("lo", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("lo"))
    hi = F.when(some_zero, F.greatest(F.coalesce("hi", F.lit(0.0)), F.lit(0.0))).otherwise(
        F.col("hi")
    )
    bounds = known.select("query_id", lo.alias("lo"), hi.alias("hi"))
    scale = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise(
        (F.col("raw") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    )
    return (
        _best(filled, k)
        .join(bounds, "query_id")
        .select("query_id", "rank", "doc_id", "raw", scale.alias("score"))
    )


def bm25_hits(
    queries: DataFrame,
    docs: DataFrame,
    k: int = 5,
    tokenizer: str = "whitespace",
    stats: CorpusStats | None = None,
) -> DataFrame:
    """Only documents that match, scores min-max normalised over the hits returned."""
    check_k(k)
    stats = stats or corpus_stats(docs, tokenizer)
    if stats.mean_idf < 0 or not stats.n_docs:
        found = _top_and_spread(queries, docs, k, stats, tokenizer)
    else:
        weights = cut_lineage(_query_weights(queries, stats, tokenizer).where(F.col("weight") > 0))
        found = ix.top(weights, _index(docs, weights, stats, tokenizer), k)
    best = found.where(F.col("raw") > 0).select("query_id", "doc_id", "raw")
    hits = _best(best, k)
    return hits.withColumn("score", minmax(F.col("raw"), list_of("query_id")))
