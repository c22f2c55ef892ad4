"""Evaluation tables derived from the star-schema test tables.

The given tables hold no question/answer set, so conversations become items,
documents become a corpus and model responses, events become latencies. Every
view covers its whole source table, and its size grows with that table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions.vectors import hash_embedding
from plumbline.operators.cost_metrics import PRICES, with_cost
from plumbline.operators.evaluate import evaluate, long_scores
from plumbline.operators.providers import build_prompt, echo_answer

SHORT_ANSWER = 350  # characters; a shorter answer counts as a failed generation
RUN_METRICS = [
    "context_precision", "context_recall", "mrr", "ndcg", "faithfulness", "answer_relevancy",
    "hallucination", "f1_score", "exact_match", "latency", "token_count",
]
AS_OF = "2024-06-30 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choice(values: list[str], index: Column) -> Column:
    """The value at a 0-based index; past the end gives null."""
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def row_key(*names: str) -> Column:
    """A key that stays unique for any size of its parts."""
    return F.concat_ws(":", *(F.col(n).cast("string") for n in names))


#: Turns of a conversation that one task puts in order.
TURNS = 8192


def _uses(turns: DataFrame) -> DataFrame:
    """(conv_id, from_turn, turn, use): what each turn is to which answer, found without any text.

    A turn is a context of the next answer after it. An answer is its own, and the
    nearest user turn before it is its question, at any distance. Conversations are cut
    into ranges of turns, so a task sorts a range at most; what lies beyond the ends of
    a range is carried over from one row for each range.
    """
    slim = turns.select("conv_id", "turn", "role", F.floor(F.col("turn") / TURNS).alias("range"))
    answers = F.when(F.col("role") == "assistant", F.col("turn"))
    asked = F.when(F.col("role") == "user", F.col("turn"))
    here = Window.partitionBy("conv_id", "range")
    before = here.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    after = here.orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    near = slim.select(
        "conv_id",
        "range",
        "turn",
        answers.alias("own"),
        F.last(answers, ignorenulls=True).over(after).alias("near_answer"),
        F.last(asked, ignorenulls=True).over(before).alias("near_asked"),
    )
    # One row for each range tells the others what stands before and behind it.
    ends = slim.groupBy("conv_id", "range").agg(F.max(asked).alias("last_asked"), F.min(answers).alias("first_answer"))
    ranges = Window.partitionBy("conv_id")
    earlier = ranges.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    later = ranges.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        "conv_id",
        "range",
        F.last("last_asked", ignorenulls=True).over(earlier).alias("far_asked"),
        F.last("first_answer", ignorenulls=True).over(later).alias("far_answer"),
    )
    placed = near.join(carried, ["conv_id", "range"]).select(
        "conv_id",
        "turn",
        "own",
        F.coalesce("near_answer", "far_answer").alias("next_answer"),
        F.coalesce("near_asked", "far_asked").alias("asked"),
    )
    turn = F.col("turn")
    use = lambda who, what, kind: F.struct(who.alias("from_turn"), what.alias("turn"), F.lit(kind).alias("use"))
    uses = F.array(
        F.when(F.col("own").isNotNull(), use(turn, turn, "answer")),
        F.when(F.col("next_answer").isNotNull(), use(turn, F.col("next_answer"), "context")),
        F.when(F.col("own").isNotNull() & F.col("asked").isNotNull(), use(F.col("asked"), turn, "question")),
    )
    return placed.select("conv_id", F.inline(F.array_compact(uses)))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per assistant turn. Its contexts are the assistant turn before it and all turns since.

    The question is the nearest user turn before, the reference the nearest
    assistant turn before. Each turn is a context of one item, so nothing is cut and
    the view stays as large as the table. Texts are grouped by (conversation, turn),
    so a conversation that holds a third of all rows spreads over all tasks.
    """
    turns = table(spark, sf_dir, "conversations")
    texts = turns.select("conv_id", F.col("turn").alias("from_turn"), "role", "text")
    used = _uses(turns).join(texts, ["conv_id", "from_turn"])
    told = lambda kind: F.col("use") == kind
    when_assistant = F.when(told("context") & (F.col("role") == "assistant"), F.col("from_turn"))
    grouped = used.groupBy("conv_id", "turn").agg(
        F.max(F.when(told("answer"), F.col("text"))).alias("answer"),
        F.max(F.when(told("question"), F.col("text"))).alias("question"),
        F.max_by("text", when_assistant).alias("ground_truth"),
        F.array_sort(
            F.collect_list(F.when(told("context"), F.struct("from_turn", "text")))
        ).alias("history"),
    )
    slot = F.col("conv_id") % 12
    base = grouped.where(F.col("answer").isNotNull()).select(
        row_key("conv_id", "turn").alias("item_id"),
        "conv_id",
        "question",
        "answer",
        "ground_truth",
        F.col("history.text").alias("contexts"),
        _choice([p[0] for p in PRICES], slot).alias("provider"),
        _choice([p[1] for p in PRICES], slot).alias("model"),
    )
    spaced = lambda c: F.replace(F.col(c), F.lit("\n"), F.lit("  "))
    return base.withColumns(
        {
            "ground_truth_contexts": F.array_compact(
                F.array(spaced("ground_truth"), spaced("question"), spaced("answer"))
            ),
            "context": F.get("contexts", F.lit(0)),
            "prompt_tokens": tx.token_count(F.col("question"))
            + tx.token_count(F.array_join("contexts", " ")),
            "completion_tokens": tx.token_count(F.col("answer")),
            "latency_ms": F.when(F.col("provider").isNotNull(), F.length("answer") * 1.5),
            "error_type": F.when(F.col("question").isNull(), "invalid item").when(
                F.length("answer") < SHORT_ANSWER, "no full answer"
            ),
        }
    )


def echo_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same items answered by the echo generator: the second run to compare."""
    df = items(spark, sf_dir)
    prompt = build_prompt(F.col("question"), F.col("contexts"))
    return df.withColumn("answer", echo_answer(F.col("ground_truth"), prompt)).withColumns(
        {
            "completion_tokens": tx.token_count(F.col("answer")),
            "error_type": F.when(F.col("question").isNull(), "invalid item"),
        }
    )


def both_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logged run and the echo run of every item: one scan, each item fanned out."""
    fanned = items(spark, sf_dir).withColumn(
        "run_id", F.explode(F.array(F.lit("logged"), F.lit("echo")))
    )
    echo = F.col("run_id") == "echo"
    echoed = echo_answer(
        F.col("ground_truth"), build_prompt(F.col("question"), F.col("contexts"))
    )
    no_question = F.when(F.col("question").isNull(), "invalid item")
    return fanned.withColumn("answer", F.when(echo, echoed).otherwise(F.col("answer"))).withColumns(
        {
            "completion_tokens": F.when(echo, tx.token_count(F.col("answer"))).otherwise(
                F.col("completion_tokens")
            ),
            "error_type": F.when(echo, no_question).otherwise(F.col("error_type")),
        }
    )


def scored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both runs scored, wide: the ``results`` table of a run store."""
    runs_ = both_runs(spark, sf_dir)
    return evaluate(runs_, RUN_METRICS, failed=F.col("error_type").isNotNull())


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both runs, long: run_id, item_id, metric, score."""
    return long_scores(scored_runs(spark, sf_dir), RUN_METRICS, "run_id", "item_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a date written into the text in four formats (some have none)."""
    docs = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") * 7 % 1700).cast("int"))
    stamp = _choice_column(
        [
            F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T08:30:00")),
            F.date_format(day, "yyyy-MM-dd"),
            F.date_format(day, "M/d/yyyy"),
            F.date_format(day, "MMMM d, yyyy"),
        ],
        F.col("doc_id") % 5,
    )
    return docs.select(
        "doc_id",
        "lang",
        "source",
        F.coalesce(F.concat(F.lit("Last updated: "), stamp, F.lit("\n"), F.col("text")), "text")
        .alias("content"),
    )


def _choice_column(values: list[Column], index: Column) -> Column:
    return F.get(F.array(*values), index)


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("event_type").alias("stage"), F.col("value").alias("latency_ms")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"), "label"
    )


def plain(c: str) -> Column:
    """Text with everything but letters, digits, blanks and simple marks blanked out."""
    return F.regexp_replace(F.col(c), r"[^\p{L}\p{N} .,;:!?-]", " ")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-writer responses of a model, one per document, in eight styles
    from a clean JSON array down to unusable text."""
    docs = table(spark, sf_dir, "documents")
    q = F.concat(F.lit("What does document "), F.col("doc_id").cast("string"), F.lit(" say?"))
    a = F.trim(F.regexp_replace(plain("text"), " +", " "))
    obj = F.concat(F.lit('{"question": "'), q, F.lit('", "answer": "'), a, F.lit('"}'))
    second = F.concat(
        F.lit('{"question": "Who wrote '), F.col("doc_id").cast("string"),
        F.lit('?", "answer": "'), F.col("source"), F.lit('"}'),
    )
    body = _choice_column(
        [
            F.concat(F.lit("["), obj, F.lit(", "), second, F.lit("]")),
            F.concat(F.lit("```json\n["), obj, F.lit(",\n"), second, F.lit("]\n```")),
            F.concat(F.lit("Here you are:\n["), obj, F.lit(", "), second, F.lit(",]\nDone")),
            F.concat(
                F.lit("[{'question': '"), q, F.lit("', 'answer': '"), a, F.lit("'}]")
            ),
            obj,
            F.concat(F.lit("First "), obj, F.lit(" and then "), second),
            F.concat(F.lit('"Question": "'), q, F.lit('" then "Answer": "'), a, F.lit('"')),
            a,
        ],
        F.col("doc_id") % 8,
    )
    return docs.select("doc_id", "source", body.alias("response"))


def judge_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free judge text per document: numbers in several scales, keywords, neither."""
    docs = table(spark, sf_dir, "documents")
    n = F.col("n_chars")
    body = _choice_column(
        [
            F.concat(F.lit("The score is 0."), (n % 100).cast("string")),
            F.concat((n % 101).cast("string"), F.lit("%")),
            F.concat(F.lit("I rate it "), (n % 10).cast("string"), F.lit(".5 out of ten")),
            F.lit("Yes, it is Excellent"),
            F.lit("No, not at all"),
            F.lit("unclear; see below"),
        ],
        F.col("doc_id") % 7,
    )
    return docs.select("doc_id", F.coalesce(body, F.col("text")).alias("response"))


def rank_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def rank_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))


#: Queries that are sent to all texts at a time.
RELEVANT = 1 << 16


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id) for documents that contain the whole query text.

    Candidates come from an equi-join on up to four inner words of the query, which
    stand whole in any text that contains it (its first and last word may be parts of
    longer words); the text then decides. Queries of one or two words have no inner word
    and are held against every text. Queries are sent to the texts, RELEVANT at a time,
    so that no text and no run of its words is shuffled.
    """
    queries = rank_queries(spark, sf_dir).withColumn("w", tx.split_words(F.col("text")))
    size = F.greatest(F.lit(0), F.least(F.lit(4), F.size("w") - 2))
    anchored = queries.select(
        "query_id", "text", size.alias("size"), F.array_join(F.slice("w", 2, size), " ").alias("anchor")
    )
    counted = {r["size"]: r["count"] for r in anchored.groupBy("size").count().collect()}
    sizes, n = sorted(counted), -(-sum(counted.values()) // RELEVANT)
    docs = rank_docs(spark, sf_dir).withColumn("w", tx.split_words(F.col("content")))

    def runs(w: Column) -> Column:
        def of(n: int) -> Column:
            last = F.size(w) - (n - 1)
            found = F.transform(
                F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                lambda i: F.concat_ws(" ", F.slice(w, i, n)),
            )
            return F.when(last >= 1, found).otherwise(F.array().cast("array<string>"))

        return F.array_distinct(F.concat(*(of(n) if n else F.array(F.lit("")) for n in sizes)))

    if not sizes:
        return spark.createDataFrame([], "query_id long, doc_id long")
    grams = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", "content", F.explode(tx.let(F.col("w"), runs)).alias("anchor")
    )

    def found(some: DataFrame) -> DataFrame:
        pairs = grams.join(F.broadcast(some.select("query_id", "text", "anchor")), "anchor")
        return pairs.where(F.contains("content", "text")).select("query_id", "doc_id")

    asked = anchored.where(F.col("query_id").isNotNull())
    part = F.pmod(F.xxhash64("query_id"), F.lit(n))
    return reduce(DataFrame.unionByName, [found(asked.where(part == i)) for i in range(n)])


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts embedded by the hash embedder, in the width of the vector table."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), hash_embedding(F.col("text"), 64).alias("v")
    )


def chunk_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk of a document with the one after it, as the contexts of an item."""
    docs = table(spark, sf_dir, "documents")
    pieces = docs.select("doc_id", tx.chunks(F.col("text"), 1000, 200).alias("cs"))
    paired = tx.let(
        F.col("cs"),
        lambda cs: F.transform(cs, lambda c, i: F.array_compact(F.array(c, F.get(cs, i + 1)))),
    )
    return pieces.select("doc_id", F.posexplode(paired).alias("i", "contexts")).select(
        row_key("doc_id", "i").alias("item_id"),
        "contexts",
        F.lit(500).alias("chunk_size"),
        F.lit(50).alias("chunk_overlap"),
    )


def verdict_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's reply per document and its successor: JSON in prose, or no JSON at all."""
    docs = table(spark, sf_dir, "documents")
    confidence = F.format_string("%.2f", F.col("n_chars") % 100 / 100.0)
    body = F.concat(
        F.lit('Sure. {"contradicts": '),
        F.when(F.col("doc_id") % 3 == 0, F.lit("false")).otherwise(F.lit("true")),
        F.lit(', "confidence": '), confidence,
        F.lit(', "topic": "'), F.col("lang"), F.lit(" "), F.col("source"),
        F.lit('", "explanation": "They differ.", "sources": [{"id": '),
        F.col("doc_id").cast("string"), F.lit('}, {"id": '),
        (F.col("doc_id") + 1).cast("string"), F.lit("}]} Anything else?"),
    )
    reply = F.when(F.col("doc_id") % 10 == 9, plain("text")).otherwise(body)
    return docs.select(
        F.col("doc_id").alias("doc_a"),
        (F.col("doc_id") + 1).alias("doc_b"),
        reply.alias("response"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run history: every conversation counts as one run of its items."""
    scored = evaluate(items(spark, sf_dir), RUN_METRICS, failed=F.col("error_type").isNotNull())
    costed = with_cost(scored)
    means = [F.avg(m) for m in RUN_METRICS]
    conv = F.col("conv_id")
    return costed.groupBy("conv_id").agg(
        F.count_if(F.col("error_type").isNotNull()).alias("errors"),
        F.round(sum(means[1:], means[0]) / len(RUN_METRICS), 9).alias("score"),
        F.round(F.sum("cost_usd"), 12).alias("cost"),
    ).select(
        F.concat(F.lit("run-"), conv.cast("string")).alias("run_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(conv * 37 % 1000).cast("int")))
        .alias("created_at"),
        F.concat(_choice(["data/a/", "data/b/", "data/c/"], conv % 3), conv.cast("string"))
        .alias("dataset_path"),
        _choice(["json", "markdown"], conv % 2).alias("output"),
        "errors",
        "score",
        "cost",
    )
