"""A3, A9 and the metric registry: score items by adding one column per metric.

``evaluate`` is a projection. It never shuffles, so it runs on streams as well
as on tables, and every metric is a JVM expression unless a user registers one
that is not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import cost_metrics as cm
from plumbline.operators import generation_metrics as gm
from plumbline.operators import retrieval_metrics as rm

# --- fixed values: metric names by group, default choice, older short names --
METRIC_GROUPS = {
    "retrieval": [
        "context_precision", "context_recall", "recall_at_k", "precision_at_k",
        "hit_rate", "mrr", "ndcg",
    ],
    "generation": [
        "faithfulness", "answer_relevancy", "hallucination", "semantic_similarity",
        "exact_match", "f1_score", "bleu", "rouge", "bertscore",
    ],
    "performance": ["latency"],
    "cost": ["token_count"],
}
DEFAULT_METRICS = [
    "context_precision", "context_recall", "mrr", "faithfulness", "answer_relevancy",
    "latency", "token_count",
]
SHORT_NAMES = {
    "precision": "context_precision",
    "recall": "context_recall",
    "relevancy": "answer_relevancy",
    "similarity": "semantic_similarity",
    "tokens": "token_count",
}
# -----------------------------------------------------------------------------

LOWER_IS_BETTER = {"hallucination"}

# Token arrays and normalised lists shared by the metrics, by column name.
_PREPARED: dict[str, Callable[[], Column]] = {
    "_ret": lambda: F.transform(tx.texts_or_empty(F.col("contexts")), tx.normalize_context),
    "_rel": lambda: F.transform(
        tx.texts_or_empty(F.col("ground_truth_contexts")), tx.normalize_context
    ),
    "_aw": lambda: tx.words(F.col("answer")),
    "_tw": lambda: tx.words(F.col("ground_truth")),
    "_ctx": lambda: tx.word_set(
        F.array_join(tx.texts_or_empty(F.col("contexts")), " ", null_replacement="")
    ),
    "_qk": lambda: tx.question_words(F.col("question")),
    "_ak": lambda: tx.question_words(F.col("answer")),
}
# Second stage, built on the first.
_DERIVED: dict[str, tuple[Callable[[], Column], list[str]]] = {
    "_as": (lambda: F.array_distinct("_aw"), ["_aw"]),
    "_ts": (lambda: F.array_distinct("_tw"), ["_tw"]),
    "_shared": (
        lambda: F.size(
            F.array_intersect(
                tx.occurrence_labels(F.col("_aw")), tx.occurrence_labels(F.col("_tw"))
            )
        ),
        ["_aw", "_tw"],
    ),
}


@dataclass(frozen=True)
class Metric:
    """A named score. ``score`` and ``error`` build columns; ``needs`` names prepared inputs."""

    name: str
    score: Callable[..., Column]
    needs: tuple[str, ...] = ()
    error: Callable[..., Column] | None = None


def _c(name: str) -> Column:
    return F.col(name)


def _builtin() -> dict[str, Metric]:
    ranked = ("_ret", "_rel")
    sizes = lambda: (F.size("_aw"), F.size("_tw"), _c("_shared"))
    found = [
        Metric("context_precision", lambda k: rm.context_precision(_c("_ret"), _c("_rel")), ranked),
        Metric("context_recall", lambda k: rm.context_recall(_c("_ret"), _c("_rel")), ranked),
        Metric("recall_at_k", lambda k: rm.recall_at_k(_c("_ret"), _c("_rel"), k), ranked),
        Metric("precision_at_k", lambda k: rm.precision_at_k(_c("_ret"), _c("_rel"), k), ranked),
        Metric("hit_rate", lambda k: rm.hit_rate(_c("_ret"), _c("_rel")), ranked),
        Metric("mrr", lambda k: rm.mrr(_c("_ret"), _c("_rel")), ranked),
        Metric(
            "ndcg",
            lambda k: rm.ndcg(_c("_ret"), _c("_rel"), k),
            ranked,
            lambda k: rm.ndcg_error(_c("_ret"), _c("_rel"), k),
        ),
        Metric("exact_match", lambda k: gm.exact_match(_c("answer"), _c("ground_truth"))),
        Metric(
            "f1_score",
            lambda k: gm.f1_score(_c("answer"), _c("ground_truth"), *sizes()),
            ("_shared",),
        ),
        Metric(
            "bleu", lambda k: gm.bleu(_c("answer"), _c("ground_truth"), *sizes()), ("_shared",)
        ),
        Metric("rouge", lambda k: gm.rouge(_c("_as"), _c("_ts")), ("_as", "_ts")),
        Metric(
            "semantic_similarity",
            lambda k: gm.word_similarity(_c("_as"), _c("_ts")),
            ("_as", "_ts"),
        ),
        Metric("bertscore", lambda k: gm.word_similarity(_c("_as"), _c("_ts")), ("_as", "_ts")),
        Metric("faithfulness", lambda k: gm.faithfulness(_c("_as"), _c("_ctx")), ("_as", "_ctx")),
        Metric(
            "answer_relevancy",
            lambda k: gm.answer_relevancy(_c("question"), _c("answer"), _c("_qk"), _c("_ak")),
            ("_qk", "_ak"),
        ),
        Metric(
            "hallucination",
            lambda k: gm.hallucination(_c("answer"), _c("contexts"), _c("_as"), _c("_ctx")),
            ("_as", "_ctx"),
        ),
        Metric(
            "latency",
            lambda k: cm.latency_score(_c("latency_ms")),
            (),
            lambda k: cm.latency_error(_c("latency_ms")),
        ),
        Metric("token_count", lambda k: cm.token_score(_c("prompt_tokens"), _c("completion_tokens"))),
    ]
    return {m.name: m for m in found}


_REGISTRY: dict[str, Metric] = _builtin()


def _given(name: str, variant: str, score: Callable[[], Column]) -> Metric:
    """A form of a metric that reads what a model gave; a row without it scores 0 with a message."""
    message = F.lit(f"the {variant} form of {name} has no input here")
    return Metric(name, lambda k: score(), (), lambda k: F.when(score().isNull(), message))


def _variants() -> dict[tuple[str, str], Metric]:
    """Model-backed forms by metric and variant, and the columns they read.

    vectors: answer_vec and ground_truth_vec; scores: bertscore_f1; nli:
    faithfulness_nli (as ``claim_support`` adds it) or relevancy_nli (entailment of
    the question by the answer).
    """
    vectors = lambda: (_c("answer_vec"), _c("ground_truth_vec"))
    forms = [
        ("semantic_similarity", "vectors", lambda: gm.vector_similarity(*vectors())),
        ("bertscore", "vectors", lambda: gm.vector_bertscore(*vectors())),
        ("bertscore", "scores", lambda: gm.given_bertscore(_c("bertscore_f1"))),
        ("faithfulness", "nli", lambda: _c("faithfulness_nli")),
        ("answer_relevancy", "nli", lambda: gm.nli_relevancy(_c("question"), _c("answer"), _c("relevancy_nli"))),
    ]
    return {(name, variant): _given(name, variant, score) for name, variant, score in forms}


def _chosen(names: list[str], variants: Mapping[str, str] | None) -> list[Metric]:
    """The metrics, in the wanted forms; ``words`` is the built-in form of every metric."""
    wanted = {SHORT_NAMES.get(n, n): v for n, v in (variants or {}).items() if v != "words"}
    if not wanted:
        return [_REGISTRY[n] for n in names]
    known = _variants()
    unknown = [f"{n}: {v}" for n, v in wanted.items() if (n, v) not in known]
    if unknown:
        raise KeyError(f"unknown variants {unknown}; available: {sorted(known)}")
    return [known[n, wanted[n]] if n in wanted else _REGISTRY[n] for n in names]


def metric_names() -> list[str]:
    return sorted(_REGISTRY)


def resolve_metrics(names: Iterable[str]) -> list[str]:
    """Canonical names in the given order; an unknown name is an error that lists the choices."""
    resolved = [SHORT_NAMES.get(n, n) for n in names]
    unknown = [n for n in resolved if n not in _REGISTRY]
    if unknown:
        raise KeyError(f"unknown metrics {unknown}; available: {', '.join(metric_names())}")
    return list(dict.fromkeys(resolved))


def route_metrics(names: Iterable[str]) -> dict[str, list[str]]:
    """Split a flat list into the four groups; names in no group are dropped."""
    canonical = [SHORT_NAMES.get(n, n) for n in names]
    return {g: [n for n in canonical if n in members] for g, members in METRIC_GROUPS.items()}


def register_metric(
    name: str,
    score: Callable[[DataFrame], Column] | Callable[[], Column],
    error: Callable[[], Column] | None = None,
) -> None:
    """Add a user metric: ``score()`` returns a Column over the item columns.

    A Python scorer goes in as a pandas UDF applied to columns.
    """
    _REGISTRY[name] = Metric(
        name, lambda k: score(), (), None if error is None else (lambda k: error())
    )


def unregister_metric(name: str) -> None:
    if name in _builtin():
        raise ValueError(f"{name} is built in")
    _REGISTRY.pop(name, None)


def _prepare(df: DataFrame, wanted: set[str]) -> tuple[DataFrame, list[str]]:
    derived = [n for n in _DERIVED if n in wanted]
    first = {n for n in wanted if n in _PREPARED}
    for n in derived:
        first.update(_DERIVED[n][1])
    if first:
        df = df.withColumns({n: _PREPARED[n]() for n in _PREPARED if n in first})
    if derived:
        df = df.withColumns({n: _DERIVED[n][0]() for n in derived})
    return df, [*first, *derived]


def evaluate(
    df: DataFrame,
    metrics: Iterable[str] = tuple(DEFAULT_METRICS),
    k: int | None = None,
    failed: Column | None = None,
    variants: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add a DOUBLE column per metric, plus ``metric_errors`` (MAP name to message).

    Reads ``question``, ``answer``, ``ground_truth``, ``contexts``,
    ``ground_truth_contexts``, ``latency_ms``, ``prompt_tokens`` and
    ``completion_tokens`` as the chosen metrics need them. A metric that fails on
    a row scores 0 there and leaves a message. Rows where ``failed`` is true get
    0 for every metric (A4). ``variants`` picks the model-backed form of a metric by
    name: ``vectors``, ``scores`` or ``nli``; their inputs are columns of ``df``.
    """
    names = resolve_metrics(metrics)
    chosen = _chosen(names, variants)
    prepared, temps = _prepare(df, {n for m in chosen for n in m.needs})
    off = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))

    def guarded(m: Metric) -> Column:
        value = m.score(k)
        score = F.coalesce(value, F.lit(0.0))
        return score if failed is None else F.when(off, F.lit(0.0)).otherwise(score)

    entries = [
        F.struct(F.lit(m.name).alias("key"), m.error(k).alias("value")) for m in chosen if m.error
    ]
    if entries:
        errors = F.map_from_entries(
            F.filter(F.array(*entries), lambda e: e["value"].isNotNull() & ~off)
        )
    else:
        errors = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    scored = prepared.withColumns({m.name: guarded(m) for m in chosen})
    return scored.withColumn("metric_errors", errors).drop(*temps)


def long_scores(df: DataFrame, names: Iterable[str], *keys: str) -> DataFrame:
    """Wide to long: one row per key and metric, columns ``metric`` and ``score``."""
    names = list(names)
    return df.unpivot([F.col(c) for c in keys], [F.col(n) for n in names], "metric", "score")
