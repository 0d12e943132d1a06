"""The whole scoring plan: messages in, one verdict row per accepted message out."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.functions.common import computed_once
from mailrisk.operators.fuse import apply_policy, combine_review, error_columns, heuristics
from mailrisk.operators.validate import check_verdict, fill_defaults, has_content, require_content

SCORES = ["header_score", "url_score", "text_score", "attachment_score", "total_score"]
FEATURES = ["findings", "url_findings", "signals", "descriptions", *SCORES]
VERDICT = ["label", "risk_score", "top_reasons", "summary", "actions"]


def classify(
    messages: DataFrame,
    reviews: DataFrame | None = None,
    intel: DataFrame | None = None,
    as_of=None,
    keep: tuple[str, ...] = (),
    suffixes: DataFrame | None = None,
    brands: DataFrame | None = None,
) -> DataFrame:
    """Score messages.

    ``reviews`` (``message_id, response``), ``intel`` (one row per domain), ``suffixes`` (public-suffix
    rules) and ``brands`` (imitated domains) are optional; without them the plan is a single narrow
    stage.  ``keep`` names message columns to carry along, such as an event time.
    """
    accepted, _ = require_content(fill_defaults(messages))
    scored = heuristics(accepted, intel, as_of, suffixes=suffixes, brands=brands).select("message_id", *keep, *FEATURES)
    return verdict_columns(apply_policy(combine_review(scored, reviews)), keep)


def verdict_columns(judged: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The verdict row of judged messages.

    ``latency_ms`` is null: a row of a batch has no time of its own.
    """
    verdict = {name: F.col(f"verdict.{name}") for name in VERDICT}
    return computed_once(
        judged,
        ["message_id", *keep],
        {
            **verdict,
            "evidence": F.col("evidence"),
            "latency_ms": F.lit(None).cast("int"),
            "heuristics": F.struct(
                *SCORES, "findings", "url_findings", "descriptions", "critical"
            ),
        },
    )


def answers(messages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One answer per message, whatever happens to it, in one narrow pass.

    ``status`` is ``ok`` with the verdict, ``invalid_request`` without one for a message without content, or
    ``analysis_failed`` with the fixed cautious verdict where the analysis gave no valid verdict; ``reason`` names
    the constraint that failed.
    """
    filled = fill_defaults(messages)
    scored = heuristics(filled).select("message_id", *keep, *FEATURES, F.coalesce(has_content(), F.lit(False)).alias("accepted"))
    told = verdict_columns(apply_policy(combine_review(scored)), (*keep, "accepted"))
    checked = check_verdict(told)
    failed = F.array_compact(F.array(*[F.when(~F.col(c), c) for c in checked.columns if c.endswith("_ok")]))
    status = F.when(~F.col("accepted"), "invalid_request").when(F.col("valid"), "ok").otherwise("analysis_failed")
    caution = error_columns()
    rows = checked.withColumns({"status": status, "reason": F.when(~F.col("accepted"), "no content").otherwise(F.array_join(failed, ","))})
    answer = {name: F.when(F.col("status") == "ok", F.col(name)).when(F.col("status") == "analysis_failed", caution[name]) for name in VERDICT}
    return rows.select("message_id", *keep, "status", F.when(F.col("reason") != "", F.col("reason")).alias("reason"), *[c.alias(n) for n, c in answer.items()])
