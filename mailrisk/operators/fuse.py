"""Fusion of the four analyses, reviews and the safety policy, row by row.

Every step is a narrow projection.  Steps are separate so that a value used
several times downstream is computed once: Spark does not merge projections when
that would repeat expensive expressions.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk import rules
from mailrisk.functions import headers as H
from mailrisk.functions import text as N
from mailrisk.functions import urls as U
from mailrisk.functions import verdict as V
from mailrisk.functions.attachments import attachment_score
from mailrisk.functions.common import computed_once, strings
from mailrisk.functions.prep import clean_text
from mailrisk.functions.redact import redact_headers, redact_text
from mailrisk.operators.urls import analysed_urls
from mailrisk.schemas import EVIDENCE, HEADER_FINDINGS


# labels from harmless to grave
GRAVITY = ["seguro", "sospechoso", "phishing"]


def redacted(messages: DataFrame) -> DataFrame:
    """Masked headers and text next to the original columns."""
    return messages.withColumns(
        {
            "redacted_headers": redact_headers(F.col("raw_headers")),
            "redacted_text": redact_text(F.col("text_body")),
        }
    )


BODIES = ("raw_headers", "raw_html", "text_body", "redacted_headers", "redacted_text", "header_fields", "clean", "lines", "ends")


def heuristics(
    messages: DataFrame,
    intel: DataFrame | None = None,
    as_of=None,
    url_limit: int | None = None,
    suffixes: DataFrame | None = None,
    brands: DataFrame | None = None,
) -> DataFrame:
    """Add redacted texts, findings, component scores and the weighted total.

    Without lookup tables the plan has no shuffle and works on streams.  With ``intel`` (one row per domain),
    ``suffixes`` (public-suffix rules) or ``brands`` (imitated domains) the texts are left out of the result: features
    are written once, and only they and thin facts about links are joined.
    """
    prepared = redacted(messages).withColumns(
        {
            "header_fields": H.header_fields(F.col("redacted_headers")),
            "clean": clean_text(F.col("redacted_text")),
            "urls": U.all_links(F.col("raw_html"), F.col("redacted_text"), url_limit),
        }
    )
    signalled = (
        prepared.withColumns(
            {
                "header_details": H.header_details(F.col("header_fields")),
                "lines": N.phrase_lines(F.col("clean")),
                "ends": N.word_ends(F.col("clean")),
            }
        )
        .withColumn("signals", N.signals_of(F.col("clean"), F.col("lines"), ends=F.col("ends")))
        .drop("header_fields", "clean", "lines", "ends")
    )
    if intel is None and suffixes is None and brands is None:
        analysed = signalled.withColumn("analysed", U.analyse_urls(F.col("urls")))
    else:
        slim = signalled.drop(*BODIES)
        analysed = analysed_urls(slim, intel, as_of, suffixes, brands)
    steps = ("urls", "analysed", "header_details", "signals")
    found = computed_once(
        analysed,
        [c for c in analysed.columns if c not in steps],
        {
            "header_details": F.col("header_details"),
            "signals": F.col("signals"),
            "findings": H.findings_of(F.col("header_details")),
            "url_findings": F.array_compact(
                F.transform("analysed", lambda a: a["finding"])
            ),
            "url_metadata": F.transform("analysed", lambda a: a["metadata"]),
            "descriptions": N.signal_descriptions(F.col("signals")),
        },
    )
    scored = found.withColumns(
        {
            "header_score": H.header_score(F.col("findings")),
            "url_score": U.url_score(F.col("url_findings")),
            "text_score": N.text_score(F.col("signals")),
            "attachment_score": attachment_score(F.col("attachments")),
        }
    )
    components = ["header_score", "url_score", "text_score", "attachment_score"]
    return scored.withColumn("total_score", V.total_score(*map(F.col, components)))


def _neutral_evidence(signal: str):
    header = F.struct(
        F.lit("ok").alias("auth"),
        *[F.lit(False).alias(f.name) for f in HEADER_FINDINGS.fields[1:]],
    )
    return F.struct(
        header.alias("header"),
        F.array().cast(EVIDENCE["urls"].dataType).alias("urls"),
        strings([signal]).alias("signals"),
    )


def gravest(review: str) -> Column:
    """Of several parsed reviews the one with the gravest label, of equal labels the highest score."""
    rank = F.struct(F.array_position(strings(GRAVITY), F.col(review)["label"]), F.col(review))
    return F.max_by(F.col(review), F.when(F.col(review).isNotNull(), rank)).alias(review)


def judged_by(rows: DataFrame) -> DataFrame:
    """``verdict`` and ``evidence`` from the column ``review`` where it is not null, else from the score."""
    answered = F.col("review").isNotNull()
    names = ("label", "risk_score", "top_reasons", "summary", "actions")
    reviewed = F.struct(*[F.col("review")[n].alias(n) for n in names])
    return rows.withColumns(
        {
            "verdict": F.when(answered, reviewed).otherwise(V.fallback_verdict(F.col("total_score"))),
            "evidence": F.when(answered, F.col("review.evidence")).otherwise(
                _neutral_evidence(rules.FALLBACK_SIGNAL)
            ),
        }
    ).drop("review")


def combine_review(scored: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """The reviewer's verdict where it is valid, else the score's own verdict.

    ``reviews`` has ``message_id, response``; should a message have several, the
    gravest label counts, of equal labels the highest score.
    """
    if reviews is None:
        fallback = V.fallback_verdict(F.col("total_score"))
        return scored.withColumns({"verdict": fallback, "evidence": _neutral_evidence(rules.FALLBACK_SIGNAL)})
    parsed = (
        reviews.select("message_id", V.parse_review(F.col("response")).alias("review"))
        .groupBy("message_id")
        .agg(gravest("review"))
    )
    return judged_by(scored.join(parsed, "message_id", "left"))


def apply_policy(verdicts: DataFrame) -> DataFrame:
    """Elevate on critical signals, then make score and label agree."""
    return (
        verdicts.withColumn(
            "critical",
            V.critical_signals(F.col("findings"), F.col("url_findings"), F.col("signals")),
        )
        .withColumn("verdict", V.elevate(F.col("verdict"), F.col("critical")))
        .withColumn("verdict", V.score_label_consistency(F.col("verdict")))
    )


def error_columns() -> dict[str, Column]:
    """The fixed cautious verdict for messages that could not be analysed."""
    return {
        "label": F.lit(rules.ERROR_LABEL),
        "risk_score": F.lit(rules.ERROR_SCORE),
        "top_reasons": strings(rules.ERROR_REASONS),
        "summary": F.lit(rules.ERROR_SUMMARY),
        "actions": strings(rules.ERROR_ACTIONS),
    }


def error_verdict(failed: DataFrame) -> DataFrame:
    """``error_columns`` as verdict rows."""
    return failed.select(
        "message_id",
        *[c.alias(name) for name, c in error_columns().items()],
        _neutral_evidence(rules.ERROR_SIGNAL).alias("evidence"),
        F.lit(None).cast("int").alias("latency_ms"),
    )
