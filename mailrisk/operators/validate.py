"""Row checks before and after scoring."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk import rules
from mailrisk.functions.common import strings
from mailrisk.schemas import ATTACHMENT


def has_content():
    """Some of headers, HTML and text is present."""
    return (
        (F.col("raw_headers") != "") | (F.col("raw_html") != "") | (F.col("text_body") != "")
    )


def fill_defaults(messages: DataFrame) -> DataFrame:
    """Missing texts become empty, missing lists empty lists, the locale its default."""
    context = F.col("context")
    texts = {
        c: F.coalesce(F.col(c), F.lit("")) for c in ("raw_headers", "raw_html", "text_body")
    }
    return messages.withColumns(
        {
            **texts,
            "attachments": F.coalesce(
                F.col("attachments"),
                F.array().cast(f"array<{ATTACHMENT.simpleString()}>"),
            ),
            "context": F.struct(
                F.coalesce(context["user_locale"], F.lit(rules.DEFAULT_LOCALE)).alias(
                    "user_locale"
                ),
                F.coalesce(context["trusted_senders"], strings([])).alias(
                    "trusted_senders"
                ),
                F.coalesce(context["owned_domains"], strings([])).alias("owned_domains"),
            ),
        }
    )


def require_content(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a message without any content is rejected."""
    present = F.coalesce(has_content(), F.lit(False))
    return (
        messages.filter(present),
        messages.filter(~present).withColumn("reason", F.lit("invalid_request")),
    )


def check_verdict(verdicts: DataFrame) -> DataFrame:
    """One boolean per constraint on a verdict row, and ``valid`` for all of them."""
    summary = F.col("summary")
    words = F.size(F.filter(F.split(summary, r"\s+"), lambda w: w != ""))
    checks = {
        "label_ok": F.col("label").isin(rules.LABELS),
        "score_ok": F.col("risk_score").between(0, 100),
        "reasons_ok": F.size("top_reasons") <= 3,
        "actions_ok": F.size("actions") <= 3,
        "summary_ok": (F.length(summary) <= 200) & (words <= 60),
    }
    checked = verdicts.withColumns(
        {name: F.coalesce(c, F.lit(False)) for name, c in checks.items()}
    )
    return checked.withColumn(
        "valid", F.expr(" AND ".join(checks))
    )
