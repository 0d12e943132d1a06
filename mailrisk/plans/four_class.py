"""Mail and mail files reviewed in four classes: request out, review text in."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk import rules
from mailrisk.functions.common import strings
from mailrisk.functions.verdict import file_class_verdict, four_class_verdict

# What the interactive service shows a reviewer of a mail and of a mail file.
MAIL_CHARS, FILE_CHARS = 1500, 1200
# labels from harmless to grave
GRAVITY = ["safe", "spam", "suspicious", "phishing"]


def review_requests(mails: DataFrame, max_chars: int | None = None) -> DataFrame:
    """What a reviewer sees of a mail; takes ``message_id, email_body, sender, subject,
    attachments``.  ``max_chars`` limits the body.
    """
    body = F.col("email_body") if max_chars is None else F.substring("email_body", 1, max_chars)
    request = mails.select(
        "message_id", "sender", "subject", body.alias("body"),
        F.greatest(F.size("attachments"), F.lit(0)).alias("n_attachments"),
    )
    prompt = F.format_string(
        "Is this mail safe, spam, suspicious or phishing?\n\nFrom: %s\nSubject: %s\n"
        "Attachments: %d\n\n%s\n\nEnd with VEREDICTO: SEGURO, SPAM, SOSPECHOSO or PHISHING.",
        "sender", "subject", "n_attachments", "body",
    )
    return request.withColumn("prompt", prompt)


def judge(mails: DataFrame, reviews: DataFrame, files: bool = False) -> DataFrame:
    """Verdict of every mail from its review (``message_id, response``).

    A mail without a review is an error with a middle score.  Of several reviews the one with the gravest
    label counts, of equal labels the highest score.  ``files`` uses the rules for mail files.
    """
    reads = file_class_verdict if files else four_class_verdict
    read = reviews.where(F.col("response").isNotNull()).select(
        "message_id", F.col("response").alias("analysis"), reads(F.col("response")).alias("v")
    )
    rank = F.struct(F.array_position(strings(GRAVITY), F.col("v.label")), "v.risk_score", "analysis")
    one_each = read.groupBy("message_id").agg(F.max_by(F.struct("analysis", "v"), rank).alias("told")).select("message_id", "told.*")
    judged = mails.join(one_each, "message_id", "left")
    details = F.create_map(
        F.lit("sender"), F.col("sender"),
        F.lit("subject"), F.col("subject"),
        F.lit("attachments"), F.greatest(F.size("attachments"), F.lit(0)).cast("string"),
    )
    return judged.select(
        "message_id",
        F.coalesce("v.label", F.lit(rules.FAILED_LABEL)).alias("label"),
        F.coalesce("v.risk_score", F.lit(rules.FAILED_SCORE)).alias("risk_score"),
        F.coalesce("analysis", F.lit(rules.FAILED_TEXT)).alias("analysis"),
        F.coalesce("v.recommendations", strings(rules.FAILED_RECOMMENDATIONS)).alias(
            "recommendations"
        ),
        F.coalesce("v.explanation", F.lit("")).alias("explanation"),
        details.alias("details"),
    )
