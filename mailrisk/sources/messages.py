"""Message and raw mail sources."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from mailrisk.functions.common import strings
from mailrisk.functions.prep import html_to_text, split_raw_message
from mailrisk.operators.validate import fill_defaults
from mailrisk.schemas import MESSAGE

# Senders trusted unless the account says otherwise.
TRUSTED_SENDERS = [
    "noreply@paypal.com",
    "security@paypal.com",
    "service@amazon.com",
    "no-reply@accounts.google.com",
]


def read_messages(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Messages with the explicit schema; missing lists and locale get defaults."""
    return fill_defaults(spark.read.schema(MESSAGE).format(fmt).load(path))


def typed_ingest(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(messages, rejected lines): a wrongly typed field rejects the whole record."""
    corrupt = "_corrupt_record"
    schema = StructType([*MESSAGE.fields, StructField(corrupt, StringType())])
    parsed = lines.withColumn(
        "parsed",
        F.from_json(
            F.col(column),
            schema,
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt},
        ),
    )
    good = F.col("parsed").isNotNull() & F.col(f"parsed.{corrupt}").isNull()
    fields = [F.col(f"parsed.{name}") for name in MESSAGE.names]
    return (
        fill_defaults(parsed.filter(good).select(*fields)),
        parsed.filter(~good).select(F.col(column), F.lit("invalid_type").alias("reason")),
    )


def extract_mail_fields(raw_mails: DataFrame) -> DataFrame:
    """Message rows from raw mail.

    Takes ``message_id, raw, html, plain, attachments, user_address, user_locale``;
    without plain text the HTML is converted.
    """
    plain = F.coalesce(F.col("plain"), F.lit(""))
    user_domain = F.split_part(F.col("user_address"), F.lit("@"), F.lit(2))
    return fill_defaults(
        raw_mails.select(
            "message_id",
            split_raw_message(F.col("raw")).alias("raw_headers"),
            F.col("html").alias("raw_html"),
            F.when(plain != "", plain).otherwise(html_to_text(F.col("html"))).alias(
                "text_body"
            ),
            "attachments",
            F.struct(
                F.col("user_locale").alias("user_locale"),
                strings(TRUSTED_SENDERS).alias("trusted_senders"),
                F.array(user_domain).alias("owned_domains"),
            ).alias("context"),
        )
    )


def extract_review_fields(raw_mails: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Rows for the four-class review: the body, at most ``max_chars`` of it, and headers made from the fields.

    Takes ``message_id, sender, subject, sent_at, plain, html, attachments``.
    """
    plain = F.coalesce(F.col("plain"), F.lit(""))
    body = F.when(plain != "", plain).otherwise(F.col("html"))
    return raw_mails.select(
        "message_id",
        F.format_string(
            "From: %s\nSubject: %s\nDate: %s", "sender", "subject", "sent_at"
        ).alias("email_headers"),
        (body if max_chars is None else F.substring(body, 1, max_chars)).alias("email_body"),
        "sender",
        "subject",
        "attachments",
    )
