"""Explicit table schemas; nothing is inferred at read time."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields):
    return StructType([StructField(name, kind) for name, kind in fields.items()])


ATTACHMENT = _struct(
    filename=StringType(), mime=StringType(), size=LongType(), hash=StringType()
)
CONTEXT = _struct(
    user_locale=StringType(),
    trusted_senders=ArrayType(StringType()),
    owned_domains=ArrayType(StringType()),
)
MESSAGE = _struct(
    message_id=LongType(),
    raw_headers=StringType(),
    raw_html=StringType(),
    text_body=StringType(),
    attachments=ArrayType(ATTACHMENT),
    context=CONTEXT,
)
MESSAGE4 = _struct(
    email_headers=StringType(),
    email_body=StringType(),
    sender=StringType(),
    subject=StringType(),
    attachments=ArrayType(ATTACHMENT),
)

# A labelled case keeps the request under the interchange names.
CASE = _struct(
    name=StringType(),
    classification=StringType(),
    expected_score=IntegerType(),
    request=_struct(
        raw_headers=StringType(),
        raw_html=StringType(),
        text_body=StringType(),
        attachments_meta=ArrayType(ATTACHMENT),
        account_context=CONTEXT,
    ),
    expected_reasons=ArrayType(StringType()),
)
CASE_CATEGORIES = ["phishing_examples", "suspicious_examples", "legitimate_examples"]
CASE_SUITE = StructType(
    [StructField(name, ArrayType(CASE)) for name in CASE_CATEGORIES]
)

HEADER_FINDINGS = _struct(
    auth=StringType(),
    reply_to_mismatch=BooleanType(),
    display_name_spoof=BooleanType(),
    punycode=BooleanType(),
    suspicious_received=BooleanType(),
)
URL_FINDING = _struct(url=StringType(), reason=StringType(), risk_level=StringType())
EVIDENCE = _struct(
    header=HEADER_FINDINGS,
    urls=ArrayType(URL_FINDING),
    signals=ArrayType(StringType()),
)

# What a reviewer answers, under the interchange names of the answer format.
REVIEW = _struct(
    classification=StringType(),
    risk_score=LongType(),
    top_reasons=ArrayType(StringType()),
    non_technical_summary=StringType(),
    recommended_actions=ArrayType(StringType()),
    evidence=_struct(
        header_findings=_struct(
            spf_dkim_dmarc=StringType(),
            reply_to_mismatch=BooleanType(),
            display_name_spoof=BooleanType(),
            punycode_detected=BooleanType(),
            suspicious_received=BooleanType(),
        ),
        url_findings=ArrayType(URL_FINDING),
        nlp_signals=ArrayType(StringType()),
    ),
)

DOMAIN_INTEL = _struct(
    domain=StringType(),
    registered_on=DateType(),
    redirects=IntegerType(),
    final_url=StringType(),
    status=IntegerType(),
    blacklisted=BooleanType(),
)

LOG = _struct(
    ts=TimestampType(),
    level=StringType(),
    event=StringType(),
    method=StringType(),
    endpoint=StringType(),
    status=IntegerType(),
    duration_ms=LongType(),
    error_type=StringType(),
    component=StringType(),
    classification=StringType(),
    risk_score=IntegerType(),
    remote_ip=StringType(),
)
GAUGE = _struct(
    ts=TimestampType(), metric=StringType(), instance=StringType(), value=DoubleType()
)
