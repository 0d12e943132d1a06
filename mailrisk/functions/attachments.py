"""Attachment risk from metadata."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailrisk import rules
from mailrisk.functions.common import any_of, contains_any


def attachment_points(attachment: Column) -> Column:
    """Points of one attachment: extension, MIME type, odd size."""
    name, mime = F.lower(attachment["filename"]), F.lower(attachment["mime"])
    size = attachment["size"]
    return (
        F.when(any_of(name.endswith(e) for e in rules.RISKY_EXTENSIONS), 25.0).otherwise(0.0)
        + F.when(contains_any(mime, rules.RISKY_MIME_PARTS), 15.0).otherwise(0.0)
        + F.when(size > rules.BIG_FILE_BYTES, 5.0).when(size == 0, 10.0).otherwise(0.0)
    )


def attachment_score(attachments: Column) -> Column:
    points = F.aggregate(
        attachments, F.lit(0.0), lambda total, a: total + attachment_points(a)
    )
    return F.least(points, F.lit(100.0))
