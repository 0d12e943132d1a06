"""Mail files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk.functions.regex import SPACE

# What the interactive service reads of a file.
SERVICE_LIMITS = {"max_lines": 200, "max_chars": 2000, "field_chars": 100}
_BLANKS = rf"\A[{SPACE}]+|[{SPACE}]+\z"
_DISPOSITION = "content-disposition: attachment"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, _BLANKS, "")


def _decoded(content: Column) -> Column:
    """UTF-8 text without the bytes that are none."""
    raw = content.cast("string")
    broken, held = F.lit("\ufffd"), F.lit("\uffff")
    marked = F.make_valid_utf8(F.replace(raw, broken, held))
    repaired = F.replace(F.replace(marked, broken, F.lit("")), held, broken)
    return F.when(F.is_valid_utf8(raw), raw).otherwise(repaired)


def _last_field(lines: Column, name: str, default: str, chars: int | None) -> Column:
    """The last line with this name, trimmed, at most ``chars`` of it; also when it is in the body."""
    found = F.filter(lines, lambda line: line.startswith(name))
    value = F.regexp_replace(F.get(found, F.size(found) - 1), rf"\A{name}", "")
    value = _strip(value) if chars is None else F.substring(_strip(value), 1, chars)
    return F.when(F.size(found) > 0, value).otherwise(default)


def parse_eml(
    files: DataFrame,
    content: str = "content",
    max_lines: int | None = None,
    max_chars: int | None = None,
    field_chars: int | None = None,
) -> DataFrame:
    """Sender, subject, headers, body and attachment count of whole mail files.

    The first blank line ends the headers.  Limits are off unless given: ``max_lines`` lines
    are looked at; body lines add up until they exceed ``max_chars`` characters, which also ends
    the search for sender and subject; headers are cut to as many; sender and
    subject to ``field_chars``.
    """
    bodyless = ("From:", "Subject:")

    def is_field(line):
        return line.startswith(bodyless[0]) | line.startswith(bodyless[1])

    blank_at = F.array_min(
        F.filter(
            F.transform(
                F.col("lines"), lambda line, i: F.when(_strip(line) == "", i)
            ),
            lambda i: i.isNotNull(),
        )
    )
    # body lines with the length the body has before them; a line is read while
    # that length does not exceed the limit
    start = F.struct(
        F.array().cast("array<string>").alias("seen"),
        F.lit("").alias("body"),
    )

    def read(acc, line):
        open_ = F.length(acc["body"]) <= max_chars
        body = F.when(
            open_ & ~is_field(line), F.concat(acc["body"], line, F.lit("\n"))
        ).otherwise(acc["body"])
        seen = F.when(
            open_ & is_field(line), F.array_append(acc["seen"], line)
        ).otherwise(acc["seen"])
        return F.struct(seen.alias("seen"), body.alias("body"))

    n_head = F.coalesce(F.col("blank_at"), F.size("lines"))
    head = F.slice(F.col("lines"), 1, n_head)
    none = F.array().cast("array<string>")
    rest = F.when(
        F.col("blank_at").isNotNull(),
        F.slice(F.col("lines"), F.col("blank_at") + 2, F.size("lines")),
    ).otherwise(none)
    if max_chars is None:
        text = F.filter(rest, lambda line: ~is_field(line))
        scan = F.struct(
            F.filter(rest, is_field).alias("seen"),
            F.when(F.size(text) > 0, F.concat(F.array_join(text, "\n"), F.lit("\n"))).otherwise("").alias("body"),
        )
    else:
        scan = F.aggregate(rest, start, read)
    fields = F.filter(F.concat(head, F.col("scan.seen")), is_field)
    headers = F.array_join(head, "\n")
    lines = F.split("decoded", "\n")
    return (
        files.withColumn("decoded", _decoded(F.col(content)))
        .withColumn("lines", lines if max_lines is None else F.slice(lines, 1, max_lines))
        .withColumn("blank_at", blank_at)
        .withColumn("scan", scan)
        .select(
            *[c for c in files.columns if c != content],
            _last_field(fields, bodyless[0], "Unknown", field_chars).alias("sender"),
            _last_field(fields, bodyless[1], "No Subject", field_chars).alias("subject"),
            F.when(
                F.col("blank_at").isNotNull(),
                headers if max_chars is None else F.substring(headers, 1, max_chars),
            ).otherwise("").alias("headers"),
            F.col("scan.body").alias("body"),
            (F.size(F.split(F.lower("decoded"), _DISPOSITION)) - 1).alias(
                "attachment_count"
            ),
        )
    )


def _mail_files(reader, path: str, pattern: str) -> DataFrame:
    files = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return files.load(path).select("path", "content")


# So many of a scan's partitions go to one task.
_PARTITIONS_A_TASK = 32


def _packed(files: DataFrame) -> DataFrame:
    """Fewer tasks, without a shuffle: a scan counts a file as some megabytes at least, so few small ones fill a partition."""
    n = files.rdd.getNumPartitions()
    least = min(n, 4 * files.sparkSession.sparkContext.defaultParallelism)
    return files.coalesce(max(least, n // _PARTITIONS_A_TASK, 1))


def read_eml(spark: SparkSession, path: str, pattern: str = "*.eml", **limits) -> DataFrame:
    """All mail files below ``path``, one row per file; empty files have none.  ``limits`` as in `parse_eml`."""
    return parse_eml(_packed(_mail_files(spark.read.format("binaryFile"), path, pattern)), **limits)


def stream_eml(spark: SparkSession, path: str, pattern: str = "*.eml", **limits) -> DataFrame:
    """`read_eml` of files as they arrive."""
    files = spark.readStream.schema(BINARY_FILE).format("binaryFile")
    return parse_eml(_mail_files(files, path, pattern), **limits)


BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
