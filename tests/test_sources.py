import hashlib
import json

from pyspark.sql import functions as F

from mailrisk.functions import prep
from mailrisk.operators.tables import attachment_hash
from mailrisk.plans.classify import classify
from mailrisk.sources.cases import case_messages, read_cases
from mailrisk.sources.eml import SERVICE_LIMITS, read_eml
from mailrisk.sources.logs import read_logs, split_logs
from mailrisk.sources.messages import (
    extract_mail_fields,
    extract_review_fields,
    read_messages,
    typed_ingest,
)
from mailrisk.sources.sinks import export_metrics, write_verdicts


def brute_eml(content, most_lines=None, most_chars=None, most_field=None):
    """The fields of a mail file, line by line."""
    text = content.decode("utf-8", errors="ignore")
    lines = text.split("\n")
    found = {"sender": "Unknown", "subject": "No Subject", "headers": "", "body": ""}
    reading = False
    for number, line in enumerate(lines[:most_lines]):
        if line.startswith("From:"):
            found["sender"] = line[5:].strip()[:most_field]
        elif line.startswith("Subject:"):
            found["subject"] = line[8:].strip()[:most_field]
        elif reading:
            found["body"] += line + "\n"
            if most_chars and len(found["body"]) > most_chars:
                break
        elif not line.strip():
            reading, found["headers"] = True, "\n".join(lines[:number])[:most_chars]
    return {**found, "attachment_count": text.lower().count("content-disposition: attachment")}


def test_read_eml(spark, tmp_path):
    mails = {
        "plain": "From: a@b.c\nSubject: Hi\nTo: x\n\nBody one\n\nBody two\nSubject: later\nrest",
        "crlf": "From: a@b.c \r\nSubject:  S \r\n\r\nBody\r\nContent-Disposition: Attachment; f\r\ncontent-disposition: attachment",
        "long": "Subject: " + "s" * 150 + "\n\n" + "\n".join(f"line {i} " + "x" * 90 for i in range(60)) + "\nFrom: too-late",
        "many": "From: f\n\n" + "\n".join("y" for _ in range(300)) + "\nSubject: beyond",
        "nobody": "From: only@headers.org\nTo: z", "blankfirst": "\nFrom: b@c.d\nfirst",
        "bigheader": "X: " + "h" * 3000 + "\n\nbody",
    }
    for name, text in mails.items():
        (tmp_path / f"{name}.eml").write_bytes(text.encode())
    (tmp_path / "broken.eml").write_bytes(b"From: caf\xc3\xa9\n\nok")
    (tmp_path / "empty.eml").write_text("")
    (tmp_path / "skip.txt").write_text("From: no")
    for limits, brute in (({}, ()), (SERVICE_LIMITS, (200, 2000, 100))):
        rows = {r.path.rsplit("/", 1)[1]: r for r in read_eml(spark, str(tmp_path), **limits).collect()}
        assert len(rows) == len(mails) + 1
        for path in set(tmp_path.glob("*.eml")) - {tmp_path / "empty.eml"}:
            row = rows[path.name].asDict()
            row.pop("path")
            assert row == brute_eml(path.read_bytes(), *brute), path.name


def test_bad_bytes_are_dropped(spark, tmp_path):
    (tmp_path / "x.eml").write_bytes(b"From: a\xff\xfeb@c.d\nSubject: \xc3\xa9\xe2\x82 ok\n\nbo\x80dy")
    row = read_eml(spark, str(tmp_path)).first().asDict()
    row.pop("path")
    assert row == brute_eml((tmp_path / "x.eml").read_bytes())


def test_messages_get_defaults(spark, tmp_path):
    (tmp_path / "m.json").write_text(
        '{"message_id": 1, "raw_headers": "h", "raw_html": "", "text_body": "t"}\n'
        '{"message_id": 2, "text_body": "t", "context": {"user_locale": "en-US"}, "attachments": [{"filename": "f", "size": 3}]}\n'
    )
    one, two = read_messages(spark, str(tmp_path)).orderBy("message_id").collect()
    assert one.context.user_locale == "es-ES" and one.attachments == [] and one.context.owned_domains == []
    assert two.context.user_locale == "en-US" and two.raw_headers == "" and two.attachments[0].size == 3


def test_wrong_types_reject_the_record(spark):
    good = {"message_id": 1, "raw_headers": "a", "raw_html": "", "text_body": "t", "attachments": [{"filename": "f", "mime": "m", "size": 1, "hash": "h"}]}
    bad = json.loads(json.dumps(good))
    bad["attachments"][0]["size"] = "big"
    lines = spark.createDataFrame([(json.dumps(good),), (json.dumps(bad),), ("{oops",)], "value string")
    accepted, rejected = typed_ingest(lines)
    assert [r.message_id for r in accepted.collect()] == [1] and rejected.count() == 2


def test_split_raw_message(values):
    assert values(prep.split_raw_message, ["A: b\r\nC: d\r\n\r\nbody\r\n\r\nmore", "x" * 2500, "\r\n\r\nrest"]) == [
        "A: b\r\nC: d", "x" * 2500, ""]
    cut = lambda raw: prep.split_raw_message(raw, prep.HEADER_FALLBACK_CHARS)
    assert values(cut, ["A: b\r\n\r\nmore", "x" * 2500]) == ["A: b", "x" * 2000]


def test_extract_fields(spark):
    rows = spark.createDataFrame(
        [(1, "H: 1\r\n\r\nraw", "<p>Hi <b>you</b></p>", "", None, "me@corp.es", None, "s@x.y", "Sub", "Mon")],
        "message_id long, raw string, html string, plain string,"
        " attachments array<struct<filename:string,mime:string,size:bigint,hash:string>>,"
        " user_address string, user_locale string, sender string, subject string, sent_at string",
    )
    row = extract_mail_fields(rows).first()
    assert (row.raw_headers, row.text_body, row.context.owned_domains) == ("H: 1", "Hi you", ["corp.es"])
    assert len(row.context.trusted_senders) == 4 and row.context.user_locale == "es-ES"
    short = extract_review_fields(rows).first()
    assert short.email_headers == "From: s@x.y\nSubject: Sub\nDate: Mon" and short.email_body.startswith("<p>")


def test_cases(spark, tmp_path):
    case = {"name": "n1", "classification": "phishing", "expected_score": 80, "request": {"raw_headers": "From: a@b.c", "raw_html": "", "text_body": "t"}}
    suite = {"phishing_examples": [case], "suspicious_examples": [], "legitimate_examples": [{**case, "name": "n2", "classification": "seguro"}]}
    (tmp_path / "cases.json").write_text(json.dumps(suite, indent=2))
    cases = read_cases(spark, str(tmp_path))
    assert {(r.category, r.name, r.expected_label) for r in cases.collect()} == {
        ("phishing_examples", "n1", "phishing"), ("legitimate_examples", "n2", "seguro")}
    assert classify(case_messages(cases)).count() == 2


def test_logs(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text(
        '{"ts": "2024-01-15T10:30:00Z", "level": "INFO", "event": "x", "status": 200, "duration_ms": 12}\n'
        'plain line\n{"ts": "2024-01-15T10:30:00Z", "status": "many"}\n{"level": "INFO", "path": "/no-time"}\n'
        '{"timestamp": "2024-01-15T10:31:00Z", "message": "HTTP request processed", "method": "POST", "path": "/classify",'
        ' "status_code": 200, "latency_ms": 1847.0, "request_id": "r", "within_slo": true}\n')
    rows, corrupt = split_logs(read_logs(spark, str(tmp_path)))
    row, service = rows.orderBy("ts").collect()
    assert corrupt.count() == 3 and row.duration_ms == 12 and row.ts.year == 2024
    assert (service.endpoint, service.status, service.duration_ms, service.event) == ("/classify", 200, 1847, "HTTP request processed")


def test_verdict_sink_round_trip(spark, messages, tmp_path):
    verdicts = classify(messages({"text": "hello there"}, {"text": "enter your password now"}))
    write_verdicts(verdicts, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.message_id, r.label) for r in back.collect()} == {(r.message_id, r.label) for r in verdicts.collect()}
    assert back.schema["evidence"].dataType["urls"] is not None


def test_attachment_hash(spark):
    files = spark.createDataFrame([(1, "f", "m", bytearray(b"abc"))], "message_id long, filename string, mime string, content binary")
    row = attachment_hash(files).first()
    assert (row.size, row.hash) == (3, "sha256:" + hashlib.sha256(b"abc").hexdigest())


def test_export_metrics(spark):
    logs = spark.createDataFrame(
        [("POST", "/classify", 200, "seguro", None, 40), ("POST", "/classify", 500, None, "internal_error", 3000), ("POST", "/classify", 200, "phishing", None, 5)],
        "method string, endpoint string, status int, classification string, error_type string, duration_ms long")
    got = {(r.metric, tuple(sorted(r.labels.items()))): r.value for r in export_metrics(logs).collect()}
    assert got[("requests_total", (("endpoint", "/classify"), ("method", "POST"), ("status", "200")))] == 2
    assert got[("errors_total", (("error_type", "internal_error"),))] == 1
    assert got[("request_duration_seconds_bucket", (("le", "0.005"),))] == 1
    assert got[("request_duration_seconds_bucket", (("le", "0.05"),))] == 2
    assert got[("request_duration_seconds_bucket", (("le", "+Inf"),))] == 3
    assert got[("request_duration_seconds_sum", ())] == 3.045
