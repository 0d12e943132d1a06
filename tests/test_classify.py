import pandas as pd
import json

import pytest
from pyspark.sql import functions as F

from mailrisk import rules
from mailrisk.functions import verdict as V
from mailrisk.functions.attachments import attachment_score
from mailrisk.operators.fuse import error_verdict, heuristics
from mailrisk.operators.review import review_requests, score_with_reviewer
from mailrisk.operators.validate import check_verdict, fill_defaults, require_content
from mailrisk.plans.classify import classify
from mailrisk.plans.views import mail_view

from conftest import SF

LOOKALIKE = {
    "headers": "From: PayPal Security <security@payp4l-secure.com>\nTo: user@example.com\n"
    "Authentication-Results: mx; dmarc=fail; spf=fail; dkim=fail",
    "html": "<p><a href='http://payp4l-secure.com/verify-account'>verify</a></p>",
    "text": "PayPal notice\n\nYour account has been suspended.\n\nPlease verify your account within 24 hours."
    "\n\nClick here: http://payp4l-secure.com/verify-account",
}
HARVEST = {
    "headers": "From: Banco Santander <avisos@santander-seguridad.tk>\nReply-To: soporte@malicious-site.com",
    "html": "<a href='https://santander-actualizacion.tk/login'>Portal</a>",
    "text": "Estimado cliente, ingrese la clave aquí: https://santander-actualizacion.tk/login\n\nPara la"
    " factura tiene 2 horas. Banco Santander",
    "attachments": [("form.exe", "application/x-executable", 2048000, "h")],
}
CALM = {
    "headers": "From: PayPal <service@paypal.com>\nAuthentication-Results: mx; dmarc=pass; spf=pass; dkim=pass",
    "text": "Hello, the transaction went well. PayPal Team",
}
FILES = {
    "headers": "From: IT <it@company-update.com>",
    "text": "Please see the attached notes.",
    "attachments": [("update.exe", "application/x-executable", 2048576, "h"), ("run.bat", "application/x-bat", 1024, "h")],
}


def test_golden_messages(messages):
    rows = classify(messages(LOOKALIKE, HARVEST, CALM, FILES)).orderBy("message_id").collect()
    look, harvest, calm, files = rows
    h = look.heuristics
    assert (h.header_score, h.url_score, h.text_score, h.total_score) == (60.0, 40.0, 49.75, 46.4375)
    assert h.critical == ["DMARC failure", "Credential request"]
    assert (look.label, look.risk_score) == ("phishing", 65)
    h = harvest.heuristics
    assert (h.header_score, h.url_score, h.attachment_score) == (40.0, 0.0, 40.0)
    assert (harvest.label, harvest.risk_score) == ("sospechoso", 45)
    assert harvest.top_reasons == ["Señales críticas: Credential request", *rules.FALLBACK_REASONS[:2]]
    assert (calm.label, calm.heuristics.header_score) == ("seguro", 0.0)
    assert (files.heuristics.attachment_score, files.heuristics.total_score) == (80.0, 4.0)
    assert files.label == "seguro" and files.risk_score == 4


def test_verdicts_keep_their_limits(spark):
    verdicts = classify(mail_view(spark, SF))
    checked = check_verdict(verdicts)
    assert checked.filter(~F.col("valid")).count() == 0
    wrong = verdicts.filter(
        "(label = 'phishing' and risk_score < 60) or (label = 'sospechoso' and risk_score < 40)"
        " or (label = 'seguro' and risk_score >= 40)"
    )
    assert wrong.count() == 0 and verdicts.count() == 175


def test_plan_is_one_narrow_stage(spark):
    plan = classify(mail_view(spark, SF).coalesce(8))._jdf.queryExecution().executedPlan().toString()
    after_input = plan.split("Coalesce")[0]
    for operator in ("Exchange", "Join", "Aggregate", "Python"):
        assert operator not in after_input


def test_filters_do_not_repeat_the_scoring(spark):
    filtered = classify(mail_view(spark, SF)).filter("label = 'phishing' and heuristics.url_score > 10")
    plan = filtered._jdf.queryExecution().executedPlan().toString()
    assert plan.count("^Received-SPF:") == 1 and filtered.count() > 0


def test_repartitioning_changes_nothing(spark):
    mail = mail_view(spark, SF)
    columns = ["message_id", "label", "risk_score", F.to_json("heuristics").alias("h")]
    one = classify(mail.coalesce(1)).select(*columns)
    many = classify(mail.repartition(7, "lang")).select(*columns)
    assert one.exceptAll(many).count() == 0 and one.count() == many.count()


def test_intel_form_equals_narrow_form_without_facts(spark):
    mail = mail_view(spark, SF)
    intel = spark.createDataFrame(
        [], "domain string, registered_on date, redirects int, final_url string, status int, blacklisted boolean"
    )
    columns = ["message_id", "label", "risk_score", F.to_json("heuristics").alias("h")]
    narrow = classify(mail).select(*columns)
    joined = classify(mail, intel=intel, as_of="2024-02-01").select(*columns)
    assert narrow.exceptAll(joined).count() == 0 and joined.count() == narrow.count()


def test_empty_messages_are_rejected(messages):
    accepted, rejected = require_content(fill_defaults(messages({}, {"text": "x"}, {"html": None, "headers": None, "text": None})))
    assert accepted.count() == 1
    assert [r.reason for r in rejected.collect()] == ["invalid_request"] * 2
    row = error_verdict(rejected).first()
    assert (row.label, row.risk_score, row.evidence.signals) == ("sospechoso", 50, ["Error de sistema"])


def test_attachment_rules(values):
    shape = "array<struct<filename:string,mime:string,size:bigint,hash:string>>"
    inputs = [
        [], [("a.ZIP", "application/zip", 10, "")], [("a.txt", "application/x-sh", 0, "")],
        [("a.com", "text/plain", 52428801, "")], [("a", "b", 52428800, "")], [("x.exe", "application/x-executable", 1, "")] * 3,
    ]
    assert values(attachment_score, inputs, shape) == [0.0, 25.0, 25.0, 30.0, 0.0, 100.0]


@pytest.mark.parametrize("score, label", [
    (95, "phishing"), (65, "phishing"), (60, "phishing"), (59.99, "sospechoso"), (55, "sospechoso"), (45, "sospechoso"),
    (40, "sospechoso"), (39.9, "seguro"), (35, "seguro"), (15, "seguro"), (0, "seguro"),
])
def test_thresholds(values, score, label):
    row = values(V.fallback_verdict, [float(score)], "double")[0]
    assert (row.label, row.risk_score) == (label, int(score)) and len(row.top_reasons) == 3


def review(**changes):
    answer = {
        "classification": "phishing", "risk_score": 95, "top_reasons": ["a", "b", "c", "d"],
        "non_technical_summary": "s" * 250, "recommended_actions": ["x"],
        "evidence": {"header_findings": {"spf_dkim_dmarc": "fail", "punycode_detected": True}, "nlp_signals": ["n"],
                     "url_findings": [{"url": "u", "reason": "r"}]},
    }
    answer.update(changes)
    return json.dumps({k: v for k, v in answer.items() if v is not None})


def test_parse_review(values):
    good = values(V.parse_review, ["Sure:\n" + review() + "\nBye", "{" + review()[1:]])
    for row in good:
        assert (row.label, row.risk_score, row.top_reasons, len(row.summary)) == ("phishing", 95, ["a", "b", "c"], 200)
        assert row.evidence.header.punycode and row.evidence.urls[0].risk_level == "low"


def test_parse_review_refuses(values):
    bad = [
        "no json", "", "}{", "{not json}", review(classification="spam"), review(risk_score=101), review(risk_score=-1),
        review(risk_score=60.0), review(risk_score="60"), review(top_reasons=None), review(evidence=None),
        review(recommended_actions=None), review(non_technical_summary="w " * 61), review(classification=None),
        review(evidence={"url_findings": []}), review(evidence={"header_findings": {"spf_dkim_dmarc": "odd"}}),
        review(evidence={"header_findings": {}, "url_findings": [{"url": "u"}]}),
        review(evidence={"header_findings": {}, "url_findings": [{"url": "u", "reason": "r", "risk_level": "huge"}]}),
    ]
    assert values(V.parse_review, bad) == [None] * len(bad)


def test_reviews_and_elevation(spark, messages):
    reviews = spark.createDataFrame(
        [(0, review(classification="seguro", risk_score=30)), (2, "broken"), (2, review(classification="sospechoso", risk_score=20))],
        "message_id long, response string",
    )
    look, harvest, calm = classify(messages(LOOKALIKE, HARVEST, CALM), reviews).orderBy("message_id").collect()
    # one step only, the reason goes first and the list stays at three
    assert (look.label, look.risk_score) == ("sospechoso", 45)
    assert look.top_reasons == ["Señales críticas: DMARC failure, Credential request", "a", "b"]
    assert harvest.label == "sospechoso" and calm.label == "sospechoso" and calm.risk_score == 40
    assert look.evidence.header.auth == "fail"


def test_safe_with_high_score_is_raised(spark, messages):
    reviews = spark.createDataFrame([(0, review(classification="seguro", risk_score=70))], "message_id long, response string")
    row = classify(messages(CALM), reviews).first()
    assert (row.label, row.risk_score) == ("sospechoso", 70)


def test_review_requests(messages):
    mail = fill_defaults(messages({**LOOKALIKE, "text": LOOKALIKE["text"] + " call 555-123-4567 " + "z" * 3000}))
    row = review_requests(heuristics(mail)).first()
    assert len(row.text_body) == 2000 and "555******567" not in row.headers_raw
    assert "555-123-4567" not in row.prompt and row.user_locale == "es-ES"
    assert row.heuristic_summary.startswith("Headers: riesgo 60/100; URLs: 2 sospechosas, riesgo 40/100; NLP: ")


def test_reviewer_is_retried_and_bad_prompts_cost_only_themselves(spark):
    rows = spark.createDataFrame([(i, "bad" if i == 3 else f"p{i}") for i in range(6)], "message_id long, prompt string")

    def flaky(prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return [p.upper() for p in prompts]

    calls = []

    def counted(prompts):
        calls.extend(prompts)
        return flaky(prompts)

    from mailrisk.operators import review

    got = {r.message_id: r.response for r in score_with_reviewer(rows.coalesce(1), flaky).collect()}
    frame = pd.DataFrame({"message_id": range(6), "prompt": ["bad" if i == 3 else f"p{i}" for i in range(6)]})

    class Requests:
        schema = rows.schema

        def select(self, *_):
            return self

        def mapInPandas(self, function, _):
            return list(function([frame]))

    answers = review.score_with_reviewer(Requests(), counted, batch_size=4)[0].response.tolist()
    assert answers == ["P0", "P1", "P2", None, "P4", "P5"]
    assert {p: calls.count(p) for p in calls} == {"p0": 2, "p1": 2, "p2": 2, "bad": 3, "p4": 1, "p5": 1}
    assert got == {0: "P0", 1: "P1", 2: "P2", 3: None, 4: "P4", 5: "P5"}


def test_four_classes(values):
    texts = ["... VEREDICTO: PHISHING", "veredicto: spam ... fraude", "Veredicto: seguro", "parece una estafa", "una oferta",
             "hay que verificar", "todo bien"]
    got = values(V.four_class_verdict, texts)
    assert [(r.label, r.risk_score) for r in got] == [
        ("phishing", 85), ("spam", 35), ("safe", 15), ("phishing", 80), ("spam", 30), ("suspicious", 55), ("safe", 20)]
    assert all(len(r.recommendations) == 3 for r in got)


def test_file_classes(values):
    texts = ["Clasificación final: MALICIOSO", "clasificación final: seguro", "esto es malicioso", "presenta riesgos",
             "no presenta riesgos", "es legítimo", "?"]
    assert [(r.label, r.risk_score) for r in values(V.file_class_verdict, texts)] == [
        ("phishing", 85), ("safe", 15), ("phishing", 80), ("suspicious", 55), ("suspicious", 55), ("safe", 20), ("suspicious", 50)]


def test_labels_and_bands(values):
    assert values(V.canonical_label, ["Malicious", "SOSPECHOSO", "spam", "Seguro", "else", "phishing"]) == [
        "phishing", "suspicious", "spam", "safe", "suspicious", "phishing"]
    assert [b.split(" -")[0] for b in values(V.risk_band, [0, 30, 31, 60, 61], "int")] == [
        "Riesgo bajo", "Riesgo bajo", "Riesgo medio", "Riesgo medio", "Riesgo alto"]


def test_evidence_text(messages):
    rows = classify(messages(LOOKALIKE, CALM)).orderBy("message_id").select(
        V.evidence_text(F.col("heuristics.findings")).alias("e"), V.url_lines(F.col("heuristics.url_findings")).alias("u")).collect()
    assert rows[0].e == "SPF/DKIM/DMARC: fail\nPosible suplantación en nombre mostrado"
    assert rows[0].u.startswith("• http://payp4l-secure.com/verify-account: ") and rows[1].e == "Sin problemas detectados"
