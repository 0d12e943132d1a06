"""Fusion, fallback verdicts, safety policy and verdict texts."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailrisk import rules
from mailrisk.functions.common import contains_any, kept, let, shown, strings
from mailrisk.schemas import REVIEW


def total_score(header: Column, url: Column, text: Column, attachment: Column) -> Column:
    w = rules.WEIGHTS
    return (
        header * w["header"]
        + url * w["url"]
        + text * w["text"]
        + attachment * w["attachment"]
    )


def heuristic_summary(
    header: Column, url: Column, text: Column, attachment: Column,
    n_urls: Column, n_signals: Column,
) -> Column:
    """Readable score overview for a reviewer."""
    parts = kept(
        (header > 20, F.concat(F.lit("Headers: riesgo "), shown(header), F.lit("/100"))),
        (
            url > 20,
            F.concat(
                F.lit("URLs: "), n_urls, F.lit(" sospechosas, riesgo "), shown(url),
                F.lit("/100"),
            ),
        ),
        (
            text > 20,
            F.concat(
                F.lit("NLP: "), n_signals, F.lit(" señales, riesgo "), shown(text),
                F.lit("/100"),
            ),
        ),
        (
            attachment > 10,
            F.concat(F.lit("Adjuntos: riesgo "), shown(attachment), F.lit("/100")),
        ),
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise(
        rules.NO_SIGNALS_TEXT
    )


# --- fallback ----------------------------------------------------------------
def label_of_score(total: Column) -> Column:
    return (
        F.when(total >= rules.PHISHING_AT, "phishing")
        .when(total >= rules.SUSPICIOUS_AT, "sospechoso")
        .otherwise("seguro")
    )


def _by_label(label: Column, value) -> Column:
    first, second, default = rules.LABELS
    return F.when(label == first, value(first)).when(
        label == second, value(second)
    ).otherwise(value(default))


def fallback_verdict(total: Column) -> Column:
    """Verdict from the score alone; the score is cut, not rounded."""
    label = label_of_score(total)
    return F.struct(
        label.alias("label"),
        total.cast("int").alias("risk_score"),
        strings(rules.FALLBACK_REASONS).alias("top_reasons"),
        _by_label(label, lambda k: F.lit(rules.FALLBACK_TEXTS[k][0])).alias("summary"),
        _by_label(label, lambda k: strings(rules.FALLBACK_TEXTS[k][1])).alias("actions"),
    )


# --- review ------------------------------------------------------------------
def parse_review(response: Column) -> Column:
    """Reviewer text to a verdict struct; null when anything required is off."""
    first = F.instr(response, "{")
    last = F.length(response) - F.instr(F.reverse(response), "}") + 1
    body = F.when(
        (first > 0) & response.contains("}"),
        F.substring(response, first, last - first + 1),
    )
    return let(F.from_json(body, REVIEW), _checked_review)


def _checked_review(parsed: Column) -> Column:
    """The parsed answer as a verdict, or null."""
    evidence = parsed["evidence"]
    findings = evidence["header_findings"]
    summary = F.substring(parsed["non_technical_summary"], 1, 200)
    words = F.size(F.filter(F.split(summary, r"\s+"), lambda w: w != ""))
    auth = F.coalesce(findings["spf_dkim_dmarc"], F.lit("ok"))
    no_urls = F.array().cast(REVIEW["evidence"].dataType["url_findings"].dataType)
    urls = F.coalesce(evidence["url_findings"], no_urls)
    urls_ok = F.forall(
        urls,
        lambda u: u["url"].isNotNull()
        & u["reason"].isNotNull()
        & F.coalesce(u["risk_level"], F.lit("low")).isin("low", "medium", "high"),
    )
    valid = (
        parsed["classification"].isin(rules.LABELS)
        & parsed["risk_score"].between(0, 100)
        & parsed["top_reasons"].isNotNull()
        & parsed["recommended_actions"].isNotNull()
        & summary.isNotNull()
        & (words <= 60)
        & findings.isNotNull()
        & auth.isin("ok", "mismatch", "fail")
        & urls_ok
    )

    def flag(name):
        return F.coalesce(findings[name], F.lit(False))

    return F.when(
        valid,
        F.struct(
            parsed["classification"].alias("label"),
            parsed["risk_score"].cast("int").alias("risk_score"),
            F.slice(parsed["top_reasons"], 1, 3).alias("top_reasons"),
            summary.alias("summary"),
            F.slice(parsed["recommended_actions"], 1, 3).alias("actions"),
            F.struct(
                F.struct(
                    auth.alias("auth"),
                    flag("reply_to_mismatch").alias("reply_to_mismatch"),
                    flag("display_name_spoof").alias("display_name_spoof"),
                    flag("punycode_detected").alias("punycode"),
                    flag("suspicious_received").alias("suspicious_received"),
                ).alias("header"),
                F.transform(
                    urls,
                    lambda u: F.struct(
                        u["url"].alias("url"),
                        u["reason"].alias("reason"),
                        F.coalesce(u["risk_level"], F.lit("low")).alias("risk_level"),
                    ),
                ).alias("urls"),
                F.coalesce(evidence["nlp_signals"], strings([])).alias("signals"),
            ).alias("evidence"),
        ),
    )


# --- policy ------------------------------------------------------------------
def critical_signals(findings: Column, url_findings: Column, signals: Column) -> Column:
    texts = rules.CRITICAL_TEXTS
    return kept(
        (findings["auth"] == "fail", F.lit(texts["auth"])),
        (F.exists(url_findings, lambda f: f["risk_level"] == "high"), F.lit(texts["url"])),
        (signals["credential_request"], F.lit(texts["credential"])),
    )


def elevate(verdict: Column, critical: Column) -> Column:
    """Raise the label by one step when critical signals contradict it."""
    label, score, reasons = (verdict[f] for f in ("label", "risk_score", "top_reasons"))
    to_suspicious = (F.size(critical) > 0) & (label == "seguro")
    to_phishing = (F.size(critical) >= 2) & (label == "sospechoso")
    named = F.concat(
        F.lit(rules.CRITICAL_REASON_PREFIX), F.array_join(F.slice(critical, 1, 2), ", ")
    )
    return F.struct(
        F.when(to_suspicious, "sospechoso").when(to_phishing, "phishing").otherwise(label)
        .alias("label"),
        F.when(to_suspicious, F.greatest(score, F.lit(rules.ELEVATED_SUSPICIOUS_SCORE)))
        .when(to_phishing, F.greatest(score, F.lit(rules.ELEVATED_PHISHING_SCORE)))
        .otherwise(score).alias("risk_score"),
        F.when(to_suspicious, F.slice(F.concat(F.array(named), reasons), 1, 3))
        .otherwise(reasons).alias("top_reasons"),
        verdict["summary"].alias("summary"),
        verdict["actions"].alias("actions"),
    )


def score_label_consistency(verdict: Column) -> Column:
    """Make score and label agree; a safe label with a high score is raised."""
    label, score = verdict["label"], verdict["risk_score"]
    raised = (label == "seguro") & (score >= rules.SUSPICIOUS_AT)
    return F.struct(
        F.when(raised, "sospechoso").otherwise(label).alias("label"),
        F.when(label == "phishing", F.greatest(score, F.lit(rules.PHISHING_AT)))
        .when(label == "sospechoso", F.greatest(score, F.lit(rules.SUSPICIOUS_AT)))
        .otherwise(score).alias("risk_score"),
        verdict["top_reasons"].alias("top_reasons"),
        verdict["summary"].alias("summary"),
        verdict["actions"].alias("actions"),
    )


# --- four-class review -------------------------------------------------------
def _outcome(label, score, explanation, recommendations) -> Column:
    return F.struct(
        F.lit(label).alias("label"),
        F.lit(score).alias("risk_score"),
        F.lit(explanation).alias("explanation"),
        strings(recommendations).alias("recommendations"),
    )


def _ladder(conditions, default) -> Column:
    """First condition that holds picks its outcome."""
    return reduce(
        lambda rest, step: F.when(step[0], step[1]).otherwise(rest),
        reversed(conditions),
        default,
    )


def four_class_verdict(review: Column) -> Column:
    """Final marker of a mail review, else its wording, to one of four classes."""
    low = F.lower(review)

    def outcome(label, score, explanation):
        return _outcome(
            label, score, explanation, rules.VERDICT_RECOMMENDATIONS[(label, score)]
        )

    steps = [
        (low.contains(marker), outcome(*rest)) for marker, *rest in rules.VERDICT_MARKERS
    ] + [
        (contains_any(low, words), outcome(*rest))
        for words, *rest in rules.VERDICT_KEYWORDS
    ]
    return _ladder(steps, outcome(*rules.VERDICT_DEFAULT))


def file_class_verdict(review: Column) -> Column:
    """The same for reviews of mail files, with their own marker and wording."""
    low = F.lower(review)

    def outcome(label, score):
        return _outcome(
            label, score, rules.FILE_EXPLANATION, rules.FILE_RECOMMENDATIONS
        )

    steps = [
        (low.contains(marker), outcome(*rest)) for marker, *rest in rules.FILE_MARKERS
    ] + [
        (contains_any(low, words), outcome(*rest)) for words, *rest in rules.FILE_KEYWORDS
    ]
    return _ladder(steps, outcome(*rules.FILE_DEFAULT))


def canonical_label(label: Column) -> Column:
    low = F.lower(label)
    chosen = F.lit("suspicious")
    for synonym, canonical in rules.LABEL_SYNONYMS.items():
        chosen = F.when(low == synonym, canonical).otherwise(chosen)
    return chosen


def risk_band(score: Column) -> Column:
    steps = [(score <= top, F.lit(text)) for top, text in rules.RISK_BANDS]
    return _ladder(steps, F.lit(rules.RISK_BAND_TOP))


def evidence_text(findings: Column) -> Column:
    """Header findings as readable lines."""
    texts = rules.EVIDENCE_TEXTS
    lines = kept(
        (findings["auth"] != "ok", F.concat(F.lit(texts["auth"]), findings["auth"])),
        (findings["reply_to_mismatch"], F.lit(texts["reply_to"])),
        (findings["display_name_spoof"], F.lit(texts["spoof"])),
        (findings["punycode"], F.lit(texts["punycode"])),
        (findings["suspicious_received"], F.lit(texts["received"])),
    )
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(
        rules.NO_EVIDENCE_TEXT
    )


def url_lines(url_findings: Column) -> Column:
    return F.array_join(
        F.transform(
            url_findings, lambda f: F.concat(F.lit("• "), f["url"], F.lit(": "), f["reason"])
        ),
        "\n",
    )


def signal_lines(descriptions: Column) -> Column:
    return F.array_join(
        F.transform(descriptions, lambda s: F.concat(F.lit("• "), s)), "\n"
    )
