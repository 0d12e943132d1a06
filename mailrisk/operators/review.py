"""Requests to, and answers from, an external reviewer."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.functions.prep import truncate_fields
from mailrisk.functions.redact import safe_snippets
from mailrisk.functions.verdict import heuristic_summary

LATENCY_BUDGET_MS = 35000


def review_requests(scored: DataFrame) -> DataFrame:
    """One request per message: the cut fields and a prompt built from them.

    Takes the output of ``fuse.heuristics``; only masked text leaves.
    """
    context = F.col("context")
    fields = truncate_fields(
        F.col("redacted_headers"),
        F.col("redacted_text"),
        safe_snippets(F.col("text_body")),
        F.col("url_metadata"),
        context["owned_domains"],
    )
    summary = heuristic_summary(
        *[F.col(f"{c}_score") for c in ("header", "url", "text", "attachment")],
        F.size("url_findings"),
        F.size("descriptions"),
    )
    requests = scored.select(
        "message_id",
        *[column.alias(name) for name, column in fields.items()],
        summary.alias("heuristic_summary"),
        F.size("attachments").alias("n_attachments"),
        F.size(context["trusted_senders"]).alias("n_trusted"),
        context["user_locale"].alias("user_locale"),
        F.lit(LATENCY_BUDGET_MS).alias("latency_budget_ms"),
    )
    return requests.withColumn("prompt", prompt_text())


def prompt_text():
    """The request fields as one text with a heading per part."""

    def part(heading, value):
        return F.concat(F.lit(heading + "\n"), value)

    return F.concat_ws(
        "\n\n",
        F.lit("Decide whether this e-mail is phishing, sospechoso or seguro."),
        part("Headers (masked):", F.col("headers_raw")),
        part("Text:", F.col("text_body")),
        part("Notable passages:", F.to_json("html_snippets")),
        part("Links:", F.to_json("url_metadata")),
        part("Scores so far:", F.col("heuristic_summary")),
        part("Number of attachments:", F.col("n_attachments").cast("string")),
        part(
            "Recipient:",
            F.format_string(
                "domains %s, trusted senders %d, language %s",
                F.to_json("owned_domains"), F.col("n_trusted"), F.col("user_locale"),
            ),
        ),
        part("Time limit in ms:", F.col("latency_budget_ms").cast("string")),
        F.lit(
            "Answer with one JSON object holding classification, risk_score, "
            "top_reasons, non_technical_summary, recommended_actions and evidence."
        ),
    )


def score_with_reviewer(requests: DataFrame, fn, attempts: int = 3, batch_size: int = 32) -> DataFrame:
    """Call ``fn(list of prompts) -> list of texts`` on at most ``batch_size`` prompts at a time.

    A null answer, an error and a list of another length are failures.  What failed is asked
    again one by one, so a bad prompt costs only its own answer (null); no prompt is
    sent more than ``attempts`` times.
    """

    def ask(prompts):
        try:
            answers = list(fn(prompts))
        except Exception:  # any reviewer failure counts as no answer
            return [None] * len(prompts)
        return answers if len(answers) == len(prompts) else [None] * len(prompts)

    def review(batches):
        for batch in batches:
            prompts = batch["prompt"].tolist()
            answers = [None] * len(prompts)
            size = batch_size
            for _ in range(attempts):
                open_ = [i for i, answer in enumerate(answers) if answer is None]
                for at in range(0, len(open_), size):
                    places = open_[at : at + size]
                    for i, answer in zip(places, ask([prompts[i] for i in places])):
                        answers[i] = answer
                size = 1
            yield pd.DataFrame({"message_id": batch["message_id"], "response": answers})

    key_type = requests.schema["message_id"].dataType.simpleString()
    return requests.select("message_id", "prompt").mapInPandas(
        review, f"message_id {key_type}, response string"
    )
