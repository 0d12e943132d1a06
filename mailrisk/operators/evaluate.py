"""Comparison of verdicts with labelled cases."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrisk.functions.verdict import label_of_score

LATENCY_NOTE_MS = 3000
PASS_RATE_PCT = 80.0
FALSE_POSITIVE_PCT = 2.0
FALSE_NEGATIVE_PCT = 0.5


def case_result(expected: DataFrame, actual: DataFrame, tol: int = 20) -> DataFrame:
    """Join cases to verdicts by name: label equal and score near enough passes.

    ``expected``: ``name, category, expected_label, expected_score``;
    ``actual``: ``name, label, risk_score, latency_ms``.  A missing verdict fails.
    """
    label_ok = F.coalesce(F.col("label") == F.col("expected_label"), F.lit(False))
    difference = F.abs(F.col("risk_score") - F.col("expected_score"))
    score_ok = F.coalesce(difference <= tol, F.lit(False))
    return expected.join(actual, "name", "left").select(
        "name",
        "category",
        "expected_label",
        "label",
        difference.alias("score_diff"),
        label_ok.alias("label_ok"),
        score_ok.alias("score_ok"),
        (label_ok & score_ok).alias("passed"),
        F.coalesce(F.col("latency_ms") <= LATENCY_NOTE_MS, F.lit(False)).alias("latency_ok"),
    )


def category_pass_rate(results: DataFrame) -> DataFrame:
    """Totals per category and, as ``all``, overall."""
    rate = F.col("n_passed") / F.col("n_cases") * 100
    return (
        results.rollup("category")
        .agg(
            F.grouping("category").alias("overall"),
            F.count("*").alias("n_cases"),
            F.count_if("passed").alias("n_passed"),
        )
        .select(
            F.when(F.col("overall") == 1, "all").otherwise(F.col("category")).alias("category"),
            "n_cases",
            "n_passed",
            rate.alias("pass_pct"),
            (rate >= PASS_RATE_PCT).alias("suite_ok"),
        )
    )


def confusion_matrix(judged: DataFrame) -> DataFrame:
    """Expected label by given label."""
    return judged.groupBy("expected_label").agg(
        *[
            F.count_if(F.col("label") == name).alias(name)
            for name in ("phishing", "sospechoso", "seguro")
        ]
    )


def quality_rates(judged: DataFrame) -> DataFrame:
    """False-positive and false-negative shares against their targets."""
    bad, flagged = F.col("expected_label") == "phishing", F.col("label") == "phishing"
    counts = judged.agg(
        F.count_if(bad).alias("n_bad"),
        F.count_if(~bad).alias("n_good"),
        F.count_if(~bad & flagged).alias("n_fp"),
        F.count_if(bad & ~flagged).alias("n_fn"),
    )
    fp = F.when(F.col("n_good") > 0, F.col("n_fp") / F.col("n_good") * 100)
    fn = F.when(F.col("n_bad") > 0, F.col("n_fn") / F.col("n_bad") * 100)
    return counts.select(
        "*",
        fp.alias("fp_pct"),
        fn.alias("fn_pct"),
        (fp <= FALSE_POSITIVE_PCT).alias("fp_ok"),
        (fn <= FALSE_NEGATIVE_PCT).alias("fn_ok"),
    )


def threshold_table(scored: DataFrame, score: str = "total_score") -> DataFrame:
    """How many messages each whole score gives which label."""
    return (
        scored.groupBy(F.floor(score).cast("int").alias("score"))
        .agg(F.count("*").alias("n_messages"))
        .withColumn("label", label_of_score(F.col("score")))
    )


def threshold_sweep(judged: DataFrame, step: int = 5, score: str = "total_score") -> DataFrame:
    """Hits and misses of every phishing cut from 0 to 100.

    Rows are first counted per whole score, so only about a hundred rows meet the
    cuts.
    """
    bad = F.col("expected_label") == "phishing"
    counted = judged.groupBy(F.floor(score).cast("int").alias("score")).agg(
        F.count_if(bad).alias("n_bad"), F.count_if(~bad).alias("n_good")
    )
    cuts = F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(step))).alias("cut")
    flagged = F.col("score") >= F.col("cut")
    return (
        counted.select("*", cuts)
        .groupBy("cut")
        .agg(
            F.sum(F.when(flagged, F.col("n_bad")).otherwise(0)).alias("true_positive"),
            F.sum(F.when(flagged, F.col("n_good")).otherwise(0)).alias("false_positive"),
            F.sum(F.when(flagged, 0).otherwise(F.col("n_bad"))).alias("false_negative"),
            F.sum(F.when(flagged, 0).otherwise(F.col("n_good"))).alias("true_negative"),
        )
    )
