"""Spark-native e-mail threat scoring: mail in, verdicts and reports out."""
