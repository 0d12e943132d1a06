"""Inputs of a megabyte that make careless patterns overflow the stack or take quadratic time."""

import time

import pytest
from pyspark.sql import functions as F

from mailrisk.functions import headers as H
from mailrisk.functions import prep, redact, urls

MEGA = 1_000_000


def mega(piece, before="", after=""):
    return before + piece * (MEGA // len(piece)) + after


CASES = {
    "quoted name": (H.mailbox, mega("x", '"', '" <a@b.c>')),
    "open quote": (H.mailbox, mega('\\"', '"')),
    "open comments": (H.mailbox, mega("(")),
    "open routes": (H.mailbox, mega("<")),
    "dots behind an address": (redact.redact_emails, mega("a.", "x@y ")),
    "dots in an address": (redact.redact_emails, mega("a.", "x@y.")),
    "signs": (redact.redact_emails, mega("a@")),
    "digits": (redact.redact_phones, mega("5")),
    "card digits": (redact.redact_cards, mega("1234-")),
    "account words": (redact.redact_accounts, mega("account ")),
    "open scripts": (prep.html_to_text, mega("<script>")),
    "open styles": (prep.html_to_text, mega("<style>", "<script>a</script>")),
    "open tags": (prep.html_to_text, mega("<")),
    "open scripts before a link": (urls.html_links, mega("<script>", "", "<a href=http://a.b>")),
    "open comments before a link": (urls.html_links, mega("<!--", "", "<a href=http://a.b>")),
    "attributes": (urls.html_links, mega(" b=c", "<a", " href=http://a.b>")),
    "one long word": (urls.text_links, mega("a")),
    "links": (urls.text_links, mega("http://")),
    "references": (urls.html_links, mega("&amp;", '<a href="http://a.b/', '">')),
}


@pytest.mark.parametrize("name", CASES)
def test_a_megabyte_takes_seconds(spark, name):
    function, text = CASES[name]
    rows = spark.createDataFrame([(text,)], "v string").select(function(F.col("v")).alias("r"))
    begin = time.perf_counter()
    rows.select(F.length(F.to_json(F.struct("r"))).alias("n")).collect()
    assert time.perf_counter() - begin < 20
