import email
import email.utils
import random

import pytest
from pyspark.sql import functions as F

from mailrisk.functions import headers as H


def findings(values, *raw):
    return values(H.header_findings, list(raw))


def test_authentication_pass_and_fail(values):
    ok, bad = findings(
        values,
        "Authentication-Results: mx;\n    dmarc=pass;\n    spf=pass;\n    dkim=pass\nFrom: PayPal <s@paypal.com>",
        "Authentication-Results: mx;\n    dmarc=fail (p=reject);\n    spf=fail;\n    dkim=fail\nFrom: X <s@y.com>",
    )
    assert (ok.auth, ok.reply_to_mismatch, ok.display_name_spoof) == ("ok", False, False)
    assert bad.auth == "fail"


def test_reply_to(values):
    rows = findings(
        values,
        "From: Bank Support <a@legitimate.com>\nReply-To: b@other.com\nTo: c@d.com",
        "From: a@one.com\nReply-To: b@one.com",
        "From: a@one.com\nReply-To: A@ONE.com",
        "From: a@one.com",
        "From: a@one.com, b@two.com\nReply-To: c@three.com",
    )
    assert [r.reply_to_mismatch for r in rows] == [True, False, False, False, False]


def test_display_name(values):
    rows = findings(
        values,
        "From: PayPal Security <n@suspicious.com>",
        "From: PayPal <service@paypal.com>",
        "From: PayPal <service@notpaypal.com>",
        "From: Netflix <info@netflix.com>",
        "From: paypal@evil.com",
        "From: evil@evil.com (Amazon)",
        "From: Someone <paypal@evil.com>",
    )
    assert [r.display_name_spoof for r in rows] == [True, False, False, True, False, True, False]


def test_punycode_and_routing(values):
    puny, hops, calm, none = findings(
        values,
        "From: Apple <support@xn--apple-fake.com>",
        "Received: from odd.tk ([127.0.0.1])\n    by mx.example.com; Mon\n"
        "Received: from localhost ([192.168.1.1])\n    by odd.tk; Mon\nFrom: S <s@example.com>",
        "Received: from a by mx.example.com for b@example.com\nFrom: S <s@example.com>",
        "",
    )
    assert puny.punycode and hops.suspicious_received
    assert not calm.suspicious_received and not none.suspicious_received


def test_malformed_and_empty_are_neutral(values):
    for row in findings(values, "Invalid header format", ""):
        assert row.asDict() == {
            "auth": "ok", "reply_to_mismatch": False, "display_name_spoof": False,
            "punycode": False, "suspicious_received": False,
        }


def test_spf_order_and_fallback(values):
    raw = [
        "Authentication-Results: spf=softfail", "Authentication-Results: spf=neutral",
        "Received-SPF: Softfail (x)", "Received-SPF: Pass", "From: a@b.c",
        "Authentication-Results: spf=fail; dkim=pass",
    ]
    got = values(lambda c: H.header_details(H.header_fields(c))["spf"], raw)
    assert got == ["softfail", "neutral", "fail", "pass", "none", "fail"]
    assert [r.auth for r in findings(values, *raw)] == ["ok", "ok", "mismatch", "ok", "ok", "mismatch"]


def test_dkim_and_dmarc_details(values):
    rows = values(
        lambda c: H.header_details(H.header_fields(c)),
        [
            "DKIM-Signature: v=1; d=corp.com; s=k\nAuthentication-Results: dkim=pass; dmarc=pass",
            "DKIM-Signature: v=1; d=corp.com",
            "Authentication-Results: dmarc=fail x policy.quarantine; spf=pass",
        ],
    )
    assert [(r.dkim.status, r.dkim.domain) for r in rows] == [
        ("pass", "corp.com"), ("neutral", None), ("none", None)
    ]
    assert [(r.dmarc.status, r.dmarc.policy) for r in rows] == [
        ("pass", None), ("none", None), ("fail", "quarantine")
    ]


def test_score_bounds(values):
    shape = "struct<auth:string,reply_to_mismatch:boolean,display_name_spoof:boolean,punycode:boolean,suspicious_received:boolean>"
    inputs = [("fail", True, True, True, True), ("mismatch", False, False, False, False), ("ok",) + (False,) * 4]
    assert values(H.header_score, inputs, shape) == [100.0, 20.0, 0.0]


def test_brand_domains(values):
    def check(pattern):
        return lambda c: H.brand_domain_ok(pattern, c)

    assert values(check("paypal"), ["paypal.com", "payp4l.com"]) == [True, False]
    assert values(check("amazon"), ["amazon.es", "amazon-security.tk"]) == [True, False]
    assert values(check("google"), ["gmail.com", "g00gle.com"]) == [True, False]
    assert values(check("netflix"), ["netflix.com"]) == [False]


def random_header(rng):
    names = ["From", "from", "Reply-To", "Received", "Received", "Subject", "X-Y", "DKIM-Signature"]
    bodies = ["a@b.com", "Pay Pal <x@y.org>", "", "from h by k for z", "  two  spaces", "a:b;c=d"]
    lines = []
    for _ in range(rng.randint(0, 7)):
        lines.append(f"{rng.choice(names)}:{rng.choice(['', ' ', '  '])}{rng.choice(bodies)}")
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            lines.append(rng.choice([" ", "\t", "    "]) + rng.choice(["more", "d=x; e", "for all"]))
    if rng.random() < 0.3:
        lines.insert(rng.randint(0, len(lines)), rng.choice(["", "no header here", "Bad name: x"]))
    return rng.choice(["\n", "\r\n"]).join(lines)


def test_headers_equal_the_standard_parser(values):
    rng = random.Random(7)
    raws = [random_header(rng) for _ in range(300)]
    parsed = values(H.parse_headers, raws)
    fields = values(H.header_fields, raws)

    def plain(value):
        return value.replace("\r\n", "\n").lstrip(" \t\n")

    for raw, mine, field in zip(raws, parsed, fields):
        message = email.message_from_string(raw)
        expected = {}
        for name, value in message.items():
            expected.setdefault(name.lower(), []).append(plain(value))
        assert {k: [plain(v) for v in vs] for k, vs in mine.items()} == expected, raw
        assert plain(field.from_field) == plain(message.get("From", "")), raw
        assert [plain(v) for v in field.received] == [
            plain(v) for v in message.get_all("Received", [])
        ], raw


@pytest.mark.parametrize(
    "field",
    [
        "a@b.com", "<a@b.com>", "Bob <a@b.com>", '"Doe, Bob" <a@b.com>', "Doe, Bob <a@b.com>",
        "a@b.com (Bob S)", "Bob   S <a@b.com>", '"Bob" <a@b.com>', "", "a@b.com, c@d.com",
        '"A \\"B\\" C" <a@b.com>', "Bob Smith <a@b.com> ", "José Núñez <j@b.com>",
    ],
)
def test_mailbox_equals_the_standard_parser(values, field):
    row = values(H.mailbox, [field])[0]
    assert (row.name, row.address) == email.utils.parseaddr(field)


def test_hops_table(spark, messages):
    from mailrisk.operators.tables import received_hops

    rows = received_hops(
        messages({"headers": "Received: from x.tk (10.0.0.1)\nReceived: from a by b for c"})
    ).orderBy("hop").collect()
    assert [r.anomalies for r in rows] == [
        ["Suspicious TLD: .tk", "Private IP in routing", "Malformed received header"], [],
    ]


def test_brand_table_join_equals_literal_rules(spark, messages):
    from mailrisk.operators.tables import BRAND_ROWS, sender_brands

    mail = messages(
        {"headers": "From: a <a@mail.paypal.com>"}, {"headers": "From: a <a@notpaypal.com>"},
        {"headers": "From: a <a@evil.org>"}, {"headers": "From: b <b@gmail.com>"},
    )
    brands = spark.createDataFrame(BRAND_ROWS, "brand string, domain string")
    literal = sender_brands(mail).filter("legitimate")
    joined = sender_brands(mail, brands)
    key = ["domain", "brand"]
    assert sorted(map(tuple, literal.select(*key).collect())) == sorted(
        map(tuple, joined.select(*key).collect())
    )
    assert literal.filter(F.col("brand") == "paypal").count() == 2
