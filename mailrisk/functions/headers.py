"""Header analysis on one header block per row, without a shuffle."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailrisk import rules
from mailrisk.functions.common import any_of, kept, let, strings
from mailrisk.functions.regex import SPACE, jvm_regex

# A fold (newline followed by a blank) is kept as this mark while headers are cut
# out, so that a value is a plain run of characters for the regex engine.
_FOLD = "\x1e"
_HEADER_LINE = r"(?:From |[!-9;-~]*:|[ \t])"
PRIVATE_IP = jvm_regex(rules.PRIVATE_IP_PATTERN, first="1")


def header_block(raw: Column) -> Column:
    """Everything before the first line that cannot be a header, folds marked."""
    text = raw
    for newline in ("\r\n", "\r"):
        text = F.replace(text, F.lit(newline), F.lit("\n"))
    block = F.regexp_replace(text, rf"(?dms)^(?!{_HEADER_LINE}).*", "")
    for blank in (" ", "\t"):
        block = F.replace(block, F.lit("\n" + blank), F.lit(_FOLD + blank))
    return block


def _unfold(value: Column) -> Column:
    return F.translate(value, _FOLD, "\n")


def _value_pattern(name: str) -> str:
    return rf"(?idm)^{name}:[ \t]*([^\n]*)"


def header_value(block: Column, name: str) -> Column:
    """First value of a header in a ``header_block``; empty when absent."""
    return _unfold(F.regexp_extract(block, _value_pattern(name), 1))


def header_values(block: Column, name: str) -> Column:
    found = F.regexp_extract_all(block, F.lit(_value_pattern(name)), F.lit(1))
    return F.transform(found, _unfold)


def parse_headers(raw: Column) -> Column:
    """``map<lower-case name, values in order>`` of a raw header text."""

    def name_of(line):
        return F.lower(F.substring_index(line, ":", 1))

    def value_of(line):
        rest = F.substring(line, F.length(F.substring_index(line, ":", 1)) + 2, F.length(line))
        return _unfold(F.regexp_replace(rest, r"\A[ \t]+", ""))

    lines = F.filter(
        F.split(header_block(raw), "\n"),
        lambda line: line.rlike(r"\A[!-9;-~]+:"),
    )
    return let(
        lines,
        lambda ls: let(
            F.array_distinct(F.transform(ls, name_of)),
            lambda names: F.map_from_arrays(
                names,
                F.transform(
                    names,
                    lambda n: F.transform(
                        F.filter(ls, lambda line: name_of(line) == n), value_of
                    ),
                ),
            ),
        ),
    )


# --- addresses ---------------------------------------------------------------
# What is opened and never closed reaches to the end, so every opening is scanned once.
_QUOTED = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)'
_COMMENT = r"\([^)]*+(?:\)|\z)"


def mailbox(field: Column) -> Column:
    """``struct<name, address>`` of a From-like field; both empty for lists.

    The name is the text before ``<…>`` without quotes, or a parenthesised
    comment after a bare address; bare words are no usable name.
    """
    bare = F.regexp_replace(field, _QUOTED, "")
    several = F.regexp_replace(bare, rf"{_COMMENT}|<[^>]*+(?:>|\z)", "").contains(",")
    angled = bare.rlike("<[^<>]*>")
    inner = F.regexp_extract(field, r"<([^<>]*)>[^<>]*\z", 1)
    before = F.trim(F.regexp_extract(field, r"\A((?s:.*?))<[^<>]*>[^<>]*\z", 1))
    comment = F.regexp_extract(field, r"\(([^)]*+)(?:\)|\z)", 1)
    spoken = F.regexp_replace(
        F.regexp_replace(before, r'\\(.)|"', "$1"), rf"[{SPACE}]+", " "
    )
    lone = F.regexp_extract(
        F.regexp_replace(field, _COMMENT, " "), rf"([^{SPACE}]*@[^{SPACE}]*|[^{SPACE}]+)", 1
    )
    name = F.when(angled, F.trim(spoken)).otherwise(comment)
    address = F.when(angled, F.regexp_replace(inner, rf"[{SPACE}]+", "")).otherwise(lone)
    empty = F.lit("")
    return F.struct(
        F.when(several, empty).otherwise(name).alias("name"),
        F.when(several, empty).otherwise(address).alias("address"),
    )


def domain_of(address: Column) -> Column:
    """Text after the last ``@``; empty without one."""
    return F.when(address.contains("@"), F.substring_index(address, "@", -1)).otherwise("")


# --- authentication ----------------------------------------------------------
def spf_status(auth_results: Column, received_spf: Column) -> Column:
    auth, spf = F.lower(auth_results), F.lower(received_spf)
    return (
        F.when(auth.contains("spf=pass"), "pass")
        .when(auth.contains("spf=fail"), "fail")
        .when(auth.contains("spf=softfail"), "softfail")
        .when(auth.contains("spf=neutral"), "neutral")
        .when(spf.contains("pass"), "pass")
        .when(spf.contains("fail"), "fail")
        .otherwise("none")
    )


def _present(value: Column) -> Column:
    return F.when(value != "", value)


def dkim_status(auth_results: Column, signature: Column) -> Column:
    auth = F.lower(auth_results)
    passed = auth.contains("dkim=pass")
    status = (
        F.when(passed, "pass")
        .when(auth.contains("dkim=fail"), "fail")
        .when(signature != "", "neutral")
        .otherwise("none")
    )
    domain = F.when(passed, _present(F.regexp_extract(signature, "d=([^;]+)", 1)))
    return F.struct(status.alias("status"), domain.alias("domain"))


def dmarc_status(auth_results: Column) -> Column:
    auth = F.lower(auth_results)
    passed, failed = auth.contains("dmarc=pass"), auth.contains("dmarc=fail")
    policy = F.regexp_extract(auth, r"dmarc=fail[^;]*policy\.([^;]+)", 1)
    return F.struct(
        F.when(passed, "pass").when(failed, "fail").otherwise("none").alias("status"),
        F.when(~passed & failed, _present(policy)).alias("policy"),
    )


def auth_status(spf: Column, dkim: Column, dmarc: Column) -> Column:
    return (
        F.when(dmarc == "fail", "fail")
        .when((spf == "fail") & (dkim == "fail"), "fail")
        .when(spf.isin("pass", "neutral") & (dkim == "pass"), "ok")
        .when((spf == "fail") | (dkim == "fail"), "mismatch")
        .otherwise("ok")
    )


# --- sender checks -----------------------------------------------------------
def reply_to_mismatch(from_address: Column, reply_address: Column) -> Column:
    sender, reply = F.lower(from_address), F.lower(reply_address)
    return (
        (sender != "")
        & (reply != "")
        & (sender != reply)
        & (domain_of(sender) != domain_of(reply))
    )


def brand_domain_ok(brand_pattern: str, domain: Column) -> Column:
    """Does ``domain`` end with a domain of the brand named in the pattern?"""
    for brand, domains in rules.BRAND_DOMAINS.items():
        if brand in brand_pattern:
            return any_of(domain.endswith(d) for d in domains)
    return F.lit(False)


def display_name_spoof(name: Column, address: Column) -> Column:
    shown = F.lower(name)
    domain = F.lower(F.substring_index(address, "@", -1))
    return (address != "") & any_of(
        shown.rlike(p) & ~brand_domain_ok(p, domain)
        for p in rules.DISPLAY_BRAND_PATTERNS
    )


def punycode(from_field: Column, reply_field: Column) -> Column:
    return F.lower(from_field).contains("xn--") | F.lower(reply_field).contains("xn--")


# --- routing -----------------------------------------------------------------
def hop_anomalies(hop: Column) -> Column:
    """Readable anomalies of one Received value, in check order."""
    low = F.lower(hop)
    return kept(
        *[(low.contains(tld), F.lit(f"Suspicious TLD: {tld}")) for tld in rules.HOP_TLDS],
        (hop.rlike(PRIVATE_IP), F.lit("Private IP in routing")),
        (~low.rlike(r"by [^\n]+ for [^\n]+"), F.lit("Malformed received header")),
    )


def received_anomalies(hops: Column) -> Column:
    """All anomalies of a message; two or more make its routing suspicious."""
    return F.flatten(F.transform(hops, hop_anomalies))


# --- summary -----------------------------------------------------------------
def header_fields(raw: Column) -> Column:
    """The header values the checks need, cut out of the block once."""
    return let(
        header_block(raw),
        lambda b: F.struct(
            header_value(b, "Authentication-Results").alias("auth_results"),
            header_value(b, "Received-SPF").alias("received_spf"),
            header_value(b, "DKIM-Signature").alias("dkim_signature"),
            header_value(b, "From").alias("from_field"),
            header_value(b, "Reply-To").alias("reply_field"),
            header_values(b, "Received").alias("received"),
        ),
    )


def header_details(fields: Column) -> Column:
    """Parsed parts of ``header_fields``: mailboxes, authentication, anomalies."""
    auth = fields["auth_results"]
    return F.struct(
        mailbox(fields["from_field"]).alias("sender"),
        mailbox(fields["reply_field"]).alias("reply"),
        spf_status(auth, fields["received_spf"]).alias("spf"),
        dkim_status(auth, fields["dkim_signature"]).alias("dkim"),
        dmarc_status(auth).alias("dmarc"),
        punycode(fields["from_field"], fields["reply_field"]).alias("punycode"),
        received_anomalies(fields["received"]).alias("anomalies"),
    )


def findings_of(details: Column) -> Column:
    """The five header findings from ``header_details``."""
    sender, reply = details["sender"], details["reply"]
    return F.struct(
        auth_status(
            details["spf"], details["dkim"]["status"], details["dmarc"]["status"]
        ).alias("auth"),
        reply_to_mismatch(sender["address"], reply["address"]).alias("reply_to_mismatch"),
        (
            (sender["name"] != "")
            & display_name_spoof(sender["name"], sender["address"])
        ).alias("display_name_spoof"),
        details["punycode"].alias("punycode"),
        (F.size(details["anomalies"]) >= 2).alias("suspicious_received"),
    )


def header_findings(raw: Column) -> Column:
    return let(let(header_fields(raw), header_details), findings_of)


def header_score(findings: Column) -> Column:
    points = rules.HEADER_POINTS
    score = (
        F.when(findings["auth"] == "fail", points["fail"])
        .when(findings["auth"] == "mismatch", points["mismatch"])
        .otherwise(0.0)
    )
    for field, key in [
        ("reply_to_mismatch", "reply_to"),
        ("display_name_spoof", "spoof"),
        ("punycode", "punycode"),
        ("suspicious_received", "received"),
    ]:
        score = score + F.when(findings[field], points[key]).otherwise(0.0)
    return F.least(score, F.lit(100.0))


def brand_table() -> Column:
    """Brand domains as a literal ``map<brand, domains>`` for table lookups."""
    pairs = []
    for brand, domains in rules.BRAND_DOMAINS.items():
        pairs += [F.lit(brand), strings(domains)]
    return F.create_map(*pairs)
