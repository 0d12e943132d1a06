"""URL extraction and checks.

Each check is a Column expression over one URL, so the same definitions serve an
exploded URL table and a ``transform`` over a message's URL array.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailrisk import rules
from mailrisk.functions.common import any_of, kept, let, strings
from mailrisk.functions.prep import replace_closed, without_elements
from mailrisk.functions.regex import SPACE, jvm_regex

_TAG = r"""(?is)<(?:a|img|form)(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*+>"""
# One attribute after the other: a name, and a value in either kind of quotes or in none.
_ATTRIBUTE = r"""(?is)(?:\G|\A<[a-z]+)[\s/"']*+([^\s/>="'][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)|))?"""
_ATTRIBUTES = ("href", "src", "action")
_COMMENT = r"(?s)<!--.*?-->"
_REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z]+);?"
# Named character references that may stand for a character of a link.
_NAMED = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "colon": ":", "sol": "/", "equals": "=", "period": ".",
    "comma": ",", "num": "#", "quest": "?", "excl": "!", "dollar": "$", "percnt": "%", "plus": "+", "lowbar": "_",
    "commat": "@", "semi": ";", "lpar": "(", "rpar": ")", "lsqb": "[", "rsqb": "]", "ast": "*", "bsol": "\\",
    "Tab": "\t", "NewLine": "\n", "nbsp": "\u00a0", "hyphen": "\u2010", "dash": "\u2010",
}
# Of these the names also count without their semicolon.
_LOOSE = ("amp", "lt", "gt", "quot", "nbsp")
TEXT_URL = jvm_regex(rules.TEXT_URL_PATTERN, ignore_case=True)
SUSPICIOUS = [jvm_regex(p, ignore_case=True) for p in rules.URL_PATTERNS]
IP_URL = jvm_regex(rules.IP_URL_PATTERN)


# --- extraction --------------------------------------------------------------
def _character(reference: Column) -> Column:
    """The character of one reference; unknown names stay as they are."""
    body = F.regexp_replace(reference, r"\A&|;\z", "")
    hexed = F.lower(F.substring(body, 1, 2)) == "#x"
    digits = F.when(hexed, F.substring(body, F.lit(3), F.length(body))).otherwise(F.substring(body, F.lit(2), F.length(body)))
    digits = F.when(digits.rlike(r"\A0*\z"), "0").otherwise(F.regexp_replace(digits, r"\A0+", ""))
    number = F.when(F.length(digits) > 8, F.lit(0)).otherwise(F.when(hexed, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long"))
    real = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    code = F.lpad(F.hex(F.when(real, number).otherwise(0xFFFD)), 8, "0")
    known = F.create_map(*[F.lit(x) for pair in _NAMED.items() for x in pair])
    named = F.when(reference.endswith(";") | body.isin(*_LOOSE), F.try_element_at(known, body))
    return F.when(body.startswith("#"), F.decode(F.unhex(code), "UTF-32")).otherwise(F.coalesce(named, reference))


def decoded(value: Column) -> Column:
    """Character references decoded in one pass: what a reference yields is not read again."""
    found = F.transform(F.regexp_extract_all(value, F.lit(_REFERENCE), F.lit(0)), _character)
    between = F.split(value, _REFERENCE)
    parts = F.zip_with(between, found, lambda text, char: F.concat(text, F.coalesce(char, F.lit(""))))
    return F.when(value.contains("&"), F.array_join(parts, "")).otherwise(value)


def _links_of(tag: Column) -> Column:
    """The first href, src and action of a tag, in this order.

    Inside a lambda nothing is shared by itself, so the attributes are bound once by ``let``.
    """
    name, double, single, bare = (F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(g)) for g in (1, 2, 3, 4))
    pairs = F.arrays_zip(name.alias("name"), double.alias("a"), single.alias("b"), bare.alias("c"))

    def value(attributes, wanted):
        first = F.get(F.filter(attributes, lambda p: F.lower(p["name"]) == wanted), F.lit(0))
        return let(first, lambda p: let(F.concat(p["a"], p["b"], p["c"]), decoded))

    return let(pairs, lambda attributes: F.array_compact(F.array(*[value(attributes, a) for a in _ATTRIBUTES])))


def _visible(html: Column) -> Column:
    """Without comments and script and style elements, whose links nobody can follow."""
    return without_elements(replace_closed(html, _COMMENT, "-->", ""), "script", "style")


def html_links(html: Column) -> Column:
    """Absolute http(s) links of anchors, images and forms, in page order."""
    tags = F.regexp_extract_all(_visible(html), F.lit(_TAG), F.lit(0))
    values = F.flatten(F.transform(tags, _links_of))
    return F.filter(values, lambda u: u.startswith("http://") | u.startswith("https://"))


def text_links(text: Column) -> Column:
    # every link has these marks, and a plain search for them is far cheaper than the pattern
    none = ~text.contains("://")
    found = F.regexp_extract_all(text, F.lit(TEXT_URL), F.lit(0))
    return F.when(none, F.array().cast("array<string>")).otherwise(found)


def all_links(html: Column, text: Column, limit: int | None = None) -> Column:
    """Distinct URLs by first appearance, HTML before text; all, or the first ``limit``."""
    found = F.array_distinct(F.concat(html_links(html), text_links(text)))
    return found if limit is None else F.slice(found, 1, limit)


# --- checks ------------------------------------------------------------------
def url_domain(url: Column) -> Column:
    """Lower-case network location, user-info and port included."""
    cleaned = F.regexp_replace(url, rf"\A[{SPACE}]+|[\t\r\n]", "")
    return F.lower(F.regexp_extract(cleaned, r"\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def valid_location(domain: Column) -> Column:
    """Unbalanced brackets make a location unreadable; such URLs are not judged."""
    return domain.contains("[") == domain.contains("]")


def suspicious_pattern(url: Column) -> Column:
    return any_of(url.rlike(p) for p in SUSPICIOUS)


def ip_host(url: Column) -> Column:
    return url.rlike(IP_URL)


def shortener(domain: Column) -> Column:
    return domain.isin(rules.SHORTENERS)


def uses_https(url: Column) -> Column:
    return F.lower(F.substring_index(url, ":", 1)) == "https"


def registered_domain(domain: Column, suffixes=rules.PUBLIC_SUFFIXES) -> Column:
    """Longest known suffix plus one label; the last two labels otherwise."""
    host = F.ltrim(domain, F.lit("."))
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    return F.when(two.isin(list(suffixes)), three).otherwise(two)


def _near_lengths(n: int) -> tuple[int, int]:
    """The least and the greatest length whose distance from ``n`` is below 0.3 of the longer one."""
    near = [m for m in range(2 * n + 1) if abs(m - n) < 0.3 * max(m, n)]
    return near[0], near[-1]


def brand_similarity(registered: Column, exclude_exact: bool = False) -> Column:
    """Best edit similarity to a known brand domain; null unless above 0.7.

    Brands whose length alone keeps the similarity at or below 0.7 are skipped.
    """

    def best(length):
        def similarity(brand):
            n = len(brand)
            reachable = length.between(*_near_lengths(n))
            if exclude_exact:
                reachable = reachable & (registered != brand)
            # above 0.7 there are fewer than 0.3 of at most n / 0.7 edits; counting stops there with -1
            edits = F.levenshtein(registered, F.lit(brand), n * 3 // 7 + 1)
            return F.when(reachable, 1.0 - edits / F.greatest(length, F.lit(n)))

        measured = F.array(*[similarity(b) for b in rules.LOOKALIKE_BRANDS])
        return F.array_max(F.filter(measured, lambda s: s <= 1.0))

    return let(let(F.length(registered), best), lambda most: F.when(most > 0.7, most))


# --- verdict per URL ---------------------------------------------------------
def url_facts(url: Column, exclude_exact: bool = False, similarity: Column | None = None) -> Column:
    """Everything the reasons and the level depend on, each computed once.

    ``similarity`` to a brand may come from a lookup; else it is measured here.
    """

    def measured(domain):
        if similarity is not None:
            return similarity
        return let(registered_domain(domain), lambda r: brand_similarity(r, exclude_exact))

    def located(domain):
        return F.struct(
            url.alias("url"),
            domain.alias("domain"),
            valid_location(domain).alias("valid"),
            uses_https(url).alias("https"),
            suspicious_pattern(url).alias("pattern"),
            ip_host(url).alias("ip"),
            shortener(domain).alias("shortener"),
            measured(domain).alias("similarity"),
        )

    return let(url_domain(url), located)


def _similar(facts: Column) -> Column:
    return F.coalesce(facts["similarity"] > 0.8, F.lit(False))


def url_reasons(facts: Column, redirects: Column = None, age_days: Column = None) -> Column:
    """Reasons in check order; ``redirects`` and ``age_days`` come from a lookup."""
    texts = rules.URL_REASONS
    checks = [
        (facts["pattern"], F.lit(texts["pattern"])),
        (facts["ip"], F.lit(texts["ip"])),
        (facts["shortener"], F.lit(texts["shortener"])),
        (~facts["https"], F.lit(texts["no_https"])),
        (_similar(facts), F.lit(texts["similar"])),
    ]
    if redirects is not None:
        checks.append((redirects > 2, F.lit(texts["redirects"])))
    if age_days is not None:
        # an age of exactly 0 counts as unknown
        checks.append(((age_days < 30) & (age_days != 0), F.lit(texts["young"])))
    return F.when(facts["valid"], kept(*checks)).otherwise(strings([]))


def url_level(facts: Column) -> Column:
    """The last check that fires decides."""
    return (
        F.when(_similar(facts), "high")
        .when(~facts["https"] | facts["shortener"], "medium")
        .when(facts["ip"], "high")
        .when(facts["pattern"], "medium")
        .otherwise("low")
    )


def url_finding(facts: Column, reasons: Column) -> Column:
    """``struct<url, reason, risk_level>``; null without a reason."""
    return F.when(
        F.size(reasons) > 0,
        F.struct(
            facts["url"].alias("url"),
            F.array_join(F.slice(reasons, 1, 2), "; ").alias("reason"),
            url_level(facts).alias("risk_level"),
        ),
    )


def url_metadata(facts: Column, intel: Column = None, age_days: Column = None) -> Column:
    """Description of one analysed URL, finding or not."""

    def known(field, kind, default=None):
        value = F.lit(None) if intel is None else intel[field]
        value = value.cast(kind)
        return value if default is None else F.coalesce(value, F.lit(default))

    return F.struct(
        facts["url"].alias("url"),
        facts["domain"].alias("domain"),
        (facts["https"] & facts["valid"]).alias("https"),
        known("redirects", "int", 0).alias("redirections"),
        F.when(_similar(facts) & facts["valid"], facts["similarity"]).alias(
            "domain_similarity"
        ),
        (F.lit(None) if age_days is None else age_days).cast("int").alias(
            "whois_age_days"
        ),
        known("blacklisted", "boolean", False).alias("blacklist_hit"),
        known("final_url", "string").alias("final_url"),
        known("status", "int").alias("response_code"),
        (~facts["valid"]).alias("analysis_failed"),
    )


def analyse_urls(urls: Column) -> Column:
    """``array<struct<finding, metadata>>`` for an array of URLs, row-local."""
    facts = F.transform(urls, lambda u: url_facts(u))
    return F.transform(
        facts,
        lambda f: F.struct(
            let(url_reasons(f), lambda r: url_finding(f, r)).alias("finding"),
            url_metadata(f).alias("metadata"),
        ),
    )


def url_score(findings: Column) -> Column:
    """Points per finding by level, plus a bonus for several findings; at most 100."""
    points = F.aggregate(
        findings,
        F.lit(0.0),
        lambda total, f: total + level_points(f["risk_level"]),
    )
    return total_url_score(points, F.size(findings))


def level_points(level: Column) -> Column:
    points = rules.URL_POINTS
    return (
        F.when(level == "high", points["high"])
        .when(level == "medium", points["medium"])
        .otherwise(points["low"])
    )


def total_url_score(points: Column, n: Column) -> Column:
    bonus = F.when(n > 1, F.least(n * 5, F.lit(20))).otherwise(0)
    return F.least(points + bonus, F.lit(100.0))
