"""Masking of personal data.

The four kinds are masked in a fixed order, each scanning what the previous step
left.  Every match is replaced wherever it occurs, so a step is a fold over its
distinct matches; a repeated match finds nothing left to replace.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailrisk import rules
from mailrisk.functions.common import contains_any, let
from mailrisk.functions.regex import SPACE, jvm_regex

# The rule's pattern, tried once per run of address characters: where the rule finds an
# address, it starts at the first word edge of a run that an @ follows.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = jvm_regex(
    rf"(?:(?<!{_LOCAL})|\G)(?={_LOCAL}++@)(?>{_LOCAL}*?\b)({_LOCAL}++"
    + rules.EMAIL_PATTERN.removeprefix(rf"\b{_LOCAL}+")
    + ")",
    ignore_case=True,
)
PHONE = jvm_regex(rules.PHONE_PATTERN, first="+(0-9")
ACCOUNT = jvm_regex(rules.ACCOUNT_PATTERN, ignore_case=True, first="acn", second="cuú")
CARD = jvm_regex(rules.CARD_PATTERN, first="0-9")
# phones and cards have four digits on end, accounts more
_DIGITS = "[0-9][0-9][0-9][0-9]"
SEPARATORS = rf"[-{SPACE}]"


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n)


def _cut(value: Column, start: Column | int, length: Column | int) -> Column:
    return F.substring(value, F.lit(start), F.lit(length))


def mask_email(address: Column) -> Column:
    local = F.substring_index(address, "@", 1)
    n = F.length(local)
    domain = _cut(address, n + 1, F.length(address))
    masked_local = F.when(n <= 2, _stars(n)).otherwise(
        F.concat(F.left(local, F.lit(1)), _stars(n - 2), F.right(local, F.lit(1)))
    )
    return F.when(~address.contains("@"), address).otherwise(
        F.concat(masked_local, domain)
    )


def fingerprint(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 16)


def _mask_middle(value: Column, keep: int) -> Column:
    return F.concat(
        F.left(value, F.lit(keep)),
        _stars(F.length(value) - 2 * keep),
        F.right(value, F.lit(keep)),
    )


def mask_phone(number: Column) -> Column:
    return _mask_middle(number, 3)


def mask_account(number: Column) -> Column:
    return _mask_middle(number, 2)


def card_digits(card: Column) -> Column:
    return F.regexp_replace(card, SEPARATORS, "")


def mask_card(card: Column) -> Column:
    return _mask_middle(card_digits(card), 4)


def find_emails(text: Column) -> Column:
    # the '@' test is far cheaper than the pattern and rules most texts out, and of the others most words:
    # an address holds no blank, and a blank is as good an edge as any neighbour
    words = F.array_join(F.filter(F.split(text, " "), lambda w: w.contains("@")), " ")
    return F.when(
        text.contains("@"), F.regexp_extract_all(words, F.lit(EMAIL), F.lit(1))
    ).otherwise(F.array().cast("array<string>"))


def _find_numbers(text: Column, pattern: str, group: int, digits: int) -> Column:
    """Matches of a pattern that holds a run of ``digits`` digits; texts without one are not searched."""
    none = ~text.rlike(f"[0-9]{{{digits}}}")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.when(none, F.array().cast("array<string>")).otherwise(found)


def find_phones(text: Column) -> Column:
    return _find_numbers(text, PHONE, 0, 4)


def find_accounts(text: Column, group: int = 1) -> Column:
    return _find_numbers(text, ACCOUNT, group, 6)


def find_cards(text: Column) -> Column:
    return _find_numbers(text, CARD, 0, 4)


def _replace_each(text: Column, matches: Column, mask) -> Column:
    return F.aggregate(
        F.array_distinct(matches), text, lambda done, m: F.replace(done, m, mask(m))
    )


def redact_emails(text: Column) -> Column:
    return _replace_each(text, find_emails(text), mask_email)


def redact_phones(text: Column) -> Column:
    return _replace_each(text, find_phones(text), mask_phone)


def redact_accounts(text: Column) -> Column:
    return _replace_each(text, find_accounts(text), mask_account)


def redact_cards(text: Column) -> Column:
    return _replace_each(text, find_cards(text), mask_card)


def redact_placeholder(text: Column) -> Column:
    """Same order and reach, with a bracketed token in place of each match."""

    def token(kind):
        return lambda _: F.lit(rules.PLACEHOLDERS[kind])

    steps = [
        lambda t: _replace_each(t, find_emails(t), token("email")),
        lambda t: _replace_each(t, find_phones(t), token("phone")),
        lambda t: _replace_each(t, find_accounts(t, 0), token("account")),
        lambda t: _replace_each(t, find_cards(t), token("cc")),
    ]
    for step in steps:
        text = let(text, step)
    return text


def redact_text(text: Column, keep_context: bool = True) -> Column:
    """All four kinds, masked (``keep_context``) or replaced by tokens."""
    if not keep_context:
        return redact_placeholder(text)

    def numbers(rest):
        phones = lambda t: _replace_each(t, F.regexp_extract_all(t, F.lit(PHONE), F.lit(0)), mask_phone)
        cards = lambda t: _replace_each(t, F.regexp_extract_all(t, F.lit(CARD), F.lit(0)), mask_card)
        for step in (phones, redact_accounts, cards):
            rest = let(rest, step)
        return rest

    # masking makes no digits, so one test is enough for all three kinds of numbers
    return let(
        redact_emails(text), lambda t: F.when(t.rlike(_DIGITS), numbers(t)).otherwise(t)
    )


def redaction_entries(text: Column) -> Column:
    """``array<struct<kind, fingerprint>>`` in match order, repeats kept."""

    def entries(kind, matches):
        return F.transform(
            matches,
            lambda m: F.struct(
                F.lit(kind).alias("kind"), fingerprint(m).alias("fingerprint")
            ),
        )

    def numbers(after_emails):
        return let(
            redact_phones(after_emails),
            lambda after_phones: F.concat(
                entries("phone", find_phones(after_emails)),
                entries("account", find_accounts(after_phones)),
                let(
                    redact_accounts(after_phones),
                    lambda rest: entries(
                        "cc", F.transform(find_cards(rest), card_digits)
                    ),
                ),
            ),
        )

    return F.concat(
        entries("email", find_emails(text)), let(redact_emails(text), numbers)
    )


def redact_headers(headers: Column) -> Column:
    """Masked text, then the value of forwarded-address lines blanked."""
    names = "|".join(rules.IP_HEADERS)
    return F.regexp_replace(
        redact_text(headers),
        rf"(?idm)^({names}):[^\n]*",
        "$1: " + rules.IP_PLACEHOLDER,
    )


def safe_snippets(text: Column, max_len: int = 500, most: int | None = None) -> Column:
    """Pieces of token-redacted sentences worth a reviewer's look; ``most`` limits their number.

    The first three long sentences always stay; later ones only with a keyword.
    Sentences are packed in order, so the fold carries finished pieces plus the
    open one and, with a limit, stops growing there.
    """
    blanks = rf"\A[{SPACE}]+|[{SPACE}]+\z"
    sentences = F.transform(
        F.split(redact_placeholder(text), "[.!?]+"),
        lambda s: F.regexp_replace(s, blanks, ""),
    )
    long_enough = F.filter(sentences, lambda s: F.length(s) >= 20)
    relevant = F.filter(
        long_enough,
        lambda s, i: (i < 3) | contains_any(F.lower(s), rules.SNIPPET_KEYWORDS),
    )

    def state(done, piece):
        return F.struct(done.alias("done"), piece.alias("piece"))

    def pack(acc, sentence):
        fits = F.length(acc["piece"]) + F.length(sentence) < max_len
        opened = F.concat(sentence, F.lit(". "))
        full = F.lit(False) if most is None else F.size(acc["done"]) >= most
        flushed = F.when(
            (acc["piece"] == "") | full, acc["done"]
        ).otherwise(F.array_append(acc["done"], F.trim(acc["piece"])))
        return F.when(fits, state(acc["done"], F.concat(acc["piece"], opened))).otherwise(
            state(flushed, opened)
        )

    def close(acc):
        last = F.when(acc["piece"] != "", F.trim(acc["piece"]))
        pieces = F.array_compact(F.array_append(acc["done"], last))
        return pieces if most is None else F.slice(pieces, 1, most)

    start = state(F.array().cast("array<string>"), F.lit(""))
    return F.aggregate(relevant, start, pack, close)
