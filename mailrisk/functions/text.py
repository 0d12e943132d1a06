"""Text signals on cleaned, lower-case text."""

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailrisk import rules
from mailrisk.functions.common import any_of, kept, let
from mailrisk.functions.prep import clean_text
from mailrisk.functions.regex import WORD, by_first_letter, rare_end, rare_ends, whole_words, word_bodies


def folded(clean: Column) -> Column:
    """Lower-case text with the two letters that only case folding maps to ASCII.

    Case-sensitive patterns on this text find what case-insensitive ones find on
    the original, at a fraction of the cost.
    """
    return F.when(
        clean.contains("ſ") | clean.contains("ı"), F.translate(clean, "ſı", "si")
    ).otherwise(clean)


# Every pattern that is a word or phrase, and the number of blanks in the longest.
_PHRASES = (
    rules.URGENCY_PATTERNS
    + rules.TIME_PATTERNS
    + rules.CREDENTIAL_PATTERNS
    + rules.PAYMENT_PATTERNS
    + rules.ERROR_PATTERNS
    + rules.THREAT_PATTERNS
)
_LONGEST = 5
# The character before a word: a plain class rules most places out, the full word edge is for hits only.
_SCAN = (
    rf"[^abcdefghijklmnopqrstuvwxyz0123456789_](?=((?:{by_first_letter(_PHRASES)})(?![{WORD}])"
    rf"[^ ]*(?: [^ ]+){{0,{_LONGEST}}}))(?<![{WORD}])"
)


def phrase_lines(clean: Column) -> Column:
    """Where any phrase pattern matches, the words from there on; one line per place.

    The text is scanned once for all patterns.  Each pattern then only looks at the
    starts of these few lines: cleaned text has single blanks and no newlines, so a
    line holds every phrase that starts at its place, whole.
    """
    # the blank stands before the first word
    text = F.concat(F.lit(" "), folded(clean))
    return F.array_join(F.regexp_extract_all(text, F.lit(_SCAN), F.lit(1)), "\n")


_NAMES = [name for group in rules.BRAND_NAMES.values() for name in group]
# Everything that is searched anywhere in a text, inside of words too.
_ANYWHERE = (
    _NAMES
    + rules.THREAT_PHRASES
    + rules.CREDENTIAL_WORDS
    + rules.CREDENTIAL_ACTIONS
    + rules.PAYMENT_WORDS
    + rules.PAYMENT_ACTIONS
)
_ENDS = rare_ends(_ANYWHERE)


def word_ends(clean: Column) -> Column:
    """The rare ends of the names and words in a text, one line each, found by one scan."""
    return F.array_join(F.array_distinct(F.regexp_extract_all(clean, F.lit(_ENDS), F.lit(1))), "\n")


def _contains(clean: Column, ends: Column | None, word: str) -> Column:
    """Is ``word`` in the text?  With ``word_ends`` the text is only searched if its rare end was found."""
    end = rare_end(word)
    found = clean.contains(word)
    return found if ends is None or end is None else ends.contains(end) & found


def _contains_any(clean: Column, ends: Column | None, words) -> Column:
    return any_of(_contains(clean, ends, w) for w in words)


def _at_line_start(patterns) -> str:
    return rf"(?dm)^(?:{word_bodies(patterns)})(?![{WORD}])"


def _found(lines: Column, patterns) -> Column:
    return lines.rlike(_at_line_start(patterns))


def _hits(lines: Column, patterns) -> Column:
    return reduce(add, [_found(lines, [p]).cast("int") for p in patterns])


def urgency(lines: Column) -> Column:
    """Share of urgency patterns found, time wording counting half."""
    weighted = _hits(lines, rules.URGENCY_PATTERNS) + 0.5 * _hits(lines, rules.TIME_PATTERNS)
    return F.least(weighted / len(rules.URGENCY_PATTERNS), F.lit(1.0))


def credential_request(clean: Column, lines: Column, ends: Column | None = None) -> Column:
    return _found(lines, rules.CREDENTIAL_PATTERNS) | (
        _contains_any(clean, ends, rules.CREDENTIAL_WORDS)
        & _contains_any(clean, ends, rules.CREDENTIAL_ACTIONS)
    )


def payment_request(clean: Column, lines: Column, ends: Column | None = None) -> Column:
    return _found(lines, rules.PAYMENT_PATTERNS) | (
        _contains_any(clean, ends, rules.PAYMENT_WORDS)
        & _contains_any(clean, ends, rules.PAYMENT_ACTIONS)
    )


def lexical_errors(clean: Column, lines: Column) -> Column:
    """Matches of the mistake patterns plus one per odd punctuation habit.

    The habit of shouting in capitals never shows in lower-case text and adds 0.
    """
    mistakes = F.regexp_count(lines, F.lit(_at_line_start(rules.ERROR_PATTERNS)))
    repeated = clean.rlike(rules.REPEATED_MARKS_PATTERN)
    glued = clean.rlike(_GLUED)
    return mistakes + repeated.cast("int") + glued.cast("int")


# the rare mark is tested before its neighbours
_GLUED = rf"[!?.,;:](?=[{WORD}])(?<=[{WORD}][!?.,;:])"


def language_mixing(clean: Column, min_hits: int = 3) -> Column:
    """At least ``min_hits`` Spanish and English indicator patterns.

    There are two patterns per language, so the default never fires.
    """
    if min_hits > min(len(rules.SPANISH_PATTERNS), len(rules.ENGLISH_PATTERNS)):
        return F.lit(False)
    text = folded(clean)

    def hits(patterns):
        return reduce(add, [text.rlike(whole_words([p])).cast("int") for p in patterns])

    return (hits(rules.SPANISH_PATTERNS) >= min_hits) & (
        hits(rules.ENGLISH_PATTERNS) >= min_hits
    )


def brand_mentions(clean: Column, whole_word: bool = False, ends: Column | None = None) -> Column:
    """Brand names in the text, in rule order; ``whole_word`` avoids "ing" in words."""
    held = {n: _contains(clean, ends, n) for n in _NAMES}
    if whole_word:
        # a plain search rules most names out before their pattern is tried
        return kept(*[(c & clean.rlike(whole_words([n])), F.lit(n)) for n, c in held.items()])
    return kept(*[(c, F.lit(n)) for n, c in held.items()])


def threat_phrases(clean: Column, lines: Column, ends: Column | None = None) -> Column:
    """Distinct threats found by pattern or phrase, sorted."""
    found = F.regexp_extract_all(
        lines, F.lit(_at_line_start(rules.THREAT_PATTERNS)), F.lit(0)
    )
    phrases = kept(*[(_contains(clean, ends, t), F.lit(t)) for t in rules.THREAT_PHRASES])
    return F.array_sort(F.array_distinct(F.concat(found, phrases)))


def signals_of(
    clean: Column, lines: Column, whole_word: bool = False, min_hits: int = 3, ends: Column | None = None
) -> Column:
    """All signals of a cleaned text and its ``phrase_lines``; its ``word_ends`` save searches."""
    return F.struct(
        urgency(lines).alias("urgency"),
        credential_request(clean, lines, ends).alias("credential_request"),
        payment_request(clean, lines, ends).alias("payment_request"),
        lexical_errors(clean, lines).alias("lexical_errors"),
        language_mixing(clean, min_hits).alias("language_mixing"),
        brand_mentions(clean, whole_word, ends).alias("brands"),
        threat_phrases(clean, lines, ends).alias("threats"),
    )


def text_signals(text: Column, whole_word: bool = False, min_hits: int = 3) -> Column:
    """All signals of a raw text; an empty text has the neutral ones."""
    return let(
        clean_text(text),
        lambda clean: let(
            F.struct(phrase_lines(clean).alias("lines"), word_ends(clean).alias("ends")),
            lambda found: signals_of(clean, found["lines"], whole_word, min_hits, found["ends"]),
        ),
    )


def signal_descriptions(signals: Column) -> Column:
    texts = rules.SIGNAL_TEXTS
    urgency_text = F.format_string(texts["urgency"], F.bround(signals["urgency"], 2))
    errors_text = F.format_string(texts["errors"], signals["lexical_errors"])
    first_brands = F.array_join(F.slice(signals["brands"], 1, 3), ", ")
    return kept(
        (signals["urgency"] > 0.3, urgency_text),
        (signals["credential_request"], F.lit(texts["credential"])),
        (signals["payment_request"], F.lit(texts["payment"])),
        (signals["lexical_errors"] > 2, errors_text),
        (signals["language_mixing"], F.lit(texts["mixing"])),
        (
            F.size(signals["brands"]) > 0,
            F.concat(F.lit(texts["brands"]), first_brands),
        ),
        (F.size(signals["threats"]) > 0, F.lit(texts["threats"])),
    )


def text_score(signals: Column) -> Column:
    def capped(points, cap):
        return F.least(points.cast("double"), F.lit(float(cap)))

    def when(flag, points):
        return F.when(flag, float(points)).otherwise(0.0)

    total = (
        signals["urgency"] * 20
        + when(signals["credential_request"], 30)
        + when(signals["payment_request"], 25)
        + capped(signals["lexical_errors"] * 3, 15)
        + when(signals["language_mixing"], 10)
        + capped(F.size(signals["brands"]) * 5, 15)
        + capped(F.size(signals["threats"]) * 8, 20)
    )
    return F.least(total, F.lit(100.0))
