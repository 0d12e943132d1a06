"""Whole texts are scanned for few and plain things, with the results of the plain rules."""

import random
import re
import sys
import unicodedata

from pyspark.sql import functions as F

from mailrisk import rules
from mailrisk.functions import prep, redact
from mailrisk.functions import text as N
from mailrisk.functions import urls as U
from mailrisk.functions.regex import BLANK_RUN

BLANKS = [c for c in map(chr, range(sys.maxunicode)) if unicodedata.category(c)[0] == "Z" or c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_blank_runs_start_with_a_plain_class(values):
    assert BLANK_RUN.startswith("[") and "&&" not in BLANK_RUN and "|" not in BLANK_RUN
    rng = random.Random(5)
    texts = [None, "", " ", "  "] + [f"a{b}b {b}c{b} d{b}{b}e" for b in BLANKS]
    texts += ["".join(rng.choice([" ", " ", "a", "é", "‐", "​", "、", *rng.sample(BLANKS, 2)]) for _ in range(12)) for _ in range(500)]
    got = values(prep.squeezed, texts)
    run = f"[{re.escape(''.join(BLANKS))}]+"
    assert got == [None if t is None else re.sub(run, " ", t) for t in texts]


def test_phrases_behind_any_edge(values):
    assert not N._SCAN.startswith("(?<!")
    texts = ["now", "énow", "é now", "now,now-now", "_now 9now", "ſnow €now", None]
    assert values(N.phrase_lines, texts) == ["now", "", "now", "now,now-now\nnow-now\nnow", "", "now", None]


def test_links_searched_plainly_first(values):
    assert "contains" in str(U.text_links(F.col("t")))
    assert values(U.text_links, ["http a", "HTTPS://a.b/c x", "", None]) == [[], ["HTTPS://a.b/c"], [], None]


def test_one_test_for_all_numbers(values):
    assert str(redact.redact_text(F.col("t"))).upper().count("RLIKE") == 2
    texts = ["call 555-123-4567, account 1234567, 4111 1111 1111 1111, a.b1@c.de", "in 123 at a1@b.co", "account 12", "", None]

    def in_steps(t):
        return redact.redact_cards(redact.redact_accounts(redact.redact_phones(redact.redact_emails(t))))

    assert values(redact.redact_text, texts) == values(in_steps, texts)


def test_edits_counted_to_a_bound(values):
    rng = random.Random(7)
    names = [*rules.LOOKALIKE_BRANDS, "", "x.com", None]
    for brand in rules.LOOKALIKE_BRANDS:
        for _ in range(25):
            name = list(brand)
            for _ in range(rng.randint(1, 6)):
                at = rng.randrange(len(name) + 1)
                name[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "1", "-é"])
            names.append("".join(name))

    def best(name):
        near = [1.0 - edits(name, b) / max(len(name), len(b)) for b in rules.LOOKALIKE_BRANDS]
        return max(near) if max(near) > 0.7 else None

    assert values(U.brand_similarity, names) == [None if n is None else best(n) for n in names]
