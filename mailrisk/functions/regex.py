"""Turn rule patterns into JVM regular expressions with Unicode semantics.

``\\b``, ``\\w``, ``\\d`` and ``\\s`` are ASCII-only in a plain JVM regex and their
Unicode variants differ between JVM versions, so the shorthands are spelled out
as explicit character classes.
"""

import re

WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
SPACE = r"\t-\r\x1C-\x1F\x85\p{Z}"
# A run of blanks from its first one that is no space.  Blanks are few and cheap to tell by the first class;
# the look back drops what is no blank between the wide ones.
BLANK_RUN = rf"[\t\n\x0B\f\r\x1C\x1D\x1E\x1F\x85\xA0\u1680-\u3000](?<=[{SPACE}])[{SPACE}]*"

_CLASS_BODY = {"w": WORD, "d": DIGIT, "s": SPACE}
_EDGE = rf"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"
_TOKEN = re.compile(r"\\(.)|([\[\]])")


def jvm_regex(pattern: str, ignore_case: bool = False, first: str = "", second: str = "") -> str:
    """Spell out the shorthands of ``pattern``; optionally fold Unicode case.

    ``first`` names the characters a match can start with, ``second`` those that can follow.
    Testing them before the costlier word edge lets the engine skip most positions.
    """
    inside = False

    def spell(token):
        nonlocal inside
        escaped, bracket = token.groups()
        if bracket:
            inside = bracket == "["
            return bracket
        if escaped in _CLASS_BODY:
            body = _CLASS_BODY[escaped]
            return body if inside else f"[{body}]"
        return _EDGE if escaped == "b" else token.group()

    spelled = _TOKEN.sub(spell, pattern)
    guard = f"(?=[{first}]{second and f'[{second}]'})" if first else ""
    return ("(?iu)" if ignore_case else "") + guard + spelled


def word_bodies(patterns) -> str:
    """Alternation of patterns without their outer word edges."""
    return "|".join(
        jvm_regex(p.removeprefix(r"\b").removesuffix(r"\b")) for p in patterns
    )


def _parts(body: str) -> list[str]:
    """What ``|`` separates outside of groups and classes."""
    depth, inside, parts = 0, False, [""]
    for token in re.findall(r"\\.|.", body):
        inside = token == "[" or (inside and token != "]")
        depth += 0 if inside else (token == "(") - (token == ")")
        if token == "|" and not depth and not inside:
            parts.append("")
        else:
            parts[-1] += token
    return parts


def _alternatives(body: str) -> list[str]:
    """Bodies that together match what ``body`` does, groups at the start spelled out; ``(?:a|b)?tail`` as ``a tail, b tail, tail``."""
    parts = _parts(body)
    if len(parts) > 1:
        return [a for part in parts for a in _alternatives(part)]
    if not body.startswith("(?:"):
        return [body]
    end = next(i for i in range(len(body)) if body[i] == ")" and len(_parts(body[: i + 1] + "|")) == 2)
    tail = body[end + 1 :]
    if tail[:1] in ("*", "+", "{"):
        return [body]
    tails = [tail.removeprefix("?")] * (1 + tail.startswith("?"))
    chosen = [a + tails[0] for part in _parts(body[3:end]) for a in _alternatives(part)]
    return chosen + [a for t in tails[1:] for a in _alternatives(t)]


# At so many letters or more, half of them are ruled out by one look at the next letter.
_MANY_LETTERS = 6


def _by_letter(bodies) -> str:
    """Alternation of bodies as a tree of their first letters."""
    grouped, others = {}, []
    for body in dict.fromkeys(bodies):
        if body[:1].isalpha() and body[1:2] not in ("?", "*", "+", "{"):
            grouped.setdefault(body[0], []).append(body[1:])
        else:
            others.append(jvm_regex(body))
    branches = {c: c + (f"(?:{_by_letter(rest)})" if len(rest) > 1 else jvm_regex(rest[0])) for c, rest in grouped.items()}

    def tree(letters):
        if len(letters) < _MANY_LETTERS:
            return "|".join(branches[c] for c in letters)
        halves = letters[: len(letters) // 2], letters[len(letters) // 2 :]
        return "|".join(f"(?=[{''.join(half)}])(?:{tree(half)})" for half in halves)

    return "|".join([t for t in [tree(sorted(grouped))] if t] + others)


def by_first_letter(patterns) -> str:
    """Alternation of pattern bodies, those with common first letters together.

    At most places the engine then tests a few letters, not every word.  It finds the same places as the patterns
    one by one; which of several that match there is taken is left open.
    """
    return _by_letter([a for p in patterns for a in _alternatives(p.removeprefix(r"\b").removesuffix(r"\b"))])


def whole_words(patterns) -> str:
    """One alternation for patterns that all start and end on a word character.

    The two word edges are checked once, outside the alternation.
    """
    return rf"(?<![{WORD}])(?:{word_bodies(patterns)})(?![{WORD}])"


# Letters that are rare in running text, rarest first.
_RARE = "qxjzkwyvbfghpcm"


def rare_end(word: str) -> str | None:
    """The end of a word from its rarest letter on, at least two letters; none without a rare letter."""
    rare = [(_RARE.index(c), i) for i, c in enumerate(word[:-1]) if c in _RARE]
    return word[min(rare)[1] :] if rare else None


def rare_ends(words) -> str:
    """Pattern of the places where the ``rare_end`` of a plain word stands in that word, taken as group 1.

    Two plain classes rule most places out, of equal places the longest end is taken, and nothing is used up, so
    words may overlap.
    """
    ends = {word: end for word in words if (end := rare_end(word))}
    first, second = ("".join(sorted({end[i] for end in ends.values()})) for i in (0, 1))
    bodies = [end + (f"(?<={word})" if end != word else "") for word, end in ends.items()]
    return f"(?=[{first}][{second}])(?=({_by_letter(bodies)}))"
