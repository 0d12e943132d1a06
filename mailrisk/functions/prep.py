"""Text preparation: raw mail splitting, HTML to text, cleaning, truncation."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailrisk.functions.common import let
from mailrisk.functions.regex import BLANK_RUN

# What the interactive service keeps of a mail without a blank line.
HEADER_FALLBACK_CHARS = 2000


def split_raw_message(raw: Column, fallback_chars: int | None = None) -> Column:
    """Header block of a raw mail: up to the first CRLF CRLF, else all of it.

    ``fallback_chars`` limits what is taken of a mail without such a line.
    """
    end = F.instr(raw, "\r\n\r\n")
    rest = raw if fallback_chars is None else F.substring(raw, 1, fallback_chars)
    return F.when(end > 0, F.substring(raw, F.lit(1), end - 1)).otherwise(rest)


def replace_closed(text: Column, pattern: str, closing: str, by: str) -> Column:
    """``regexp_replace`` for a pattern whose matches end in ``closing``.

    Nothing behind the last closing can match, so openings there are not tried: each
    would scan the rest of the text.
    """
    def replaced(whole, closed):
        rest = F.substring(whole, F.length(closed) + 1, F.length(whole))
        return F.concat(F.regexp_replace(closed, pattern, by), rest)

    # bound, as several of these steps on one another would else repeat their text each time
    return let(
        text,
        lambda whole: let(
            F.regexp_extract(whole, rf"(?is)\A(.*{closing})", 1), lambda closed: replaced(whole, closed)
        ),
    )


def without_elements(html: Column, *elements: str) -> Column:
    """Drop whole elements."""
    text = html
    for element in elements:
        closing = f"</{element}>"
        text = replace_closed(text, rf"(?is)<{element}[^>]*>.*?{closing}", closing, "")
    return text


def squeezed(text: Column) -> Column:
    """Runs of blanks to one space: first those with other blanks than spaces, then what is left of spaces."""
    return let(
        F.regexp_replace(text, BLANK_RUN, " "),
        lambda t: F.when(t.contains("  "), F.regexp_replace(t, " {2,}", " ")).otherwise(t),
    )


def html_to_text(html: Column) -> Column:
    """Drop style and script elements, turn tags into spaces, squeeze blanks."""
    text = without_elements(html, "style", "script")
    text = replace_closed(text, "<[^>]*>", ">", " ")
    return F.trim(squeezed(text))


def clean_text(text: Column) -> Column:
    """Entities to blanks, blanks squeezed, lower case."""
    entities = F.regexp_replace(text, "&[a-zA-Z0-9#]+;", " ")
    text = F.when(text.contains("&"), entities).otherwise(text)
    return F.lower(F.trim(squeezed(text)))


def truncate_fields(
    headers: Column,
    text: Column,
    snippets: Column,
    url_metadata: Column,
    owned: Column,
    *,
    header_chars: int = 1000,
    text_chars: int = 2000,
    most_snippets: int = 3,
    most_urls: int = 5,
    most_owned: int = 3,
) -> dict[str, Column]:
    """The size limits of a review request."""
    return {
        "headers_raw": F.substring(headers, 1, header_chars),
        "text_body": F.substring(text, 1, text_chars),
        "html_snippets": F.slice(snippets, 1, most_snippets),
        "url_metadata": F.slice(url_metadata, 1, most_urls),
        "owned_domains": F.slice(owned, 1, most_owned),
    }
