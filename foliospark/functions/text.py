"""Column helpers over text. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words dropped by the full-text configuration.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what which "
    "who whom this that these those am is are was were be been being have has had having do "
    "does did doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will "
    "just don should now"
).split()

TERM_PATTERN = r"[\p{L}\p{N}]+"


# Fixed value: the characters that count as whitespace at the ends of a text.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def strip_left(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE))


def strip_right(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def squeeze(text: Column) -> Column:
    """Whitespace runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def token_count(text: Column) -> Column:
    """Runs of non-whitespace."""
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("int")


def solid_length(text: Column) -> Column:
    """Characters that are not whitespace."""
    return F.length(F.regexp_replace(text, r"(?U)\s+", ""))


def excerpt(text: Column, max_chars: int) -> Column:
    body = squeeze(text)
    return F.when(
        F.length(body) > max_chars, F.concat(F.substring(body, 1, max_chars), F.lit("…"))
    ).otherwise(body)


def preview(text: Column, max_chars: int = 200) -> Column:
    return F.left(text, F.lit(max_chars))


def repeat_key(text: Column) -> Column:
    """Lower-cased text with digit runs as '#' and single spaces, so that running
    footers that differ only in the page number compare equal."""
    marked = F.regexp_replace(F.lower(strip(text)), r"(?U)\d+", "#")
    return F.regexp_replace(marked, r"(?U)\s+", " ")


def word_set(words: list[str]) -> Column:
    """A constant array; one literal, so that building the plan stays cheap."""
    return F.split(F.lit(" ".join(words)), " ")


def one_of(column: str, words: list[str]) -> Column:
    """IN test against a fixed list, which Spark turns into a hash set."""
    return F.expr(f"{column} IN ({', '.join(repr(w) for w in words)})")


def terms(text: Column) -> Column:
    """Lower-cased letter/digit runs in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0))


def stem(term: Column) -> Column:
    """Harman's S-stemmer: first matching plural rule only."""
    size = F.length(term)
    return (
        F.when(~term.endswith("s"), term)
        .when(
            term.endswith("ies") & ~term.endswith("eies") & ~term.endswith("aies"),
            F.concat(term.substr(F.lit(1), size - 3), F.lit("y")),
        )
        .when(
            term.endswith("es")
            & ~term.endswith("aes") & ~term.endswith("ees") & ~term.endswith("oes"),
            term.substr(F.lit(1), size - 1),
        )
        .when(~term.endswith("us") & ~term.endswith("ss"), term.substr(F.lit(1), size - 1))
        .otherwise(term)
    )


def chunk_key(document_id: Column, page: Column, offset: Column) -> Column:
    """sha256 over ``document|page|offset``."""
    return F.sha2(
        F.concat_ws("|", document_id.cast("string"), page.cast("string"), offset.cast("string")),
        256,
    )


# Fixed value: the name space of stored chunk ids.
CHUNK_NAMESPACE = "6a6e2b0e-6b7b-4f34-9f2e-9d6b6f5c8e3d"


def uuid5(name: Column, namespace: str = CHUNK_NAMESPACE) -> Column:
    """RFC 4122 name-based (SHA-1) uuid of ``name``."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3),
        F.lit("-"), F.substring(digest, 21, 12),
    )
