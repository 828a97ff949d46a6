"""HTML to words, entirely with JVM-side expressions."""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements whose content is not page text.
HIDDEN_ELEMENTS = ("script", "style", "applet", "button", "select", "textarea", "frameset", "noframes")

WORD = "[a-zA-Z]{3,}"
PROLOG = r"(?s)^<\?.*?\?>"

# Names that HTML also reads without a semicolon, longest first.
_BARE_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
NAMED = rf"&(?:[a-zA-Z][a-zA-Z0-9]*;|{'|'.join(_BARE_NAMES)})"


def markup_pattern(hidden: Sequence[str] = HIDDEN_ELEMENTS) -> str:
    """One pattern for comments, hidden elements with their content, and plain tags.

    The alternatives are tried at each position from left to right as a browser would meet them, so
    a comment inside a script or a tag inside a comment cannot unbalance the rest. Quoted attribute
    values may hold ">" and a tag may be cut off by the end of the page. The possessive repeat keeps the
    matcher's stack flat however many values a tag has; it never changes what is found.
    """
    parts = [r"!--.*?(?:-->|\z)"]
    parts += [rf"{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)" for tag in hidden]
    parts += [r"""[/!?a-z][^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*+>""", r"[/!?a-z][^>]*(?:>|\z)"]
    # The common first character stands in front, so that plain text is passed over quickly.
    return f"(?is)<(?:{'|'.join(parts)})"


def strip_prolog(html: Column) -> Column:
    return F.regexp_replace(html, PROLOG, "")


def _decode_numeric(text: Column) -> Column:
    """Numeric references to ASCII characters are decoded, all others become a blank."""
    pieces = F.split(text, "&#")

    def decoded(piece: Column) -> Column:
        # Without leading zeros, ASCII has at most three digits; a longer number is some other character.
        dec = F.regexp_extract(piece, r"^0*([0-9]+)", 1)
        hexa = F.regexp_extract(piece, r"^[xX]0*([0-9a-fA-F]+)", 1)
        code = F.when(dec != "", F.when(F.length(dec) > 3, 0).otherwise(dec.try_cast("int"))).when(
            hexa != "", F.when(F.length(hexa) > 3, 0).otherwise(F.conv(hexa, 16, 10).try_cast("int")))
        char = F.when(code.between(1, 127), F.char(code)).otherwise(F.lit(" "))
        rest = F.regexp_replace(piece, r"^(?:[0-9]+|[xX][0-9a-fA-F]+);?", "")
        return F.when(code.isNull(), F.concat(F.lit("&#"), piece)).otherwise(F.concat(char, rest))

    tail = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), decoded)
    joined = F.concat(F.element_at(pieces, 1), F.array_join(tail, ""))
    return F.when(F.contains(text, F.lit("&#")), joined).otherwise(text)


def html_text(html: Column, sep: str = "", hidden: Sequence[str] = HIDDEN_ELEMENTS) -> Column:
    """Visible text. Tags vanish without a blank unless ``sep`` says so, so ``<li>a</li><li>b</li>``
    gives ``ab``. Named references never stand for ASCII letters, so they become blanks."""
    bare = F.regexp_replace(html, markup_pattern(hidden), sep)
    return _decode_numeric(F.regexp_replace(bare, NAMED, " "))


def words(text: Column) -> Column:
    """Runs of at least three ASCII letters, in order, case kept."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def page_words(html: Column, sep: str = "") -> Column:
    return words(html_text(strip_prolog(html), sep))


def normalise_words(tokens: Column) -> Column:
    """Lower-cased, trimmed, blanks dropped."""
    return F.filter(F.transform(tokens, lambda w: F.lower(F.trim(w))), lambda w: w != "")
