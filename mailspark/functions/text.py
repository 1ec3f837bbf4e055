"""Tokens as padded text.

A text column is stored once in *padded* form: every token is surrounded by single blanks, so
``"Invoice 2024"`` becomes ``"  invoice  2024  "``. Matching a phrase is then one ``contains`` and
counting its occurrences is length arithmetic, both inside whole-stage codegen. No token arrays
are built and no lambda runs per token.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text columns that can be searched, in this order.
TEXT_COLUMNS = ("subject", "from_name", "from_address", "to_text", "snippet", "body_text")

# Characters that never belong to a token (everything but letters, numbers, private use).
SEPARATORS = r"[^\p{L}\p{N}\p{Co}]+"

# White space trimmed from the ends of values.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Combining marks that vanish inside a token.
DROPPED_MARKS = "".join(
    chr(c)
    for c in (
        0x300, 0x301, 0x302, 0x303, 0x304, 0x306, 0x307, 0x308, 0x309, 0x30A, 0x30B, 0x30C, 0x30F,
        0x311, 0x31B, 0x323, 0x324, 0x325, 0x326, 0x327, 0x328, 0x32D, 0x32E, 0x330, 0x331,
    )
)

# Lower-case letters with a second spelling.
LETTER_VARIANTS = {
    "µ": "μ", "ſ": "s", "ẛ": "s", "ς": "σ", "ϐ": "β", "ϑ": "θ", "ϕ": "φ", "ϖ": "π", "ϰ": "κ", "ϱ": "ρ", "ϵ": "ε",
}


def _accent_table() -> tuple[str, str]:
    """Lower-case letters made of one ASCII letter and one mark, with that ASCII letter."""
    accented, plain = [], []
    for code in range(0xC0, 0x2000):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if len(parts) == 2 and "a" <= parts[0] <= "z" and unicodedata.combining(parts[1]):
            accented.append(char)
            plain.append(parts[0])
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accent_table()
FOLD_FROM = _ACCENTED + "".join(LETTER_VARIANTS) + DROPPED_MARKS
FOLD_TO = _PLAIN + "".join(LETTER_VARIANTS.values())


def fold(col: Column) -> Column:
    """Lower case without Latin accents."""
    return F.translate(F.lower(col), FOLD_FROM, FOLD_TO)


def strip(col: Column) -> Column:
    """Text without white space at its ends."""
    return F.trim(col, F.lit(WHITE))


def pad(col: Column) -> Column:
    """Padded tokens of a text column; null counts as empty text."""
    spaced = F.concat(F.lit(" "), fold(F.coalesce(col, F.lit(""))), F.lit(" "))
    return F.regexp_replace(spaced, SEPARATORS, "  ")


def token_count(padded: Column) -> Column:
    """Number of tokens in a padded column: two-blank gaps minus one."""
    gaps = F.length(padded) - F.length(F.replace(padded, F.lit("  "), F.lit("")))
    return (gaps / 2).cast("long") - 1


def token_array(padded: Column) -> Column:
    """Tokens of a padded column in order."""
    return F.filter(F.split(padded, " +"), lambda t: t != "")


def fold_value(value: str) -> list[str]:
    """Tokens of one search value (driver side, a few characters long)."""
    table = str.maketrans(dict(zip(FOLD_FROM[: len(FOLD_TO)], FOLD_TO)) | dict.fromkeys(DROPPED_MARKS, ""))
    tokens, current = [], ""
    for char in value.lower().translate(table) + " ":
        kind = unicodedata.category(char)
        if kind[0] in "LN" or kind == "Co":
            current += char
        elif current:
            tokens.append(current)
            current = ""
    return tokens


def needle(tokens: list[str], prefix: bool) -> str:
    """What to look for in a padded column to find these tokens side by side."""
    return " " + "  ".join(tokens) + ("" if prefix else " ")


def can_overlap(wanted: str) -> bool:
    """Whether two occurrences of ``wanted`` may share tokens (``a a`` in ``a a a``)."""
    return any(wanted[-k:] == wanted[:k] for k in range(2, len(wanted)))


def occurrences(padded: Column, wanted: str) -> Column:
    """How often ``wanted`` occurs in a padded column, overlapping ones included."""
    if can_overlap(wanted):
        return F.regexp_count(padded, F.lit("(?=" + wanted + ")")).cast("long")
    rest = F.length(F.replace(padded, F.lit(wanted), F.lit("")))
    return ((F.length(padded) - rest) / len(wanted)).cast("long")
