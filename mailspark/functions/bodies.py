"""Readable message bodies from plain text and HTML, as column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mailspark.functions.text import strip

# Elements that stand apart with a blank line.
PARAGRAPH_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "table")

# Elements that start a new line.
LINE_TAGS = (
    "br", "hr", "div", "tr", "section", "article", "header", "footer", "aside", "main", "nav", "figure",
    "figcaption", "caption", "address", "dl", "dt", "dd", "fieldset", "form",
)

# Elements dropped together with their content.
HIDDEN_TAGS = ("script", "style", "title")

# Tags become one control character each while text is cleaned; control characters of the input
# are removed first and entities never decode to one.
LINE, PARAGRAPH, BULLET, CELL, INLINE = "\x01", "\x02", "\x03", "\x04", "\x05"
BREAKS = LINE + PARAGRAPH + BULLET

BLANKS = r"[ \t\n\r\f\x0B\p{Zs}]"
CONTROLS = r"[\x00-\x08\x0E-\x1F\x7F-\x9F]"
INVISIBLE = r"[\p{Cf}\x{034F}]"


def tag_pattern(names: tuple[str, ...], opening: str = "/?") -> str:
    return rf"(?i)<\s*{opening}(?:{'|'.join(names)})(?:[ \t\n/][^>]*)?>"


# Replacements in order: markup to marker characters.
TO_MARKERS = [
    (r"\r\n?", "\n"),
    (CONTROLS, ""),
    (r"(?s)<!--.*?(?:-->|\z)", ""),
    *[(rf"(?is)<{name}.*?(?:</{name}>|\z)", "") for name in HIDDEN_TAGS],
    (r"<[^>]*\z", ""),
    (tag_pattern(("li",), opening=""), BULLET),
    (tag_pattern(("li",), opening="/"), LINE),
    (tag_pattern(("td", "th")), CELL),
    (tag_pattern(PARAGRAPH_TAGS), PARAGRAPH),
    (tag_pattern(LINE_TAGS), LINE),
    (r"<[^>]*>", INLINE),
]

# Replacements in order: runs of blanks and markers to the text between two words.
FROM_MARKERS = [
    (INVISIBLE + "|" + INLINE, ""),
    (BLANKS + "+", " "),
    (rf"[ {CELL}]*([{BREAKS}])[ {CELL}]*", "$1"),
    (rf"[ {CELL}]+", " "),
    (rf"^ |[ {BREAKS}]+\z", ""),
    (rf"^[{LINE}{PARAGRAPH}]*{BULLET}[{BREAKS}]*", "• "),
    (rf"^[{LINE}{PARAGRAPH}]+", ""),
    (
        rf"[{LINE}{BULLET}]*{PARAGRAPH}[{LINE}{PARAGRAPH}]*{BULLET}[{BREAKS}]*"
        rf"|[{LINE}]*{BULLET}[{LINE}{BULLET}]*{PARAGRAPH}[{BREAKS}]*",
        "\n\n• ",
    ),
    (rf"{LINE}*{BULLET}[{LINE}{BULLET}]*", "\n• "),
    (rf"{LINE}*{PARAGRAPH}[{LINE}{PARAGRAPH}]*", "\n\n"),
    (rf"{LINE}+", "\n"),
]

# Replacements in order for plain text.
PLAIN_STEPS = [
    (r"\r\n?", "\n"),
    (r"\p{Zs}", " "),
    (CONTROLS + "|" + INVISIBLE, ""),
    (r"[ \t]+(\n|\z)", "$1"),
    (r"\n{3,}", "\n\n"),
]


def _apply(col: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, replacement in steps:
        col = F.regexp_replace(col, pattern, replacement)
    return col


@F.pandas_udf(StringType())
def _decode_entities(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def html_to_text(col: Column) -> Column:
    """Readable text of an HTML body: blocks on their own lines, list bullets, decoded entities.

    Entity decoding is the one step without a Spark function; it is an Arrow-batched UDF, and only rows with ``&`` reach it. Each row
    takes one of two branches, so the steps before are computed once.
    """
    encoded = col.contains("&")
    marked = _apply(F.coalesce(col, F.lit("")), TO_MARKERS)
    return _apply(F.when(encoded, _decode_entities(F.when(encoded, marked))).otherwise(marked), FROM_MARKERS)


def clean_plain(col: Column) -> Column:
    """Plain text with unified line ends, no invisible characters, at most one blank line in a row."""
    return strip(_apply(F.coalesce(col, F.lit("")), PLAIN_STEPS))


def readable_body(text: Column, html_body: Column, snippet: Column) -> Column:
    """Clean text, else the HTML part as text, else the snippet.

    Text with a letter, digit or sign is never empty when cleaned: its HTML part is not looked at.
    """
    needed = F.when(F.coalesce(text.rlike(r"[\p{L}\p{N}\p{P}\p{S}]"), F.lit(False)), F.lit(None)).otherwise(html_body)
    return F.coalesce(
        F.nullif(clean_plain(text), F.lit("")),
        F.nullif(html_to_text(needed), F.lit("")),
        clean_plain(snippet),
    )
