"""Text columns: tickets in text, HTML to text, token estimates, prompt texts."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TICKET_PATTERN = r"\b[A-Z][A-Z0-9]+-\d+\b"  # fixed value


def extract_ticket_ids(text: Column) -> Column:
    """Distinct ticket keys in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TICKET_PATTERN), F.lit(0)))


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


# Entities replaced without leaving the JVM; ``amp`` comes last so that nothing is decoded twice.
PLAIN_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "copy": "\u00a9", "middot": "\u00b7", "nbsp": "\u00a0", "amp": "&"}


@F.pandas_udf(StringType())
def _unescape_any(text: pd.Series) -> pd.Series:
    """The full entity table has over two thousand names."""
    return text.map(html.unescape, na_action="ignore")


def unescape_entities(text: Column) -> Column:
    """Texts with only plain entities stay in the JVM; Python sees null instead of them."""
    rare = text.rlike(f"&(?!({'|'.join(PLAIN_ENTITIES)});)[#a-zA-Z]")
    plain = text
    for name, char in PLAIN_ENTITIES.items():
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(char))
    return F.coalesce(_unescape_any(F.when(rare, text)), plain)


def html_to_text(markup: Column) -> Column:
    """Drop script and style blocks, then tags; unescape; squeeze white space.

    Tags vanish without a space, so words can join, and ``<script`` is matched in lower
    case only.
    """
    bare = F.regexp_replace(markup, r"(?s)<script[^>]*>.*?</script>", "")
    bare = F.regexp_replace(bare, r"(?s)<style[^>]*>.*?</style>", "")
    bare = F.regexp_replace(bare, r"<[^>]+>", "")
    return F.trim(F.regexp_replace(unescape_entities(bare), r"(?U)\s+", " "))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up (code points, where JavaScript counts
    UTF-16 units)."""
    return F.ceil(F.length(text) / 4)


def taxonomy_text(category: Column, description: Column, keywords: Column) -> Column:
    listed = F.when(F.size(keywords) > 0, F.concat(F.lit("Keywords: "), F.array_join(keywords, ", ")))
    return F.concat_ws(
        "\n", F.concat(F.lit("Category: "), category), F.concat(F.lit("Description: "), description), listed
    )


def content_text(title: Column, content: Column, head: int | None = None) -> Column:
    """Title and content, the text to embed; ``head`` limits the content to its first characters."""
    shown = content if head is None else F.substring(content, 1, head)
    return F.concat(F.lit("Title: "), title, F.lit("\n\nContent: "), shown)


def content_summary(index: Column, title: Column, url: Column, content: Column) -> Column:
    """Numbered summary; its labels are fixed output values."""
    return F.concat(
        index, F.lit(". Title: "), title, F.lit("\n   URL: "), url, F.lit("\n   Preview: "), content, F.lit("...")
    )


def words(text: Column) -> Column:
    """Distinct words split on white space."""
    return F.array_distinct(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
