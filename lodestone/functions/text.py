"""Text cleaning as column expressions; a chain of them runs in one stage.

Pattern lists are parameters: their defaults are examples for the languages of
the test tables.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Header and footer phrases, masks of personal data, risk patterns and injection patterns.
BOILERPLATE = (
    r"(?i)licensed under the [a-z]+ license, version [0-9.]+\.?",
    r"(?i)all rights reserved\.?",
    r"(?i)copyright \(c\) [0-9]{4}[^\n]*",
    r"(?i)print page",
)
MASKS = (
    (r"\+?[0-9]{1,3}[ -]?\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}", "[PHONE]"),
    (r"\b[0-9]{3}-[0-9]{4}\b", "[PHONE]"),
    (r"\b[A-Z]{2}[0-9]{8}\b", "[ID]"),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
)
RISKS = (
    r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}",
    r"\b[89][0-9]{7}\b",
    r"\b[0-9]{9,16}\b",
    r"(?i)\b[A-Z]{2}[0-9]{8}\b",
    r"(?i)(account number|phone number|email)",
)
INJECTIONS = (
    r"(?i)ignore\s+(previous|above|all)\s+instructions",
    r"(?i)you\s+are\s+now",
    r"(?i)reveal\s+(your|the)\s+(system|original)\s+prompt",
    r"(?i)disregard\s+(previous|all)",
)


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse_space(text: Column) -> Column:
    """White space runs become one blank; none at the ends."""
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def collapse_lines(text: Column) -> Column:
    """As ``collapse_space`` within each line; at most one empty line in a row."""
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1), collapse_space)
    return trim_space(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def normalize_text(text: Column, respace_punctuation: bool = True) -> Column:
    """NFC, no invisible marks, plain blanks, folded quotes and, unless switched off, one blank after full stops and colons.

    Respacing parts the digits of ``14.7``; chunking by clause numbers switches it off.
    """
    out = F.regexp_replace(nfc(text), " ", " ")
    out = collapse_lines(F.regexp_replace(out, "[​‌‍﻿]", ""))
    out = F.regexp_replace(F.regexp_replace(out, "[«»“”]", '"'), "[‘’]", "'")
    if respace_punctuation:
        out = F.regexp_replace(F.regexp_replace(out, r"\s*\.\s*", ". "), r"\s*:\s*", ": ")
        out = F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), r"\n\s+\n", "\n\n")
    return out


def truncate_text(text: Column, most: int = 200) -> Column:
    """Cut to ``most`` characters, the last three of them an ellipsis."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def strip_html(html: Column) -> Column:
    """Without script, style, form, navigation, header and footer blocks, comments and tags."""
    out = html
    for block in ("script", "style", "form", "nav", "header", "footer"):
        out = F.regexp_replace(out, rf"(?is)<{block}[^>]*>.*?</{block}>", " ")
    return F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"<[^>]*>", "")


def remove_patterns(text: Column, patterns: Sequence[str] = BOILERPLATE) -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, "")
    return text


def mask(text: Column, masks: Sequence[tuple[str, str]] = MASKS) -> Column:
    """Personal data replaced by placeholders, in the order of ``masks``."""
    for pattern, placeholder in masks:
        text = F.regexp_replace(text, pattern, placeholder)
    return text


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | text.rlike(pattern)
    return found


def has_personal_data(text: Column, patterns: Sequence[str] = RISKS) -> Column:
    return matches_any(text, patterns)


def has_injection(text: Column, patterns: Sequence[str] = INJECTIONS) -> Column:
    return matches_any(text, patterns)


def truncate_at_sentence(text: Column, most: int) -> Column:
    """Cut after the last sentence mark in the second half, else at the last blank beyond 40 %, else at ``most``."""
    head = F.substring(text, 1, most)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?\n\x{3002}])", 1)
    words = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    cut = (
        F.when(F.length(sentence) - 1 > most * 0.5, sentence)
        .when(F.length(words) > most * 0.4, words)
        .otherwise(head)
    )
    return F.when(F.length(text) <= most, text).otherwise(trim_space(cut))


def snippet(text: Column) -> Column:
    return truncate_at_sentence(text, 240)


def clean(text: Column) -> Column:
    """Boilerplate out, personal data masked, white space collapsed, of any length."""
    return collapse_space(mask(remove_patterns(text)))


def sanitize(text: Column, most: int) -> Column:
    """``clean``, cut at a sentence."""
    return truncate_at_sentence(clean(text), most)


#: Line filters and inline replacements for scanned text.
NOISE_LINES = (r"^\s*[#*=_|-]+\s*$", r"^\s*[0-9]+\s*$", r"(?i)^\s*page [0-9]+( of [0-9]+)?\s*$")
NOISE_INLINE = (r"[#*$%&|<>]{3,}", r"(?i)\[image[^\]]*\]")


def strip_noise(text: Column, lines: Sequence[str] = NOISE_LINES, inline: Sequence[str] = NOISE_INLINE) -> Column:
    """Drop noise lines, then noise within lines, then lines that became blank."""

    def without(line: Column) -> Column:
        for pattern in inline:
            line = F.regexp_replace(line, pattern, "")
        return collapse_space(line)

    kept = F.filter(F.split(text, "\n", -1), lambda line: ~matches_any(line, lines))
    return F.array_join(F.filter(F.transform(kept, without), lambda line: line != ""), "\n")


def has_letters_of(text: Column, letters: str) -> Column:
    return text.rlike(f"[{letters}]")


def has_mojibake(text: Column) -> Column:
    """Letters left by UTF-8 read as a one-byte encoding."""
    return text.rlike("[ÃÂÐÑ][\u0080-¿]")


def tokens_by_chars(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def tokens_by_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))).cast("long")


def stable_uuid(text: Column) -> Column:
    """First 32 hex digits of SHA-256 with the version (4) and variant (8 to b) nibbles forced."""
    h = F.sha2(text, 256)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8
    variant = F.lower(F.conv(nibble.cast("string"), 10, 16))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )
