"""Extraction of references, dates, links and fields as column expressions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """First match, null if there is none."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


# Values that must match: years 1990 to 2050, article numbers to 500.


def law_ids(text: Column) -> Column:
    """Distinct ``year/number`` references, years 1990 to 2050, in order."""
    pairs = F.transform(all_matches(text, r"([0-9]{4}[/-][0-9]{2,3})"), lambda x: F.translate(x, "-", "/"))
    year = lambda x: F.substring(x, 1, 4).cast("int")
    number = lambda x: F.substring(x, 6, 3).cast("int")
    return F.array_distinct(F.filter(pairs, lambda x: year(x).between(1990, 2050) & (number(x) >= 1)))


def article_numbers(text: Column, word: str = "article") -> Column:
    """Distinct article numbers 1 to 500, in either word order."""
    after = all_matches(text, rf"(?i){word}\s+([0-9]+)")
    before = all_matches(text, rf"(?i)([0-9]+)\.?\s+{word}")
    found = F.array_distinct(F.concat(after, before))
    return F.filter(found, lambda x: (F.length(x) <= 3) & F.coalesce(x.cast("int").between(1, 500), F.lit(False)))


def article_number(text: Column, word: str = "article") -> Column:
    """Article number of a text or question, null if none; whole numbers beyond 500 do not count."""
    number = F.coalesce(first_match(text, rf"(?i){word}\s*([0-9]+(?:\.[0-9]+)*)"), first_match(text, rf"(?i)([0-9]+(?:\.[0-9]+)*)\s*{word}"))
    plain = number.rlike(r"^[0-9]+$")
    return F.when(~plain | ((F.length(number) <= 3) & (F.lpad(number, 3, "0") <= "500")), number)


#: Separators of a date, the first kind that a text holds wins.
DATE_KINDS = ("--", "..", "yearmonth")
DATE = r"\b20[0-9]{2}(?:-|\.|\s*year\s*)[0-9]{1,2}(?:-|\.|\s*month\s*)[0-9]{1,2}\b"


def iso_date(text: Column) -> Column:
    """First date of the text as yyyy-mm-dd, empty if none: ISO before dotted before worded (``2024 year 5 month 3``).

    One scan finds what looks like a date; the separators of a find tell its
    kind, its figures are the fields.
    """

    def read(found: Column) -> Column:
        figures = F.regexp_extract_all(found, F.lit("[0-9]+"), F.lit(0))
        kind = F.array_position(F.array(*map(F.lit, DATE_KINDS)), F.regexp_replace(found, r"[0-9\s]+", ""))
        short = (kind == 1) & (F.length(found) < 10)  # ISO fields have two figures
        iso = F.concat_ws("-", F.get(figures, F.lit(0)), F.lpad(F.get(figures, F.lit(1)), 2, "0"), F.lpad(F.get(figures, F.lit(2)), 2, "0"))
        return F.struct(F.when((kind > 0) & ~short, kind).alias("kind"), iso.alias("iso"))

    dates = F.filter(F.transform(all_matches(text, DATE, 0), read), lambda d: d["kind"].isNotNull())
    first = F.filter(dates, lambda d: d["kind"] == F.array_min(F.transform(dates, lambda x: x["kind"])))
    return F.coalesce(F.get(first, F.lit(0))["iso"], F.lit(""))


def marker_places(text: Column, marker: str, apart: int = 6) -> Column:
    """Offsets of ``marker`` in the text, without those at most ``apart`` characters after the one before."""

    @F.pandas_udf("array<long>")
    def places(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            found = [m.start() for m in re.finditer(re.escape(marker), text or "")]
            out.append([x for k, x in enumerate(found) if not k or x - found[k - 1] > apart])
        return pd.Series(out)

    return places(text)


def keywords(text: Column, suffix: str, stop: Sequence[str], least: int = 3, most: int = 12) -> Column:
    """The ``most`` frequent terms of a text with their number and rank: runs of ``least`` or more of a-z, 0-9 and full stops, without suffix and stop words; ties by term."""
    word, cut = re.compile(rf"[a-z0-9.]{{{least},}}"), re.compile(suffix)

    @F.pandas_udf("array<struct<term: string, n: long, rank: int>>")
    def counted(texts: pd.Series) -> pd.Series:
        out = []
        for low in texts:
            raw = Counter(word.findall(low or ""))
            terms: Counter[str] = Counter()
            for term, n in raw.items():
                terms[cut.sub("", term)] += n
            best = sorted(((t, n) for t, n in terms.items() if len(t) >= least and t not in stop), key=lambda x: (-x[1], x[0]))[:most]
            out.append([{"term": t, "n": n, "rank": k} for k, (t, n) in enumerate(best, 1)])
        return pd.Series(out)

    return counted(F.lower(text))


def by_precedence(text: Column, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """Value of the first rule whose upper-case marker the text contains."""
    upper, out = F.upper(text), F.lit(default)
    for marker, value in reversed(rules):
        out = F.when(F.contains(upper, F.lit(marker)), value).otherwise(out)
    return out


TRACKING = r"(?i)[?&](utm_[a-z]+|ref|fbclid)=[^&#]*"


def canonical_url(url: Column) -> Column:
    """Without fragment, tracking keys, mobile and www prefixes, index suffixes and closing slash; https; host in lower case."""
    out = F.regexp_replace(url, r"#.*$", "")
    out = F.regexp_replace(F.regexp_replace(out, TRACKING, ""), r"^http:", "https:")
    out = F.regexp_replace(out, r"^https://(www|m)\.", "https://")
    host = F.lower(F.regexp_extract(out, r"^(https://[^/?]+)", 1))
    rest = F.regexp_replace(out, r"^https://[^/?]+", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"\.html?$", ""), r"/+$", "")
    return F.concat(host, rest)


def url_id(url: Column) -> Column:
    """Number of the page: from the query, else from the path; null if neither has one."""
    return F.coalesce(first_match(url, r"[?&](?:id|lawId)=([0-9]+)"), first_match(url, r"^[^?#]*/([0-9]+)(?:[/.?#]|$)"))


def confidence(text: Column) -> Column:
    """What stands after the last colon, clamped to 0..1, if it is a number and ``confidence`` stands before the colon; else 0.5."""
    bare = F.regexp_replace(text, r"\s+$", "")
    value = F.substring_index(bare, ":", -1)
    named = F.endswith(F.lower(F.substring(bare, F.lit(1), F.length(bare) - F.length(value) - 1)), F.lit("confidence"))
    number = F.when(F.trim(value).rlike(r"^[0-9]+(\.[0-9]+)?$"), F.trim(value).cast("double"))
    return F.when(named & number.isNotNull(), F.least(number, F.lit(1.0))).otherwise(F.lit(0.5))
