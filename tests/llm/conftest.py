import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

#: Columns whose names operators use themselves.
CLASHING = ("score", "tag", "shard", "keep", "known", "doc", "kept", "matches", "a", "b", "kept_id", "kept_tag", "place", "n_words", "rule_kept", "rule_n_words")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
LONG = " ".join(f"w{i}" for i in range(30_000))
PARAGRAPH = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew strong coffee under a pale moon tonight"


def rows_of(texts):
    return [(i, t, "en", "s", None if t is None else len(t), *CLASHING) for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names operators use."""
    texts = [
        (1, None), (2, ""), (3, "  \n\t\n "), (None, PARAGRAPH), (None, None), (5, PARAGRAPH), (5, PARAGRAPH), (5, PARAGRAPH + " more"),
        (6, LONG), (7, LONG), (8, "a"), (9, PARAGRAPH + "\n" + PARAGRAPH), (10, "É à ü\n" + PARAGRAPH.upper()),
    ]
    return spark.createDataFrame(rows_of(texts), DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
