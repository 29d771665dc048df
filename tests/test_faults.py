"""The first check that a page fails, with its reason."""

from pyspark.sql import functions as F

from lodestone.operators.ingest import page_fault


def test_pages_fail_at_the_first_check(spark):
    html, text = "h" * 120, "t" * 120
    rows = [
        (0, html, 200, text, "Title", "1", 2, 2, 2), (1, "h" * 119, 500, None, None, None, 0, 0, 0), (2, html, 503, None, None, None, 0, 0, 0), (3, html, 204, "t" * 119, None, None, 0, 0, 0), (4, html, 200, text, " ab ", None, 0, 0, 0),
        (5, html, 200, text, "abc", " ", 0, 0, 0), (6, html, 200, text, "abc", "1", 0, 0, 0), (7, html, 200, text, "abc", "1", 3, 0, 0), (8, html, 200, text, "abc", "1", 3, 2, 1), (9, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "k long, html string, status int, text string, title string, id string, chunks int, kept int, embedded int")
    found = {r["k"]: r["f"] and tuple(r["f"]) for r in df.select("k", page_fault(*map(F.col, df.columns[1:])).alias("f")).collect()}
    assert found == {
        0: None, 1: ("fetch-validate", "HTML response too short (119 < 120)", False), 2: ("fetch-validate", "Unexpected HTTP status code: 503", True), 3: ("parse-validate", "Parsed text too short (119 < 120)", False),
        4: ("parse-validate", "Missing parsed title", False), 5: ("parse-validate", "Missing parsed externalId", False), 6: ("chunk", "Chunking produced zero chunks", False), 7: ("chunk", "All chunks were dropped as duplicates", False),
        8: ("embed-validate", "Embedded chunk count mismatch (1 != 2)", False), 9: ("fetch-validate", "HTML response too short (0 < 120)", False),
    }
