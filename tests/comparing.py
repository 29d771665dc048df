"""Comparison of Spark results with DuckDB relations."""


def plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, float):
        return repr(round(value, 8)).removesuffix(".0")
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def compare(df, relation):
    """Rows of a Spark result against those of a DuckDB relation, as multisets with columns by name."""
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    got = sorted(tuple(plain(row[n]) for n in names) for row in df.collect())
    at = [relation.columns.index(n) for n in names]
    want = sorted(tuple(plain(row[i]) for i in at) for row in relation.fetchall())
    assert got == want
