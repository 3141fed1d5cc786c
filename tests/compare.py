"""Rows of Spark and DuckDB results in one form."""


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}" if v != int(v) else str(int(v))
    if hasattr(v, "normalize") and hasattr(v, "as_tuple"):
        return plain(float(v))
    return str(v)


def same(spark_df, relation) -> None:
    columns = sorted(spark_df.columns)
    assert columns == sorted(relation.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in spark_df.collect())
    at = [relation.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[k]) for k in at) for r in relation.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b
