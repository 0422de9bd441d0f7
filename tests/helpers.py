import os

import duckdb


def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def rows_of(pdf):
    cols = sorted(pdf.columns)
    pdf = pdf[cols].astype(object)
    return cols, sorted(map(repr, pdf.where(pdf.notna(), None).values.tolist()))


def same_rows(spark, query, sql, sf):
    """The query and its SQL give the same columns and rows, in any order."""
    a, b = rows_of(query(spark, sf).toPandas()), rows_of(duck(sf).sql(sql).df())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    wrong = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
    assert not wrong, wrong[:3]
