"""Tables and comparisons that all tests share."""

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


def rows_of(names, rows):
    """Rows as a sorted list of texts, columns by name; floats to nine digits."""

    def cell(x):
        return round(x, 9) if isinstance(x, float) else x

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([cell(r[i]) for i in order]) for r in rows)


def same_rows(df, con, sql):
    """Hold a Spark result against a DuckDB statement: names, then rows in any order."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, found.fetchall())
