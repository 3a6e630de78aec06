"""A DataFrame against SQL, whatever the order of rows and columns."""


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 6) + 0.0)
    return repr(value)


def assert_same(df, con, sql):
    rows, relation = df.collect(), con.sql(sql)
    names = [d[0] for d in relation.description]
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in rows)
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in relation.fetchall())
    assert mine == theirs
