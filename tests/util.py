def canonical(rows, columns):
    """Rows as texts, columns by name, so that engines' number types don't matter."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if isinstance(x, float) and x.is_integer():
            x = int(x)
        return str(x)

    return sorted(str([value(r[i]) for i in order]) for r in rows)


def same_rows(df, con, sql):
    relation = con.sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(relation.fetchall(), relation.columns)
