def rows(df, *order):
    """Rows as tuples, sorted."""
    columns = order or df.columns
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: tuple(str(x) for x in t))


def one(df):
    found = df.collect()
    assert len(found) == 1
    return found[0]
