"""Comparison of query results, under a name that no other test folder uses."""


def same(df, found) -> bool:
    """Rows of a DataFrame and of a DuckDB relation, columns by name, in any order."""
    def rows(data, cols):
        at = sorted(range(len(cols)), key=lambda i: cols[i])
        return sorted(tuple(str(r[i]) for i in at) for r in data)

    return sorted(df.columns) == sorted(found.columns) and rows(df.collect(), df.columns) == rows(found.fetchall(), found.columns)
