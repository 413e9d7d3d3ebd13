"""What several tests use."""


def canonical(rows, names):
    """Rows by sorted column name as comparable text."""
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        if isinstance(v, float):
            return "nan" if v != v else repr(round(v, 9) + 0.0)
        if isinstance(v, list | tuple):
            return "[" + ",".join(map(one, v)) + "]"
        return repr(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)
