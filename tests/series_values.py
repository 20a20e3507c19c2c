"""Plain views of the fixture rows."""


def values_of(rows, member):
    return [r[2] for r in rows if r[0] == member]
