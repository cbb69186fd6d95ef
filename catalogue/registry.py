"""Collects the queries of one catalogue module."""


def registry():
    """The module's query and SQL tables, and the decorator that fills them."""
    queries, oracles = {}, {}

    def query(sql: str | None = None):
        def register(fn):
            queries[fn.__name__] = fn
            if sql is not None:
                oracles[fn.__name__] = sql
            return fn

        return register

    return queries, oracles, query
