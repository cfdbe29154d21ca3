"""The registered queries: every operator over the given tables, each with the SQL that must agree."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def load():
    from catalog import audits, evaluation, federation, functions, jobs, lineage, normalising, projection, stores  # noqa: F401

    return QUERIES, ORACLES
