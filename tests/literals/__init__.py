"""Queries over literal rows."""

from loomtext.plans.catalog import table  # noqa: F401

CASES: dict[str, tuple] = {}


def query(oracle: str):
    def keep(f):
        CASES[f.__name__] = (f, oracle.strip())
        return f

    return keep
