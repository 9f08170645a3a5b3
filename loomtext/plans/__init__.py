"""Query catalogue: modules of registered queries by kind."""

from importlib import import_module

MODULES = ("counts", "filters", "words", "scalars", "sequences", "corpora", "models", "knowledge", "extras", "details", "records", "arcs", "places", "blocks", "shapes")


def load_all() -> None:
    for m in MODULES:
        import_module(f"loomtext.plans.{m}")
