"""The library's queries; ``load`` registers them in the catalogue."""

from importlib import import_module

MODULES = ("relational", "graph", "citations", "mentions", "made", "files", "maintenance", "more", "streams")


def load() -> None:
    for name in MODULES:
        import_module(f"lexloom.plans.{name}")
