"""Queries over the test tables, each with its DuckDB counterpart where SQL can express it."""

from importlib import import_module

_MODULES = [
    "conversations", "corpus", "vectors", "retrieval", "routing", "citations", "web", "logs",
    "evaluation", "answers", "documents", "streams", "stores",
]


def _merged(attribute: str) -> dict:
    modules = [import_module(f"{__name__}.{name}") for name in _MODULES]
    return {key: value for module in modules for key, value in getattr(module, attribute).items()}


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict[str, str]:
    return _merged("ORACLES")
