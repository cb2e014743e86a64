"""A Spark-native engine for RDF data: templates, patterns and SPARQL over DataFrames.

Names load on first use, so that Python workers of other subpackages stay small.
"""

import importlib

_HOMES = {
    "namespaces": ("Namespaces",),
    "operators.bindings": ("Bindings",),
    "operators.coercion": ("Coercion",),
    "operators.graph": ("Dataset", "Graph", "Match", "Prepared", "Result", "column", "evaluate"),
    "operators.template": ("Template",),
    "plans.syntax": ("Path", "SyntaxProblem", "parse_path"),
    "sources.mapping": ("Mapping", "Property", "Table"),
    "terms": ("ANY", "Blank", "Iri", "Literal", "Variable"),
}
_WHERE = {name: home for home, names in _HOMES.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"{__name__}.{_WHERE[name]}"), name)
