"""Prefixes and the base IRI: host-side values that compilers take."""

from __future__ import annotations

import importlib
import re
from types import MappingProxyType
from urllib.parse import urljoin

from .terms import RDF, XSD

_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


class Namespaces:
    """An immutable prefix table with an optional base; changes give a new one."""

    def __init__(self, prefixes: dict[str, str] | None = None, base: str | None = None):
        self.prefixes = MappingProxyType({"rdf": RDF, "xsd": XSD} | dict(prefixes or {}))
        self.base = base

    def bind(self, prefix: str, iri: str, override: bool = True) -> Namespaces:
        if not override and prefix in self.prefixes:
            return self
        return Namespaces(dict(self.prefixes) | {prefix: self.resolve(iri)}, self.base)

    def with_base(self, base: str) -> Namespaces:
        return Namespaces(dict(self.prefixes), self.resolve(base))

    def merged(self, other: Namespaces, override: bool = False) -> Namespaces:
        """Both tables; this one's entries win unless ``override``."""
        first, second = (self, other) if override else (other, self)
        return Namespaces(dict(first.prefixes) | dict(second.prefixes), self.base or other.base)

    def resolve(self, iri: str) -> str:
        """An absolute IRI as it is, a relative one against the base."""
        return iri if _SCHEME.match(iri) or not self.base else urljoin(self.base, iri)

    def expand(self, prefix: str, local: str) -> str:
        if prefix not in self.prefixes:
            raise KeyError(prefix)
        return self.prefixes[prefix] + local

    def shorten(self, iri: str) -> str | None:
        """prefix:local for the longest namespace that leaves a plain local name."""
        found = [(len(n), p) for p, n in self.prefixes.items() if iri.startswith(n) and re.fullmatch(r"[A-Za-z_][\w-]*", iri[len(n) :])]
        if not found:
            return None
        size, prefix = max(found)
        return f"{prefix}:{iri[size:]}"

    @classmethod
    def from_module(cls, module: str, *names: str) -> Namespaces:
        """Prefixes of a Python module: its ``__namespaces__`` table, else attributes of those names."""
        found = importlib.import_module(module)
        table = dict(getattr(found, "__namespaces__", {}))
        for name in names:
            if name not in table:
                value = getattr(found, name.upper(), None) or getattr(found, name, None)
                if value is None:
                    raise ImportError(f"{module} has no prefix {name}")
                table[name] = str(value)
        return cls({k: v for k, v in table.items() if not names or k in names})

    def __eq__(self, other) -> bool:
        return isinstance(other, Namespaces) and (dict(self.prefixes), self.base) == (dict(other.prefixes), other.base)

    def __hash__(self) -> int:
        return hash((tuple(sorted(self.prefixes.items())), self.base))
