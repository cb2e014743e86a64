"""Equality of small graphs up to the names of blank nodes; for tests."""

from __future__ import annotations

import hashlib

from ..terms import Blank


def _colours(triples, rounds: int) -> dict:
    colour = {t: "" for x in triples for t in x if isinstance(t, Blank)}
    say = lambda t: colour[t] if isinstance(t, Blank) else t.n3()
    for _ in range(rounds):
        near: dict = {b: [] for b in colour}
        for s, p, o in triples:
            if isinstance(s, Blank):
                near[s].append(f"> {p.n3()} {say(o)}")
            if isinstance(o, Blank):
                near[o].append(f"< {p.n3()} {say(s)}")
        colour = {b: hashlib.md5((colour[b] + "|" + "\n".join(sorted(n))).encode()).hexdigest() for b, n in near.items()}
    return colour


def isomorphic(a, b) -> bool:
    """Whether some renaming of blank nodes makes the two sets of triples equal."""
    a, b = set(a), set(b)
    if len(a) != len(b):
        return False
    rounds = 1 + max(len({t for x in g for t in x if isinstance(t, Blank)}) for g in (a, b)) if a else 1
    left, right = _colours(a, rounds), _colours(b, rounds)
    if sorted(left.values()) != sorted(right.values()):
        return False
    order = sorted(left, key=lambda t: (list(left.values()).count(left[t]), left[t]))

    def extend(i: int, names: dict) -> bool:
        if i == len(order):
            return {tuple(names.get(t, t) for t in x) for x in a} == b
        for other, c in right.items():
            if c == left[order[i]] and other not in names.values() and extend(i + 1, {**names, order[i]: other}):
                return True
        return False

    return extend(0, {})
