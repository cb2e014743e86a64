import datetime
import decimal

import pytest

from quadrille import ANY, Blank, Iri, Literal, Namespaces
from quadrille.operators.isomorphism import isomorphic
from quadrille.terms import BOOLEAN, DATE, DATETIME, DECIMAL, DOUBLE, INTEGER, blank_label, dtype, langtag, node


@pytest.mark.parametrize(
    "value, kind",
    [(1, INTEGER), (True, BOOLEAN), (1.5, DOUBLE), (decimal.Decimal("1.5"), DECIMAL), ("x", None), (datetime.date(2020, 1, 2), DATE), (datetime.datetime(2020, 1, 2), DATETIME)],
)
def test_host_values(value, kind):
    assert node(value).datatype == kind


def test_none_is_refused():
    for f in (node, langtag, dtype):
        with pytest.raises(TypeError):
            f(None)


def test_terms_pass_through():
    for t in (Iri("http://x"), Blank("b"), Literal("x", None, "en")):
        assert node(t) is t
    assert dtype(Iri("http://d")) == "http://d" and langtag("en") == "en" and repr(ANY) == "ANY"


def test_n3():
    assert Literal('a"\n\\', None, "en").n3() == '"a\\"\\n\\\\"@en'
    assert Literal("1", INTEGER).n3().endswith("integer>") and Iri("http://x").n3() == "<http://x>"


def test_keyed_labels():
    assert blank_label(Blank("z")) == "z" and blank_label("ok-1") == blank_label(Literal("ok-1"))
    given = [5, "5", 5.0, ("a", "bc"), ("ab", "c"), "it's x", 'a" "b', ("a", "b"), True, "true"]
    assert len({blank_label(x) for x in given}) == len(given)
    assert blank_label(1e20) == blank_label(Literal("1.0E20", DOUBLE)) and blank_label(1e-5) == blank_label(Literal("1.0E-5", DOUBLE))


def test_namespaces():
    ns = Namespaces({"ex": "http://e/"}, base="http://b/c/d")
    assert ns.resolve("x") == "http://b/c/x" and ns.resolve("http://y") == "http://y"
    assert ns.shorten("http://e/a") == "ex:a" and ns.shorten("http://e/a/b") is None
    assert ns.bind("ex", "http://f/", override=False) is ns
    changed = ns.bind("ex", "http://f/")
    assert ns.expand("ex", "a") == "http://e/a" and changed.expand("ex", "a") == "http://f/a"
    assert ns.merged(Namespaces({"ex": "http://g/", "q": "http://q/"})).prefixes["ex"] == "http://e/"


def test_prefixes_of_a_module(tmp_path, monkeypatch):
    (tmp_path / "voc.py").write_text("EX = 'http://e/'\n__namespaces__ = {'q': 'http://q/'}\n")
    monkeypatch.syspath_prepend(tmp_path)
    assert Namespaces.from_module("voc", "q", "ex").prefixes["ex"] == "http://e/"
    with pytest.raises(ImportError):
        Namespaces.from_module("voc", "nope")


def test_isomorphism():
    p, a, b, c = Iri("http://p"), Blank("a"), Blank("b"), Blank("c")
    assert isomorphic([(a, p, b), (b, p, a)], [(c, p, a), (a, p, c)])
    assert not isomorphic([(a, p, b), (b, p, a)], [(a, p, a), (b, p, b)])
    assert not isomorphic([(a, p, Literal("1"))], [(a, p, Literal("2"))])
