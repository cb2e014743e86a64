import pytest

from quadrille import Iri, Literal, Namespaces, SyntaxProblem, Variable
from quadrille.plans.syntax import Call, Path, parse_expression, parse_query, parse_triples, parse_update
from quadrille.terms import DECIMAL, DOUBLE, FIRST, INTEGER, NIL, REST, TYPE, Blank

NS = Namespaces({"ex": "http://example.org/"}, base="http://base.org/a/b")
EX = "http://example.org/"


def triples(text):
    return parse_triples(text, NS)


def test_grouping_and_trailing_punctuation():
    got = triples("ex:s a ex:C ; ex:p 1 , 2 ; . ex:t ex:q ex:u .")
    assert got == (
        (Iri(EX + "s"), Iri(TYPE), Iri(EX + "C")),
        (Iri(EX + "s"), Iri(EX + "p"), Literal("1", INTEGER)),
        (Iri(EX + "s"), Iri(EX + "p"), Literal("2", INTEGER)),
        (Iri(EX + "t"), Iri(EX + "q"), Iri(EX + "u")),
    )


@pytest.mark.parametrize("text, kind", [("4", INTEGER), ("-4", INTEGER), ("4.5", DECIMAL), ("4e0", DOUBLE), (".5", DECIMAL), ("1.5E-3", DOUBLE)])
def test_numbers(text, kind):
    assert triples(f"ex:s ex:p {text}")[0][2] == Literal(text, kind)


@pytest.mark.parametrize("text", ["1_000", "0x10", "1j"])
def test_host_numbers_are_refused(text):
    with pytest.raises(SyntaxProblem):
        triples(f"ex:s ex:p {text}")


def test_outer_triple_precedes_nested_ones():
    got = triples("ex:s ex:p [ ex:q 1 ]")
    assert got[0][0] == Iri(EX + "s") and got[0][2] == got[1][0]


def test_collections():
    got = triples("ex:s ex:p (1 (2) ())")
    assert [x[1].value for x in got].count(FIRST) == 4
    assert sum(x[2] == Iri(NIL) for x in got) == 3
    assert sum(x[1] == Iri(REST) for x in got) == 4
    assert triples("ex:s ex:p ()")[0][2] == Iri(NIL)


def test_labelled_blanks_are_shared():
    got = triples("_:b ex:p _:b")
    assert got[0][0] == got[0][2] == Blank("b")


def test_relative_iri_and_strings():
    got = triples("""<c> ex:p "a\\n\\u00e9"@en-GB, '''x'y''', "1"^^ex:t""")
    assert got[0][0] == Iri("http://base.org/a/c")
    assert [x[2] for x in got] == [Literal("a\né", None, "en-GB"), Literal("x'y"), Literal("1", EX + "t")]


def test_errors_carry_the_position():
    with pytest.raises(SyntaxProblem) as e:
        parse_query("SELECT ?s\nWHERE { ?s zz:p ?o }", NS)
    assert (e.value.line, e.value.column) == (2, 12)


@pytest.mark.parametrize(
    "text",
    ["SELECT WHERE { ?s ?p ?o }", "SELECT ?s { ?s ?p }", "FOO", "SELECT ?s { ?s ?p ?o", "SELECT (BOUND(1) AS ?x) {}", "SELECT (NOPE(1) AS ?x) {}", "SELECT (STRLEN() AS ?x) {}", "SELECT * { SERVICE <http://x> {} }"],
)
def test_faults(text):
    with pytest.raises(SyntaxProblem):
        parse_query(text, NS)


def test_load_is_refused():
    with pytest.raises(SyntaxProblem):
        parse_update("LOAD <http://x>", NS)


def test_precedence():
    e = parse_expression("?a || ?b && ?c = 1 + 2 * 3", NS)
    assert e.name == "||" and e.args[1].name == "&&"
    assert e.args[1].args[1].name == "=" and e.args[1].args[1].args[1].name == "+"


def test_not_in_and_ternary():
    assert parse_expression("?a NOT IN (1, 2)", NS).name == "!"
    assert parse_expression("1 IF ?a ELSE 2", NS) == Call("IF", (Variable("a"), Literal("1", INTEGER), Literal("2", INTEGER)))


def test_paths():
    p = triples("?s ex:a/^ex:b|!(a|^ex:c)/(ex:d)*/ex:e+ ?o")[0][1]
    assert isinstance(p, Path) and p.op == "alt" and p.parts[0].op == "seq" and p.parts[1].op == "seq"
    assert p.parts[1].parts[0].op == "not" and p.parts[1].parts[1].op == "*" and p.parts[1].parts[2].op == "+"


def test_update_after_comment_and_prologue():
    found = parse_update("# note\nPREFIX q: <http://q/> INSERT DATA { q:a q:b q:c } ; DELETE WHERE { ?s q:b ?o }", NS)
    assert [u.kind for u in found] == ["MODIFY", "MODIFY"] and found[1].delete == found[1].delete


def test_computed_terms():
    got = triples("e<http://e/{?id}> ex:p e{ ?v * 2 } ; ex:q ex:{?id} ; ex:r _:{?a, ?b}")
    assert got[0][0].name == "iri_encoded" and got[0][2].name == "expression"
    assert got[1][2].name == "iri_plain" and got[2][2].name == "keyed_blank"
