"""Column functions on single texts."""

import pytest
from pyspark.sql import functions as F

from pairwright.functions import answers, formula, identity, rules
from pairwright.functions.profile import describe


def profile(text, **kw):
    return describe(text, kw.get("depth", 4), kw.get("size", 5), kw.get("empty", True), kw.get("known"))


def test_spellings(one):
    assert one(formula.to_ascii, " ⟨⟨a⟩⟩ □ (p ⇒ ◇ ~q ∧ r \\/ s) ") == "<<a>> G (p -> F !q & r | s)"
    assert one(formula.to_printed, "<<a>> G (!p -> q | r)") == "⟨⟨a⟩⟩ G (¬p → q ∨ r)"


def test_components(one):
    f = "⟨⟨b, a⟩⟩ G (p → ⟨⟨c⟩⟩ F done_1)"
    assert one(formula.agents, f) == ["a", "b", "c"]
    assert one(formula.agents, "p") == []
    assert one(formula.first_coalition, "<<b, a>> G p") == ["b", "a"]
    assert one(formula.first_coalition, "G p") == []
    assert one(formula.temporal_operators, f) == ["G", "F", "->"]
    assert one(formula.temporal_operators, "FLAG (x)") == ["G"]
    assert one(formula.atoms, f) == ["done_1", "p"]
    assert one(formula.atoms, "<<a>> G (True and not x implies y)") == ["x", "y"]
    assert one(lambda c: formula.operators(c, "boundary"), "Goal & G(p)") == ["G", "&"]
    assert one(lambda c: formula.operators(c, "substring"), "Goal & p") == ["G", "&"]
    assert one(formula.identifiers, "<<ab>> G(p & p)") == ["ab", "p", "p"]


@pytest.mark.parametrize(
    "text,name",
    [
        ("<<a>> G(F(p))", "recurrence"), ("<<a>> F(G(p))", "persistence"), ("<<a>> G(p -> F(q))", "response"),
        ("<<a>> (p U q)", "until"), ("<<a>> G(!p)", "safety"), ("<<a>> G(p)", "invariant"), ("<<a>> F(p)", "liveness"),
        ("p", "unknown"),
    ],
)
def test_pattern(one, text, name):
    assert one(formula.pattern, text) == name


def test_same_formula(one):
    assert one(formula.same_formula, "⟨⟨A⟩⟩ G p", "<<a>>G  P")
    assert not one(formula.same_formula, "<<a>> G p", "<<a>> F p")


def test_domain_ties_go_to_the_earlier_one(one):
    # controller is a word of two domains
    assert one(identity.domain_of, "a controller", "") == "autonomous_systems"
    assert one(identity.domain_of, "valve and controller", "") == "industrial_control"
    assert one(identity.domain_of, "nothing", "here") == "generic"
    # substrings count by default
    assert one(identity.domain_of, "the farmer", "") == "robotics"
    assert one(lambda a, b: identity.domain_of(a, b, whole_words=True), "the farmer", "") == "generic"


def test_ids(one):
    import hashlib

    want = hashlib.sha256("a statement|<<a>> G p".encode()).hexdigest()[:12]
    assert one(identity.content_id, " A Statement ", "<<a>> G p ") == want


def test_quick_rules(one):
    assert one(rules.formula_errors, "<<a>> G(p -> q)") == []
    assert one(rules.formula_errors, "  ") == ["Empty formula"]
    assert one(rules.formula_errors, "<a> p (") == [
        "No coalition operator <<agents>> found", "No temporal operators found", "Unbalanced parentheses",
    ]
    # an arrow is no bracket
    assert one(rules.formula_errors, "<<a>> G(p) -> F(q)") == []


def test_structure_rules(one):
    got = one(rules.check_structure, "<<a, b>> G (p1 -> F q2)")
    assert got.valid and got.agents == ["a", "b"] and got.atoms == ["p1", "q2"] and got.depth == 2
    bad = one(rules.check_structure, "<<a>>")
    assert not bad.valid and bad.errors == ["Formula ends with coalition operator - missing temporal formula"] and bad.atoms is None
    assert one(rules.check_structure, "⟨⟨⟩⟩ G F p").warnings == [
        "Empty coalition (grand coalition assumed)", "Consecutive temporal operators without operand",
    ]


@pytest.mark.parametrize(
    "text,depth,ops,shown",
    [
        ("<<a>> G p", 1, ["G"], "⟨⟨a⟩⟩ G p"),
        ("<<b,a>> G (p -> F q)", 2, ["G", "F"], "⟨⟨a,b⟩⟩ G (p → F q)"),
        ("<<a>> (p U q)", 2, ["U"], "⟨⟨a⟩⟩ (p U q)"),
        ("<<a>> G p & q", 1, ["G"], "⟨⟨a⟩⟩ G (p ∧ q)"),
        ("!(p | q) & r", 0, [], "(¬((p ∨ q)) ∧ r)"),
        ("p -> q -> r", 0, [], "((p → q) → r)"),
        ("<<a>> G Goal", 1, ["G"], "⟨⟨a⟩⟩ G Goal"),
        ("<<2,x>> F true", 1, ["F"], "⟨⟨x,2⟩⟩ F ⊤"),
    ],
)
def test_profile(text, depth, ops, shown):
    got = profile(text)
    assert got["valid"], got["errors"]
    assert (got["depth"], got["operators"], got["normalised"]) == (depth, ops, shown)


def test_profile_limits():
    assert profile("<<a>> G F G F G p")["errors"] == ["Nesting depth 5 exceeds maximum 4"]
    assert profile("<<a,b,c>> G p", size=2)["errors"] == ["Coalition size 3 exceeds maximum 2"]
    assert profile("<<>> G p")["warnings"] == ["Coalition has empty agent set"]
    assert not profile("<<>> G p", empty=False)["valid"]
    assert profile("<<a,z>> G p", known=frozenset("a"))["errors"] == ["Unknown agents: z"]
    for text in ["", "<<a>>", "<<a>> p", "(p", "p q", "p &", "1p", "a # b", None, "(" * 5000]:
        got = profile(text)
        assert not got["valid"] and got["errors"][0].startswith("Parse error"), text


def test_answers(one):
    assert one(answers.formula_candidates, "```atl\n<<a>> G p\n```") == ["<<a>> G p", "<<a>> G p"]
    assert one(answers.formula_candidates, "Answer: p.") == ["p"]
    assert one(lambda c: answers.clean_answer(c, "single_colon"), "ATL: <<a>> G p") == "<<a>> G p"
    assert one(lambda c: answers.clean_answer(c, "fence_edges"), "```atl\n<<a>> G p\n```") == "<<a>> G p"
    assert one(lambda c: answers.clean_answer(c, "fence_edges"), "no formula") is None
    assert one(answers.list_items, "1. one\n2) two\n\n5G three") == ["one", "two", "5G three"]
    assert one(lambda c: answers.list_items(c, bare_numbers=True), "5G three") == ["G three"]
    assert one(lambda c: answers.list_items(c, first=1), "1. one\n2. two") == ["one"]


def test_verdicts(one):
    v = one(answers.verdict, 'so: {"verdict": "accept", "confidence": 0.9} ok')
    assert (v.verdict, v.confidence, v.issues, v.parse_failed) == ("ACCEPT", 0.9, [], False)
    v = one(lambda c: answers.verdict(c, "NEEDS_REVIEW", unparsed_confidence=0.5), "nothing")
    assert (v.verdict, v.confidence, v.issues) == ("NEEDS_REVIEW", 0.5, ["Could not parse response"])
    # a nested object is out of reach of the flat match: the inner one is found
    v = one(answers.verdict, '{"verdict": "ACCEPT", "more": {"confidence": 0.1}}')
    assert v.verdict == "REJECT"
    s = one(answers.semantic_check, '```json\n{"matches": true, "confidence": 0.7}\n```')
    assert s.matches and s.confidence == 0.7 and not s.parse_failed
    s = one(answers.semantic_check, "sorry")
    assert not s.matches and s.confidence == 0.0 and s.parse_failed
    c = one(answers.critique, '{"ok": false, "suggested_fix": "<<a>> G p"}')
    assert not c.ok and c.suggested_fix == "<<a>> G p"


def test_list_items_of_odd_lines(one):
    text = " \n\t1. one \r\n\n  \x0b\n2) 'two'\n 3.\n-4: x\n5G\n7 . y\n* \"z\"  \n1. 2. w\n "
    assert one(answers.list_items, text) == ["one", "'two'", "-4: x", "5G", "7 . y", '* "z"', "2. w"]
    assert one(lambda c: answers.list_items(c, bullets=True, quotes=True), text) == ["one", "two", "4: x", "5G", "7 . y", "z", "2. w"]
    assert one(lambda c: answers.list_items(c, original=F.lit("5G"), min_length=3), text) == ["'two'", "-4: x", "7 . y", '* "z"', "2. w"]
    assert one(lambda c: answers.list_items(c, original=F.lit(None).cast("string")), text) == []
    assert one(answers.list_items, None) is None
    assert one(answers.list_items, "") == []
