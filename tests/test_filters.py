import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecframe.plans import filters as f
from vecframe.plans.filters import Filter
from vecframe.plans.querylang import QuerySyntaxError, parse


@pytest.mark.parametrize("node, text", [
    (~~Filter.tag("shelf").eq("north"), "--@shelf:{north}"),
    (Filter.geo("harbour").within_radius(12.5, -3.25, 40, "m"), "@harbour:[12.5 -3.25 40 m]"),
    (Filter.text("label").prefix("over"), "@label:over*"),
    (Filter.text("label").match("half-open"), "@label:half\\-open"),
    (Filter.text("label").phrase('the "third" door'), '@label:"the \\"third\\" door"'),
    (Filter.numeric("depth").lt(-2), "@depth:[-inf (-2]"),
    (Filter.numeric("depth").lte(-2), "@depth:[-inf -2]"),
    (Filter.numeric("depth").gt(0.125), "@depth:[(0.125 +inf]"),
    (Filter.numeric("depth").between(1, 3.5, False), "@depth:[(1 3.5]"),
    (Filter.tag("shelf").isin("upper left", "semi-dry", "x"), "@shelf:{upper\\ left|semi\\-dry|x}"),
    ((Filter.text("label").match("oak") | Filter.numeric("depth").lte(7)) & ~Filter.tag("shelf").eq("upper left") & Filter.geo("harbour").within_radius(0, 0, 1.5, "ft"),
     "(@label:oak | @depth:[-inf 7]) -@shelf:{upper\\ left} @harbour:[0 0 1.5 ft]"),
])
def test_rendering_and_back(node, text):
    assert node.render() == text
    assert parse(text).render() == text


@pytest.mark.parametrize("bad", [
    lambda: Filter.numeric("depth").lt(math.inf * 0), lambda: Filter.numeric("depth").between(3, 2.5), lambda: Filter.tag("shelf").eq("\t"), lambda: Filter.tag("shelf").isin(),
    lambda: Filter.geo("x").within_radius(4, 5, -1, "km"), lambda: Filter.geo("x").within_radius(1, 2, 1, "league"), lambda: Filter.all(Filter.tag("a").eq("b")), lambda: Filter.text("").match("x"),
])
def test_rejected(bad):
    with pytest.raises(ValueError):
        bad()


names = st.from_regex(r"[a-z][a-z_]{0,5}", fullmatch=True)
leaves = st.one_of(
    st.builds(lambda n, v: f.Tag(n, tuple(v)), names, st.lists(st.from_regex(r"[a-z0-9]([a-z0-9 .-]{0,5}[a-z0-9])?", fullmatch=True), min_size=1, max_size=3)),
    st.builds(lambda n, a, b: f.Range(n, float(min(a, b)), float(max(a, b))), names, st.integers(-99, 99), st.integers(-99, 99)),
    st.builds(f.Affix, names, st.from_regex(r"[a-z]{1,5}", fullmatch=True)),
    st.builds(f.Term, names, st.from_regex(r"[a-z][a-z0-9-]{0,4}[a-z]", fullmatch=True)),
    st.builds(f.Phrase, names, st.from_regex(r'[a-z"\\ ]{1,8}', fullmatch=True)),
)
nodes = st.recursive(leaves, lambda x: st.one_of(st.builds(lambda a: ~a, x), st.builds(Filter.all, x, x), st.builds(Filter.any, x, x)), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(nodes)
def test_round_trip(node):
    assert parse(node.render()) == node


@pytest.mark.parametrize("text", ["", "(", "a |", '"x', "@f:{", "@f:[1]", "%%%%x%%%%", "@:x", ")"])
def test_syntax_errors(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)


def test_or_binds_looser_than_and():
    assert parse("a b | c") == Filter.any(Filter.all(f.Term(None, "a"), f.Term(None, "b")), f.Term(None, "c"))
