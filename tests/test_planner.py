import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.errors import GlobError, RegexCompileError
from lodestone.functions.dialect import compile_pattern, escape_literal, java_predicate
from lodestone.functions.grams import Rarity, covering_ngrams, fold, gram_hash, pack_trigrams, sparse_ngrams
from lodestone.functions.positions import literal_spans, located, match_spans
from lodestone.plans.planner import plan_literal, plan_pattern
from lodestone.sources.paths import glob_to_regex


def spans(pattern, content, **options):
    return list(match_spans(compile_pattern(pattern, **options).build(), content))


def grams(text, folded=False):
    return set(pack_trigrams(fold(text) if folded else text).tolist())


def test_class_pattern_keeps_its_literals():
    plan = plan_pattern("user_[0-9]{4}_event_[A-Z]{3}")
    assert plan.kind == "and" and not plan.used_fallback
    assert "user_" in plan.literals and "_event_" in plan.literals


@pytest.mark.parametrize("pattern, kind", [("abc|def", "or"), ("abc", "and"), ("[a-f0-9]{40}", "all"), ("a|bcd", "all"), ("ab?c", "all"), ("", "all")])
def test_plan_kinds(pattern, kind):
    assert plan_pattern(pattern).kind == kind


@pytest.mark.parametrize(
    "pattern, matching",
    [
        ("abc+def", [b"abcdef", b"abccdef", b"abcccdef"]), ("xa{1,3}yz", [b"xayz", b"xaayz", b"xaaayz"]), ("[[:alpha:]]foo", [b"afoo"]), ("[]abc]foo", [b"]foo", b"bfoo"]), ("[[]foo|bar", [b"[foo", b"bar"]),
        ("(?i)foobar", [b"FooBar"]), (r"\x41bcd", [b"Abcd"]), (r"\Qa.b*c\E", [b"a.b*c"]), ("(abc|de)fgh", [b"abcfgh", b"defgh"]), ("(?:ab){2,4}cd", [b"ababcd", b"ababababcd"]), ("a{10}b", [b"a" * 10 + b"b"]),
        ("foo(?=bar)barbaz", [b"foobarbaz"]), (r"foo\b bar", [b"foo bar"]), ("(x)yz\\1abc", [b"xyzxabc"]), ("foo.*?bar", [b"foobar", b"foo--bar"]), ("(?x) a b c d", [b"abcd"]),
    ],
)
def test_plans_admit_what_matches(pattern, matching):
    plan = plan_pattern(pattern)
    for text in matching:
        assert spans(pattern, text), text
        assert plan.admits(grams(text, plan.folded)), text


ATOMS = st.sampled_from(["a", "b", "ab", "c", "[ab]", ".", "(ab|c)", "(?:bc)", "a+", "b{2}", "c{1,2}", "a*", "(?i:B)", "\\.", "x?"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(ATOMS, min_size=1, max_size=6).map("".join), min_size=1, max_size=3).map("|".join), st.text("abcABC.x", max_size=14))
def test_plans_are_sound(pattern, text):
    content = text.encode()
    for case_sensitive in (True, False):
        plan = plan_pattern(pattern, case_sensitive)
        if spans(pattern, content, case_sensitive=case_sensitive):
            assert plan.admits(grams(content, plan.folded))
        budget = plan_pattern(pattern, case_sensitive, budget=Rarity({0x6162: 5, 0x6263: 1}))
        assert budget.kind != "all" or plan.kind == "all"
        if plan.admits(grams(content, plan.folded)):
            assert budget.admits(grams(content, budget.folded))


@settings(max_examples=200, deadline=None)
@given(st.text("ab.+*[](){}|\\^$?", min_size=1, max_size=8), st.text("ab.+*[](){}|\\^$?", max_size=20))
def test_literals_match_themselves(literal, text):
    content = text.encode()
    assert spans(literal, content, literal=True) == list(literal_spans(literal.encode(), content))
    assert re.compile(escape_literal(literal)).fullmatch(literal)
    if literal in text:
        assert plan_literal(literal.encode()).admits(grams(content))


def test_empty_matches():
    assert spans("a*", b"baac") == [(0, 0), (1, 3), (4, 4)]


@pytest.mark.parametrize(
    "pattern, text, expected",
    [
        (r"foo\Kbar", b"foobar", [(3, 6)]), (r"a\Z", b"a\n", [(0, 1)]), (r"a\z", b"a\n", []), (r"\R", b"a\r\nb", [(1, 3)]), (r"\h+", b"a \tb", [(1, 3)]), ("(?<n>a)(?P=n)", b"aa", [(0, 2)]), ("[[:^alpha:]]", b"a1", [(1, 2)]), (r"\((?:[^()]|(?R))*\)", b"(a(b))", [(0, 6)]), ("é", "é".encode(), [(0, 2)]), (".", "é".encode(), [(0, 1), (1, 2)]),
    ],
)
def test_dialect(pattern, text, expected):
    assert spans(pattern, text) == expected


def test_multiline_start_is_not_after_the_last_line_end():
    assert spans("^", b"a\nb\n", multiline=True) == [(0, 0), (2, 2)]


@pytest.mark.parametrize("pattern", ["(", "[a", "a\\", r"\p{L}", "[[:nope:]]", "*a"])
def test_bad_patterns(pattern):
    with pytest.raises(RegexCompileError):
        compile_pattern(pattern)


def test_java_takes_only_what_it_decides_alike():
    assert java_predicate("MIT License|Apache [0-9]+") and java_predicate("abc", False).startswith("(?i)")
    for pattern in ("a.c", "[^a]b", "^a", "é", "(?R)", r"\bab", "[[:alpha:]]"):
        assert java_predicate(pattern) is None


def test_positions():
    found = located([(3, 8)], "é hello".encode(), True)[0]
    assert (found["byte_offset"], found["line"], found["column"], found["snippet"]) == (3, 1, 4, "é hello")
    assert located([(8, 12)], b"another line\n", True)[0]["snippet"] == "another line\n"
    two = located([(0, 1), (4, 5)], b"a\r\nxb\nc", True)
    assert [(m["line"], m["column"], m["snippet"]) for m in two] == [(1, 1, "a\r"), (2, 2, "xb")]
    assert located([(2, 2)], b"a\n", True)[0]["line"] == 1
    assert located([(0, 1)], b"\xff", True)[0]["snippet"] == "�"


@pytest.mark.parametrize(
    "glob, yes, no",
    [
        ("*.rs", ["src/a.rs", "a.rs"], ["a.rs2"]), ("src/**", ["src/a", "src/b/c"], ["src", "x/src/a"]), ("**/a", ["a", "x/a", "x/y/a"], ["ba"]), ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["a/xb"]), ("[!a]?.{ts,md}", ["bx.ts", "b/.md"], ["ax.ts", "bx.rs"]), (r"a\*b", ["a*b"], ["axb"]), ("a[]-]b", ["a]b", "a-b"], ["axb"]), ("x.y+z", ["x.y+z"], ["xay+z"]),
    ],
)
def test_globs(glob, yes, no):
    rx = re.compile(glob_to_regex(glob).replace(r"\z", r"\Z").replace("^(?s:", "(?s:"))
    assert all(rx.match(p) for p in yes) and not any(rx.match(p) for p in no)


@pytest.mark.parametrize("glob", ["[a", "{a", "a}", "a\\", "[z-a]"])
def test_bad_globs(glob):
    with pytest.raises(GlobError):
        glob_to_regex(glob)


def brute_sparse(text, rarity):
    w, out = rarity.weights(text).tolist(), []
    for left in range(len(w)):
        for right in range(left + 1, min(len(w), left + 24)):
            between = w[left + 1 : right]
            if all(min(w[left], w[right]) > x for x in between) and text[left : right + 2] not in out:
                out.append(text[left : right + 2])
    return out


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes(97 + x % 5 for x in b)), st.dictionaries(st.sampled_from([0x6161 + 256 * i + j for i in range(5) for j in range(5)]), st.integers(1, 9)))
def test_sparse_grams(text, frequency):
    rarity = Rarity(frequency)
    found = sparse_ngrams(text, rarity)
    assert found == brute_sparse(text, rarity)
    assert {text[i : i + 3] for i in range(len(text) - 2)} <= set(found)
    if len(text) >= 3:
        cover = covering_ngrams(text, rarity)
        assert cover and all(g in text for g in cover) and len(cover) <= 12


def test_gram_hash_is_signed_xxh3():
    assert gram_hash(b"abc") == 8696274497037089104
