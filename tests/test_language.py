"""The query language: trees, errors, date periods and score expressions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathom.config import FieldConfig, IndexConfig, QueryError
from fathom.functions import analysis, dates
from fathom.functions.english import english_stem
from fathom.operators import intervals
from fathom.plans import lang
from fathom.plans.lang import Bool, Boost, MatchAll, Range, Set_, Text, parse


def test_precedence():
    assert parse("a OR b AND c") == Bool((("", Text(None, "a")), ("", Bool((("+", Text(None, "b")), ("+", Text(None, "c")))))))
    assert parse("a b", default_and=True) == Bool((("+", Text(None, "a")), ("+", Text(None, "b"))))


def test_groups_with_a_minimum_keep_their_terms_optional():
    q = parse("title:(cancer AND lung -fly rat bear insect +fruit)@2", default_and=True)
    assert isinstance(q, Bool) and q.mm == 2
    assert [o for o, _ in q.clauses] == ["", "-", "", "", "", "+"]


def test_leaves():
    assert parse("*:*") == parse("") == MatchAll()
    assert parse("n:[1 TO 5}") == Range("n", "1", "5", True, False)
    assert parse("n<=5") == Range("n", "*", "5", True, True)
    assert parse("n>5") == Range("n", "5", "*", False, True)
    assert parse("t:tes*").kind == "wildcard" and parse("t:/x.y/").kind == "regex"
    assert parse('t:"a b"~3') == Text("t", "a b", "phrase", 3)
    assert parse("t:nest~").n == 2 and parse("t:nest~1").n == 1
    assert parse("(a b)^2.5") == Boost(Bool((("", Text(None, "a")), ("", Text(None, "b")))), 2.5)
    assert parse('f:zl:tq(a "b c")') == Set_("f", ("a", "b c"), False)
    assert parse("f:zl:ns(1 2)") == Set_("f", ("1", "2"), True)
    assert parse("|||comments|||>2") == Range("|||comments|||", "2", "*", False, True)
    assert parse("year:(-2020 OR -2021)").clauses[0][0] == "-"


@pytest.mark.parametrize("bad", ["title^abc", "(a", '"a', "a)", "f:/x", "nest~1.5", "nest~-1", "zl:what(1)", "fn:what(a)", "[1 TO 2]"])
def test_bad_queries_are_typed_errors(bad):
    with pytest.raises(QueryError):
        parse(bad)


@given(st.text(alphabet='ab:()[]{}"~^*?+-!/\\ <>=|', max_size=25))
def test_any_text_parses_or_fails_as_a_query_error(text):
    try:
        parse(text)
    except QueryError:
        pass


def test_periods():
    lo, hi = dates.period("2014-02")
    assert (lo.month, hi.month, hi.day) == (2, 2, 28)
    lo, hi = dates.bounds("2012", "2014", False, False)
    assert (lo.year, lo.month, hi.year, hi.month) == (2013, 1, 2013, 12)
    assert dates.period("2014/1/5")[0].day == 5 and dates.period("nope") is None and dates.period("2014-13") is None


def test_interval_functions():
    tok = "pink with big big big stripes".split()

    def n(q):
        return len(intervals.evaluate(intervals.analyzed(parse(q).fn, str.split), tok))

    assert n("fn:ordered(pink big)") and not n("fn:ordered(big pink)")
    assert n("fn:ordered(big big big)") and not n("fn:ordered(big big big big)")
    assert n("fn:unordered(big pink)") and n("fn:maxgaps(1 fn:ordered(pink big))") and not n("fn:maxgaps(0 fn:ordered(pink big))")
    assert n("fn:maxwidth(3 fn:ordered(pink big))") and not n("fn:maxwidth(2 fn:ordered(pink big))")
    assert n("fn:phrase(big stripes)") and n("fn:or(x stripes)") and n("fn:atLeast(2 pink x stripes)") and not n("fn:atLeast(3 pink x stripes)")
    assert n("fn:before(pink stripes)") and not n("fn:after(pink stripes)")
    assert n("fn:containing(fn:ordered(pink stripes) big)") and not n("fn:notContaining(fn:ordered(pink stripes) big)")
    assert n("fn:containedBy(big fn:ordered(pink stripes))") == 3 and not n("fn:notContainedBy(big fn:ordered(pink stripes))")
    assert n("fn:within(pink 2 big)") and n("fn:notWithin(pink 1 stripes)") and n("fn:extend(pink 0 2)")
    assert n("fn:overlapping(fn:ordered(pink big) fn:ordered(with stripes))") and n("fn:nonOverlapping(pink stripes)")
    assert n("fn:wildcard(str*)") and n("fn:fuzzyTerm(pinq 1)") and n("fn:unorderedNoOverlaps(big pink)")


@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), min_size=2, max_size=3), st.integers(0, 3))
@settings(max_examples=150, deadline=None)
def test_sweeps_find_what_combinations_find(tok, words, slop):
    from itertools import permutations, product

    where = [[i for i, t in enumerate(tok) if t == w] for w in words]

    def least(ok):
        spans = {(min(c), max(c)) for c in product(*where) if len(set(c)) == len(c) and ok(c)}
        return sorted(s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans))

    text = tuple(("text", [w]) for w in words)
    got = lambda name: sorted(s[:2] for s in intervals.evaluate((name, text), tok))
    assert got("ordered") == least(lambda c: list(c) == sorted(c))
    assert got("unordered") == least(lambda c: True)
    assert got("phrase") == least(lambda c: all(y - x == 1 for x, y in zip(c, c[1:], strict=False)))
    near = any(max(p - i for i, p in enumerate(c)) - min(p - i for i, p in enumerate(c)) <= slop for c in permutations(range(len(tok)), len(words)) if [tok[p] for p in c] == words)
    assert intervals.sloppy_match(tok, words, slop) == near


def test_fields_expand_over_declared_names_only():
    c = IndexConfig("i", "id", (FieldConfig("a", "STRING", {"aTitle": "standard", "bTitle": "standard"}), FieldConfig("n", "INT")), mappings={"alt": ("aTitle", "alt")})
    assert c.expand("*Title") == ["aTitle", "bTitle"] and c.expand("|*Title|") == ["|aTitle|", "|bTitle|"]
    assert c.expand("alt,n") == ["aTitle", "alt", "n"] and c.expand("*:x") == []
    assert IndexConfig.from_json(c.to_json()) == c
    assert [f.name for f in c.update((FieldConfig("m", "LONG"),), removed=("n",)).fields] == ["a", "m"]
    assert [f.name for f in c.update((FieldConfig("m", "LONG"),), how="REPLACE").fields] == ["m"]


def test_stemmers():
    assert [analysis.min_stem(w) for w in ("skies", "dogs", "glass", "bus", "shoes")] == ["sky", "dog", "glass", "bus", "shoes"]
    assert [analysis.inflect_stem(w) for w in ("running", "cities", "walked", "created")] == ["run", "city", "walk", "create"]


#: Words with the stems that the algorithm's own description gives for them.
STEMS = {"consign": "consign", "consignment": "consign", "consistency": "consist", "consolations": "consol", "consolatory": "consolatori", "consolingly": "consol", "conspicuously": "conspicu", "conspirators": "conspir", "constables": "constabl", "constancy": "constanc", "knackeries": "knackeri", "knavish": "knavish", "kneaded": "knead", "knives": "knive", "knitted": "knit", "knightly": "knight", "generically": "generic", "generate": "generat", "communication": "communic", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "kiwis": "kiwi", "luxuriated": "luxuri", "hopping": "hop", "hoping": "hope", "agreed": "agre", "feed": "feed", "skies": "sky", "dying": "die", "happy": "happi", "by": "by", "say": "say", "proceed": "proceed", "inning": "inning", "analogies": "analog", "youth": "youth", "bedding": "bed", "rolled": "roll", "controlling": "control", "dog's": "dog", "'tis": "tis", "": ""}


def test_english_stems():
    assert {w: english_stem(w) for w in STEMS} == STEMS


@given(st.text("aeiouyYbdlnstg'", max_size=12))
def test_stems_are_no_longer_than_their_words_by_more_than_an_e(word):
    assert len(english_stem(word)) <= len(word) + 1


def test_stop_words_from_a_file(spark, tmp_path):
    from pyspark.sql import functions as F

    (tmp_path / "words.txt").write_text(" red \n\nshoes\n")
    (tmp_path / "none.txt").write_text("")
    df = spark.createDataFrame([("the red shoes",), (None,)], "t string")
    for name, want in (("words.txt", ["the", None, None]), ("none.txt", ["the", "red", "shoes"])):
        c = IndexConfig("i", "id", (), analyzers={"x": ("tok_standard", f"stop_file:{tmp_path / name}")})
        assert [r[0] for r in df.select(analysis.tokens(F.col("t"), "x", c)).collect()] == [want, None]
        assert analysis.query_tokens("the red shoes", "x", c) == want


def test_steps_agree_between_columns_and_lists(spark):
    from pyspark.sql import functions as F

    text = ["The Dogs' skies über Straße wi-fi colour AIDS", "boxes and horses", "Größe, naïve café's", ""]
    df = spark.createDataFrame([(t,) for t in text], "t string")
    for name in analysis.NAMED:
        got = [r[0] for r in df.select(analysis.tokens(F.col("t"), name)).collect()]
        if name not in ("lsh", "standardHtml"):
            assert got == [analysis.query_tokens(t, name) for t in text], name
    for steps in (("tok_standard", "lower", "german"), ("tok_standard", "british_us"), ("tok_standard", "lower", "stop"), ("tok_standard", "case_protect", "lower"), ("tok_standard", "upper", "snowball"), ("tok_standard", "lower", "snowball")):
        c = IndexConfig("i", "id", (), analyzers={"x": steps})
        assert [r[0] for r in df.select(analysis.tokens(F.col("t"), "x", c)).collect()] == [analysis.query_tokens(t, "x", c) for t in text], steps


def test_edit_distance():
    assert intervals.edits("abc", "acb", 2) == 1 and intervals.edits("abc", "acb", 2, swaps=False) == 2 and intervals.edits("a", "abcdef", 2) == 3
    assert lang.INTERVALS["maxgaps"] == "maxgaps"


def test_interval_tests_against_all_pairs():
    import random
    import time

    inside = lambda x, y: y[0] <= x[0] and x[1] <= y[1]
    near = lambda x, y, n: y[0] - n <= x[1] and x[0] <= y[1] + n
    rule = {
        "before": lambda s, b: any(s[1] < r[0] for r in b),
        "after": lambda s, b: any(s[0] > r[1] for r in b),
        "containing": lambda s, b: any(inside(r, s) for r in b),
        "notContaining": lambda s, b: not any(inside(r, s) for r in b),
        "containedBy": lambda s, b: any(inside(s, r) for r in b),
        "notContainedBy": lambda s, b: not any(inside(s, r) for r in b),
        "overlapping": lambda s, b: any(near(s, r, 0) for r in b),
        "nonOverlapping": lambda s, b: not any(near(s, r, 0) for r in b),
        "within": lambda s, b: any(r[0] - 2 <= s[0] and s[1] <= r[1] + 2 for r in b),
        "notWithin": lambda s, b: not any(near(s, r, 2) for r in b),
    }
    rand = random.Random(5)
    word = lambda w: ("text", [w])
    some = [word("a"), word("b"), ("text", ["a", "b"]), ("ordered", (word("a"), word("c"))), ("extend", (word("b"), 2, 1)), ("unordered", (word("c"), word("b"))), ("or", (word("a"), ("text", ["c", None, "b"])))]
    for _ in range(300):
        tokens = [rand.choice(("a", "b", "c", "d", None)) for _ in range(rand.randrange(25))]
        x, y, name = rand.choice(some), rand.choice(some), rand.choice(list(rule))
        a, b = intervals.evaluate(x, tokens), intervals.evaluate(y, tokens)
        got = intervals.evaluate((name, (x, 2, y) if "ithin" in name else (x, y)), tokens)
        assert got == [s for s in a if rule[name](s, b)], (name, x, y, tokens)
    begin = time.monotonic()
    assert not intervals.evaluate(("containing", (word("a"), word("b"))), ["a", "b"] * 20_000)
    assert time.monotonic() - begin < 5


def test_intervals_send_positions_to_python(spark):
    import re

    from fathom.config import FieldConfig, IndexConfig
    from fathom.operators.search import Clause, Search, Searcher

    rows = [(1, "on 7 of the thing"), (2, "the 7 x of"), (3, None), (4, ""), (5, "tha of teh x x 7"), (6, "OF x THE")]
    config = IndexConfig("i", "id", (FieldConfig("text", "STRING", {"text": "standard", "stopped": "halted"}),), ("text",), analyzers={"halted": ("tok_standard", "lower", "stop")})
    s = Searcher(spark.createDataFrame(rows, "id long, text string"), config)
    hits = lambda q: s.hits(Search((Clause("FILTER", q),)), scored=False)
    for q, want in (
        ("fn:ordered(7 of)", [1, 2]), ("fn:maxwidth(3 fn:atLeast(2 of the 7))", [1, 2, 6]), ("fn:or(thing 7)", [1, 2, 5]), ("fn:fuzzyTerm(the 1)", [1, 2, 5, 6]),
        ("fn:wildcard(t[h]*g)", [1]), ("fn:notContaining(fn:ordered(of the) x)", [1]), ("fn:within(of 2 the)", [1, 6]), ('fn:containing("of the" the)', [1]), ("fn:notWithin(of 3 the)", [5]),
        ("stopped:fn:ordered(7 thing)", [1]), ('stopped:fn:phrase("7 of the" thing)', [1]), ('"the of"~1', []), ('"the of"~2', [1, 2]),
    ):
        assert sorted(r.id for r in hits(q).collect()) == want, q
        assert not re.search(r"run\(_tok_\w+#\d+\)", hits(q)._jdf.queryExecution().optimizedPlan().toString())
