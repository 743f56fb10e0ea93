import random

import pytest

from ledgerbrook.errors import InvalidOperation, ParseError
from ledgerbrook.functions.aggregates import parse_aggregate
from ledgerbrook.functions.types import REGISTRY, promoted
from ledgerbrook.operators.predicate import Comparison, Every, Some, compile_tree, evaluate, impossible, minterms, parse
from ledgerbrook.operators.schema import SchemaBuilder, parse_schema
from ledgerbrook.sources.multilog import parse_trigger


def test_precedence_and_negation():
    assert parse("a<b") == Comparison("a", "<", "b")
    assert parse("a==1 || b==2 && c==3") == Some((Comparison("a", "==", "1"), Every((Comparison("b", "==", "2"), Comparison("c", "==", "3")))))
    assert parse("!(a<1 && b>2)") == Some((Comparison("a", ">=", "1"), Comparison("b", "<=", "2")))
    assert parse("!!(a<1)") == Comparison("a", "<", "1")
    assert parse("") is None
    assert parse('h == "two words"') == Comparison("h", "==", "two words")


@pytest.mark.parametrize(
    ("text", "size"),
    [("a<1", 1), ("a<1 && b>2", 1), ("a<1 || b>2", 2), ("a<1 || b>2 && c==3", 2), ("a<1 && (b>2 || c==3)", 2), ("a<1 || a<1", 1), ("(a<1 || b>2) && (c==3 || d==4) || e==5", 5)],
)
def test_minterms(text, size):
    assert len(minterms(parse(text))) == size


@pytest.mark.parametrize("text", ["a <", "a < 1 &&", "(a < 1", "a ? 1", "1 < a b", "a < 1)", "&& a < 1"])
def test_bad_predicates(text):
    with pytest.raises(ParseError):
        parse(text)


def test_schema_text():
    s = parse_schema("{ a: BOOL, b: CHAR, c: SHORT, d: INT, e: LONG, f: FLOAT, g: DOUBLE, h: STRING(16) }")
    assert [c.name for c in s.columns] == ["TIMESTAMP", *"ABCDEFGH"]
    assert s.record_size == 52
    assert parse_schema(s.spelled()).spelled() == s.spelled()
    for bad in ("{ a: BOOL }", "{ a: NOPE, b: INT }", "a: INT, b: INT", "{ a INT, b: INT }"):
        with pytest.raises(ParseError):
            parse_schema(bad)
    with pytest.raises(InvalidOperation):
        parse_schema("{ timestamp: INT, b: INT }")


def test_records_match_the_schema():
    s = SchemaBuilder().add("x", "INT").add("y", "CHAR").build()
    assert s.parse_record(["5", "7", "a"]) == [5, 7, 97]
    assert s.parse_record(["7", "a"], now=9) == [9, 7, 97]
    for bad in (["1"], ["1", "2", "a", "b"], ["1", "1.5", "a"], ["1", "2", "ab"]):
        with pytest.raises(InvalidOperation):
            s.parse_record(bad)


def test_aggregate_and_trigger_text():
    assert parse_aggregate("SUM(a)") == ("SUM", "a")
    assert parse_trigger("a >= 10") == ("a", ">=", "10")
    for bad in ("SUM a", "SUM()", "(a)"):
        with pytest.raises(ParseError):
            parse_aggregate(bad)
    for bad in ("a", ">= 10", "a => 10"):
        with pytest.raises(ParseError):
            parse_trigger(bad)


def test_promotion_is_by_type_number():
    t = REGISTRY.get
    assert promoted(t("ULONG"), t("LONG")).name == "ULONG"
    assert promoted(t("LONG"), t("FLOAT")).name == "FLOAT"
    with pytest.raises(InvalidOperation):
        promoted(t("INT"), t("STRING(4)"))


def test_random_predicates_against_plain_python(spark):
    schema = SchemaBuilder().add("i", "INT").add("f", "FLOAT").add("g", "DOUBLE").add("s", "STRING(8)").add("b", "BOOL").build()
    rng = random.Random(4)
    rows = [{"TIMESTAMP": k, "I": rng.randrange(5), "F": rng.choice([0.1, 0.2, 0.5]), "G": rng.choice([0.1, 0.25, float("nan")]), "S": rng.choice("abz"), "B": rng.random() < 0.5} for k in range(60)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema.struct())
    values = {"i": "01234", "f": ["0.1", "0.2", "0.3"], "g": ["0.1", "0.2"], "s": "abz", "b": ["true", "false"]}

    def text(depth):
        if depth == 0 or rng.random() < 0.3:
            c = rng.choice("ifgsb")
            return f"{c} {rng.choice(['<', '<=', '>', '>=', '==', '!='])} {rng.choice(values[c])}"
        return rng.choice(["{} && {}", "{} || {}", "!({} && {})", "({} || {})"]).format(text(depth - 1), text(depth - 1))

    checks = [text(3) for _ in range(60)]
    trees = [parse(t) for t in checks]
    got = df.select("TIMESTAMP", *[compile_tree(t, schema).alias(f"p{k}") for k, t in enumerate(trees)]).collect()
    for row, plain in zip(sorted(got), rows, strict=True):
        for k, t in enumerate(trees):
            assert row[f"p{k}"] == evaluate(t, plain, schema), checks[k]


def test_contradictions_read_nothing(spark):
    schema = SchemaBuilder().add("i", "INT").add("s", "STRING(8)").build()
    df = spark.createDataFrame([(1, 2, "a")], schema.struct())
    for text in ("i > 5 && i < 3", "i == 1 && i != 1", "s > b && s < a", "i >= 2 && i < 2", "(i > 5 && i < 3) && s == a"):
        plan = df.where(compile_tree(parse(text), schema))._jdf.queryExecution().optimizedPlan().toString()
        assert "Filter" not in plan and "LocalRelation <empty>" in plan
    assert df.where(compile_tree(parse("i > 5 && i < 3 || s == a"), schema)).count() == 1


def test_unknown_column_and_bad_literal():
    schema = SchemaBuilder().add("d", "INT").add("x", "DOUBLE").build()
    for text in ("nope == 1", "d == 1.5", "x == abc"):
        with pytest.raises(InvalidOperation):
            compile_tree(parse(text), schema)


def test_single_floats_in_contradictions():
    schema = parse_schema("{ f: FLOAT, d: DOUBLE }")
    low, high = 0.1, 0.10000000001  # one float, two doubles
    both = lambda c: [Comparison(c, ">=", str(high)), Comparison(c, "<=", str(low))]
    assert not impossible(both("F"), schema) and impossible(both("D"), schema)
    assert not impossible([Comparison("F", ">=", "1e39"), Comparison("F", "<=", "2e39")], schema)  # both infinite
