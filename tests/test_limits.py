"""Limits of evaluation, caches, trace listeners, files of definitions and codes."""

import json

import pytest

from lumenpath import tracing
from lumenpath.interp.evaluator import PATTERNS, evaluate
from lumenpath.lang.cache import Cache
from lumenpath.lang.errors import InvalidOperation, ParseError, Timeout
from lumenpath.lang.parser import EXPRESSIONS, parse
from lumenpath.sources import examples
from lumenpath.sources.definitions import Registry
from lumenpath.sources.terminology import Terminology


def test_limits():
    many = "(1 | 2 | 3 | 4 | 5 | 6 | 7 | 8 | 9 | 10)"
    slow = f"{many}.select({many}.select({many}.select({many}.select({many}.select({many}.count()).sum()).sum()).sum()).sum()).sum()"
    with pytest.raises(Timeout):
        evaluate(slow, "{}", seconds=0.05)
    assert Timeout.kind == "Timeout" and evaluate("1 + 1", "{}", seconds=60) == [2]
    with pytest.raises(InvalidOperation):
        evaluate("1 + (1 + (1 + (1 + (1 + 1))))", "{}", depth=4)
    assert evaluate("1 + (1 + 1)", "{}", depth=10) == [3]
    with pytest.raises(InvalidOperation):
        evaluate("1 | 2 | 3", "{}", max_items=2)


def test_limits_of_rows(spark):
    from lumenpath.operators import dynamic

    df = spark.createDataFrame([('{"a": [1, 2, 3]}',), ('{"a": 1}',)], "json string")
    assert sorted(len(r.x) for r in dynamic.select(df, "json", {"x": "a"}, max_items=2).collect()) == [0, 1]


def test_caches():
    made = Cache(str.upper, 2)
    assert [made.get(x) for x in ("a", "b", "a", "c", "b")] == ["A", "B", "A", "C", "B"]
    assert len(made) == 2 and (made.stats().hits, made.stats().misses, made.stats().limit) == (1, 4, 2) and made.stats().hit_rate == 20
    made.clear()
    assert len(made) == 0 and made.stats().hit_rate == 0
    EXPRESSIONS.clear()
    assert parse("a.b") is parse("a.b") and EXPRESSIONS.stats().hits == 1
    with pytest.raises(ParseError):
        parse("a b")
    assert len(EXPRESSIONS) == 1
    PATTERNS.clear()
    assert evaluate("'ab'.matches('b') and 'cb'.matches('b')", "{}") == [True] and PATTERNS.stats().misses == 1


def test_trace_listener():
    told = []
    try:
        tracing.set_listener(lambda name, items: told.append((name, items)))
        assert evaluate("(1 | 2).trace('here').count() + 5.trace('more', $this + 1)", "{}") == [7]
        tracing.set_listener(tracing.to_nobody)
        assert evaluate("1.trace('x')", "{}") == [1]
    finally:
        tracing.set_listener(tracing.to_log)
    assert told == [("here", [1, 2]), ("more", [6])] and tracing.listener() is tracing.to_log


def test_specification_files_and_differentials(tmp_path):
    entries = examples.definitions()["entry"]
    kinds = {"profiles-resources.json": "resource", "profiles-types.json": "complex-type"}
    for name, kind in kinds.items():
        (tmp_path / name).write_text(json.dumps({"resourceType": "Bundle", "entry": [e for e in entries if e["resource"]["kind"] == kind]}))
    registry = Registry()
    assert registry.load_specification(str(tmp_path)) == 6 and Registry().load_specification(str(tmp_path / "none")) == 0
    registry.load({"resourceType": "StructureDefinition", "url": "http://x/profile/p", "type": "Patient", "differential": {"element": [{"path": "Patient.name", "min": 1}]}})
    assert [(e.path, e.min) for e in registry.get("http://x/profile/p").differential] == [("Patient.name", 1)] and registry.get("http://x/profile/p").elements == []


def test_table_of_codes(tmp_path):
    first, again = examples.terminology(), Terminology()
    assert first.save(str(tmp_path / "codes.jsonl")) == 4
    again.load_table(str(tmp_path / "codes.jsonl"))
    assert again.sets == first.sets


def test_guard_of_patterns():
    from lumenpath.functions.strings import check_pattern
    from lumenpath.lang.errors import InvalidArguments

    for good in ("a{2}b+", "))((a))", "((((a))))", "a+b*c?", "[0-9]{1,3}", "x" * 1000, "a+{2}"):
        check_pattern(good)
    for bad in ("a++", "(a+)+", "a{+", "((((((a))))))", "x" * 1001, "a*?"):
        with pytest.raises(InvalidArguments):
            check_pattern(bad)


def test_inferred_documents(spark):
    from lumenpath.operators import evaluate as E
    from lumenpath.operators.dynamic import Document
    from lumenpath.sources.documents import inferred, inferred_schema

    rows = ['{"a": 1, "b": {"c": [1.5, 2]}, "m": 1, "odd name": "x"}', '{"b": {"d": "t"}, "m": "s"}', "{", None, "[1]"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "n long, json string")
    got = E.select(inferred(df.where("n < 4"), "json"), {"a": ("a", "integer"), "c": ("b.c.sum()", "decimal"), "d": ("b.d", "text"), "m": ("m", "text")}, ("n",)).orderBy("n").collect()
    assert [tuple(r) for r in got[:2]] == [(0, 1, 3.5, None, "1"), (1, None, 0.0, "t", "s")] and got[2].a is None
    assert inferred_schema(df.where("n > 90"), "json").startswith("STRUCT<") and inferred(df.where("n > 90"), "json").count() == 0
    document = Document('{"a": [1, 2]}')
    assert document.evaluate("a.count()") == [2] and document.json("a") == "[1, 2]"
    kinds = examples.terminology().enumeration(examples.GENDERS, "Gender")
    assert kinds.FEMALE.value == "female" and len(kinds) == 4
