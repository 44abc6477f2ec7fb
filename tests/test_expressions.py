"""One table of expressions for both evaluators: the compiler over typed frames, and the schema-less one over JSON."""

import json

import pytest
from pyspark.sql import functions as F

from lumenpath.functions import registry
from lumenpath.interp.evaluator import evaluate
from lumenpath.interp.values import text
from lumenpath.lang.errors import FunctionNotFound, InvalidArguments, InvalidPath, ParseError, PathError, SingletonExpected, TypeMismatch
from lumenpath.lang.parser import parse
from lumenpath.operators import evaluate as E
from lumenpath.operators import references
from lumenpath.plans.coll import Coll
from lumenpath.sources.documents import parse as parse_documents

DOCUMENT = {
    "resourceType": "Patient", "id": "p1", "active": True, "age": 41, "score": 2.5, "birthDate": "1974-12-25", "empty": None,
    "name": [{"use": "official", "family": "Chalmers", "given": ["Peter", "James"]}, {"use": "usual", "given": ["Jim"]}],
    "telecom": [{"system": "phone", "value": "1", "rank": 2}, {"system": "email", "value": "2", "rank": 1}],
    "valueQuantity": {"value": 70.5, "unit": "kg", "code": "kg"},
    "extension": [{"url": "http://x/a", "valueString": "A"}, {"url": "http://x/b", "valueString": "B"}],
    "managingOrganization": {"reference": "http://server/fhir/Organization/7"},
    "flags": [True, False], "numbers": [3, 1, 2], "words": ["b", "a", "b"],
}
SCHEMA = (
    "resourceType string, id string, active boolean, age long, score double, birthDate string, empty string, name array<struct<use:string,family:string,given:array<string>>>, "
    "telecom array<struct<system:string,value:string,rank:long>>, valueQuantity struct<value:double,unit:string,code:string>, extension array<struct<url:string,valueString:string>>, "
    "managingOrganization struct<reference:string>, flags array<boolean>, numbers array<long>, words array<string>"
)

CASES = [
    ("Patient.name.family", ["Chalmers"]), ("name.given", ["Peter", "James", "Jim"]), ("Observation.id", []), ("Resource.id", ["p1"]), ("nothing.at.all", []),
    ("name[0].given[1]", ["James"]), ("name[5]", []), ("name[-1]", []), ("`name`.given.first()", ["Peter"]), ("empty", []), ("{}", []), ("value.unit", ["kg"]), ("value.value", ["70.5"]),
    ("name.where(use = 'usual').given", ["Jim"]), ("name.where($index = 0).given.last()", ["James"]), ("name.select(given.first())", ["Peter", "Jim"]), ("name.select($index)", ["0", "1"]),
    ("name.exists()", ["true"]), ("name.exists(use = 'old')", ["false"]), ("name.all(given.exists())", ["true"]), ("nothing.all(false)", ["true"]), ("nothing.empty()", ["true"]),
    ("active and {}", []), ("false and {}", ["false"]), ("true or {}", ["true"]), ("active xor true", ["false"]), ("false implies {}", ["true"]), ("{} implies true", ["true"]), ("active.not()", ["false"]),
    ("age = 41", ["true"]), ("age = 41.0", ["true"]), ("name.use = 'official'", []), ("age != 40", ["true"]), ("id = 5", ["false"]), ("{} ~ {}", ["true"]), ("' A  b ' ~ 'a B'", ["true"]), ("id !~ 'x'", ["true"]),
    ("age > 40 and score <= 2.5", ["true"]), ("'a' < 'b'", ["true"]), ("{} < 1", []), ("1 + 2 * 3", ["7"]), ("7 div 2", ["3"]), ("-7 div 2", ["-3"]), ("-7 mod 3", ["-1"]), ("7 / 2", ["3.5"]), ("0.1 + 0.2", ["0.3"]),
    ("'a' + 'b'", ["ab"]), ("'a' & {} & 'b'", ["ab"]), ("'a' & 1", ["a"]), ("-age", ["-41"]), ("(1 | 1 | 2)", ["1", "2"]), ("words | 'c'", ["b", "a", "b", "c"]), ("words.union('a')", ["b", "a", "b"]),
    ("words.combine('a').count()", ["4"]), ("words.intersect('b' | 'x')", ["b"]), ("words.exclude('b')", ["a"]), ("words.distinct()", ["b", "a"]), ("words.isDistinct()", ["false"]), ("'a'.subsetOf(%resource.words)", ["true"]),
    ("words.supersetOf('a' | 'z')", ["false"]), ("'a' in words", ["true"]), ("words contains 'z'", ["false"]), ("{} in words", []),
    ("numbers.sum()", ["6"]), ("numbers.min()", ["1"]), ("numbers.max()", ["3"]), ("numbers.avg()", ["2"]), ("nothing.sum()", ["0"]), ("words.max()", ["b"]), ("flags.allTrue()", ["false"]), ("flags.anyTrue()", ["true"]),
    ("flags.allFalse()", ["false"]), ("flags.anyFalse()", ["true"]), ("numbers.aggregate($this + $total, 10)", ["16"]), ("numbers.aggregate(iif($total.empty(), $this, iif($this > $total, $this, $total)))", ["3"]),
    ("numbers.tail()", ["1", "2"]), ("numbers.skip(2)", ["2"]), ("numbers.take(2)", ["3", "1"]), ("numbers.take(-1)", []), ("numbers.skip(-3).count()", ["3"]), ("id.single()", ["p1"]),
    ("iif(active, 'y', 'n')", ["y"]), ("iif(false, 'y')", []), ("iif({}, 1, 2)", ["2"]), ("id.hasValue()", ["true"]), ("name.hasValue()", ["false"]), ("id.getValue()", ["p1"]),
    ("value is Quantity", ["true"]), ("id is String", ["true"]), ("id is code", ["true"]), ("age.is(Integer)", ["true"]), ("(id as String)", ["p1"]), ("id as Integer", []), ("name.ofType(HumanName).count()", ["2"]), ("$this is DomainResource", ["true"]),
    ("'abc'.startsWith('ab')", ["true"]), ("'abc'.endsWith('bc')", ["true"]), ("'abc'.contains('x')", ["false"]), ("'abc'.replace('b', 'x')", ["axc"]), ("'ab'.replace('', '-')", ["-a-b-"]), ("'a1b'.matches('[0-9]')", ["true"]),
    ("'a1b22'.replaceMatches('[0-9]+', '<$0>')", ["a<1>b<22>"]), ("'abc'.indexOf('c')", ["2"]), ("'abc'.indexOf('x')", ["-1"]), ("'abcd'.substring(1, 2)", ["bc"]), ("'abc'.substring(5)", []), ("'abc'.substring(1)", ["bc"]), ("'aB'.lower()", ["ab"]), ("'aB'.upper()", ["AB"]),
    ("' a '.trim()", ["a"]), ("'abc'.length()", ["3"]), ("'abc'.toChars()", ["a", "b", "c"]), ("'a,b,,c'.split(',')", ["a", "b", "", "c"]), ("'a.b'.split('.')", ["a", "b"]), ("words.join('-')", ["b-a-b"]), ("nothing.join(',')", [""]), ("words.join()", ["bab"]),
    ("(-5).abs()", ["5"]), ("2.5.ceiling()", ["3"]), ("2.5.floor()", ["2"]), ("(-2.5).truncate()", ["-2"]), ("2.45.round(1)", ["2.5"]), ("3.round()", ["3"]), ("16.sqrt()", ["4"]), ("(-1).sqrt()", []), ("2.power(10)", ["1024"]), ("1.exp().round(4)", ["2.7183"]), ("100.log(10).round(6)", ["2"]), ("0.ln()", []),
    ("'12'.toInteger()", ["12"]), ("'1.5'.toInteger()", []), ("'1.5'.toDecimal()", ["1.5"]), ("'Yes'.toBoolean()", ["true"]), ("2.toBoolean()", []), ("true.toInteger()", ["1"]), ("age.toString()", ["41"]), ("'x'.convertsToInteger()", ["false"]), ("'x'.convertsToDate()", ["true"]), ("age.convertsToString()", ["true"]),
    ("birthDate.toDate() = @1974-12-25", ["true"]), ("birthDate.toDate() < @1975", ["true"]), ("birthDate.toDate() = @1974-12", ["false"]), ("birthDate.toDate().`year`()", ["1974"]), ("birthDate.toDate().month()", ["12"]), ("birthDate.toDateTime()", ["1974-12-25"]),
    ("(@2024-01-31 + 1 month).toString()", ["2024-03-02"]), ("(@2024-02-29 + 1 year).toString()", ["2025-03-01"]), ("(@2024-03-01 - 1 day).toString()", ["2024-02-29"]), ("(@2024-05 + 1 month).toString()", ["2024-06"]), ("(@2024-01-01T23:30:00Z + 45 minutes).toString()", ["2024-01-02T00:15:00Z"]), ("@2024-01-01T10:00:00Z = @2024-01-01T12:00:00+02:00", ["true"]),
    ("@T10:30 < @T10:31", ["true"]), ("@T10:30 = @T10:30:00", ["false"]), ("@2024-01-01T10:15:20.500Z.second()", ["20"]), ("@2024-01-01T10:15Z.millisecond()", ["0"]),
    ("value > 70000 'g'", ["true"]), ("1 'g' = 1000 'mg'", ["true"]), ("1 'g' = 1 's'", ["false"]), ("1 'kg' ~ 1000.0000000001 'g'", ["true"]), ("(1 'g' + 2 'g').toString()", ["3 g"]), ("'5 mg'.toQuantity() = 5 'mg'", ["true"]), ("5.toQuantity('kg').toString()", ["5 kg"]), ("'5 mg'.convertsToQuantity('g')", ["true"]), ("'x'.convertsToQuantity()", ["false"]),
    ("extension('http://x/b').value", ["B"]), ("hasExtension('http://x/c')", ["false"]), ("getExtensionValue('http://x/a')", ["A"]), ("managingOrganization.getReferenceKey()", ["Organization/7"]), ("managingOrganization.getReferenceKey('type')", ["Organization"]), ("managingOrganization.reference.getReferenceKey('id')", ["7"]), ("managingOrganization.resolve()", []),
    ("%resource.id & %context.id", ["p1p1"]), ("id.trace('x')", ["p1"]), ("name.children().count()", ["6"]), ("managingOrganization.descendants()", ["http://server/fhir/Organization/7"]), ("name.repeat(given)", ["Peter", "James", "Jim"]),
    ("1 + 2 /* note */ * 3 // end", ["7"]), ("a.b.c.exists()", ["false"]), ("telecom.where(rank > 1 and system = 'phone').value", ["1"]), ("telecom.rank.max()", ["2"]), ("5 > 3 is Boolean", ["true"]), ("'it\\'s'", ["it's"]),
]


@pytest.fixture(scope="module")
def frame(spark):
    return parse_documents(spark.createDataFrame([(json.dumps(DOCUMENT),)], "json string"), "json", SCHEMA)


@pytest.mark.parametrize(("expression", "wanted"), CASES)
def test_schema_less(expression, wanted):
    got = [text(x) for x in evaluate(expression, json.dumps(DOCUMENT))]
    assert [_plain(x) for x in got] == wanted


def _plain(x: str) -> str:
    try:
        return format(float(x), ".12g") if "." in x and x.replace(".", "").replace("-", "").isdigit() else x
    except ValueError:
        return x


def test_compiled(frame):
    """All cases in a few plans."""
    wrong = []
    for at in range(0, len(CASES), 25):
        part = CASES[at : at + 25]
        row = E.select(frame, {f"e{i}": (e, "texts") for i, (e, _) in enumerate(part)}).first()
        wrong += [(e, row[f"e{i}"], want) for i, (e, want) in enumerate(part) if row[f"e{i}"] != want]
    assert not wrong


def test_all_functions_are_there():
    names = """aggregate children descendants not hasValue getValue combine union as empty exists all allTrue anyTrue allFalse anyFalse count distinct isDistinct
    subsetOf supersetOf where select repeat ofType first last tail skip take single intersect exclude iif toBoolean convertsToBoolean toInteger convertsToInteger toDecimal
    convertsToDecimal toString convertsToString toDate convertsToDate toDateTime convertsToDateTime toTime convertsToTime toQuantity convertsToQuantity is abs ceiling exp
    floor ln log power round sqrt truncate sum min max avg resolve extension hasExtension getExtensionValue getReferenceKey startsWith endsWith contains replace matches
    replaceMatches indexOf substring lower upper toChars split join trim length year month day hour minute second millisecond now today timeOfDay trace""".split()
    from lumenpath.interp.evaluator import _FUNCTIONS

    assert len(names) == 96 and set(names) <= set(registry.names()) and set(names) <= set(_FUNCTIONS)


@pytest.mark.parametrize("expression", ["", "  ", "name.", "a b", "1 +", "(1", "name[", "@2024-01-15T", "'open", "a..b", "#"])
def test_syntax_errors(expression):
    with pytest.raises(ParseError):
        parse(expression)


@pytest.mark.parametrize(("expression", "error"), [("nope()", FunctionNotFound), ("name.where()", InvalidArguments), ("%unknown", InvalidPath), ("'a'.matches('(((((((a)))))))')", InvalidArguments), ("'a'.matches('a**')", InvalidArguments)])
def test_errors_in_both(frame, expression, error):
    with pytest.raises(error):
        evaluate(expression, json.dumps(DOCUMENT))
    with pytest.raises(error):
        E.select(frame, {"x": expression})


@pytest.mark.parametrize(("expression", "error"), [("name + 1", SingletonExpected), ("name.single()", SingletonExpected), ("1 / 0", PathError), ("id > 1", TypeMismatch), ("@2024 < @2024-01", TypeMismatch), ("1 'g' < 1 's'", TypeMismatch)])
def test_row_errors(frame, expression, error):
    with pytest.raises(error):
        evaluate(expression, json.dumps(DOCUMENT))
    if expression != "name + 1":
        assert E.select(frame, {"x": (expression, "texts")}).first().x == []
        with pytest.raises(Exception, match="[a-z]"):
            E.select(frame, {"x": (expression, "texts")}, strict=True).collect()


def test_precedence():
    assert parse("1 + 2 * 3") == parse("1 + (2 * 3)") and parse("a or b and c") == parse("a or (b and c)")
    assert parse("-1.abs()") == parse("-(1.abs())") and parse("a = b | c") == parse("a = (b | c)") and parse("a and b implies c or d") == parse("(a and b) implies (c or d)")


def test_spec_mode(frame):
    spec = lambda e: (E.select(frame, {"x": (e, "texts")}, spec=True).first().x, [text(x) for x in evaluate(e, json.dumps(DOCUMENT), spec=True)])
    for e, want in [("(@2024-01-31 + 1 month).toString()", ["2024-02-29"]), ("words | 'c'", ["b", "a", "c"]), ("nothing.single()", []), ("'10:30'.toTime().minute()", ["30"]), ("words = words", ["true"])]:
        assert spec(e) == (want, want), e
    assert evaluate("nothing.sum()", "{}", spec=True) == []


def test_user_functions_and_variables(frame):
    registry.register("twice", 0, 0, lambda this: Coll(this.kind, this.col * 2))
    row = E.select(frame, {"x": ("age.twice()", "integer"), "y": ("age > %limit", "boolean")}, variables={"limit": 40}).first()
    assert (row.x, row.y) == (82, True)


def test_item_limit(frame):
    with pytest.raises(Exception, match="more than 2 items"):
        E.select(frame, {"x": "numbers.where($this > 0)"}, max_items=2).collect()


def test_plan_stays_in_the_jvm_and_prunes(spark):
    from lumenpath.sources.documents import patients

    df = E.where(E.select(patients(spark, "/root/testdata/sf0.001"), {"v": ("Patient.name.where(use = 'official').family", "text")}, ("id", "resourceType")), "id = '5'")
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "BatchEvalPython" not in plan
    scan = next(line for line in plan.split("\n") if "ReadSchema" in line and "customer" in line)
    assert "c_comment" not in scan and "c_acctbal" not in scan.split("ReadSchema")[-1]


def test_resolve_by_join(spark):
    from pyspark.sql import functions as F

    from lumenpath.operators import references

    people = spark.createDataFrame([("Patient/1", "Patient", "Ann"), ("Patient/2", "Patient", "Bob")], "key string, resourceType string, family string")
    visits = spark.createDataFrame([("a", ["Patient/1", "http://s/x/Patient/2"]), ("b", ["Patient/9"]), ("c", None)], "id string, subject array<string>")
    got = references.resolve(visits, "subject", people, "key", ("id",)).select("id", "pos", F.col("document.family").alias("f")).collect()
    assert sorted(tuple(r) for r in got) == [("a", 0, "Ann"), ("a", 1, "Bob"), ("b", 0, None)]
    joined, variables = references.with_resolved(visits, "subject", people, "key", "id")
    row = {r.id: r.x for r in E.select(joined, {"x": ("subject.resolve().family", "texts")}, ("id",), variables=variables).collect()}
    assert row == {"a": ["Ann", "Bob"], "b": [], "c": []}
    assert [r.id for r in references.missing(visits, "subject", people, "key", ("id",)).collect()] == ["b"]
    forms = spark.createDataFrame([("#a",), ("Patient/1",), ("urn:uuid:01234567-89ab-cdef-0123-456789abcdef",), ("urn:oid:1.2.3",), ("http://s/fhir/Patient/1",), ("http://x|2",), ("??",)], "r string")
    assert [r.f for r in forms.select(references.parse_reference(F.col("r"))["form"].alias("f")).collect()] == ["contained", "relative", "uuid", "oid", "absolute", "canonical", "invalid"]


def test_bad_patterns_end_no_job(spark):
    """A pattern or replacement that comes from a row: its result is empty, with and without a schema."""
    from lumenpath.interp.evaluator import evaluate
    from lumenpath.lang.errors import InvalidArguments
    from lumenpath.operators import dynamic

    df = spark.createDataFrame([("ab", "a", "<$1$9>"), ("ab", "(", "x$"), ("ab", "(a)", "\\$0\\"), ("ab", "a{99999999999}", "")], "x string, p string, r string").coalesce(1)
    rows = E.select(df, {"m": ("x.matches(%resource.p)", "boolean"), "r": ("x.replaceMatches(%resource.p, %resource.r)", "text"), "g": ("x.replaceMatches('(a)', '[$1$2${7}]')", "text")}).collect()
    assert [r.m for r in rows] == [True, None, True, None]
    assert rows[0].r == "<>b" and rows[1].r is None and [r.g for r in rows] == ["[a]b"] * 4
    assert dynamic.select(df.select(E.as_json(df).alias("json")), "json", {"m": "x.matches(p)", "r": "x.replaceMatches('x', '$1')", "g": "x.replaceMatches('(a)', '[$1$2]')"}).count() == 4
    for bad in ("x.matches('(')", "x.replaceMatches('[', 'a')"):
        with pytest.raises(InvalidArguments):
            evaluate(bad, '{"x": "ab"}')


def test_references_match_whole_texts(spark):
    from lumenpath.operators.references import matched, parse_reference

    texts = ["Organization/1", "Organization/1\n", "#a", "#a\n", "urn:oid:1.2", "urn:oid:1.2\u0663", "http://h/x/Patient/1", "http://h/x/Patient/1\n", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_reference(F.col("t")).alias("r")).collect()
    assert [r.r and r.r.form for r in got] == ["relative", "invalid", "contained", "invalid", "oid", "invalid", "absolute", "canonical", None]
    assert matched(references.RELATIVE, "Organization/1") and not matched(references.RELATIVE, "Organization/1\n")


def test_descendants_of_deep_documents(spark):
    """More than eight levels; what no schema bounds is refused, not cut."""
    from lumenpath.lang.errors import InvalidOperation

    deep = "v: string"
    for _ in range(12):
        deep = f"v: string, below: struct<{deep}>"
    value = None
    for k in range(13):
        value = {"v": str(12 - k)} | ({"below": value} if value else {})
    df = spark.createDataFrame([(json.dumps(value),)], "j string").select(F.from_json("j", f"struct<{deep}>").alias("d")).select("d.*")
    row = E.select(df, {"r": ("repeat(below).count()", "integer"), "all": ("descendants()", "texts")}).first()
    assert row.r == 12 and sum(x in {str(k) for k in range(13)} for x in row["all"]) == 13
    with pytest.raises(InvalidOperation):
        E.select(df, {"x": "v.repeat($this & 'x')"})
