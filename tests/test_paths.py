import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import documents, path_naive, paths
from sparkloom.functions.path_syntax import parse_path
from sparkloom.functions.templates import TemplateError, render, render_naive
from sparkloom.functions.values import SyntaxProblem, parse_datatype, parse_document, parse_value, to_text

DOCS = [
    {
        "people": [{"n": "a", "age": 30, "tags": ["x", "y"]}, {"n": "b", "age": None, "tags": []}, {"n": "c", "tags": ["z"]}],
        "m": {"k1": 1, "k2": 2.5}, "nested": [[1, 2], [3], 4], "s": "héllo", "t": True, "e": [], "d": -1.5,
        "nums": [3, 1, 2, 2.5], "mix": [1, "a", True, None, [1], {"q": 1}], "strs": ["b", "a"], "interest": 5,
    },
    {},
    {"people": 5, "m": [1], "nested": None, "s": 7},
    {"people": [], "m": {}, "nums": ["x"], "nested": [1, [2, [3]]]},
]

PATHS = """
people[*].n ; people[?age > ^20].n ; people[].tags[] ; people[-1] ; people[::-1].n ; people[1:].n ; people[0:2].tags[0]
people[:-1].n ; people[5:1].n ; * ; m.* ; {a: m.k1, b: nested[0]} ; [m.k1, missing] ; people | [0].n ; !missing ; length(people)
map(&age, people) ; sort_by(people, &n) ; max_by(people, &age) ; min_by(people, &age) ; merge(m, ^{"k1": 9}) ; not_null(missing, m.k2)
join(', ', people[*].n) ; nested[] ; nested[*] ; nested[0][1] ; nested[*][0] ; abs(d) ; ceil(d) ; floor(d) ; avg(nums) ; sum(nums)
sum(e) ; avg(e) ; max(nums) ; min(nums) ; max(strs) ; sort(nums) ; sort(mix) ; reverse(strs) ; keys(m) ; values(m) ; contains(nums, ^2)
contains(s, 'll') ; starts_with(s,'h') ; ends_with(s,'o') ; length(s) ; to_string(m) ; to_string(d) ; to_double('1.5') ; to_double('x')
to_bigint('12') ; to_boolean('false') ; to_boolean(d) ; type(d) ; type(m) ; type(s) ; type(nums) ; type(missing) ; to_array(s)
to_array(nums) ; t && s ; t || s ; e || s ; missing && s ; s == 'héllo' ; nums[?@ >= ^2] ; people[?n == 'a' || n == 'c'].n
people[?!age].n ; people[?tags[0]].{n: n, t: tags[0]} ; m.k1 < m.k2 ; t == 'true' ; people[*].tags ; people[*].tags[] ; people[*].[n, age]
"people"[0]."n" ; people[?contains(tags, 'z')] | [0].n ; ^[1, 2][0] ; people[0].* ; *.k1 ; @.s ; (s) ; length(@) ; people[*].missing
s[0] ; mix[?type(@) == 'Varchar'] ; e[0] ; e[*] ; nested[::2] ; nested[-2:] ; interest ; ^?p ; m.k1 == ^?p ; 'raw' ; nums[2:0:-1]
"""


def test_paths_equal_naive(spark):
    todo = [p.strip() for line in PATHS.strip().splitlines() for p in line.split(";")]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)], "i int, j string").withColumn("v", paths.document("j")).cache()
    for k in range(0, len(todo), 12):
        some = todo[k : k + 12]
        for r in df.select("i", *(F.to_json(paths.search("v", q, {"p": 1})).alias(str(n)) for n, q in enumerate(some))).collect():
            for n, q in enumerate(some):
                got = json.loads(r[str(n)]) if r[str(n)] is not None else None
                assert got == path_naive.search(q, DOCS[r.i], {"p": 1}), (q, r.i)


@pytest.mark.parametrize("bad", ["a.", "[", "a[1:2:0]", "a b", "a | ", '""', "f(", "{a}", "a[?b", "^"])
def test_syntax_errors(bad):
    with pytest.raises((SyntaxProblem, IndexError)):
        parse_path(bad)


@pytest.mark.parametrize("bad", ["nothing(a)", "abs()", "abs(a, b)", "sort_by(a, b)", "abs(&a)", "^?unbound"])
def test_compile_errors(spark, bad):
    with pytest.raises(paths.PathError):
        paths.search(F.parse_json(F.lit("{}")), bad)


def test_strict_raises(spark):
    with pytest.raises(Exception, match="wrong type"):
        spark.range(1).select(F.to_json(paths.search(F.parse_json(F.lit('{"a": "x"}')), "abs(a)", strict=True))).collect()


def test_values():
    assert parse_value("12345ll") == 12345 and parse_value("0xffu") == 255 and parse_value("0b11_u8") == 3
    assert parse_value("1.5") == 1.5 and parse_value("100d") == 100.0 and parse_value("-.5e1") == -5.0
    assert parse_value("{ // note\n a: [1, 'x', null], \"b c\": true }") == {"a": [1, "x", None], "b c": True}
    doc = parse_document("#{Money: Decimal(5,2)} {v: '123.4'@#Money, t: #Money, x: <Integer>[1, 2], p: ?name}")
    assert doc.value["v"].type == doc.types["Money"] and str(doc.types["Money"]) == "Decimal(5, 2)"
    assert str(parse_datatype("const Map<Varchar, Array<BigInt>>*&")) == "const Map<Varchar, Array<BigInt>>*&"
    assert parse_document(to_text(doc.value["v"])).value == doc.value["v"]
    assert parse_value('"\\ud83d\\ude00"') == "😀"
    for bad in ("300_u8", "{a 1}", "[1,", "'x", "1 2"):
        with pytest.raises(SyntaxProblem):
            parse_value(bad)


json_values = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.text(max_size=8).filter(lambda s: s.isprintable()),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5).filter(lambda s: s.isprintable()), x, max_size=4),
    max_leaves=12,
)


@settings(max_examples=80, deadline=None)
@given(json_values)
def test_json_is_document_text(v):
    assert parse_value(json.dumps(v)) == v and parse_value(to_text(v)) == v


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=8), st.integers(-9, 9) | st.none(), st.integers(-9, 9) | st.none(), st.integers(-3, 3).filter(bool))
def test_slices_naive(xs, a, b, c):
    text = f"[{'' if a is None else a}:{'' if b is None else b}:{c}]"
    assert path_naive.search(f"x{text}", {"x": xs}) == xs[a:b:c]


def test_document_columns(spark):
    df = spark.createDataFrame([('{"a": [1, 2, 3], "m": {"x": 1}}',), ("{a: [1,2,3], m: {x: 1}} // superset",), ("nonsense [",), (None,)], "t string")
    v, a, m = F.col("v"), paths.search("v", "a"), paths.search("v", "m")
    rows = df.select(documents.parse("t").alias("v")).select(
        F.to_json(documents.array_set(a, 1, F.lit(9))),
        F.to_json(documents.array_push(a, F.lit("z"))),
        F.to_json(documents.array_remove(a, 0, 2)),
        documents.array_get(a, -1).cast("int"),
        F.to_json(documents.map_put(m, "y", F.lit(2))),
        F.to_json(documents.map_remove(m, "x")),
        documents.compare(paths.search("v", "a[0]"), paths.search("v", "a[1]")),
        documents.equals(paths.search("v", "a[0]"), paths.search("v", "m.x")),
        v.isNull(),
    ).collect()
    want = ("[1,9,3]", '[1,2,3,"z"]', "[3]", 3, '{"x":1,"y":2}', "{}", -1, True, False)
    assert tuple(rows[0]) == want and tuple(rows[1]) == want
    assert rows[2][-1] and rows[3][-1]
    with pytest.raises(Exception, match="no key"):
        df.limit(1).select(documents.map_expect(documents.parse("t"), "zz").cast("string")).collect()
    t = spark.createDataFrame([("Decimal(1,2)",), ("?",)], "t string").select(documents.datatype("t").alias("d")).collect()
    assert t[0].d.name == "Decimal" and t[0].d.args == ["1", "2"] and t[1].d.name is None


TEMPLATES = [
    "plain", "{{ s }} and {{ missing }}!", "{% for p in people %}{{ p.n }}{% if p.age %}={{ p.age }}{% else %}?{% endif %};{% endfor %}",
    "{% set x = m.k1 %}{% for p in people %}{% for t in p.tags %}{{ x }}{{ t }}{{ p.n }} {% endfor %}{% endfor %}",
    "{% if e %}a{% elif t %}b{% else %}c{% endif %}", "a  {%- if t -%}  b  {%- endif -%}  c",
    "<ul>\n  {% for p in people %}\n  <li>{{ p.n }}</li>\n  {% endfor %}\n</ul>\n", "{{ m }} {{ t }} {{ d }}",
]


def test_templates(spark):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)], "i int, j string").withColumn("v", paths.document("j"))
    for r in df.select("i", *(render(t, "v").alias(str(n)) for n, t in enumerate(TEMPLATES))).collect():
        for n, t in enumerate(TEMPLATES):
            assert r[str(n)] == render_naive(t, DOCS[r.i]), (t, r.i)
    assert render_naive(TEMPLATES[6], DOCS[0]) == "<ul>\n  <li>a</li>\n  <li>b</li>\n  <li>c</li>\n</ul>\n"
    assert render_naive(TEMPLATES[5], DOCS[0]) == "abc"
    for bad in ("{% for %}{% endfor %}", "{% if a %}", "{# c #}", "{% what %}"):
        with pytest.raises(TemplateError):
            render(bad, "v")


def test_row_tests_reach_the_scan(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    plan = paths.where_rows(events, "value > ^100 && event_type == 'view'").select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,100" in plan and "EqualNullSafe(event_type,view)" in plan and "props" not in plan
    native, via = paths.where_rows(events, "!(value > ^100)").count(), events.where(~(F.col("value") > 100)).count()
    assert native == via and paths.where_rows(events, "starts_with(event_type, 'v')").count() == events.where("event_type like 'v%'").count()


def test_hand_written_results(spark):
    """Expectations that share no code with the compiler or its parser."""
    text = '{"a":{"b":true,"l":[1,2]},"x":9007199254740993,"y":9007199254740992,"n":[3,1.5,2,null],"e":[],"t":"true","dec":12345678901234567890.5}'
    df = spark.createDataFrame([(text,)], "t string").select(paths.document("t").alias("d"))
    want = {
        "!a.b": False, "!a.c": True, "!a.l[0]": False, "!e": True, "!a.b || t": "true", "!a.c && x": 9007199254740993, "!a.b == a.c": False,
        "x == y": False, "x != y": True, "x > y": True, "y < x": True, "x >= x": True, "x < y": False, "t > x": None,
        "max([y, x])": 9007199254740993, "min([x, y])": 9007199254740992, "sort([x, y])": [9007199254740992, 9007199254740993],
        "contains([x], y)": False, "contains([x], x)": True, "[x, y][?@ == ^9007199254740993]": [9007199254740993],
        "sort(n)": [None, 1.5, 2, 3], "max(n)": 3, "min(n)": 1.5, "n[?@ > ^1.5]": [3, 2], "n[?^2 <= @]": [3, 2], "a.b == t": True, "length(n[?@ != ^2])": 2,
        "to_bigint(x)": 9007199254740993, "a.l[1]": 2, "a.l[-1]": 2, "a.l | [0]": 1, "min_by([{k: x, v: 't'}, {k: y, v: 'u'}], &k).v": "u",
    }
    row = df.select(*(F.to_json(paths.search("d", q)).alias(str(i)) for i, q in enumerate(want))).first()
    got = {q: json.loads(row[str(i)]) if row[str(i)] is not None else None for i, q in enumerate(want)}
    assert got == want


def test_nested_tests_stay_small(spark):
    df = spark.createDataFrame([("{}",)], "t string").select(paths.document("t").alias("d"))
    plan = df.select(paths.search("d", "length(lines[?a > ^25 && b.c == 'x' || !d])"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000
