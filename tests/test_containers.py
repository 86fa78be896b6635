import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import sequence as S
from sparkloom.operators.containers import Multimap, OrderedMap, OrderedSet, Vector
from sparkloom.operators.positions import find_sum, with_positions
from sparkloom.sources.store import Store, StoreError
from sparkloom.sources.tables import compile_commands
from sparkloom.plans.sql import ToolServer, as_records
from sparkloom.streaming import channels


@pytest.fixture(scope="module")
def symbols():
    rng = random.Random(3)
    out = []
    while len(out) < 9000:
        out += [rng.randrange(4)] * rng.choice([1, 1, 2, 7, 40])
    return out


@pytest.fixture(scope="module")
def seq(spark, symbols):
    return spark.createDataFrame(list(enumerate(symbols)), "pos long, symbol int").cache()


TEST = {"eq": int.__eq__, "neq": int.__ne__, "lt": int.__lt__, "le": int.__le__, "gt": int.__gt__, "ge": int.__ge__}


@pytest.mark.parametrize("op", sorted(TEST))
def test_rank_select(spark, seq, symbols, op):
    n = len(symbols)
    asked = [(p, s) for p in (0, 1, 255, 256, 257, 4095, n - 1, n, n + 700) for s in (0, 2, 3)]
    got = {(r.pos, r.symbol): r["rank"] for r in S.rank(seq, spark.createDataFrame(asked, "pos long, symbol int"), op, block=256).collect()}
    assert got == {(p, s): sum(TEST[op](x, s) for x in symbols[:p]) for p, s in asked}
    asked = [(s, r) for r in (0, 1, 500, 2000, 10**6) for s in (0, 2, 3)]
    q = spark.createDataFrame(asked, "symbol int, r long")
    for backward in (False, True):
        got = {(x.symbol, x.r): x.pos for x in S.select(seq, q, op, backward, block=256).collect()}
        for s, r in asked:
            at = [i for i, x in enumerate(symbols) if TEST[op](x, s)][:: -1 if backward else 1]
            assert got[s, r] == (at[r] if r < len(at) else n), (op, s, r)


def test_rank_of_every_position_keeps_rows_few(spark, seq, symbols):
    from sparkloom.plans.catalog import _asked_everywhere

    ranked = S.rank(seq, _asked_everywhere(seq, "pos"), "lt", block=256)
    want, seen = {}, [0] * 4
    for p, x in enumerate(symbols):
        want |= {(p, s): sum(seen[:s]) for s in range(4)}
        seen[x] += 1
    assert {(r.pos, r.symbol): r["rank"] for r in ranked.collect()} == want
    # no join of questions with all rows of their block
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "<" not in "".join(x for x in plan.splitlines() if "Join" in x and "pos" in x)


def test_runs(spark, seq, symbols):
    want, at = [], 0
    for i in range(1, len(symbols) + 1):
        if i == len(symbols) or symbols[i] != symbols[at]:
            want.append((at, i - at, symbols[at]))
            at = i
    packed = S.runs(seq, block=64)
    assert sorted(map(tuple, packed.select("start", "len", "symbol").collect())) == want
    assert sorted(map(tuple, S.unpacked(packed).select("pos", "symbol").collect())) == list(enumerate(symbols))
    lens = S.run_lengths(seq, seq.where("pos < 900"), block=64).collect()
    by = {p: (s, n) for s, n, _ in want for p in range(s, s + n)}
    assert len(lens) == 900 and all((r.forward, r.backward) == (by[r.pos][0] + by[r.pos][1] - r.pos, r.pos - by[r.pos][0] + 1) for r in lens)
    cut = S.remove(S.insert(seq, 10, spark.createDataFrame([(0, 9), (1, 9)], "pos long, symbol int"), 2), 10, 12)
    assert sorted(map(tuple, cut.collect())) == list(enumerate(symbols))
    free = S.free_runs(spark.createDataFrame([(i, i % 5 < 2) for i in range(20)], "pos long, allocated boolean"))
    assert sorted(map(tuple, free.collect())) == [(2, 3), (7, 3), (12, 3), (17, 3)]


def test_sequence_of_nothing(spark):
    empty = spark.createDataFrame([], "pos long, symbol int")
    assert S.runs(empty).count() == 0
    got = S.rank(empty, spark.createDataFrame([(5, 1)], "pos long, symbol int")).collect()
    assert [r["rank"] for r in got] == [0]


def test_map_against_dict(spark):
    rng = random.Random(5)
    d = {f"k{rng.randrange(10**6):06}": rng.random() for _ in range(3000)}
    m = OrderedMap(spark.createDataFrame(list(d.items()), "key string, value double"))
    keys = sorted(d)
    assert [r.key for r in m.find("k5").limit(3).collect()] == [k for k in keys if k >= "k5"][:3]
    assert m.seek(77).first().key == keys[77] and m.first().first().key == keys[0] and m.last().first().key == keys[-1]
    asked = spark.createDataFrame([("k2",), ("k99999999",), ("",), (keys[9],)], "q string")
    got = {r.q: r.key for r in m.lower_bounds(asked).collect()}
    assert got == {q: next((k for k in keys if k >= q), None) for q in ("k2", "k99999999", "", keys[9])}
    new = m.upsert(spark.createDataFrame([(keys[0], 1.0, 1), (keys[0], 2.0, 2), ("zz", 3.0, 1)], "key string, value double, seq int"), "seq")
    assert dict(map(tuple, new.df.collect())) == d | {keys[0]: 2.0, "zz": 3.0}
    some = spark.createDataFrame([(keys[1],), ("none",)], "key string")
    assert {r.key for r in m.removed(some).collect()} == {keys[1]} and m.remove(some).df.count() == len(d) - 1
    assert {r.key: r.existed for r in m.existed(some).collect()} == {keys[1]: True, "none": False}
    assert m.remove_positions(5, len(d)).df.count() == 5
    with pytest.raises(Exception, match="key exists"):
        m.insert(spark.createDataFrame([(keys[3], 0.0)], "key string, value double")).df.collect()


def test_set_vector_multimap(spark):
    s = OrderedSet(spark.createDataFrame([(f"e{i:03}",) for i in range(100)], "key string"))
    assert [r.key for r in s.read(97, 10).orderBy("key").collect()] == ["e097", "e098", "e099"]
    assert s.upsert(s.df).df.count() == 100 and s.intersect(OrderedSet(s.df.limit(7))).df.count() == 7
    v = Vector(spark.createDataFrame([(i, f"v{i}") for i in range(10)], "pos long, value string"))
    w = Vector(spark.createDataFrame([(0, "x"), (1, "y")], "pos long, value string"))
    out = [r.value for r in v.insert(4, w, 2).remove(0, 2).df.orderBy("pos").collect()]
    assert out == ["v2", "v3", "x", "y", *(f"v{i}" for i in range(4, 10))]
    m = Multimap(spark.createDataFrame([("a", 1, 5), ("a", 0, 4), ("b", 0, 9), ("c", 0, 1)], "key string, ord long, value int"))
    groups = {r.key: r["values"] for r in m.grouped().collect()}
    assert groups == {"a": [4, 5], "b": [9], "c": [1]}
    assert {(r.key, r.ord, r.value) for r in Multimap.of_groups(m.grouped()).df.collect()} == {(r.key, r.ord, r.value) for r in m.df.collect()}
    assert {r.key for r in m.remove_range("b").df.collect()} == {"a"} and {r.key for r in m.remove_range(None, "b").df.collect()} == {"b", "c"}


def test_positions_and_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert all(r.k == r.pos for r in with_positions(df, "k").collect())
    rows = spark.range(5000).select(F.col("id").alias("pos"), F.lit(2).alias("v"))
    assert find_sum(rows, "pos", "v", 100).first().pos == 50 and find_sum(rows, "pos", "v", 100, strict=False).first().pos == 49


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store = Store.create(spark, path)
    df = spark.range(5).select(F.col("id").alias("key"))
    w = store.begin(description="first")
    w.put("s", df, "Set<BigInt>", {"owner": "me"})
    with pytest.raises(StoreError):
        store.begin()
    one = w.commit()
    with pytest.raises(StoreError):
        w.commit()
    w = store.begin()
    w.put("s", df.where("key > 2"), "Set<BigInt>")
    w.rollback()
    store.branch_from("main", "side")
    w = store.begin("side")
    w.put("s", df.where("key > 2"), "Set<BigInt>")
    w.set_reference("s", "next", "t")
    two = w.commit()
    assert store.open().find("s").count() == 5 and store.open("side").find("s", "Set<BigInt>").count() == 2
    assert store.open(id_=one.id).property("s", "owner") == "me" and store.branches() == ["main", "side"]
    with pytest.raises(StoreError):
        store.open().find("s", "Set<Varchar>")
    with pytest.raises(StoreError):
        store.open().find("none")
    assert [r.id for r in store.linear_history(two.id).orderBy("depth").collect()][:2] == [two.id, one.id]
    assert len(store.vacuum()) == 1  # what was rolled back
    w = store.begin("side")
    w.import_from(one, "s", "old")
    w.copy_from(one, "s", "copy")
    three = w.commit()
    assert three.names() == ["copy", "old", "s"] and three.containers["old"]["path"] == one.containers["s"]["path"]
    store.remove_snapshot(two.id)
    assert store.snapshot(three.id).parent == one.id
    store.check()
    assert store.copy_to(f"file://{tmp_path}/other", "side").open().names() == ["copy", "old", "s"]
    with pytest.raises(StoreError):
        Store.open_store(spark, f"file://{tmp_path}/nowhere")


def test_sql_tools(spark, tmp_path):
    import io
    import json

    rows = [json.loads(r.record) for r in as_records(spark.sql("SELECT 1 AS a, NULL AS b, 'x' AS a")).collect()]
    assert rows == [{"a": "x", "b": "NULL"}]
    server, out = ToolServer(spark), io.StringIO()
    lines = ['{"tool": "add_numbers", "params": {"a": 2, "b": 3}}', '{"tool": "sql_query", "params": {"query": "SELECT 7 AS n"}}', '{"tool": "no"}', "{", '{"tool": "init"}']
    server.serve(iter(lines), out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert answers[0] == {"result": 5} and answers[1] == {"result": [{"n": "7"}]} and "error" in answers[2] and "error" in answers[3]
    assert [t["name"] for t in answers[4]["result"]] == ["add_numbers", "init", "sql_query"]
    (tmp_path / "c.json").write_text('[{"directory": "d", "file": "f.c"}, {"command": "cc"}]')
    assert [tuple(r) for r in compile_commands(spark, str(tmp_path / "c.json")).collect()] == [("d", "", "f.c"), ("", "cc", "")]


def test_channels(spark, tmp_path):
    path = str(tmp_path / "in")
    for k in range(3):
        channels.push(spark.range(k * 1000, k * 1000 + 1000).select(F.col("id").alias("value")), path)
    stream = channels.pop(spark, path, "value long", max_files=1)
    assert channels.drained(channels.running_sum(stream, "value")).first().total == sum(range(3000))
    channels.call(channels.pop(spark, path, "value long"), lambda df: df.select((F.col("value") * 2).alias("value")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("value")).first()[0] == 2 * sum(range(3000))


def test_vacuum_and_locks(spark, tmp_path):
    store = Store.create(spark, f"file://{tmp_path}/v")
    w = store.begin()
    w.put("a", spark.range(3), "Set<BigInt>")
    with pytest.raises(StoreError):
        store.vacuum()
    w.commit()
    assert store.vacuum() == [] and store.open().find("a").count() == 3
    with pytest.raises(StoreError):
        store.begin("no such branch")
    w = store.begin()  # the failed one left no lock
    w.put("b", spark.range(1), "Set<BigInt>")
    store.break_lock()
    assert len(store.vacuum()) == 1
    store.begin().rollback()
