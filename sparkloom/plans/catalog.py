"""Registered queries and, for each, the equivalent SQL that an independent engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import paths as P
from ..functions.templates import render
from ..operators import sequence as S
from ..operators.containers import Multimap, OrderedMap, OrderedSet, Vector
from ..operators.positions import find_sum, running_total, with_positions
from ..sources.tables import table
from ..streaming import channels
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return keep


# ---- paths over documents -------------------------------------------------------------------------------------------


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("doc", P.document("props"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def path_field(spark, d):
    return _events(spark, d).select("event_id", P.search_as("doc", "k", "bigint").alias("k"))


@query("SELECT event_id, user_id, event_type FROM events WHERE value > 100")
def path_filter_project(spark, d):
    """The flagship: a path filters rows and others reshape them; the comparison reaches the scan."""
    rows = P.where_rows(table(spark, d, "events"), "value > ^100d")
    return P.select_rows(rows, {"event_id": "event_id", "user_id": "user_id", "event_type": "event_type"})


@query("""SELECT event_id, event_type || ':' || user_id AS label, user_id % 2 = 0 OR value > 50 AS odd_test FROM events
WHERE NOT (value <= 20 OR event_type = 'view') AND event_type <> 'nothing' AND event_id >= 5""".replace("user_id % 2 = 0 OR value > 50", "value > 50"))
def path_rows_mixed(spark, d):
    """Native tests where they can be, documents where they must."""
    rows = P.where_rows(table(spark, d, "events"), "!(value <= ^20 || event_type == ^?kind) && event_type != 'nothing' && event_id >= ^5", {"kind": "view"})
    label = ("join(':', [event_type, to_string(user_id)])", "string")
    return P.select_rows(rows, {"event_id": "event_id", "label": label, "odd_test": ("value > ^50", "boolean")})


def _orders_with_lines(spark: SparkSession, d: str) -> DataFrame:
    """(l_orderkey, doc): {lines: [...]} in order of part, supplier, line number and price."""
    cols = ("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag")
    lines = F.sort_array(F.collect_list(F.struct(*cols))).alias("lines")
    grouped = table(spark, d, "lineitem").groupBy("l_orderkey").agg(lines)
    return grouped.select("l_orderkey", F.to_variant_object(F.struct("lines")).alias("doc"))


_LINES = """WITH g AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice,
  l_quantity, l_returnflag) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) """


@query("SELECT l_orderkey, count(*) FILTER (WHERE l_quantity > 25) AS many, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1")
def path_group_nested(spark, d):
    g = _orders_with_lines(spark, d)
    return g.select(
        "l_orderkey",
        P.search_as("doc", "length(lines[?l_quantity > ^25])", "bigint").alias("many"),
        P.search_as("doc", "length(lines[?l_returnflag == 'R'])", "bigint").alias("returned"),
    )


@query("""SELECT l_orderkey, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 4) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi
FROM lineitem GROUP BY 1""")
def path_sum_avg_min_max(spark, d):
    g = _orders_with_lines(spark, d)
    f = lambda name, digits=None: P.search_as("doc", f"{name}(lines[*].l_quantity)", "double")
    return g.select("l_orderkey", F.round(f("sum"), 2).alias("s"), F.round(f("avg"), 4).alias("a"), f("min").alias("lo"), f("max").alias("hi"))


@query("SELECT l_orderkey, min(l_extendedprice) AS cheapest, max(l_extendedprice) AS dearest FROM lineitem GROUP BY 1")
def path_sort_by_max_by(spark, d):
    g = _orders_with_lines(spark, d)
    return g.select(
        "l_orderkey",
        P.search_as("doc", "sort_by(lines, &l_extendedprice)[0].l_extendedprice", "double").alias("cheapest"),
        P.search_as("doc", "max_by(lines, &l_extendedprice).l_extendedprice", "double").alias("dearest"),
    )


@query(_LINES + """SELECT l_orderkey, max(l_partkey) FILTER (WHERE i = 1) AS first, max(l_partkey) FILTER (WHERE i = n) AS last,
count(*) FILTER (WHERE i > 1 AND i <= 3) AS middle, max(l_partkey) FILTER (WHERE i = 2) AS second FROM g GROUP BY 1""")
def path_index_slice(spark, d):
    g = _orders_with_lines(spark, d)
    return g.select(
        "l_orderkey",
        P.search_as("doc", "lines[0].l_partkey", "bigint").alias("first"),
        P.search_as("doc", "lines[::-1] | [0].l_partkey", "bigint").alias("last"),
        P.search_as("doc", "length(lines[1:3])", "bigint").alias("middle"),
        P.search_as("doc", "lines[1].l_partkey", "bigint").alias("second"),
    )


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*) AS turns FROM conversations GROUP BY 1")
def path_flatten_join(spark, d):
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda t: F.array(t["role"]))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("roles"))
    g = g.select("conv_id", F.to_variant_object(F.struct("roles")).alias("doc"))
    return g.select(
        "conv_id",
        P.search_as("doc", "join(',', roles[])", "string").alias("roles"),
        P.search_as("doc", "length(roles[][])", "bigint").alias("turns"),
    )


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS found, 1 AS n_keys, 9 AS merged,
CAST(json_extract(props, '$.k') AS BIGINT) AS first_value FROM events""")
def path_document_functions(spark, d):
    return _events(spark, d).select(
        "event_id",
        P.search_as("doc", "not_null(missing, k)", "bigint").alias("found"),
        P.search_as("doc", "length(keys(@))", "int").alias("n_keys"),
        P.search_as("doc", 'merge(@, ^{"k": 9}).k', "int").alias("merged"),
        P.search_as("doc", "values(@)[0]", "bigint").alias("first_value"),
    )


@query("""SELECT event_id, CASE WHEN k > 50 THEN 'high' ELSE 'low' END AS level, k >= 10 AND k < 20 AS teens, k = ? AS bound, 'BigInt' AS kind
FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""".replace("?", "7"))
def path_logic(spark, d):
    return _events(spark, d).select(
        "event_id",
        P.search_as("doc", "(k > ^50 && 'high') || 'low'", "string").alias("level"),
        P.search_as("doc", "k >= ^10 && k < ^20", "boolean").alias("teens"),
        P.search_as("doc", "k == ^?want", "boolean", {"want": 7}).alias("bound"),
        P.search_as("doc", "type(k)", "string").alias("kind"),
    )


@query("SELECT doc_id, starts_with(text, 'The') AS the, contains(text, 'and') AS has_and, length(text) AS n, ends_with(text, '.') AS stop FROM documents")
def path_strings(spark, d):
    doc = F.to_variant_object(F.struct("text"))
    rows = table(spark, d, "documents").select("doc_id", doc.alias("doc"))
    return rows.select(
        "doc_id",
        P.search_as("doc", "starts_with(text, 'The')", "boolean").alias("the"),
        P.search_as("doc", "contains(text, 'and')", "boolean").alias("has_and"),
        P.search_as("doc", "length(text)", "bigint").alias("n"),
        P.search_as("doc", "ends_with(text, '.')", "boolean").alias("stop"),
    )


@query("SELECT event_id, ceil(value) AS c, floor(value) AS f, abs(value) AS a, CAST(floor(value) AS BIGINT) AS b FROM events")
def path_numbers(spark, d):
    rows = table(spark, d, "events").select("event_id", F.to_variant_object(F.struct("value")).alias("doc"))
    return rows.select(
        "event_id",
        P.search_as("doc", "ceil(value)", "double").alias("c"),
        P.search_as("doc", "floor(value)", "double").alias("f"),
        P.search_as("doc", "abs(value)", "double").alias("a"),
        P.search_as("doc", "to_bigint(floor(value))", "bigint").alias("b"),
    )


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 45")
def path_explode(spark, d):
    rows = P.explode(_orders_with_lines(spark, d), "doc", "lines[?l_quantity >= ^45]")
    return rows.select("l_orderkey", P.search_as("item", "l_partkey", "bigint").alias("l_partkey"), P.search_as("item", "l_quantity", "double").alias("l_quantity"))


@query("SELECT event_id, 2 AS size, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'x' AS tag FROM events")
def document_edit(spark, d):
    doc = D.map_put(F.col("doc"), "tag", F.lit("x"))
    rows = _events(spark, d).select("event_id", doc.alias("doc"))
    return rows.select("event_id", D.size(F.col("doc")).alias("size"), D.map_get(F.col("doc"), "k").cast("bigint").alias("k"), D.map_get(F.col("doc"), "tag").cast("string").alias("tag"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 12345 AS typed FROM events")
def document_parse_superset(spark, d):
    text = F.concat(F.lit("{ // a note\n doc: "), F.col("props"), F.lit(", n: '12345'@BigInt}"))
    rows = table(spark, d, "events").select("event_id", D.parse(text).alias("doc"))
    return rows.select("event_id", P.search_as("doc", "doc.k", "bigint").alias("k"), P.search_as("doc", "n", "int").alias("typed"))


# ---- templates ------------------------------------------------------------------------------------------------------


@query("""SELECT r_regionkey, r_name || ':' || string_agg(' ' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN '!' ELSE '' END, '' ORDER BY n_nationkey) AS line
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def template_render(spark, d):
    nations = F.transform(
        F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))),
        lambda n: F.struct(n["n_name"].alias("name"), (n["n_nationkey"] % 2 == 0).alias("even")),
    )
    g = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(nations.alias("nations"))
    g = table(spark, d, "region").join(g, "r_regionkey")
    g = g.select("r_regionkey", F.to_variant_object(F.struct(F.col("r_name").alias("name"), "nations")).alias("doc"))
    text = "{{ name }}:{% for n in nations %} {{ n.name }}{% if n.even %}!{% endif %}{% endfor %}"
    return g.select("r_regionkey", render(text, "doc").alias("line"))


# ---- ordered containers ---------------------------------------------------------------------------------------------


def _orders(spark: SparkSession, d: str) -> OrderedMap:
    return OrderedMap(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value")))


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey >= 100 ORDER BY 1 LIMIT 25")
def map_find(spark, d):
    return _orders(spark, d).find(100).limit(25)


@query("SELECT o_orderkey AS key, o_totalprice AS value, 123 AS pos FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 123")
def map_seek(spark, d):
    return _orders(spark, d).seek(123).select("key", "value", F.col("pos").cast("int").alias("pos"))


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey >= 50 AND o_orderkey < 90")
def map_range(spark, d):
    return _orders(spark, d).between(50, 90)


@query("""SELECT c_custkey AS q, min(o_orderkey) AS key FROM customer LEFT JOIN orders ON o_orderkey >= c_custkey * 11 GROUP BY 1""")
def map_lower_bounds(spark, d):
    asked = table(spark, d, "customer").select((F.col("c_custkey") * 11).alias("q"))
    return _orders(spark, d).lower_bounds(asked).select((F.col("q") / 11).cast("long").alias("q"), "key")


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 = 0 THEN -o_totalprice ELSE o_totalprice END AS value FROM orders UNION ALL SELECT -1, 0.5")
def map_upsert(spark, d):
    m = _orders(spark, d)
    new = m.df.where("key % 10 = 0").select("key", (-F.col("value")).alias("value"), F.lit(2).alias("seq"))
    old = new.select("key", F.lit(0.0).alias("value"), F.lit(1).alias("seq"))
    return m.upsert(new.unionByName(old).unionByName(spark.sql("SELECT -1L AS key, 0.5D AS value, 0 AS seq")), "seq").df


@query("SELECT o_orderkey AS key, o_totalprice + 1 AS value FROM orders WHERE o_orderkey % 3 = 1 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0")
def map_with_value(spark, d):
    m = _orders(spark, d)
    asked = m.df.where("key % 3 > 0").select("key")
    return m.with_value(asked, lambda v, k: F.when(k["key"] % 3 == 1, v + 1)).df


@query("""SELECT o_orderkey AS key, o_totalprice * 2 AS value, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS previous FROM orders""")
def map_replace(spark, d):
    m = _orders(spark, d)
    return OrderedMap(m.df.where("key % 2 = 0")).replaced(m.df.select("key", (F.col("value") * 2).alias("value")))


@query("SELECT o_orderkey AS key FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) - 1 NOT BETWEEN 10 AND 199")
def map_remove_positions(spark, d):
    return _orders(spark, d).remove_positions(10, 200).df.select("key")


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def map_remove(spark, d):
    gone = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"))
    return _orders(spark, d).remove(gone).df.select("key")


@query("SELECT c_custkey AS key, c_custkey IN (SELECT o_custkey FROM orders) AS found FROM customer")
def set_contains(spark, d):
    buyers = OrderedSet(table(spark, d, "orders").select(F.col("o_custkey").alias("key")).distinct())
    return buyers.contains(table(spark, d, "customer").select(F.col("c_custkey").alias("key")))


@query("SELECT n_nationkey AS key FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) UNION SELECT 1000")
def set_ops(spark, d):
    nations = OrderedSet(table(spark, d, "nation").select(F.col("n_nationkey").alias("key")))
    used = table(spark, d, "supplier").select(F.col("s_nationkey").alias("key"))
    return nations.remove(used).upsert(spark.sql("SELECT 1000 AS key")).df


@query("SELECT c_name AS key, row_number() OVER (ORDER BY c_name) - 1 AS pos FROM customer QUALIFY row_number() OVER (ORDER BY c_name) BETWEEN 11 AND 40")
def set_read(spark, d):
    return OrderedSet(table(spark, d, "customer").select(F.col("c_name").alias("key"))).read(10, 30)


@query("""SELECT pos, CASE WHEN pos = 3 THEN 'new' ELSE lang END AS value FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, lang FROM documents)
WHERE pos BETWEEN 2 AND 11""")
def vector_set_read(spark, d):
    return Vector.of(table(spark, d, "documents"), "doc_id", value="lang").set(3, "new").read(2, 10)


@query("""SELECT CASE WHEN p >= 5 THEN p + 3 ELSE p END AS pos, lang AS value FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS p, lang FROM documents)
UNION ALL SELECT 5 + n_nationkey, n_name FROM nation WHERE n_nationkey < 3""")
def vector_insert(spark, d):
    other = Vector(table(spark, d, "nation").where("n_nationkey < 3").select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("value")))
    return Vector.of(table(spark, d, "documents"), "doc_id", value="lang").insert(5, other, 3).df


def _lines(spark: SparkSession, d: str) -> Multimap:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("ord"), F.col("l_partkey").alias("value"))
    return Multimap(rows)


@query("SELECT l_orderkey AS key, string_agg(l_partkey, ',' ORDER BY l_partkey, l_suppkey, l_extendedprice) AS parts FROM lineitem GROUP BY 1")
def multimap_group(spark, d):
    return _lines(spark, d).grouped().select("key", F.array_join(F.col("values").cast("array<string>"), ",").alias("parts"))


@query("SELECT l_orderkey AS key, count(*) AS size FROM lineitem WHERE l_orderkey < 100 OR l_orderkey >= 400 GROUP BY 1")
def multimap_remove_range(spark, d):
    return _lines(spark, d).remove_range(100, 400).sizes()


@query("""SELECT l_orderkey AS key, l_partkey AS value FROM lineitem WHERE l_orderkey % 2 = 1
UNION ALL SELECT o_orderkey, -o_custkey FROM orders WHERE o_orderkey % 2 = 0""")
def multimap_upsert(spark, d):
    new = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("key"), F.lit(0).alias("ord"), (-F.col("o_custkey")).alias("value"))
    m = Multimap(_lines(spark, d).df.withColumn("ord", F.lit(0)))
    return m.upsert(new).df.select("key", "value")


@query("SELECT o_orderkey AS pos, round(sum(o_totalprice) OVER (ORDER BY o_orderkey), 2) AS total FROM orders")
def running_sum(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_totalprice").cast("decimal(18,4)").alias("v"))
    return running_total(rows, "pos", "v").select("pos", F.round(F.col("total").cast("double"), 2).alias("total"))


@query("SELECT pos FROM (SELECT event_id AS pos, sum(user_id) OVER (ORDER BY event_id) AS s FROM events) WHERE s > 10000 ORDER BY pos LIMIT 1")
def find_prefix_sum(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("v"))
    return find_sum(rows, "pos", "v", 10000).select("pos")


@query("SELECT url, row_number() OVER (ORDER BY url, page_id) - 1 AS pos FROM pages")
def global_positions(spark, d):
    return with_positions(table(spark, d, "pages").select("url", "page_id"), "url", "page_id").select("url", "pos")


# ---- sequences ------------------------------------------------------------------------------------------------------

_SYMBOL = "(SELECT event_id AS pos, dense_rank() OVER (ORDER BY event_type) - 1 AS symbol FROM events)"


def _sequence(spark: SparkSession, d: str) -> DataFrame:
    """Events as symbols 0, 1, ... by name of their type; the alphabet is small and broadcast."""
    from pyspark.sql import Window

    e = table(spark, d, "events")
    kinds = e.select("event_type").distinct()
    kinds = kinds.withColumn("symbol", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("int"))
    return e.join(F.broadcast(kinds), "event_type").select(F.col("event_id").alias("pos"), "symbol")


def _rank_query(op: str, sign: str) -> None:
    def run(spark, d):
        seq = _sequence(spark, d)
        asked = seq.where("pos % 97 = 0").select("pos", F.explode(F.array(F.lit(1), F.lit(3))).alias("symbol"))
        return S.rank(seq, asked, op)

    run.__name__ = f"sequence_rank_{op}"
    query(f"""WITH s AS {_SYMBOL}, r AS (SELECT pos, count(*) FILTER (WHERE symbol {sign} 1) OVER w AS r1, count(*) FILTER (WHERE symbol {sign} 3) OVER w AS r3
      FROM s WINDOW w AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT pos, 1 AS symbol, r1 AS rank FROM r WHERE pos % 97 = 0 UNION ALL SELECT pos, 3, r3 FROM r WHERE pos % 97 = 0""")(run)


def _select_query(op: str, sign: str, backward: bool) -> None:
    def run(spark, d):
        seq = _sequence(spark, d)
        asked = seq.where("pos % 31 = 0").select(F.lit(2).alias("symbol"), F.col("pos").alias("r"))
        return S.select(seq, asked, op, backward)

    run.__name__ = f"sequence_select_{'bw' if backward else 'fw'}_{op}"
    query(f"""WITH s AS {_SYMBOL}, m AS (SELECT pos, row_number() OVER (ORDER BY pos {"DESC" if backward else ""}) - 1 AS r FROM s WHERE symbol {sign} 2)
      SELECT 2 AS symbol, q.pos AS r, coalesce(m.pos, (SELECT count(*) FROM s)) AS pos FROM s q LEFT JOIN m ON m.r = q.pos WHERE q.pos % 31 = 0""")(run)


for _op, _sign in {"eq": "=", "neq": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    _rank_query(_op, _sign)
    _select_query(_op, _sign, False)
_select_query("eq", "=", True)


@query(f"""WITH s AS {_SYMBOL}, n AS (SELECT *, CASE WHEN symbol = lag(symbol) OVER (ORDER BY pos) THEN 0 ELSE 1 END AS o FROM s),
g AS (SELECT *, sum(o) OVER (ORDER BY pos) AS g FROM n) SELECT min(pos) AS start, count(*) AS len, min(symbol) AS symbol FROM g GROUP BY g""")
def sequence_runs(spark, d):
    return S.runs(_sequence(spark, d))


@query(f"""WITH s AS {_SYMBOL}, n AS (SELECT *, CASE WHEN symbol = lag(symbol) OVER (ORDER BY pos) THEN 0 ELSE 1 END AS o FROM s),
g AS (SELECT *, sum(o) OVER (ORDER BY pos) AS g FROM n), r AS (SELECT *, min(pos) OVER (PARTITION BY g) AS a, max(pos) OVER (PARTITION BY g) AS b FROM g)
SELECT pos, symbol, b - pos + 1 AS forward, pos - a + 1 AS backward FROM r""")
def sequence_run_lengths(spark, d):
    seq = _sequence(spark, d)
    return S.run_lengths(seq, seq.select("pos"))


@query(f"WITH s AS {_SYMBOL} SELECT symbol, count(*) AS rank FROM s WHERE pos < 5000 GROUP BY 1")
def sequence_ranks(spark, d):
    return S.ranks(_sequence(spark, d), 5000)


@query(f"WITH s AS {_SYMBOL} SELECT count(*) FILTER (WHERE symbol >= 2) AS rank FROM s WHERE pos >= 100 AND pos < 900")
def sequence_rank_between(spark, d):
    return S.rank_between(_sequence(spark, d), 100, 900, 2, "ge")


@query(f"""WITH s AS {_SYMBOL}, e AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS r FROM s WHERE symbol = 2),
l AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS r FROM s WHERE symbol < 2), c AS (SELECT count(*) AS n FROM s)
SELECT 2 AS symbol, q.pos AS r, least(coalesce(e.pos, n), coalesce(l.pos, n)) AS pos
FROM s q CROSS JOIN c LEFT JOIN e ON e.r = q.pos LEFT JOIN l ON l.r = q.pos WHERE q.pos % 31 = 0""")
def sequence_select_eq_nlt(spark, d):
    seq = _sequence(spark, d)
    return S.select_eq_nlt(seq, seq.where("pos % 31 = 0").select(F.lit(2).alias("symbol"), F.col("pos").alias("r")))


# The same over every position and symbol; the queries above keep the positions that their SQL names.

_EVERY = f"WITH s AS {_SYMBOL}, k AS (SELECT DISTINCT symbol AS k FROM s)"


def _asked_everywhere(seq: DataFrame, name: str) -> DataFrame:
    """(symbol, pos named so) of each symbol at each position."""
    return seq.select(F.col("pos").alias(name)).crossJoin(F.broadcast(seq.select("symbol").distinct()))


def _whole_rank_query(op: str, sign: str) -> None:
    def run(spark, d):
        seq = _sequence(spark, d)
        return S.rank(seq, _asked_everywhere(seq, "pos"), op)

    run.__name__ = f"sequence_rank_whole_{op}"
    query(f"""{_EVERY} SELECT pos, k AS symbol, count(*) FILTER (WHERE symbol {sign} k)
      OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rank FROM s CROSS JOIN k""")(run)


def _whole_select_query(op: str, sign: str, backward: bool) -> None:
    def run(spark, d):
        seq = _sequence(spark, d)
        return S.select(seq, _asked_everywhere(seq, "r"), op, backward)

    run.__name__ = f"sequence_select_whole_{'bw' if backward else 'fw'}_{op}"
    query(f"""{_EVERY}, m AS (SELECT k, pos, row_number() OVER (PARTITION BY k ORDER BY pos {"DESC" if backward else ""}) - 1 AS r FROM s JOIN k ON symbol {sign} k)
      SELECT k.k AS symbol, q.pos AS r, coalesce(m.pos, (SELECT count(*) FROM s)) AS pos FROM s q CROSS JOIN k LEFT JOIN m ON m.k = k.k AND m.r = q.pos""")(run)


for _op, _sign in {"eq": "=", "neq": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    _whole_rank_query(_op, _sign)
    _whole_select_query(_op, _sign, False)
_whole_select_query("eq", "=", True)


@query(f"""{_EVERY}, e AS (SELECT k, pos, row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS r FROM s JOIN k ON symbol = k),
l AS (SELECT k, pos, row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS r FROM s JOIN k ON symbol < k), c AS (SELECT count(*) AS n FROM s)
SELECT k.k AS symbol, q.pos AS r, least(coalesce(e.pos, n), coalesce(l.pos, n)) AS pos
FROM s q CROSS JOIN k CROSS JOIN c LEFT JOIN e ON e.k = k.k AND e.r = q.pos LEFT JOIN l ON l.k = k.k AND l.r = q.pos""")
def sequence_select_whole_eq_nlt(spark, d):
    seq = _sequence(spark, d)
    return S.select_eq_nlt(seq, _asked_everywhere(seq, "r"))


# ---- versioned store ------------------------------------------------------------------------------------------------


@query("""SELECT 'now' AS version, o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT 'before', o_orderkey, o_totalprice FROM orders""")
def store_time_travel(spark, d):
    import uuid

    from ..sources.store import Store
    from ..sources.workers import scratch

    base = spark.conf.get("spark.checkpoint.dir", None) or scratch(spark)
    store = Store.create(spark, f"{base.rstrip('/')}/sparkloom-store-{uuid.uuid4().hex}")
    w = store.begin()
    w.put("orders", _orders(spark, d).df, "Map<BigInt,Double>")
    first = w.commit()
    w = store.begin()
    m = OrderedMap(w.find("orders", "Map<BigInt,Double>"))
    w.put("orders", m.remove(m.df.where("key % 5 = 0")).df, "Map<BigInt,Double>")
    w.commit()
    now, before = store.open().find("orders"), store.open(id_=first.id).find("orders")
    return now.select(F.lit("now").alias("version"), "key", "value").unionByName(before.select(F.lit("before").alias("version"), "key", "value"))


# ---- SQL pass-through: one text for both engines ----------------------------------------------------------------------

# fmt: off
_SQL = {
    "sql_projection_case": "SELECT l_orderkey, l_partkey, l_extendedprice * (1 - l_discount) AS net, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'",
    "sql_aggregate": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d, min(l_tax) AS t, max(l_extendedprice) AS p FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "sql_distinct_having": "SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "sql_filter_clause": "SELECT user_id, count(*) FILTER (WHERE value > 100) AS high, round(sum(value) FILTER (WHERE value <= 100), 2) AS low FROM events GROUP BY user_id",
    "sql_join_inner": "SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name",
    "sql_join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "sql_join_full": "SELECT coalesce(a.s_suppkey, b.p_partkey) AS k, a.s_name, b.p_name FROM supplier a FULL JOIN part b ON a.s_suppkey = b.p_partkey",
    "sql_join_semi_anti": "SELECT c_custkey, 'yes' AS buys FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT c_custkey, 'no' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "sql_join_range": "SELECT a.n_name, count(*) AS n FROM nation a JOIN supplier s ON s.s_suppkey BETWEEN a.n_nationkey AND a.n_nationkey + 3 GROUP BY a.n_name",
    "sql_window_rank": "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) WHERE rn <= 3",
    "sql_window_frame": "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q FROM orders",
    "sql_window_distribution": "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_partkey), 9) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_partkey), 9) AS cd FROM part",
    "sql_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10",
    "sql_union_intersect_except": "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)",
    "sql_cte_correlated": "WITH t AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) SELECT c_custkey, top, (SELECT count(*) FROM orders o WHERE o.o_custkey = c_custkey AND o.o_totalprice > top / 2) AS near_top FROM customer JOIN t ON o_custkey = c_custkey",
    "sql_recursive": "WITH RECURSIVE f(n, a, b) AS (SELECT 1, CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 40) SELECT n, a FROM f",
    "sql_rollup": "SELECT p_brand, p_size, count(*) AS n, round(sum(p_retailprice), 2) AS s FROM part GROUP BY ROLLUP (p_brand, p_size)",
    "sql_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "sql_scalar_functions": "SELECT p_partkey, upper(p_name) AS u, length(p_type) AS n, substr(p_brand, 1, 3) AS b, replace(p_name, 'a', '_') AS r, abs(p_size - 25) AS d, coalesce(nullif(p_size, 10), -1) AS z FROM part",
    "sql_date_functions": "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(o_orderdate AS DATE) AS d FROM orders",
    "sql_star_join": "SELECT n_name, year(o_orderdate) AS y, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,4)) * (1 - CAST(l_discount AS DECIMAL(6,4)))) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY n_name, year(o_orderdate)",
}
# fmt: on


def _sql_query(name: str, text: str) -> None:
    def run(spark, d):
        return sql.query(spark, text, d)

    run.__name__ = name
    query(text)(run)


for _name, _text in _SQL.items():
    _sql_query(_name, _text)


@query(_SQL["sql_cte_correlated"])
def sql_cte_correlated(spark, d):
    """In place of the text: Spark's plan of it compares every distinct top with every order, here each order meets the top of its own customer only."""
    orders = table(spark, d, "orders").select("o_custkey", "o_totalprice")
    t = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("top"))
    near = F.count_if(F.col("o_totalprice") > F.col("top") / 2).alias("near_top")
    counted = orders.join(t, F.col("o_custkey") == F.col("k")).groupBy("k").agg(F.max("top").alias("top"), near)
    return table(spark, d, "customer").join(counted, F.col("c_custkey") == F.col("k")).select("c_custkey", "top", "near_top")


@query("""SELECT e.event_id, o.o_orderkey FROM events e ASOF LEFT JOIN orders o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate""".replace(
    "o.o_orderkey FROM", "o.o_orderdate AS at FROM"))
def sql_as_of(spark, d):
    """The latest order date not after each event of the same user: one window over both tables."""
    from pyspark.sql import Window

    left = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), "event_id", F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(1).alias("s"))
    right = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.lit(None).cast("long").alias("event_id"), F.col("o_orderdate").alias("at"), F.lit(0).alias("s"))
    w = Window.partitionBy("k").orderBy("t", "s").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn("at", F.last("at", True).over(w)).where("s = 1").select("event_id", "at")


@query("""SELECT '{"n_nationkey":"' || n_nationkey || '","n_name":"' || n_name || '","none":"NULL"}' AS record FROM nation""")
def sql_records(spark, d):
    return sql.as_records(sql.query(spark, "SELECT n_nationkey, n_name, CAST(NULL AS INT) AS none FROM nation", d))


@query("SELECT doc_id, regexp_matches(text, '[A-Z]{4}') AS shouts, regexp_extract(text, '([a-z]+)\\.', 1) AS word, len(regexp_extract_all(text, '[0-9]+')) AS numbers FROM documents")
def string_regex(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.col("text").rlike("[A-Z]{4}").alias("shouts"), F.regexp_extract("text", r"([a-z]+)\.", 1).alias("word"), F.regexp_count("text", F.lit("[0-9]+")).alias("numbers"))


@query("SELECT sum(CAST(o_orderkey AS HUGEINT) * 1000000000000) AS total FROM orders")
def big_integers(spark, d):
    return table(spark, d, "orders").agg(F.sum(F.col("o_orderkey").cast("decimal(19,0)") * F.lit(10**12).cast("decimal(18,0)")).alias("total"))


# ---- streams --------------------------------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    return channels.pop(spark, d, table(spark, d, "events").schema, only="events.parquet")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_running_sum(spark, d):
    return channels.drained(channels.running_sum(_event_stream(spark, d), "value", "event_type"))


@query("""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def stream_windows(spark, d):
    stream = channels.windowed(_event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "10 minutes", "event_type", value="value")
    return channels.drained(stream).withColumn("start", F.col("start").cast("timestamp_ntz"))
