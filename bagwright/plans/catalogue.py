"""Registered queries over the keyed-table engine and their SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.domains import DATE, enum
from ..functions.expressions import all_, any_, ceil_, count, count_known, div, floor_, lift, max_, max_known, mean, min_, mod, round_, sum_, sum_known, to_real, trunc_
from ..operators.table import KeyedTable, cond, disjointness_check, evaluate, folds, row
from ..operators.validation import grouped_folds, stratified_folds, temporal_folds
from ..sources.stores import apply_deltas, bag_source, insert, load, outlives, refresh, store, update
from ..streaming import windows

FLAG, STATUS, LINE = enum("A", "N", "R"), enum("F", "O", "P"), enum("F", "O")
PRIORITY = enum("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
LANG = enum("de", "en", "es", "fr")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) that gives a KeyedTable or DataFrame, with its SQL."""

    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(lambda name: load(spark, sf_dir, name))
            return out.to_df() if isinstance(out, KeyedTable) else out

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def rounded(t: KeyedTable, *names: str) -> DataFrame:
    """Sums of doubles depend on the order of their terms; four places don't."""
    return t.to_df().withColumns({n: F.round(n, 4) for n in names})


def orders(get) -> KeyedTable:
    return store(get("orders"), ["o_orderkey"], domains={"o_orderstatus": STATUS, "o_orderpriority": PRIORITY}, const=("o_orderdate",))


def customers(get) -> KeyedTable:
    return store(get("customer"), ["c_custkey"])


def nations(get) -> KeyedTable:
    return store(get("nation"), ["n_nationkey"])


def lines(get, *index: str) -> KeyedTable:
    values = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"]
    return bag_source(get("lineitem"), list(index), [v for v in values if v not in index], {"l_returnflag": FLAG, "l_linestatus": LINE})


def by_nation(get) -> KeyedTable:
    return bag_source(get("customer"), ["c_nationkey"], unique=("c_custkey",))


def documents(get) -> KeyedTable:
    return store(get("documents"), ["doc_id"], ["lang", "source", "n_chars"], {"lang": LANG})


def labels(get) -> KeyedTable:
    return store(get("labels"), ["doc_id"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per order and return flag of lines with a discount."""
    get = lambda name: load(spark, sf_dir, name)
    t = lines(get, "l_orderkey").map(lambda k, r: cond(r.l_discount > 0.0, row(l_returnflag=r.l_returnflag, revenue=r.l_extendedprice * (1.0 - r.l_discount)), ()))
    return rounded(t.extend_key("l_returnflag").group_map(lambda k, g: row(revenue=sum_(g.revenue), n=count(g.revenue))), "revenue")


QUERIES["flagship_revenue"] = flagship
ORACLE["flagship_revenue"] = "SELECT l_orderkey, l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(*) AS n FROM lineitem WHERE l_discount > 0 GROUP BY 1, 2"

_ORDERS = "o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@query(f"SELECT {_ORDERS} FROM orders")
def store_scan(get):
    return orders(get)


@query("SELECT c_custkey, round(c_acctbal / 2.0, 4) AS half FROM customer")
def map_derive(get):
    return rounded(customers(get).map(lambda k, r: row(half=r.c_acctbal / 2.0)), "half")


@query("SELECT o_orderkey, o_orderkey + 1 AS next_key FROM orders")
def map_key_read(get):
    return orders(get).map(lambda k, r: row(next_key=k.o_orderkey + 1))


@query(f"SELECT {_ORDERS} FROM orders")
def map_identity(get):
    return orders(get).map(lambda k, r: r)


@query(f"SELECT {_ORDERS} FROM orders WHERE o_totalprice > 100000.0")
def map_filter(get):
    return orders(get).map(lambda k, r: cond(r.o_totalprice > 100000.0, r, ()))


@query(f"SELECT {_ORDERS} FROM orders WHERE o_orderstatus = 'F'")
def map_filter_enum(get):
    return orders(get).filter(lambda k, r: r.o_orderstatus == "F")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'O') AND NOT (o_totalprice < 50000.0)")
def map_bool_ops(get):
    return orders(get).filter(lambda k, r: ((r.o_orderstatus == "F") | (r.o_orderstatus == "O")) & ~(r.o_totalprice < 50000.0)).select("o_totalprice")


@query("SELECT o_orderkey, CAST(CASE WHEN o_totalprice >= 150000.0 THEN 1 ELSE 0 END AS BIGINT) AS big FROM orders")
def map_case_field(get):
    return orders(get).map(lambda k, r: row(big=cond(r.o_totalprice >= 150000.0, 1, 0)))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE c_mktsegment END AS kind, CASE WHEN c_acctbal < 0 THEN -c_acctbal ELSE c_acctbal END AS amount FROM customer")
def map_branch_rows(get):
    return customers(get).map(lambda k, r: cond(r.c_acctbal < 0.0, row(kind=lift("debt"), amount=-r.c_acctbal), row(kind=r.c_mktsegment, amount=r.c_acctbal)))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name AS label, CAST(n_regionkey AS BIGINT) AS number FROM nation UNION ALL SELECT n_nationkey, 'copy', -n_regionkey FROM nation")
def map_expand(get):
    return nations(get).map(lambda k, r: (row(label=r.n_name, number=r.n_regionkey), row(label=lift("copy"), number=-r.n_regionkey)))


@query("SELECT c_custkey, 'low' AS kind, c_acctbal AS amount FROM customer WHERE c_acctbal < 1000 UNION ALL SELECT c_custkey, 'all', c_acctbal + 1 FROM customer WHERE c_acctbal < 1000")
def map_guarded_expand(get):
    return customers(get).map(lambda k, r: cond(r.c_acctbal < 1000.0, (row(kind=lift("low"), amount=r.c_acctbal), row(kind=lift("all"), amount=r.c_acctbal + 1.0)), ()))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_nationkey AS BIGINT) * n_nationkey AS square FROM nation")
def map_int_pow(get):
    return nations(get).map(lambda k, r: row(square=k.n_nationkey**2))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1995-01-01'")
def map_date_cmp(get):
    return store(get("orders"), ["o_orderkey"], ["o_orderdate"], {"o_orderdate": DATE}).filter(lambda k, r: r.o_orderdate < dt.date(1995, 1, 1))


@query("SELECT l_orderkey, l_returnflag, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY 1, 2")
def extend_group_sum(get):
    return rounded(lines(get, "l_orderkey").extend_key("l_returnflag").group_map(lambda k, g: row(quantity=sum_(g.l_quantity))), "quantity")


@query("SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, min(c_acctbal) AS low, max(c_acctbal) AS high, round(sum(c_acctbal), 4) AS total, count(*) AS n FROM customer GROUP BY 1")
def group_all_aggs(get):
    return rounded(by_nation(get).group_map(lambda k, g: row(low=min_(g.c_acctbal), high=max_(g.c_acctbal), total=sum_(g.c_acctbal), n=count(g.c_name))), "total")


@query("SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, bool_or(c_acctbal < 0) AS some_debt, bool_and(c_acctbal < 9000) AS none_rich FROM customer GROUP BY 1")
def group_any_all(get):
    t = by_nation(get).map(lambda k, r: row(debt=r.c_acctbal < 0.0, modest=r.c_acctbal < 9000.0))
    return t.group_map(lambda k, g: row(some_debt=any_(g.debt), none_rich=all_(g.modest)))


@query("SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, round(sum(c_acctbal) / count(*), 4) AS mean FROM customer GROUP BY 1")
def group_mean_real(get):
    return rounded(by_nation(get).group_map(lambda k, g: row(mean=sum_(g.c_acctbal) / to_real(count(g.c_acctbal)))), "mean")


@query("SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, round(sum(c_custkey) / CAST(count(*) AS DOUBLE), 4) AS mean FROM customer GROUP BY 1")
def group_mean_int(get):
    return rounded(by_nation(get).group_map(lambda k, g: row(mean=mean(g.c_custkey))), "mean")


@query("SELECT DISTINCT l_orderkey, CAST(1 AS BIGINT) AS n FROM lineitem")
def group_const(get):
    return lines(get, "l_orderkey").group_map(lambda k, g: row(n=1))


@query("SELECT l_orderkey, l_orderkey + count(*) AS sum_key FROM lineitem GROUP BY 1")
def group_key_field(get):
    return lines(get, "l_orderkey").group_map(lambda k, g: row(sum_key=k.l_orderkey + count(g.l_quantity)))


@query("SELECT l_orderkey, bool_or(l_returnflag = 'A') AS returned FROM lineitem GROUP BY 1")
def group_membership(get):
    return lines(get, "l_orderkey").group_map(lambda k, g: row(returned=lift("A").is_in(g.l_returnflag)))


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity < 0 HAVING count(*) > 0")
def group_empty_strict(get):
    return lines(get).filter(lambda k, r: r.l_quantity < 0.0).group_map(lambda k, g: row(n=count(g.l_quantity)))


@query("SELECT o_orderkey, o_totalprice AS total, CAST(1 AS BIGINT) AS n FROM orders")
def group_singletons(get):
    return orders(get).group_map(lambda k, g: row(total=sum_(g.o_totalprice), n=count(g.o_totalprice)))


@query("SELECT l_orderkey, l_quantity AS q FROM lineitem")
def window_project(get):
    return lines(get, "l_orderkey").group_map(lambda k, g: row(q=g.l_quantity))


@query("SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS line FROM lineitem")
def window_to_real(get):
    return lines(get, "l_orderkey").group_map(lambda k, g: row(line=to_real(g.l_linenumber)))


@query(f"SELECT {_ORDERS}, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def left_join_functional(get):
    return orders(get).left_join(customers(get), lambda k, r: r.o_custkey)


@query("SELECT d.doc_id, lang, l.quality IS NULL AS unlabelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join_missing(get):
    return documents(get).left_join(labels(get), lambda k, r: k.doc_id).map(lambda k, r: row(lang=r.lang, unlabelled=r.quality.is_missing()))


@query("SELECT d.doc_id, lang, coalesce(CAST(l.quality AS BIGINT), -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def default_missing(get):
    return documents(get).left_join(labels(get), lambda k, r: k.doc_id).map(lambda k, r: row(lang=r.lang, quality=r.quality.default(-1)))


@query("SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN CAST(l.quality AS BIGINT) + 1 ELSE 0 END AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def narrow_known(get):
    t = documents(get).left_join(labels(get), lambda k, r: k.doc_id)
    return t.map(lambda k, r: cond(r.quality.is_known(), lambda own: row(score=own.quality + 1), row(score=0)))


@query("SELECT d.doc_id, lang, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def inner_join_drop(get):
    return documents(get).select("lang").inner_join(labels(get), lambda k, r: k.doc_id)


@query("SELECT o_orderkey, o_totalprice, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def join_chain(get):
    t = orders(get).inner_join(customers(get), lambda k, r: r.o_custkey).inner_join(nations(get), lambda k, r: r.c_nationkey)
    return t.select("o_totalprice", "c_mktsegment", "n_name")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, c_custkey, c_acctbal FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey")
def join_bag_right(get):
    right = bag_source(get("customer"), ["c_nationkey"], ["c_custkey", "c_acctbal"])
    return nations(get).select("n_name").left_join(right, lambda k, r: k.n_nationkey)


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join(get):
    return documents(get).select("lang").anti_join(labels(get), lambda k, r: k.doc_id)


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def semi_via_inner(get):
    return documents(get).select("lang").inner_join(labels(get), lambda k, r: k.doc_id).select("lang")


def _halves(get):
    t = lines(get, "l_orderkey").select("l_returnflag", "l_quantity")
    return t, t.split(lambda k: k.l_orderkey < 30000)


def _sides(get):
    """Even and odd order keys: both hold rows at any scale."""
    odd, even = folds(_halves(get)[0], 2, lambda k: k.l_orderkey)[0]
    return even, odd


@query("SELECT l_orderkey, l_returnflag, l_quantity FROM lineitem WHERE l_orderkey % 2 = 0")
def split_even(get):
    return _sides(get)[0]


@query("SELECT l_orderkey, l_returnflag, l_quantity FROM lineitem WHERE l_orderkey % 2 <> 0")
def split_odd(get):
    return _sides(get)[1]


@query("SELECT l_orderkey, l_returnflag, l_quantity, CASE WHEN l_orderkey % 2 = 0 THEN CASE WHEN l_orderkey % 3 = 0 THEN 'a' ELSE 'b' END ELSE CASE WHEN l_orderkey % 3 = 0 THEN 'c' ELSE 'd' END END AS bucket FROM lineitem")
def nested_split_remainder(get):
    parts = [side for t in _sides(get) for side in reversed(folds(t, 3, lambda k: k.l_orderkey)[0])]
    named = [t.mutate(bucket=lambda k, r, n=n: lift(n)) for t, n in zip(parts, "abcd")]
    return named[0].bind(named[1]).bind(named[2].bind(named[3]))


@query("SELECT l_orderkey, l_returnflag, l_quantity FROM lineitem WHERE l_orderkey < 30000")
def split_first(get):
    return _halves(get)[1][0]


@query("SELECT l_orderkey, l_returnflag, l_quantity FROM lineitem WHERE NOT l_orderkey < 30000")
def split_second(get):
    return _halves(get)[1][1]


@query("SELECT l_orderkey, l_returnflag, l_quantity FROM lineitem")
def split_bind_identity(get):
    # Selected apart: bind() gives back the parent of sides that are as split() left them.
    a, b = (t.select("l_returnflag", "l_quantity") for t in _sides(get))
    return a.bind(b)


@query("SELECT l_orderkey, l_returnflag, round(sum(l_quantity), 4) AS q FROM lineitem GROUP BY 1, 2")
def split_safe_pipeline(get):
    f = lambda t: t.extend_key("l_returnflag").group_map(lambda k, g: row(q=sum_(g.l_quantity)))
    a, b = _sides(get)
    return rounded(f(a).bind(f(b)), "q")


@query("SELECT l_orderkey, l_returnflag, l_quantity, CASE WHEN l_orderkey < 30000 THEN CASE WHEN l_orderkey < 10000 THEN 'a' ELSE 'b' END ELSE CASE WHEN l_orderkey < 50000 THEN 'c' ELSE 'd' END END AS bucket FROM lineitem")
def nested_split(get):
    a, b = _halves(get)[1]
    parts = [*a.split(lambda k: k.l_orderkey < 10000), *b.split(lambda k: k.l_orderkey < 50000)]
    named = [t.mutate(bucket=lambda k, r, n=n: lift(n)) for t, n in zip(parts, "abcd")]
    return named[0].bind(named[1]).bind(named[2].bind(named[3]))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10")
def bind_overlap(get):
    t = nations(get).select("n_name")
    return t.bind(t.filter(lambda k, r: k.n_nationkey < 10))


@query("SELECT c_custkey AS key, c_acctbal AS balance, 'customer' AS tag FROM customer UNION ALL SELECT CAST(s_suppkey AS BIGINT), s_acctbal, 'supplier' FROM supplier")
def tagged_bind(get):
    return _tagged(get)


def _tagged(get):
    a = store(get("customer").selectExpr("c_custkey AS key", "c_acctbal AS balance"), ["key"])
    b = store(get("supplier").selectExpr("s_suppkey AS key", "s_acctbal AS balance"), ["key"])
    return a.tagged_bind(b, "customer", "supplier")


@query("SELECT CAST(s_suppkey AS BIGINT) AS key, s_acctbal AS balance FROM supplier")
def tagged_split(get):
    return _tagged(get).tagged_split("supplier")


@query("UNPIVOT (SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_retailprice, CAST(p_size AS DOUBLE) AS p_size FROM part) ON p_retailprice, p_size INTO NAME name VALUE value")
def unpivot_wide(get):
    return store(get("part"), ["p_partkey"]).map(lambda k, r: row(p_retailprice=r.p_retailprice, p_size=to_real(r.p_size))).unpivot("p_retailprice", "p_size")


_PIVOT = ", ".join(f"max(n) FILTER (o_orderpriority = '{v}') AS \"{v}\"" for v in PRIORITY.variants)


def _counts(get) -> KeyedTable:
    t = bag_source(get("orders"), ["o_custkey"], ["o_orderkey", "o_orderpriority"], {"o_orderpriority": PRIORITY}, complete=True)
    return t.extend_key("o_orderpriority").group_map(lambda k, g: row(n=count(g.o_orderkey)))


_COUNTED = "SELECT CAST(o_custkey AS BIGINT) AS o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2"


@query(f"SELECT o_custkey, {_PIVOT} FROM ({_COUNTED}) GROUP BY 1")
def pivot_attr(get):
    return _counts(get).shrink_key("o_orderpriority").pivot("o_orderpriority", "n")


@query(f"SELECT o_custkey, {_PIVOT} FROM ({_COUNTED}) GROUP BY 1")
def pivot_index(get):
    return _counts(get).pivot_index("o_orderpriority", "n")


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_retailprice, CAST(p_size AS DOUBLE) AS p_size FROM part")
def pivot_unpivot_roundtrip(get):
    t = store(get("part"), ["p_partkey"], complete=True).map(lambda k, r: row(p_retailprice=r.p_retailprice, p_size=to_real(r.p_size)))
    return t.unpivot("p_retailprice", "p_size").pivot_index("name", "value")


@query("SELECT l_returnflag, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY 1")
def shrink_group(get):
    t = lines(get, "l_orderkey", "l_linenumber").extend_key("l_returnflag").assume(complete=True).shrink_key("l_orderkey", "l_linenumber")
    return rounded(t.group_map(lambda k, g: row(quantity=sum_(g.l_quantity))), "quantity")


@query("SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem")
def distinct_bag(get):
    return lines(get, "l_orderkey").select("l_returnflag").distinct()


@query("SELECT c_custkey, c_name FROM customer")
def sugar_select(get):
    return customers(get).select("c_name")


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment, c_acctbal * 2 AS twice FROM customer")
def sugar_mutate(get):
    return customers(get).mutate(twice=lambda k, r: r.c_acctbal * 2.0)


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def completeness_gate(get):
    t = orders(get).select("o_orderpriority").extend_key("o_orderpriority")
    t = t.completeness_check(lambda t: t.df.filter("o_orderkey IS NULL").isEmpty())
    return t.shrink_key("o_orderkey").group_map(lambda k, g: row(n=count(g.o_orderkey)))


def _events(get) -> KeyedTable:
    return bag_source(get("events"), ["user_id"], ["event_id", "ts", "event_type", "value"], unique=("event_id",))


@query("SELECT CAST(user_id AS BIGINT) AS user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS total FROM events")
def cumsum_window(get):
    return rounded(_events(get).ordered("event_id", total=("cumsum", "value")).select("event_id", "total"), "total")


@query("SELECT CAST(user_id AS BIGINT) AS user_id, event_id, rank() OVER (PARTITION BY user_id ORDER BY value) AS place FROM events")
def rank_window(get):
    return _events(get).ordered("value", place=("rank", None)).select("event_id", "place")


@query("SELECT CAST(user_id AS BIGINT) AS user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events")
def lag_window(get):
    return _events(get).ordered("event_id", before=("lag", "event_type")).select("event_id", "before")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_events(get):
    return windows.windowed(get("events"), "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n")])


@query("SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1, 2")
def sliding_events(get):
    return windows.windowed(get("events"), "ts", "2 hours", ["event_type"], [F.count(F.lit(1)).alias("n")], slide="1 hour")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def latest_event(get):
    return windows.latest(get("events").select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id")


@query("SELECT CAST(doc_id % 3 AS BIGINT) AS fold, count(*) FILTER (l.quality = 1) AS good, count(*) AS n FROM labels l GROUP BY 1")
def kfold_disjoint(get):
    t = labels(get)
    parts = [evaluate(train, test, lambda d: None, lambda _, d, i=i: d.agg(F.lit(i).cast("bigint").alias("fold"), F.count_if(F.col("quality") == 1).alias("good"), F.count(F.lit(1)).alias("n"))) for i, (train, test) in enumerate(folds(t, 3, lambda k: k.doc_id))]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT l_orderkey, l_returnflag, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY 1, 2")
def sugar_aggregate(get):
    return lines(get, "l_orderkey").aggregate("l_returnflag", quantity=lambda k, g: sum_(g.l_quantity), n=lambda k, g: count(g.l_quantity))


@query("SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS low, CAST(ceil(c_acctbal) AS BIGINT) AS high, CAST(trunc(c_acctbal) AS BIGINT) AS whole, round(c_acctbal / 8, 1) AS near FROM customer")
def map_rounding(get):
    return customers(get).map(lambda k, r: row(low=floor_(r.c_acctbal), high=ceil_(r.c_acctbal), whole=trunc_(r.c_acctbal), near=round_(r.c_acctbal / 8.0, 1)))


@query("SELECT c_custkey, CAST(floor((c_nationkey - 12) / 5.0) AS BIGINT) AS part, CAST((c_nationkey - 12) - 5 * floor((c_nationkey - 12) / 5.0) AS BIGINT) AS rest FROM customer")
def map_div_mod(get):
    return customers(get).map(lambda k, r: row(part=div(r.c_nationkey - 12, 5), rest=mod(r.c_nationkey - 12, 5)))


@query("SELECT l_orderkey, bool_or(l_quantity > 45) AS some, bool_and(l_discount < 0.09) AS every FROM lineitem GROUP BY 1")
def group_quantifiers(get):
    return lines(get, "l_orderkey").group_map(lambda k, g: row(some=any_(g.l_quantity, lambda x: x > 45.0), every=all_(g.l_discount, lambda x: x < 0.09)))


@query("SELECT source, sum(l.quality) AS good, max(l.toxic) AS worst, count(l.quality) AS known, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def group_known_aggregates(get):
    t = documents(get).left_join(labels(get), lambda k, r: k.doc_id).select("source", "quality", "toxic").extend_key("source")
    t = t.assume(complete=True).shrink_key("doc_id")
    return t.group_map(lambda k, g: row(good=sum_known(g.quality), worst=max_known(g.toxic), known=count_known(g.quality), n=count(g.doc_id)))


@query("SELECT CAST(user_id AS BIGINT) AS user_id, event_id, lead(event_id) OVER w AS after, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lead_window(get):
    return _events(get).ordered("ts", ("event_id",), after=("lead", "event_id"), n=("size", None)).select("event_id", "after", "n")


@query("SELECT CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus FROM orders UNION SELECT CAST(o_custkey AS BIGINT), o_orderstatus FROM orders WHERE o_totalprice > 1000")
def union_distinct(get):
    t = bag_source(get("orders"), ["o_custkey"], ["o_orderkey", "o_orderstatus", "o_totalprice"], {"o_orderstatus": STATUS}, unique=("o_orderkey",))
    rich = t.filter(lambda k, r: r.o_totalprice > 1000.0).select("o_orderstatus")
    a, b = t.select("o_orderstatus").assume(disjoint_from=rich)  # bags add up; distinct comes after
    return a.bind(b).distinct()


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0 OR c_acctbal > 5000")
def disjointness_gate(get):
    t = customers(get).select("c_acctbal")
    a, b = disjointness_check(t.filter(lambda k, r: r.c_acctbal < 0.0), t.filter(lambda k, r: r.c_acctbal > 5000.0))
    return a.bind(b)


_WEIGHTS = "SELECT CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus, 1 + (CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 0 END) + (CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 0 END) AS w FROM orders"


@query(f"SELECT o_custkey, o_orderstatus FROM (SELECT o_custkey, o_orderstatus, unnest(range(CAST(sum(w) AS BIGINT))) FROM ({_WEIGHTS}) GROUP BY 1, 2)")
def delta_apply(get):
    t = bag_source(get("orders"), ["o_custkey"], ["o_orderstatus"], {"o_orderstatus": STATUS})
    change = lambda k, weight: get("orders").filter(F.col("o_orderkey") % k == 0).select(F.col("o_custkey").cast("bigint").alias("o_custkey"), "o_orderstatus", F.lit(weight).alias("weight"))
    return apply_deltas(t, change(3, -1).union(change(5, 2)))


@query("SELECT CAST(o_custkey AS BIGINT) AS o_custkey, round(sum(o_totalprice), 4) AS total, count(*) AS n FROM orders GROUP BY 1")
def materialised_view(get):
    t = bag_source(get("orders"), ["o_custkey"], ["o_totalprice"]).aggregate(total=lambda k, g: sum_(g.o_totalprice), n=lambda k, g: count(g.o_totalprice))
    return rounded(refresh(t, f"bagwright_view_{uuid.uuid4().hex}"), "total")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -c_custkey - 1, 1.5 FROM customer WHERE c_nationkey = 3")
def ingest_update(get):
    more = get("customer").filter("c_nationkey = 3").select((-F.col("c_custkey") - 1).alias("c_custkey"), F.lit(1.5).alias("c_acctbal"))
    return update(insert(customers(get).select("c_acctbal"), more), lambda k, r: r.c_acctbal < 0.0, c_acctbal=lambda k, r: 0.0)


def measured(pairs, of: str) -> DataFrame:
    """Per fold: rows of train, rows of test and the sum of ``of`` in test."""

    def side(i: int, **made):
        n = {"n_train": F.lit(0), "n_test": F.lit(0), "test_sum": F.lit(0), **made}
        return lambda d: d.agg(F.lit(i).cast("bigint").alias("fold"), *(c.cast("bigint").alias(x) for x, c in n.items()))

    out = None
    for i, (train, test) in enumerate(pairs):
        tested = side(i, n_test=F.count(F.lit(1)), test_sum=F.coalesce(F.sum(of), F.lit(0)))
        part = evaluate(train, test, side(i, n_train=F.count(F.lit(1))), lambda model, d, tested=tested: model.union(tested(d)))
        out = part if out is None else out.union(part)
    return out.groupBy("fold").agg(*(F.sum(x).alias(x) for x in ("n_train", "n_test", "test_sum")))


def _folds_sql(fold: str, table: str, of: str) -> str:
    return f"SELECT CAST(f AS BIGINT) AS fold, count(*) FILTER (fold = f) AS n_test, CAST(sum({of}) FILTER (fold = f) AS BIGINT) AS test_sum, count(*) FILTER (fold <> f) AS n_train FROM (SELECT {of}, {fold} AS fold FROM {table}), range(3) t(f) GROUP BY 1"


@query(_folds_sql("o_custkey % 3", "orders", "o_orderkey"))
def grouped_folds_disjoint(get):
    t = bag_source(get("orders"), ["o_custkey"], ["o_orderkey"])
    return measured(grouped_folds(t, 3, "o_custkey", number=lambda k: k.o_custkey), "o_orderkey")


@query(_folds_sql("(row_number() OVER (PARTITION BY lang ORDER BY doc_id % 64, doc_id) - 1) % 3", "documents", "n_chars"))
def stratified_folds_disjoint(get):
    t = documents(get).select("n_chars", "lang")
    return measured(stratified_folds(t, 3, "lang", number=lambda k: k.doc_id, parts=64), "n_chars")


_CUTS = [dt.date(1994, 1, 1), dt.date(1996, 1, 1), dt.date(1997, 1, 1)]


@query(
    "SELECT fold, count(*) FILTER (d >= a AND d < b) AS n_test, CAST(sum(o_orderkey) FILTER (d >= a AND d < b) AS BIGINT) AS test_sum, count(*) FILTER (d < a) AS n_train "
    "FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), (VALUES (0::BIGINT, DATE '1994-01-01', DATE '1996-01-01'), (1, DATE '1996-01-01', DATE '1997-01-01'), (2, DATE '1997-01-01', DATE '9999-01-01')) t(fold, a, b) GROUP BY 1"
)
def temporal_folds_disjoint(get):
    t = store(get("orders"), ["o_orderkey"], ["o_orderdate"], {"o_orderdate": DATE})
    return measured(temporal_folds(t, "o_orderdate", *_CUTS), "o_orderkey")


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def row_cardinality(get):
    t = bag_source(get("orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], ["o_orderkey"])
    return t.cardinality(customers(get))


@query("SELECT CAST(o_custkey AS BIGINT) AS o_custkey, count(*) AS n FROM orders GROUP BY 1")
def complete_over_shrink(get):
    t = store(get("orders"), ["o_custkey", "o_orderkey"], ["o_orderstatus"], {"o_orderstatus": STATUS}, complete_over=("o_orderkey",))
    return t.shrink_key("o_orderkey").group_map(lambda k, g: row(n=count(g.o_orderkey)))


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O')")
def disjoint_partition_bind(get):
    done, open_ = (store(get("orders").filter(F.col("o_orderstatus") == s), ["o_orderkey"], ["o_totalprice"], block=("status", s)) for s in ("F", "O"))
    return done.bind(open_).group_map(lambda k, g: row(o_totalprice=sum_(g.o_totalprice)))


_TERMS = "SELECT o_custkey AS of, min(o_orderdate) AS since, max(o_orderdate) AS until FROM orders GROUP BY 1"


def _terms(get) -> DataFrame:
    return get("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("since"), F.max("o_orderdate").alias("until"))


@query(f"SELECT o_orderkey, o_custkey, since FROM orders LEFT JOIN ({_TERMS}) ON o_custkey = of AND since <= o_orderdate AND o_orderdate < until")
def interval_join(get):
    t = get("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return windows.join_valid(t, _terms(get), ["o_custkey"], "o_orderdate", "since", "until", "left").select("o_orderkey", "o_custkey", "since")


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderdate FROM orders")
def outlives_gate(get):
    terms = store(_terms(get).withColumn("until", F.lit(None).cast("timestamp")), ["o_custkey"], optional=("until",))
    return outlives(store(get("orders"), ["o_orderkey"], ["o_custkey", "o_orderdate"]), "o_custkey", "o_orderdate", terms, "since", "until")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
