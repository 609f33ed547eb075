"""The engine's registered queries: one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.database import Database
from quadrel.functions.aggregates import asc, avg, count, desc, max_, min_, sum_
from quadrel.functions.predicates import (
    and_, between, eq, exists, gt, gte, ilike, in_array, is_not_null, is_null, like, lt, lte, ne, not_, not_between, not_exists, not_in_array, or_, regex,
)
from quadrel.operators import conflicts, federation, identity, mutations, quads, validation
from quadrel.schema import Ref, Table, alias, column, double, integer, key, many, one, string, table, timestamp
from quadrel.sources import layout

NS = "http://data.example/vocab#"
HOME = "http://data.example/"


def _table(name: str, columns: dict, pk: str, **more: object) -> Table:
    kinds = {"i": integer, "d": double, "s": string, "t": timestamp}
    made = {n: kinds[k]() for n, k in columns.items() if n != pk}
    return table(name, {pk: key("bigint"), **made}, NS + name.capitalize(), namespace=NS, base=HOME + name, **{"template": "#{id}", **more})


REGION = _table("region", {"r_regionkey": "i", "r_name": "s"}, "r_regionkey")
NATION = _table("nation", {"n_nationkey": "i", "n_name": "s", "n_regionkey": "i"}, "n_nationkey")
CUSTOMER = _table("customer", {"c_custkey": "i", "c_name": "s", "c_nationkey": "i", "c_acctbal": "d", "c_mktsegment": "s"}, "c_custkey")
SUPPLIER = _table("supplier", {"s_suppkey": "i", "s_name": "s", "s_nationkey": "i", "s_acctbal": "d"}, "s_suppkey")
PART = _table("part", {"p_partkey": "i", "p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "i", "p_retailprice": "d"}, "p_partkey")
ORDERS = _table("orders", {"o_orderkey": "i", "o_custkey": "i", "o_orderstatus": "s", "o_totalprice": "d", "o_orderdate": "t", "o_orderpriority": "s"}, "o_orderkey")
LINEITEM = _table("lineitem", {"l_id": "s", "l_orderkey": "i", "l_partkey": "i", "l_suppkey": "i", "l_linenumber": "i", "l_quantity": "d", "l_extendedprice": "d", "l_discount": "d", "l_tax": "d", "l_returnflag": "s", "l_linestatus": "s", "l_shipdate": "t"}, "l_id")
EVENTS = _table("events", {"event_id": "i", "ts": "t", "user_id": "i", "event_type": "s", "value": "d", "props": "s"}, "event_id")
TABLES = (REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDERS, LINEITEM, EVENTS)
#: Orders over this price; some customers have none.
DEAR = 400000


def open_db(spark: SparkSession, sf_dir: str) -> Database:
    db = Database(spark)

    def opened(t: Table) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{t.name}.parquet")
        return df.withColumn("l_id", F.concat_ws("-", "l_orderkey", "l_linenumber")) if t is LINEITEM else df

    for t in TABLES:
        db.bind_later(t, partial(opened, t))
    return db.relate(REGION, nations=many(NATION, ("r_regionkey",), ("n_regionkey",))).relate(
        NATION, region=one(REGION, ("n_regionkey",), ("r_regionkey",)), customers=many(CUSTOMER, ("n_nationkey",), ("c_nationkey",))
    ).relate(CUSTOMER, orders=many(ORDERS, ("c_custkey",), ("o_custkey",))).relate(ORDERS, customer=one(CUSTOMER, ("o_custkey",), ("c_custkey",)))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers f(db) under its name."""

    def keep(f: Callable[[Database], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(open_db(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- scans and projections


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_all(db):
    return db.select().from_(NATION).df()


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def project_rename(db):
    return db.select(id=CUSTOMER.c.c_custkey, name="c_name").from_(CUSTOMER).df()


@query("SELECT n_name, r_name AS region_name, r_regionkey AS region_key FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def join_nested_projection(db):
    regions = alias(REGION, "Regions")
    db.bind(REGION, db.frames["region"].filter("r_name <> 'ASIA'"))
    q = db.select(n_name=NATION.c.n_name, region={"name": regions.c.r_name, "key": regions.c.r_regionkey}).from_(NATION).left_join(regions, {NATION.c.n_regionkey: regions.c.r_regionkey})
    return q.df().select("n_name", F.col("region.name").alias("region_name"), F.col("region.key").alias("region_key"))


@query("SELECT n_name, CASE WHEN r_regionkey IS NULL THEN NULL ELSE r_regionkey || ':' || r_name END AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def project_whole_table(db):
    db.bind(REGION, db.frames["region"].filter("r_name <> 'ASIA'"))
    df = db.select(n_name=NATION.c.n_name, region=REGION).from_(NATION).left_join(REGION, eq(NATION.c.n_regionkey, REGION.c.r_regionkey)).df()
    return df.select("n_name", F.when(F.col("region").isNotNull(), F.concat_ws(":", "region.r_regionkey", "region.r_name")).alias("region"))


@query("SELECT n_nationkey, n_name, n_regionkey, r_regionkey AS region__r_regionkey, r_name AS region__r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_flat_columns(db):
    return db.select().from_(NATION).inner_join(REGION, eq(NATION.c.n_regionkey, REGION.c.r_regionkey)).df()


@query("SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders")
def project_expression(db):
    return db.select(o_orderkey=ORDERS.c.o_orderkey, doubled=F.col("orders__o_totalprice") * 2).from_(ORDERS).df()


# ---- predicates


def _filter(name: str, t: Table, fields: list[str], condition: Callable, sql: str) -> None:
    def f(db):
        return db.select({n: t.c[n] for n in fields}).from_(t).where(condition(t.c)).df()

    f.__name__ = name
    query(f"SELECT {', '.join(fields)} FROM {t.name} WHERE {sql}")(f)


_filter("filter_eq", ORDERS, ["o_orderkey", "o_orderstatus"], lambda c: eq(c.o_orderstatus, "F"), "o_orderstatus = 'F'")
_filter("filter_ne", ORDERS, ["o_orderkey", "o_orderstatus"], lambda c: ne(c.o_orderstatus, "F"), "o_orderstatus <> 'F'")
_filter("filter_gt_gte_lt_lte", LINEITEM, ["l_orderkey", "l_linenumber", "l_quantity"], lambda c: and_(gt(c.l_quantity, 10), gte(c.l_discount, 0.05), lt(c.l_quantity, 40), lte(c.l_tax, 0.04)), "l_quantity > 10 AND l_discount >= 0.05 AND l_quantity < 40 AND l_tax <= 0.04")
_filter("filter_like_ci", PART, ["p_partkey", "p_name"], lambda c: like(c.p_name, "RED%_GET"), "p_name ILIKE 'RED%_GET'")
_filter("filter_ilike", CUSTOMER, ["c_custkey", "c_name"], lambda c: ilike(c.c_name, "%CUST%7"), "c_name ILIKE '%CUST%7'")
_filter("filter_between", LINEITEM, ["l_orderkey", "l_linenumber", "l_quantity"], lambda c: between(c.l_quantity, 10, 12), "l_quantity BETWEEN 10 AND 12")
_filter("filter_not_between", LINEITEM, ["l_orderkey", "l_linenumber", "l_quantity"], lambda c: not_between(c.l_quantity, 3, 48), "l_quantity NOT BETWEEN 3 AND 48")
_filter("filter_regex", PART, ["p_partkey", "p_type"], lambda c: regex(c.p_type, "[A-F]"), "regexp_matches(p_type, '[A-F]')")
_filter("filter_regex_flags", PART, ["p_partkey", "p_name"], lambda c: regex(c.p_name, "^RED.*T$", "i"), "regexp_matches(p_name, '(?i)^RED.*T$')")
_filter("filter_in", NATION, ["n_nationkey"], lambda c: in_array(c.n_regionkey, [1, 3]), "n_regionkey IN (1, 3)")
_filter("filter_not_in", NATION, ["n_nationkey"], lambda c: not_in_array(c.n_regionkey, [1, 3]), "n_regionkey NOT IN (1, 3)")
_filter("filter_in_empty", NATION, ["n_nationkey"], lambda c: in_array(c.n_regionkey, []), "false")
_filter("filter_not_in_empty", NATION, ["n_nationkey"], lambda c: not_in_array(c.n_regionkey, []), "true")
_filter("filter_and_or_not", EVENTS, ["event_id"], lambda c: or_(and_(gt(c.value, 50), not_(eq(c.event_type, "click"))), lt(c.value, 1)), "(value > 50 AND NOT event_type = 'click') OR value < 1")
_filter("filter_object_form", ORDERS, ["o_orderkey"], lambda c: {"o_orderstatus": "O", "o_orderpriority": ["1-URGENT", "2-HIGH"]}, "o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
_filter("filter_timestamp", ORDERS, ["o_orderkey"], lambda c: gte(c.o_orderdate, F.lit("1996-01-01").cast("timestamp_ntz")), "o_orderdate >= TIMESTAMP '1996-01-01'")


def _dear(db) -> None:
    """Only dear orders: left joins find customers without any."""
    db.bind(ORDERS, db.frames["orders"].filter(F.col("o_totalprice") > DEAR))


_LEFT = f"customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > {DEAR}) ON c_custkey = o_custkey"
_ON = eq(CUSTOMER.c.c_custkey, ORDERS.c.o_custkey)


@query(f"SELECT c_custkey FROM {_LEFT} WHERE o_orderstatus IS NULL")
def filter_is_null(db):
    _dear(db)
    return db.select(c_custkey=CUSTOMER.c.c_custkey).from_(CUSTOMER).left_join(ORDERS, _ON).where(is_null(ORDERS.c.o_orderstatus)).df()


@query(f"SELECT c_custkey, o_orderkey FROM {_LEFT} WHERE o_orderstatus IS NOT NULL")
def filter_is_not_null(db):
    _dear(db)
    return db.select(c_custkey=CUSTOMER.c.c_custkey, o_orderkey=ORDERS.c.o_orderkey).from_(CUSTOMER).left_join(ORDERS, _ON).where(is_not_null(ORDERS.c.o_orderstatus)).df()


@query(f"SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > {DEAR})")
def filter_exists(db):
    return db.select(c_custkey=CUSTOMER.c.c_custkey).from_(CUSTOMER).where(exists(ORDERS, {CUSTOMER.c.c_custkey: ORDERS.c.o_custkey}, gt(ORDERS.c.o_totalprice, DEAR))).df()


@query(f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > {DEAR})")
def filter_not_exists(db):
    return db.select(c_custkey=CUSTOMER.c.c_custkey).from_(CUSTOMER).where(not_exists(ORDERS, {CUSTOMER.c.c_custkey: ORDERS.c.o_custkey}, gt(ORDERS.c.o_totalprice, DEAR))).df()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey > 10) ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def cursor_page(db):
    c = ORDERS.c
    q = db.select(o_orderkey=c.o_orderkey, o_totalprice=c.o_totalprice).from_(ORDERS)
    return q.where_cursor(or_(lt(c.o_totalprice, 200000), and_(eq(c.o_totalprice, 200000), gt(c.o_orderkey, 10)))).order_by(desc(c.o_totalprice), asc(c.o_orderkey)).limit(30).df()


# ---- joins


@query("SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def join_inner(db):
    return db.select(c_name=CUSTOMER.c.c_name, o_orderkey=ORDERS.c.o_orderkey).from_(CUSTOMER).inner_join(ORDERS, _ON).df()


@query(f"SELECT c_custkey, o_orderkey FROM {_LEFT}")
def join_left(db):
    _dear(db)
    return db.select(c_custkey=CUSTOMER.c.c_custkey, o_orderkey=ORDERS.c.o_orderkey).from_(CUSTOMER).left_join(ORDERS, {CUSTOMER.c.c_custkey: ORDERS.c.o_custkey}).df()


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(db):
    return db.select(r_name=REGION.c.r_name, n_name=NATION.c.n_name).from_(REGION).cross_join(NATION).df()


@query(f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) RIGHT JOIN (SELECT * FROM orders WHERE o_totalprice > {DEAR}) ON c_custkey = o_custkey")
def join_right(db):
    _dear(db)
    db.bind(CUSTOMER, db.frames["customer"].filter("c_acctbal > 0"))
    return db.select(c_custkey=CUSTOMER.c.c_custkey, o_orderkey=ORDERS.c.o_orderkey).from_(CUSTOMER).right_join(ORDERS, _ON).df()


@query(f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT * FROM orders WHERE o_totalprice > {DEAR}) ON c_custkey = o_custkey")
def join_full(db):
    _dear(db)
    db.bind(CUSTOMER, db.frames["customer"].filter("c_acctbal > 0"))
    return db.select(c_custkey=CUSTOMER.c.c_custkey, o_orderkey=ORDERS.c.o_orderkey).from_(CUSTOMER).full_join(ORDERS, _ON).df()


@query("SELECT a.n_name AS name, b.n_name AS neighbour FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE b.n_name <> a.n_name")
def join_self_alias(db):
    other = alias(NATION, "Other")
    return db.select(name=NATION.c.n_name, neighbour=other.c.n_name).from_(NATION).inner_join(other, eq(NATION.c.n_regionkey, other.c.n_regionkey)).where(ne(other.c.n_name, NATION.c.n_name)).df()


@query("SELECT a.l_orderkey AS l_orderkey, a.l_linenumber AS l_linenumber, b.l_quantity AS l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
def join_multi_key(db):
    b = alias(LINEITEM, "B")
    a = LINEITEM.c
    return db.select(l_orderkey=a.l_orderkey, l_linenumber=a.l_linenumber, l_quantity=b.c.l_quantity).from_(LINEITEM).inner_join(b, and_(eq(a.l_orderkey, b.c.l_orderkey), eq(a.l_linenumber, b.c.l_linenumber))).df()


@query("SELECT r_name, n_name, c_custkey, o_orderkey FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey")
def join_chain(db):
    q = db.select(r_name=REGION.c.r_name, n_name=NATION.c.n_name, c_custkey=CUSTOMER.c.c_custkey, o_orderkey=ORDERS.c.o_orderkey).from_(REGION)
    return q.inner_join(NATION, eq(REGION.c.r_regionkey, NATION.c.n_regionkey)).inner_join(CUSTOMER, eq(NATION.c.n_nationkey, CUSTOMER.c.c_nationkey)).inner_join(ORDERS, _ON).df()


@query(f"SELECT c_custkey, o_orderkey FROM {_LEFT} WHERE o_orderstatus = 'F' AND c_acctbal > 0")
def join_post_filter(db):
    _dear(db)
    q = db.select(c_custkey=CUSTOMER.c.c_custkey, o_orderkey=ORDERS.c.o_orderkey).from_(CUSTOMER).left_join(ORDERS, _ON)
    return q.where(and_(eq(ORDERS.c.o_orderstatus, "F"), gt(CUSTOMER.c.c_acctbal, 0))).df()


# ---- aggregates


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_customers FROM orders")
def agg_global(db):
    return db.select(n=count(), n_customers=count(ORDERS.c.o_custkey, distinct=True)).from_(ORDERS).df()


@query(f"SELECT count(*) AS n, count(o_orderkey) AS n_orders FROM {_LEFT}")
def agg_count_col(db):
    _dear(db)
    return db.select(n=count(), n_orders=count(ORDERS.c.o_orderkey)).from_(CUSTOMER).left_join(ORDERS, _ON).df()


@query("SELECT count(DISTINCT o_orderstatus) AS n FROM orders")
def agg_count_distinct(db):
    return db.select(n=count(ORDERS.c.o_orderstatus, distinct=True)).from_(ORDERS).df()


@query("SELECT count(*) AS n FROM (SELECT DISTINCT * FROM nation)")
def agg_count_distinct_rows(db):
    return db.select(n=count(distinct=True)).from_(NATION).df()


@query("SELECT round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem")
def agg_sum_avg_min_max(db):
    c = LINEITEM.c.l_quantity
    df = db.select(total=sum_(c), mean=avg(c), low=min_(c), high=max_(c)).from_(LINEITEM).df()
    return df.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6)})


@query("SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS total FROM part")
def agg_sum_distinct(db):
    return db.select(total=sum_(PART.c.p_size, distinct=True)).from_(PART).df()


@query("SELECT p_brand, round(avg(DISTINCT p_size), 6) AS mean, min(DISTINCT p_size) AS low FROM part GROUP BY p_brand")
def agg_avg_distinct(db):
    df = db.select(p_brand=PART.c.p_brand, mean=avg(PART.c.p_size, distinct=True), low=min_(PART.c.p_size, distinct=True)).from_(PART).group_by("p_brand").df()
    return df.withColumn("mean", F.round("mean", 6))


@query("SELECT min(o_orderpriority) AS low, max(o_orderpriority) AS high, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders")
def agg_min_max_string_ts(db):
    c = ORDERS.c
    return db.select(low=min_(c.o_orderpriority), high=max_(c.o_orderpriority), first_date=min_(c.o_orderdate), last_date=max_(c.o_orderdate)).from_(ORDERS).df()


@query("SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_totalprice < 0")
def agg_global_empty(db):
    return db.select(n=count(), total=sum_(ORDERS.c.o_totalprice)).from_(ORDERS).where(lt(ORDERS.c.o_totalprice, 0)).df()


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def group_by(db):
    df = db.select(o_orderstatus=ORDERS.c.o_orderstatus, n=count(), total=sum_(ORDERS.c.o_totalprice)).from_(ORDERS).group_by(ORDERS.c.o_orderstatus).df()
    return df.withColumn("total", F.round("total", 2))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority")
def group_by_multi(db):
    return db.select(o_orderstatus="o_orderstatus", o_orderpriority="o_orderpriority", n=count()).from_(ORDERS).group_by("o_orderstatus", "o_orderpriority").df()


@query("SELECT DISTINCT o_orderpriority FROM orders")
def group_by_dedupe(db):
    return db.select(o_orderpriority="o_orderpriority").from_(ORDERS).group_by("o_orderpriority").df()


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having_alias(db):
    return db.select(o_custkey="o_custkey", n=count()).from_(ORDERS).group_by("o_custkey").having(lambda a: gt(a.n, 12)).df()


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) BETWEEN 9 AND 11")
def having_between(db):
    return db.select(o_custkey="o_custkey", n=count()).from_(ORDERS).group_by("o_custkey").having(between(Ref(None, "n"), 9, 11)).df()


@query("SELECT c_mktsegment, count(o_orderkey) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment HAVING count(o_orderkey) > 0")
def agg_over_join(db):
    q = db.select(c_mktsegment=CUSTOMER.c.c_mktsegment, n_orders=count(ORDERS.c.o_orderkey), revenue=sum_(ORDERS.c.o_totalprice)).from_(CUSTOMER).left_join(ORDERS, _ON)
    return q.group_by(CUSTOMER.c.c_mktsegment).having(lambda a: gt(a.n_orders, 0)).df().withColumn("revenue", F.round("revenue", 2))


# ---- order, page, distinct


@query(f"SELECT c_custkey, o_orderkey FROM {_LEFT} ORDER BY o_orderkey DESC NULLS FIRST, c_custkey ASC NULLS LAST LIMIT 300")
def order_multi_nulls(db):
    _dear(db)
    q = db.select(c_custkey=CUSTOMER.c.c_custkey, o_orderkey=ORDERS.c.o_orderkey).from_(CUSTOMER).left_join(ORDERS, _ON)
    return q.order_by(desc(ORDERS.c.o_orderkey), asc(CUSTOMER.c.c_custkey)).limit(300).df()


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 10 OFFSET 5")
def limit_offset(db):
    return db.select(s_suppkey="s_suppkey", s_acctbal="s_acctbal").from_(SUPPLIER).order_by("s_acctbal", "s_suppkey").limit(10).offset(5).df()


@query("SELECT s_suppkey FROM supplier WHERE false")
def limit_zero(db):
    return db.select(s_suppkey="s_suppkey").from_(SUPPLIER).limit(0).df()


@query("SELECT s_suppkey FROM supplier ORDER BY s_suppkey OFFSET 7")
def offset_only(db):
    return db.select(s_suppkey="s_suppkey").from_(SUPPLIER).order_by("s_suppkey").offset(7).df()


@query("SELECT DISTINCT event_type, user_id FROM events")
def distinct_rows(db):
    return db.select(event_type="event_type", user_id="user_id").from_(EVENTS).distinct().df()


@query("SELECT DISTINCT user_id FROM events ORDER BY user_id DESC LIMIT 20")
def distinct_limit(db):
    return db.select(user_id="user_id").from_(EVENTS).distinct().order_by(desc("user_id")).limit(20).df()


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(db):
    return db.select(k="c_nationkey").from_(CUSTOMER).union(db.select(k="s_nationkey").from_(SUPPLIER))


@query("SELECT o_custkey AS k FROM orders WHERE o_totalprice > 400000 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def set_intersect(db):
    return db.select(k="o_custkey").from_(ORDERS).where(gt(ORDERS.c.o_totalprice, DEAR)).intersect(db.select(k=CUSTOMER.c.c_custkey).from_(CUSTOMER).where(gt(CUSTOMER.c.c_acctbal, 5000)))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT user_id FROM events")
def set_except(db):
    return db.select(k=CUSTOMER.c.c_custkey).from_(CUSTOMER).except_(db.select(k="user_id").from_(EVENTS))


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT user_id FROM events WHERE event_type = 'click'")
def set_except_repeats(db):
    """Most customers have several orders: a value goes however often it stands on the left."""
    return db.select(k="o_custkey").from_(ORDERS).except_(db.select(k="user_id").from_(EVENTS).where(eq(EVENTS.c.event_type, "click")))


@query("SELECT DISTINCT o_orderpriority, n FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority, o_custkey) ORDER BY o_orderpriority DESC, n")
def group_distinct_order(db):
    """Grouped by one more column than is shown: equal rows that are put out count once."""
    q = db.select(o_orderpriority="o_orderpriority", n=count()).from_(ORDERS).group_by("o_orderpriority", "o_custkey")
    return q.distinct().order_by(desc(ORDERS.c.o_orderpriority), asc("n")).df()


# ---- relations


_LIST = "coalesce(string_agg(o_orderkey::varchar, ',' ORDER BY o_orderkey), '')"


def _keys(name: str) -> F.Column:
    return F.array_join(F.array_sort(F.transform(f"{name}", lambda o: o["o_orderkey"])).cast("array<string>"), ",")


@query(f"SELECT c_custkey, {_LIST} AS orders FROM {_LEFT} GROUP BY c_custkey")
def rel_many(db):
    _dear(db)
    return db.query(CUSTOMER).find_many(with_=["orders"]).select("c_custkey", _keys("orders").alias("orders"))


@query("SELECT o_orderkey, c_name AS customer FROM orders JOIN customer ON c_custkey = o_custkey")
def rel_one(db):
    return db.query(ORDERS).find_many(with_=["customer"]).select("o_orderkey", F.col("customer.c_name").alias("customer"))


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def rel_inverse(db):
    """Regions hold an inverse list of the IRIs of their nations."""
    regions = table("regions", {"r_regionkey": key("bigint"), "r_name": string(), "nations": column("uri", predicate_iri=NS + "region").array().inverse().link("nation")}, NS + "Region", namespace=NS, base=HOME + "region", template="#{id}")
    lists = db.frame(NATION).groupBy(F.col("n_regionkey").alias("k")).agg(F.collect_set("_iri").alias("nations"))
    db.bind(regions, db.frames["region"].join(lists, F.col("k") == F.col("r_regionkey"), "left")).relate(regions, members=many(NATION))
    rows = db.query(regions).find_many(with_=["members"])
    return rows.select("r_name", F.array_join(F.array_sort(F.transform("members", lambda n: n["n_name"])), ",").alias("nations"))


@query("SELECT count(*) AS n FROM customer WHERE c_acctbal > 5000")
def rel_count(db):
    return db.spark.range(1).select(F.lit(db.query(CUSTOMER).count(gt(CUSTOMER.c.c_acctbal, 5000))).cast("long").alias("n"))


@query(f"SELECT c_custkey, {_LIST} AS orders FROM (SELECT * FROM customer WHERE c_acctbal > 1000 ORDER BY c_acctbal DESC, c_custkey LIMIT 50) LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def rel_where_order_limit(db):
    rows = db.query(CUSTOMER).find_many(where=gt(CUSTOMER.c.c_acctbal, 1000), order_by=(desc("c_acctbal"), asc("c_custkey")), limit=50, with_={"orders": True})
    return rows.select("c_custkey", _keys("orders").alias("orders"))


@query(f"SELECT c_name, {_LIST} AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name")
def rel_columns(db):
    return db.query(CUSTOMER).find_many(columns=["c_name"], with_=["orders"]).select("c_name", _keys("orders").alias("orders"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def exact_by_id(db):
    return db.query(CUSTOMER).find_by_id(42, columns=["c_custkey", "c_name"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def exact_by_id_limit(db):
    """The lookup comes before the page, whatever sorts before the row."""
    return db.query(CUSTOMER).find_by_id(42, columns=["c_custkey", "c_name"], order_by=desc("c_name"), limit=1)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 43")
def exact_by_iri(db):
    return db.query(CUSTOMER).find_by_iri(HOME + "customer#43", columns=["c_custkey", "c_name"])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def exact_by_short_id(db):
    return db.query(NATION).find_by_resource("7", columns=["n_nationkey", "n_name"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (5, 6, 77)")
def exact_by_iris(db):
    return db.query(CUSTOMER).find_by_iris([f"{HOME}customer#{k}" for k in (5, 6, 77, 10**12)], columns=["c_custkey", "c_name"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal, c_custkey LIMIT 1")
def rel_first(db):
    row = db.query(CUSTOMER).find_first(where=gt(CUSTOMER.c.c_acctbal, 0), order_by=("c_acctbal", "c_custkey"))
    return db.spark.createDataFrame([(row["c_custkey"], row["c_name"])], "c_custkey long, c_name string")


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, min(value) AS value FROM events GROUP BY user_id")
def rel_merged_subjects(db):
    """Events as several rows of one subject each, merged before they are loaded."""
    users = table("users", {"user_id": key("bigint"), "kinds": string().array(), "value": double()}, NS + "User", namespace=NS, base=HOME + "users", template="#{id}")
    db.bind(users, db.frames["events"].select("user_id", F.array("event_type").alias("kinds"), "value"))
    return db.query(users).merged().select("user_id", F.array_join("kinds", ",").alias("kinds"), "value")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 12")
def order_by_id(db):
    return db.select(o_orderkey="o_orderkey").from_(ORDERS).order_by(desc(ORDERS.c.o_orderkey)).limit(12).df()


@query("SELECT event_id, value FROM events WHERE event_type = 'click'")
def layout_pruned(db):
    """Events in folders by kind; an equality on the template's variable reads one folder."""
    t = table("filed", {"event_id": key("bigint"), "event_type": string(), "value": double()}, NS + "Event", namespace=NS, base=HOME + "filed", template="{event_type}/log.ttl#{id}")
    at = layout.scratch(db.spark, "filed")
    layout.write_table(db.frames["events"].select("event_id", "event_type", "value"), t, at)
    return layout.read_table(db.spark, t, at, event_type="click").select("event_id", "value")


# ---- identifiers


@query("SELECT event_id, 'http://data.example/events#' || event_id AS iri FROM events")
def id_template(db):
    return db.frame(EVENTS).select("event_id", F.col("_iri").alias("iri"))


@query("SELECT event_id, event_id::varchar AS short FROM events")
def id_extract(db):
    return db.frame(EVENTS).select("event_id", identity.extract(F.col("_iri"), EVENTS.base, EVENTS.template)["id"].alias("short"))


@query("SELECT event_id, 'http://data.example/events/' || event_type || '/' || strftime(ts, '%Y/%m/%d') || '/log.ttl#' || event_id AS iri FROM events")
def id_partitioned(db):
    dated = table("dated", {"event_id": key("bigint"), "event_type": string(), "createdAt": timestamp(source="ts")}, NS + "Event", namespace=NS, base=HOME + "events", template="{event_type}/{yyyy}/{MM}/{dd}/log.ttl#{id}")
    db.bind(dated, db.frames["events"])
    return db.frame(dated).select("event_id", F.col("_iri").alias("iri"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def id_slug(db):
    return db.frame(PART).select("p_partkey", identity.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


# ---- quads


def _quads(db: Database, *tables: Table) -> DataFrame:
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), (quads.wide_to_quads(db.frame(t), t) for t in tables))


@query("SELECT c_custkey, c_name, c_nationkey::bigint AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def quads_roundtrip(db):
    return quads.type_scan(_quads(db, CUSTOMER), CUSTOMER).drop("_iri")


@query("SELECT 'http://data.example/nation#' || n_nationkey AS s FROM nation")
def quads_type_scan(db):
    return quads.type_scan(_quads(db, NATION, REGION), NATION, HOME + "nation").select(F.col("_iri").alias("s"))


_USER = table("user", {"user_id": key("bigint"), "kinds": string().array()}, NS + "User", namespace=NS, base=HOME + "user", template="#{id}")


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def quads_multivalue(db):
    wide = db.frames["events"].groupBy("user_id").agg(F.collect_list("event_type").alias("kinds"))
    q = quads.wide_to_quads(Database(db.spark).bind(_USER, wide).frame(_USER), _USER)
    return quads.type_scan(q, _USER).select("user_id", F.array_join("kinds", ",").alias("kinds"))


@query("SELECT 'http://data.example/nation' AS g, count(*) AS n FROM (SELECT unnest([1, 2, 3]) FROM nation)")
def quads_graph_scan(db):
    return quads.graph_scan(_quads(db, NATION, REGION), HOME + "nation").groupBy("g").agg(F.count("*").alias("n"))


@query(f"SELECT 'n_name' AS p, n_name AS o FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'n_regionkey', n_regionkey::varchar FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'type', '{NS}Nation'")
def quads_read_subject(db):
    rows = quads.read_subject(_quads(db, NATION, REGION), HOME + "nation#7", HOME + "nation")
    return rows.select(F.regexp_replace("p", "^.*#", "").alias("p"), "o")


# ---- SPARQL


def _sparql(name: str, text: str, sql: str, cast: dict[str, str] | None = None, tables: tuple = (REGION, NATION, CUSTOMER)) -> None:
    def f(db):
        db.load_quads(*tables)
        rows = db.sparql(f"PREFIX v: <{NS}>\n" + text)
        return rows.withColumns({k: F.col(k).cast(t) for k, t in (cast or {}).items()})

    f.__name__ = name
    query(sql)(f)


_sparql("sparql_bgp", "SELECT ?nation ?region WHERE { ?n a v:Nation ; v:n_name ?nation ; v:n_regionkey ?k . ?r a v:Region ; v:r_name ?region . BIND(STRAFTER(STR(?r), '#') AS ?short) FILTER(?short = STR(?k)) }",
        "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
_sparql("sparql_filter", "SELECT ?name ?bal WHERE { ?c v:c_name ?name ; v:c_acctbal ?bal ; v:c_mktsegment 'BUILDING' . FILTER(?bal > 5000 && REGEX(?name, '1$')) }",
        "SELECT c_name AS name, c_acctbal AS bal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000 AND regexp_matches(c_name, '1$')", {"bal": "double"})
_sparql("sparql_optional", "SELECT ?name ?rich WHERE { ?c v:c_name ?name ; v:c_acctbal ?bal . OPTIONAL { ?c v:c_mktsegment ?rich . FILTER(?bal > 9000) } }",
        "SELECT c_name AS name, CASE WHEN c_acctbal > 9000 THEN c_mktsegment END AS rich FROM customer")
_sparql("sparql_union", "SELECT ?name WHERE { { ?x v:n_name ?name } UNION { ?x v:r_name ?name } }", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
_sparql("sparql_minus", "SELECT ?name WHERE { ?n v:n_name ?name MINUS { ?n v:n_regionkey 1 } }", "SELECT n_name AS name FROM nation WHERE n_regionkey <> 1")
_sparql("sparql_bind", "SELECT ?name ?twice WHERE { ?c v:c_name ?name ; v:c_nationkey ?k . BIND(?k * 2 AS ?twice) }", "SELECT c_name AS name, CAST(c_nationkey * 2 AS BIGINT) AS twice FROM customer", {"twice": "bigint"})
_sparql("sparql_values", "SELECT ?name ?k WHERE { VALUES ?k { 1 2 } ?n v:n_name ?name ; v:n_regionkey ?k }", "SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS k FROM nation WHERE n_regionkey IN (1, 2)", {"k": "bigint"})
_sparql("sparql_subselect", "SELECT ?name ?n WHERE { ?c v:c_name ?name ; v:c_nationkey ?k . { SELECT ?k (COUNT(*) AS ?n) WHERE { ?x v:c_nationkey ?k } GROUP BY ?k } }",
        "SELECT c_name AS name, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer", {"n": "bigint"})
_sparql("sparql_group", "SELECT ?seg (COUNT(?c) AS ?n) (SUM(?bal) AS ?total) (MAX(?name) AS ?last) WHERE { ?c v:c_mktsegment ?seg ; v:c_acctbal ?bal ; v:c_name ?name } GROUP BY ?seg HAVING (COUNT(?c) > 1)",
        "SELECT c_mktsegment AS seg, count(*) AS n, CAST(sum(c_acctbal) AS DECIMAL(20,0)) AS total, max(c_name) AS last FROM customer GROUP BY c_mktsegment HAVING count(*) > 1", {"n": "bigint", "total": "decimal(20,0)"})
_sparql("sparql_order_limit", "SELECT DISTINCT ?k WHERE { ?c v:c_nationkey ?k } ORDER BY DESC(?k) LIMIT 5 OFFSET 2", "SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS k FROM customer ORDER BY k DESC LIMIT 5 OFFSET 2", {"k": "bigint"})
_sparql("sparql_exists", "SELECT ?name WHERE { ?n v:n_name ?name ; v:n_regionkey ?k . FILTER NOT EXISTS { ?n v:n_regionkey 2 } }", "SELECT n_name AS name FROM nation WHERE n_regionkey <> 2")
_sparql("sparql_graph", f"SELECT ?name WHERE {{ GRAPH <{HOME}region> {{ ?s v:r_name ?name }} }}", "SELECT r_name AS name FROM region")
_sparql("sparql_ask", "ASK { ?r v:r_name 'ASIA' }", "SELECT count(*) > 0 AS result FROM region WHERE r_name = 'ASIA'")


_sparql("sparql_strings", "SELECT ?up ?low ?len ?part ?both ?swap ?before WHERE { ?c v:c_name ?name . BIND(UCASE(?name) AS ?up) BIND(LCASE(?name) AS ?low) BIND(STRLEN(?name) AS ?len) BIND(SUBSTR(?name, 10, 4) AS ?part) BIND(CONCAT(?name, '-', ?part) AS ?both) BIND(REPLACE(?name, '0+', 'o') AS ?swap) BIND(STRBEFORE(?name, '#') AS ?before) }",
        "SELECT upper(c_name) AS up, lower(c_name) AS low, length(c_name) AS len, substr(c_name, 10, 4) AS part, c_name || '-' || substr(c_name, 10, 4) AS both, regexp_replace(c_name, '0+', 'o', 'g') AS swap, split_part(c_name, '#', 1) AS before FROM customer", {"len": "bigint"})
_sparql("sparql_optional_join", "SELECT ?name ?k WHERE { ?c v:c_name ?name ; v:c_acctbal ?bal . OPTIONAL { ?c v:c_nationkey ?k . FILTER(?bal > 5000) } ?c v:c_nationkey ?k }",
        "SELECT c_name AS name, c_nationkey::bigint AS k FROM customer", {"k": "bigint"})
_sparql("sparql_path", "SELECT DISTINCT ?name WHERE { ?n v:n_name|v:r_name ?name . ?n a/^a ?other . ?other v:r_name ?any }", "SELECT DISTINCT r_name AS name FROM region")
_sparql("sparql_construct", "CONSTRUCT { ?n v:label ?name } WHERE { ?n a v:Nation ; v:n_name ?name }", f"SELECT 'http://data.example/nation#' || n_nationkey AS s, '{NS}label' AS p, 'literal' AS o_kind, n_name AS o, 'http://www.w3.org/2001/XMLSchema#string' AS o_dt, NULL::varchar AS o_lang FROM nation")
_sparql("sparql_describe", "DESCRIBE ?r WHERE { ?r v:r_name 'ASIA' }", f"SELECT 'http://data.example/region#' || r_regionkey AS s, '{quads.RDF_TYPE}' AS p, 'iri' AS o_kind, '{NS}Region' AS o, NULL::varchar AS o_dt, NULL::varchar AS o_lang FROM region WHERE r_name = 'ASIA' UNION ALL SELECT 'http://data.example/region#' || r_regionkey, '{NS}r_name', 'literal', r_name, '{quads.XSD}string', NULL FROM region WHERE r_name = 'ASIA'")


@query("WITH RECURSIVE up(a, b) AS (SELECT n_nationkey, n_nationkey - 5 FROM nation WHERE n_nationkey >= 5 UNION SELECT a, b - 5 FROM up WHERE b >= 5) SELECT 'http://data.example/nation#' || a AS a, 'http://data.example/nation#' || b AS b FROM up")
def sparql_closure(db):
    """Every fifth nation is linked to the one five before it: a path of any length."""
    iri = lambda c: F.concat(F.lit(HOME + "nation#"), c.cast("string"))
    rows = db.frames["nation"].filter("n_nationkey >= 5").select(F.lit(HOME + "nation").alias("g"), iri(F.col("n_nationkey")).alias("s"), F.lit(NS + "after").alias("p"), F.lit("iri").alias("o_kind"), iri(F.col("n_nationkey") - 5).alias("o"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    return db.replace_quads(rows, True).sparql(f"PREFIX v: <{NS}> SELECT ?a ?b WHERE {{ ?a v:after+ ?b }}")


def _update(name: str, text: str, sql: str) -> None:
    def f(db):
        db.load_quads(NATION)
        db.sparql(f"PREFIX v: <{NS}>\n" + text)
        return quads.type_scan(db.quads, NATION).select("n_nationkey", "n_name", "n_regionkey")

    f.__name__ = name
    query(sql)(f)


_BIG = "SELECT n_nationkey::bigint AS n_nationkey, n_name, n_regionkey::bigint AS n_regionkey FROM nation"
_update("sparql_update_insert", f"INSERT DATA {{ <{HOME}nation#99> a v:Nation ; v:n_name 'NOWHERE' ; v:n_regionkey 4 }}", f"{_BIG} UNION ALL SELECT 99, 'NOWHERE', 4")
_update("sparql_update_delete", "DELETE WHERE { ?n a v:Nation ; v:n_name ?x ; v:n_regionkey 3 }", f"{_BIG} WHERE n_regionkey <> 3")
_update("sparql_update_modify", "DELETE { ?n v:n_regionkey ?k } INSERT { ?n v:n_regionkey ?m } WHERE { ?n v:n_regionkey ?k . FILTER(?k = 1) BIND(?k + 10 AS ?m) }",
        "SELECT n_nationkey::bigint AS n_nationkey, n_name, CASE WHEN n_regionkey = 1 THEN 11 ELSE n_regionkey END::bigint AS n_regionkey FROM nation")

_update("sparql_update_optional", "DELETE { ?n v:n_name ?x } INSERT { ?n v:n_name 'RENAMED' } WHERE { ?n v:n_name ?x . OPTIONAL { ?n v:n_regionkey ?k . FILTER(?k = 2) } FILTER(BOUND(?k)) }", "SELECT n_nationkey::bigint AS n_nationkey, CASE WHEN n_regionkey = 2 THEN 'RENAMED' ELSE n_name END AS n_name, n_regionkey::bigint AS n_regionkey FROM nation")
_update("sparql_update_minus", "DELETE { ?n ?p ?o } WHERE { ?n ?p ?o MINUS { ?n v:n_regionkey 0 } }", f"{_BIG} WHERE n_regionkey = 0")
_update("sparql_update_subselect", "DELETE { ?n v:n_name ?x } INSERT { ?n v:n_name 'TOP' } WHERE { { SELECT (MAX(?k) AS ?top) WHERE { ?m v:n_regionkey ?k } } ?n v:n_regionkey ?top ; v:n_name ?x }", "SELECT n_nationkey::bigint AS n_nationkey, CASE WHEN n_regionkey = (SELECT max(n_regionkey) FROM nation) THEN 'TOP' ELSE n_name END AS n_name, n_regionkey::bigint AS n_regionkey FROM nation")
_update("sparql_update_clear", f"CLEAR GRAPH <{HOME}region> ; COPY <{HOME}nation> TO <{HOME}other> ; DROP GRAPH <{HOME}nation>", _BIG)
_update("sparql_update_union", "DELETE { ?n ?p ?o } WHERE { ?n ?p ?o { ?n v:n_regionkey 1 } UNION { ?n v:n_name 'NATION_7' } }", f"{_BIG} WHERE n_regionkey <> 1 AND n_name <> 'NATION_7'")


# ---- changes


_SUPPLIER = "s_suppkey, s_name, s_nationkey, s_acctbal"


@query("SELECT s_suppkey, s_name, s_nationkey::bigint AS s_nationkey, s_acctbal FROM supplier UNION ALL SELECT 900001, 'new', 7, 0.0 UNION ALL SELECT 900002, 'other', 3, 5.5")
def mut_insert_defaults(db):
    from dataclasses import replace

    columns = {**SUPPLIER.columns, "s_name": SUPPLIER.columns["s_name"].default("new"), "s_acctbal": SUPPLIER.columns["s_acctbal"].default(lambda: 0.0)}
    t = replace(SUPPLIER, columns=columns)
    db.insert(t).values([{"s_suppkey": 900001, "s_nationkey": 7}, {"s_suppkey": 900002, "s_name": "other", "s_nationkey": 3, "s_acctbal": 5.5}]).run()
    return db.frames["supplier"]


@query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey < 5 THEN 1.5 ELSE s_acctbal END AS s_acctbal FROM supplier")
def mut_update(db):
    db.update(SUPPLIER).set({"s_acctbal": 1.5}).where(lt(SUPPLIER.c.s_nationkey, 5)).run()
    return db.frames["supplier"]


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier")
def mut_set_null(db):
    db.update(SUPPLIER).set({"s_name": None}).where(lt(SUPPLIER.c.s_acctbal, 0)).run()
    return db.frames["supplier"]


@query("SELECT s_suppkey, CASE WHEN s_suppkey = 3 THEN 'third' ELSE s_name END AS s_name FROM supplier WHERE s_suppkey <> 4")
def mut_by_resource(db):
    mutations.update_by_iri(db, SUPPLIER, HOME + "supplier#3", {"s_name": "other"})
    mutations.update_by_resource(db, SUPPLIER, "3", {"s_name": "third"})
    mutations.delete_by_resource(db, SUPPLIER, HOME + "supplier#4")
    return db.frames["supplier"].select("s_suppkey", "s_name")


@query(f"SELECT {_SUPPLIER} FROM supplier WHERE NOT (s_acctbal < 0)")
def mut_delete(db):
    db.delete(SUPPLIER).where(lt(SUPPLIER.c.s_acctbal, 0)).run()
    return db.frames["supplier"]


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'changed' ELSE s_name END AS s_name, s_nationkey::bigint AS s_nationkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 800000, 'changed', s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 5000")
def mut_upsert(db):
    few = db.frames["supplier"].filter("s_acctbal > 5000").withColumn("s_name", F.lit("changed"))
    return mutations.upsert(db, SUPPLIER, few.unionByName(few.withColumn("s_suppkey", F.col("s_suppkey") + 800000)))


@query("SELECT s_suppkey, CAST(2.5 AS DOUBLE) AS s_acctbal FROM supplier WHERE s_nationkey = 3")
def mut_returning(db):
    return db.update(SUPPLIER).set({"s_acctbal": 2.5}).where({"s_nationkey": 3}).returning("s_suppkey", "s_acctbal")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 3")
def mut_delete_returning(db):
    return db.delete(SUPPLIER).where({"s_nationkey": 3}).returning("s_suppkey", "s_name")


def _versions(db: Database) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = db.frames["events"].select("event_id", "ts", "value", "event_type")
    local = base.filter("event_id % 11 <> 0").withColumn("value", F.when(F.expr("event_id % 3 = 0"), -1.0).otherwise(F.col("value")))
    later = F.when(F.expr("event_id % 4 = 0"), F.col("ts") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts"))
    return base, local, base.filter("event_id % 13 <> 0").withColumns({"event_type": F.when(F.expr("event_id % 5 = 0"), "remote").otherwise(F.col("event_type")), "ts": later})


_L = "(SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN -1.0 ELSE value END AS value, event_type FROM events WHERE event_id % 11 <> 0) l"
_R = "(SELECT event_id, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 1 DAY ELSE ts END AS ts, value, CASE WHEN event_id % 5 = 0 THEN 'remote' ELSE event_type END AS event_type FROM events WHERE event_id % 13 <> 0) r"
_PICK = lambda test: "SELECT coalesce(l.event_id, r.event_id) AS event_id, " + ", ".join(f"CASE WHEN {test} THEN l.{c} ELSE r.{c} END AS {c}" for c in ("ts", "value", "event_type")) + f" FROM {_L} FULL JOIN {_R} ON l.event_id = r.event_id"


@query(_PICK("l.event_id IS NOT NULL"))
def conflict_lww(db):
    _, local, remote = _versions(db)
    return conflicts.last_write_wins(local, remote, "event_id")


@query(_PICK("r.event_id IS NULL OR (l.event_id IS NOT NULL AND l.ts > r.ts)"))
def conflict_timestamp(db):
    _, local, remote = _versions(db)
    return conflicts.by_timestamp(local, remote, "event_id", "ts")


@query(f"SELECT l.event_id AS event_id, r.ts AS ts, l.value AS value, r.event_type AS event_type FROM {_L} JOIN {_R} ON l.event_id = r.event_id")
def conflict_field(db):
    base, local, remote = _versions(db)
    return conflicts.by_field(base, local, remote, "event_id")


@query("SELECT event_id, 'value' AS field FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 3 = 0 AND value <> -1 UNION ALL SELECT event_id, 'event_type' FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 5 = 0")
def conflict_list(db):
    _, local, remote = _versions(db)
    return conflicts.conflicts(local.drop("ts"), remote.drop("ts"), "event_id").select("event_id", "field")


@query("SELECT count(*) AS n, count(DISTINCT s_suppkey) AS n_keys, 0 AS n_lacking, 21 AS shortest FROM (SELECT s_suppkey FROM supplier UNION ALL SELECT s_suppkey + 1000000 FROM supplier)")
def mut_insert_generated_key(db):
    """Suppliers inserted into a table with text keys: those without one get a key of their own that stays the same."""
    made = table("made", {"id": key(), "name": string(), "nation": integer()}, NS + "Made", namespace=NS, base=HOME + "made", template="#{id}")
    rows = db.frames["supplier"].select(F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("nation"))
    db.insert(made).values(rows).run()
    db.insert(made).values(rows.withColumn("id", F.lit(None).cast("string"))).run()
    return db.frames["made"].agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_keys"), F.count_if(F.col("id").isNull()).cast("int").alias("n_lacking"), F.min(F.char_length("id")).alias("shortest"))


@query("SELECT s_suppkey, strftime(DATE '1996-01-02', '%Y/%m/%d') || '/' || lower(s_name) AS prefix FROM supplier")
def mut_id_template(db):
    """Keys after a template: date parts of the row's time, a slug and a generated end."""
    made = table("dated", {"id": key("id").default("{yyyy}/{MM}/{dd}/{name|slug}.ttl#{key}"), "name": string(), "createdAt": timestamp(), "number": integer()}, NS + "Dated", namespace=NS, base=HOME + "dated", template="{id}")
    rows = db.frames["supplier"].select(F.regexp_replace("s_name", "#", "-").alias("name"), F.lit("1996-01-02").cast("timestamp").alias("createdAt"), F.col("s_suppkey").alias("number"))
    db.insert(made).values(rows).run()
    return db.frames["dated"].select(F.col("number").alias("s_suppkey"), F.regexp_replace(F.regexp_extract("id", r"^(.*)\.ttl#.{21}$", 1), "-", "#").alias("prefix"))


@query("SELECT s_suppkey, s_name, s_nationkey::bigint AS s_nationkey, CASE WHEN s_nationkey = 7 THEN 2.5 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_nationkey <> 3 UNION ALL SELECT 900001, 'new', 7, 2.5")
def mut_write_back(db):
    """A table that lasts: insert, update and delete are written to its folder, and read back by another database."""
    path, rows = layout.scratch(db.spark, "store"), db.frames["supplier"]
    lasting = Database(db.spark).bind_store(SUPPLIER, path)
    lasting.insert(SUPPLIER).values(rows).run()
    lasting.insert(SUPPLIER).values({"s_suppkey": 900001, "s_name": "new", "s_nationkey": 7, "s_acctbal": 0.0}).run()
    lasting.update(SUPPLIER).set({"s_acctbal": 2.5}).where({"s_nationkey": 7}).run()
    lasting.delete(SUPPLIER).where({"s_nationkey": 3}).run()
    return Database(db.spark).bind_store(SUPPLIER, path).frames["supplier"]


@query("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey + 700000, 'again' FROM supplier")
def mut_insert_once(db):
    rows = db.frames["supplier"].withColumn("s_name", F.lit("again"))
    mutations.insert_once(db, SUPPLIER, rows.unionByName(rows.withColumn("s_suppkey", F.col("s_suppkey") + 700000)))
    return db.frames["supplier"].select("s_suppkey", "s_name")


@query(_PICK("r.event_id IS NULL").replace("CASE WHEN r.event_id IS NULL THEN l.value ELSE r.value END", "CASE WHEN r.event_id IS NULL THEN l.value WHEN l.event_id IS NULL THEN r.value ELSE greatest(l.value, r.value) END"))
def conflict_by_user(db):
    _, local, remote = _versions(db)
    return conflicts.by_user(local, remote, "event_id", lambda name, l, r: F.greatest(l, r) if name == "value" else r)  # noqa: E741


@query("SELECT 'http://data.example/supplier#' || s_suppkey AS s FROM supplier WHERE s_nationkey <> 3")
def delete_inline_children(db):
    """Each supplier holds an inline part that holds another one: they go with it, others stay."""
    from quadrel.operators import things

    iri = F.concat(F.lit(HOME + "supplier#"), F.col("s_suppkey").cast("string"))
    step = lambda a, b: F.struct(a.alias("s"), F.lit(NS + "holds").alias("p"), F.lit("iri").alias("o_kind"), b.alias("o"))
    inner, last = F.concat(iri, F.lit("-part")), F.concat(iri, F.lit("-part-of-part"))
    made = db.frames["supplier"].select("s_nationkey", F.lit(HOME + "supplier").alias("g"), F.explode(F.array(step(iri, inner), step(inner, last))).alias("q")).select("s_nationkey", "g", "q.*")
    quad = made.select("g", "s", "p", "o_kind", "o", F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    gone = made.filter("s_nationkey = 3 and s not like '%part'").select("s")
    left = things.delete_with_children(quad, gone, [NS + "holds"])
    return left.filter(~F.endswith("s", F.lit("-part"))).select("s")


# ---- validation, federation, search, notifications


@query("SELECT event_id, 'props' AS path, CASE WHEN event_id % 3 = 0 THEN 'datatype' ELSE 'nodeKind' END AS constraint FROM events WHERE event_id % 3 < 2 UNION ALL SELECT event_id, 'tags', 'maxCount' FROM events WHERE event_type = 'click'")
def validate_kinds(db):
    """Words where integers or IRIs belong, and too many values."""
    rows = db.frames["events"].select("event_id", F.when(F.expr("event_id % 3 = 0"), "word").otherwise(F.lit("12")).alias("n"), F.when(F.expr("event_id % 3 = 1"), "word").otherwise("http://a.example/b").alias("link"), F.when(F.col("event_type") == "click", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("tags"))
    shape = validation.Shape(EVENTS.type_iri, (validation.Constraint("n", datatype=quads.XSD + "integer"), validation.Constraint("link", node_kind="IRI"), validation.Constraint("tags", max_count=1)))
    found = validation.violations(rows, shape, "event_id")
    return found.select("event_id", F.when(F.col("path").isin("n", "link"), "props").otherwise(F.col("path")).alias("path"), "constraint")


@query("SELECT n_nationkey::bigint AS number, 'n_regionkey' AS column, 'is no integer' AS problem FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey, 'n_name', 'must have a value' FROM nation WHERE n_regionkey = 2")
def validate_insert_rows(db):
    from dataclasses import replace

    strict = replace(NATION, columns={**NATION.columns, "n_name": NATION.columns["n_name"].not_null()})
    rows = db.frames["nation"].select("n_nationkey", F.when(F.col("n_regionkey") != 2, F.col("n_name")).alias("n_name"), F.when(F.col("n_regionkey") == 1, "one").otherwise(F.col("n_regionkey").cast("string")).alias("n_regionkey"))
    found = validation.row_problems(strict, rows)
    return found.select(F.get_json_object("row", "$.n_nationkey").cast("long").alias("number"), "column", "problem")


@query("SELECT 'http://data.example/nation#' || n_nationkey AS s, n_name AS name FROM nation")
def read_turtle(db):
    """A Turtle file of the nations, written and read back."""
    return _documents(db, "turtle", lambda iri, name: F.concat(F.lit("<"), iri, F.lit("> v:n_name \""), name, F.lit("\" .")), f"@prefix v: <{NS}> .\n")


@query("SELECT 'http://data.example/nation#' || n_nationkey AS s, n_name AS name FROM nation")
def read_ntriples(db):
    from quadrel.sources import rdf

    at = layout.scratch(db.spark, "ntriples")
    frame = db.frame(NATION)
    frame.select(F.concat(F.lit("<"), F.col("_iri"), F.lit(f"> <{NS}n_name> \""), F.col("n_name"), F.lit("\" ."))).write.text(at)
    return rdf.read_ntriples(db.spark, at).select("s", F.col("o").alias("name"))


def _documents(db: Database, format: str, line: Callable, head: str) -> DataFrame:
    from quadrel.sources import rdf

    at = layout.scratch(db.spark, format)
    frame = db.frame(NATION)
    frame.agg(F.concat(F.lit(head), F.array_join(F.collect_list(line(F.col("_iri"), F.col("n_name"))), "\n"))).coalesce(1).write.text(at)  # one document of 25 rows
    return rdf.read_documents(db.spark, at + "/*.txt", format).select("s", F.col("o").alias("name"))


@query("SELECT p_brand AS rdf_class, p_type AS container, string_agg(DISTINCT (p_size % 3)::varchar, ',' ORDER BY (p_size % 3)::varchar) AS shapes, min(1 + p_size % 2) AS rank FROM part WHERE p_brand = 'Brand#3' AND p_size > 10 GROUP BY p_brand, p_type")
def discover_class(db):
    from quadrel.operators.discovery import Discovery

    places = db.frames["part"].select(F.col("p_brand").alias("rdf_class"), F.col("p_type").alias("container"), (F.col("p_size") % 3).cast("string").alias("shape"), F.when(F.col("p_size") > 10, "big").otherwise("small").alias("app"), (1 + F.col("p_size") % 2).alias("rank"))
    return Discovery(places).discover("Brand#3", app="big").withColumn("shapes", F.array_join("shapes", ","))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def rel_link_keys(db):
    """Orders name their customer by IRI, by fragment or by bare id; all three meet the customer's key."""
    people = table("people", {"id": key()}, NS + "Person", namespace=NS, base=HOME + "people", template="#{id}")
    bought = table("bought", {"id": key(), "buyer": column("uri").link(people)}, NS + "Order", namespace=NS, base=HOME + "bought", template="#{id}")
    number = F.col("o_custkey").cast("string")
    buyer = F.when(F.expr("o_orderkey % 3 = 0"), F.concat(F.lit(HOME + "people#"), number)).when(F.expr("o_orderkey % 3 = 1"), F.concat(F.lit("#"), number)).otherwise(number)
    db.bind(people, db.frames["customer"].select(F.col("c_custkey").cast("string").alias("id"))).bind(bought, db.frames["orders"].select(F.col("o_orderkey").cast("string").alias("id"), buyer.alias("buyer")))
    db.relate(people, orders=many(bought, ("id",), ("buyer",)))
    return db.query(people).find_many(with_=["orders"]).select(F.col("id").cast("long").alias("c_custkey"), F.size("orders").cast("long").alias("n"))


@query("SELECT c_custkey, 'c_name' AS path, 'pattern' AS constraint FROM customer WHERE NOT regexp_matches(c_name, '[0-8]$') UNION ALL SELECT c_custkey, 'c_mktsegment', 'minCount' FROM customer WHERE c_acctbal < 0")
def validate_shape(db):
    shape = validation.Shape(CUSTOMER.type_iri, (validation.Constraint("c_name", 1, 1, pattern="[0-8]$"), validation.Constraint("c_mktsegment", min_count=1), validation.Constraint("c_acctbal", datatype=quads.XSD + "double")))
    rows = db.frames["customer"].withColumn("c_mktsegment", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))
    return validation.violations(rows, shape, "c_custkey").select("c_custkey", "path", "constraint")


@query("SELECT source, event_id, value FROM (SELECT 'part' || (event_id % 4) AS source, event_id, value FROM events) ORDER BY value DESC, event_id LIMIT 40")
def federated_union(db):
    parts = {f"part{k}": db.frames["events"].filter(F.col("event_id") % 4 == k) for k in range(4)}
    return federation.union_sources(parts).orderBy(F.desc("value"), "event_id").limit(40).select("source", "event_id", "value")


def _remote(db: Database) -> tuple[DataFrame, DataFrame]:
    rows = db.frames["events"].select(F.concat(F.lit("part"), (F.col("event_id") % 4).cast("string")).alias("place"), "event_id", "user_id")
    sources = db.spark.range(4).select(F.concat(F.lit("part"), F.col("id").cast("string")).alias("place"), (F.col("id") < 3).alias("ok"), F.when(F.col("id") == 3, "403 forbidden").alias("message"))
    places = lambda: F.array(F.concat(F.lit("part"), (F.col("c_custkey") % 4).cast("string")), F.when(F.col("c_custkey") % 10 == 0, "part9").otherwise("part0"))
    return federation.remote_rows(db.frames["customer"], "c_custkey", places, sources, rows, "user_id")


@query("SELECT c_custkey, event_id FROM customer JOIN events ON user_id = c_custkey WHERE event_id % 4 <> 3 AND (event_id % 4 = c_custkey % 4 OR (event_id % 4 = 0 AND c_custkey % 10 <> 0))")
def federated_relation(db):
    return _remote(db)[0].select("c_custkey", F.col("row.event_id").alias("event_id"))


@query("SELECT c_custkey, 'part3' AS place, 'FORBIDDEN' AS code FROM customer WHERE c_custkey % 4 = 3 UNION ALL SELECT c_custkey, 'part9', 'NOT_FOUND' FROM customer WHERE c_custkey % 10 = 0")
def federated_errors(db):
    return _remote(db)[1].select("c_custkey", "place", "code")


@query("SELECT p_brand AS rdf_class, p_type AS container, string_agg(DISTINCT (p_size % 3)::varchar, ',' ORDER BY (p_size % 3)::varchar) AS shapes FROM part GROUP BY p_brand, p_type")
def discover_merge(db):
    places = db.frames["part"].select(F.col("p_brand").alias("rdf_class"), F.col("p_type").alias("container"), (F.col("p_size") % 3).cast("string").alias("shape"), "p_partkey")
    found = federation.discover_places([(1, places.filter("p_partkey % 2 = 0")), (2, places.filter("p_partkey % 3 <> 1")), (3, places)])
    return found.select("rdf_class", "container", F.array_join("shapes", ",").alias("shapes"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%bolt%' OR p_type ILIKE '%bolt%' ORDER BY p_name, p_partkey LIMIT 25")
def search_repository(db):
    repository = mutations.Repository(db, PART, ("p_name", "p_type"), (asc("p_name"), asc("p_partkey")))
    return repository.list(search="bolt", limit=25).select("p_partkey", "p_name")


@query("SELECT event_type AS type, count(*) AS n FROM events GROUP BY event_type")
def stream_notify(db):
    """The events as a file stream, run until nothing is left, into a table in the shared folder."""
    return _notified(db, {"*": None})


@query("SELECT event_type AS type, count(*) AS n FROM events WHERE event_id % 5 IN (1, 2) GROUP BY event_type")
def stream_notify_kinds(db):
    """Updates and deletions alone, each to its own handler."""
    return _notified(db, {"Update": None, "Delete": None})


def _notified(db: Database, kinds_wanted: dict) -> DataFrame:
    from quadrel.streaming import notify

    at = layout.scratch(db.spark, "notify")
    kinds = F.element_at(F.array(*map(F.lit, notify.KINDS)), (F.col("event_id") % 5 + 1).cast("int"))
    rows = db.frames["events"].select(F.col("event_id").cast("string").alias("id"), kinds.alias("type"), F.concat(F.lit(EVENTS.base + "#"), "event_id").alias("object"), F.col("ts").cast("timestamp").alias("published"), F.col("event_type").alias("state"))
    rows.write.parquet(f"{at}/in")
    started = notify.subscribe(notify.events(db.spark, f"{at}/in"), f"{at}/checkpoint", {k: lambda found: found.write.mode("append").parquet(f"{at}/out") for k in kinds_wanted}, EVENTS, once=True, late="4000 days")
    started.awaitTermination()
    return db.spark.read.parquet(f"{at}/out").groupBy(F.col("state").alias("type")).agg(F.count("*").alias("n"))


