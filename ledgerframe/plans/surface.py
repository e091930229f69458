"""Plain SQL over family views: the same text runs in both engines."""

from ..charter import Charter, Column, Registry
from . import query, table

SQL = {
    "sql_window_rank": "SELECT o_custkey, o_orderkey, rk FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) t WHERE rk <= 3",
    "sql_set_ops": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1",
    "sql_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "sql_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)",
    "sql_having": "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY l_suppkey HAVING count(*) > 100",
    "sql_join_order": "SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' GROUP BY n_name",
    "sql_cte": "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT max(n) AS m FROM big) SELECT o_custkey, n FROM big, top WHERE n >= m - 2",
    "sql_left_join": "SELECT s_suppkey, count(l_orderkey) AS n FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey AND l_quantity > 49 GROUP BY s_suppkey",
}
VIEWS = ("nation", "customer", "supplier", "orders", "lineitem")


def _registry() -> Registry:
    return Registry(
        Charter("nation", "n_nationkey", "2026.01.01", (Column("n_nationkey", int), Column("n_name", str), Column("n_regionkey", int))),
        Charter("customer", "c_custkey", "2026.01.01", (Column("c_custkey", int), Column("c_nationkey", int, foreign_key="nation"), Column("c_acctbal", float))),
        Charter("supplier", "s_suppkey", "2026.01.01", (Column("s_suppkey", int), Column("s_name", str), Column("s_nationkey", int, foreign_key="nation"))),
        Charter("orders", "o_orderkey", "2026.01.01", (Column("o_orderkey", int), Column("o_custkey", int, foreign_key="customer"), Column("o_totalprice", float))),
    )


def _run(text: str):
    def run(spark, d):
        session = spark.newSession()  # its own views: queries cannot disturb each other
        _registry().register_views(session, d)
        session.read.parquet(f"{d}/lineitem.parquet").createOrReplaceTempView("lineitem")
        return session.sql(text)

    return run


for _name, _text in SQL.items():
    query(_name, _text.replace("c_nationkey AS k FROM", "c_nationkey::BIGINT AS k FROM"))(_run(_text))


@query("json_agg", "SELECT user_id, event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY 1, 2")
def json_agg(spark, d):
    table(spark, d, "events").createOrReplaceTempView("ledgerframe_events")
    return spark.sql("SELECT user_id, event_type, sum(cast(get_json_object(props, '$.k') AS bigint)) AS k, listagg(cast(event_id AS string), ',') WITHIN GROUP (ORDER BY event_id) AS ids FROM ledgerframe_events GROUP BY user_id, event_type")
