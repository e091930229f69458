"""Batch documents and JSON boundaries."""

from pyspark.sql import functions as F

from ..operators import batch
from ..sources import documents as strict
from . import query, table


@query("batch_expand", """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS item_index, CASE WHEN turn % 3 = 0 THEN 'batch' ELSE role END AS role, text FROM conversations""")
def batch_expand(spark, d):
    c = table(spark, d, "conversations")
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    rows = rows.select("conv_id", F.lit("batch").alias("role"), F.transform("turns", lambda x: F.when(x["turn"] % 3 == 0, F.create_map(F.lit("text"), x["text"])).otherwise(F.create_map(F.lit("role"), x["role"], F.lit("text"), x["text"]))).alias("items"))
    out = batch.expand(rows, "items", ["role"])
    return out.select("conv_id", F.col("item_index").cast("long").alias("item_index"), F.col("item")["role"].alias("role"), F.col("item")["text"].alias("text"))


@query("batch_lift", "SELECT conv_id, CASE WHEN min(role) = max(role) THEN min(role) END AS role FROM conversations GROUP BY 1")
def batch_lift(spark, d):
    return batch.lifted(table(spark, d, "conversations"), ["conv_id"], "role")


@query("batch_collapse", """
WITH g AS (SELECT conv_id, CASE WHEN min(role) = max(role) THEN min(role) END AS role FROM conversations GROUP BY 1)
SELECT conv_id, any_value(g.role) AS role, count(*)::INTEGER AS items, count(CASE WHEN c.role IS DISTINCT FROM g.role THEN c.role END)::INTEGER AS own_roles FROM conversations c JOIN g USING (conv_id) GROUP BY 1""")
def batch_collapse(spark, d):
    made = batch.collapse(table(spark, d, "conversations"), ["conv_id"], "turn", ["role"], ["text"])
    return made.select("conv_id", "role", F.size("items").alias("items"), F.size(F.filter("items", lambda x: x["role"].isNotNull())).alias("own_roles"))


@query("json_boundary", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_boundary(spark, d):
    return strict.strict(table(spark, d, "events").select("event_id", "props"), "props", "k long").select("event_id", F.col("document.k").alias("k"))


@query("unknown_keys", "SELECT event_id, 'z' AS unknown FROM events WHERE event_id % 10 = 0")
def unknown_keys(spark, d):
    props = F.when(F.col("event_id") % 10 == 0, F.regexp_replace("props", r"\}$", ', "z": 1}')).otherwise(F.col("props"))
    rows = strict.unknown_keys(table(spark, d, "events").select("event_id", props.alias("props")), "props", ["k"])
    return rows.select("event_id", F.array_join("unknown", ",").alias("unknown"))


@query("yaml_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def yaml_round_trip(spark, d):
    nation = table(spark, d, "nation")
    text = strict.encode_yaml(nation.select(F.to_json(F.struct("*")).alias("doc")), "doc").select("yaml")
    back = strict.strict(strict.decode_yaml(text, "yaml"), "json", "n_nationkey int not null, n_name string not null, n_regionkey int not null")
    return back.select("document.*")
