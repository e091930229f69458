"""Snapshot algebra: manifests made from orders, and a commit graph made by rule."""

from pyspark.sql import functions as F

from ..operators import snapshot
from . import query, table

SIDES = """
WITH base AS (SELECT 'orders/' || o_orderkey AS path, o_orderstatus AS oid FROM orders WHERE o_orderkey % 7 <> 0),
lft AS (SELECT 'orders/' || o_orderkey AS path, CASE WHEN o_orderkey % 5 = 0 THEN 'L' || o_orderstatus ELSE o_orderstatus END AS oid FROM orders WHERE o_orderkey % 11 <> 0),
rgt AS (SELECT 'orders/' || o_orderkey AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'R' || o_orderstatus ELSE o_orderstatus END AS oid FROM orders)
"""
MERGED = SIDES + """, m AS (
  SELECT path, b.oid AS base, l.oid AS lft, r.oid AS rgt FROM base b FULL JOIN lft l USING (path) FULL JOIN rgt r USING (path)
), v AS (
  SELECT *, (lft IS DISTINCT FROM rgt AND rgt IS DISTINCT FROM base AND lft IS DISTINCT FROM base) AS conflict,
    CASE WHEN lft IS NOT DISTINCT FROM rgt OR rgt IS NOT DISTINCT FROM base THEN lft WHEN lft IS NOT DISTINCT FROM base THEN rgt END AS oid FROM m
)
"""


def sides(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderstatus").alias("oid"))
    base = o.where("k % 7 <> 0")
    left = o.where("k % 11 <> 0").withColumn("oid", F.expr("CASE WHEN k % 5 = 0 THEN concat('L', oid) ELSE oid END"))
    right = o.withColumn("oid", F.expr("CASE WHEN k % 3 = 0 THEN concat('R', oid) ELSE oid END"))
    return tuple(x.select("path", "oid") for x in (base, left, right))


@query("diff", SIDES + """
SELECT path, CASE WHEN b.oid IS NULL THEN 'added' WHEN l.oid IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM base b FULL JOIN lft l USING (path) WHERE b.oid IS DISTINCT FROM l.oid""")
def diff(spark, d):
    base, left, _ = sides(spark, d)
    return snapshot.diff(base, left)


@query("three_way_merge", MERGED + "SELECT path, oid FROM v WHERE NOT conflict AND oid IS NOT NULL")
def three_way_merge(spark, d):
    return snapshot.three_way(*sides(spark, d)).where("not conflict and oid is not null").select("path", "oid")


@query("merge_conflicts", MERGED + "SELECT path, base, lft AS left, rgt AS right FROM v WHERE conflict")
def merge_conflicts(spark, d):
    return snapshot.three_way(*sides(spark, d)).where("conflict").select("path", "base", "left", "right")


@query("apply_batch", SIDES + """
SELECT path, oid FROM (
  SELECT path, oid FROM base WHERE path NOT IN (SELECT path FROM lft WHERE oid LIKE 'L%') UNION ALL SELECT path, oid FROM lft WHERE oid LIKE 'L%'
) WHERE path NOT IN (SELECT path FROM rgt WHERE oid LIKE 'RF%')""")
def apply_batch(spark, d):
    base, left, right = sides(spark, d)
    return snapshot.apply_batch(base, left.where("oid like 'L%'"), right.where("oid like 'RF%'"))


@query("last_staged", """
SELECT c_custkey AS path, CASE WHEN o_orderkey % 4 = 0 THEN 'delete' ELSE 'add' END AS op, o_orderkey AS seq FROM (
  SELECT o_custkey AS c_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1)""")
def last_staged(spark, d):
    staged = table(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.expr("CASE WHEN o_orderkey % 4 = 0 THEN 'delete' ELSE 'add' END").alias("op"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("oid"))
    return snapshot.last_staged(staged).select("path", "op", "seq")


@query("prefix_conflicts", """
WITH f AS (SELECT 'a/' || c_nationkey || '/' || c_custkey AS path FROM customer), a AS (SELECT 'a/' || n_nationkey AS path FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'a/' || c_nationkey || '/' || c_custkey || '/x' FROM customer WHERE c_custkey % 10 = 0)
SELECT a.path, f.path AS "with" FROM a JOIN f ON starts_with(f.path, a.path || '/')
UNION SELECT a.path, b.path FROM a JOIN (SELECT path FROM f UNION SELECT path FROM a) b ON starts_with(a.path, b.path || '/')""")
def prefix_conflicts(spark, d):
    customer = table(spark, d, "customer")
    at = F.concat_ws("/", F.lit("a"), F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string"))
    head = customer.select(at.alias("path"))
    adds = table(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.concat(F.lit("a/"), F.col("n_nationkey").cast("string")).alias("path"))
    return snapshot.prefix_conflicts(head, adds.unionByName(customer.where("c_custkey % 10 = 0").select(F.concat(at, F.lit("/x")).alias("path"))))


@query("revert_check", SIDES + """
SELECT path, b.oid AS oid, r.oid IS DISTINCT FROM l.oid AS blocked FROM base b FULL JOIN lft l USING (path) LEFT JOIN rgt r USING (path) WHERE b.oid IS DISTINCT FROM l.oid""")
def revert_check(spark, d):
    base, left, right = sides(spark, d)
    return snapshot.revert(base, left, right)


@query("unreachable", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents m WHERE m.doc_id % 3 <> 0 AND m.text = d.text) AND d.text IS NOT NULL")
def unreachable(spark, d):
    objects = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("oid"))
    return snapshot.unreachable(objects, objects.where("doc_id % 3 <> 0").select("oid")).select("doc_id")


@query("list_dir", """
SELECT split_part(x, '/', 1) AS name, max(contains(x, '/')) AS is_dir FROM (SELECT p_brand || '/' || p_partkey AS x FROM part UNION ALL SELECT s_name FROM supplier) GROUP BY 1""")
def list_dir(spark, d):
    entries = table(spark, d, "part").select(F.concat(F.lit("root/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"))
    entries = entries.unionByName(table(spark, d, "supplier").select(F.concat(F.lit("root/"), "s_name").alias("path"))).withColumn("oid", F.lit(""))
    return snapshot.children(entries, "root")


@query("tree_errors", "SELECT p_name AS path FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def tree_errors(spark, d):
    return snapshot.tree_errors(table(spark, d, "part").select(F.concat(F.lit("/"), "p_name", F.lit("/")).alias("path"), F.col("p_brand").alias("oid")))


PARENTS = "WITH RECURSIVE p AS (SELECT o_orderkey AS id, unnest(CASE WHEN o_orderkey = 0 THEN []::BIGINT[] ELSE [o_orderkey // 2, o_orderkey // 3] END) AS parent FROM orders), "


def parents(spark, d):
    o = table(spark, d, "orders").where("o_orderkey > 0")
    return o.select(F.col("o_orderkey").alias("id"), F.explode(F.array(F.expr("o_orderkey div 2"), F.expr("o_orderkey div 3"))).alias("parent"))


@query("ancestors", PARENTS + """m AS (SELECT max(o_orderkey) AS id FROM orders),
a AS (SELECT id, 0 AS distance FROM m UNION SELECT p.parent, a.distance + 1 FROM a JOIN p ON a.id = p.id)
SELECT id, min(distance) AS distance FROM a GROUP BY id""")
def ancestors(spark, d):
    top = table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]
    return snapshot.ancestors(parents(spark, d), [top], "long").select("id", "distance")


@query("merge_bases", PARENTS + """
a AS (SELECT max(o_orderkey) AS id FROM orders UNION SELECT p.parent FROM a JOIN p ON a.id = p.id),
b AS (SELECT max(o_orderkey) - 7 AS id FROM orders UNION SELECT p.parent FROM b JOIN p ON b.id = p.id),
c AS (SELECT id FROM a INTERSECT SELECT id FROM b)
SELECT id FROM c WHERE id NOT IN (SELECT p.parent FROM c JOIN p ON c.id = p.id)""")
def merge_bases(spark, d):
    top = table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]
    return snapshot.merge_bases(parents(spark, d), top, top - 7, "long")


@query("log_topk", "SELECT o_orderkey AS sha, o_orderdate AS ts FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def log_topk(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("ts")).orderBy(F.col("ts").desc(), "sha").limit(50)
