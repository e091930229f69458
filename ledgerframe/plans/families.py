"""Digests, codecs, references, foreign keys, contracts, lifecycle and graph."""

from pyspark.sql import functions as F

from ..charter import Charter, Column, Registry
from ..functions import canonical, refcodec
from ..operators import contracts, graph, lifecycle, placement, references
from . import query, table


@query("version_id", """
SELECT n_nationkey, 'sha256:' || sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS version_id FROM nation""")
def version_id(spark, d):
    nation = table(spark, d, "nation")
    return nation.select("n_nationkey", canonical.version_id(nation, nation.columns).alias("version_id"))


@query("blob_dedupe", "SELECT sha256(text) AS oid, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def blob_dedupe(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("oid")).agg(F.count(F.lit(1)).alias("copies"))


@query("git_blob_oid", "SELECT p_partkey, sha1(encode('blob ' || octet_length(encode(p_name))) || '\\x00'::BLOB || encode(p_name)) AS oid FROM part")
def git_blob_oid(spark, d):
    return table(spark, d, "part").select("p_partkey", canonical.blob_oid(F.col("p_name")).alias("oid"))


@query("hash_scatter", """
SELECT c_custkey, 'customers/' || substr(sha256(c_name), 1, 2) || '/' || substr(sha256(c_name), 3, 2) || '/' || c_name || '.yaml' AS path, c_name AS ref FROM customer""")
def hash_scatter(spark, d):
    p = placement.HashScattered("customers", depth=2)
    rows = table(spark, d, "customer").select("c_custkey", p.path(F.col("c_name")).alias("path"))
    return rows.select("c_custkey", "path", p.ref(F.col("path")).alias("ref"))


@query("fanout_histogram", "SELECT substr(sha256(o_orderkey::VARCHAR), 1, 2) AS bucket, count(*) AS n FROM orders GROUP BY 1")
def fanout_histogram(spark, d):
    return table(spark, d, "orders").groupBy(refcodec.fanout(F.col("o_orderkey").cast("string")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("base64url", "SELECT page_id, rtrim(replace(replace(to_base64(encode(url)), '+', '-'), '/', '_'), '=') AS code, url AS back FROM pages")
def base64url(spark, d):
    rows = table(spark, d, "pages").select("page_id", refcodec.base64url(F.col("url")).alias("code"))
    return rows.select("page_id", "code", refcodec.from_base64url(F.col("code")).alias("back"))


@query("slug", """
SELECT p_partkey, nullif(regexp_replace(regexp_replace(lower(trim(p_name || ' #' || p_brand)), '[^A-Za-z0-9_-]+', '_', 'g'), '^[_-]+|[_-]+$', '', 'g'), '') AS slug FROM part""")
def slug(spark, d):
    return table(spark, d, "part").select("p_partkey", refcodec.slug(F.concat("p_name", F.lit(" #"), "p_brand")).alias("slug"))


@query("safe_slug", """
SELECT page_id, nullif(regexp_replace(regexp_replace(' -' || url || '-. ', '[^\\p{L}\\p{N}_.\\-]', '_', 'g'), '^[._\\-]+|[._\\-]+$', '', 'g'), '') AS slug FROM pages""")
def safe_slug(spark, d):
    return table(spark, d, "pages").select("page_id", refcodec.safe_slug(F.concat(F.lit(" -"), "url", F.lit("-. "))).alias("slug"))


@query("nested_path_refs", "SELECT doc_id, 'docs/' || lang || '/' || doc_id || '.yaml' AS path, lang || '/' || doc_id AS ref FROM documents")
def nested_path_refs(spark, d):
    p = placement.NestedFlat("docs")
    rows = table(spark, d, "documents").select("doc_id", p.path(F.concat_ws("/", "lang", F.col("doc_id").cast("string"))).alias("path"))
    return rows.select("doc_id", "path", p.ref(F.col("path")).alias("ref"))


PART_KEYS = "SELECT p_partkey::VARCHAR AS key, p_partkey AS id FROM part UNION SELECT p_name, p_partkey FROM part"


@query("reference_lookup", f"SELECT key, count(*)::INTEGER AS n, min(id) AS least FROM ({PART_KEYS}) GROUP BY key")
def reference_lookup(spark, d):
    return references.lookup(table(spark, d, "part"), "p_partkey", ["p_name"]).select("key", "n", F.col("id").alias("least"))


@query("ambiguous_refs", f"SELECT key, count(*) AS n FROM ({PART_KEYS}) GROUP BY key HAVING count(*) > 1")
def ambiguous_refs(spark, d):
    return references.ambiguous(table(spark, d, "part"), "p_partkey", ["p_name"])


@query("resolve_status", f"""
WITH i AS (SELECT key, count(*) AS n, min(id) AS id FROM ({PART_KEYS}) GROUP BY key),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 5 = 0 THEN 'missing ' || l_partkey WHEN l_partkey % 11 = 0 THEN '' WHEN l_partkey % 3 = 0 THEN p_name ELSE l_partkey::VARCHAR END AS ref
      FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT CASE WHEN ref = '' THEN 'empty' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status, count(*) AS n, count(CASE WHEN n = 1 THEN id END) AS resolved
FROM r LEFT JOIN i ON r.ref = i.key GROUP BY 1""")
def resolve_status(spark, d):
    part = table(spark, d, "part")
    ref = F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("missing "), F.col("l_partkey").cast("string"))).when(F.col("l_partkey") % 11 == 0, "").when(F.col("l_partkey") % 3 == 0, F.col("p_name")).otherwise(F.col("l_partkey").cast("string"))
    refs = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(ref.alias("ref"))
    found = references.resolve(refs, "ref", references.lookup(part, "p_partkey", ["p_name"]))
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("resolved"))


@query("fk_dangling", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def fk_dangling(spark, d):
    customers = table(spark, d, "customer").where("c_custkey % 7 <> 0")
    return references.dangling(table(spark, d, "orders"), "o_custkey", customers, "c_custkey").select("o_orderkey", "o_custkey")


@query("fk_reasons", """
WITH r AS (SELECT l_orderkey, list_distinct(list(CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_partkey END)) AS v FROM lineitem GROUP BY 1),
e AS (SELECT l_orderkey, unnest(v) AS value FROM r)
SELECT reason, count(*) AS n FROM (
  SELECT l_orderkey, 'required' AS reason FROM r WHERE len(v) = 0
  UNION ALL SELECT l_orderkey, 'cardinality' FROM r WHERE len(v) > 1
  UNION ALL SELECT l_orderkey, 'dangling' FROM e WHERE value NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0)
) GROUP BY reason""")
def fk_reasons(spark, d):
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_partkey") % 4 != 0, F.col("l_partkey"))).alias("parts"))
    index = references.lookup(table(spark, d, "part").where("p_partkey % 7 <> 0"), "p_partkey", [])
    found = references.violations(orders, "l_orderkey", references.ForeignKey("orders", "parts[]", "part"), index)
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("fk_post_state", """
WITH c AS (SELECT c_custkey FROM customer WHERE c_custkey % 13 <> 0 UNION SELECT c_custkey + 10000000 FROM customer WHERE c_custkey % 5 = 0)
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM c)""")
def fk_post_state(spark, d):
    customer = table(spark, d, "customer").select("c_custkey")
    saves = customer.where("c_custkey % 5 = 0").select((F.col("c_custkey") + 10_000_000).alias("c_custkey"))
    state = references.post_state(customer, "c_custkey", saves, customer.where("c_custkey % 13 = 0"))
    return references.dangling(table(spark, d, "orders"), "o_custkey", state, "c_custkey").select("o_orderkey", "o_custkey")


@query("registry_validate", """
SELECT 'nation' AS source, 'n_regionkey' AS field, n_nationkey::VARCHAR AS id, n_regionkey::VARCHAR AS value, 'dangling' AS reason FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey <> 2)
UNION ALL SELECT 'customer', 'c_nationkey', c_custkey::VARCHAR, c_nationkey::VARCHAR, 'dangling' FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)""")
def registry_validate(spark, d):
    registry = Registry(
        Charter("region", "r_regionkey", "2026.01.01", (Column("r_regionkey", int), Column("r_name", str, alias_key=True))),
        Charter("nation", "n_nationkey", "2026.01.01", (Column("n_nationkey", int), Column("n_name", str), Column("n_regionkey", int, foreign_key="region"))),
        Charter("customer", "c_custkey", "2026.01.01", (Column("c_custkey", int), Column("c_name", str), Column("c_nationkey", int, foreign_key="nation"))),
    )
    tables = {n: registry.read(spark, d, n) for n in registry.charters}
    return registry.validate(tables | {"region": tables["region"].where("r_regionkey <> 2")})


@query("cross_family_resolve", """
WITH i AS (SELECT 'customer' AS family, c_name AS key, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_name, s_suppkey FROM supplier),
r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'customer' ELSE 'supplier' END AS family, c_name AS ref FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT r.family, CASE WHEN i.id IS NULL THEN 'missing' ELSE 'ok' END AS status, count(*) AS n FROM r LEFT JOIN i ON r.family = i.family AND r.ref = i.key GROUP BY 1, 2""")
def cross_family_resolve(spark, d):
    customer = table(spark, d, "customer")
    index = references.lookup(customer, "c_custkey", ["c_name"], "customer").unionByName(references.lookup(table(spark, d, "supplier").withColumn("s_suppkey", F.col("s_suppkey").cast("long")), "s_suppkey", ["s_name"], "supplier"))
    refs = table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.when(F.col("o_orderkey") % 2 == 0, "customer").otherwise("supplier").alias("family"), F.col("c_name").alias("ref"))
    return references.resolve(refs, "ref", index, "family").groupBy("family", "status").agg(F.count(F.lit(1)).alias("n"))


@query("fk_rewrite", """
SELECT CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey + 1000000 ELSE l_suppkey END AS l_suppkey, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM lineitem GROUP BY 1""")
def fk_rewrite(spark, d):
    images = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") + 1_000_000).alias("target"))
    rows = references.rewrite(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), "l_suppkey", images)
    return rows.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query("image_conflicts", "SELECT l_orderkey AS source FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def image_conflicts(spark, d):
    return references.image_conflicts(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_suppkey").alias("target")))


@query("relationship_ordered", """
SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def relationship_ordered(spark, d):
    rows = references.children_of(table(spark, d, "customer").select("c_custkey"), "c_custkey", table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey")
    return rows.select("c_custkey", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("orders"))


@query("transport_levels", """
WITH RECURSIVE l AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey = 0 THEN NULL WHEN n_nationkey IN (20, 21) THEN 41 - n_nationkey ELSE n_nationkey // 2 END AS ref FROM nation),
w AS (SELECT id, 0 AS level FROM l WHERE ref IS NULL UNION ALL SELECT l.id, w.level + 1 FROM l JOIN w ON l.ref = w.id)
SELECT l.id, coalesce(w.level, -1) AS level FROM l LEFT JOIN w ON l.id = w.id""")
def transport_levels(spark, d):
    ref = F.when(F.col("n_nationkey") == 0, None).when(F.col("n_nationkey").isin(20, 21), 41 - F.col("n_nationkey")).otherwise(F.expr("n_nationkey div 2").cast("int"))
    return references.transport_order(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), ref.alias("ref")))


@query("quarantine", """
SELECT o_custkey % 7 <> 0 AS valid, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1""")
def quarantine(spark, d):
    good, bad = references.quarantine(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, d, "customer").where("c_custkey % 7 <> 0"), "c_custkey")
    rows = good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))
    return rows.groupBy("valid").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("contract_check", """
WITH o AS (SELECT * FROM (VALUES ('table:nation', 1, 'a'), ('table:region', 1, 'a'), ('table:customer', 1, 'a'), ('table:orders', 1, 'a'), ('table:part', 1, 'a'), ('table:lineitem', 1, 'a')) t(key, version, body)),
n AS (SELECT * FROM (VALUES ('table:nation', 1, 'a', false), ('table:customer', 2, 'b', false), ('table:orders', 1, 'b', true), ('table:part', 1, 'b', false), ('table:supplier', 1, 'a', false), ('table:lineitem', 2, 'a', false)) t(key, version, body, marked))
SELECT key, CASE WHEN o.version IS NULL THEN 'added' WHEN n.version IS NULL THEN 'removed' WHEN o.version = n.version AND o.body = n.body THEN 'unchanged'
WHEN o.version <> n.version THEN 'bumped' WHEN n.marked THEN 'compatible' ELSE 'failed' END AS status FROM o FULL JOIN n USING (key)""")
def contract_check(spark, d):
    def body(name):
        return [[f.name, f.dataType.simpleString()] for f in table(spark, d, name).schema.fields]

    def entry(name, version="2026.01.01", extra=(), mark=False):
        return contracts.Entry("table", name, version, [*body(name), *extra], mark)

    old = [entry(n) for n in ("nation", "region", "customer", "orders", "part", "lineitem")]
    more = [["added", "string"]]
    new = [entry("nation"), entry("customer", "2026.02.01", more), entry("orders", extra=more, mark=True), entry("part", extra=more), entry("supplier"), entry("lineitem", "2026.02.01")]
    return contracts.compare(contracts.manifest(spark, old), contracts.manifest(spark, new))


@query("lifecycle_batch", """
WITH t AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F'), p(policy, hit) AS (VALUES ('FAIL', 'conflict'), ('SKIP', 'skipped'), ('REPLACE', 'replaced'), ('MERGE', 'merged'))
SELECT policy, CASE WHEN o.o_orderstatus <> 'O' THEN 'wrong_state' WHEN o.o_totalprice <= 100000 THEN 'guard_failed' WHEN t.o_orderkey IS NOT NULL THEN hit ELSE 'written' END AS outcome, count(*) AS n
FROM orders o LEFT JOIN t ON o.o_orderkey // 2 = t.o_orderkey, p GROUP BY 1, 2""")
def lifecycle_batch(spark, d):
    orders = table(spark, d, "orders")
    steps = tuple(lifecycle.Transition(f"fulfil_{p.lower()}", "O", "F", p, guard=F.col("o_totalprice") > 100000, identity=F.expr("o_orderkey div 2")) for p in lifecycle.POLICIES)
    machine = lifecycle.Lifecycle(("P", "O", "F"), ("F",), steps)
    existing, out = orders.where("o_orderstatus = 'F'").select("o_orderkey"), None
    for step in machine.transitions:
        rows = lifecycle.run_batch(orders, "o_orderkey", "o_orderstatus", step, existing).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).select(F.lit(step.policy).alias("policy"), "outcome", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("lifecycle_state_fields", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def lifecycle_state_fields(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return lifecycle.state_projection(rows, "o_orderstatus", "F", {"o_orderpriority": ("O", "P"), "o_orderstatus": ()})


@query("graph_nodes", "SELECT 'supplier' AS family, s_suppkey::VARCHAR AS id, coalesce(CASE WHEN s_suppkey % 4 <> 0 THEN s_name END, s_suppkey::VARCHAR) AS label, s_nationkey::VARCHAR AS nation, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 2 END AS n_metadata FROM supplier")
def graph_nodes(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).alias("label"), F.col("s_nationkey").alias("nation"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("also"))
    made = graph.nodes(rows, "supplier", "s_suppkey", "label", ["nation", "also"])
    return made.select("family", "id", "label", F.col("metadata")["nation"].alias("nation"), F.size("metadata").alias("n_metadata"))


@query("graph_edges", """
SELECT 'nation' AS source_family, 'in' AS kind, 'region' AS target_family, count(*) AS n, count(DISTINCT n_regionkey) AS targets FROM nation
UNION ALL SELECT 'orders', 'by', 'customer', count(*), count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'lineitem', 'of', 'part', count(*), count(DISTINCT l_partkey) FROM lineitem""")
def graph_edges(spark, d):
    parts = [graph.edges(table(spark, d, t), t, k, [graph.Edge(kind, f, to)]) for t, k, kind, f, to in (("nation", "n_nationkey", "in", "n_regionkey", "region"), ("orders", "o_orderkey", "by", "o_custkey", "customer"), ("lineitem", "l_orderkey", "of", "l_partkey", "part"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source_family", "kind", "target_family").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target").alias("targets"))


@query("hyperedge", "SELECT l_orderkey::VARCHAR AS id, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS sources, o_custkey::VARCHAR AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, o_custkey")
def hyperedge(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "o_custkey").agg(F.sort_array(F.collect_set(F.col("l_partkey").cast("string"))).alias("parts"))
    return graph.hyperedges(rows, "order", "l_orderkey", "parts", "o_custkey").select("id", F.array_join("sources", ",").alias("sources"), "target")


@query("polymorphic_view", "SELECT event_id, user_id, value FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def polymorphic_view(spark, d):
    events = table(spark, d, "events")
    return graph.polymorphic(events, "event_type", events.agg(F.min("event_type")).first()[0], ["event_id", "user_id", "value"])


@query("fk_rewrite_nested", """
WITH i AS (SELECT o_orderkey, 'c' || o_custkey AS c, ['c' || (o_custkey + 1), 'p' || o_orderkey] AS m FROM orders)
SELECT o_orderkey, CASE WHEN substr(c, 2)::BIGINT % 3 = 0 THEN c || 'x' ELSE c END AS head, CASE WHEN substr(m[1], 2)::BIGINT % 3 = 0 THEN m[1] || 'x' ELSE m[1] END AS first, m[2] AS second FROM i""")
def fk_rewrite_nested(spark, d):
    c = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    member = F.array(F.struct(F.concat(F.lit("c"), (F.col("o_custkey") + 1).cast("string")).alias("ref")), F.struct(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("ref")))
    rows = table(spark, d, "orders").select("o_orderkey", F.struct(c.alias("ref"), member.alias("members")).alias("body"))
    keys = table(spark, d, "orders").select("o_custkey").unionByName(table(spark, d, "orders").select((F.col("o_custkey") + 1).alias("o_custkey"))).distinct().where("o_custkey % 3 = 0")
    images = keys.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("x")).alias("target"))
    made = references.rewrite_paths(rows, "o_orderkey", {"body.ref": images, "body.members[].ref": images})
    return made.select("o_orderkey", F.col("body.ref").alias("head"), F.col("body.members")[0]["ref"].alias("first"), F.col("body.members")[1]["ref"].alias("second"))


@query("transport_family", """
WITH r AS (SELECT n_nationkey AS k, n_regionkey AS g, CASE WHEN n_nationkey = 0 THEN 24 ELSE n_nationkey // 2 END AS up FROM nation),
n AS (SELECT k, up, CASE WHEN g = 1 THEN 'r1x' ELSE 'r' || g END AS region FROM r), x AS (SELECT k, up, region, region || ':' || k AS id FROM n)
SELECT x.id, x.region, y.id AS parent FROM x JOIN x y ON y.k = x.up""")
def transport_family(spark, d):
    """A family whose own references make a cycle; the records of one region move, and their referrers follow."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.when(F.col("n_nationkey") == 0, 24).otherwise(F.expr("n_nationkey div 2")).alias("up"))
    region = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    named = rows.select(F.concat(region, F.lit(":"), F.col("n_nationkey").cast("string")).alias("id"), region.alias("region"), "up", F.col("n_nationkey").alias("k"))
    named = named.join(named.select(F.col("k").alias("up"), F.col("id").alias("parent")), "up").select("id", "region", "parent", "k")
    images = spark.createDataFrame([("r1", "r1x")], "source string, target string")
    made, _ = references.transport_family(named, "id", {"region": images}, ["parent"], lambda df: F.concat("region", F.lit(":"), F.col("k").cast("string")))
    return made.select("id", "region", "parent")


@query("graph_dependencies", """
SELECT 'order:' || o_orderkey AS source, 'customer:' || o_custkey AS target, 'o_custkey' AS field FROM orders""")
def graph_dependencies(spark, d):
    return graph.dependencies(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey")), "order", "o_orderkey", {"o_custkey": "customer"})
