"""Full text and vectors."""

from pyspark.sql import functions as F

from ..operators import derived, fts, vectors
from . import query, table

WORDS = f"""
WITH w AS (SELECT doc_id AS doc, list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), '{fts.ACCENTED}', '{fts.FOLDED}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM documents),
len AS (SELECT doc, len(t) AS len FROM w), p AS (SELECT doc, term, count(*) AS f FROM (SELECT doc, unnest(t) AS term FROM w) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS n FROM p GROUP BY 1), s AS (SELECT count(*) AS docs, avg(len) AS mean FROM len)
"""
RANK = """
, r AS (SELECT p.doc, p.term, greatest(ln((docs - n + 0.5) / (n + 0.5)), 0) AS idf0, f, len, mean FROM p JOIN df USING (term) JOIN len USING (doc), s),
q AS (SELECT doc, term, CASE WHEN idf0 > 0 THEN idf0 ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean)) AS x FROM r)
"""


def index(spark, d):
    return fts.build(table(spark, d, "documents").select("doc_id", "text"), "doc_id", ["text"], index_id=False)


@query("fts_df", WORDS + "SELECT term, n FROM df")
def fts_df(spark, d):
    return index(spark, d).terms


@query("fts_doclen", WORDS + "SELECT doc, len FROM len")
def fts_doclen(spark, d):
    return index(spark, d).lengths


@query("bm25_one_term", WORDS + RANK + "SELECT doc, round(-sum(x), 9) AS rank FROM q WHERE term = 'heron' OR term = 'worthless' GROUP BY 1 HAVING count(DISTINCT term) >= 1")
def bm25_one_term(spark, d):
    return fts.search(index(spark, d), [], [fts.Term("heron"), fts.Term("worthless")]).select("doc", F.round("rank", 9).alias("rank"))


@query("bm25_and", WORDS + RANK + "SELECT doc, round(-sum(x), 9) AS rank FROM q WHERE term IN ('the', 'and') GROUP BY 1 HAVING count(DISTINCT term) = 2")
def bm25_and(spark, d):
    return fts.search(index(spark, d), [fts.Term("the"), fts.Term("and")]).select("doc", F.round("rank", 9).alias("rank"))


@query("bm25_not", WORDS + RANK + "SELECT doc, round(-sum(x), 9) AS rank FROM q WHERE term = 'of' AND doc NOT IN (SELECT doc FROM p WHERE term = 'that') GROUP BY 1")
def bm25_not(spark, d):
    return fts.search(index(spark, d), [fts.Term("of")], none_of=[fts.Term("that")]).select("doc", F.round("rank", 9).alias("rank"))


@query("fts_prefix", WORDS + "SELECT DISTINCT doc FROM p WHERE starts_with(term, 'worth')")
def fts_prefix(spark, d):
    return fts.search(index(spark, d), [fts.Term("worth", prefix=True)]).select("doc")


@query("bm25_topk", WORDS + RANK + "SELECT doc, round(-sum(x), 9) AS rank FROM q WHERE term = 'the' GROUP BY 1 ORDER BY -sum(x), doc LIMIT 20")
def bm25_topk(spark, d):
    return fts.search(index(spark, d), [fts.Term("the")], limit=20).select("doc", F.round("rank", 9).alias("rank"))


def placed(spark, d):
    return fts.build(table(spark, d, "documents").select("doc_id", "text"), "doc_id", ["text"], index_id=False, positions=True)


@query("fts_phrase", WORDS + "SELECT doc, f FROM (SELECT doc, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS f FROM w) WHERE f > 0")
def fts_phrase(spark, d):
    return fts.occurrences(placed(spark, d), [fts.Phrase(("of", "the"))]).select("doc", F.size("starts").cast("bigint").alias("f"))


@query("fts_first", WORDS + "SELECT doc FROM w WHERE t[1] = 'the'")
def fts_first(spark, d):
    return fts.search(placed(spark, d), [fts.Phrase(("the",), first=True)]).select("doc")


@query("fts_near", WORDS + "SELECT doc FROM w WHERE len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'of' AND list_contains(t[greatest(1, i - 5):i + 5], 'that'))) > 0")
def fts_near(spark, d):
    return fts.search(placed(spark, d), [fts.Near((fts.Phrase(("of",)), fts.Phrase(("that",))), 4)]).select("doc")


@query("bm25_phrase", WORDS + """
, o AS (SELECT doc, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS f FROM w), h AS (SELECT doc, f FROM o WHERE f > 0), n AS (SELECT count(*) AS n FROM h),
i AS (SELECT ln((docs - n + 0.5) / (n + 0.5)) AS idf, mean FROM s, n)
SELECT doc, round(-(CASE WHEN idf > 0 THEN idf ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean)), 9) AS rank FROM h JOIN len USING (doc), i
WHERE doc NOT IN (SELECT doc FROM p WHERE term = 'heron')""")
def bm25_phrase(spark, d):
    return fts.search(placed(spark, d), [fts.Phrase(("of", "the"))], none_of=[fts.Term("heron")]).select("doc", F.round("rank", 9).alias("rank"))


@query("knn_joined", """
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
k AS (SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, e), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))), 9) AS distance FROM embeddings, q WHERE vec_id % 2 = 0 ORDER BY distance, vec_id LIMIT 25)
SELECT 'e' || vec_id AS id, vec_id AS seq, distance FROM k WHERE vec_id % 3 <> 0""")
def knn_joined(spark, d):
    """Nearest of one model's vectors, then only those whose entity is there under the same seq."""
    e = table(spark, d, "embeddings")
    model = F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd").alias("model")
    ident = F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("id")
    rows = e.select(model, F.col("vec_id").alias("seq"), F.col("embedding").alias("vector"))
    status = e.select(model, F.col("vec_id").alias("seq"), ident)
    source = e.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("seq"), ident)
    target = e.where("vec_id = 0").first()["embedding"]
    return vectors.nearest_entities(rows, target, 25, status, source, "even").select("id", "seq", F.round("distance", 9).alias("distance"))


@query("vec_point", "SELECT 'e' || vec_id AS id, embedding[1]::DOUBLE AS x FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 3 <> 0 AND label = 3")
def vec_point(spark, d):
    e = table(spark, d, "embeddings")
    model = F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd").alias("model")
    ident = F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("id")
    rows = e.select(model, F.col("vec_id").alias("seq"), F.col("embedding").alias("vector"))
    source = e.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("seq"), ident)
    found = vectors.point_lookup(rows, e.select(model, F.col("vec_id").alias("seq"), ident), source, "even", e.where("label = 3").select(ident))
    return found.select("id", F.col("vector")[0].cast("double").alias("x"))


@query("knn_l2", """
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id AS id, round(sqrt(list_sum(list_transform(list_zip(embedding, e), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))), 9) AS distance FROM embeddings, q ORDER BY distance, id LIMIT 10""")
def knn_l2(spark, d):
    rows = vectors.checked(table(spark, d, "embeddings"), "embedding", 64)
    target = rows.where("vec_id = 0").first()["embedding"]
    return vectors.nearest(rows, "vec_id", "embedding", target, 10).select("id", F.round("distance", 9).alias("distance"))


@query("vec_restore", """
SELECT CASE WHEN vec_id % 5 = 0 THEN 'orphaned' WHEN vec_id % 7 = 0 THEN 'stale' ELSE 'restored' END AS outcome, count(*) AS n, coalesce(sum(CASE WHEN vec_id % 5 <> 0 AND vec_id % 7 <> 0 THEN vec_id + 100 END), 0)::BIGINT AS seqs FROM embeddings GROUP BY 1""")
def vec_restore(spark, d):
    e = table(spark, d, "embeddings")
    snapshot = e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("content_hash"), F.col("embedding").alias("vector"))
    now = e.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("id"), (F.col("vec_id") + 100).alias("seq"), F.expr("CASE WHEN vec_id % 7 = 0 THEN 'changed' ELSE cast(label AS string) END").alias("content_hash"))
    return vectors.restore(snapshot, now).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("seq"), F.lit(0)).alias("seqs"))


@query("vec_stale", "SELECT vec_id AS id, label::VARCHAR AS content_hash FROM embeddings WHERE vec_id % 4 = 0 OR label = 3")
def vec_stale(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("content_hash"))
    return vectors.stale(e, e.where("id % 4 <> 0").withColumn("content_hash", F.expr("CASE WHEN content_hash = '3' THEN 'old' ELSE content_hash END")))


@query("vec_upsert", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, -1 FROM embeddings WHERE vec_id % 3 = 0")
def vec_upsert(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    third = e.where("vec_id % 3 = 0")
    new = third.unionByName(third.withColumn("vec_id", F.col("vec_id") + 1_000_000)).withColumn("label", F.lit(-1))
    return vectors.upsert(e, new, ["vec_id"])


@query("build_order", "SELECT * FROM (VALUES (0, 'blobs'), (1, 'commits'), (2, 'index'), (3, 'views'), (4, 'report')) t(place, step)")
def build_order(spark, d):
    steps = [derived.Step("report", ("views", "index")), derived.Step("views", ("commits",)), derived.Step("commits", ("blobs",)), derived.Step("blobs"), derived.Step("index", ("commits",))]
    return spark.createDataFrame(list(enumerate(derived.build_order(steps))), "place int, step string")
