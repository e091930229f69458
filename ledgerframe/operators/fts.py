"""Full-text search: postings, document lengths and BM25 ranks.

The rank of a document is the negated sum over the query's terms of
``idf * f * (k1 + 1) / (f + k1 * (1 - b + b * length / mean length))`` with k1 = 1.2, b = 0.75
and ``idf = ln((N - n + 0.5) / (n + 0.5))``, or 1e-6 where that is not positive; smaller is better.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

K1, B, LEAST = 1.2, 0.75, 1e-6
#: Latin letters with diacritics and the letters they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyy"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, Latin diacritics folded."""
    folded = F.translate(F.lower(text), ACCENTED, FOLDED)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda x: x != "")


@dataclass(frozen=True)
class Index:
    """postings: (doc, field, term, f[, at: positions]); lengths: (doc, len) over all fields;
    terms: (term, n); stats: one row (docs, mean)."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    stats: DataFrame

    def save(self, path: str, buckets: int = 64) -> Index:
        """The tables as files, postings in folders by a hash of the term: searches read what is stored."""
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket")
        self.postings.select("*", bucket).repartition("bucket").sortWithinPartitions("term", "doc").write.partitionBy("bucket").parquet(f"{path}/postings")
        for name in ("lengths", "terms", "stats"):
            getattr(self, name).write.parquet(f"{path}/{name}")
        return Index.load(self.postings.sparkSession, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "terms", "stats")))


def build(docs: DataFrame, id_column: str, fields: list[str], index_id: bool = True, positions: bool = False) -> Index:
    """All four tables; with ``index_id`` the id is a field like the others, whose tokens count and match;
    with ``positions`` the places of each term, which phrases need."""
    names = [*([id_column] if index_id else []), *fields]
    parts = F.array(*[F.struct(F.lit(n).alias("field"), tokens(F.coalesce(F.col(n).cast("string"), F.lit(""))).alias("terms")) for n in names])
    rows = docs.select(F.col(id_column).alias("doc"), F.explode(parts).alias("p")).select("doc", "p.field", "p.terms")
    f = F.count(F.lit(1)).alias("f")
    if positions:
        spread = rows.select("doc", "field", F.posexplode("terms").alias("at", "term"))
        postings = spread.groupBy("doc", "field", "term").agg(f, F.sort_array(F.collect_list("at")).alias("at"))  # within one document
    else:
        postings = rows.select("doc", "field", F.explode("terms").alias("term")).groupBy("doc", "field", "term").agg(f)
    lengths = rows.groupBy("doc").agg(F.sum(F.size("terms")).cast("bigint").alias("len"))
    # a term of one field has one posting a document
    n = F.count(F.lit(1)) if len(names) == 1 else F.countDistinct("doc")
    terms = postings.groupBy("term").agg(n.alias("n"))
    stats = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean"))
    return Index(postings, lengths, terms, stats)


@dataclass(frozen=True)
class Term:
    """One query term; ``prefix`` matches all terms that start with it, ``field`` one field only."""

    text: str
    prefix: bool = False
    field: str | None = None

    def condition(self) -> Column:
        hit = F.col("term").startswith(self.text) if self.prefix else F.col("term") == self.text
        return hit & (F.col("field") == self.field) if self.field else hit


@dataclass(frozen=True)
class Phrase:
    """Terms that follow each other in a field; ``first``: from the field's first token on."""

    terms: tuple[str, ...]
    first: bool = False
    field: str | None = None


@dataclass(frozen=True)
class Near:
    """Phrases of one field with at most ``distance`` tokens between the end of the first and the start of the last."""

    phrases: tuple[Phrase, ...]
    distance: int = 10


def occurrences(index: Index, phrases: list[Phrase]) -> DataFrame:
    """(phrase, doc, field, starts): where each of the phrases begins; one pass over the postings."""
    if not phrases or any(not p.terms for p in phrases):
        raise ValueError("a phrase needs a term")
    wanted = [F.struct(F.lit(k).alias("phrase"), F.lit(i).alias("i"), F.lit(len(p.terms)).alias("n"), F.lit(p.first).alias("first"), F.lit(t).alias("t"), F.lit(p.field).cast("string").alias("in")) for k, p in enumerate(phrases) for i, t in enumerate(p.terms)]
    mine = F.filter(F.array(*wanted), lambda w: (w["t"] == F.col("term")) & (w["in"].isNull() | (w["in"] == F.col("field"))))
    rows = index.postings.where(F.col("term").isin(sorted({t for p in phrases for t in p.terms})))
    rows = rows.select("doc", "field", "at", F.explode(mine).alias("w")).select("doc", "field", "w.*", F.explode("at").alias("place"))
    starts = rows.groupBy("phrase", "doc", "field", "n", "first", (F.col("place") - F.col("i")).alias("start")).agg(F.count(F.lit(1)).alias("found"))
    starts = starts.where((F.col("found") == F.col("n")) & (~F.col("first") | (F.col("start") == 0)))
    return starts.groupBy("phrase", "doc", "field").agg(F.sort_array(F.collect_list("start")).alias("starts"))  # within one document


def _near(index: Index, query: Near) -> DataFrame:
    """(doc, f): documents with a field where all phrases are near, and how many first ones are."""
    found = occurrences(index, list(query.phrases))
    spans = F.transform("starts", lambda s: F.struct(s.alias("s"), (s + F.element_at(F.array(*[F.lit(len(p.terms)) for p in query.phrases]), F.col("phrase") + 1)).alias("e")))
    rows = found.groupBy("doc", "field").agg(F.collect_list(spans).alias("all")).where(F.size("all") == len(query.phrases))
    near = F.filter(F.flatten("all"), lambda a: F.forall(F.col("all"), lambda p: F.exists(p, lambda b: (b["s"] >= a["s"]) & (b["s"] <= a["e"] + query.distance))))
    return rows.select("doc", F.size(near).alias("f")).where("f > 0").groupBy("doc").agg(F.sum("f").alias("f"))


def search(index: Index, all_of: list[Term | Phrase | Near], any_of: list[Term | Phrase | Near] = (), none_of: list[Term | Phrase | Near] = (), limit: int | None = None) -> DataFrame:
    """(doc, rank), best first, ties by doc: has every part of ``all_of``, one of ``any_of`` (if any), none of ``none_of``.

    All terms are found in one pass over the postings, all phrases in one more.
    """
    if not all_of and not any_of:
        raise ValueError("a query needs a term")
    parts = [*all_of, *any_of, *none_of]
    found = None
    terms = [(k, t) for k, t in enumerate(parts) if isinstance(t, Term)]
    if terms:
        hits = F.array(*[F.when(t.condition(), F.lit(k)) for k, t in terms])
        some = reduce(lambda a, b: a | b, [t.condition() for _, t in terms])
        rows = index.postings.where(some).select("doc", "f", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("t"))
        found = rows.groupBy("t", "doc").agg(F.sum("f").alias("f"))
    phrases = [(k, p) for k, p in enumerate(parts) if isinstance(p, Phrase)]
    if phrases:
        number = F.element_at(F.array(*[F.lit(k) for k, _ in phrases]), F.col("phrase") + 1).alias("t")
        rows = occurrences(index, [p for _, p in phrases]).groupBy(number, "doc").agg(F.sum(F.size("starts")).alias("f"))
        found = rows if found is None else found.unionByName(rows)
    for k, query in enumerate(parts):
        if isinstance(query, Near):
            rows = _near(index, query).select(F.lit(k).alias("t"), "doc", "f")
            found = rows if found is None else found.unionByName(rows)
    need, last = len(all_of), len(all_of) + len(any_of)
    df = found.where(F.col("t") < last).groupBy("t").agg(F.count(F.lit(1)).alias("n"))  # one row per query part
    scored = found.join(F.broadcast(df), "t", "left").join(index.lengths, "doc").crossJoin(F.broadcast(index.stats))  # one row
    idf = F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(LEAST)
    weight = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    t = F.col("t")
    ranked = scored.groupBy("doc").agg(
        (-F.sum(F.when(t < last, weight))).alias("rank"),
        F.sum((t < need).cast("int")).alias("has"),
        F.max(((t >= need) & (t < last)).cast("int")).alias("any"),
        F.max((t >= last).cast("int")).alias("out"),
    )
    ranked = ranked.where((F.col("has") == need) & (F.col("out") == 0))
    if any_of:
        ranked = ranked.where("any = 1")
    out = ranked.select("doc", "rank").orderBy("rank", "doc")
    return out.limit(limit) if limit is not None else out
