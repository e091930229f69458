"""Operators and stores on small tables: rules, errors and races that no registered query reaches."""

import pytest
from pyspark.sql import functions as F

from ledgerframe.charter import Charter, Column, Registry
from ledgerframe.functions import refcodec
from ledgerframe.operators import contracts, derived, fts, graph, lifecycle, placement, references, snapshot, vectors
from ledgerframe.plans import oracle_sql, queries
from ledgerframe.sources import documents
from ledgerframe.sources.store import HeadMismatch, SnapshotStore


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_queries_without_sql_are_named():
    assert set(queries()) - set(oracle_sql()) == set()


# codecs, contracts, lifecycle


def test_safe_slug(spark):
    for text, wanted in ((" -a b-. ", "a_b"), ("Smith 2024.TestPaper", "Smith_2024.TestPaper"), ("é·ü", "é_ü"), ("--.__", None), ("a-b", "a-b")):
        assert one(spark, refcodec.safe_slug, text) == wanted


def test_contract_rules(spark):
    def entry(name, version, body, compatible=False):
        return contracts.Entry("t", name, version, body, compatible)

    old = contracts.manifest(spark, [entry(n, "1", {"a": 1}) for n in "abcdef"])
    new = contracts.manifest(spark, [entry("a", "1", {"a": 1}), entry("b", "2", {"a": 1}), entry("c", "2", {"a": 2}), entry("d", "1", {"a": 2}, True), entry("e", "1", {"a": 2}), entry("g", "1", {})])
    assert dict(rows(contracts.compare(old, new))) == {"t:a": "unchanged", "t:b": "bumped", "t:c": "bumped", "t:d": "compatible", "t:e": "failed", "t:f": "removed", "t:g": "added"}
    with pytest.raises(contracts.ContractDrift, match="t:e"):
        contracts.check(old, new)
    with pytest.raises(ValueError, match="twice"):
        contracts.manifest(spark, [entry("a", "1", 1), entry("a", "2", 1)])


def test_lifecycle_definitions_and_writes(spark):
    publish = lifecycle.Transition("publish", "draft", "live", "MERGE", identity=F.concat(F.lit("p"), "id"), merge={"n": F.col("r.n") + F.col("t.n")})
    back = lifecycle.Transition("reopen", "live", "draft")
    made = lifecycle.Lifecycle(("draft", "live"), ("live",), (publish, back))  # a terminal state may have transitions
    with pytest.raises(ValueError, match="unknown state"):
        lifecycle.Lifecycle(("draft",), (), (publish,))
    records = spark.createDataFrame([("1", "draft", 1), ("2", "draft", 2), ("3", "live", 3)], "id string, state string, n int")
    live = spark.createDataFrame([("p1", 10)], "pid string, n int")
    done = lifecycle.run_batch(records, "id", "state", made.transition("publish"), live)
    assert rows(done.select("id", "outcome")) == [("1", "merged"), ("2", "written"), ("3", "wrong_state")]
    assert rows(lifecycle.writes(done, "state", publish, live, "pid").select("target_id", "state", "n")) == [("p1", "live", 11), ("p2", "live", 2)]


# documents


def test_strict_documents_at_every_level(spark):
    schema = "a struct<b: int, c: array<struct<d: int>>>, e string"
    good = spark.createDataFrame([('{"a":{"b":1,"c":[{"d":2},{"d":3}]},"e":"x"}',), ('{"e":"y"}',), ('{"a":null}',)], "j string")
    assert documents.strict(good, "j", schema).select("document.a.b").count() == 3
    for text in ('{"zz":1}', '{"a":{"b":1,"zz":2}}', '{"a":{"b":1,"c":[{"d":2},{"zz":3}]}}'):
        with pytest.raises(Exception, match="zz"):
            documents.strict(spark.createDataFrame([(text,)], "j string"), "j", schema).select("document").collect()


def test_yaml_folders(spark, tmp_path):
    (tmp_path / "b.yaml").write_text("name: b\nvalue: 2\n")
    (tmp_path / "a.yaml").write_text("name: a\nvalue: 1\n")
    (tmp_path / "c.txt").write_text("no document")
    got = documents.yaml_files(spark, str(tmp_path), "name string, value bigint").select("document.*")
    assert [tuple(r) for r in got.collect()] == [("a", 1), ("b", 2)]
    batch = tmp_path / "batch"
    batch.mkdir()
    (batch / "x.yaml").write_text("source: s\nitems:\n- name: a\n- name: b\n  source: t\n")
    got = documents.yaml_batches(spark, str(batch), "items", "name string, source string", ["source"]).select("item_index", "item.*")
    assert [tuple(r) for r in got.collect()] == [(1, "a", "s"), (2, "b", "t")]
    (batch / "y.yaml").write_text("other: 1\nitems: []\n")
    with pytest.raises(Exception, match="unknown fields"):
        documents.yaml_batches(spark, str(batch), "items", "name string, source string", ["source"]).collect()


# the snapshot store


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, f"file://{tmp_path}/store")


def files(spark, **data):
    return spark.createDataFrame([(k.replace("_", "/"), v.encode()) for k, v in data.items()], "path string, data binary")


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_commits_log_and_revert(spark, store):
    first = store.commit(files(spark, a="1", b_c="2"), None, "one")
    second = store.commit(files(spark, a="3"), paths(spark, "b/c"), "two")
    assert [r.message for r in store.log().collect()] == ["two", "one"] and store.head("refs/heads/main") == second
    assert rows(store.summary(second)) == [("a", "modified"), ("b/c", "deleted")]
    assert rows(snapshot.read_file(store.manifest(first), store.blobs(), "a").select("data")) == [(bytearray(b"1"),)]
    assert rows(snapshot.subtree(store.manifest(first), store.blobs(), ["b"]).select("rel")) == [("c",)]
    undone = snapshot.reverted(store.manifest(first), store.manifest(second), store.manifest(second))
    assert rows(undone) == rows(store.manifest(first))
    third = store.commit(files(spark, a="4"), None, "three")
    with pytest.raises(snapshot.RevertBlocked, match="a"):
        snapshot.reverted(store.manifest(first), store.manifest(second), store.manifest(third))
    assert store.exists("refs/heads/main", "a") and not store.exists("refs/heads/main", "b")


def test_paths_of_a_commit(spark, store):
    twice = spark.createDataFrame([("/q/", b"1"), ("q", b"1")], "path string, data binary")
    assert [r.path for r in store.manifest(store.commit(twice, None, "m")).collect()] == ["q"]
    with pytest.raises(snapshot.PathConflict):
        store.commit(spark.createDataFrame([("r", b"1"), ("r/", b"2")], "path string, data binary"), None, "m")
    store.commit(files(spark, b="1", d_e="1"), None, "m")
    for adds, deletes in ((files(spark, b_z="1"), paths(spark, "b")), (files(spark, d="1"), paths(spark, "d/e")), (files(spark, x="1", x_y="2"), None)):
        with pytest.raises(snapshot.PathConflict):
            store.commit(adds, deletes, "conflict")


def test_one_writer_wins(spark, store):
    base = store.commit(files(spark, a="1"), None, "one")
    with pytest.raises(HeadMismatch):
        store.commit(files(spark, a="2"), None, "two", expected="elsewhere")
    store.swap("refs/heads/x", None, base)
    number = store._ref("refs/heads/x")[0]
    store._ref = lambda name: (number - 1, None)  # a second writer that has read before
    with pytest.raises(HeadMismatch):
        store.swap("refs/heads/x", None, "other")
    del store._ref
    assert store.head("refs/heads/x") == base
    store.swap("refs/heads/x", base, None)
    assert store.head("refs/heads/x") is None and [r.name for r in store.refs("refs/heads/").collect()] == ["refs/heads/main"]


def test_fetch_notes_export_and_unreachable(spark, store, tmp_path):
    store.commit(files(spark, a="1", b_c="2"), None, "one")
    head = store.commit(files(spark, a="3"), None, "two")
    other = SnapshotStore(spark, f"file://{tmp_path}/other")
    assert other.fetch(store, "refs/heads/main", "refs/heads/main", None) == head
    assert [r.message for r in other.log().collect()] == ["two", "one"] and rows(other.manifest(head)) == rows(store.manifest(head))
    other.write_note("review", head, "fine")
    assert other.read_note("review", head) == "fine"
    other.write_note("review", head, None)
    assert other.read_note("review", head) is None
    side = store.commit(files(spark, only="here"), None, "side", ref="refs/heads/side")
    assert store.unreachable().count() == 0
    store.swap("refs/heads/side", side, None)
    assert store.unreachable().count() == 1
    assert store.export("refs/heads/main", str(tmp_path / "out")) == 2 and (tmp_path / "out" / "b" / "c").read_text() == "2"


def test_merges(spark):
    def manifest(**x):
        return spark.createDataFrame(list(x.items()) or [], "path string, oid string")

    base, left, right = manifest(a="1", b="1", c="1"), manifest(a="2", b="1"), manifest(a="1", b="3", c="1", d="9")
    assert rows(snapshot.merge(base, left, right)) == [("a", "2"), ("b", "3"), ("d", "9")]
    with pytest.raises(snapshot.MergeConflict, match="a"):
        snapshot.merge(base, left, manifest(a="7", b="1", c="1"))
    parents = spark.createDataFrame([("d", "b"), ("e", "b"), ("e", "c"), ("d", "c"), ("b", "a"), ("c", "a")], "id string, parent string")
    assert [r.id for r in snapshot.merge_bases(parents, "d", "e").collect()] == ["b", "c"] and snapshot.merge_base(parents, "d", "e") == "b"
    line = spark.createDataFrame([(str(k), str(k - 1)) for k in range(1, 24)], "id string, parent string")
    assert dict((r.id, r.distance) for r in snapshot.ancestors(line, ["23"]).collect()) == {str(k): 23 - k for k in range(24)}


def test_directory_digests(spark):
    def digests(*entries):
        return dict(rows(snapshot.directory_digest(spark.createDataFrame(entries, "path string, oid string"))))

    a = digests(("x/y/1", "a"), ("x/2", "b"), ("z", "c"))
    assert set(a) == {"", "x", "x/y"}
    b = digests(("z", "c"), ("x/2", "b"), ("x/y/1", "a"), ("w/y/1", "a"))
    assert b["x"] == a["x"] and b["w/y"] == a["x/y"] and b[""] != a[""]


def test_build_once(spark, tmp_path):
    tables = derived.DerivedTables(spark, f"file://{tmp_path}/derived")
    key = derived.cache_key("p", "c", {"i": "1"})
    assert key != derived.cache_key("p", "c", {"i": "2"})
    first = tables.materialize(key, lambda: spark.range(3).toDF("x"))
    again = tables.materialize(key, lambda: pytest.fail("built twice"))
    assert first[1] and not again[1] and again[0].count() == 3
    with pytest.raises(ZeroDivisionError):
        tables.materialize("bad", lambda: spark.range(1 // 0))
    assert not tables.exists("bad") and tables.gc({key}) == [] and tables.gc(set()) == [key]
    with pytest.raises(ValueError, match="unknown"):
        derived.build_order([derived.Step("a", ("b",))])


# placements and charters


@pytest.mark.parametrize("made, ref, path, back", [
    (placement.Flat("n"), "a", "n/a.yaml", True),
    (placement.Flat("n", "colon_to_double_underscore"), "a:b", "n/a__b.yaml", True),
    (placement.SubdirFixedFile("n"), "a", "n/a/index.yaml", True),
    (placement.NestedFlat("n"), "d/a", "n/d/a.yaml", True),
    (placement.FixedFile("n"), "a", "n/index.yaml", False),
    (placement.Template("n", template="t/{ref}.json"), "a", "t/a.json", False),
    (placement.Flat("n", "slug"), "A b", "n/a_b.yaml", False),
    (placement.Singleton("n"), "n", "n/index.yaml", True),
])
def test_placements(spark, made, ref, path, back):
    assert one(spark, made.path, ref) == path
    if back:
        assert one(spark, made.ref, path) == ref and one(spark, made.ref, "elsewhere/a.yaml") is None
    else:
        with pytest.raises(placement.NotScannable):
            one(spark, made.ref, path)


def test_bad_references_raise(spark):
    for made, ref in ((placement.NestedFlat("n"), "a/b/c"), (placement.Flat("n"), ""), (placement.Flat("n", "slug"), "--")):
        with pytest.raises(Exception):
            one(spark, made.path, ref)
    owner = spark.createDataFrame([("a b",)], "o string").select(placement.branch_for("template", F.col("o"), "main", "now", template="x/{owner}", suffix=True)).first()[0]
    assert owner.startswith("x/a_b-") and len(owner) == len("x/a_b-") + 8


def test_charters(spark):
    note = Charter("note", "id", "2026.01.01", (Column("id", int), Column("title", str, unique=True), Column("body", str | None, states=("live",), document_name="text")))
    data = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (2, None, "y")], "id bigint, title string, body string")
    assert rows(note.check(data).select("column", "reason").distinct()) == [("id", "unique"), ("title", "null"), ("title", "unique")]
    assert note.document(data, "draft").columns == ["id", "title"] and note.document(data, "live").columns == ["id", "title", "text"]
    with pytest.raises(ValueError, match="unknown"):
        Registry(Charter("a", "id", "1", (Column("id", int), Column("b", str, foreign_key="b"))))
    with pytest.raises(ValueError, match="twice"):
        Charter("a", "id", "1", (Column("id", int), Column("id", int)))


# references


def test_lookups(spark):
    concepts = spark.createDataFrame([("c1", ["F0", "frequency"]), ("c2", ["F0", "pitch"]), ("c3", ["pressure"]), (None, ["lost"])], "id string, aliases array<string>")
    index = references.lookup(concepts, "id", ["aliases[]"])
    assert ("F0", "c1", 2) in rows(index) and ("pressure", "c3", 1) in rows(index) and not index.where("key = 'lost'").count()
    assert rows(references.candidates(concepts, "id", ["aliases[]"], references.ambiguous(concepts, "id", ["aliases[]"]))) == [("F0", "c1"), ("F0", "c2")]
    with pytest.raises(references.BadReference, match="F0"):
        references.unique_lookup(concepts, "id", ["aliases[]"])
    refs = spark.createDataFrame([("F0",), ("pitch",), ("none",), (None,), ("",)], "r string")
    assert rows(references.resolve(refs, "r", index)) == [("", None, "empty"), ("F0", None, "ambiguous"), ("none", None, "missing"), ("pitch", "c2", "ok"), (None, None, "empty")]
    with pytest.raises(references.BadReference, match="list"):
        references.field_values(concepts, "aliases")


def test_children_and_dependencies(spark):
    links = spark.createDataFrame([("p", 2, "f"), ("p", 1, "m"), ("q", 1, "x")], "p string, ordinal int, name string")
    parents = spark.createDataFrame([("p",), ("r",)], "p string")
    assert rows(references.children_of(parents, "p", links, "p", ["ordinal"], "name")) == [("p", ["m", "f"]), ("r", [])]
    assert rows(references.ordered_children(links, "p", ["ordinal"]).select("p", "position", "name")) == [("p", 0, "m"), ("p", 1, "f"), ("q", 0, "x")]
    data = spark.createDataFrame([("a", [("x",), ("y",), ("x",)]), ("b", None)], "id string, l array<struct<r: string>>")
    assert rows(graph.dependencies(data, "f", "id", {"l[].r": "g"})) == [("f:a", "g:x", "l[].r"), ("f:a", "g:y", "l[].r")]


def test_nested_rewrites(spark):
    data = spark.createDataFrame([("1", (("x",), [("y", 1), ("z", 2), (None, 3)]), ["x", "y"]), ("2", None, None)], "id string, a struct<p: struct<q: string>, l: array<struct<r: string, n: int>>>, m array<string>")
    images = spark.createDataFrame([("x", "X"), ("y", "Y")], "source string, target string")
    made = references.rewrite_paths(data, "id", {"a.p.q": images, "a.l[].r": images, "m[]": images}).orderBy("id").collect()
    assert made[0].a.p.q == "X" and [tuple(x) for x in made[0].a.l] == [("Y", 1), ("z", 2), (None, 3)] and made[0].m == ["X", "Y"] and made[1].a is None and made[1].m is None
    with pytest.raises(references.BadReference, match="overlap"):
        references.rewrite_paths(data, "id", {"a.p": images, "a.p.q": images})


def link(spark, *records):
    return spark.createDataFrame(list(records), "id string, item string, related array<string>")


def identity(df):
    return F.concat(F.lit("link:"), "item")


def test_transport_of_a_cycle_with_referrers(spark):
    data = link(spark, ("old-a", "a", ["old-b"]), ("old-b", "b", ["old-a"]), ("old-c", "c", ["old-b"]), ("old-d", "d", []))
    images = spark.createDataFrame([("a", "a-image")], "source string, target string")
    made, moved = references.transport_family(data, "id", {"item": images}, ["related[]"], identity)
    assert rows(made) == [("link:a-image", "a-image", ["link:b"]), ("link:b", "b", ["link:a-image"]), ("link:c", "c", ["link:b"]), ("old-d", "d", [])]
    assert rows(moved) == [("old-a", "link:a-image"), ("old-b", "link:b"), ("old-c", "link:c")]
    kept, none = references.transport_family(data, "id", {"item": images.where("source = 'zz'")}, ["related[]"], identity)
    assert rows(kept) == rows(data) and none.count() == 0


def test_transport_errors(spark):
    images = spark.createDataFrame([("a", "new-a")], "source string, target string")
    loop = link(spark, ("old-a", "a", ["old-a"]))
    assert rows(references.transport_family(loop, "id", {"item": images}, ["related[]"], identity)[0]) == [("link:new-a", "new-a", ["link:new-a"])]
    with pytest.raises(references.BadReference, match="dangling"):
        references.transport_family(link(spark, ("old-a", "a", ["missing"])), "id", {"item": images}, ["related[]"], identity)
    with pytest.raises(references.BadReference, match="identity"):
        references.transport_family(loop, "id", {"item": images}, ["related[]"], None)
    with pytest.raises(references.BadReference, match="conflicting"):
        references.transport_family(loop, "id", {"item": images}, ["related[]"], identity, images.selectExpr("'old-a' AS source", "'other' AS target"))
    with pytest.raises(Exception, match="conflicting images"):
        references.transport_family(loop, "id", {"item": images}, ["related[]"], lambda df: F.concat("item", F.lit(":"), F.col("related")[0]))[0].collect()


# full text and vectors


def test_phrases(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the force of the moving mass", "x"), (2, "moving the mass of force", "the force"), (3, "", None), (4, "force force force", "of of")], "id int, a string, b string")
    made = fts.build(docs, "id", ["a", "b"], index_id=False, positions=True).save(str(tmp_path / "index"), buckets=4)

    def found(*all_of, **more):
        return sorted(r.doc for r in fts.search(made, list(all_of), **more).collect())

    assert found(fts.Phrase(("the", "force"))) == [1, 2] and found(fts.Phrase(("the", "force"), field="a")) == [1]
    assert found(fts.Phrase(("the",), first=True)) == [1, 2] and found(fts.Phrase(("force",), first=True)) == [4]
    near = fts.Near((fts.Phrase(("force",)), fts.Phrase(("moving", "mass"))), 2)
    assert found(near) == [1] and found(fts.Near(near.phrases, 1)) == []
    assert found(fts.Near((fts.Phrase(("mass",)), fts.Phrase(("moving",))), 1)) == [1, 2]
    assert found(fts.Term("force"), none_of=[fts.Phrase(("the", "force"))]) == [4]
    assert found(fts.Term("mo", prefix=True), any_of=[fts.Term("of"), fts.Phrase(("zzz",))]) == [1, 2]
    assert found(fts.Phrase(("force", "force"))) == [4]
    with pytest.raises(ValueError):
        fts.search(made, [])


def test_models_and_lookups(spark):
    models = spark.createDataFrame([], vectors.MODELS)
    models = vectors.register_model(models, "p", "m", "1", "d", 2, "t0")
    models = vectors.register_model(vectors.register_model(models, "p", "m", "2", "d", 3, "t0"), "p", "m", "1", "d", 2, "t1")
    assert sorted((r.model_version, r.created_at) for r in models.collect()) == [("1", "t1"), ("2", "t0")]
    model = models.where("model_version = '1'").first().model
    data = spark.createDataFrame([(model, 1, [0.1, 0.2]), (model, 2, [0.9, 0.9])], "model string, seq bigint, vector array<double>")
    status = spark.createDataFrame([(model, 1, "near"), (model, 2, "far")], "model string, seq bigint, id string")
    source = spark.createDataFrame([(1, "near"), (2, "moved")], "seq bigint, id string")
    assert vectors.checked_models(data, models).count() == 2
    with pytest.raises(Exception, match="other dimensions"):
        vectors.checked_models(data.withColumn("vector", F.array(F.lit(1.0))), models).collect()
    assert [r.id for r in vectors.nearest_entities(data, [0.1, 0.21], 2, status, source, model).collect()] == ["near"]
    ids = spark.createDataFrame([("near",), ("far",)], "id string")
    assert [r.id for r in vectors.point_lookup(data, status, source, model, ids).collect()] == ["near"]
    with pytest.raises(Exception, match="dimensions"):
        vectors.checked(data, "vector", 3).collect()
