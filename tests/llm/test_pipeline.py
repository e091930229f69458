"""The stages of the pipeline against plain Python, on rows with nulls, repeats and clashing columns."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline as pipeline  # noqa: E402
from ledgerframe.llm import langid, neardup, quality  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, _in int, _key string, score double, kept boolean"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents():
    rng = np.random.default_rng(21)
    words = {"en": "the of and to in that it was for on with as".split(), "de": "der die und das nicht von zu mit sich ein auf".split()}
    out = []
    for i in range(120):
        lang = "en" if i % 2 else "de"
        text = " ".join(rng.choice(words[lang], 60)) + f" {i}."
        out.append((i, text if i % 5 else "BUY!! NOW!! " * (4 + i % 3) + f"the {i}", lang))
    body = [f"the{k} and of to in" for k in range(60)]
    out += [(200, " ".join(body), "en"), (201, " ".join(body[:30] + ["other"] + body[31:]), "en"), (202, " ".join(body).upper(), "en")]
    out += [(203, None, "en"), (204, "", None), (205, "123 !!", None), (None, out[1][1], "en"), (7, out[7][1], "en"), (300, out[8][1], "de"), (301, out[8][1].upper(), None)]
    return [(*r, "s", 1, 2, "k", 0.5, False) for r in out]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(documents(), SCHEMA).repartition(3).write.parquet(f"file://{d}/documents.parquet")
    labels = [(i, int(i % 5 != 0)) for i in range(120)] + [(200, None), (None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"file://{d}/labels.parquet")
    return f"file://{d}"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages(spark, sf_dir):
    docs = pipeline.table(spark, sf_dir, "documents")
    every = rows(docs)
    # language: each text by itself
    net = langid.fit_language(docs)
    names, scores = net.predict([r[1] for r in every])
    kept = pipeline.language(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    wanted = [r for r, n, s in zip(every, names, scores) if n != "und" and s >= pipeline.LEAST_LANGUAGE_SCORE]
    assert rows(kept) == wanted and not {203, 204, 205} & {r[0] for r in wanted} and len(wanted) > 100
    # quality: each text by itself
    docs, every = kept.cache(), wanted
    model = quality.fit_quality(docs, pipeline.table(spark, sf_dir, "labels"))
    good = model.score(np.stack([quality.statistics(r[1]) for r in every])) >= 0.7
    kept = pipeline.good_quality(spark, docs, sf_dir)
    wanted = [r for r, g in zip(every, good) if g]
    assert rows(kept) == wanted and not any("BUY" in r[1] for r in wanted) and len(wanted) > 80
    # exact copies: the largest id, of repeated rows one
    docs, every = kept.cache(), wanted
    groups = defaultdict(list)
    for r in every:
        groups[r[1].translate(LOWER)].append(r)
    wanted = sorted((max(g, key=lambda r: (r[0] is not None, r[0] or 0)) for g in groups.values()), key=repr)
    kept = pipeline.exact_dedup(spark, docs, sf_dir)
    assert kept.columns == docs.columns and rows(kept) == wanted and len(wanted) < len(every)
    # near copies: all pairs
    docs, every = kept.cache(), wanted
    rare = neardup.rarity(docs)
    bags = [neardup.shingles(r[1]) for r in every]
    bags = [dict(zip(h.tolist(), neardup.weights(h, c, rare).tolist())) for h, c in bags]
    top = list(range(len(every)))
    for a in range(len(every)):
        for b in range(a):
            shared = sum(min(w, bags[b].get(h, 0)) for h, w in bags[a].items())
            if shared >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - shared) and top[a] != top[b]:
                top = [min(top[a], top[b]) if t in (top[a], top[b]) else t for t in top]
    classes = defaultdict(list)
    for t, r in zip(top, every):
        classes[t].append(r)
    wanted = sorted((min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in classes.values()), key=repr)
    kept = pipeline.near_dedup(spark, docs, sf_dir)
    assert rows(kept) == wanted and len(wanted) < len(every)
    # packing: every piece once, no gap, no sequence too long
    docs = kept.cache()
    library, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for r in wanted:
        ids = [*library.encode(r[1], add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            pieces[(r[0], k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    got = pipeline.pack(spark, docs, sf_dir).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == np.cumsum([0, *[n for _, n in sorted(b)]])[:-1].tolist() and sum(n for _, n in b) <= 4096
    # all stages in a row
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pipeline.run(spark, sf_dir).collect()) == pieces


def test_empty_tables(spark, sf_dir):
    docs = pipeline.table(spark, sf_dir, "documents").limit(0)
    for name, stage in pipeline.STAGES:
        made = stage(spark, docs, sf_dir)
        assert made.count() == 0, name
        if name != "packing":
            assert made.columns == docs.columns
