"""The training-data operators against brute force, on a fixture of awkward rows."""

import hashlib
import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from ledgerframe.llm import ann, bpe, chat, exactdedup, katz, langid, neardup, packing, quality, tokenfile, words  # noqa: E402
from ledgerframe.llm.common import work_path  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(6000))
BASE = " ".join(f"word{i}" for i in range(120))
NEAR = BASE.replace("word60 ", "other ")
TEXTS = [
    (1, "The quick brown fox's jumps, over 12 dogs!"),
    (2, "the QUICK brown fox's jumps, over 12 dogs!"),
    (3, None),
    (4, ""),
    (5, LONG),
    (6, BASE),
    (7, NEAR),
    (8, BASE),
    (8, BASE),
    (None, "no id"),
    (None, BASE),
    (9, "<|endoftext|> ÉÀ ΣΣ I’ll we'll ''  \x1c á <|startoftext|>"),
    (10, "aaaa" * 900 + "tion" * 700),
    (-3, "one"),
    (11, "one\ntwo"),
    (12, "   \n\t "),
]
SCHEMA = "doc_id long, text string, _key string, bucket int, keep string"


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns clash with names that operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def rows(df):
    return [tuple(r) for r in df.collect()]


def expected_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def order(x):
    return tuple((v is not None, v if v is not None else 0) for v in x)


def test_token_files(spark, docs, none, library):
    wanted, start = [], 0
    for i, t in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*expected_ids(library, t), 2]
        wanted.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(rows(tokenfile.token_files(docs, PATH, 2, length=64)), key=order) == sorted(wanted, key=order)
    assert rows(tokenfile.token_files(none, PATH, 2)) == []


def test_sequences_are_views_of_the_file(spark, docs, library):
    manifest = tokenfile.write_token_files(docs, PATH, 2, work_path(spark, "test"), length=32, rows=4).orderBy("shard").collect()
    whole = [x for i, t in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")) for x in [*expected_ids(library, t), 2]]
    read = []
    for m in manifest:
        shard = tokenfile.Shard(m.path)
        got = []
        for k in range(-(-m.n_tokens // 32)):
            ids, mask = shard.sequence(k)
            assert len(ids) == len(mask) == 32 and not ids.flags.owndata and not mask.flags.owndata
            got += ids[mask.astype(bool)].tolist()
        assert len(got) == m.n_tokens
        with pytest.raises(IndexError):
            shard.sequence(-(-m.n_tokens // 32))
        read += got
    assert read == whole


def test_round_trip(docs, none, library):
    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    wanted = []
    for i, t in TEXTS:
        ids = expected_ids(library, t)
        text = bpe.transducer(PATH).decode_text(ids)
        if i in (1, 5, 11):
            assert text == "".join(piece + " " for piece in words.pieces(t))
        wanted.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)), sha(text)))
    assert sorted(rows(bpe.round_trip(docs, PATH)), key=lambda r: (order(r[:2]), r[2:])) == sorted(wanted, key=lambda r: (order(r[:2]), r[2:]))
    assert rows(bpe.round_trip(none, PATH)) == []


def test_long_texts_stream_through_the_digests(library, monkeypatch):
    """Long pieces and texts of many chunks give the same digests, in memory that the text does not set."""
    monkeypatch.setattr(bpe, "LONG", 200)
    rng = np.random.default_rng(12)
    of = bpe._digests(PATH)
    text = " ".join("".join(rng.choice(["a", "n", "th", "er", "ing", "o", "é", "ß"], int(n))) for n in [3, 900, 5, 60_000, 7, 260]) + " end" + " some more words" * 20_000
    ids = expected_ids(library, text)
    n, *got = of(text)
    wanted = [" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False), "".join(piece + " " for piece in words.pieces(text))]
    assert n == len(ids) and got == [hashlib.sha256(x.encode()).hexdigest() for x in wanted]
    tracemalloc.start()
    of(text * 10)
    most = tracemalloc.get_traced_memory()[1] - len(text) * 10 * 2
    tracemalloc.stop()
    assert most < 12 << 20


def test_transducer_streams_with_its_lookahead(library):
    t = bpe.Transducer(PATH, window=1)
    rng = np.random.default_rng(5)
    for _ in range(6):
        word = "".join(rng.choice(["a", "n", "th", "er", "ing", "o", "é"], 900))
        data = word.encode()
        cuts = sorted(rng.integers(0, len(data), 7).tolist())
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        assert list(t.stream(parts)) == expected_ids(library, word)
    assert t.decode_text(t.encode("Héllo wörld <|endoftext|>")).split() == ["héllo", "wörld", "<|endoftext|>"]


@pytest.mark.parametrize("data", [b"ab\xc3\xa9", b"\xe2\x82", b"\xf0\x9f\x98\x80x", b"\xff\x80a", b"\xc3(", b"\xed\xa0\x80"])
def test_byte_machine(data):
    whole, single = bpe.ByteToText(), bpe.ByteToText()
    a = whole.feed(data) + whole.end()
    b = "".join(single.feed(data[i : i + 1]) for i in range(len(data))) + single.end()
    assert a == b == data.decode("utf-8", "replace")


def test_packing(docs, none, library):
    got = packing.pack_documents(docs, PATH, end_id=1, capacity=256).collect()
    wanted = Counter()
    for i, t in TEXTS:
        ids = [*expected_ids(library, t), 1]
        for k, at in enumerate(range(0, len(ids), 256)):
            wanted[(i, k, at, len(ids[at : at + 256]), crc(ids[at : at + 256]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == wanted
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert rows(packing.pack_documents(none, PATH)) == []


def test_local_search_empties_bins():
    # best fit leaves 3 bins: 6+3, 5+4, 2; swaps make 6+4, 5+3+2
    lengths = [6, 5, 4, 3, 2]
    bins = packing.improve([[0, 3], [1, 2], [4]], lengths, 10)
    assert len(bins) == 2 and sorted(i for b in bins for i in b) == [0, 1, 2, 3, 4]
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 60, 300).tolist()
    first = packing.best_fit(lengths, 100)
    better = packing.improve([list(b) for b in first], lengths, 100)
    assert len(better) <= len(first) and sorted(i for b in better for i in b) == list(range(300))
    assert all(sum(lengths[i] for i in b) <= 100 for b in better)


def test_exact_dedup(docs, none):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[(t or "").translate(lower)].append(i)
    for parts in ((docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 <> 0 or doc_id is null")), (none, docs), (docs, none)):
        got = exactdedup.dedup(*parts).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(
            (i, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids
        )
        assert sum(r.kept for r in got) == len(groups)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert rows(exactdedup.dedup(none, none)) == []


def test_exact_dedup_of_a_text_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "MANY", 4)
    data = [(i, "Hot text" if i % 3 else f"own {i // 6}") for i in range(240)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(20)
    groups = defaultdict(list)
    for i, t in data:
        groups[t.lower()].append(i)
    got = exactdedup.dedup(df.where("doc_id < 200"), df.where("doc_id >= 200")).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == Counter((i, max(ids), len(ids), i == max(ids)) for ids in groups.values() for i in ids)


def test_packing_in_groups(spark):
    """Rows that repeat spread over the groups, and every row has its place."""
    rng = np.random.default_rng(14)
    lengths = [*rng.integers(1, 60, 700).tolist(), *[37] * 300, None, 0]
    df = spark.createDataFrame([(1, x) for x in lengths], "doc_id long, length int")
    got = packing.pack_pieces(packing.cut(df, "test"), 100, group_rows=120).collect()
    assert sorted((r.length or 0) for r in got) == sorted(x or 0 for x in lengths)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length or 0))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 100
    assert len(bins) <= 1.06 * sum(x or 0 for x in lengths) / 100


def test_local_search_has_no_caps():
    """Bins of many short pieces, and more bins than the search once looked at."""
    rng = np.random.default_rng(15)
    lengths = [*[3] * 300, *[5] * 200, *rng.integers(40, 60, 30).tolist()]
    bins = packing.pack_lengths(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and len(bins) == -(-sum(lengths) // 100)
    lengths = rng.integers(1000, 2500, 1200).tolist()
    first = packing.best_fit(lengths, 4096)
    better = packing.improve([list(b) for b in first], lengths, 4096)
    assert sorted(i for b in better for i in b) == list(range(1200)) and len(better) < len(first)
    assert all(sum(lengths[i] for i in b) <= 4096 for b in better)


@pytest.mark.parametrize("n", [0, 1, 2, 10, 3000])
def test_binary_fuse(n):
    rng = np.random.default_rng(n)
    keys, others = rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 63, 20_000, np.uint64)
    made = exactdedup.BinaryFuse.from_bytes(exactdedup.BinaryFuse.build(keys).to_bytes())
    assert made.contains(keys).all()
    assert made.contains(others).mean() < 0.02


def brute_katz(texts, order):
    """(base, score) by plain dictionaries; follows the definitions, not the operator's code."""
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    tokens = [[*(t or "").encode().translate(lower).split(), "END"] for _, t in texts]
    train = [zlib.crc32(str("" if i is None else i).encode()) % 7 != 2 for i, _ in texts]
    count = {m: Counter() for m in range(1, order + 1)}
    for w, t in zip(tokens, train):
        if t:
            marked = ["BOS", *w]
            count[1].update((x,) for x in w)
            for m in range(2, order + 1):
                count[m].update(tuple(marked[k : k + m]) for k in range(len(marked) - m + 1))

    def discounts(counts):
        n = Counter(counts)
        tail = 6 * n[6] / n[1] if n[1] else 1
        out = {}
        for r in range(1, 6):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return out

    d = {m: discounts(count[m].values()) for m in count}
    words = [w for (w,) in count[1]]
    total = sum(count[1].values())
    left = sum((1 - d[1][c]) * c for c in count[1].values() if c <= 5)
    scale, unknown = (total, left / total) if left else (total + 1, 1 / (total + 1))
    p1 = {w: d[1].get(c, 1) * c / scale for (w,), c in count[1].items()}
    assert math.isclose(sum(p1.values()) + unknown, 1)
    after = defaultdict(dict)
    for m in range(2, order + 1):
        for gram, c in count[m].items():
            after[gram[:-1]][gram[-1]] = c
    models = {(): (p1, unknown)}

    def model(h):
        """(P of each known word, P of the unknown word) after ``h``."""
        if h not in models:
            p, rest = model(h[1:])
            if seen := after.get(h):
                few = d[len(h) + 1]
                events = sum(seen.values())
                freed = sum((1 - few[c]) * c for c in seen.values() if c <= 5)
                size = events if freed else events + 1
                alpha = (freed or 1) / size / (1 - sum(p[w] for w in seen))
                p = {w: few.get(seen[w], 1) * seen[w] / size if w in seen else alpha * p[w] for w in words}
                rest = alpha * rest
                assert math.isclose(sum(p.values()) + rest, 1)
            models[h] = p, rest
        return models[h]

    out = []
    for (i, _), w, t in zip(texts, tokens, train):
        score, marked = 0.0, ["BOS", *w]
        for k in range(1, len(marked)):
            p, rest = model(tuple(marked[max(0, k - order + 1) : k]))
            score += math.log10(p.get(marked[k], rest))
        base = sum(math.log10((count[1][x,] + 1) / (total + len(words) + 1)) for x in w)
        out.append((i, not t, len(w), sum(count[1][x,] > 0 for x in w), total, base, score))
    return out


def test_words_of_the_language_model():
    texts = ["  A bÉ\tC ", "", "\x0b\x0c\r\n", "x\x1cy z\u00a0Z", "one"]
    words_, found, counts = katz.tokenized(pa.array(texts))
    got = np.array(words_.to_pylist(), object)[found].tolist()
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    wanted = [t.encode().translate(lower).split() for t in texts]
    assert [w.encode() for w in got] == sum(wanted, []) and counts.tolist() == list(map(len, wanted))


def katz_texts():
    rng = np.random.default_rng(2)
    words = [f"v{k}" for k in range(40)]
    texts = [(i, " ".join(rng.choice(words, int(rng.integers(0, 60)), p=np.arange(40, 0, -1) / 820))) for i in range(120)]
    return texts + [(900, None), (901, "Unseen words HERE"), (901, "Unseen words HERE"), (None, "v1 v2"), (902, "v1 " * 5000)]


def same_scores(got, wanted):
    got, wanted = (sorted(x, key=lambda r: (order(r[:1]), r[5])) for x in (got, wanted))
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in wanted])


def test_katz(spark, none):
    texts = katz_texts()
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    same_scores(rows(katz.score_corpus(df)), brute_katz(texts, 3))
    assert rows(katz.score_corpus(none)) == []


@pytest.mark.parametrize("n, hot, passes", [(2, 50, 1), (3, 50, 2), (4, 2_000_000, 1)])
def test_katz_orders_hot_histories_and_other_texts(spark, n, hot, passes):
    """Histories dealt over many buckets, buckets asked in turns, small blocks; stored tables score other texts alike."""
    texts = katz_texts()
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    model = katz.Katz(n, block_tokens=700, bucket_entries=300, hot=hot, passes=passes)
    got = rows(model.fit(df.withColumn("train", katz.crc_mod("doc_id", 7) != 2)))
    wanted = brute_katz(texts, n)
    same_scores(got, wanted)
    again = rows(model.score(df.select("doc_id", "text")))
    same_scores(again, [(r[0], True, *r[2:]) for r in wanted])


def test_chat(spark):
    said = "</s>[INST] ok [/INST] <\\|im_start|> <|im_end|>\\<s>\n\\"
    turns = [(1, 0, "system", "be <s> good"), (1, 1, "user", said), (1, 2, "assistant", said), (1, 3, "assistant", None), (2, None, None, "x"), (2, 0, "a\nb\\", ""), (None, 0, "assistant", "é😀"), (1, 1, "user", said)]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, input_ids int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    formatted = chat.format_conversations(df, path)
    got = {r.conv_id: r for r in chat.read_back(formatted, path).collect()}
    for conv in (1, 2, None):
        mine = sorted(((c, t, r or "", x or "") for c, t, r, x in turns if c == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        loss = "".join(x for _, _, r, x in mine if r == "assistant")
        assert got[conv].n_turns == len(mine)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in mine).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    f = chat.formatter(path)
    text = f.render(f.turn("user", said)[0])
    assert text.count("<|im_start|>") == 1 and text.count("<|im_end|>") == 1 and "</s>" not in text
    assert rows(chat.read_back(chat.format_conversations(df.limit(0), path), path)) == []


def test_near_duplicates(spark, docs, none):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    classes = defaultdict(set)
    for r in got:
        classes[r.class_id].add(r.doc_id)
    assert {6, 7, 8, None} in classes.values()  # near copies, exact copies, and a row without id
    assert {3, 4} in classes.values()  # null and empty
    assert {1, 2} in classes.values()  # equal but for case
    assert {5} in classes.values()
    assert sum(r.kept for r in got) == len(classes)
    assert rows(neardup.near_duplicates(none)) == []


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(12):
        words = [f"t{x}" for x in rng.integers(0, 5000, 150)]
        for edits in (0, 1, 2, 3, 5, 8):
            changed = list(words)
            for at in rng.integers(0, 150, edits):
                changed[at] = f"e{rng.integers(0, 10**6)}"
            texts.append(" ".join(changed))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root))


def test_sampler_estimates_weighted_similarity():
    rng = np.random.default_rng(6)
    hashes = rng.integers(0, 1 << 63, 400, np.uint64)
    a, b = rng.uniform(1, 3, 400), rng.uniform(1, 3, 400)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    s = neardup.Sampler()
    hits = [(s.samples(hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1), a) == s.samples(hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1), b)).mean() for k in range(1, 25)]
    assert abs(np.mean(hits) - true) < 0.03


def test_quality(spark, none):
    good = [(i, f"This is a clean text number {i} with words that vary {i * 7} and go on.") for i in range(200)]
    bad = [(1000 + i, "BUY!! NOW!! " * (3 + i % 5)) for i in range(100)]
    docs = spark.createDataFrame([(*r, 1) for r in [*good, *bad, (5000, None), (5001, ""), (None, "x")]], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(7, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, model, ["doc_id"]).collect()
    assert len(got) == 303 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.doc_id < 5000]
    assert np.mean([(r.doc_id < 1000) == bool(r.predicted) for r in held]) > 0.95
    assert quality.score_quality(none, quality.fit_quality(none, labels.limit(0)), ["doc_id"]).collect() == []


def test_trees_against_a_plain_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    trees = quality.BoostedTrees.fit(x, y)

    def walk(row):
        raw = trees.base
        for t in range(len(trees.value)):
            node = 0
            while node < len(trees.feature[t]):
                node = 2 * node + (2 if row[trees.feature[t][node]] > trees.threshold[t][node] else 1)
            raw += trees.value[t][node - len(trees.feature[t])]
        return 1 / (1 + math.exp(-raw))

    assert np.allclose(trees.score(x), [walk(r) for r in x])
    assert np.mean((trees.score(x) > 0.5) == y) > 0.9


def test_samples_are_bounded_by_rows(spark):
    """An id that is repeated gives one row; kept columns may be named like the operators' own."""
    many = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("some words and number "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    labels = spark.createDataFrame([(1, 1)] * 50, "doc_id long, quality int")
    assert quality.labelled_sample(many, labels, "quality", 10).count() == 1
    few = spark.createDataFrame([(i, "the of and to " * 9 if i % 2 else "der die das und " * 9, "en" if i % 2 else "de", 5, "t", "u", 0.5) for i in range(40)], "doc_id long, text string, lang string, _own int, _text string, lang_pred string, score double")
    net = langid.fit_language(few)
    got = langid.predict_language(few, net, few.columns)
    assert got.columns == ["doc_id", "text", "lang", "_own", "_text", "lang_pred", "score"] and {r.lang_pred for r in got.collect()} == {"de", "en"}
    model = quality.fit_quality(few, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    assert quality.score_quality(few, model, few.columns).columns == ["doc_id", "text", "lang", "_own", "_text", "lang_pred", "score", "predicted"]


def plain_network(net, x):
    """The network's log probabilities with one-hot bytes and explicit loops."""
    out = []
    for row in x:
        features = []
        for w, table, bias in zip(net.widths, net.tables, net.bias):
            for k in range(net.filters):
                best = max(sum(float(table[j][row[at + j]][k]) for j in range(w)) for at in range(len(row) - w + 1))
                features.append(max(0.0, best + float(bias[k])))
        z = [sum(f * float(net.out[m][c]) for m, f in enumerate(features)) + float(net.out_bias[c]) for c in range(len(net.languages))]
        total = math.log(sum(map(math.exp, z)))
        out.append([v - total for v in z])
    return out


def test_network_against_plain_loops():
    rng = np.random.default_rng(4)
    net = langid.ByteNetwork(["aa", "bb", "cc"])
    x = rng.integers(0, 256, (2, langid.WINDOW)).astype(np.uint8)
    assert np.allclose(net.log_probabilities(x), plain_network(net, x), atol=1e-4)


def test_language(spark, none):
    rng = np.random.default_rng(8)
    en, de = "the of and to in that it was for on with".split(), "der die und das nicht von zu mit sich ein über".split()
    docs = [(i, " ".join(rng.choice(en if i % 2 else de, 60)), "en" if i % 2 else "de") for i in range(160)]
    docs += [(900, None, "en"), (901, "123 !!", "de"), (902, "", None), (None, "the of the", "en"), (903, "über das " * 9000, None)]
    df = spark.createDataFrame([(*r, "z") for r in docs], "doc_id long, text string, lang string, _text string").drop("_text")
    net = langid.fit_language(df)
    got = {r.doc_id: r for r in langid.predict_language(df, net, ["doc_id"]).collect()}
    assert got[900].lang_pred == got[901].lang_pred == got[902].lang_pred == "und" and got[903].lang_pred == "de"
    held = [(i, lang) for i, _, lang in docs[:160] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.95
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.predict_language(empty, langid.fit_language(empty), ["doc_id"]).collect() == []


def test_nearest(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 16))
    x[100:400] = x[100]  # copies
    x[500] = 0
    data = [(i, [float(v) for v in r], "s") for i, r in enumerate(x)]
    data += [(901, None, "s"), (902, [float("nan")] * 16, "s"), (903, [None] * 16, "s"), (None, [1.0] * 16, "s"), (904, [1.0, 2.0], "s"), (950, [1.0, 2.0], "s")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, shard string").repartition(3)
    got = defaultdict(list)
    for r in ann.knn(df, df.where("vec_id % 50 = 0"), 5, shard_rows=300).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert 500 not in got and [r[1] for r in got[950]] == [904]
    hit = total = 0
    ok = [i for i in range(900) if i != 500]
    for q in range(0, 900, 50):
        if q == 500:
            continue
        score = {i: float(x[i] @ x[q] / np.linalg.norm(x[i]) / np.linalg.norm(x[q])) for i in ok if i != q}
        best = sorted(score, key=lambda i: (-round(score[i], 12), i))[:5]
        hit += len(set(best) & {r[1] for r in got[q]})
        total += 5
        assert all(math.isclose(score[i], s, abs_tol=1e-12) for _, i, s in got[q]) and [r[0] for r in got[q]] == [1, 2, 3, 4, 5]
    assert hit / total >= 0.9
    assert [r[1] for r in got[100]] == [101, 102, 103, 104, 105]


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_nearest_among_vectors_of_one_direction(spark, kind):
    """Scaled copies share a node: all of them are found, in clusters of any size."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(700, 24)).astype(kind)
    clusters = {}
    at = 0
    for size in (10, 30, 100):
        x[at : at + size] = (x[at] * rng.uniform(0.2, 5, (size, 1))).astype(kind)
        clusters[at] = range(at, at + size)
        at += size
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(2)
    x = x.astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in ann.knn(df, df.where("vec_id % 10 = 0"), 5, shard_rows=400).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    hit = []
    for q in range(0, 700, 10):
        score = unit @ unit[q]
        score[q] = -2
        best = np.sort(score)[-5:]
        hit.append(np.mean([r.score >= best[0] - 1e-9 for r in got[q]]))
        for members in clusters.values():
            if q in members:
                assert {r.vec_id for r in got[q]} <= set(members)
    assert np.mean(hit) >= 0.95


def test_ties_go_to_the_smaller_id(spark):
    """More vectors of one cosine than the beam holds nodes."""
    rows_ = [(i, [1.0, 0.0, 0.0]) for i in range(300, 0, -1)] + [(1000 + i, [float(i), 1.0, 0.5]) for i in range(60)]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>").repartition(3)
    got = ann.knn(df, df.where("vec_id = 100"), 5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5]
