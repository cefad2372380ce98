import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import decontamination, embedding_dedup, language_id, mixing, near_dedup, quality, quotations, substring_dedup, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h1 string, shard int, root long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(spark, texts):
    return spark.createDataFrame([(i, t, "en", None if (i or 0) % 4 == 3 else f"s{(i or 0) % 4}", 0, "x", 1, 2) for i, t in texts], DOCS).repartition(3)


def odd(spark):
    """Nulls, empty and long texts, repeated rows, one doc_id twice."""
    rng = random.Random(5)
    base = words(rng, 300)
    near = base[:150] + ["changed"] + base[151:]
    long = " ".join(words(rng, 20_000, 10**6))
    return [(None, None), (1, None), (2, ""), (3, " \n\t"), (4, " ".join(base)), (5, " ".join(base)), (6, "  ".join(near)), (6, "  ".join(near)), (7, "one two"), (8, "one two"), (9, long), (None, " ".join(base)), (10, "ünï " * 60)]


def test_token_counts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    parts, rng = [" ", "  ", "▁", "\n", "\t", "the", "ing", "<s>", "</s>", "é", "中", "😀", "\x00", "1", ".", "É"], random.Random(1)
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for i in range(3000)] + odd(spark)
    got = Counter(map(tuple, token_counts.count_tokens(corpus(spark, texts), path, 10).collect()))
    assert got == Counter((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 10) for i, t in texts)


def brute_cut(texts, width):
    first = {}
    for i, t in texts:
        w, k = re.findall(r"[^\x20\x09-\x0D]+", t or ""), 2**63 - 1 if i is None else i
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            first[key] = min(first.get(key, k), k)
    out = Counter()
    for i, t in texts:
        w, k = re.findall(r"[^\x20\x09-\x0D]+", t or ""), 2**63 - 1 if i is None else i
        gone = {q for p in range(len(w) - width + 1) if first[tuple(w[p : p + width])] < k for q in range(p, p + width)}
        out[i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)] += 1
    return out


@pytest.mark.parametrize(("width", "fan"), [(5, 256), (50, 256), (5, 4), (50, 4)])
def test_substring_dedup(spark, width, fan):
    rng = random.Random(2)
    shared = words(rng, 80)
    texts = odd(spark) + [(100 + i, " ".join(words(rng, 30) + (shared if i % 3 else []) + words(rng, 40))) for i in range(40)]
    got = substring_dedup.remove_repeats(corpus(spark, texts), width, chunk_chars=3000, shard_windows=500 if fan > 4 else 50, fan=fan)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()) == brute_cut(texts, width)
    assert substring_dedup.remove_repeats(corpus(spark, texts).limit(0)).count() == 0


def brute_near(texts, threshold=0.8):
    sets = {}
    for i, t in texts:
        w = (t or "").split()
        if w and i is not None:
            sets[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a < b and sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys()) >= threshold:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("small", [24, 1])
def test_near_duplicates(spark, small):
    rng, texts = random.Random(3), []
    for g in range(6):
        base = words(rng, 60)
        for k in range(6):
            w = list(base)
            for _ in range(k % 4):
                w[rng.randrange(60)] = f"x{rng.random()}"
            texts.append((1000 * (g + 1) + k, " ".join(w)))
    texts += [(i, t) for i, t in odd(spark) if i != 9]
    got = near_dedup.near_duplicates(corpus(spark, texts), small=small, star_rounds=1).collect()
    want = brute_near(texts)
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is not None:
            assert r.class_id == want.get(r.doc_id, r.doc_id) and r.kept == (r.class_id == r.doc_id)
    assert near_dedup.near_duplicates(corpus(spark, texts).limit(0)).count() == 0
    assert near_dedup.deduplicated(corpus(spark, texts)).columns == corpus(spark, texts).columns


def test_probability_jaccard():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = ({int(k): float(rng.integers(1, 5)) for k in rng.choice(12, rng.integers(1, 10), replace=False)} for _ in range(2))
        exact = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())
        pack = lambda x: (np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)]))
        assert near_dedup.probability_jaccard(pack(a), pack(b)) == pytest.approx(exact)


def test_mixing(spark):
    rng = random.Random(6)
    texts = odd(spark) + [(200 + i, " ".join(words(rng, rng.randrange(1, 40)))) for i in range(400)]
    docs = corpus(spark, texts)
    rows = mixing.mix(docs, block_docs=16).collect()
    assert rows and len(rows) == len(texts) and Counter(map(str, rows)) == Counter(map(str, mixing.mix(docs.repartition(5), block_docs=16).collect()))
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.size * len(r.shards) and all(0 <= x < 16 for x in r.shards)
        by.setdefault((r.source_size, r.target), []).append(r)
    assert sum(t for _, t in by) == pytest.approx(sum(r.size for r in rows))
    for (_, target), group in by.items():
        assert abs(sum(r.taken for r in group) - target) <= max(r.size for r in group) / 2 + 1
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.draw(mixing.mix(docs, carry=docs.columns)).count() == sum(len(r.shards) for r in mixing.mix(docs).collect())


def test_mixing_fills_up_beside_a_long_document(spark):
    rng = random.Random(16)
    rows = [(i, " ".join(words(rng, 20)), "b") for i in range(300)] + [(900, "w " * 9000, "b")] + [(1000 + i, " ".join(words(rng, 100)), s) for i in range(300) for s in "ac"]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("source_size = 15000").collect()
    assert abs(sum(r.taken for r in got) - got[0].target) <= 9000  # the long one is left out or in, never instead of the small ones
    small = mixing.mix(spark.createDataFrame([r for r in rows if r[0] != 900], "doc_id long, text string, source string")).where("source_size = 6000").collect()
    assert abs(sum(r.taken for r in small) - small[0].target) <= 20


def test_splitting_tree(spark):
    one = spark.createDataFrame([(0, [50, 0, 7, 400])], "group long, units array<long>")
    shards = sorted(mixing.split_quotas(one, 3).collect(), key=lambda r: r.shard)
    assert np.sum([r.units for r in shards], axis=0).tolist() == [50, 0, 7, 400] and {sum(r.units) for r in shards} <= {57, 58}
    assert [r.begin for r in shards] == np.cumsum([[0] * 4] + [r.units for r in shards[:-1]], axis=0).tolist()
    quotas = [[(i * 7 + j) % 11 for j in range(256)] for i in range(3)]
    many = mixing.split_quotas(spark.createDataFrame(list(enumerate(quotas)), "group long, units array<long>"), 2, groups=3).collect()
    totals = Counter()
    for r in many:
        totals[r.shard] += sum(r.units)
    assert max(totals.values()) - min(totals.values()) <= 2
    for g in range(3):
        assert np.sum([r.units for r in many if r.group == g], axis=0).tolist() == quotas[g]
    # the mean of a hypergeometric draw
    draws = spark.range(2000).select(mixing.hypergeometric(F.lit(60), F.lit(20), F.lit(30), mixing.uniform(F.lit("x"), F.col("id"))).alias("n")).select(F.avg("n").alias("m"), F.var_pop("n").alias("v")).first()
    assert draws.m == pytest.approx(10, abs=0.2) and draws.v == pytest.approx(30 * 20 / 60 * 40 / 60 * 30 / 59, rel=0.15)


def test_more_sources_than_a_group(spark):
    docs = spark.createDataFrame([(i, "one two three", f"s{i % 300:03d}") for i in range(900)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source_size, r.target] += r.taken
        target[r.source_size, r.target] = r.target
    assert len(rows) == 900 and sum(taken.values()) == pytest.approx(2700, abs=300 * 1.5)


@pytest.mark.parametrize("block", [2_000_000, 90, 30])
def test_decontamination(spark, block):
    rng = random.Random(7)
    items = [(i, " ".join(words(rng, 20, 5000))) for i in range(8)] + [(90, None), (91, ""), (92, "Two Words"), (None, " ".join(words(rng, 20, 5000)))]
    w = [t.split() if t else [] for _, t in items]
    texts = [(1, "clean " * 30), (2, " ".join(words(rng, 30, 5000) + w[0] + ["end"] + w[11])), (3, " ".join(["a"] + w[1][:6] + ["X"] + w[1][7:13] + ["Y"] + w[1][14:])), (4, " ".join(w[2][:9])), (5, None), (6, "")]
    texts += [(7, "say two, words"), (2, " ".join(w[0]).upper()), (2, "clean"), (None, " ".join(w[3])), (None, "fine"), (8, " ".join(words(rng, 30_000, 10**6) + w[4])), (9, " ".join(w[0])), (9, " ".join(w[0]))]
    docs, bench = corpus(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_overlaps(docs, bench, block_words=block).collect()
    want = [(1, ()), (2, ()), (2, (0,)), (2, (0, None)), (3, (1,)), (4, ()), (5, ()), (6, ()), (7, (92,)), (8, (4,)), (9, (0,)), (9, (0,)), (None, ()), (None, (3,))]
    assert sorted(((r.doc_id, tuple(r.item_ids)) for r in got), key=str) == sorted(want, key=str)
    assert all(len(r.item_ids) == len(r.spans) == len(r.first_words) and r.contaminated == bool(r.item_ids) for r in got)
    assert [(r.first_words, r.equal) for r in got if r.doc_id == 3] == [([1], [18])]
    kept = decontamination.decontaminated(docs.withColumn("key", F.lit(1)).withColumn("found", F.lit(2)), bench, block_words=block)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 4, 5, 6, None])) and kept.columns == [*docs.columns, "key", "found"]
    assert decontamination.find_overlaps(docs.limit(0), bench, block_words=block).count() == 0
    assert decontamination.decontaminated(docs, bench.limit(0), block_words=block).count() == len(texts)


def test_embeddings(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base, base[:20] + 0.1 * rng.standard_normal((20, 16)), base[:5], 2 * base[5:8]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [None] + [1.0] * 15), (504, [1.0]), (None, x[0].tolist()), (505, [])]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=8, per_cell=4).collect()}
    assert len(got) == len(rows)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.array([min(root[i], *root[near[i]]) if near[i].any() else root[i] for i in range(len(x))])
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), root[i], root[i] == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(500, 506))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicate_vectors(frame.limit(0)).count() == 0
    lengths = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [3.0, 0.1, 0.0]), (5, [1.0]), (6, [2.0]), (5, [1.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicate_vectors(lengths).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False)]


def test_toxicity(spark):
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = " ".join(words(rng, 30) + (["scumbag"] if bad else []) + (["women"] if bad or i % 50 == 1 else []))
        texts.append((i, text))
        labels.append((i, int(bad)))
    docs, marks = corpus(spark, texts + [(900, None), (901, ""), (None, "x")]), spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, y in labels) and got[900] == got[901] < 0.5

    def moved(m):
        w = m.weights
        return abs(float(sum(w[f] for f in toxicity.features_of("women")) - sum(w[f] for f in toxicity.features_of("men"))))

    assert moved(toxicity.fit(docs, marks, penalty=20.0)) < 0.7 * moved(toxicity.fit(docs, marks, penalty=0.0))
    assert toxicity.clean(docs, model).columns == docs.columns
    assert toxicity.fit(docs, marks.limit(0)).bias == 0 and toxicity.score(docs.limit(0), model).count() == 0


def test_quality(spark):
    docs = corpus(spark, [(i, "the cat sat on the mat " * 3) for i in range(60)] + [(100, "zq@#!x9 " * 9), (101, None), (102, "")])
    got = {r.doc_id: r for r in quality.judge(docs, spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int"), least=3).collect()}
    assert len(got) == 63 and all(got[i].keep for i in range(60)) and not any(got[i].keep for i in (100, 101, 102)) and got[101].perplexity is None
    # probabilities of all bytes after one context add up to 1
    seen = [(0, int.from_bytes(b"abcd" + bytes([x]), "big"), n) for x, n in ((1, 3), (2, 1), (3, 2))]
    asked = [(0, int.from_bytes(b"abcd" + bytes([x]), "big"), 0) for x in range(4, 256)] + [(0, int.from_bytes(b"abcd\x00", "big"), 0)]
    p = quality.log_probabilities(spark.createDataFrame(seen + asked, "shard long, key long, n long")).select(F.sum(F.exp("logp"))).first()[0]
    assert 0.99 < p <= 1.0


def test_quality_threshold_resists_an_outlier(spark):
    good = [(i, "the cat sat on the mat " * 3) for i in range(400)]
    aside = next(i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0)
    good[aside] = (aside, "zq@#!x9 " * 9)  # one held-out trusted text is an outlier
    docs = corpus(spark, good + [(1000 + i, "mat mat mat mat cat cat cat the the " * 3) for i in range(5)])
    got = {r.doc_id: r.keep for r in quality.judge(docs, spark.createDataFrame([(i, 1) for i in range(400)], "doc_id long, quality int")).collect()}
    assert all(got[i] for i in range(400) if i != aside) and not any(got[1000 + i] for i in range(5))


def test_quality_threshold_of_small_languages(spark):
    aside = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 0]
    rest = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, "the cat sat on the mat " * 3, "en") for i in rest[:60] + aside[:60]] + [(i, "zq@#!x9 wv%&?k7 " * 4, "xx") for i in aside[60:70]] + [(3000, "the cat", "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(r[0], 1) for r in rows[:-1]], "doc_id long, quality int")
    at = {r.lang: r.threshold for r in quality.judge(docs, labels, quantile=0.5).select("lang", "threshold").distinct().collect()}
    assert at["en"] < at["xx"] and at["en"] == pytest.approx(at["yy"])  # ten held-out texts move a language's own threshold; none leave the pooled one
    assert quality.judge(docs, labels.limit(0)).where("threshold is null and keep").count() == len(rows)


def test_language(spark):
    en, de = "the house and the garden with this water ", "das haus und der garten mit diesem wasser nicht "
    docs = spark.createDataFrame([(i, (en if i % 2 else de) * 5, "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    pages = [(1, "http://a.de/x", f"<html lang=de><p>{de}</p>"), (2, "http://a.com", f"<script>{de}</script><p>{en}"), (3, "http://a.de/y", ""), (4, None, None), (5, "::", f"<p>{en}")] + [(10 + i, f"http://a.de/{i}", de) for i in range(9)]
    got = {r.page_id: r for r in language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert len(got) == len(pages) and [got[i].lang for i in (1, 2, 3, 5)] == ["de", "en", "de", "en"] and got[1].declared == "de" and got[3].host == "a.de"


def test_rare_language_has_a_model(spark):
    rows = [(i, "the house and the garden with this water", "en") for i in range(200)] + [(1000 + i, "talo ja puutarha tämän veden kanssa", "fi") for i in range(2)] + [(5, "hus och trädgård med detta vatten", "SV")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert language_id.fit_text(docs, max_docs=2)[0] == ["en", "fi", "sv"]


def test_quotations(spark):
    rows = [(1, 0, "user", "Hello there\nhow are you?"), (1, 1, "a", "> hello  there\n> How are you?\n\nFine."), (1, 2, "user", "New topic"), (1, 3, "a", ">> Hello there\n> Fine.\nGood!"), (1, 4, "a", "> unknown\nok"), (2, 0, "user", "> Fine."), (3, None, None, None), (None, 1, "u", ""), (1, 5, "a", "> New topic\n> Good!")]
    got = {(r.conv_id, r.turn): r for r in quotations.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(rows)
    assert [got[1, t].reply_to for t in range(6)] == [None, 0, None, 1, None, 3]
    assert [got[1, t].thread for t in range(6)] == [0, 0, 2, 0, 4, 0] and got[1, 5].depth == 3
    assert [got[1, t].position for t in (0, 1, 3, 5, 2, 4)] == list(range(6))
    assert got[1, 1].body == "Fine." and got[1, 3].body == "Good!" and got[2, 0].reply_to is None and got[2, 0].quotes == 1


def test_digest(spark):
    text = substring_dedup.remove_repeats(corpus(spark, [(1, " a  b ")])).select(F.sha2("kept_text", 256)).first()[0]
    assert text == hashlib.sha256(b"a b").hexdigest()
