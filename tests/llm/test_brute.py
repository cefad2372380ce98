"""Operators that SQL does not express, against direct versions."""

import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import brute_near, corpus, odd, words

from tidemark.llm import decontamination, embedding_dedup, language_id, near_dedup, quality, quotations, toxicity


def test_toxicity_gradient():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 40).astype(float)
    owner = np.repeat(np.arange(40, dtype=np.int32), 5)
    kinds = [((10, 11), (12,), 3), ((13,), (10,), 1), ((99,), (98,), 2)]
    objective = toxicity.Objective(y, owner, rng.integers(0, 6, 200), np.array([10, 11, 12, 13, 14, 15]), kinds, 0.7, 0.1)
    w, b = rng.standard_normal(6), 0.3
    loss, grad, gb = objective(w, b)
    swaps = [w[2] - w[0] - w[1]] * 3 + [w[0] - w[3]] + [0.0] * 2
    z = b + np.array([w[objective.ids[owner == i]].sum() for i in range(40)])
    direct = np.mean(np.log1p(np.exp(z)) - y * z) + 0.05 * (w @ w) + 0.7 * np.mean(np.square(swaps))
    assert loss == pytest.approx(direct)
    for i in range(6):
        e = np.eye(6)[i] * 1e-6
        assert grad[i] == pytest.approx((objective(w + e, b)[0] - objective(w - e, b)[0]) / 2e-6, rel=1e-4, abs=1e-7)
    assert gb == pytest.approx((objective(w, b + 1e-6)[0] - objective(w, b - 1e-6)[0]) / 2e-6, rel=1e-4)


def test_toxicity_rows_and_order(spark):
    rng = random.Random(19)
    texts = [(i, " ".join(words(rng, 30) + (["scumbag", "women"] if i % 4 == 0 else []))) for i in range(200)] + [(900, None), (901, ""), (None, "x"), (902, "women " * 50_000), (5, "scumbag"), (5, "scumbag")]
    docs, marks = corpus(spark, texts), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    other = toxicity.fit(docs.repartition(7), marks.repartition(3))
    assert np.array_equal(model.weights, other.weights) and model.bias == other.bias and model.weights.any()
    for bias in (model.bias, 2.0):  # with a bias above 0 texts without features go
        m = toxicity.Model(bias, model.weights)
        scores = toxicity.score(docs, m).collect()
        assert len(scores) == len(texts)
        assert toxicity.clean(docs, m).count() == sum(r.score < 0.5 for r in scores)
    clash = docs.withColumn("score", F.lit("mine")).withColumn("id", F.lit(7))
    assert toxicity.clean(clash, model).columns == clash.columns
    assert toxicity.clean(docs.limit(0), model).count() == 0


def test_near_duplicates_by_row(spark):
    a, b = "a b c d e f g h", "unique text here now"
    rows = [(3, a), (6, a), (6, b), (6, "other words of the same document"), (None, "q w e r t y"), (None, "q w e r t y"), (None, a), (7, None), (7, None), (8, ""), (9, "x y z"), (9, "x y z")]
    docs = corpus(spark, rows)
    got = Counter(tuple(r) for r in near_dedup.near_duplicates(docs).collect())
    assert got == Counter([(3, 3, True), (6, 3, False), (6, 6, True), (6, 6, True), (None, None, True), (None, None, True), (None, 3, False), (7, 7, True), (7, 7, True), (8, 8, True), (9, 9, True), (9, 9, True)])
    kept = near_dedup.deduplicated(docs.withColumn("key", F.lit(1)).withColumn("_id", F.lit(2)).withColumn("content", F.lit(3)))
    want = [(3, a), (6, b), (6, "other words of the same document"), (7, None), (7, None), (8, ""), (9, "x y z"), (None, "q w e r t y")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str) and kept.columns[-3:] == ["key", "_id", "content"]
    assert near_dedup.deduplicated(docs.limit(0)).count() == 0


def test_large_groups_of_near_copies(spark):
    rng, texts = random.Random(23), []
    base = words(rng, 80)
    for i in range(400):  # one group of near copies, and texts that share a bucket without a link
        w = list(base)
        for _ in range(i % 3):
            w[rng.randrange(80)] = f"x{rng.random()}"
        texts.append((i, " ".join(w)))
    want = brute_near(texts)
    for options in ({}, {"small": 2, "star_rounds": 2}):
        assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(corpus(spark, texts), **options).collect()} == want


def test_decontamination_against_all_alignments(spark):
    rng = random.Random(3)
    items = [(i, [f"i{i}w{k}" for k in range(11 + i % 6)]) for i in range(60)]
    docs, want = [], {}

    def best(item, text):
        found = 0
        for d in range(-len(item) + 1, len(text)):
            same = [0 <= d + k < len(text) and item[k] == text[d + k] for k in range(len(item))]
            inside = [k for k in range(len(item)) if 0 <= d + k < len(text)]
            for x, y in itertools.combinations(inside, 2):
                n = y - x + 1
                if same[x] and same[y] and n >= min(13, len(item)) and sum(same[x : y + 1]) >= 0.8 * n - 1e-9:
                    found = max(found, n)
        return found

    for n in range(240):
        i, item = items[n % 60]
        changed = [f"z{n}k{k}" if k in places else x for places in [set(rng.sample(range(len(item)), rng.randrange(5)))] for k, x in enumerate(item)]
        text = [f"d{n}a"] * rng.randrange(3) + changed + [f"d{n}b"]
        docs.append((n, " ".join(text)))
        want[n] = {i: best(item, text)} if best(item, text) else {}
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    got = {r.doc_id: dict(zip(r.item_ids, r.spans, strict=True)) for r in decontamination.find_overlaps(corpus(spark, docs), bench).collect()}
    assert got == want and 50 < sum(map(bool, want.values())) < 230


def test_seeds_hit_all_placements():
    for n, k in ((11, 2), (12, 2), (13, 2), (14, 2), (15, 3), (16, 3)):
        for p in itertools.combinations(range(1, n - 1), k):
            assert any(all(m[i] == "0" or s + i not in p for i in range(len(m))) for m in decontamination.MASKS for s in range(n - len(m) + 1)), (n, p)


def traversal(a, b, n):
    """The heap form of the multi-sequence order."""
    i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen, out = [(a[i[0]] + b[j[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < n:
        _, p, q = heapq.heappop(heap)
        out.append((int(i[p]), int(j[q])))
        for x, y in ((p + 1, q), (p, q + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (a[i[x]] + b[j[y]], x, y))
    return out


def test_multi_sequence_order():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 30, 200):
        a, b = rng.random((20, 12)), rng.random((20, 12))
        i, j = embedding_dedup.multi_sequence(a, b, n)
        assert all(list(zip(i[r].tolist(), j[r].tolist(), strict=True)) == traversal(a[r], b[r], n) for r in range(20))


def test_embedding_recall(spark):
    """Many pairs near the threshold in a grid of 11 x 11 cells."""
    rng = np.random.default_rng(12)
    base = rng.standard_normal((1500, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((1500, 24))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.945, 0.97, (1500, 1))
    dense = base[:1] + 0.04 * rng.standard_normal((400, 24))  # one dense group
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * side, dense]).astype(np.float32)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    index = embedding_dedup.MultiIndex(u, len(u), 0.95, 0.998, per_cell=28)
    assert index.k >= 8 and index.visits < index.k**2 / 2
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(rows, block=256, per_cell=28).collect()}
    n = np.array([got[i].n_links for i in range(len(x))])
    assert (n <= near.sum(axis=1)).all() and n.sum() >= 0.99 * near.sum()
    pairs = near[:1500, 1500:3000].diagonal()
    found = np.array([got[i].component_id == got[1500 + i].component_id for i in range(1500)])
    assert pairs.sum() > 500 and found[pairs].mean() >= 0.99


def direct_perplexities(texts, trusted):
    order, start = 5, b"\xff" * 4
    grams = lambda t: [(start + t)[i : i + order] for i in range(len(t))]
    levels = {order: Counter(g for i, t in texts if i in trusted for g in grams(t))}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    d = {k: quality.discounts(*(sum(c == i for c in levels[k].values()) for i in (1, 2, 3, 4))) for k in levels}
    totals = {k: defaultdict(lambda: [0, 0, 0, 0]) for k in levels}
    for k, level in levels.items():
        for g, c in level.items():
            totals[k][g[:-1]][0] += c
            totals[k][g[:-1]][min(c, 3)] += 1

    def p(g):
        if not g:
            return 1 / 257
        q, k = p(g[1:]), len(g)
        total, *n = totals[k].get(g[:-1], (0, 0, 0, 0))
        if not total:
            return q
        c = levels[k][g]
        return (c - (d[k][min(c, 3) - 1] if c else 0) + sum(a * b for a, b in zip(d[k], n, strict=True)) * q) / total

    return [(i, math.exp(-sum(math.log(p(g)) for g in grams(t)) / len(t)) if t else None) for i, t in texts]


@pytest.mark.parametrize("fan", [256, 4])
def test_kneser_ney_against_direct_counts(spark, fan):
    rng = random.Random(31)
    texts = [(i, " ".join(words(rng, rng.randrange(1, 30), 40))) for i in range(40)] + [(50, "zq@#!x9 ünï"), (51, None), (52, ""), (5, "another text of a trusted id"), (7, "twice"), (7, "twice"), (None, "w1 w2 w3"), (60, " ".join(words(rng, 3000, 300)))]
    trusted = set(range(20))
    docs = corpus(spark, texts)
    got = sorted(((r.doc_id, r.perplexity) for r in quality.perplexities(docs, spark.createDataFrame([(i,) for i in trusted] + [(None,)], "doc_id long"), chunk_chars=300, shard_chars=500, fan=fan).collect()), key=str)
    want = sorted(direct_perplexities([(i, (t or "").encode()) for i, t in texts], trusted), key=str)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(a is b is None or a == pytest.approx(b, rel=1e-4) for (_, a), (_, b) in zip(got, want, strict=True))
    flat = quality.perplexities(docs, spark.createDataFrame([], "doc_id long")).where("perplexity is not null").select(F.min("perplexity"), F.max("perplexity")).first()
    assert flat[0] == pytest.approx(257, rel=1e-3) and flat[1] == pytest.approx(257, rel=1e-3)
    assert quality.judge(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


def test_fusion_against_counts_by_hand(spark):
    en, de = "the house and the garden with this water", "das haus und der garten mit diesem wasser nicht"
    docs = spark.createDataFrame([(i, (en if i % 2 else de) * 5, "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    pages = [(i, f"http://{'x' if i % 3 else 'y'}.{'de' if i % 3 else 'com'}/{i}", f"<html{' lang=de' if i % 4 == 0 else ''}><p>{de if i % 3 else en}") for i in range(60)]
    pages += [(100, "http://x.de/", "<p>in den"), (101, "http://y.com/", "<p>in den"), (102, "http://x.de/", ""), (103, None, None), (104, "http://new.de", "<p>ok"), (105, "http://new.com", "<html lang=de>ok"), (100, "http://x.de/", "<p>in den"), (None, "http://y.com", "a"), (106, "http://y.com", f"<script>{de * 999}</script>" + en * 3000)]
    kappa, temper, million = 5.0, 0.1, 1_000_000
    names, table = language_id.fit_text(docs)
    table = (table * temper).astype(np.float32).astype(np.float64)
    seen, add = [], lambda d, k, post: d.setdefault(k, np.zeros(2)).__iadd__(post)
    host, suffix, declared = {}, {}, {}
    for i, url, page in pages:
        n = np.bincount(language_id.trigrams(language_id.text_of(page or "")), minlength=language_id.BUCKETS)
        ll = table @ n
        ll -= ll.max()
        post = np.rint(np.exp(ll) / np.exp(ll).sum() * million)
        row = (i, *language_id.host_of(url), language_id.declared_in(page or ""), ll, post)
        seen.append(row)
        for d, k in ((host, row[1]), (suffix, row[2]), (declared, row[3])):
            add(d, k, post)
    g = sum(r[5] for r in seen)
    prior = (g + million) / (g.sum() + 2 * million)
    want = []
    for i, h, s, says, ll, post in seen:
        wide = (suffix[s] - post + kappa * million * prior) / (suffix[s].sum() - post.sum() + kappa * million)
        close = (host[h] - post + kappa * million * wide) / (host[h].sum() - post.sum() + kappa * million)
        score = ll + np.log(close) + (np.log((declared[says] - post + million) / (g + 20 * million)) if says else 0)
        p = np.exp(score - score.max())
        want.append((i, names[int(score.argmax())], float(p.max() / p.sum())))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = sorted(((r.page_id, r.lang, r.confidence) for r in language_id.identify(frame, docs).collect()), key=str)
    want.sort(key=str)
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-6)
    lang = {r[0]: r[1] for r in want}
    assert lang[100] == "de" and lang[101] == "en" and lang[102] == "de"  # the host decides where the text does not
    none = language_id.identify(frame, docs.limit(0)).collect()
    assert len(none) == len(pages) and all(r.lang is None and r.host is not None for r in none)
    assert language_id.identify(frame.limit(0), docs).count() == 0


def test_markup_in_linear_time():
    assert language_id.shown("a<script x>b</script>c<!--d-->e<style>f") == "a c e<style>f"
    for page in ("<script>" * 100_000, "<!-- " * 100_000 + "-->", "<" * 300_000, "<meta content-language " * 50_000, "<html " * 100_000):
        language_id.text_of(page)
        language_id.declared_in(page)


def direct_links(rows):
    """reply_to, thread, depth and place of messages (conv, turn, role, text) with distinct turns."""
    quote = re.compile(r"^[ \t]*((?:>[ \t]*)+)")
    normal = lambda x: re.sub(r"\s+", " ", x.lower(), flags=re.ASCII).strip(" ")

    def units(text):
        out, run = set(), []
        for line in [*re.split(r"\r\n?|\n", text or ""), None]:
            m = quote.match(line) if line is not None else None
            level, body = (m[1].count(">") if m else 0), (line or "")[m.end() if m else 0 :].strip(" ")
            if run and (line is None or body == "" or run[0][0] != level):
                out.add((run[0][0], normal(" ".join(b for _, b in run))))
                run = []
            if line is not None and body:
                run.append((level, body))
                out.add((level, normal(body)))
        return out

    parsed = {(c, t): units(x) for c, t, _, x in rows}
    first = {}
    for (c, t), us in parsed.items():
        for level, u in us:
            if level == 0:
                first[c, u] = min(first.get((c, u), t), t)
    reply = {}
    for (c, t), us in parsed.items():
        found = [(level, -first[c, u]) for level, u in us if level and first.get((c, u), t) < t]
        reply[c, t] = -min(found)[1] if found else None

    def root(c, t):
        depth = 0
        while reply[c, t] is not None:
            t, depth = reply[c, t], depth + 1
        return t, depth

    out = {}
    for c in {r[0] for r in rows}:
        order = sorted((root(c, t)[0], t) for cc, t in parsed if cc == c)
        for place, (thread, t) in enumerate(order):
            out[c, t] = (reply[c, t], thread, root(c, t)[1], place)
    return out


def test_quotations_against_a_direct_linker(spark):
    rng, rows = random.Random(41), []
    for conv in range(6):
        said = []
        for turn in range(30 if conv else 700):
            lines = []
            if said and rng.random() < 0.8:
                for _ in range(rng.randrange(1, 3)):
                    quoted = rng.choice(said[-8:])
                    lines += [rng.choice(["> ", ">", " > "]) + x.replace("  ", " ") for x in (quoted if rng.random() < 0.7 else quoted[:1])]
                    if rng.random() < 0.5:
                        lines.append("")
            own = [rng.choice(["Yes", "no  way", "maybe"]) if rng.random() < 0.1 else f"line {conv} {turn} {k} {rng.choice('abc')}" for k in range(rng.randrange(1, 4))]
            lines += [*own, *(["", "and more"] if rng.random() < 0.2 else [])]
            said.append(lines)
            rows.append((conv, turn, "user" if turn % 2 else "bot", rng.choice(["\n", "\r\n"]).join(lines)))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = quotations.link(frame.withColumn("level", F.lit(1)).withColumn("hash", F.lit("x")))
    seen = {(r.conv_id, r.turn): (r.reply_to, r.thread, r.depth, r.position) for r in got.collect()}
    want = direct_links(rows)
    assert seen == want
    assert sum(x[0] is not None for x in want.values()) > 300 and max(x[2] for x in want.values()) > 5
    parts = quotations.chats(got).collect()
    assert Counter(r.conv_id for r in parts) == Counter([0, 0, 1, 2, 3, 4, 5]) and sum(len(r.messages) for r in parts) == len(rows)
    assert all([m.position for m in r.messages] == sorted(m.position for m in r.messages) for r in parts)
    assert all(not line.lstrip().startswith(">") for r in parts for m in r.messages for line in m.body.split("\n"))


def test_quotations_odd_rows(spark):
    rows = [(1, 0, "u", "Hello"), (1, 1, "a", "> hello\nx"), (1, 1, "a", "> hello\nx"), (1, None, "u", "> Hello"), (None, 0, "u", "> Hello"), (None, None, None, None), (2, 0, "u", ""), (3, 0, "u", "word " * 60_000), (3, 1, "a", "> " + "word " * 60_000)]
    got = quotations.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    assert [r.reply_to for r in got if (r.conv_id, r.turn) == (1, 1)] == [0, 0] and sorted(r.position for r in got if r.conv_id == 1) == [0, 1, 2, 3]
    assert [r.reply_to for r in got if (r.conv_id, r.turn) == (3, 1)] == [0]
    assert all(r.reply_to is None for r in got if r.conv_id is None or r.turn is None)
    assert quotations.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_held_out_by_crc(spark):
    got = corpus(spark, odd(spark)).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_first_of_each_language(spark):
    rows = spark.range(9000).selectExpr("id", "case when id % 3 > 0 then 'a' when id % 90 = 0 then 'b' else 'c' end as l")
    rows = rows.unionByName(rows.where("id < 40"))  # repeated rows
    want: dict[str, list] = {}
    for r in rows.withColumn("h", F.xxhash64("id")).collect():
        want.setdefault(r.l, []).append((r.h, r.id))
    for k in (1, 50, 101, 5000):
        got: dict[str, list] = {}
        for r in language_id.first_of_each(rows, k).collect():
            got.setdefault(r.l, []).append(r.id)
        assert {x: sorted(y) for x, y in got.items()} == {x: sorted(i for _, i in sorted(y)[:k]) for x, y in want.items()}
    assert language_id.first_of_each(rows.limit(0), 5).count() == 0
