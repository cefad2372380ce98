"""The pipeline on a small corpus, stage by stage, against brute force."""

import random
from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from test_llm import brute_cut, brute_near, corpus, words


def planted():
    """Texts, and the ids that are toxic and that hold a benchmark item."""
    rng = random.Random(11)
    texts = [(i, " ".join(words(rng, 30) + (["scumbag"] if i % 4 == 0 else []))) for i in range(300)]
    base = words(rng, 60, 5000)
    texts += [(1000 + k, " ".join(base[:59] + [f"end{k}"])) for k in range(5)] + [(1005, " ".join(base)), (1006, " ".join(base))]
    passage = words(rng, 70, 5000)
    texts += [(2000 + k, " ".join(words(rng, 40) + passage + words(rng, 40 + k))) for k in range(5)] + [(2010, " ".join(passage))]
    items = [(1, " ".join(words(rng, 25, 5000))), (2, None)]
    texts += [(3000 + k, " ".join(words(rng, 40) + items[0][1].split() + words(rng, 30))) for k in range(2)]
    texts += [(4000, None), (4001, ""), (None, " ".join(words(rng, 20)))]
    return texts, items, {i for i in range(0, 300, 4)}, {3000, 3001}


def water_filled(sizes):
    """Targets of sources by weights 5, 2, 1, repeating, in code point order with null last; none above three times its size."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, target = float(sum(sizes.values())), [s for s in names if sizes[s]], dict.fromkeys(names, 0.0)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 3 * sizes[s]]
        if not full:
            return target | share
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free = [s for s in free if s not in full]
    return target


def test_pipeline(spark, tmp_path):
    texts, items, toxic, leaks = planted()
    sf = str(tmp_path)
    docs = corpus(spark, texts)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    kept = [(i, t) for i, t in texts if i not in toxic]
    wanted = [kept]
    near = brute_near(kept)
    kept = [(i, t) for i, t in kept if near.get(i, i) == i]
    wanted.append(kept)
    cut = {i: (n, gone, text) for i, n, gone, text in brute_cut(kept, 50)}
    kept = [(i, t if not cut[i][1] else cut[i][2]) for i, t in kept if not cut[i][1] or cut[i][1] < cut[i][0]]
    wanted.append(kept)
    kept = [(i, t) for i, t in kept if i not in leaks]
    wanted.append(kept)
    assert len({len(x) for x in wanted}) == 4  # every stage takes something

    now = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES[:4], wanted, strict=True):
        now = stage(spark, now, sf)
        assert now.columns == docs.columns, name
        now.write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
        assert sorted(((r.doc_id, r.text) for r in now.collect()), key=str) == sorted(want, key=str), name
    changed = {i for i, (_, gone, _) in cut.items() if gone}
    assert all(r.n_chars == (len(r.text) if r.doc_id in changed else 0) for r in now.collect())

    source, text = {r.doc_id: r.source for r in docs.collect()}, dict(kept)
    sizes = defaultdict(int)
    for i, t in kept:
        sizes[source[i]] += len((t or "").split())
    target = water_filled(sizes)
    mixed = corpus_pipeline.run(spark, sf).collect()
    taken, copies = defaultdict(int), defaultdict(int)
    for r in mixed:
        assert r.text == text[r.doc_id] and r.size == len((r.text or "").split()) and r.source == source[r.doc_id]
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        taken[r.source] += r.size
        copies[r.doc_id] += 1
    largest = max(r.size for r in mixed)
    assert max(copies.values()) <= 3 and all(abs(taken[s] - target[s]) <= largest for s in sizes)
    key = lambda r: (str(r.doc_id), r["copy"])
    assert [tuple(r) for r in sorted(mixed, key=key)] == [tuple(r) for r in sorted(corpus_pipeline.run(spark, sf).collect(), key=key)]


def test_empty(spark, tmp_path):
    sf = str(tmp_path)
    corpus(spark, []).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_columns_that_clash(spark, tmp_path):
    """Columns with names that operators use within are carried by every stage but the last, unchanged."""
    sf = str(tmp_path)
    texts, items, toxic, _ = planted()
    names = ("chunk", "n_words", "n_removed", "kept_text", "removed", "row", "key", "content", "_id", "_key", "_again", "found", "score", "node", "size", "block", "shards", "copy", "id")
    docs = corpus(spark, texts).select("*", *(F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names))
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns, name
        now.write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
        rows = now.collect()
        assert rows and all(r[n] == f"{n}:{'none' if r.doc_id is None else r.doc_id}" for r in rows for n in names), name
    mixed = corpus_pipeline.STAGES[4][1](spark, now, sf)
    assert mixed.count() and {"doc_id", "text", "shard", "copy", "key", "content"} <= set(mixed.columns)
