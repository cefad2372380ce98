"""Language identification by Bayesian evidence fusion.

Evidence on a page: the likelihood of its text under character trigram models; the language its markup declares, through
how often pages of each language declare it; and a prior for its host, smoothed towards the prior of its address suffix,
which is smoothed towards that of all pages. Declarations and priors are counted over all pages by grouped aggregation,
from each page's text posterior in whole millionths, so sums don't depend on the order. A page's own part is taken out
of its host's and suffix's counts.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable

BUCKETS = 1 << 16
MILLION = 1_000_000
HIDDEN = re.compile(r"<(?:(script|style|noscript|template)\b|!--)", re.I)
ENDS = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template")} | {"": re.compile("-->")}
TAG = re.compile(r"<[^<>]*>")
HEAD = re.compile(r"<(html|meta)\b([^<>]*)>", re.I)
LANG = re.compile(r"\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)
CONTENT = re.compile(r"\bcontent\s*=\s*[\"']?\s*([A-Za-z]{2,3})(?:\b|_)", re.I)
HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)")


def shown(page: str) -> str:
    """The page without comments and what scripts, styles and templates hold; what never ends is not taken out.

    Each kind of end is searched for at most once beyond what is taken out, so the time is linear in the page.
    """
    out, at, missing = [], 0, set()
    while m := HIDDEN.search(page, at):
        kind = (m[1] or "").lower()
        end = None if kind in missing else ENDS[kind].search(page, m.end())
        if end is None:
            missing.add(kind)
        out.append(page[at : m.start()] if end else page[at : m.end()])
        out.append(" " if end else "")
        at = end.end() if end else m.end()
    out.append(page[at:])
    return "".join(out)


def text_of(page: str) -> str:
    return html.unescape(TAG.sub(" ", shown(page)))


def declared_in(page: str) -> str:
    """The primary subtag of the declared language in lower case, or '': that of the html tag, else content-language, else og:locale."""
    found: dict[str, str] = {}
    for tag, rest in HEAD.findall(page):
        lower = rest.lower()
        kind = "html" if tag.lower() == "html" else next((x for x in ("content-language", "og:locale") if x in lower), None)
        if kind and kind not in found and (m := (LANG if kind == "html" else CONTENT).search(rest)):
            found[kind] = m[1].lower()
    return found.get("html") or found.get("content-language") or found.get("og:locale") or ""


def host_of(url: str | None) -> tuple[str, str]:
    """Host in lower case and its last label, or ''."""
    m = HOST.match(url or "")
    host = m[1].lower().rstrip(".") if m else ""
    last = host.rpartition(".")[2]
    return host, last if last.isalpha() else ""


def trigrams(text: str) -> np.ndarray:
    """Buckets of the character trigrams of lower-case text, white space and digits as one separator."""
    t = re.sub(r"[\W\d_]+", " ", text.lower())
    c = np.frombuffer(f" {t} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.empty(0, np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:]
    return ((h * np.uint64(0x165667B19E3779F9)) >> np.uint64(48)).astype(np.int64)


def first_of_each(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows (id, l) of each l with the smallest hashes of id, equal ones by id.

    Rows are counted by the leading 16 bits of the hash first, so a task that ranks gets about k + n / 65,536 rows of an l with
    n rows; one row for each l is broadcast, and the models hold 65,536 numbers for each of them anyway.
    """
    rows = rows.withColumn("part", F.shiftright(F.xxhash64("id"), 48))
    counts = rows.groupBy("l", "part").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(W.partitionBy("l").orderBy("part")))
    ends = upto.groupBy("l").agg(F.coalesce(F.min(F.when(F.col("upto") >= k, F.col("part"))), F.max("part")).alias("end"))
    near = rows.join(F.broadcast(ends), "l").where("part <= end")
    rank = F.row_number().over(W.partitionBy("l").orderBy(F.xxhash64("id"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "l")


def fit_text(docs: DataFrame, max_docs: int = 4000) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-probabilities of trigram buckets (languages x BUCKETS), from whole texts of at most ``max_docs`` labelled rows of each language."""
    spark = docs.sparkSession
    labelled = docs.where("doc_id is not null and lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), F.lower("lang").alias("l"))
    ids = first_of_each(labelled, max_docs).toArrow()
    if not ids.num_rows:
        return [], np.zeros((0, BUCKETS))
    sample = spark.createDataFrame(ids).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column("l").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by[lang] = by.get(lang, 0) + np.bincount(trigrams(text), minlength=BUCKETS)
            for lang, n in by.items():
                at = np.flatnonzero(n)
                yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["l", "bucket", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.lower("lang").alias("l"), "text").where("text is not null").join(F.broadcast(sample), ["id", "l"]).select("l", "text")
    found = rows.mapInArrow(count, "l string, bucket long, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found.column("l").to_pylist()))
    counts = np.full((len(names), BUCKETS), 0.1)
    np.add.at(counts, (np.array([names.index(x) for x in found.column("l").to_pylist()], np.int64), found.column("bucket").to_numpy()), found.column("n").to_numpy())
    return names, np.log(counts / counts.sum(axis=1, keepdims=True))


def identify(pages: DataFrame, docs: DataFrame, max_docs: int = 4000, temper: float = 0.1, kappa: float = 5.0) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, host and suffix of every row of ``pages`` (page_id, url, html; other
    columns are ignored).

    Text models are fitted on labelled rows of ``docs`` (doc_id, text, lang). ``temper`` scales the text's log-likelihood
    (neighbouring trigrams overlap), ``kappa`` is the weight, in pages, of the wider prior. A null or empty page has no
    text evidence and gets what its address says; pages of any length are read whole; without labelled documents lang,
    confidence and text_lang are null. Ties: the first language in code point order. Repeated rows, and rows of one or no
    page_id, each count and get a row each; an empty table gives none.
    """
    names, table = fit_text(docs, max_docs)
    shipped = pages.sparkSession.sparkContext.broadcast((table * temper).astype(np.float32))  # languages x 65,536
    langs = range(len(names))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        for batch in batches:
            out = []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = np.bincount(trigrams(text_of(page or "")), minlength=1)
                at = np.flatnonzero(n)
                ll = (table[:, at].astype(np.float64) * n[at]).sum(axis=1)
                ll -= ll.max(initial=-np.inf)
                p = np.exp(np.maximum(ll, -600))
                out.append((*host_of(url), declared_in(page or ""), ll.tolist(), np.rint(p / max(p.sum(), 1.0) * MILLION).astype(np.int64).tolist()))
            host, suffix, declared, ll, post = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.record_batch([batch.column(0), pa.array(host, pa.string()), pa.array(suffix, pa.string()), pa.array(declared, pa.string()), pa.array(ll, pa.list_(pa.float64())), pa.array(post, pa.list_(pa.int64()))], ["page_id", "host", "suffix", "declared", "ll", "post"])

    seen = durable(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(read, "page_id long, host string, suffix string, declared string, ll array<double>, post array<long>"))

    if not names:
        return seen.select("page_id", *(F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("confidence", "double"), ("text_lang", "string"))), "declared", "host", "suffix")

    def summed(name: str) -> Column:
        return F.array(*(F.sum(F.col("post")[i]) for i in langs)).alias(name)

    everywhere = seen.agg(summed("g"), F.count("*").alias("n")).first()  # one row
    g = [(x or 0) for x in everywhere["g"]]
    prior = [(x + MILLION) / (sum(g) + MILLION * len(names)) for x in g]
    by_suffix = seen.groupBy("suffix").agg(summed("in_suffix"), F.count("*").alias("_n"))
    by_host = seen.groupBy("host").agg(summed("in_host"), F.count("*").alias("_n"))
    by_declared = seen.groupBy("declared").agg(summed("in_declared"), F.count("*").alias("_n"))

    def joined_with(rows: DataFrame, by: DataFrame, key: str, name: str) -> DataFrame:
        """Keys of a thousandth of all pages or more (at most 1000 by that) are joined by broadcast, and their pages spread over the join of the others."""
        by, least = durable(by), everywhere["n"] / 1000
        hot = by.where(F.col("_n") >= least).select(F.col(key), F.col(name).alias("_hot"))
        rows = rows.join(F.broadcast(hot), key, "left")
        at = F.when(F.col("_hot").isNull(), F.struct(F.col(key).alias("k"), F.lit(0).cast("long").alias("s"))).otherwise(F.struct(F.lit("").alias("k"), (F.pmod(F.xxhash64("page_id"), F.lit(100_000)) + 1).alias("s")))
        cold = by.where(F.col("_n") < least).select(F.struct(F.col(key).alias("k"), F.lit(0).cast("long").alias("s")).alias("_at"), name)
        return rows.withColumn("_at", at).join(cold, "_at", "left").withColumn(name, F.coalesce("_hot", name)).drop("_hot", "_at")

    joined = joined_with(joined_with(joined_with(seen, by_host, "host", "in_host"), by_suffix, "suffix", "in_suffix"), by_declared, "declared", "in_declared")
    post = F.col("post")

    def total(name: str) -> Column:
        return F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + x)

    scores = []
    for i in langs:
        wide = (F.greatest(F.col("in_suffix")[i] - post[i], F.lit(0)) + kappa * MILLION * prior[i]) / (F.greatest(total("in_suffix") - total("post"), F.lit(0)) + kappa * MILLION)
        near = (F.greatest(F.col("in_host")[i] - post[i], F.lit(0)) + kappa * MILLION * wide) / (F.greatest(total("in_host") - total("post"), F.lit(0)) + kappa * MILLION)
        says = (F.greatest(F.col("in_declared")[i] - post[i], F.lit(0)) + MILLION) / (max(g[i], 1) + 20.0 * MILLION)
        scores.append(F.col("ll")[i] + F.log(near) + F.when(F.col("declared") == "", 0.0).otherwise(F.log(says)))
    named = joined.withColumn("s", F.array(*scores)).withColumn("top", F.array_max("s"))
    best = F.array_position("s", F.col("top"))
    spread = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    all_names = F.array(*map(F.lit, names))
    return named.select(
        "page_id", F.element_at(all_names, best.cast("int")).alias("lang"), F.round(1 / spread, 6).alias("confidence"), F.element_at(all_names, F.array_position("post", F.array_max("post")).cast("int")).alias("text_lang"), "declared", "host", "suffix"
    )
