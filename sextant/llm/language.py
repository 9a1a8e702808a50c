"""Languages of web pages by Bayesian fusion of four kinds of evidence.

- Text: hashed character trigrams under each language's distribution, fitted on labelled documents. Neighbouring
  trigrams are not independent, so the log likelihood is tempered to that of a bounded number of them.
- Declared language: the `lang` of the page's markup, by how often pages of each language declare each value.
- Address suffix: the host's last label and the language-like first part of the path, in the same way.
- Host: a prior smoothed hierarchically, the host's own pages towards its domain's and the domain's towards all.

The last three are tables of counts over all pages, taken by grouped aggregates of the text's own verdicts: sums
combine before the shuffle, so a host with a third of all pages is as cheap as any. Their rows come back to the pages
by joins on the host, domain, declaration and suffix, in which hot ones are broadcast. A page's own verdict is taken off
before they are used: it is heard once, as its text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import cut, join_hot

U = np.uint64
#: Bins of hashed trigrams; labelled documents that are fitted on, about, in all and of each language at least (or all it
#: has); trigrams that a text counts for at most; languages that can be told apart.
BINS, FIT_ROWS, FIT_LEAST, MOST, LANGUAGES = 1 << 14, 20_000, 200, 200, 1000
#: Strengths of the priors: of a domain over its hosts, of all pages over a domain, of a uniform one over a table.
HOST, DOMAIN, TABLE = 5.0, 10.0, 2.0


def _bins(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the trigrams inside words (with a space on either side), and the row of each; A-Z folded, digits left out."""
    buf, at = T.flat(column)
    if len(buf) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x = T._LOWER[buf]
    letter = ((x >= 97) & (x <= 122)) | (x >= 0x80)
    y = np.where(letter, x, 0x20).astype(U)
    key = y[:-2] | y[1:-1] << U(8) | y[2:] << U(16)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keep = (row[:-2] == row[2:]) & letter[1:-1]
    return (T.mix(key[keep]) % U(BINS)).astype(np.int64), row[:-2][keep]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for i, j in T.slices(batch.column(1)):
            part = batch.slice(i, j - i)
            bins, row = _bins(part.column(1))
            langs = part.column(0).to_pylist()
            for lang in set(langs):
                own = np.array([x == lang for x in langs])
                total[lang] = total.get(lang, 0) + np.bincount(bins[own[row]], minlength=BINS)
    for lang, n in total.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(n[some])], names=["lang", "bin", "n"])


def fitted(documents: DataFrame, fit_rows: int = FIT_ROWS, fit_least: int = FIT_LEAST) -> tuple[list[str], np.ndarray]:
    """Languages and the log probabilities of the bins under each, from a sample of about fit_rows labelled documents.

    Every language of the labelled documents is one; a rare one gives fit_least documents, or all that it has. More than
    LANGUAGES values are no languages: they are refused, never thinned out."""
    known = documents.select("lang", "doc_id", "text").filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"documents.lang has over {LANGUAGES} values")
    langs = sorted(sizes)
    if not langs:
        return [], np.full((0, BINS), 0.5)
    share = fit_rows / sum(sizes.values())
    # in 2**-32, as a share of a language with many documents may be below a millionth
    parts = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, math.ceil(min(1.0, max(share, fit_least / n)) * (1 << 32)))))
    sample = known.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32)) < F.element_at(parts, F.col("lang"))).select("lang", "text")
    rows = sample.mapInArrow(_counts, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()  # of the sample
    table = np.full((len(langs), BINS), 0.5)
    for r in rows:
        table[langs.index(r["lang"]), r["bin"]] += r["n"]
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def page_text(html: Column) -> Column:
    """The visible text of a page: no scripts, styles, comments, tags or entities.

    What is not closed goes on to the end, tags to the next one; so no part of a page is scanned again and again, and the
    time is in proportion to its length."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^<>]*+>.*?(?:</\1\s*+>|\z)|<!--.*?(?:-->|\z)|<[^<>]*+>?", " ")
    return F.regexp_replace(bare, r"&#?[A-Za-z0-9]{1,31};", " ")


def address(url: Column) -> dict[str, Column]:
    """Host, registered domain (its last two labels) and suffix of an address; empty where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?=[/?#.]|$)", 1))
    return {"host": host, "domain": F.regexp_extract(host, r"[^.]+\.[^.]+$|^[^.]*$", 0), "suffix": F.concat_ws("/", F.regexp_extract(host, r"[^.]*$", 0), path)}


def _likelihoods(langs: list[str], table: np.ndarray):
    @T.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in T.slices(batch.column("text")):
                part = batch.slice(i, j - i)
                bins, row = _bins(part.column("text"))
                n = np.bincount(row, minlength=len(part))
                weight = np.minimum(1, MOST / np.maximum(n, 1))
                ll = np.stack([np.bincount(row, weights=t[bins], minlength=len(part)) * weight for t in table], axis=1)
                ll -= ll.max(axis=1, keepdims=True)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * len(langs), pa.int32()), pa.array(ll.ravel()))
                sure = np.exp(ll)
                sure = sure / sure.sum(axis=1, keepdims=True) * (n > 0)[:, None]
                votes = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * len(langs), pa.int32()), pa.array(sure.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "host", "domain", "suffix", "declared")), values, votes], names=["page_id", "host", "domain", "suffix", "declared", "ll", "votes"])

    return run


def declared_language(html: Column) -> Column:
    """The language that a page's markup declares, or an empty text."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^<>]*?\blang\s*+=\s*+[\"']?([A-Za-z]{2,8})", 1))


def page_languages(pages: DataFrame, documents: DataFrame, fit_rows: int = FIT_ROWS, fit_least: int = FIT_LEAST) -> DataFrame:
    """page_id, lang, confidence, declared, host for each row of pages (page_id, url, html).

    lang is the language of the largest posterior, the first by name of equals; confidence is that posterior. Null and
    empty pages and addresses give no evidence: a page with none has the languages' overall shares. Rows are judged
    each, whatever their page_id; copies of a page are evidence for each other. Without labelled documents lang is null and
    confidence 0. A page of any length is taken whole and takes about 60 bytes of a task's memory for each of its own. Other
    columns are ignored, whatever their names. An empty table gives an empty result. The language model is fitted on a sample
    of fit_rows labelled documents, fit_least of each language at least.
    """
    langs, table = fitted(documents, fit_rows, fit_least)
    declared = declared_language(F.col("html"))
    ask = pages.select(F.col("page_id").cast("long"), F.coalesce(page_text(F.col("html")), F.lit("")).alias("text"), *(c.alias(k) for k, c in address(F.col("url")).items()), declared.alias("declared"))
    if not langs:
        return ask.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), "declared", "host")
    k = len(langs)
    seen = cut(ask.mapInArrow(_likelihoods(langs, table), "page_id long, host string, domain string, suffix string, declared string, ll array<double>, votes array<double>"))
    sums = [F.sum(F.element_at("votes", i + 1)).alias(f"v{i}") for i in range(k)]
    all_ = seen.agg(F.count("*").alias("pages"), *sums).first()
    total = [x or 0.0 for x in all_[1:]]
    overall = F.array(*(F.lit((x + 1) / (sum(total) + k)) for x in total))
    out = seen.withColumn("row", F.monotonically_increasing_id())
    for by in ("host", "domain", "declared", "suffix"):
        facts = cut(seen.groupBy(by).agg(F.count("*").alias("pages"), *sums).select(by, "pages", F.array(*(F.col(f"v{i}") for i in range(k))).alias(f"{by}_n")))
        out = join_hot(out, facts, by, "pages", all_["pages"], "row")
    smooth = "transform(zip_with(zip_with({n}, votes, (a, v) -> greatest(a - v, 0D)), {p}, (a, b) -> a + {w}D * b), x -> x / ({w}D + greatest(aggregate({n}, 0D, (s, y) -> s + y) - own, 0D)))"
    out = out.withColumn("own", F.expr("aggregate(votes, 0D, (s, y) -> s + y)")).withColumn("everyone", overall)
    out = out.withColumn("dp", F.expr(smooth.format(n="domain_n", p="everyone", w=DOMAIN))).withColumn("prior", F.expr(smooth.format(n="host_n", p="dp", w=HOST)))
    out = out.withColumn("t", F.array(*(F.lit(x) for x in total)))
    for by in ("declared", "suffix"):
        # P(value of by | language) up to a factor: its share of the language's other pages, smoothed by its share of all
        every = f"((greatest(aggregate({by}_n, 0D, (s, y) -> s + y) - own, 0D) + 1D) / ({sum(total)!r}D + 1D))"
        each = f"zip_with(zip_with({by}_n, votes, (a, v) -> greatest(a - v, 0D)), zip_with(t, votes, (b, v) -> greatest(b - v, 0D)), (a, b) -> ln((a + {TABLE}D * {every}) / (b + {TABLE}D)))"
        out = out.withColumn(f"{by}_ll", F.expr(f"if({by} = '', transform(ll, x -> 0D), {each})"))
    out = out.withColumn("posterior", F.expr("transform(sequence(0, size(ll) - 1), i -> ll[i] + declared_ll[i] + suffix_ll[i] + ln(prior[i]))"))
    out = out.withColumn("best", F.array_max("posterior"))
    sure = F.expr("1D / aggregate(posterior, 0D, (s, x) -> s + exp(x - best))")
    name = F.element_at(F.array(*(F.lit(x) for x in langs)), F.array_position("posterior", F.col("best")).cast("int"))
    return out.select("page_id", name.alias("lang"), sure.alias("confidence"), "declared", "host")
