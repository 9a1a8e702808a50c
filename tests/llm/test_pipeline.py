"""The pipeline's stages against plain Python."""

import re

import pytest

import corpus_pipeline as P
from sextant.llm import minhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage gave, by name, with what it was given."""
    out = {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES:
        where = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(where)
        out[name] = docs, spark.read.parquet(where)
        docs = out[name][1]
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "personal_data", "mixture", "packing"]
    for name, (_, after) in list(stages.items())[:-1]:
        assert after.columns == P.COLUMNS, name


def test_quality(spark, stages):
    before, after = (by_id(df) for df in stages["quality"])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1 and i in before]
    bad = [i for i, q in labels.items() if q == 0 and i in before]
    assert sum(i in after for i in good) >= 0.97 * len(good) and sum(i in after for i in bad) <= 0.1 * len(bad)
    assert all(before[i] == after[i] for i in after)


def test_near_duplicates(stages):
    before, after = (by_id(df) for df in stages["near_duplicates"])
    kept = {r.doc_id for r in minhash.near_duplicates(stages["near_duplicates"][0]).collect() if r.kept}
    assert set(after) == kept and all(before[i] == after[i] for i in after)


def test_personal_data(stages):
    before, after = (by_id(df) for df in stages["personal_data"])
    assert set(before) == set(after)
    private = re.compile(r"\b4\d{15}\b|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{1,3}(?:\.\d{1,3}){3}\b|\S+@\S+\.com|AKIA\w{16}")
    for i, r in before.items():
        for v in private.findall(r.text):
            if not v.startswith("4") or v not in after[i].text:
                assert v not in after[i].text
        if not re.search(r"\d", r.text):
            assert after[i].text == r.text
        assert after[i].n_chars == len(after[i].text)


def test_mixture(stages):
    """Each row is a stretch of its document, and a document's rows have the words that the mix takes of it."""
    before, after = stages["mixture"]
    whole = by_id(before)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    taken = {}
    for r in after.collect():
        assert r.text.strip() in whole[r.doc_id].text and r.n_chars == len(r.text) and r.source == whole[r.doc_id].source
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(words(r.text))
    size = {i: len(words(r.text)) for i, r in whole.items()}
    assert sum(taken.values()) > 0.9 * sum(size.values()) and all(n <= 3 * size[i] for i, n in taken.items())


def test_packing(stages):
    docs, pieces = stages["packing"]
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert pieces.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 2048").isEmpty()


def test_edge_rows_pass_all_stages(spark, docs, empty):
    for df in (docs, empty):
        for name, stage in P.STAGES[:-1]:
            df = spark.createDataFrame(stage(spark, df, SF).collect(), "doc_id long, text string, lang string, source string, n_chars long")
            assert df.columns == P.COLUMNS, name
        P.STAGES[-1][1](spark, df, SF).count()


def test_run(spark):
    got = P.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns) and got.count() > 0


def test_mixture_has_the_drawn_blocks(spark):
    """The words of the drawn blocks, as often as drawn, of long documents and of rows without doc_id or with one twice."""
    from collections import Counter

    from sextant.llm.mixing import mixed_blocks

    sizes = [(1, 700, "a"), (2, 90, "a"), (None, 300, "a"), (None, 300, "a"), (3, 2000, "b"), (3, 2000, "b"), (4, 900, "c"), (None, 40, "c")]
    rows = [(i, " ".join(f"d{k}w{j}" for j in range(n)), "en", s, 0) for k, (i, n, s) in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    out = [r.text.split() for r in P.mixture(spark, docs, SF).collect()]
    for words in out:  # a row is a stretch of one document
        k, first = re.fullmatch(r"d(\d+)w(\d+)", words[0]).groups()
        assert words == [f"d{k}w{int(first) + j}" for j in range(len(words))]
    placed, slots = mixed_blocks(docs.selectExpr("*", "cast(regexp_extract(text, 'd([0-9]+)w', 1) as bigint) as k"), keep=("k",))
    times = Counter((r.sid, r.block) for r in slots.collect())
    want = Counter()
    for r in placed.collect():
        want.update({f"d{r.k}w{j}": times[r.sid, (r.start + j) // 64] for j in range(r.size)})
    assert Counter(w for words in out for w in words) == +want
