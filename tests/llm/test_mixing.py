import random

import pytest
from pyspark.sql import functions as F

from diffmill.llm import mixing as M
from tests.llm.plain import SCHEMA, empty, messy, messy_rows, mix_targets, prose, white_words


def corpus():
    rng = random.Random(8)
    sources = ["b", "a", "ä", None, "Z", "tiny", "none"]
    rows = [(i, prose(rng, rng.randrange(1, 60)), "en", "a" if i % 3 else rng.choice(sources[:-2]), 0) for i in range(600)]
    return rows + [(900, "just three words", "en", "tiny", 0), (901, "", "en", "none", 0), (902, None, "en", "none", 0)]


def sizes(rows):
    total = {}
    for _, text, _, source, _ in rows:
        total[source] = total.get(source, 0) + len(white_words(text))
    return total


@pytest.mark.parametrize("rows", [corpus(), messy_rows()])
def test_targets_and_taken_words(spark, rows):
    got = M.mix_sources(spark.createDataFrame(rows, SCHEMA)).select("row.*", "size", "source_size", "target", "copies").collect()
    assert len(got) == len(rows)
    own, want, taken, largest = sizes(rows), mix_targets(sizes(rows)), {}, {}
    for r in got:
        assert r.size == len(white_words(r.text)) and r.source_size == own[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    repeats = 6  # equal rows are taken together
    assert all(abs(taken[s] - want[s]) <= largest[s] * (repeats if rows is not corpus and len(rows) < 100 else 1) for s in want)


def test_selection_is_the_prefix_by_key(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    keys = df.select("doc_id", M.sampling_key(df.doc_id, df.text, M.size_of(df.text)).alias("k")).collect()
    key = {r.doc_id: r.k for r in keys}
    want, got = mix_targets(sizes(rows)), {}
    for r in M.mix_sources(df).select("row.*", "size", "copies").collect():
        got.setdefault(r.source, []).append((key[r.doc_id], r.size, r.copies))
    for source, docs in got.items():
        total = sum(n for _, n, _ in docs)
        epochs = int(want[source] // total) if total else 0
        ahead, rest = 0, want[source] - epochs * total
        for _, n, copies in sorted(docs):
            if n:
                assert copies == epochs + (rest > 0 and ahead + n / 2 <= rest)
            ahead += n


def test_quality_weight_and_reruns(spark):
    rows = [(i, "a b c d ###" if i % 2 else "a b c d e", "en", "big" if i < 4000 else "small", 0) for i in range(8000)]
    df = spark.createDataFrame(rows, SCHEMA)
    first = M.mix_sources(df).selectExpr("row.doc_id", "copies").collect()
    again = M.mix_sources(df.repartition(3)).selectExpr("row.doc_id", "copies").collect()
    assert sorted(first) == sorted(again)
    once = [r for r in first if r.doc_id >= 4000 and r.copies > min(x.copies for x in first if x.doc_id >= 4000)]
    if once:
        assert sum(r.doc_id % 2 for r in once) < 0.45 * len(once)


@pytest.mark.parametrize("symbols", [0, 0.5, 1, 5])
def test_no_bucket_holds_much_of_a_source(spark, symbols):
    n, buckets = 40_000, 200
    text = " ".join(["word"] * 6) + "#" * int(6 * symbols)
    df = spark.range(n).select(M.sampling_key(F.col("id"), F.lit(text), F.lit(6)).alias("key"))
    largest = df.groupBy(M._bucket(buckets)).count().agg(F.max("count")).first()[0]
    assert largest < 2 * n / (2.718 * buckets)


def test_awkward_rows(spark):
    df = messy(spark)
    mixed = M.mixed_rows(df)
    assert mixed.columns == df.columns and mixed.where("text is null or text = ''").count() == 0
    assert M.mix_sources(empty(spark)).collect() == [] and M.mixed_rows(empty(spark)).collect() == []
