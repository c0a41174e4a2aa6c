import tracemalloc

import pyarrow as pa

from diffmill.llm import lm_score as L
from diffmill.llm.common import PIECE, as_bytes, judged


def test_a_filter_on_the_result_does_not_judge_again(spark):
    """It did, in a second Python worker of each task."""
    seen = spark.sparkContext.accumulator(0)

    def make():
        def judge(text):
            seen.add(1)
            return {"n": len(text)}

        return judge

    docs = spark.createDataFrame([(i, "x" * i) for i in range(1, 7)], "doc_id long, text string")
    got = judged(docs, "doc_id", "text", make, "n bigint").where("n > 2").collect()
    assert sorted((r.doc_id, r.n) for r in got) == [(i, i) for i in range(3, 7)]
    assert seen.value == 6


def test_few_texts_are_python_objects_at_once():
    column = pa.array([*["x" * 1000] * (8 * PIECE), None, "é"])[1:]
    tracemalloc.start()
    n = sum(len(t or b"") for t in as_bytes(column))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1000 * (8 * PIECE - 1) + 2 and peak < 3000 * PIECE


def test_pieces_of_a_batch_keep_its_rows(spark):
    n = 2 * PIECE + 5
    docs = spark.range(n).selectExpr("id as doc_id", "if(id % 7 = 0, null, repeat('y', id % 50)) as text").coalesce(1)
    got = judged(docs, "doc_id", "text", lambda: lambda t: {"n": -1 if t is None else len(t)}, "n bigint").collect()
    assert sorted((r.doc_id, r.n) for r in got) == [(i, -1 if i % 7 == 0 else i % 50) for i in range(n)]


def test_words_are_numbered_once(spark):
    """The filter on their numbers numbered them again, in a second Python worker of each task."""
    seen = spark.sparkContext.accumulator(0)

    class Numbers(dict):
        def __contains__(self, word):
            seen.add(1)
            return dict.__contains__(self, word)

    words = [(f"w{i}".encode(), 10 - i) for i in range(8)]
    counted = spark.createDataFrame(words, "word binary, n bigint")
    rare, totals = L.shares(counted, Numbers({b"w0": 0, b"w1": 1}))
    assert sorted(bytes(r.word) for r in rare.collect()) == [w for w, _ in words[2:]]
    assert totals.sum() == sum(n for _, n in words[2:]) + L.UNSEEN * L.SHARED
    assert seen.value == 8
