import random

from diffmill.llm import decontaminate as D
from diffmill.llm.queries import QUERIES
from tests.llm.plain import contamination, empty, messy, messy_rows, plain_words, sha


def tables(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(40)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([20, 13, 15, 4, 1, 30, 13])]
    items += [(7, None), (8, "  .. "), (9, items[0][1]), (2, items[2][1]), (10, " ".join(["w1"] * 20))]
    docs = []
    for i in range(60):
        words = [word() for _ in range(rng.randrange(5, 200))]
        for _ in range(rng.randrange(3)):
            own = (rng.choice(items)[1] or "").upper().split()
            cut = rng.randrange(0, 4)
            at = rng.randrange(len(words))
            words[at:at] = own[cut:]
        docs.append((i, (", " if i % 2 else " ").join(words)))
    docs += [(60, " ".join(["W1"] * 50)), (61, None), (62, ""), (63, items[4][1]), (None, items[0][1])]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), docs, items


def test_agrees_with_a_plain_search_in_any_number_of_blocks(spark):
    docs, bench, rows, items = tables(spark)
    want = sorted((str(i), *contamination(t, items)) for i, t in rows)
    for block_bytes in (10**6, 100):
        got = D.find_contamination(docs, bench, block_bytes=block_bytes)
        found = sorted((str(r.doc_id), r.n_words, sum(h.end - h.start for h in r.hits), r["items"]) for r in got.collect())
        assert found == want


def test_query_columns(spark, tmp_path):
    docs, bench, rows, items = tables(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for r in QUERIES["op2_decontaminate"](spark, str(tmp_path)).collect():
        n, hit, found = contamination(dict(rows)[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, hit, len(found), sha(found))
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_awkward_rows(spark):
    items = [(1, "one"), (2, "same text here for all five rows"), (None, "equal texts of many rows equal texts of many rows equal texts of")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_contamination(messy(spark), bench).collect()
    assert len(got) == len(messy_rows())
    assert {r.doc_id for r in got if r["items"]} == {3, 20}
    assert {r.doc_id for r in got if r.hits} == {3, 20, *range(30, 36)}
    none = D.find_contamination(messy(spark), bench.limit(0)).collect()
    assert not any(r.hits for r in none) and sum(r.n_words for r in none) == sum(len(plain_words(t)) for _, t, *_ in messy_rows())
    assert D.find_contamination(empty(spark), bench).collect() == []


def test_dropping_keeps_all_columns(spark):
    bench = spark.createDataFrame([(1, "one"), (2, "same text here for all five rows")], "item_id long, text string")
    rows = D.drop_contaminated(messy(spark), bench)
    assert rows.columns == messy(spark).columns and rows.count() == len(messy_rows()) - 4
