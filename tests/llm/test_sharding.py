import itertools
import math
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash

from diffmill.llm import sharding as S
from diffmill.llm.queries import QUERIES
from tests.llm.plain import SCHEMA, empty, messy, messy_rows


@pytest.mark.parametrize("dimensions, bits", [(1, 5), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    index = S.hilbert_index(list(cells.T), bits)
    assert sorted(index) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def law(rows, n):
    counts = [sum(r.shard == s for r in rows) for s in range(8)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_law_order_and_pruning(spark):
    rows = [(i, "x" * (i % 50), "en" if i % 3 else "fr", "hot" if i % 2 else f"s{i % 5}", 0) for i in range(1003)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = S.shard(df).select("row.*", "size", "index", "rank", "shard", "slot").collect()
    law(got, 1003)
    by_rank = sorted(got, key=lambda r: r["rank"])
    assert [r["rank"] for r in by_rank] == list(range(1003))
    assert [r["index"] for r in by_rank] == sorted(r["index"] for r in got)
    assert [r.shard for r in by_rank] == sorted(r.shard for r in got)
    assert all(r["size"] == len(r.text.encode()) + 1 for r in got)
    # each shard holds few sources
    assert sum(len({r.source for r in got if r.shard == s}) for s in range(8)) < 8 * 5
    again = S.shard(df.repartition(5)).select("row.doc_id", "rank").collect()
    assert sorted(again) == sorted((r.doc_id, r["rank"]) for r in got)


def test_awkward_rows_and_query(spark, tmp_path):
    df = messy(spark)
    got = S.shard(df).select("row.text", "shard", "slot").collect()
    law(got, len(messy_rows()))
    assert S.shard(empty(spark)).collect() == []
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op9_hilbert_shards"](spark, str(tmp_path)).collect()
    law(out, len(messy_rows()))
    data = lambda t: (t or "").encode()
    assert sorted((r["size"], r.text_crc32) for r in out) == sorted((len(data(t)) + 1, zlib.crc32(data(t))) for _, t, *_ in messy_rows())


def cell_of(index, n=4, bits=8):
    """The cell of a place on the curve: the way back from the index, one place at a time."""
    x = [sum((index >> (b * n + n - 1 - i) & 1) << b for b in range(bits)) for i in range(n)]
    turn = x[-1] >> 1
    for i in range(n - 1, 0, -1):
        x[i] ^= x[i - 1]
    x[0] ^= turn
    for b in range(1, bits):
        low = (1 << b) - 1
        for i in range(n - 1, -1, -1):
            if x[i] >> b & 1:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
    return x


def plain_levels(values):
    known = [v for v in values if v is not None]
    low, high = min(known), max(known)
    return [0 if v is None or low == high else math.floor((v - low) / (high - low) * 255) for v in values]


@pytest.mark.parametrize("n", [1, 7, 900])
def test_query_against_a_plain_version(spark, tmp_path, n):
    rng = random.Random(3)
    texts = [None, "", "a", "äé" * 9] + ["x y " * rng.randrange(300) for _ in range(40)]
    pick = lambda *values: rng.choice(values)
    rows = [(i * i - 50, rng.choice(texts), pick("en", "de", None, ""), pick("hot", "hot", "web", None, "ärger"), 0) for i in range(n)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    data = [(r[1] or "").encode() for r in rows]
    first_six = lambda v: None if v is None else float(int.from_bytes(v.encode()[:6].ljust(6, b"\0"), "big"))
    dimensions = [
        [first_six(r[2]) for r in rows], [first_six(r[3]) for r in rows], [float(r[0]) for r in rows],
        [math.log(len(d) + 1) / math.log(2) for d in data],
    ]
    cells = {r[0]: list(levels) for r, levels in zip(rows, zip(*map(plain_levels, dimensions)))}
    got = {r.doc_id: r for r in QUERIES["op9_hilbert_shards"](spark, str(tmp_path)).collect()}
    assert len(got) == n
    for (i, *_), raw in zip(rows, data):
        r = got[i]
        assert cell_of(r["index"]) == cells[i]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    tie = lambda i: signed(xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42))
    order = sorted(got, key=lambda i: (got[i]["index"], tie(i), i))
    starts = [-(-s * n // 8) for s in range(9)]
    want = [(i, s, rank - starts[s]) for s in range(8) for rank, i in enumerate(order) if starts[s] <= rank < starts[s + 1]]
    assert [(i, got[i].shard, got[i].slot) for i in order] == want
