"""MinHash near duplicates, candidates verified by odd sketches and then on full shingle sets.

A text's set holds its distinct five-word shingles. Texts of one set are one class, and classes are the
nodes of the graph. Each class has 1,024 MinHash values, the first 250 of them in 50 bands of five: two classes
of similarity 0.75 share no band with a chance of 1.3e-6, more similar ones with less. All values are
folded into an odd sketch, a bitmap in which each value flips one bit. The bits in which two sketches differ
tell how many values differ, so the similarity is estimated by XOR and population counts in the JVM, with a
standard deviation of 0.016 at 0.75; a candidate estimated under 0.67 is dropped (chance 5e-7), and so is one whose
set sizes alone rule a link out. What remains is confirmed on the full sets.

No group emits all its pairs. First every class of a bucket meets one class of it only, its hub: the class that
shares buckets with most others, so that near copies of one original all meet the copy nearest to it. That
joins near copies by the thousand through as many links. Then only buckets whose classes are still apart
are looked at again: classes outside the bucket's largest component meet the bucket, and the sketch
is compared inside the join, so that nothing but likely links leaves it, each from one bucket. A pair inside one component
needs no link of its own, so no component is lost. Counts and least ids are combined before their shuffle,
and joins may be split by Spark where a bucket is hot.

Whole texts move once, to fetch those that take part in candidates. Signatures, buckets, links and each
round of the components are tables in the shared folder, so lost executors cost a task, not the lineage.

Defined results: a null, empty or blank text has no shingles and is linked with nothing; a text of under
five words is one shingle; rows of one id but different texts are different nodes; repeated rows
share their class; a null id counts as no id, so it never names a component that has another; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffmill.llm.common import as_bytes, judged, mix, shingle_set
from diffmill.session import stored

#: MinHash bands and values in each, values folded into the odd sketch, and its bits.
BANDS, ROWS, SAMPLES, SKETCH_BITS = 50, 5, 1024, 2048
#: A link needs 100 * common >= SIMILAR * all shingles; candidates are estimated at LIKELY or more.
SIMILAR, LIKELY = 75, 0.67
_STEP = 128  # shingles hashed at a time

SIGNATURE = "n_shingles bigint, set_key binary, bands array<bigint>, sketch array<bigint>"


class Signer:
    """Signatures of texts; every task derives the same hash functions from the fixed seed."""

    def __init__(self, bands: int, rows: int, n: int, bits: int):
        draw = np.random.default_rng(20240229)
        self.bands, self.rows, self.bits = bands, rows, bits
        self.turn = draw.integers(0, 1 << 32, n, np.uint32)
        self.times = draw.integers(0, 1 << 32, n, np.uint32) | np.uint32(1)
        self.weights = draw.integers(0, 1 << 63, (1, rows), np.uint64) | np.uint64(1)
        self.band = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.place = np.arange(n, dtype=np.uint64) << np.uint64(32)

    def min_hashes(self, shingles: np.ndarray) -> np.ndarray:
        short = shingles.astype(np.uint32)[:, None]
        least = np.full(len(self.turn), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(short), _STEP):
            part = short[i : i + _STEP] ^ self.turn
            part *= self.times
            np.minimum(least, part.min(0), out=least)
        return least

    def __call__(self, text: bytes | None) -> dict:
        shingles = shingle_set(text)
        if not len(shingles):
            return {"n_shingles": 0, "set_key": None, "bands": None, "sketch": None}
        least = self.min_hashes(shingles).astype(np.uint64)
        banded = least[: self.bands * self.rows].reshape(self.bands, self.rows)
        bands = mix((banded * self.weights).sum(1) + self.band)
        flipped = np.bincount((mix(least + self.place) % np.uint64(self.bits)).astype(np.int64), minlength=self.bits) & 1
        return {
            "n_shingles": len(shingles),
            "set_key": xxhash.xxh3_128_digest(shingles.tobytes()),
            "bands": bands.view(np.int64).tolist(),
            "sketch": np.packbits(flipped.astype(np.uint8)).view(np.int64).tolist(),
        }


def most_flips(likely: float = LIKELY, n: int = SAMPLES, bits: int = SKETCH_BITS) -> int:
    """Differing bits expected at similarity ``likely``: each differing value flips a bit in both sketches."""
    return int(bits / 2 * (1 - np.exp(-4 * n * (1 - likely) / bits)))


def flips(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ."""
    return sum(F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(SKETCH_BITS // 64))


def _sizes_allow(a: Column, b: Column, similar: int) -> Column:
    """Whether sets of these sizes could link at all."""
    return 100 * F.least(a, b) >= similar * F.greatest(a, b)


def _similar(similar: int):
    """Whether two texts' full shingle sets link."""

    def confirm(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, left = None, None
        for first, second in batches:
            out = []
            for a, b in zip(as_bytes(first), as_bytes(second)):
                if a != last:
                    last, left = a, shingle_set(a)
                right = shingle_set(b)
                common = len(np.intersect1d(left, right, assume_unique=True))
                out.append(100 * common >= similar * (len(left) + len(right) - common))
            yield pa.array(out, pa.bool_())

    return F.arrow_udf(confirm, "boolean")


def components(links: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for every node of ``links`` (a, b).

    Alternates between hanging the larger neighbours of a node below its least neighbour, and the smaller
    ones; each round is written down. Least neighbours are combined before their shuffle.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(hung.unionByName(least.withColumnRenamed("m", "v")).distinct(), "small-star")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    # every node but the roots now hangs below its root
    return stored(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "components")


def _sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Signature of every row, stored: id, text_key, n_shingles, set_key, bands, sketch."""
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("text_key"), docs[text_col].alias("text"))
    return stored(judged(rows, ["id", "text_key"], "text", lambda: Signer(BANDS, ROWS, SAMPLES, SKETCH_BITS), SIGNATURE), "signatures")


def _classes(signed: DataFrame) -> DataFrame:
    """One row per shingle set, with a number: node, set_key, first_id, id and text_key of one of its rows."""
    any_row = F.min(F.struct("id", "text_key")).alias("row")
    same = signed.where("set_key is not null").groupBy("set_key").agg(
        F.min("id").alias("first_id"), any_row, F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
        F.first("n_shingles").alias("n"),
    )
    return stored(same.withColumn("node", F.monotonically_increasing_id()), "classes")


def _likely(pairs: DataFrame, classes: DataFrame, most: int, similar: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow a link and whose sketches differ in few enough bits."""
    a = classes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    b = classes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    near = _sizes_allow(F.col("na"), F.col("nb"), similar) & (flips(F.col("sa"), F.col("sb")) <= most)
    return pairs.join(a, "a").join(b, "b").where(near).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, similar: int) -> DataFrame:
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(a, "a").join(b, "b").withColumn("linked", _similar(similar)(F.col("ta"), F.col("tb")))
    return joined.where("linked").select("a", "b")


def _with_hubs(members: DataFrame) -> DataFrame:
    """The rows of buckets (key, node, n) with the bucket's hub: its class whose buckets hold most classes."""
    scores = members.groupBy("node").agg(F.sum("n").alias("score"))
    best = F.max_by("node", F.struct("score", "node")).alias("hub")
    hubs = members.join(scores, "node").groupBy("key").agg(best).withColumnRenamed("key", "_key")
    return members.join(hubs, F.col("key") == F.col("_key")).select("key", "node", "hub")


def _apart(members: DataFrame, roots: DataFrame, classes: DataFrame, most: int, similar: int = SIMILAR) -> DataFrame:
    """Likely pairs within a bucket whose classes are in different components."""
    placed = members.join(roots, members["node"] == roots["_node"], "left")
    placed = stored(placed.select("key", "node", "hub", F.coalesce("root", "node").alias("root")), "placed")
    counts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("key").agg(
        F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("largest")
    ).where("roots > 1")
    here = placed.join(mixed, "key").where("node <> hub").join(classes.select("node", "sketch", "bands", "n"), "node")
    here = stored(here.select("key", "node", "root", "largest", "sketch", "bands", "n"), "apart")
    left = here.where("root <> largest").select(
        "key", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("sketch").alias("sa"), F.col("bands").alias("ba"),
        F.col("n").alias("na"),
    )
    right = here.select(
        F.col("key").alias("_key"), F.col("node").alias("b"), F.col("root").alias("rb"), "largest", F.col("sketch").alias("sb"),
        F.col("bands").alias("bb"), F.col("n").alias("nb"),
    )
    once = (F.col("rb") == F.col("largest")) | (F.col("a") < F.col("b"))
    near = _sizes_allow(F.col("na"), F.col("nb"), similar) & (flips(F.col("sa"), F.col("sb")) <= most)
    first = F.array_min(F.array_intersect("ba", "bb")) == F.col("key")
    met = left.join(right, (F.col("key") == F.col("_key")) & (F.col("ra") != F.col("rb")) & once & near & first)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR) -> DataFrame:
    """One row for each row of ``docs``: id, text_key (hash of the text), n_shingles, component_id, the least
    id that links reach, and kept, whether that is its own."""
    most = most_flips()
    signed = _sign(docs, id_col, text_col)
    classes = _classes(signed)
    banded = classes.select(F.explode("bands").alias("key"), "node")
    buckets = stored(
        banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("n > 1"),
        "buckets",
    )
    large = buckets.where("n > 2").select(F.col("key").alias("_key"), "n")
    members = stored(banded.join(large, F.col("key") == F.col("_key")).select("key", "node", "n"), "members")
    members = stored(_with_hubs(members), "members-with-hubs")
    twos = buckets.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    firsts = members.where("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    pairs = stored(_likely(twos.unionByName(firsts).distinct(), classes, most, similar), "pairs")

    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    wanted = wanted.unionByName(members.select("node")).distinct().join(classes.select("node", "row"), "node")
    text = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("_text_key"), docs[text_col].alias("text"))
    same = text["id"].eqNullSafe(wanted["row.id"]) & (text["_text_key"] == wanted["row.text_key"])
    texts = stored(text.join(wanted, same).select("node", "text").dropDuplicates(["node"]), "candidate-texts")

    links = stored(_confirmed(pairs, texts, similar), "confirmed")
    roots = components(links).withColumnRenamed("node", "_node")
    more = stored(_confirmed(_apart(members, roots, classes, most, similar), texts, similar), "confirmed-apart")
    roots = components(links.unionByName(more)).withColumnRenamed("node", "_node") if more.head(1) else roots

    nodes = classes.select("node", "set_key", "first_id")
    nodes = nodes.join(roots, nodes["node"] == roots["_node"], "left").select("set_key", "first_id", F.coalesce("root", "node").alias("root"))
    named = nodes.join(nodes.groupBy("root").agg(F.min("first_id").alias("component")), "root").select(
        F.col("set_key").alias("_set_key"), "component"
    )
    found = signed.select("id", "text_key", "n_shingles", "set_key").join(named, F.col("set_key") == F.col("_set_key"), "left")
    component = F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component"))
    return found.select("id", "text_key", "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the row of the least id, its copies taken once. Texts
    without words are in no group and stay."""
    judged_rows = near_duplicates(docs, id_col, text_col)
    verdict = judged_rows.groupBy("id", "text_key").agg(F.first("kept").alias("kept"), F.first("n_shingles").alias("n_shingles"))
    rows = docs.select(F.struct("*").alias("row"), docs[id_col].alias("_id"), F.xxhash64(docs[text_col]).alias("_key"))
    met = rows.join(verdict, rows["_id"].eqNullSafe(verdict["id"]) & (rows["_key"] == verdict["text_key"])).where("kept")
    once = met.where("n_shingles > 0").groupBy("_id", "_key").agg(F.first("row").alias("row")).select("row.*")
    return once.unionByName(met.where("n_shingles = 0").select("row.*"))
