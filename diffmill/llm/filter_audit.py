"""Audit of filters in every order: what each one removes, and what removes it already.

A document is reduced to the set of filters that it fails. The state after some filters is
the set of those applied, a corner of the subset lattice; an edge applies one more. What an
edge removes depends on its state alone, not on the order that led there. So the sets are
counted once for each part, the counts are summed for each edge, and an edge's number of orders is
the number of paths that reach its state (forward) times the number of those that leave its
end (backward). Removals weighted by it and summed over a filter's edges are its Shapley
total; the steps of all orders are read from the same edges.

Filters: A under 200 words; B fewer than half of the words distinct; C more than 2% of the
characters in A-Z; D a character of ``#$%&*|``; E a text equal to that of a smaller id, in
the whole table. Words are runs of characters other than white space, in their own case.

Texts are read once, to a hash and a set of filters that are written down. Equal texts meet in a
least id by hash, combined before the shuffle, so a large group of copies sends one row a task.
That id comes back by (id, hash), which no group shares. From there on a part has 128 rows at most,
whatever it holds.

Results for special rows: a null text is the empty text; an empty text fails A only (and E if a
smaller id has one); a part is a value of ``part_by``, null read as the empty string and one part with
it. A row with a null id is never equal to a smaller one nor smaller than another. Rows that repeat an id count
each; of them none fails E for the other. Labels that repeat an id count as one with the largest
values, null as 0; ids without labels have quality and toxic 0. A text of any length is
judged whole. An empty table has no parts and gives no rows. Columns of other names are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffmill.session import stored

NAMES = "ABCDE"
SYMBOLS = "[#$%&*|]"
_BLANKS = r"\x20\x09-\x0D"
_WHITE = " \t\n\v\f\r"

SUMS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``fails`` in place of ``text``: bit set of the filters A to D that it fails."""
    body, rest = F.col(text), [c for c in docs.columns if c != text]
    trimmed = F.btrim(body, F.lit(_WHITE))
    words = F.split(trimmed, f"[{_BLANKS}]+")
    counted = docs.select(
        *rest, (F.size(words) - (trimmed == "").cast("int")).alias("_n"), F.size(F.array_distinct(words)).alias("_distinct"),
        F.regexp_count(body, F.lit("[A-Z]")).alias("_capitals"), F.length(body).alias("_chars"), body.rlike(SYMBOLS).alias("_symbols"),
    )
    n = F.col("_n")
    fails = (n < 200, 100 * F.col("_distinct") < 50 * n, 100 * F.col("_capitals") > 2 * F.col("_chars"), F.col("_symbols"))
    bits = (F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails))
    return counted.select(*rest, sum(bits, F.lit(0)).alias("fails"))


def failures(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part_by: str = "source") -> DataFrame:
    """``part``, bit set ``fails``, ``good`` and ``toxic`` (0 or 1) of every document."""
    whole = F.coalesce(docs[text], F.lit(""))
    read = docs.select(
        docs[doc_id].alias("doc_id"), F.coalesce(docs[part_by], F.lit("")).alias("part"),
        F.unhex(F.sha2(whole.cast("binary"), 256)).alias("hash"), whole.alias("text"),
    )
    slim = stored(text_failures(read, "text"), "audited")
    first = slim.groupBy("hash").agg(F.min("doc_id").alias("doc_id"))
    marks = labels.groupBy("doc_id").agg(
        *[F.max(F.coalesce(F.col(c), F.lit(0)) == 1).cast("int").alias(new) for c, new in (("quality", "good"), ("toxic", "toxic"))]
    )
    late = F.when(F.col("_first").isNull() & F.col("doc_id").isNotNull(), 1 << NAMES.index("E")).otherwise(0)
    none = F.lit(0)
    return (
        slim.join(marks, "doc_id", "left")
        .join(first.withColumn("_first", F.lit(True)), ["doc_id", "hash"], "left")
        .select(
            "part", F.col("fails").bitwiseOR(late).alias("fails"),
            F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"),
        )
    )


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """Orders that reach each state from the empty one, and orders that lead from it to the full one."""
    ahead, back = [0] * (1 << n), [0] * (1 << n)
    ahead[0] = back[-1] = 1
    for state in range(1 << n):
        for i in range(n):
            if not state >> i & 1:
                ahead[state | 1 << i] += ahead[state]
    for state in reversed(range(1 << n)):
        for i in range(n):
            if not state >> i & 1:
                back[state] += back[state | 1 << i]
    return ahead, back


def lattice_edges(n: int) -> list[tuple[int, int, int]]:
    """Each edge: its state, the bit that it adds, and the number of orders through it."""
    ahead, back = path_counts(n)
    free = ((state, i) for state in range(1 << n) for i in range(n) if not state >> i & 1)
    return [(state, 1 << i, ahead[state] * back[state | 1 << i]) for state, i in free]


def order_steps(names: str) -> list[tuple[int, int, str, int]]:
    """Each step of each order: the edge that it takes, the order, and its place from 1."""
    out = []
    for order in permutations(range(len(names))):
        state = 0
        for step, i in enumerate(order, 1):
            out.append((state, 1 << i, "".join(names[j] for j in order), step))
            state |= 1 << i
    return out


def edge_sums(failed: DataFrame, names: str = NAMES) -> DataFrame:
    """For each part and edge: what is kept, removed, redundant and so on, and the filter's Shapley total."""
    sets = failed.groupBy("part", "fails").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")
    )
    edges = F.array(*[
        F.struct(F.lit(s).alias("state"), F.lit(b).alias("bit"), F.lit(w).cast("long").alias("orders"))
        for s, b, w in lattice_edges(len(names))
    ])
    fails, bit = F.col("fails"), F.col("bit")
    alive = fails.bitwiseAND(F.col("state")) == 0
    hit = fails.bitwiseAND(bit) != 0
    chosen = {
        "kept": (alive & ~hit, "n"), "removed": (alive & hit, "n"), "redundant": (~alive & hit, "n"),
        "unique_fails": (fails == bit, "n"), "good_lost": (alive & hit, "good"), "toxic_lost": (alive & hit, "toxic"),
    }
    sums = [F.sum(F.when(rows, F.col(of)).otherwise(0)).cast("long").alias(c) for c, (rows, of) in chosen.items()]
    summed = sets.select("*", F.inline(edges)).groupBy("part", "state", "bit", "orders").agg(*sums)
    shapley = F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "bit"))
    return summed.withColumn("shapley", shapley.cast("long"))


def audit_filters(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part_by: str = "source"
) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included."""
    summed = edge_sums(failures(docs, labels, doc_id, text, part_by))
    steps = docs.sparkSession.createDataFrame(order_steps(NAMES), "state int, bit int, filter_order string, step int")
    # a fixed table: a row for each step of each order
    return summed.join(F.broadcast(steps), ["state", "bit"]).select("part", "filter_order", "step", *SUMS, "shapley")
