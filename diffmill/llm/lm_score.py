"""LM scoring by masked pseudo-likelihood.

A small network predicts every token from the two tokens on each side of it, the token itself being masked.
The sum of the log-probabilities of all tokens is a document's pseudo-log-likelihood; its mean per token makes
documents of different length comparable.

Tokens are words in lower case. The most frequent words of the whole corpus have numbers of their own, the
others share hashed numbers. The log-probability of such a token is that of its number plus the log of the word's share
of the number, from the counts of all words of the corpus: a table that grows with the corpus and is joined by word.
The most frequent ``NEAR`` words of it are sent to all tasks, the others meet their tokens in a shuffle. Every share is
smoothed by one more word of count ``UNSEEN``, which is what a word without count gets. Shares are whole numbers of
2^-20, so that their sums are exact. A token is predicted in two steps, its class (a band of frequencies) and its place in the
class, which costs a few dozen products instead of one per word of the vocabulary. Output biases start from the
corpus counts, so the untrained network is the unigram model.

Training is data-parallel over the whole corpus. In each round every task trains from the same parameters on
one eighth of the positions of each of its documents (another eighth each round, so that the rounds cover all) and returns
its parameters; they are averaged by weight in groups of 32 parts, level by level, so no task sees more than 32 of them however many tasks there
are. What goes through the driver is one set of parameters, whose size is fixed.

Every task trains on its own part of the corpus, so another division into tasks gives another, equally trained model.

Defined results: a null or empty text, or one without words, has 0 tokens, log-likelihood 0 and no mean; equal texts
get equal scores; words of equal counts are taken in their byte order (by hash where the cut of the most frequent falls among
them); a text of any length is scored whole, in blocks of a million tokens; only the columns to keep and the text are read, so
others may have any name; an empty corpus gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, GroupedData, Row
from pyspark.sql import functions as F

from diffmill.llm.common import as_bytes, pieces, plain_words
from diffmill.session import stored

#: Classes, words in each, of which the last numbers are shared by rare words.
CLASSES, PER_CLASS, SHARED = 64, 32, 64
VOCABULARY = CLASSES * PER_CLASS
HIDDEN, SIDES = 32, (-2, -1, 1, 2)
MASK, RATE = 8, 0.1
ROUNDS = MASK
_PAD = VOCABULARY
#: Positions of one training step, and scored at once; positions put in the order of their classes at once.
_BATCH, _BLOCK = 8192, 1 << 20
#: Positions whose scores are held at once, few enough to stay in a core's cache.
_CHUNK = 1024
#: Parts averaged at once, parameters in one row, words a task counts before it sends them on.
FAN_IN, ROW, COUNTED = 32, 8192, 500_000
#: Rare words whose shares every task gets, and the count of an unseen word in every shared number.
NEAR, UNSEEN = 100_000, 0.5
#: Steps in which counts double, and parts of the words by hash, where the most frequent ones are cut off.
LEVELS, PARTS = 32, 1024
_UNIT = 1 << 20


def shared_number(word: bytes) -> int:
    return VOCABULARY - SHARED + xxhash.xxh32_intdigest(word) % SHARED


class Network:
    """Parameters in one vector, with views of its parts."""

    def __init__(self, vector: np.ndarray):
        shapes = {
            "sides": (len(SIDES), VOCABULARY + 1, HIDDEN), "bias": (HIDDEN,), "classes": (HIDDEN, CLASSES),
            "class_bias": (CLASSES,), "words": (CLASSES, HIDDEN, PER_CLASS), "word_bias": (CLASSES, PER_CLASS),
        }
        self.vector, at = vector, 0
        for name, shape in shapes.items():
            size = int(np.prod(shape))
            setattr(self, name, vector[at : at + size].reshape(shape))
            at += size

    size = len(SIDES) * (VOCABULARY + 1) * HIDDEN + HIDDEN + HIDDEN * CLASSES + CLASSES + CLASSES * PER_CLASS * (HIDDEN + 1)

    @classmethod
    def start(cls, counts: np.ndarray) -> Network:
        """Small random weights, and biases by which an idle network gives the unigram model."""
        net = cls((np.random.default_rng(7).standard_normal(cls.size) * 0.05).astype(np.float32))
        share = (counts + 0.5).reshape(CLASSES, PER_CLASS)
        net.bias[:] = 0
        net.class_bias[:] = np.log(share.sum(1) / share.sum())
        net.word_bias[:] = np.log(share / share.sum(1, keepdims=True))
        return net

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.sides[0].take(context[0], axis=0)
        for k in range(1, len(SIDES)):
            total += self.sides[k].take(context[k], axis=0)
        total += self.bias
        return np.tanh(total, out=total)

    def class_scores(self, h: np.ndarray) -> np.ndarray:
        """One row per class, as are the scores in a class: sums over rows are quicker than over short lines."""
        x = self.classes.T @ h.T
        x += self.class_bias[:, None]
        return x

    def word_scores(self, h: np.ndarray, c: int) -> np.ndarray:
        x = self.words[c].T @ h.T
        x += self.word_bias[c][:, None]
        return x

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target, given the tokens around it."""
        out = np.empty(len(target), self.vector.dtype)
        order, cuts = _by_class(target)
        context, place = context[:, order], target[order] % PER_CLASS
        for c in range(CLASSES):
            for i in range(cuts[c], cuts[c + 1], _CHUNK):
                here = slice(i, min(i + _CHUNK, cuts[c + 1]))
                h = self.hidden(context[:, here])
                out[order[here]] = _logs(self.class_scores(h), c)[0] + _logs(self.word_scores(h, c), place[here])[0]
        return out

    def gradient(self, context: np.ndarray, target: np.ndarray) -> tuple[float, list]:
        """Mean log-loss, and (part, rows or None, its gradient)."""
        n = len(target)
        order, cuts = _by_class(target)
        context, target = context[:, order], target[order]
        of, place = np.divmod(target, PER_CLASS)
        h = self.hidden(context)
        dh, loss = np.empty_like(h), 0.0
        of_classes, of_words = (np.zeros_like(x) for x in (self.classes, self.words))
        of_class_bias, of_word_bias = (np.zeros_like(x) for x in (self.class_bias, self.word_bias))
        for i in range(0, n, _CHUNK):
            here = slice(i, i + _CHUNK)
            near = h[here]
            d, log_p = _errors(self.class_scores(near), of[here], n)
            loss -= log_p.sum()
            of_classes += near.T @ d.T
            of_class_bias += d.sum(1)
            np.matmul(d.T, self.classes.T, out=dh[here])
        for c in np.flatnonzero(np.diff(cuts)):
            here = slice(cuts[c], cuts[c + 1])
            near = h[here]
            d, log_p = _errors(self.word_scores(near, c), place[here], n)
            loss -= log_p.sum()
            np.matmul(near.T, d.T, out=of_words[c])
            d.sum(1, out=of_word_bias[c])
            dh[here] += d.T @ self.words[c].T
        grads = [("classes", None, of_classes), ("class_bias", None, of_class_bias)]
        grads += [("words", None, of_words), ("word_bias", None, of_word_bias)]
        dh *= 1 - h * h
        grads.append(("bias", None, dh.sum(0)))
        pairs = dh.view(np.result_type(dh, np.complex64))  # sums over pairs of numbers, which takes half as many steps
        for k in range(len(SIDES)):
            order = np.argsort(context[k], kind="stable")
            ids = context[k][order]
            starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            grads.append(("sides", (k, ids[starts]), np.add.reduceat(pairs.take(order, axis=0), starts, axis=0).view(dh.dtype)))
        return loss / n, grads


def _logs(x: np.ndarray, target: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The log-probability of each column's target, and the sum of the exponentials that ``x`` is turned into."""
    x -= x.max(0)
    log_p = x[target, np.arange(x.shape[1])]
    np.exp(x, out=x)
    total = x.sum(0)
    return log_p - np.log(total), total


def _errors(x: np.ndarray, target: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The gradient of the mean log-loss over ``n`` in the place of ``x``, and the log-probability of each column's target."""
    log_p, total = _logs(x, target)
    x *= 1 / (total * n)
    x[target, np.arange(len(target))] -= 1 / n
    return x, log_p


def _by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the targets, and where in it each class begins."""
    order = np.argsort(target, kind="stable")
    return order, np.searchsorted(target[order], np.arange(CLASSES + 1) * PER_CLASS)


def train(net: Network, context: np.ndarray, target: np.ndarray, squares: Network) -> float:
    """One Adagrad step."""
    loss, grads = net.gradient(context, target)
    for name, at, g in grads:
        part, seen = getattr(net, name), getattr(squares, name)
        if at is not None:
            part, seen, rows = part[at[0]], seen[at[0]], at[1]
        total = g * g
        total += seen if at is None else seen.take(rows, axis=0)
        seen[... if at is None else rows] = total
        total += 1e-8
        g *= RATE
        g /= np.sqrt(total, out=total)
        part[... if at is None else rows] -= g
    return loss


def laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts (as 16-bit numbers) in one array with gaps between, where each begins, and their lengths."""
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, values = texts.buffers()
    empty = np.zeros(len(texts) + 1, kind)
    bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else empty
    bounds = bounds.astype(np.int64) // 2
    lengths = np.diff(bounds)
    flat = np.frombuffer(values or b"", np.uint16)[bounds[0] : bounds[-1]]
    gaps = 2 * np.arange(1, len(texts) + 1)
    starts = bounds[:-1] - bounds[0] + gaps
    tokens = np.full(len(flat) + 2 * len(texts) + 2, _PAD, np.uint16)
    for start, gap, n in zip(starts.tolist(), gaps.tolist(), lengths.tolist()):
        tokens[start : start + n] = flat[start - gap : start - gap + n]
    return tokens, starts, lengths


def around(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([tokens[at + k] for k in SIDES])


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word and n over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        send = lambda: pa.record_batch([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                total.update(plain_words(text))
                if len(total) > COUNTED:
                    yield send()
                    total.clear()
        yield send()

    rows = docs.select(docs[text_col].alias("text")).mapInArrow(count, "word binary, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counted: DataFrame, most: int) -> list[Row]:
    """word and n of the most frequent words, falling, at most ``most``. A histogram of the counts finds where to cut, and of the
    counts in which the cut falls another one, of hashes of the words; so only the words themselves reach the driver."""
    level, part = F.floor(F.log2("n") * LEVELS), F.pmod(F.xxhash64("word"), F.lit(PARTS))
    above, cut = _fitting(counted.groupBy(level.alias("at")), most, True)
    kept = counted.select("word", "n", level.alias("level"), part.alias("part"))
    if cut is not None:
        cut_part = _fitting(kept.where(F.col("level") == cut).groupBy(F.col("part").alias("at")), most - above, False)[1]
        kept = kept.where((F.col("level") > cut) | ((F.col("level") == cut) & (F.col("part") < (PARTS if cut_part is None else cut_part))))
    return sorted(kept.select("word", "n").collect(), key=lambda r: (-r.n, bytes(r.word)))


def _fitting(groups: GroupedData, most: int, falling: bool) -> tuple[int, int | None]:
    """How many rows the groups hold before their sum exceeds ``most``, and the group by which it does, if any."""
    total = 0
    for r in sorted(groups.agg(F.count("*").alias("n")).collect(), key=lambda r: r.at, reverse=falling):
        if total + r.n > most:
            return total, r.at
        total += r.n
    return total, None


def shares(counted: DataFrame, numbers: dict[bytes, int]) -> tuple[DataFrame, np.ndarray]:
    """word and share (a logarithm, in units) of the words without a number of their own, and the counts of the shared
    numbers, each with ``UNSEEN`` for words that are not there."""

    def number(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for words in batches:
            yield pa.array([-1 if w in numbers else shared_number(w) - VOCABULARY + SHARED for w in words.to_pylist()], pa.int32())

    # else the filter numbers all words once more, in workers of its own
    rare = counted.select("word", "n", F.arrow_udf(number, "int").asNondeterministic()("word").alias("number"))
    rare = stored(rare.where("number >= 0"), "lm-rare")
    totals = np.full(SHARED, UNSEEN)
    for r in rare.groupBy("number").agg(F.sum("n").alias("n")).collect():
        totals[r.number] += r.n
    share = F.log(F.col("n") / F.get(F.lit(totals.tolist()), F.col("number")))
    return rare.select("word", F.rint(share * _UNIT).cast("bigint").alias("share")), totals


def _places(numbers: dict[bytes, int], shares: dict[bytes, int]) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """A place for every known word, and by place its number and log share; the last place is that of unknown words."""
    places = {w: i for i, w in enumerate([*numbers, *shares])}
    number_of = np.array([*numbers.values(), *map(shared_number, shares), 0], np.uint16)
    return places, number_of, np.array([0] * len(numbers) + [*shares.values(), 0], np.int64)


def numbered(docs: DataFrame, keep: list[str], text_col: str, numbers: dict[bytes, int], near: dict[bytes, int]) -> DataFrame:
    """The ``keep`` columns as ``row``, the tokens of each text as 16-bit numbers, the sum of the log shares of the
    tokens that ``near`` holds, and the other rare words, each with its count, stored with an ``at`` of the row."""
    near = docs.sparkSession.sparkContext.broadcast(near)

    def number(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places, number_of, share_of = _places(numbers, near.value)
        for texts in chain.from_iterable(map(pieces, batches)):
            tokens, sums, far, times = [], [], [], []
            for text in as_bytes(texts):
                words = plain_words(text)
                at = np.fromiter(map(places.get, words, repeat(-1)), np.int32, len(words))
                ids, unknown = number_of.take(at), at < 0
                rare = list(compress(words, unknown.tolist())) if unknown.any() else []
                if rare:
                    ids[unknown] = [shared_number(w) for w in rare]
                found = Counter(rare)
                tokens.append(ids.tobytes())
                sums.append(int(share_of.take(at).sum()))
                far.append(list(found))
                times.append(list(found.values()))
            yield pa.StructArray.from_arrays(
                [pa.array(tokens, pa.binary()), pa.array(sums, pa.int64()), pa.array(far, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                ["tokens", "near", "far", "times"],
            )

    kind = "struct<tokens:binary,near:bigint,far:array<binary>,times:array<bigint>>"
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), F.arrow_udf(number, kind)(docs[text_col]).alias("_n"))
    return stored(rows.select("row", F.monotonically_increasing_id().alias("at"), "_n.*"), "lm-tokens")


def far_shares(tokens: DataFrame, rare: DataFrame, unseen: int) -> DataFrame:
    """_at and the sum of the log shares of a row's far words."""
    used = tokens.select("at", F.explode(F.arrays_zip("far", "times")).alias("_f")).select("at", "_f.far", "_f.times")
    named = used.join(rare, F.col("far") == F.col("word"), "left")
    found = F.sum(F.col("times") * F.coalesce("share", F.lit(unseen))).alias("_far")
    return named.groupBy(F.col("at").alias("_at")).agg(found)


def _trained(tokens: DataFrame, net: Network, turn: int) -> DataFrame:
    """part, chunk, weight and parameters of every task after one round."""
    vector = tokens.sparkSession.sparkContext.broadcast(net.vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, squares = Network(vector.value.copy()), Network(np.zeros(Network.size, np.float32))
        weight = 0
        for batch in batches:
            ids = laid_out(batch.column(0))[0]
            at = np.arange(turn % MASK, len(ids), MASK)
            at = at[ids[at] != _PAD]
            for i in range(0, len(at), _BATCH):
                here = at[i : i + _BATCH]
                train(own, around(ids, here), ids[here], squares)
            weight += len(at)
        if weight:
            part = TaskContext.get().partitionId()
            chunks = [own.vector[i : i + ROW].tobytes() for i in range(0, Network.size, ROW)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(chunks), pa.int32()), pa.array(range(len(chunks)), pa.int32()),
                 pa.array([weight] * len(chunks), pa.float64()), pa.array(chunks, pa.binary())],
                ["part", "chunk", "weight", "parameters"],
            )

    return tokens.select("tokens").mapInArrow(run, _PARTS)


_PARTS = "part int, chunk int, weight double, parameters binary"


def _mean(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    weights = rows["weight"].to_numpy()
    values = np.stack([np.frombuffer(p, np.float32) for p in rows["parameters"]])
    mean = np.average(values, axis=0, weights=weights).astype(np.float32)
    return pd.DataFrame({
        "part": [int(rows["part"].iloc[0]) // FAN_IN], "chunk": [int(rows["chunk"].iloc[0])],
        "weight": [float(weights.sum())], "parameters": [mean.tobytes()],
    })


def _averaged(parts: DataFrame, net: Network) -> Network:
    """The mean of all parts, level by level; ``net`` itself where nothing was trained."""
    parts = stored(parts, "lm-parts")
    most = parts.agg(F.max("part")).first()[0]
    if most is None:
        return net
    while True:
        parts = parts.groupBy("chunk", F.floor(F.col("part") / FAN_IN)).applyInPandas(_mean, _PARTS)
        most //= FAN_IN
        if most == 0:
            break
    chunks = {r.chunk: bytes(r.parameters) for r in parts.select("chunk", "parameters").collect()}
    return Network(np.frombuffer(b"".join(chunks[i] for i in sorted(chunks)), np.float32))


def fit(tokens: DataFrame, counts: np.ndarray, rounds: int = ROUNDS) -> Network:
    net = Network.start(counts)
    for turn in range(rounds):
        net = _averaged(_trained(tokens, net, turn), net)
    return net


def score_documents(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """The ``keep`` columns (doc_id) with n_tokens, log_prob (sum over all tokens) and mean_log_prob.

    The corpus is read twice as text (counts, numbers) and once per round as stored numbers."""
    keep = ["doc_id"] if keep is None else keep
    own = VOCABULARY - SHARED
    counted = stored(word_counts(docs, text_col), "lm-words")
    frequent = most_frequent(counted, own + NEAR)
    frequent, next_ones = frequent[:own], frequent[own:]
    numbers = {bytes(r.word): i for i, r in enumerate(frequent)}
    rare, totals = shares(counted, numbers)
    counts = np.zeros(VOCABULARY)
    counts[: len(frequent)] = [r.n for r in frequent]
    counts[own:] = totals - UNSEEN
    log_share = lambda word, n: round(float(np.log(n / totals[shared_number(word) - own])) * _UNIT)
    tokens = numbered(docs, keep, text_col, numbers, {bytes(r.word): log_share(bytes(r.word), r.n) for r in next_ones})
    net = docs.sparkSession.sparkContext.broadcast(fit(tokens, counts, rounds).vector)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own_net = Network(net.value)
        for texts in chain.from_iterable(map(pieces, batches)):
            yield pa.array(score_texts(own_net, texts), pa.float64())

    n_tokens = (F.octet_length("tokens") / 2).cast("bigint").alias("n_tokens")
    scored = tokens.select("row", "at", n_tokens, "near", F.arrow_udf(score, "double")("tokens").alias("net"))
    far = far_shares(tokens, rare, round(float(np.log(UNSEEN / totals.max())) * _UNIT))
    whole = scored.join(far, F.col("at") == F.col("_at"), "left")
    log_prob = F.col("net") + (F.col("near") + F.coalesce("_far", F.lit(0))) / _UNIT
    whole = whole.select("row", "n_tokens", log_prob.alias("log_prob"))
    return whole.select("row.*", "n_tokens", "log_prob", F.try_divide("log_prob", "n_tokens").alias("mean_log_prob"))


def score_texts(net: Network, texts: pa.Array) -> np.ndarray:
    """Sum of the log-probabilities of all tokens of each text."""
    ids, starts, lengths = laid_out(texts)
    at = np.flatnonzero(ids != _PAD)
    logs = np.zeros(len(ids))
    for i in range(0, len(at), _BLOCK):
        here = at[i : i + _BLOCK]
        logs[here] = net.log_probs(around(ids, here), ids[here])
    total = np.concatenate(([0.0], np.cumsum(logs)))
    return total[starts + lengths] - total[starts]
