"""Plain readings of the contracts, and a table with every awkward case."""

import hashlib
import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = ("n_words", "size", "row", "_row", "kept", "key", "tie", "node", "rank", "shard", "slot", "text_key", "id", "_text", "host")


def prose(rng, n, words=400, lines=12):
    out = []
    for i in range(n):
        out.append(f"w{int(words * rng.random() ** 2)}x")
        out.append("\n" if (i + 1) % lines == 0 else " ")
    return "".join(out)


def messy_rows():
    rng = random.Random(5)
    long = prose(rng, 30_000)
    texts = [None, "", " \n\t ", "one", "Two  words", long, "0" * 2_000, "é" * 50, prose(rng, 60), "a\nb\na\nb", "Mit License"]
    rows = [(i, t, "en", "s1", 1) for i, t in enumerate(texts)]
    rows += [(20, "same text here for all five rows", None, None, None)] * 3
    rows += [(None, "no id at all in this row", "fr", None, 2), (None, None, None, "s2", None)]
    rows += [(30 + i, "equal texts of many rows " * 3, "en", "s1", 0) for i in range(6)]
    return rows


def messy(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(messy_rows(), SCHEMA)
    return df.withColumns({c: F.lit(7) for c in CLASHING})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def white_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_counts(text):
    words = white_words(text)
    lines = [x for x in (text or "").split("\n") if white_words(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated),
    }


def base_failed(c):
    return c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]


def contamination(text, items):
    words, hit, found = plain_words(text), set(), set()
    for item, item_text in items:
        own = plain_words(item_text)
        size = min(13, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def shingles(text):
    words = white_words(low(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def near_groups(rows):
    """(id, text) to the least id of its component, all pairs compared."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(x)] = find(y)
    members = defaultdict(list)
    for x in range(len(sets)):
        members[find(x)].append(sets[x][0])
    least = {r: min((i for i in m if i is not None), default=None) for r, m in members.items()}
    return [(sets[x][0], len(sets[x][1]), least[find(x)]) for x in range(len(sets))]


def mix_targets(sizes):
    """Shares by weight, capped at twice the source, shared again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            target.update({s: left * weight[s] / total for s in free})
            break
        target.update({s: 2.0 * sizes[s] for s in over})
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


def personal(text):
    def luhn(digits):
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0

    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m.group(0))]


def sha(names):
    return hashlib.sha256(",".join(names).encode()).hexdigest()
