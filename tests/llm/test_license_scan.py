import random
import time

import pytest
from pyspark.sql import Row

from diffmill.llm.license_scan import NOTICES, PHRASES, Scanner, SuffixAutomaton, scan_licenses
from diffmill.llm.queries import QUERIES
from tests.llm.plain import empty, messy, messy_rows, plain_words


def base(text):
    words = plain_words(text)
    return sorted(
        (i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    )


def longest(sequences, words, end):
    for n in range(min(end, 12), 0, -1):
        part = words[end - n : end]
        if any(part == s[i : i + n] for s in sequences for i in range(len(s))):
            return n
    return 0


def test_matching_statistics_agree_with_a_plain_search():
    rng = random.Random(1)
    for _ in range(60):
        sequences = [[bytes([97 + rng.randrange(3)]) for _ in range(rng.randrange(1, 9))] for _ in range(3)]
        a = SuffixAutomaton(sequences)
        words = [bytes([97 + rng.randrange(4)]) for _ in range(40)]
        state = n = 0
        for e, w in enumerate(words):
            while state and w not in a.next[state]:
                state, n = a.link[state], a.length[a.link[state]]
            state, n = (a.next[state][w], n + 1) if w in a.next[state] else (0, 0)
            assert n == longest(sequences, words, e + 1)
            if n:
                part = words[e + 1 - n : e + 1]
                places = {(s, i + n) for s, q in enumerate(sequences) for i in range(len(q) - n + 1) if q[i : i + n] == part}
                assert a.ends[state] == places


def test_phrases_in_every_place():
    rng = random.Random(2)
    scan = Scanner(PHRASES, NOTICES, 4, 0.7, 12)
    parts = "mit apache general public license gnu released under the MIT License. x, y".split() + ["Apache License"]
    for _ in range(300):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        got = scan(text.encode())
        assert sorted((p["start"], p["label"]) for p in got["phrases"]) == base(text)
        assert got["n_words"] == len(plain_words(text))


@pytest.mark.parametrize("label, notice", NOTICES)
def test_notices_are_covered_even_with_changes(label, notice):
    scan = Scanner(PHRASES, NOTICES, 4, 0.7, 12)
    got = scan(f"Some words before. {notice} And after it.".encode())
    assert any(s["label"] == label and s["cover"] == 1 and s["start"] == 3 for s in got["spans"]) and got["score"] == 1
    words = notice.split()
    if len(words) > 12:
        changed = " ".join([*words[: len(words) // 2], "quite", "otherwise", *words[len(words) // 2 + 1 :]])
        found = [s for s in scan(changed.encode())["spans"] if s["label"] == label]
        assert len(found) == 1 and found[0]["cover"] >= 0.7


def test_prose_has_no_spans():
    scan = Scanner(PHRASES, NOTICES, 4, 0.7, 12)
    assert scan(b"the terms of the work are in the file and this is free of any claim")["spans"] == []


def test_awkward_rows(spark):
    got = {(r.doc_id, r.n_words, len(r.phrases)) for r in scan_licenses(messy(spark)).collect()}
    assert got == {(i, len(plain_words(t)), len(base(t))) for i, t, *_ in messy_rows()}
    assert scan_licenses(messy(spark)).count() == len(messy_rows())
    assert scan_licenses(empty(spark)).collect() == []


def test_whole_licenses_have_whole_spans():
    scan = Scanner(PHRASES, NOTICES, 4, 0.7, 12)
    assert {"isc", "unlicense", "zlib", "epl", "cc0", "cc-by"} <= {label for label, _ in NOTICES}
    for label, notice in NOTICES:
        n = len(plain_words(notice))
        spans = scan(f"Some words before. {notice} And after it.".encode())["spans"]
        assert [(s["label"], s["start"], s["end"]) for s in spans] == [(label, 3, 3 + n)]
        if n > 60:  # the body without its opening
            body = " ".join(notice.split()[18:])
            assert [s["label"] for s in scan(body.encode())["spans"]] == [label]


@pytest.mark.parametrize("text, labels", [
    ("Licensed under CC BY 4.0.", ["cc-by"]), ("Licensed under CC BY-NC 4.0.", ["cc-by-nc"]),
    ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", ["cc-by-nc"]),
])
def test_families_are_told_apart(text, labels):
    assert [s["label"] for s in Scanner(PHRASES, NOTICES, 4, 0.7, 12)(text.encode())["spans"]] == labels


def plain_spans(words, notices, least, min_cover, max_gap):
    """Longest stretches by comparing words, chains by trying every match before, spans by looking at all kept ones."""
    sequences = [(label, plain_words(n)) for label, n in notices]

    def size(end):
        n = 0
        while n < end and any(words[end - n - 1 : end] == q[i : i + n + 1] for _, q in sequences for i in range(len(q) - n)):
            n += 1
        return n

    sizes = [size(e) for e in range(len(words) + 1)] + [0]
    stretches = [(e - sizes[e], e) for e in range(len(words) + 1) if sizes[e] >= least and sizes[e + 1] <= sizes[e]]
    chains = []
    for label, q in sequences:
        parts = sorted((a, i, b - a) for a, b in stretches for i in range(len(q)) if q[i : i + b - a] == words[a:b])
        best = []
        for j, (a, i, n) in enumerate(parts):
            ways = [(n, -a)]
            for (b, k, m), (covered, first) in zip(parts[:j], best):
                shared = max(0, b + m - a, k + m - i)
                if k < i and shared < n and a - b - m <= max_gap and a - b <= max_gap + len(q):
                    ways.append((covered + n - shared, first))
            best.append(max(ways))
            if best[-1][0] / len(q) >= min_cover:
                chains.append((-best[-1][0], -min(1.0, best[-1][0] / len(q)), -best[-1][1], a + n, label))
    kept = []
    for _, cover, start, end, label in sorted(chains):
        if not any((a <= start and end <= b) or (name == label and a < end and start < b) for name, a, b, _ in kept):
            kept.append((label, start, end, -cover))
    return sorted(kept, key=lambda x: (x[1], x[2], x[0]))


def test_spans_agree_with_plain_chaining():
    rng, some = random.Random(4), 0
    for _ in range(300):
        notices = [(rng.choice("xyz"), " ".join(rng.choice("abcdef") for _ in range(rng.randrange(3, 14)))) for _ in range(3)]
        parts = []
        for _ in range(rng.randrange(1, 7)):
            words = rng.choice(notices)[1].split()
            cut = rng.randrange(len(words))
            parts += rng.choice([words, words[cut:], words[:cut] + ["q"] * rng.randrange(6) + words[cut + 1 :], list("qqq")])
        got = Scanner([], notices, 2, 0.6, 4)(" ".join(parts).encode())["spans"]
        want = plain_spans(parts, notices, 2, 0.6, 4)
        assert [tuple(s.values()) for s in got] == want
        some += len(want)
    assert some > 300


def test_a_text_of_many_notices_takes_time_in_proportion():
    scan, line = Scanner(PHRASES, NOTICES, 4, 0.7, 12), b"Licensed under CC BY 4.0. and so on it goes\n"
    taken = []
    for n in (4_000, 32_000):
        began = time.process_time()
        assert len(scan(line * n)["spans"]) == n
        taken.append(time.process_time() - began)
    assert taken[1] < 24 * taken[0] + 1


def test_query_agrees_with_plain_versions(spark, tmp_path):
    rng = random.Random(8)
    rows = [r[:2] for r in messy_rows() if len(r[1] or "") < 5_000]
    for i in range(40):
        parts = [n if rng.random() < 0.6 else " ".join(n.split()[3:]) for _, n in rng.sample(NOTICES, rng.randrange(3))]
        rows.append((1_000 + i, " some words ".join(["MIT license here", *parts, rng.choice(["", "Apache License"])])))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, QUERIES["op1_license_scan"](spark, str(tmp_path)).drop("spans").collect()))
    want = []
    for i, text in rows:
        words, found = plain_words(text), base(text)
        spans = plain_spans(words, NOTICES, 4, 0.7, 12)
        starts, labels = [s for s, _ in found], {name for _, name in found}
        want.append((i, len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
                     ",".join(sorted(labels | {s[0] for s in spans})), float(max((s[3] for s in spans), default=0))))
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert got == sorted(str(Row(**dict(zip(names, w)))) for w in want)
