import hashlib
import random
import re

from diffmill.llm import fill_middle
from diffmill.llm.queries import QUERIES
from tests.llm.plain import SCHEMA, empty, messy, messy_rows


def plain(doc_id, text):
    """Units, form, sizes and output by the contract, token by token."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def random_rows(n=1500):
    rng = random.Random(11)
    parts = ["a", "Zb", "é", "漢", "<", "P", ">", "S", "M", " ", "\n", "🙂", "<P", "<M>", "2"]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(14)))) for i in range(n)]


def test_query_against_a_plain_version(spark, tmp_path):
    rows = [(i, t, None, None, 0) for i, t in random_rows()] + messy_rows()
    rows.append((5000, "word, " * 400_000, "en", "s1", 0))  # 2.4 million characters
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_fill_in_middle"](spark, str(tmp_path)).collect()
    want = []
    for r in rows:
        n, form, pre, mid, output = plain(r[0], r[1])
        want.append((r[0], n, form, pre, mid, sha(output), sha(r[1] or "")))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_outputs_come_back_from_output_and_form_alone(spark):
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in random_rows(500)], SCHEMA)
    made = fill_middle.fill_in_middle(docs)
    back = made.select("doc_id", fill_middle.restored_text(made["output"], made["form"]).alias("text")).collect()
    assert dict(back) == dict(random_rows(500))
    rows = {r.doc_id: r for r in made.collect()}
    for i, text in random_rows(500):
        assert (rows[i].n, rows[i].form, rows[i].prefix_chars, rows[i].middle_chars, rows[i].output) == plain(i, text)


def test_pieces_share_buffers_and_inverse_orders_undo():
    table = fill_middle.PieceTable.of(b"abcdefg")
    cut = table.cut(0, 3, 3, 7)
    assert [bytes(v) for v in cut] == [b"", b"abc", b"", b"defg", b""] and cut.buffers is table.buffers
    assert cut.cut(2, 5).text() == b"abcdefg" and len(cut) == 7
    for order in ([4, 3, 2, 1, 0], [1, 0, 4, 2, 3]):
        assert cut.arranged(order).arranged(fill_middle.inverse(order)).pieces == cut.pieces
    assert table.sha256() == hashlib.sha256(b"abcdefg").hexdigest()


def test_special_rows(spark):
    assert fill_middle.fill_in_middle(empty(spark)).collect() == []
    made = fill_middle.fill_in_middle(messy(spark))
    assert made.count() == len(messy_rows())
    null = made.where("doc_id = 0").first()
    assert (null.n, null.form, null.output) == (0, "plain", "")
    assert len({r.output for r in made.where("doc_id = 20").collect()}) == 1
    assert fill_middle.restored_text(made["output"], made["form"]) is not None


def test_rates_and_seed_are_parameters(spark):
    docs = spark.createDataFrame([(i, "some words to cut", None, None, 0) for i in range(400)], SCHEMA)
    never = fill_middle.fill_in_middle(docs, transformed=0)
    assert {r.form for r in never.collect()} == {"plain"}
    always = fill_middle.fill_in_middle(docs, transformed=100, suffix_first=100)
    assert {r.form for r in always.collect()} == {"spm"}
    first, second = (fill_middle.fill_in_middle(docs, seed=s).orderBy("doc_id").collect() for s in "12")
    assert first != second
