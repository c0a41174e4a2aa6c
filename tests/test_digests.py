"""Changed files by digests of folders, against the comparison of all files."""

import random

import pytest

from diffmill.operators import digests, metrics
from diffmill.session import work_dir

FILES = "repo string, file_path string, content string"


def compared(spark, base, head):
    folder = work_dir(spark, "trees")
    frames = [spark.createDataFrame(rows, FILES) for rows in (base, head)]
    for name, frame in zip(("base", "head"), frames):
        digests.write_tree(frame, f"{folder}/{name}")
    found = digests.compare_trees(spark, f"{folder}/base", f"{folder}/head")
    want = metrics.changed_files(*frames)
    columns = ["repo", "file_path", "change"]
    assert sorted(map(tuple, found.changes.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    return found, folder


def random_tree(rng, n):
    return {
        (rng.choice("xyz"), "/".join(rng.choice(["a", "b", "c d", "é"]) for _ in range(rng.randrange(4))) + f"/f{i}.js".lstrip("/" if i % 2 else "")):
        f"content {rng.randrange(5)}" for i in range(n)
    }


@pytest.mark.parametrize("seed", [51, 52])
def test_random_trees(spark, seed):
    rng = random.Random(seed)
    tree = {(r, p.strip("/")): c for (r, p), c in random_tree(rng, 150).items()}
    head = {k: (c + "!" if rng.random() < 0.1 else c) for k, c in tree.items() if rng.random() > 0.1}
    head |= {("x", f"new/{i}/deep/er/f.js"): "n" for i in range(4)} | {("w", "only/here.js"): "n"}
    found, _ = compared(spark, [(*k, c) for k, c in tree.items()], [(*k, c) for k, c in head.items()])
    assert found.changes.count() > 20


def test_a_file_becomes_a_folder_and_an_empty_side(spark):
    base = [("r", "a", "1"), ("r", "b/c", "2"), ("r", "e", "")]
    compared(spark, base, [("r", "a/x", "1"), ("r", "b", "2"), ("r", "e", "")])
    compared(spark, base, [])
    compared(spark, [], base)
    found, _ = compared(spark, base, base)
    assert found.entered == 1 and found.changes.count() == 0
    # contents that swap places leave the same hashes in other files
    compared(spark, [("r", "p/a", "1"), ("r", "p/b", "2")], [("r", "p/a", "2"), ("r", "p/b", "1")])


def test_rows_entered_follow_the_change(spark):
    tree = {("r", f"d{i % 100}/e{i % 17}/f{i}.js"): "c" for i in range(20_000)}
    head = dict(tree) | {("r", "d7/e3/new.js"): "n", next(k for k in tree if k[1].startswith("d42/")): "changed"}
    found, folder = compared(spark, [(*k, c) for k, c in tree.items()], [(*k, c) for k, c in head.items()])
    assert found.changes.count() == 2
    assert found.entered < 200  # of 23,000 nodes: the root, its 100 folders, theirs of two, and the files of two
    nodes = digests.read_tree(spark, f"{folder}/base").where("level = 2")
    folders = spark.createDataFrame([("r", "d7")], "repo string, parent string")
    plan = digests._children(digests.read_tree(spark, f"{folder}/base"), 2, folders)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "parent_key" in plan.split("PushedFilters")[1] and nodes.count() == 1700
