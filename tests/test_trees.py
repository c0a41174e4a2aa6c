"""Listing of trees by levels, against a walk."""

import os

from diffmill.sources import trees


def make_tree(root):
    for path in ("a.js", "src/b.ts", "src/deep/er/c.py", "src/.hidden/d.js", "node_modules/e.js", "_build/f.js", "src/g.txt", ".h.js"):
        full = root / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(path.encode())
    for i in range(300):
        folder = root / f"many/m{i % 7}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{i}.js").write_bytes(b"x" * i)
    (root / "dangling.js").symlink_to(root / "nowhere")
    (root / "loop").symlink_to(root)


def too_deep(root):
    """Folders below each other until the path is too long to be opened."""
    at = os.open(root, os.O_RDONLY)
    for _ in range(22):
        os.mkdir("d" * 200, dir_fd=at)
        at = os.open("d" * 200, os.O_RDONLY, dir_fd=at)


def walked(root):
    out = {}
    for folder, names, files in os.walk(root):
        names[:] = [n for n in names if not n.startswith(".") and n != "node_modules"]
        for name in files:
            path = os.path.join(folder, name)
            if os.path.isfile(path):
                out[os.path.relpath(path, root)] = open(path, "rb").read()
    return out


def test_levels_equal_a_walk(spark, tmp_path, monkeypatch):
    roots = [tmp_path / "one", tmp_path / "two", tmp_path / "empty"]
    for root in roots:
        root.mkdir()
    make_tree(roots[0])
    (roots[1] / "x.js").write_text("x")
    checkouts = spark.createDataFrame([(i, str(r)) for i, r in enumerate(roots)], "job int, root string")
    got = {(r.job, r.file_path): bytes(r.content) for r in trees.checkout_files(checkouts).collect()}
    want = {(i, p): c for i, r in enumerate(roots) for p, c in walked(r).items() if "loop/" not in p}
    assert got == want and len(got) > 300


def test_unreadable_folders_and_files_are_skipped_and_listed(spark, tmp_path):
    make_tree(tmp_path)
    too_deep(tmp_path)
    checkouts = spark.createDataFrame([(1, str(tmp_path)), (2, str(tmp_path / "none"))], "job int, root string")
    listing = trees.list_files(checkouts)
    bad = sorted((r.job, r.error, r.file_path[:3]) for r in listing.unreadable.collect())
    assert bad == [(1, "OSError", "ddd"), (2, "FileNotFoundError", "")]
    contents = trees.read_files(listing.files)
    assert sorted(r.file_path for r in contents.where("content is null").collect()) == ["dangling.js", "loop"]
    found = {r.file_path: r.content for r in trees.read_source_tree(spark, str(tmp_path)).collect()}
    assert found["src/deep/er/c.py"] == "src/deep/er/c.py" and "_build/f.js" in found and "many/m0/f0.js" in found
    assert not {"src/g.txt", "node_modules/e.js", "src/.hidden/d.js", "dangling.js"} & set(found)
