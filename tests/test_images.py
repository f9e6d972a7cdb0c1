"""Manifests, the index of images and lists, from files."""

import hashlib

from pavescope.sources import images

NOTE = "<annotation><filename>x.jpg</filename><size><width>{w}</width><height>{w}</height></size>{o}</annotation>"
OBJECT = "<object><name>{}</name><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>5</xmax><ymax>5</ymax></bndbox></object>"


def folder(root):
    photos, notes = root / "train" / "Japan" / "images", root / "train" / "Japan" / "xmls"
    photos.mkdir(parents=True)
    notes.mkdir()
    for name, size in (("J_007", 2048), ("J_010", 1), ("none", 3), ("J+1 b", 5)):
        (photos / f"{name}.jpg").write_bytes(b"a" * size)
    (notes / "J_007.xml").write_text(NOTE.format(w=600, o="".join(map(OBJECT.format, (" d00 ", "D00", "D44", "D40", "Repair", "D44")))))
    (notes / "J_010.xml").write_text(NOTE.format(w=0, o=OBJECT.format("D43")))
    (notes / "J+1 b.xml").write_text(NOTE.format(w=10, o=""))
    return root


def test_manifest(spark, tmp_path):
    root = folder(tmp_path / "raw")
    now = images.manifest(spark, str(root))
    got = {r["file"]: (r["sha1"], r["bytes"]) for r in now.collect()}
    want = {str(p.relative_to(root)): (hashlib.sha1(p.read_bytes()).hexdigest(), p.stat().st_size) for p in root.rglob("*.*")}
    assert got == want and len(got) == 7
    before = spark.createDataFrame([("train/Japan/images/none.jpg", "0"), ("gone.jpg", "1"), ("train/Japan/images/J_010.jpg", got["train/Japan/images/J_010.jpg"][0])], "file string, sha1 string")
    change = {r["file"]: r["change"] for r in images.changed(now, before).collect()}
    assert change["gone.jpg"] == "gone" and change["train/Japan/images/none.jpg"] == "other" and "train/Japan/images/J_010.jpg" not in change and len(change) == 7


def test_index(spark, tmp_path):
    root = str(folder(tmp_path / "raw"))
    photos, notes = images.listed(spark, root), images.read_notes(spark, root)
    got = {r["image_id"]: r for r in images.index(photos, notes.unionByName(notes)).collect()}
    assert set(got) == {"J_007", "J_010", "none", "J+1 b"}
    r = got["J_007"]
    assert (r["source"], r["country"], r["frame_num"], r["labeled"], r["xml_zero_size"], r["jpeg_kb"]) == ("train", "Japan", 7, True, False, 2.0)
    assert (r["n_D00"], r["n_D10"], r["n_D20"], r["n_D40"], r["n_otros"], r["otros_clases"], r["has_damage"]) == (2, 0, 0, 1, 3, "D44,REPAIR", True)
    assert (got["J_010"]["xml_zero_size"], got["J_010"]["has_damage"], got["J_010"]["otros_clases"]) == (True, False, "D43")
    assert (got["none"]["labeled"], got["none"]["frame_num"], got["none"]["otros_clases"]) == (False, -1, "") and got["J+1 b"]["labeled"]
    assert images.index(photos.limit(0), notes).count() == 0


def test_lists(spark, tmp_path):
    rows = [(i, f"p{i:03}", i % 4 == 0 if i % 7 else None) for i in range(200)]
    photos = spark.createDataFrame(rows, "image_id long, path string, has_damage boolean")
    splits = spark.createDataFrame([(i, ("train", "train", "fusion", "test", "despliegue")[i % 5]) for i in range(190)], "image_id long, split string")
    made = images.lists(photos, splits, 0.25, 7, 1)
    by = {}
    for r in made.collect():
        by.setdefault(r["list"], []).append(r["path"])
    damaged = {p for _, p, h in rows if h}
    shown = [p for p in by["train"] if p in damaged]
    assert len(by["train"]) - len(shown) == int(0.25 * len(shown) / 0.75 + 1e-9) and len(by["val"]) == 7 and set(by["val"]) <= set(by["fusion"])
    assert len(by["all"]) == 190 and len(by["test"]) == len(by["despliegue"]) == 38
    images.write_lists(made, str(tmp_path / "out"))
    for name, paths in by.items():
        parts = sorted((tmp_path / "out" / f"list={name}").glob("part-*"))
        assert [line for p in parts for line in p.read_text().splitlines()] == sorted(paths)
    assert images.lists(photos.limit(0), splits).count() == 0


def test_lists_join_once(spark):
    """Room, picks and all lists come from one pass over the photos."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    photos = spark.createDataFrame([(i, f"p{i}", i % 2 == 0) for i in range(100)], "image_id long, path string, has_damage boolean")
    splits = spark.createDataFrame([(i, ("train", "fusion", "test", "other", None)[i % 5]) for i in range(100)], "image_id long, split string")
    made = images.lists(photos.mapInArrow(counted, photos.schema), splits, 0.2, 5, 1)
    by = {k: sorted(r["path"] for r in made.collect() if r["list"] == k) for k in ("train", "val", "fusion", "test", "other", "all")}
    assert [len(by[k]) for k in by] == [12, 5, 20, 20, 0, 100] and by["test"] == sorted(f"p{i}" for i in range(2, 100, 5))
    assert read.value == 100
