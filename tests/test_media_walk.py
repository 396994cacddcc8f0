"""Listing by tasks against the binaryFile listing."""

import os

import pytest

from verdikt.sources.media import list_media, walk_media


@pytest.mark.parametrize("recursive", [False, True])
def test_walk_equals_listing(spark, tmp_path, recursive):
    root = tmp_path / "media root"
    for i, path in enumerate(["a.mp4", "b.MP4", "c.avi", "x/d.mp4", "x/y/e.mp4", "x/y/z/w/f.mp4", "empty/", "g.txt", "x.mp4/h.mp4"]):
        p = root / path
        (p if path.endswith("/") else p.parent).mkdir(parents=True, exist_ok=True)
        if not path.endswith("/"):
            p.write_bytes(b"x" * (i + 1))
    got = {(r.rel_path, r.name, r.length, r.modification_time) for r in walk_media(spark, str(root), recursive).collect()}
    want = {(r.name if not recursive else r.rel_path.replace("%20", " "), r.name, r.length) for r in list_media(spark, str(root), recursive).collect()}
    assert {g[:3] for g in got} == want and len(got) == len(want)
    for rel, _, _, at in got:
        assert abs(at.timestamp() - os.path.getmtime(root / rel)) < 0.01


def test_walk_of_an_empty_folder(spark, tmp_path):
    assert walk_media(spark, str(tmp_path)).count() == 0
