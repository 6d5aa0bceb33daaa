"""Refreshes rebuild what differs, and count only when their manifest is complete."""

import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from codecat.streaming import refresh
from tests.conftest import FIXTURE_ROOT


def names(spark, out, table="types", repo=None, version=None):
    df = getattr(refresh.read_current(spark, out, version)[0], table)
    return sorted(r.name for r in (df if repo is None else df.where(F.col("repo") == repo)).collect())


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_refresh_stream_replaces_changed_repos(spark):
    work = tempfile.mkdtemp(prefix="codecat-stream-")
    src, out, ckpt = (os.path.join(work, x) for x in ("src", "catalog", "ckpt"))
    shutil.copytree(FIXTURE_ROOT, src)
    refresh.start(spark, src, out, ckpt).awaitTermination(400)
    zoo = names(spark, out, repo="zoo")
    assert names(spark, out, repo="garden") == ["Flower"] and "Otter" in zoo
    assert names(spark, out) == sorted([*zoo, "Flower"])
    first = refresh.current_version(spark, out)
    # a new file in one repository: only that repository is rebuilt
    write(os.path.join(src, "garden", "plants", "weeds.go"), "package plants\n\n// Weed grows anywhere.\ntype Weed struct{}\n")
    refresh.start(spark, src, out, ckpt).awaitTermination(400)
    assert names(spark, out, repo="garden") == ["Flower", "Weed"] and names(spark, out, repo="zoo") == zoo
    where = {r.repo: r.version for r in refresh.manifest(spark, out).collect()}
    assert where["zoo"] == first and where["garden"] == refresh.current_version(spark, out) > first
    assert names(spark, out, repo="garden", version=first) == ["Flower"]  # the earlier version can still be read


def test_refresh_after_deletions_and_failures(spark, monkeypatch):
    work = tempfile.mkdtemp(prefix="codecat-refresh-")
    src, out = os.path.join(work, "src"), os.path.join(work, "catalog")
    for repo in ("one", "two", "three"):
        write(f"{src}/{repo}/go.mod", f"module example.org/{repo}\n")
        write(f"{src}/{repo}/a.go", f"package {repo}\n\nvar Level = 1\n\ntype T{repo} struct{{ N int }}\n")
    write(f"{src}/one/b.go", "package one\n\ntype Extra struct{}\n")
    assert refresh.current_version(spark, out) is None
    first = refresh.refresh(spark, src, out)
    assert names(spark, out) == ["Extra", "Tone", "Tthree", "Ttwo"] and len(names(spark, out, "vars")) == 3
    assert refresh.refresh(spark, src, out) is None  # nothing differs

    # A deleted file, and a repository that no longer fills a table.
    os.remove(f"{src}/one/b.go")
    write(f"{src}/two/a.go", "package two\n\ntype Ttwo struct{ N int }\n")
    wrote, real = [], refresh.write_snapshot

    def failing(df, path):
        if len(wrote) == 3:
            raise RuntimeError("lost")
        wrote.append(path)
        real(df, path)

    monkeypatch.setattr(refresh, "write_snapshot", failing)
    with pytest.raises(RuntimeError):
        refresh.refresh(spark, src, out)
    assert refresh.current_version(spark, out) == first and "Extra" in names(spark, out)  # as if nothing had run
    monkeypatch.setattr(refresh, "write_snapshot", real)
    second = refresh.refresh(spark, src, out)
    assert second > first and names(spark, out) == ["Tone", "Tthree", "Ttwo"]
    assert names(spark, out, "vars", "two") == [] and len(names(spark, out, "vars")) == 2

    # A repository that is gone, with nothing to rebuild.
    shutil.rmtree(f"{src}/three")
    third = refresh.refresh(spark, src, out)
    assert names(spark, out) == ["Tone", "Ttwo"] and third > second
    assert {r.repo for r in refresh.manifest(spark, out).collect()} == {"one", "two"}
    assert refresh.vacuum(spark, out) > 0 and names(spark, out) == ["Tone", "Ttwo"]
    assert refresh.current_version(spark, out) == third
