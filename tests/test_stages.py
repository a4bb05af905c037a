"""Stages are written to the shared folder, replaced, and removed at the end of a run."""

from __future__ import annotations

from pathlib import Path

from ledgerloom.functions import stages


def test_stages_are_removed(spark, monkeypatch):
    monkeypatch.setattr(stages, "_written", {})  # those of other tests stay
    first = stages.cut(spark.range(5))
    second = stages.cut(first.selectExpr("id + 1 AS id"), instead_of=first)
    third = stages.cut(second.where("id > 3"))
    folders = [Path(d._cut_path.removeprefix("file://")) for d in (first, second, third)]
    assert [f.is_dir() for f in folders] == [False, True, True] and sorted(r.id for r in third.collect()) == [4, 5]
    assert stages.discard_stages(spark) == 2 and not any(f.is_dir() for f in folders)
    assert stages.discard_stages(spark) == 0
