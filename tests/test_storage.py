"""Tables that are saved on the way, and go when they are used up."""

import os

from graphloom.storage import released, saved, scratch, shared_folder


def folders(spark):
    found = [os.path.join(top, d) for top, names, _ in os.walk(shared_folder(spark)) for d in names]
    return {os.path.basename(d) for d in found if not any(c in d for c in "_")}


def test_scratch_deletes_what_is_not_kept(spark):
    with scratch(spark):
        a = saved(spark.range(3), "outer-gone")
        with scratch(spark):
            b = saved(a, "inner-gone")
            c = saved(b, "inner-kept", keep=True)
            assert {"outer-gone", "inner-gone", "inner-kept"} <= folders(spark)
        assert "inner-gone" not in folders(spark) and c.count() == 3
        d = saved(c, "outer-kept", keep=True)
    assert not {"outer-gone", "inner-kept"} & folders(spark) and d.count() == 3


def test_a_failure_deletes_too(spark):
    try:
        with scratch(spark):
            saved(spark.range(3), "left")
            raise KeyError
    except KeyError:
        assert "left" not in folders(spark)


def test_all_can_be_released(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("graphloom.storage.shared_folder", lambda spark: str(tmp_path))
    saved(spark.range(3), "some")
    assert len(list(tmp_path.rglob("some"))) == 1 and released(spark) and not list(tmp_path.rglob("some"))
