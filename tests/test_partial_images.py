"""Images that a destination without history can't complete raise."""

import pytest

from driftline.operators import sinks
from driftline.pipeline import LOG_SCHEMA, LakeDestination, Table


def events(spark, *rows):
    return spark.createDataFrame([(1, op, lsn, 1, new, old) for op, lsn, new, old in rows], LOG_SCHEMA.replace("decimal(20,0)", "long")).selectExpr("table_id", "op", "cast(commit_lsn as decimal(20,0)) commit_lsn", "tx_ordinal", "new", "old")


def test_lake_raises_on_partial_images(spark, tmp_path):
    table = Table(1, "id int, name string", ("id",), lambda: None)
    lake = LakeDestination(spark, str(tmp_path / "lake"), [table], buckets=2)
    lake.write_events(events(spark, ("I", 1, '{"id": 1, "name": "a"}', None), ("I", 2, '{"id": 2, "name": null}', None)), 1)
    for bad in (("U", 3, '{"id": 1}', None), ("I", 3, None, None), ("D", 3, None, None), ("D", 3, None, '{"name": "a"}'), ("U", 3, '{"id": 1, "name": "b"}', '{"name": "a"}')):
        with pytest.raises(Exception, match="partial image: operation"):
            lake.write_events(events(spark, bad), 2)
        assert {tuple(r) for r in lake.current(1).collect()} == {(1, "a"), (2, None)}
    lake.write_events(events(spark, ("U", 4, '{"id": 1, "name": null}', None), ("D", 5, None, '{"id": 2}')), 2)
    assert {tuple(r) for r in lake.current(1).collect()} == {(1, None)}


@pytest.mark.parametrize("destination", sorted(sinks.DELETE_IMAGES))
def test_strict_images(spark, destination):
    frame = lambda *rows: sinks.strict_images(spark.createDataFrame(rows, "op string, new_kind string, old_kind string"), destination)
    assert frame(("I", "full", None), ("U", "full", "key"), ("D", None, "full"), ("T", None, None)).count() == 4
    for bad in (("U", "partial", "key"), ("I", None, None), ("D", None, None)):
        with pytest.raises(Exception, match=f"{destination}: operation"):
            frame(bad).count()
    if destination == "iceberg":
        with pytest.raises(Exception, match="with new image none and old image key"):
            frame(("D", None, "key")).count()
    else:
        assert frame(("D", None, "key")).count() == 1
