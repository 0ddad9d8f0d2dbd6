"""Snapshots, what changed between them, and the refresh of what changed."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lawloom.operators import snapshots
from lawloom.plans import pipeline
from lawloom.streaming.refresh import IndexTable

ROW = "doc_id long, text string, source string"


def compared(old, new):
    groups = [defaultdict(Counter), defaultdict(Counter)]
    for rows, own in zip((old, new), groups, strict=True):
        for row in rows:
            own[row[0]][row] += 1
    a, b = groups
    return {k: "added" if k not in a else "removed" if k not in b else "changed" for k in {*a, *b} if a.get(k) != b.get(k)}


def stored(spark, tmp_path, rows, name, **options):
    return snapshots.write_snapshot(spark.createDataFrame(rows, ROW), f"file://{tmp_path}/{name}", "doc_id", **options)


@pytest.mark.parametrize("parts", [(1 << 20, 1 << 20), (100, 100), (400, 50), (50, 400)])
def test_changes(spark, tmp_path, parts):
    # One key holds a third of all rows; null keys, null texts, copies whose number changes, rows in another order.
    r = random.Random(1)
    old = [(k, f"text {k}", "s") for k in range(600)] + [(7, f"hot {k}", None) for k in range(300)] + [(None, "x", "s"), (None, None, "s"), (601, None, "s"), (602, "c", "s"), (602, "c", "s")]
    new = [x for x in old if x[0] not in (5, 50)] + [(700, "new", "s"), (602, "c", "s"), (7, "hot again", None)]
    new = [(k, "other", s) if k in (9, 99, 601) else (k, s, t) if k == 400 else (k, t, s) for k, t, s in new]
    r.shuffle(new)
    a, b = (stored(spark, tmp_path, rows, name, rows_a_part=n) for rows, name, n in ((old, "a", parts[0]), (new, "b", parts[1])))
    got = {x.key: x.change for x in snapshots.changes(a, b).collect()}
    assert got == compared(old, new) and got[7] == "changed" and got[700] == "added" and got[5] == "removed"
    rows = snapshots.changed_rows(b, snapshots.changes(a, b)).collect()
    assert Counter(map(tuple, rows)) == Counter(x for x in new if got.get(x[0]) in ("added", "changed"))
    assert snapshots.changes(b, b).count() == 0


def test_null_keys_and_copies_are_changes(spark, tmp_path):
    a = stored(spark, tmp_path, [(None, "x", "s"), (1, "y", "s"), (1, "y", "s")], "a")
    b = stored(spark, tmp_path, [(None, None, "s"), (1, "y", "s")], "b")
    assert {(x.key, x.change) for x in snapshots.changes(a, b).collect()} == {(None, "changed"), (1, "changed")}
    assert snapshots.changed_rows(b, snapshots.changes(a, b)).count() == 2


def test_empty_snapshots_and_other_columns(spark, tmp_path):
    a, b = stored(spark, tmp_path, [], "a"), stored(spark, tmp_path, [(1, "x", "s"), (None, "y", "s")], "b")
    assert {(x.key, x.change) for x in snapshots.changes(a, b).collect()} == {(1, "added"), (None, "added")}
    assert {x.change for x in snapshots.changes(b, a).collect()} == {"removed"} and snapshots.changes(a, a).count() == 0
    clashing = spark.createDataFrame([(1, 2, "d")], "doc_id long, part int, digest string")
    assert snapshots.write_snapshot(clashing, f"file://{tmp_path}/c", "doc_id").rows.columns == ["doc_id", "bucket", "digest", "part"]
    with pytest.raises(ValueError):
        snapshots.changes(a, snapshots.Snapshot(spark, f"file://{tmp_path}/c"))


def test_equal_parts_are_not_read(spark, tmp_path):
    rows = [(k, f"text {k}", "s") for k in range(2000)]
    a, b = (stored(spark, tmp_path, x, name, rows_a_part=100) for x, name in ((rows, "a"), (rows[1:], "b")))
    differing = snapshots.differing_buckets(a, b)
    assert differing.count() == 1
    held = snapshots._held(a, differing, a.depth)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part", plan)
    assert held.select("part").distinct().count() == 1 and held.count() < 40


def test_refresh_of_what_changed_equals_a_full_one(spark, tmp_path, monkeypatch):
    old = [(k, f"first line of {k}\n\nsecond line {k}", "s") for k in range(60)] + [(100, "word " * 3000, "s"), (101, None, "s"), (102, "", "s")]
    new = [(k, "edited" if k in (3, 100) else t, s) for k, t, s in old if k not in (4, 44)] + [(200, "new one", "s")]
    parsed, build = [], pipeline.document_chunks

    def counted(docs, options):
        parsed.append(docs.count())
        return build(docs, options)

    monkeypatch.setattr(pipeline, "document_chunks", counted)
    table, whole = IndexTable(spark, f"{tmp_path}/index"), IndexTable(spark, f"{tmp_path}/whole")
    at = f"file://{tmp_path}/snapshots"
    assert pipeline.refresh_changed(spark.createDataFrame(old, ROW), table, at, rows_a_part=10).count() == len(old)
    docs = spark.createDataFrame(new, ROW)

    def broken(*_):
        raise RuntimeError("stopped half way")

    with monkeypatch.context() as m:
        m.setattr(IndexTable, "append", broken)
        with pytest.raises(RuntimeError):
            pipeline.refresh_changed(docs, table, at, rows_a_part=10)
    got = pipeline.refresh_changed(docs, table, at, rows_a_part=10)
    assert {(x.key, x.change) for x in got.collect()} == {(3, "changed"), (100, "changed"), (4, "removed"), (44, "removed"), (200, "added")}
    assert parsed == [len(old), 3, 3]
    pipeline.refresh_index(docs, whole)
    columns = sorted(whole.read().columns)
    rows = lambda t: Counter(str(x) for x in t.read().select(columns).collect())
    assert rows(table) == rows(whole) and sum(rows(table).values()) > 50
    version = table.next_version()
    assert pipeline.refresh_changed(docs, table, at, rows_a_part=10).count() == 0 and table.next_version() == version and parsed[-1] == 0
