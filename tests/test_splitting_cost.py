"""What splitting many small files of all kinds costs: one plan for all of them, dealt evenly, and the same hash by words as by arrays."""

import glob

import pyarrow.parquet as pq

from reelbase.operators import walk
from reelbase.plans import queries as Q


def test_kinds_are_routed_by_one_plan_over_even_files(spark, sf, monkeypatch):
    plans, stage = [], Q.R.stage

    def seen(session, elements):
        plan = elements._jdf.queryExecution()
        plans.append((plan.optimizedPlan().toString(), elements.inputFiles()))
        return stage(session, elements)

    monkeypatch.setattr(Q.R, "stage", seen)
    Q.media_by_kind(spark, sf)
    (plan, paths), *more = plans
    assert not more and "Union" not in plan and plan.count("Relation") == 1
    assert not any(glob.glob(p.removeprefix("file:")) for p in paths)  # the files go once they are split
    assert len(paths) >= 20


def test_staged_files_have_so_many_rows_at_most(spark):
    t = Q.staged(spark.range(0, 1000, 1, 2), "rows", 300)
    sizes = [pq.ParquetFile(p.removeprefix("file:")).metadata.num_rows for p in t.inputFiles()]
    assert sorted(sizes) == [200, 200, 300, 300] and t.count() == 1000
    Q.discard(t)


def test_hash_by_words():
    for size in (0, 1, 7, 8, 15, 4000, 4008, 4015, 65_535, 65_536, 65_537, 131_073):
        b = bytes((k * 7 + k // 251 + 129) % 256 for k in range(size))
        words = sum(int.from_bytes(part[k : k + 8], "little") for part in (b[:65_536], b[max(0, size - 65_536) :]) for k in range(0, len(part) // 8 * 8, 8))
        assert walk.file_hash(lambda at, n, b=b: b[at : at + n] if at >= 0 else b"", size) == b"%016x" % ((size + words) % 2**64)
