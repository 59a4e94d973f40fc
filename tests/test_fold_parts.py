"""Folds hold few rows as objects at a time, however many rows a batch has."""

import pytest

from cuewright.operators import sequence as sq


def test_rows_that_hold_lists_are_taken_in_parts(spark):
    df = spark.range(600).selectExpr("id div 3 as file_id", "id as pos", "transform(sequence(1, 1000), x -> cast(x + id as double)) as level").coalesce(1)

    def step(rows):
        import gc

        held = sum(isinstance(x, dict) and "level" in x for x in gc.get_objects())
        yield {"file_id": rows[0]["file_id"], "n": len(rows), "sum": sum(map(sum, (r["level"] for r in rows))), "held": held}

    got = {r.file_id: r for r in sq.fold(df, ["file_id"], ["pos"], step, "file_id long, n long, sum double, held long").collect()}
    assert len(got) == 200 and all(r.n == 3 and r.sum == pytest.approx(3 * 500500 + 1000 * (9 * k + 3)) for k, r in got.items())
    assert max(r.held for r in got.values()) <= 200
