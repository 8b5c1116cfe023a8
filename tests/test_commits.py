"""Writers of one table: idempotent rows, conflicts inside a batch and between writers, and a lost race."""

from __future__ import annotations

import pytest

from caselight.sources.commits import CommittedTable

SCHEMA = "k long, part string, v string"


@pytest.fixture
def store(spark, tmp_path):
    return CommittedTable(spark, str(tmp_path / "table"), SCHEMA, ["k", "part"])


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def held(table):
    return sorted(map(tuple, table.read().collect()))


def test_repeats_and_conflicts(spark, store):
    assert held(store) == [] and store.version() == 0
    first = frame(spark, (1, "a", "x"), (1, "b", None), (1, "a", "x"))
    assert store.add(first) == {"NEW": 2, "IDEMPOTENT": 0, "CONFLICT": 0}
    assert store.add(first) == {"NEW": 0, "IDEMPOTENT": 2, "CONFLICT": 0} and store.version() == 1
    # two contents of a new key in one batch: both are in conflict, and nothing of the batch is added
    assert store.add(frame(spark, (2, "a", "x"), (2, "a", "y"), (3, "a", "z"))) == {"NEW": 1, "IDEMPOTENT": 0, "CONFLICT": 2}
    # other content than what is stored, null included
    assert store.add(frame(spark, (1, "b", "now"), (1, "a", "x")))["CONFLICT"] == 1
    assert held(store) == [(1, "a", "x"), (1, "b", None)]
    assert store.add(frame(spark, (None, "a", "x"))) == store.add(frame(spark, (4, None, "x"))) == {"NEW": 1, "IDEMPOTENT": 0, "CONFLICT": 0}
    assert store.add(frame(spark, (None, "a", "x")))["IDEMPOTENT"] == 1 and store.version() == 3


@pytest.mark.parametrize(("other", "counts"), [((7, "a", "x"), {"NEW": 1, "IDEMPOTENT": 1, "CONFLICT": 0}), ((7, "a", "y"), {"NEW": 1, "IDEMPOTENT": 0, "CONFLICT": 1}), ((9, "a", "y"), {"NEW": 2, "IDEMPOTENT": 0, "CONFLICT": 0})])
def test_second_writer_judges_again(spark, store, other, counts):
    """Another writer commits between a writer's judgement and its commit."""
    create = store._create

    def late(number, folder):
        store._create = create
        assert CommittedTable(spark, store.folder, SCHEMA, ["k", "part"]).add(frame(spark, other))["NEW"] == 1
        return create(number, folder)

    store._create = late
    assert store.add(frame(spark, (7, "a", "x"), (8, "a", "x"))) == counts
    rows = held(store)
    assert other in rows and len({r[:2] for r in rows}) == len(rows)
    assert ((8, "a", "x") in rows) == (counts["CONFLICT"] == 0)


def test_rows_without_a_commit_are_not_there(spark, store):
    store.add(frame(spark, (1, "a", "x")))
    frame(spark, (5, "a", "lost")).write.parquet(f"{store.folder}/rows/left-behind")
    assert held(store) == [(1, "a", "x")]
