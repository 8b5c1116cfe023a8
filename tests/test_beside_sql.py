"""Queries against their SQL on tables that are made for the case."""

from __future__ import annotations

from datetime import datetime

import pytest

from caselight import plans

from .both_engines import comparable, connect


def same_as_sql(spark, folder, name: str) -> None:
    got = comparable(plans.QUERIES[name](spark, str(folder)).toPandas())
    assert got == comparable(connect(str(folder)).sql(plans.ORACLE_SQL[name]).df())


TEXTS = [
    'token = "e52f79df5989ba29e6d6e123cc1ca80980660839"', "8 (912) 345-67-89 and 89123456789", "éjohn@mail.com x_a@b.com_y", "a@b.co1x@y.com", "a@b.com  12345678 z ",
    "ſ@ſſ.ſſ K@k.KK", "00000000-0000-1000-8000-000000000000", "ИНН 1234", "\t\x0b a@b.c 1234567 \x0c", "@@a@@b.cc", "логин abcd@", None, "",
]


def test_redaction_of_odd_texts(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").toPandas().to_parquet(tmp_path / "documents.parquet")
    same_as_sql(spark, tmp_path, "pii_redaction")


@pytest.mark.parametrize("name", ["replay_stream_equiv", "status_stream"])
def test_keys_across_arrow_batches(spark, tmp_path, name):
    """Keys of more rows than an Arrow batch holds, and many small ones that a batch cuts in two; rows come in disorder."""
    kinds = ("purchase", "signup", "view")
    rows = [(e, datetime(2024, 1, 1), e % 7 if e % 3 else 7 + e % 2000, kinds[e % 11 % 3], float(e % 97), f'{{"k": {e % 5}}}') for e in (i * 48_271 % 60_013 for i in range(1, 60_013))]
    made = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    made.toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    same_as_sql(spark, tmp_path, name)
