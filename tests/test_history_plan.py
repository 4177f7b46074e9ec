"""How often the complaint features are windowed and written."""

from tests.conftest import SF_SMALL


def test_history_rows_are_windowed_once_and_carried_by_broadcast(spark):
    from upkeep.operators.history import history_features
    df = spark.range(200).selectExpr("id % 5 as id", "date_add(date'2001-01-01', cast(id as int)) as tanggal", "id as seq", "id % 4 as sev")
    got = history_features(df, "id", "tanggal", "seq", "sev", partitions=7)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "rightHint=(strategy=broadcast)" in plan
    assert sorted(r.running_number for r in got.collect()) == sorted(list(range(1, 41)) * 5)


def test_encoded_complaints_are_written_once(spark, monkeypatch):
    from upkeep.plans import lifespan
    written, real = [], lifespan.materialize
    monkeypatch.setattr(lifespan, "materialize", lambda df: written.append(1) or real(df))
    lifespan.complaint_target_encoding(spark, SF_SMALL)
    assert len(written) == 1
