"""Structure of tables of which one refers to a child table, as lineitem does to supplier."""

from tabloom import queries
from tabloom.operators import infer


def test_reference_to_a_child_table(spark):
    frames = {
        "nation": spark.createDataFrame([(i,) for i in range(3)], "nationkey long"),
        "supplier": spark.createDataFrame([(i, i % 3) for i in range(30)], "suppkey long, nationkey long"),
        "part": spark.createDataFrame([(i,) for i in range(25)], "partkey long"),
        "orders": spark.createDataFrame([(i,) for i in range(60)], "orderkey long"),
        "lineitem": spark.createDataFrame([(i // 2, i % 25, i * 7 % 30) for i in range(120)], "orderkey long, partkey long, suppkey long"),
    }
    plan, warnings = infer.infer(frames)
    t = plan.tables["lineitem"]
    assert (t.parent, t.primary_key, plan.tables["supplier"].parent) == ("orders", "lineitem_id", "nation")
    assert {c: t.columns[c].reference for c in ("partkey", "suppkey")} == {"partkey": "part", "suppkey": None}
    assert t.columns["suppkey"].distribution is not None
    assert any("'suppkey' holds keys of 'supplier'" in w for w in warnings)


def test_query_takes_all_tables(spark, monkeypatch):
    seen = {}

    class Plan:
        tables = {}

    monkeypatch.setattr(queries.inference, "infer", lambda frames: (seen.update(frames), (Plan, []))[1])
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: spark.createDataFrame([(1,)], "a long"))
    queries.infer_structure(spark, "unread")
    assert set(seen) == set(queries.PREFIX)
