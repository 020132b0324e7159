"""Generation, validation, profiling, fitting and inference on small tables."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom import queries
from tabloom.functions import special
from tabloom.functions.keyed import MASK, fnv1a64, inv_norm, mix64, salt, with_hashes, with_uniforms
from tabloom.functions.samplers import draw
from tabloom.operators import scan, stats
from tabloom.operators.fit import fit
from tabloom.operators.generate import generate, repair
from tabloom.operators.infer import infer
from tabloom.operators.validate import checks, violations
from tabloom.plans.spec import Law, parse
from tests.test_plans import LIBRARY

# From the public definition: seed 42, namespace customers.age, keys 0, 1, 2.
GOLDEN = [0x8976820EC15A4073, 0xBD32D85A73BE1F9B, 0xC98F0F1452AF79E7]


def test_hashes(spark):
    rows = with_hashes(spark.range(3), "id", {"h": salt(42, "customers.age")}).collect()
    assert [r.h & MASK for r in rows] == GOLDEN
    assert mix64(mix64(7 ^ salt(42, "customers.age"))) == with_hashes(spark.range(7, 8), "id", {"h": salt(42, "customers.age")}).first().h & MASK
    assert fnv1a64("") == 0xCBF29CE484222325
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    back = with_hashes(spark.range(5), "id", {"h": salt(-1, "x")})
    assert back.filter("h * 0 = 0").count() == 5


def test_inverse_normal(spark):
    got = spark.createDataFrame([(u,) for u in (0.001, 0.02425, 0.3, 0.5, 0.9, 0.9999, 0.0, 1.0)], "u double").select(inv_norm(F.col("u")).alias("z")).collect()
    for r, u in zip(got[:6], (0.001, 0.02425, 0.3, 0.5, 0.9, 0.9999), strict=True):
        assert abs(special.norm_cdf(np.array([r.z]))[0] - u) < 1e-8
    assert math.isnan(got[6].z) and math.isnan(got[7].z)


@pytest.mark.parametrize("law,mean,sd", [
    (Law("gamma", {"shape": 2.0, "scale": 3.0}), 6.0, math.sqrt(18)), (Law("beta", {"a": 2.0, "b": 5.0}), 2 / 7, math.sqrt(10 / (49 * 8))), (Law("exponential", {"rate": 0.5}), 2.0, 2.0),
    (Law("uniform", {"low": 1.0, "high": 3.0}), 2.0, 1 / math.sqrt(3)), (Law("poisson", {"lam": 4.2, "max": 63}), 4.2, math.sqrt(4.2)), (Law("bernoulli", {"p": 0.3}), 0.3, math.sqrt(0.21)),
    (Law("uniform_int", {"low": 1, "high": 6}), 3.5, math.sqrt(35 / 12)), (Law("uniform_int", {"low": 0, "high": 9, "max": 4}), 3.0, math.sqrt(2.0)), (Law("fixed", {"n": 3}), 3.0, 0.0),
    (Law("categorical", {"categories": list(range(100)), "probs": [0.01] * 100}), 49.5, math.sqrt(833.25)),
])
def test_laws(spark, law, mean, sd):
    r = with_uniforms(spark.range(20_000), "id", 1, {"u": "law"}).select(draw(law, F.col("u")).cast("double").alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(r[0] - mean) < 0.04 * max(sd, 0.01) + 1e-9 and abs(r[1] - sd) < 0.05 * sd + 1e-9


def test_zipf_is_one_rule_for_small_and_large_tables(spark):
    u = with_uniforms(spark.range(500), "id", 1, {"u": "z"})
    for n in (10, 500):
        cdf = special.zipf_cdf(1.1, n)
        rows = u.select("u", draw(Law("zipf", {"a": 1.1, "n": n}), F.col("u")).alias("x")).collect()
        assert all(r.x == min(np.searchsorted(cdf, r.u, side="left"), n - 1) for r in rows)


def test_zipf_beyond_its_table(monkeypatch):
    """Ranks past the head agree with the whole table's, and sums with plain ones."""
    n = 40_000
    u = np.linspace(1e-9, 1 - 1e-9, 20_001)
    for a in (0.0, 0.4, 1.0, 1.3, 3.0):
        want = np.clip(np.searchsorted(special.zipf_cdf(a, n), u, side="left"), 0, n - 1)
        got = special.zipf_rank(u, a, n, np.cumsum(np.arange(1, 2001, dtype=float) ** -a))
        assert (got[want < 1999] == want[want < 1999]).all() and abs(got - want).max() <= 1 and (got != want).mean() < 1e-3
        assert special.harmonic(a, n, 1000) == pytest.approx((np.arange(1, n + 1, dtype=float) ** -a).sum(), rel=1e-12)


def test_rank_correlations_at_once(spark):
    df = spark.createDataFrame([(i * 7 % 31, float(i % 5), i if i % 3 else None, 1) for i in range(90)], "a int, b double, c int, d int")
    got = stats.spearmans(df, ["a", "b", "c", "d"])
    for x, y in (("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")):
        rho, n = stats.spearman(df, x, y)
        assert got[x, y] == got[y, x] and got[x, y] == (pytest.approx(rho, abs=1e-12), n)
    assert stats.spearmans(df, []) == {} and stats.medians(df, {}) == {}


def test_too_many_categories(spark, monkeypatch):
    from tabloom.operators import fit as fitting

    monkeypatch.setattr(fitting, "MOST_CATEGORIES", 10)
    df = spark.range(11).select(F.col("id").cast("string").alias("s"))
    assert len(fitting.categories(df.limit(10), "s")[1]) == 10
    with pytest.raises(ValueError, match="more than 10"):
        fitting.categories(df, "s")


def test_partitions_do_not_matter(spark):
    plan = parse(LIBRARY)
    one, many = generate(spark, plan, partitions=1), generate(spark, plan, partitions=7)
    for n in one:
        a, b = ({tuple(r) for r in x[n].collect()} for x in (one, many))
        assert a == b and len(a) == one[n].count()
    other = generate(spark, plan, seed=8)
    assert {r.years for r in other["members"].limit(50).collect()} != {r.years for r in one["members"].limit(50).collect()}


def test_generated_tables_keep_their_promises(spark):
    plan = parse(LIBRARY)
    frames = {n: df.cache() for n, df in generate(spark, plan).items()}
    assert violations(plan, frames) == []
    assert [c for c, _ in frames["loans"].dtypes] == ["loan_id", "member_id", "fee", "returned_at", "taken_at", "fee_cents"]
    rho = frames["members"].select(F.corr("years", F.log("budget"))).first()[0]
    assert abs(rho - 0.4) < 0.1
    nulls = frames["loans"].select(F.avg(F.col("fee").isNull().cast("int"))).first()[0]
    assert 0 < nulls < 0.05
    lone = frames["loans"].filter("member_id < 300").unionByName(frames["loans"].limit(5))
    broken = {"members": frames["members"].filter("member_id <> 7").withColumn("joined_at", F.col("joined_at") + F.expr("interval 1000 days")), "loans": lone}
    bad = {(r["table"], r["check"]): r.bad_count for r in checks(plan, broken).collect()}
    assert bad["members", "row_count"] == 1 and bad["loans", "primary_key"] >= 5 and bad["loans", "foreign_key"] > 0 and bad["loans", "order"] > 0
    assert len(violations(plan, broken)) == sum(v > 0 for v in bad.values())


def test_null_rules(spark):
    """A nulled event of the same table doesn't null what follows it; a null event of the parent does."""
    at = {"kind": "datetime_uniform", "start": "2024-01-01", "end": "2024-02-01"}
    wait = {"kind": "exponential", "rate": 1.0}
    plan = parse({"version": 1, "tables": {
        "p": {"role": "root", "rows": 300, "primary_key": "id", "columns": {"id": {"type": "int64", "generator": "key"}, "a": {"type": "timestamp", "distribution": at, "null_rate": 0.5}, "b": {"type": "timestamp", "temporal": {"anchor": "a", "delay": wait}}}},
        "c": {"role": "child", "parent": "p", "cardinality": {"kind": "fixed", "n": 1}, "child_stride": 2, "primary_key": "id", "columns": {"id": {"type": "int64", "generator": "key"}, "pid": {"type": "int64", "generator": "parent_key"}, "a": {"type": "timestamp", "generator": "parent:a"}, "e": {"type": "timestamp", "temporal": {"anchor": "p.a", "delay": wait}}, "f": {"type": "timestamp", "temporal": {"anchor": "a", "delay": wait}}}},
    }})
    g = generate(spark, plan)
    assert g["p"].filter("b IS NULL").count() == 0
    assert g["c"].filter("(a IS NULL) <> (e IS NULL) OR (a IS NULL) <> (f IS NULL)").count() == 0
    assert 100 < g["c"].filter("a IS NULL").count() < 200


def test_keys_wrap(spark):
    key = {"type": "int64", "generator": "key"}
    link = {"type": "int64", "generator": "parent_key"}
    tables = {"t0": {"role": "root", "rows": 40, "primary_key": "k", "columns": {"k": key}}}
    for i in range(1, 4):
        tables[f"t{i}"] = {"role": "child", "parent": f"t{i - 1}", "primary_key": "k", "cardinality": {"kind": "fixed", "n": 1}, "child_stride": 1 << 22, "columns": {"k": key, "p": link}}
    out = generate(spark, parse({"version": 1, "tables": tables}))["t3"].collect()
    assert sorted(r.k for r in out) == sorted((lambda v: v - (1 << 64) if v >> 63 else v)((i << 66) % (1 << 64)) for i in range(40))


def test_repair():
    m = repair([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])
    assert np.allclose(np.diag(m), 1) and np.linalg.eigvalsh(m).min() > 0


def test_fit_recovers_what_was_generated(spark):
    plan = parse(LIBRARY)
    big = replace(plan, tables={n: replace(t, rows=4000) if t.role == "root" else t for n, t in plan.tables.items()})
    frames = {n: df.cache() for n, df in generate(spark, big).items()}
    got = fit(frames, plan)
    c, o = got.tables["members"], got.tables["loans"]
    assert abs(c.columns["budget"].distribution.params["mu"] - 5.2) < 0.05
    assert abs(c.copulas[0].correlation[0][1] - 0.4) < 0.05
    assert dict(zip(c.columns["branch"].distribution.params["categories"], c.columns["branch"].distribution.params["probs"], strict=True))["hill"] == pytest.approx(0.5, abs=0.03)
    assert abs(o.cardinality.params["lam"] - 3.5) < 0.15 and o.child_stride > o.cardinality.params["max"]
    returned = o.columns["returned_at"].temporal.law
    assert returned.kind == "lognormal" and abs(returned.params["mu"] - 13.2) < 0.05 and abs(returned.params["sigma"] - 0.4) < 0.05
    assert plan == parse(LIBRARY)
    with pytest.raises(ValueError, match="clamp"):
        fit(frames, plan, epsilon=1.0)
    with pytest.raises(ValueError, match="epsilon"):
        fit(frames, plan, epsilon=0)
    held = parse({**LIBRARY, "tables": {"members": {**LIBRARY["tables"]["members"], "columns": {k: v | ({"clamp": [1, 1e6]} if k == "budget" else {}) for k, v in LIBRARY["tables"]["members"]["columns"].items()}}}})
    a, b = (fit({"members": frames["members"]}, held, epsilon=5.0, dp_seed=3) for _ in range(2))
    assert a == b and a != fit({"members": frames["members"]}, held)


def test_scan_and_infer(spark):
    customers = spark.range(300).select(F.col("id").alias("customer_id"), F.concat(F.lit("c"), F.col("id") % 4).alias("country"), (F.col("id") * 1.5 + 1).alias("spend"), F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(cast(id AS int))").alias("signup_at"))
    orders = spark.range(450).select(F.col("id").alias("order_id"), (F.col("id") % 200).alias("customer_id"), F.when(F.col("id") % 10 > 0, F.col("id") * 1.0).alias("amount"), F.expr("timestamp_ntz '2024-01-02' + make_dt_interval(cast(id % 200 AS int))").alias("placed_at"))
    cards = spark.range(0, 300, 2).select(F.col("id").alias("customer_id"), F.lit(True).alias("active"))
    frames = {"customers": customers, "orders": orders, "cards": cards}
    report = scan.scan({k: frames[k] for k in ("customers", "orders")})
    assert report.tables["customers"].pk == "customer_id" and report.tables["orders"].columns["amount"].null_rate == 0.1
    (r,) = report.relations
    assert (r.child, r.parent, r.coverage, r.max_children) == ("orders", "customers", 1.0, 3)
    assert "orders.customer_id -> customers.customer_id" in scan.render(report)
    assert scan.to_dict(report)["tables"]["customers"]["rows"] == 300
    plan, warnings = infer(frames, sources=[("crm", "c*")])
    t = plan.tables
    assert t["customers"].role == "root" and t["orders"].parent == "customers" and t["cards"].parent == "customers"
    assert t["cards"].primary_key == "cards_id" and t["cards"].cardinality.kind == "bernoulli"
    assert t["orders"].columns["placed_at"].temporal.anchor == "customers.signup_at"
    assert t["customers"].source == "crm" and t["orders"].source is None
    assert any("parent-as-pk" in w for w in warnings)
    assert infer(frames, sources=[("crm", "c*")])[0] == plan


def test_medians_and_ranks(spark, monkeypatch):
    df = spark.createDataFrame([(float(i * 7 % 101), float(i % 13)) for i in range(1000)], "x double, y double")
    want = stats.median(df, "x")
    monkeypatch.setattr(stats, "MEDIAN_ROWS", 10)
    assert stats.median(df, "x") == want
    import pandas as pd

    p = df.toPandas()
    rho, n = stats.spearman(df, "x", "y")
    assert n == 1000 and rho == pytest.approx(p["x"].rank().corr(p["y"].rank()), abs=1e-12)
    assert stats.spearman(df.limit(1), "x", "y")[0] == 0 and isinstance(pd.__version__, str)


def test_query_registry():
    assert set(queries.SQL) <= set(queries.QUERIES) and len(queries.SQL) > 30


@pytest.mark.parametrize("early", [0, 3])
def test_delays_are_joined_once(spark, monkeypatch, early):
    """However many passes a law takes; the same law as from the delays themselves."""
    from tabloom.operators import fit as fitting

    monkeypatch.setattr(stats, "MEDIAN_ROWS", 100)
    plan = parse({"version": 1, "tables": {
        "p": {"role": "root", "rows": 1, "primary_key": "p_id", "columns": {"p_id": {"type": "int64", "generator": "key"}, "at": {"type": "timestamp", "distribution": {"kind": "datetime_uniform", "start": "2024-01-01", "end": "2024-02-01"}}}},
        "c": {"role": "child", "parent": "p", "primary_key": "c_id", "cardinality": {"kind": "fixed", "n": 3}, "child_stride": 4, "columns": {"c_id": {"type": "int64", "generator": "key"}, "p_id": {"type": "int64", "generator": "parent_key"}, "done": {"type": "timestamp", "temporal": {"anchor": "p.at", "delay": {"kind": "exponential", "rate": 1.0}}}}},
    }})
    stamp = lambda x: F.timestamp_seconds(x).cast("timestamp_ntz")
    wait = F.when(F.col("id") % 10 < early, F.lit(-5)).otherwise(1 + F.pmod(F.xxhash64("id"), F.lit(999)))
    p = spark.range(3000).select(F.col("id").alias("p_id"), stamp(F.lit(1_700_000_000) + F.col("id")).alias("at"))
    c = spark.range(9000).select(F.col("id").alias("c_id"), (F.col("id") % 3000).alias("p_id"), stamp(F.lit(1_700_000_000) + F.col("id") % 3000 + wait).alias("done"))
    t = plan.tables["c"]
    s = fitting.delays(plan, t, t.columns["done"], {"p": p, "c": c})
    law = fitting.delay_law(s)
    waits = np.array([r[0] for r in spark.range(9000).select(F.greatest(wait, F.lit(0))).collect()], float)
    if early:
        assert law.kind == "exponential" and law.params["rate"] == pytest.approx(1 / waits.mean())
    else:
        assert law.kind == "lognormal" and law.params["mu"] == pytest.approx(np.median(np.log(waits)))
        assert law.params["sigma"] == pytest.approx(np.log(waits).std())
    assert "Join" not in s._jdf.queryExecution().optimizedPlan().toString()


def test_queries_with_delays_join_once(spark, tmp_path):
    """fit_delay shuffles its tables once."""
    from tabloom.queries import fit_delay

    n = 20_000
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("id"), F.lit(9_000_000)))
    spark.range(n).select(F.col("id").alias("o_orderkey"), at.alias("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(3 * n).select((F.col("id") % n).alias("l_orderkey"), at.alias("l_shipdate")).write.parquet(str(tmp_path / "lineitem.parquet"))
    sc, before = spark.sparkContext, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    sc.setJobGroup("delay", "delay")
    try:
        assert fit_delay(spark, str(tmp_path)).first().n == 3 * n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("delay") for s in sc.statusTracker().getJobInfo(j).stageIds}
    rows = sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    assert 4 * n <= rows < 4 * n + 1000
