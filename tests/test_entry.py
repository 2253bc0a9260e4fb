import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 28
    assert {"config", "accuracy", "mean_latency_ms", "n_tier1"} <= set(df.columns)
    for r in rows:
        assert r.n_tier1 + r.n_tier2 + r.n_tier3 == 200


def test_registry_consistency():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60
