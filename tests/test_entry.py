import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["o_orderdate", "o_totalprice"]


def test_every_query_of_the_library_has_an_oracle():
    from chronoweave.plans import registry
    assert set(registry.all_queries()) == set(registry.all_oracle_sql())


def test_contract_importable_without_session():
    import subprocess
    import sys
    code = ("import __spark_entry__ as E; q = E.queries(); o = E.oracle_sql(); "
            "assert set(o) <= set(q); print(len(q), len(o))")
    r = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120,
                       cwd=__import__("os").path.dirname(__import__("os").path.dirname(__file__)))
    assert r.returncode == 0, r.stderr[-2000:]
