from quaywise.plans import structure
from quaywise.session import read

DATA = "/root/testdata/sf0.001"


def test_lines_are_numbered_once_for_all_loads(spark, monkeypatch):
    seen = []
    load = structure.Store.load
    monkeypatch.setattr(structure.Store, "load", lambda self, rows, name: (seen.append(rows._jdf.queryExecution().executedPlan().toString()), load(self, rows, name))[1])
    assert structure.stored_sales(spark, DATA).count() == read(spark, DATA, "lineitem").select("l_orderkey", "l_partkey").distinct().count()
    assert len(seen) == 3 and not any("Window" in p for p in seen)
