import re

import __spark_entry__ as driver
from renewscope.llm import registry


def test_one_query_for_each_operator():
    queries, sql = registry.load()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries) == list(range(1, 14))
    assert set(sql) == {"op2_mix_sources", "op10_secret_scan", "op11_fingerprints", "op12_spelling_variants", "op13_filter_audit"}
    assert set(queries) | {"pipeline"} <= set(driver.queries()) and set(sql) <= set(driver.oracle_sql())
