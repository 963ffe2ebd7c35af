from tidelog import queries
from tidelog.operators import chain


def test_the_chain_is_built_over_all_keys(spark, monkeypatch):
    seen, build = [], chain.key_chain
    monkeypatch.setattr(chain, "key_chain", lambda log, *a: seen.append(log) or build(log, *a))
    rows = queries.QUERIES["key_walk"](spark, "/root/testdata/sf0.001").collect()
    assert rows and seen[0].select("key").distinct().count() > 1
