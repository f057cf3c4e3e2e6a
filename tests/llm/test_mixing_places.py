import re

from corpusloom.llm import mixing
from tests import oracle
from tests.llm.test_native import documents


def test_texts_are_not_shuffled_and_both_ways_agree(spark, monkeypatch):
    df = documents(spark, 1500)
    df = df.unionByName(df.where("doc_id % 50 = 0")).unionByName(df.where("doc_id % 100 = 0"))  # rows of one name
    columns = df.columns
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if all tables were large
    try:
        plan = mixing.mixed_documents(documents(spark, 1500))._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and not re.search(r"\bExchange (hash|range|Single)", plan)
        placed = oracle.rows_of(columns, [tuple(r) for r in mixing.mixed_documents(df).collect()])
        monkeypatch.setattr(mixing, "MAX_RULES", 0)
        dealt = oracle.rows_of(columns, [tuple(r) for r in mixing.mixed_documents(df).collect()])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert placed == dealt and sum(placed.values()) > 1500
