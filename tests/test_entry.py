import __spark_entry__


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
