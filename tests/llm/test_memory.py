"""The driver's memory between the steps of an operator."""

from tilewright.llm import common


def test_the_driver_gives_native_memory_back(spark, monkeypatch):
    assert common.trim_driver(spark)
    called = []
    monkeypatch.setattr(common, "trim_driver", lambda s: called.append(s))
    scratch = common.Scratch(spark, "memory")
    assert len(called) == 1
    assert scratch.write(spark.range(5), "a").count() == 5 and len(called) == 2
    scratch.drop()
