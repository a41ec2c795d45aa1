import pytest
from pyspark.sql import functions as F

from bspgraph.functions.aggregators import AggregatorSet, AggregatorType, aggregator_type, register


def filled(*rows):
    s = AggregatorSet()
    for row in rows:
        s.contribute(*row)
    return s


@pytest.mark.parametrize("values, both, either", [((True, True), True, True), ((True, False), False, True), ((False, False), False, False)])
def test_logical(spark, values, both, either):
    s = filled(*[("a", "and", v) for v in values], *[("o", "or", v) for v in values])
    assert (s.value("a"), s.value("o")) == (both, either)
    df = spark.createDataFrame([(v,) for v in values], "v boolean")
    assert tuple(df.agg(aggregator_type("and").column(F.col("v")), aggregator_type("or").column(F.col("v"))).first()) == (both, either)


def test_math_starts_with_the_first_value():
    s = filled(*[(k, k, v) for k in ("minInt", "maxInt", "sumInt") for v in (-3, -7)], ("low", "minInt", 5))
    assert [s.value(k) for k in ("maxInt", "minInt", "sumInt", "low")] == [-3, -7, -10, 5]


def test_zero_and_false_are_values():
    s = filled(("z", "minInt", 0), ("f", "or", False))
    assert s.value("z") == 0 and s.value("f") is False and "z" in s and len(s) == 2


def test_coercion():
    s = filled(("a", "sumInt", 1))
    for bad in (True, 1.5, "x"):
        with pytest.raises(TypeError):
            s.set_value("a", bad)
    with pytest.raises(TypeError):
        filled(("b", "and", 1))
    with pytest.raises(OverflowError):
        s.set_value("a", 2**63 - 1)


def test_set_calls():
    s = filled(("a", "sumInt", 1))
    with pytest.raises(ValueError):
        s.add("a", "sumInt")
    with pytest.raises(KeyError):
        s.set_value("b", 1)
    with pytest.raises(KeyError):
        s.remove("b")
    c = s.clone()
    s.remove("a")
    assert "a" not in s and c.value("a") == 1
    c.contribute("a", "minInt", 4)  # the first type stays
    assert c.value("a") == 5 and AggregatorSet.from_dict(c.to_dict()).value("a") == 5
    c.clear()
    assert not len(c)
    with pytest.raises(TypeError):
        s.frozen()["x"] = 1


def test_union():
    a, b = filled(("x", "sumInt", 1), ("y", "minInt", 3)), filled(("x", "sumInt", 2), ("z", "or", True))
    a.union_with(b)
    assert (a.value("x"), a.value("y"), a.value("z")) == (3, 3, True)
    with pytest.raises(TypeError):
        a.union_with(filled(("x", "minInt", 1)))


def test_registry(spark):
    with pytest.raises(ValueError):
        aggregator_type("none")
    register(AggregatorType("longest", lambda c: F.max(F.length(c)), max, int))
    with pytest.raises(ValueError):
        register(AggregatorType("longest", F.max, max, int))
    assert spark.createDataFrame([("a",), ("abc",)], "s string").agg(aggregator_type("longest").column(F.col("s"))).first()[0] == 3
