"""Row numbers and carried values against plain loops, with a hot group, nulls and ties."""

import random

import pytest

from quaystone.operators.ranking import spread_last


@pytest.mark.parametrize("hot", [False, True])
def test_last_value_is_carried(spark, hot):
    rng = random.Random(3)
    rows = [(("a" if hot or rng.random() < 0.5 else rng.choice(["b", None])), rng.choice([None, *range(9)]), i, rng.choice([None, i])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, t int, i long, v long").repartition(7)
    got = {r.i: r.out for r in spread_last(df, ["g"], ["t", "i"], "v", "out").collect()}
    want, held = {}, {}
    for g, t, i, v in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2])):
        held[g] = v if v is not None else held.get(g)
        want[i] = held[g]
    assert got == want


def test_nothing_to_carry(spark):
    assert spread_last(spark.createDataFrame([], "g string, t int, v long"), ["g"], ["t"], "v", "out").count() == 0
