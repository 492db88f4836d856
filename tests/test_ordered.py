import hashlib
import random
import statistics
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casoteca.functions.ordered import exact_medians, hash_rank, running_totals


def brute(pairs, descending):
    out, total, sums = {}, 0, Counter()
    for value, weight in pairs:
        sums[value] += weight
    for value in sorted(sums, reverse=descending):
        total += sums[value]
        out[value] = (sums[value], total)
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from([-2.5, 0.0, 0.25, 0.5, 1.0, 7.0]), st.integers(0, 5)),
                min_size=1, max_size=60), st.booleans())
def test_running_totals(spark, pairs, descending):
    df = spark.createDataFrame(pairs, "v double, w int")
    got = running_totals(df, "v", {"w": F.sum("w")}, descending=descending, blocks=4).collect()
    assert {r["v"]: (r["w"], r["w__acum"]) for r in got} == brute(pairs, descending)
    assert {r["w__total"] for r in got} == {sum(w for _, w in pairs)}


def test_running_totals_with_a_hot_value_and_groups(spark):
    rng = random.Random(1)
    data = [("a", 0.5 if i % 3 else rng.random()) for i in range(3000)]
    data += [("b", rng.random()) for _ in range(500)]
    df = spark.createDataFrame(data, "g string, v double")
    got = running_totals(df, "v", {"n": F.count(F.lit(1))}, ["g"], blocks=16).collect()
    for g in "ab":
        want = brute([(v, 1) for k, v in data if k == g], False)
        assert {r["v"]: (r["n"], r["n__acum"]) for r in got if r["g"] == g} == want


def test_exact_medians(spark):
    rng = random.Random(2)
    data = [(20.0, 1.0), (40.0, rng.random()), (None, rng.random()), (None, 3.0)]
    df = spark.createDataFrame(data, "a double, b double")
    got = {r["atributo"]: r["mediana"] for r in exact_medians(df, ["a", "b"]).collect()}
    assert got == {"a": 30.0, "b": pytest.approx(statistics.median(b for _, b in data))}


def test_hash_rank(spark):
    data = [(str(i), i % 3 == 0) for i in range(500)]
    df = spark.createDataFrame(data, "k string, g boolean")
    got = {r["k"]: (r["posicao"], r["tamanho"]) for r in hash_rank(df, "g", "k", 1).collect()}
    for flag in (True, False):
        keys = sorted((k for k, g in data if g == flag),
                      key=lambda k: hashlib.md5(k.encode()).hexdigest())
        for position, key in enumerate(keys, 1):
            assert got[key] == (position, len(keys))
