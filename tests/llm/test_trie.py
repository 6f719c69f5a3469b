"""The conversation trie against one made of whole sequences."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quaylight.llm import trie

from . import brute

TURNS = "conv_id long, turn long, role string, text string"


def conversations(seed: int, n: int, longest: int, of: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 700), n):
        length = rng.choice([1, 2, 3, rng.randint(1, longest)])
        rows += [(c, i, rng.choice(["user", None, "bot"]) if i % 7 == 0 else "user", rng.choice([None, "", "a", "\u00e9\u00e8", "long text"][:of])) for i in range(length)]
    return rows


@pytest.mark.parametrize("height", [2, 16])
@pytest.mark.parametrize("seed, n, longest", [(1, 80, 9), (2, 25, 40)])
def test_trie(spark, height, seed, n, longest):
    rows = conversations(seed, n, longest)
    df = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit(1)).withColumn("a", F.lit("x")).repartition(3)
    assert sorted(map(tuple, trie.trie(df, height).collect()), key=repr) == brute.trie(rows)


def test_trie_of_odd_rows(spark):
    """Null ids, turns, roles and texts, repeated rows, a conversation left without turns, an empty table."""
    rows = [(None, 0, "user", "gone"), (100, None, None, None), (100, 3, "user", "b"), (100, None, "user", "")]
    rows += [(101, 0, "user", "x")] * 3 + [(205, 0, "user", "x"), (-7, 1, "user", "x"), (1000, 0, "user", "z")]
    got = sorted(map(tuple, trie.trie(spark.createDataFrame(rows, TURNS)).collect()), key=repr)
    want = brute.trie(rows)
    hashed = [r for r in got if r[1] != 1]  # the two null turns of 100 may stand either way round
    assert [r for r in want if r[1] != 1] == hashed and len(got) == len(want)
    assert trie.trie(spark.createDataFrame([], TURNS)).count() == 0


def test_members_of_a_hot_node_pass_in_strings(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 3)
    rows = [(c, 0, "user", "same") for c in range(0, 4000, 100)] + [(7, 0, "user", "other")]
    assert sorted(map(tuple, trie.trie(spark.createDataFrame(rows, TURNS).repartition(5)).collect()), key=repr) == brute.trie(rows)
