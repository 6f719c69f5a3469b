"""Phrases of any length against plain search."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quaylight.operators import extraction as ex
from quaylight.operators import phrases as ph


@pytest.mark.parametrize("size", [1 << 20, 200])
def test_find_phrases_equals_plain_search(spark, size):
    """One slice and many; phrases of 1 to 12 words that overlap, nest and repeat words."""
    rng = random.Random(4)
    words = ["a", "b", "ab", "steel", "works", "of"]
    known = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(80)})
    owned = [(p, str(i % 30)) for i, p in enumerate(known)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(100, None), (101, ""), (102, known[-1])]
    df = spark.createDataFrame(texts, "id long, text string").withColumn("phrase_of", F.lit("clash"))
    got = sorted((r.id, r.owner, r.phrase) for r in ph.find_phrases(df, "text", spark.createDataFrame(owned, "phrase string, owner string"), size=size).collect())
    want = []
    for i, t in texts:
        for o in sorted({o for _, o in owned}):
            hits = [p for p, who in owned if who == o and f" {p} " in f" {t or ''} "]
            if hits:
                want.append((i, o, max(hits, key=lambda p: (len(p), p))))
    assert got == sorted(want) and len(want) > 100


def test_no_phrases_and_no_texts(spark):
    texts, none = spark.createDataFrame([(1, "a b")], "id long, text string"), spark.createDataFrame([], "phrase string, owner string")
    assert ph.find_phrases(texts, "text", none).count() == 0
    assert ph.find_phrases(texts.where("id > 1"), "text", spark.createDataFrame([("a", "1")], none.schema)).count() == 0


def test_long_names_are_mentioned(spark):
    """A company of nine words, in capitals and in lower case, and a run of capitals far longer than any name."""
    name = "General Iron And Steel Works Of The Upper River Limited"
    directory = spark.createDataFrame([("1", name), ("2", "Acme Corp"), ("3", "Other Steel Works Of The Lower River")], "cik string, name string")
    shout = "TITLE " * 20_000
    rows = [(1, f"We buy from {name}."), (2, f"we buy from {name.lower()} and acme corp, too"), (3, f"{shout} acme corp {shout}"), (4, "Acme Corp and Acme Corp"), (4, "Acme Corp and Acme Corp"), (5, None)]
    got = ex.mentions_of(spark.createDataFrame(rows, "id long, text string"), "text", directory).collect()
    assert sorted((r.id, r.cik) for r in got) == [(1, "1"), (2, "1"), (2, "2"), (3, "2"), (4, "2")]
    by = {(r.id, r.cik): r.mention for r in got}
    assert by[1, "1"] == f"{name}." or by[1, "1"] == name
    assert by[2, "1"] == name.lower()
