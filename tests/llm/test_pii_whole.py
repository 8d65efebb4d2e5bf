"""Every type of entity is found and replaced at any length, and mentions of one entity agree."""

import re

import pytest
from pyspark.sql import functions as F

from nestra.llm import pii

# only what the pattern needs: no two digits near one another unless the type has them
SAMPLES = {
    "email": ["a@b.org"],
    "ip": ["1.2.3.4"],
    "secret": ["a" * 32, "A" * 500, "f" * 129, "AKIA" + "Q" * 16, "ghp_" + "q" * 36, "xoxb-" + "q" * 10, "xoxp-" + "q" * 300]
    + [f"{a}k_{b}_" + "q" * n for a in "spr" for b in ("live", "test") for n in (16, 24, 65, 400)],
    "iban": ["DE89 3704 0044 0532 0130 00"],
    "ssn": ["123-45-6789"],
    "card": ["4111111111111111"],
    "phone": ["+10175557713", "(017) 555-7713", "017-555-7713"],
    "name": ["Mr. John", "Госпожа Анна"],
}


@pytest.fixture(scope="module")
def replaced(spark):
    data = [(f"see {x} there", k) for k, xs in SAMPLES.items() for x in xs]
    return pii.replace(spark.createDataFrame(data, "text string, want string").withColumn("old", F.col("text"))).collect()


def test_every_type_is_replaced_at_any_length(replaced):
    assert {r["want"] for r in replaced} == set(pii.PATTERNS)
    for r in replaced:
        assert r["pii"] == 1 and r["text"] != r["old"], r["old"]


def test_hint_matches_whatever_a_pattern_matches(spark):
    data = spark.createDataFrame([(x,) for xs in SAMPLES.values() for x in xs], "text string")
    assert data.where(F.col("text").rlike(pii.ANY) & ~pii.hinted(F.col("text"))).count() == 0


def test_telephone_mentions_agree(spark):
    groups = [["+1 (017) 555-7713", "+10175557713", "+1-017-555-7713"], ["+49 30 1234567", "+49301234567"], ["+380 44 123 4567", "+380441234567"]]
    data = spark.createDataFrame([(i, x) for i, g in enumerate(groups) for x in g], "doc_id long, text string")
    digits = {}
    for r in pii.replace(data).collect():
        digits.setdefault(r["doc_id"], set()).add(re.sub("[^0-9]", "", r["text"]))
    assert all(len(d) == 1 for d in digits.values())
    assert [min(digits[i])[:n] for i, n in ((0, 1), (1, 2), (2, 3))] == ["1", "49", "380"]
