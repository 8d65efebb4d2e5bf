"""A benchmark in several blocks is scrubbed as if it were one."""

import random

from nestra.llm import decontaminate


def both(spark, docs, items, **options):
    data = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(docs)], "doc_id long, text string, n_chars int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1)
    one, many = (sorted(map(tuple, decontaminate.scrub(data, bench, block_bytes=n, **options).collect())) for n in (1 << 20, 1))
    return one, many


def test_hits_of_several_blocks_count_together(spark):
    doc = "a b c x1 x2 d e f x3 x4"  # 30 % by each of two items
    one, many = both(spark, [doc], ["a b c", "d e f"])
    assert one == many == []


def test_a_passage_joined_by_a_cut_of_a_later_block_is_found(spark):
    one, many = both(spark, ["p q k l m r s " + "y " * 40, "fine text", None], ["p q r s", "k l m"])
    assert one == many and "p q" not in many[0][1] and many[0][2] == len(many[0][1])


def test_any_blocks_equal_one(spark):
    r = random.Random(4)
    word = lambda n: " ".join(r.choice("abcde") for _ in range(n))
    one, many = both(spark, [word(30) for _ in range(150)], [word(r.randint(2, 5)) for _ in range(5)], window=3, max_coverage=0.4)
    assert one == many and 0 < len(one) < 150
