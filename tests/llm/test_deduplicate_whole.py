"""Different documents that share a doc_id, or have none, are not repeats of one another."""

import random

from nestra.llm import simhash


def text(seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=7)) for _ in range(60))


def test_different_texts_of_one_id_and_of_no_id_stay(spark):
    a, b, c, d, e = map(text, range(5))
    data = [(1, a), (1, b), (1, b), (None, c), (None, d), (None, d), (2, a), (3, e), (None, e)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((tuple(r) for r in simhash.deduplicate(docs).collect()), key=repr)
    assert got == sorted([(1, a), (1, b), (None, c), (None, d), (3, e)], key=repr)


def test_one_id_with_near_texts_keeps_one(spark):
    a = text(9)
    fps = {}
    for i in range(400):  # a near text with another fingerprint
        near = a + f" w{i}"
        fps.setdefault((simhash.fingerprint(near.encode()) ^ simhash.fingerprint(a.encode())).bit_count(), near)
    near = next(fps[n] for n in (1, 2, 3) if n in fps)
    docs = spark.createDataFrame([(5, a), (5, near), (6, near), (5, text(10))], "doc_id long, text string")
    got = [tuple(r) for r in simhash.deduplicate(docs).collect()]
    assert len(got) == 2 and (5, text(10)) in got and {x for x, _ in got} == {5}


def edited(words, share, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=7)) if r.random() < share else w for w in words)


def test_copies_with_scattered_edits_go(spark):
    """A word in a hundred differs: of the 180 words nearly all texts lose some, and their five-word sequences with them."""
    originals = [text(100 + i) + " " + text(200 + i) + " " + text(300 + i) for i in range(30)]
    copies = [edited(t.split(), 0.01, i) for i, t in enumerate(originals)]
    data = [(i, t) for i, t in enumerate(originals)] + [(1000 + i, t) for i, t in enumerate(copies)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    left = {r["doc_id"] for r in simhash.deduplicate(docs).collect()}
    assert set(range(30)) <= left and len(left) <= 33


def test_word_fingerprints_are_spelled_out():
    import xxhash

    for t in (text(1), "One two ONE", "x", ""):
        ws = sorted({w.encode() for w in t.lower().split()})
        want = []
        for i in range(simhash.ALIKE // 2):
            hs = [int.from_bytes(xxhash.xxh3_128_digest(w, seed=i), "big") for w in ws]
            bits = sum(1 << b for b in range(128) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
            want += [bits >> 64, bits & (1 << 64) - 1]
        assert [w % (1 << 64) for w in simhash.word_fingerprints(t.encode())] == want


def test_words_in_another_order_are_another_text(spark):
    words = text(5).split()
    rows = [(i, " ".join(random.Random(i).sample(words, len(words)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.deduplicate(docs).count() == 40
