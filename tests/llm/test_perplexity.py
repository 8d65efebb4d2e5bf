"""The quality model beside a plain modified Kneser-Ney in dictionaries, and on odd rows."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from nestra.llm import perplexity as P


def plain_discounts(counts):
    n = [max(1, sum(1 for c in counts if c == k)) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return [0.0] + [min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1)]


def plain_byte_model(words):
    grams = Counter()
    for w in words:
        s = [2, 2, *w, 3]
        grams.update(tuple(s[i - 2 : i + 1]) for i in range(2, len(s)))
    levels = []
    for k in (3, 2, 1):
        if k < 3:
            grams = Counter(g[1:] for g in grams)
        d = plain_discounts(grams.values())
        total, left = Counter(), defaultdict(float)
        for g, n in grams.items():
            total[g[:-1]] += n
            left[g[:-1]] += d[min(n, 3)]
        levels.append((grams, d, total, left))

    def p(gram):
        out = 1 / 256
        for k, (grams, d, total, left) in zip((1, 2, 3), levels[::-1]):
            g = gram[3 - k :]
            c = g[:-1]
            if total[c]:
                n = grams.get(g, 0)
                out = (n - d[min(n, 3)]) / total[c] + left[c] / total[c] * out
        return out

    def word(w):
        s = [2, 2, *w, 3]
        return sum(math.log(p(tuple(s[i - 2 : i + 1]))) for i in range(2, len(s)))

    return word


class Plain:
    def __init__(self, texts, vocabulary):
        seen = Counter(w for t in texts for w in t.encode().split())
        self.known = {w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:vocabulary]}
        self.spell = plain_byte_model(seen)
        self.pairs = Counter(p for t in texts if t.split() for p in self.of(t))
        self.d, self.total, self.left = plain_discounts(self.pairs.values()), Counter(), defaultdict(float)
        for (v, _), n in self.pairs.items():
            self.total[v] += n
        for (v, _), n in self.pairs.items():
            self.left[v] += self.d[min(n, 3)]
        self.before = Counter(w for _, w in self.pairs)
        self.b = plain_discounts(self.before.values())

    def of(self, text):
        seq = ["<s>", *(w if w in self.known else None for w in text.encode().split()), "</s>"]
        return list(zip(seq, seq[1:]))

    def perplexity(self, text):
        every = sum(self.before.values())
        rest = sum(self.b[min(n, 3)] for n in self.before.values()) / every
        logs = symbols = 0
        for v, w in self.of(text):
            n = self.before[w]
            p = (n - self.b[min(n, 3)]) / every + rest / (len(self.known) + 2)
            if self.total[v]:
                n = self.pairs[v, w]
                p = (n - self.d[min(n, 3)]) / self.total[v] + self.left[v] / self.total[v] * p
            logs += math.log(p)
        for w in text.encode().split():
            symbols += len(w) + 1
            if w not in self.known:
                logs += self.spell(w)
        return symbols, math.exp(-logs / symbols) if symbols else None


def corpus(n, seed, words=40):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeé", k=r.randint(1, 6))) for _ in range(words)]
    follow = {w: r.choices(vocabulary, k=3) for w in vocabulary}

    def text():
        out = [r.choice(vocabulary)]
        for _ in range(r.randint(0, 30)):
            out.append(r.choice(follow.get(out[-1], vocabulary)) if r.random() < 0.8 else "".join(r.choices("abxyz", k=4)))
        return r.choice([" ", "\n", "  "]).join(out)

    return [text() for _ in range(n)]


@pytest.mark.parametrize("vocabulary", [P.VOCABULARY, 10])
def test_equals_plain_counts(spark, monkeypatch, vocabulary):
    texts = corpus(80, 1)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(100, "", "x"), (101, None, None), (3, texts[3], "x"), (None, texts[5], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 50), 0) for i in range(102)], "doc_id long, quality int, toxic int")
    got = P.score(docs, labels, vocabulary).collect()
    out = {r["doc_id"] for r in got if r["held_out"]}
    model = Plain([t for i, t, _ in rows if i is not None and i < 50 and i not in out and t], vocabulary)
    assert len(got) == len(rows) and 0 < len(out) < 20
    want = {i: model.perplexity(t or "") for i, t, _ in rows}
    for r in got:
        symbols, value = want[r["doc_id"]]
        assert r["symbols"] == symbols and r["trusted"] == (r["doc_id"] is not None and r["doc_id"] < 50)
        assert (r["perplexity"] is None) == (value is None)
        if value:
            assert math.isclose(r["perplexity"], value, rel_tol=1e-6), r


def test_small_packs_give_the_same(spark, monkeypatch):
    texts = corpus(60, 2)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)], "doc_id long, quality int")
    one = sorted(map(tuple, P.score(docs, labels).collect()))
    numbered, known = P._numbered, P.KNOWN
    monkeypatch.setattr(P, "_numbered", lambda batches, number, *_: numbered(batches, number, 50, 4))
    monkeypatch.setattr(P, "KNOWN", 0)
    many = sorted(map(tuple, P.score(docs, labels).collect()))
    assert known and len(one) == len(many)
    assert all(a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-6) for a, b in zip(one, many))


def test_large_counts_take_several_entries():
    import numpy as np

    pairs, n = P._split(np.array([5, 9], np.uint64), np.array([9000, 3]))
    ((shard, data),) = P._packs(pairs, n)
    keys, counts = P._counted(data)
    assert shard == 0 and keys.tolist() == [5, 9] and counts.tolist() == [9000, 3]


def test_word_order_counts(spark):
    r = random.Random(7)
    texts = corpus(200, 3)
    shuffled = [" ".join(r.sample(t.split(), len(t.split()))) for t in texts[:60]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts + shuffled)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(60 <= i < 200)) for i in range(260)], "doc_id long, quality int")
    got = {r["doc_id"]: r["perplexity"] for r in P.score(docs, labels).collect()}
    long = [i for i in range(60) if len(texts[i].split()) > 8]
    assert sum(got[200 + i] > got[i] for i in long) > 0.9 * len(long)


def test_probabilities_add_up(spark):
    texts = corpus(40, 4, words=8)
    model, pairs = P.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    import numpy as np

    choices = [P.UNKNOWN, P.END, *model.number.values()]
    counts = {}
    for r in pairs.collect():
        low, n = P._counted(bytes(r["pack"]))
        counts |= dict(zip(P._whole(r["shard"], low).tolist(), n.tolist()))
    for v in (P.START, P.UNKNOWN, P.FIRST_WORD, P.FIRST_WORD + 5):
        keys = P._scrambled(np.full(len(choices), v), np.array(choices))
        logs = model.log_left[v] + model.log_lower[choices]
        logs += [model.gain(np.array([k], np.uint64), np.array([counts[k]]))[0] if k in counts else 0.0 for k in keys.tolist()]
        assert abs(np.exp(logs).sum() - 1) < 1e-9
    total = sum(math.exp(x) for x in model.spelling.logs([bytes([a]) for a in range(4, 256)] + [b""]))
    assert 0 < total < 1


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    got = P.classify(odd, labels)
    assert got.columns == ["doc_id", "lang", "symbols", "perplexity", "threshold", "kept"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == 7 and rows[2]["kept"] and rows[3]["perplexity"] is None and rows[4]["threshold"] is None
    assert P.classify(odd.limit(0), labels).count() == 0
    none = P.classify(odd, labels.limit(0))  # no trusted text: all words are spelled, nothing is rejected
    assert none.count() == 7 and none.where("not kept").count() == 0


class Mapped:
    """Stands for a table: what is mapped over its batches runs here and now."""

    def __init__(self, batches):
        self.batches = batches
        self.sparkSession = self.sparkContext = self

    def broadcast(self, value):
        return SimpleNamespace(value=value)

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        """The largest number of bytes that Python and numpy held, and the rows that came out."""
        tracemalloc.start()
        try:
            n = sum(b.num_rows for b in run(iter(self.batches)))
            return tracemalloc.get_traced_memory()[1], n
        finally:
            tracemalloc.stop()


@pytest.mark.parametrize("unknown", [False, True])
def test_a_worker_holds_numbers_not_words(monkeypatch, unknown):
    # three packs of documents whose words are all frequent, or all different and without a number
    monkeypatch.setattr(P._numbered, "__defaults__", (1 << 18, P.PACKED_DOCS))
    texts = [" ".join(f"{'u' if unknown else 'w'}{(i * 3000 + j) if unknown else j}" for j in range(3000)) for i in range(250)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(250)), pa.array(range(250)), pa.array(["x"] * 250), pa.array(texts)], names=["row", "doc_id", "lang", "text"])
    number = {b"w%d" % j: P.FIRST_WORD + j for j in range(3000)}
    grams, counts = np.unique(P.byte_grams(list(number))[0], return_counts=True)
    model = P._model(number, np.ones((P.IDS, 5), np.int64), np.ones(4, np.int64), P.Spelling(grams, counts))
    monkeypatch.setattr(P, "HELD", 10_000)
    peak, n = P._sent(Mapped([batch]), model)
    assert n > 250 and peak < (28 << 20), f"{peak / 2**20:.0f} MB for packs of 262,144 words"


def test_long_texts_are_taken_in_pieces(monkeypatch):
    texts = [t.encode() for t in corpus(30, 6)] + [b"", None, b" \n ", b"x" * 50 + b"\t" + b"y" * 70, b"  a  "]
    number = {w: i for i, w in enumerate(sorted({w for t in texts[:15] for w in t.split()}), P.FIRST_WORD)}
    for step in (1, 7, 1 << 17):
        monkeypatch.setattr(P, "STEP_BYTES", step)
        at = 0
        (pack,) = P._numbered([texts[:20], texts[20:]], number)
        words = iter(pack.unknown.split())
        for i, text in enumerate(texts):
            seq = (text or b"").split()
            ids = [number.get(w, P.UNKNOWN) for w in seq]
            assert pack.starts[i] == at and pack.symbols[i] == sum(map(len, seq)) + len(seq)
            assert pack.first[at : at + len(seq) + 1].tolist() == [P.START, *ids]
            assert pack.second[at : at + len(seq) + 1].tolist() == [*ids, P.END]
            assert [next(words) for _ in range(pack.unknowns[i])] == [w for w in seq if w not in number]
            at += len(seq) + 1
        assert at == len(pack.first) and next(words, None) is None
