"""Operators beside brute force, round trips and held-out pages, and on tables with odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nestra.llm import chat, decontaminate, html_content, language, licenses, mixing, ogg, pii, queries, simhash
from nestra.llm.common import stored
from nestra.llm.components import components

D = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in "documents benchmark conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    df = queries.queries()[name](spark, D)
    r = c.execute(queries.oracle_sql()[name])
    at = [[x[0] for x in r.description].index(k) for k in df.columns]
    shown = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    assert [shown(x) for x in rows(df)] == sorted((shown(row[i] for i in at) for row in r.fetchall()), key=repr)


def test_chat_round_trip(spark):
    turns = [(7, 1, "assistant", "a<|end|>b[INST]<\\|x</s>"), (7, 0, "user", None), (7, 1, "assistant", "a<|end|>b[INST]<\\|x</s>"), (None, 0, None, "<<SYS>>"), (8, None, "system", "")]
    data = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    out = chat.expand(data)
    said = sorted((chat.parse(r["segment"]) for r in out.collect()), key=repr)
    assert said == sorted(((t[2] or "", t[3] or "") for t in turns), key=repr)
    got = {r["conv_id"]: r for r in chat.digest(out).collect()}
    text = turns[0][3]
    assert got[7]["n_turns"] == 3 and got[7]["n_examples"] == 2 and got[8]["n_examples"] == 0
    assert got[7]["loss_sha256"] == hashlib.sha256((text * 2).encode()).hexdigest()
    assert got[7]["turns_sha256"] == hashlib.sha256(f"user\n\nassistant\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    example = chat.render(out, spark.createDataFrame([(7, 1)], "conv_id long, example long")).first()
    assert chat.unescape(example["text"][example["loss_from"] : example["loss_to"]]) == text
    assert chat.digest(chat.expand(data.limit(0))).count() == 0


def brute(seq, items, window):
    spans, keys = set(), set()
    for key, item in items:
        n = min(window, len(item))
        for j in range(len(item) - n + 1 if n else 0):
            for i in range(len(seq) - n + 1):
                if seq[i : i + n] == item[j : j + n]:
                    spans.update(range(i, i + n))
                    keys.add(key)
    return spans, keys


def test_automaton_equals_brute_force():
    r = random.Random(3)
    for _ in range(150):
        word = lambda: r.choice([b"a", b"b", b"c"])
        items = [(k, [word() for _ in range(r.randint(0, 9))]) for k in range(4)]
        seq = [word() for _ in range(40)]
        spans, keys = decontaminate.SuffixAutomaton(items, 4).scan(seq)
        assert ({p for a, b in spans for p in range(a, b)}, keys) == brute(seq, items, 4)


def test_decontamination_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "quick brown FOX jumps"), (2, None), (3, ""), (1, "lazy dog")], "item_id long, text string")
    one = rows(decontaminate.digest(decontaminate.matches(odd, bench)))
    assert one == rows(decontaminate.digest(decontaminate.matches(odd, bench, block_bytes=1)))
    assert [r[2] for r in one if r[0] in (1, 5)] == [6, 6, 6] and len(one) == 7
    clean = decontaminate.scrub(odd, bench)
    assert clean.columns == odd.columns and clean.count() == 7
    assert decontaminate.matches(clean, bench).where("size(spans) > 0").count() == 0
    assert decontaminate.scrub(odd, bench, max_coverage=0.1).count() == 4
    assert decontaminate.matches(odd, bench.limit(0)).where("size(items) > 0").count() == 0


def test_fingerprint_is_spelled_out():
    for text in ("", "One", "a b c d", "Ünï cödé   three\tFour five", "w " * 200):
        seq = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        hs = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([seq] if 0 < len(seq) < 3 else [seq[i : i + 3] for i in range(len(seq) - 2)])]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        assert simhash.fingerprint(text.encode()) % (1 << 64) == want


@pytest.mark.parametrize("options", [{}, {"blocks": 5}, {"cell": 3}])
def test_links_join_what_all_pairs_join(spark, options):
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(r.randint(0, 12)):
            for b in r.sample(range(64), r.randint(1, 4)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    root = {f: f for f in fps}
    for _ in range(len(fps)):
        new = {f: min(root[g] for g in fps if (f ^ g).bit_count() <= 3) for f in fps}
        if new == root:
            break
        root = new
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    found = components(simhash.links(stored(spark.createDataFrame([(signed(f),) for f in fps], "fp long")), **options)).collect()
    classes = {}
    for f in fps:
        classes.setdefault(root[f], set()).add(signed(f))
    got = {}
    for node, top in found:
        got.setdefault(top, set()).add(node)
    assert {frozenset(c) for c in got.values()} == {frozenset(c) for c in classes.values() if len(c) > 1}


def test_near_duplicates_of_odd_rows(spark, odd):
    got = rows(simhash.near_duplicates(odd))
    assert len(got) == 7 and [r[2] for r in got if r[0] in (1, 5)] == [1, 1, 1]
    assert {r[1] for r in got if r[0] in (2, 3)} == {"0" * 16} and {r[2] for r in got if r[0] in (2, 3)} == {2}
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and rows(kept, "doc_id") == [(1,), (2,), (4,), (None,)]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_pii(spark, odd):
    texts = ["Mail A.b@X.org or a.b@x.org, +1 (017) 555-7713, +1-017-555-7713", "Mr. John Smith met Mrs Anna Smith", "4111 1111 1111 1111", "plain text 12 of 3.5", None, " 10.0.0.1"]
    data = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("pii", F.lit("clash"))
    got = {r["doc_id"]: r for r in pii.replace(data).collect()}
    assert [got[i]["pii_2"] for i in range(6)] == [4, 2, 1, 0, 0, 1] and {got[i]["pii"] for i in range(6)} == {"clash"}
    a, b = re.findall(r"\S+@[\w.]+", got[0]["text"])
    assert a.lower() == b and "x.org" not in b
    x, y = re.findall(r"\+1[ -]\(?(\d{3})\)?[ -](\d{3}-\d{4})", got[0]["text"])
    assert x == y and x != ("017", "555-7713")
    names = re.fullmatch(r"Mr\. \w+ron (\w+) met Mrs \w+na (\w+)", got[1]["text"])
    assert names[1] == names[2] != "Smith"
    digits = [int(c) for c in got[2]["text"] if c.isdigit()]
    assert sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert got[3]["text"] == texts[3] and got[4]["text"] is None and got[5]["text"].startswith(" ")
    assert pii.replace(odd).where("pii > 0").count() == 0 and pii.replace(odd.limit(0)).count() == 0


def test_licences(spark, odd):
    index = licenses.Index({b"mit": 3.0, b"license": 1.0})
    seq = "released under the mit license and under the mit license apache license version 2 0 cc by nc".encode().split()
    starts, base, labels, score = index.scan(seq)
    assert sorted(starts) == [1, 6, 10, 15] and base == {"mit", "apache-2", "cc-by-nc"} == labels and score == 1.0
    assert index.scan(b"permission is hereby granted free of charge to any person".split())[2] == set()
    text, _ = licenses.TEXTS["mit"]
    assert index.scan(("x " * 9 + text.replace("merge", "join")).encode().split())[2] == {"mit"}
    got = licenses.scan(odd)
    assert got.count() == 7 and got.where("n_base > 0").count() == 0 and licenses.scan(odd.limit(0)).count() == 0


def test_base_phrases_equal_a_plain_search(spark):
    docs = dict(rows(spark.read.parquet(f"{D}/documents.parquet"), "doc_id", "text"))
    for doc, n, base, first, last, *_ in rows(queries.op5_licenses(spark, D)):
        seq = [w.decode() for w in licenses.words((docs[doc] or "").encode())]
        at = [i for p in licenses.BASE for i in range(len(seq)) if seq[i : i + len(p.split())] == p.split()]
        assert (n, base, first, last) == (len(seq), len(at), min(at, default=None), max(at, default=None))


def test_pages():
    model = html_content.Model(html_content.labelled_pages())
    right = total = 0
    for page in html_content.labelled_pages(60, seed=99):
        nodes, _ = html_content.parse(page)
        for n in nodes:
            n.label = n.label if n.label is not None else n.parent.label if n.parent else True
        for n, p in zip(nodes, model.marginals(nodes)):
            right, total = right + ((p >= 0.5) == n.label), total + 1
    assert right / total > 0.97
    page = "<body><nav><a href=/>Home</a></nav><article><h1>A&amp;B</h1><p>one <b>two<br>three<p>four\n five</article><div class=comments><p>so bad</p></div><footer>&copy; x</footer>"
    assert model.extract(page) == "A&B one two three four five"
    assert model.extract("") == "" and model.extract("< 3 <p") in ("", "< 3 <p")


def test_marginals_are_exact():
    model = html_content.Model(html_content.labelled_pages(20))
    nodes, _ = html_content.parse("<div class=ad><p>x</p></div><article><p>some words here</p><ul><li>y</ul></article>")
    number = {id(n): i for i, n in enumerate(nodes)}
    weights = np.zeros((len(nodes), 2))
    for state in np.ndindex(*[2] * len(nodes)):
        logs = model.root[state[0]]
        for i, n in enumerate(nodes):
            logs += sum(model.node.get(f, (0, 0))[state[i]] for f in html_content.features(n))
            if n.parent:
                logs += model.edge[state[number[id(n.parent)]]][state[i]]
        for i, s in enumerate(state):
            weights[i, s] += np.exp(logs)
    assert np.allclose(model.marginals(nodes), weights[:, 1] / weights.sum(1))


def test_language(spark, odd):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    found = language.identify(docs)
    assert found.where("language <> declared").count() == 0 and found.where("not kept").count() <= 2
    assert language.keep(docs).columns == docs.columns
    assert language.identify(odd).count() == 7 and language.identify(odd.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, "你好世界" * 50, "en", "src0"), (2, None, None, None)], docs.select("doc_id", "text", "lang", "source").schema)
    assert [r["kept"] for r in language.identify(nothing, language.fit(docs)).orderBy("doc_id").collect()] == [False, False]


def test_ogg_pages():
    r = random.Random(1)

    def plain(data):
        crc = 0
        for b in data:
            crc ^= b << 24
            for _ in range(8):
                crc = crc << 1 ^ 0x104C11DB7 if crc >> 31 else crc << 1
        return crc

    assert ogg.checksum(b"OggS test \x00\xff") == plain(b"OggS test \x00\xff")
    for sizes in ([0], [255], [254, 255, 256], [70000, 0, 10], [510] * 5):
        packets = [(r.randbytes(n), 10 * (i + 1)) for i, n in enumerate(sizes)]
        pages = ogg.pages_of(9, packets, most=7)
        streams, bad = ogg.demux(ogg.mux([pages, ogg.pages_of(4, [(b"x", 1)])]), rate=10)
        assert bad == 0 and streams[9].packets == [p for p, _ in packets] and streams[9].seconds[-1] == len(sizes)
        broken = bytearray(b"".join(pages))
        broken[-1 if sizes != [0] else 4] ^= 1
        assert ogg.demux(bytes(broken))[1] >= 1


def test_ogg_rows(spark, odd):
    got = ogg.digest(ogg.media(odd)).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in got:
        payload = ogg.padded((texts[r["doc_id"]] or "").encode())
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len(got) == 7 and len({r["media_sha256"] for r in got}) == 5


def test_mixing(spark, odd):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    plan = mixing.plan(docs, slice_rows=2)
    by = plan.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("want"), F.first("source_size").alias("s")).collect()
    assert all(abs(r["t"] - r["want"]) < 1 and r["want"] <= 2 * r["s"] for r in by)
    assert rows(plan) == rows(mixing.plan(docs)) and plan.where("taken > 2 * size").count() == 0
    mixed = mixing.mix(docs)
    words = mixed.select(mixing.size(F.col("text")).alias("n"), "mix_words").agg(F.sum("n"), F.sum("mix_words")).first()
    assert words[0] == words[1] == sum(r["t"] for r in by)
    assert mixing.plan(odd).count() == 7 and mixing.plan(odd.limit(0)).count() == 0
    assert mixing.mix(odd).columns[: len(odd.columns)] == odd.columns


def test_water_levels(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 200 and got["b"] == 20 and got[None] == 0 and abs(got["c"] - 1445) < 1e-9
