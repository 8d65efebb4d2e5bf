"""Columns of any name, ties, empty tables and hostile texts in every operator and stage."""

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nestra.llm import chat, decontaminate, html_content, language, licenses, mixing, ogg, perplexity, pii, simhash

D = "/root/testdata/sf0.001"
NAMES = (
    "cut_key cut_id cut_size cut_words mix_epoch mix_words __size __key __id __mark __full __pieces __new __source __whole __part __text pii pieces row taken new fp fingerprint gone_id gone_fingerprint "
    "spans total hit cut kind first shard place of mark gone_mark size key id whole target n_words __spans __gone __fp __taken __trusted language posterior declared kept"
).split()


@pytest.fixture(scope="module")
def strange(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(60)
    rows = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (5, "", "en", None, 0)], docs.schema))
    return rows.select("*", *(F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES)).repartition(3)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_keep_columns_of_any_name(spark, strange, name, stage):
    out = stage(spark, strange, D)
    assert out.columns[: len(strange.columns)] == strange.columns
    assert name == "source_mix" or out.columns == strange.columns
    rows = out.collect()
    at = out.columns.index("doc_id")
    assert rows
    for r in rows:
        said = "-" if r[at] is None else str(r[at])
        assert all(r[strange.columns.index(n)] == f"{n}:{said}" for n in NAMES)
    nothing = stage(spark, strange.limit(0), D)
    assert nothing.count() == 0 and nothing.columns == out.columns
    if name == "source_mix":
        assert out.columns[-2:] == ["mix_epoch_2", "mix_words_2"]


def test_operators_take_columns_of_any_name(spark, strange):
    n = strange.count()
    bench, labels = spark.read.parquet(f"{D}/benchmark.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    assert simhash.near_duplicates(strange).count() == n
    assert licenses.scan(strange).count() == n and language.identify(strange).count() == n
    assert decontaminate.digest(decontaminate.matches(strange, bench)).count() == n
    assert perplexity.classify(strange, labels).count() == n and mixing.plan(strange).count() == n
    assert ogg.digest(ogg.media(strange)).count() == n
    assert decontaminate.scrub(strange, bench, block_bytes=1).columns == strange.columns
    found = pii.replace(strange)
    assert found.columns == [*strange.columns, "pii_2"] and found.count() == n


def test_turns_that_tie_are_ordered_by_text(spark):
    rows = [(1, 0, "user", t, "x") for t in ("a!", "a", "a<", "a\u0001", "a<|end|>")] + [(1, 0, None, "b", "x"), (1, None, "user", "z", "x"), (1, 0, "user", "a", "x")]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    got = [chat.parse(r["segment"])[1] for r in chat.expand(data).collect()]
    assert got == ["z", "b", "a", "a", "a\u0001", "a!", "a<", "a<|end|>"]


def test_every_example_is_written_out(spark):
    turns = spark.read.parquet(f"{D}/conversations.parquet")
    expanded = chat.expand(turns)
    got = {(r["conv_id"], r["example"]): r for r in chat.examples(expanded).collect()}
    talks = {}
    for r in turns.collect():
        talks.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    want = {}
    for conv, said in talks.items():
        context, k = "", 0
        for _, role, text in sorted(said):
            segment = f"<|turn|>{role}<|text|>{text}<|end|>"
            if role == "assistant":
                want[conv, k] = (context, text)
                k += 1
            context += segment
    assert got.keys() == want.keys() and len(got) > 20
    for key, (context, text) in want.items():
        r = got[key]
        assert chat.unescape(r["text"][r["loss_from"] : r["loss_to"]]) == text
        assert r["text"].endswith("<|end|>") and len(r["text"]) == r["loss_to"] + len("<|end|>")
        if "\\" not in r["text"]:
            assert r["text"].startswith(context)
    some = list(want)[:5] + [(-7, 0)]
    few = chat.render(expanded, spark.createDataFrame(some, "conv_id long, example long"))
    assert sorted((r["conv_id"], r["example"], r["text"]) for r in few.collect()) == sorted((*k, got[k]["text"]) for k in some[:5])
    short = chat.examples(expanded, most_chars=200).collect()
    assert len(short) == len(got)
    for r in short:
        assert chat.unescape(r["text"][r["loss_from"] : r["loss_to"]]) == want[r["conv_id"], r["example"]][1]


def test_hostile_pages_take_linear_time():
    model = html_content.Model(html_content.labelled_pages(50))

    def took(page):
        began = time.process_time()
        model.extract(page)
        return time.process_time() - began

    for part in ("<div>x", "<a ", "<i>x", "</b><div>", "<p><table><td><div>", "<!--", "<a '", "</div><li>", "&amp;<"):
        small, large = took(part * 4000), took(part * 16000)
        assert large < 12 * small + 1.0, part
    assert model.extract("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> it is, said the long text of this page</p></article>").startswith("so x=2 it is")


def test_every_ogg_packet_has_its_time():
    import random

    r = random.Random(9)
    for size in (64, 4096, 4097, 200_000):
        payload = r.randbytes(size)
        back, streams = ogg.load(ogg.store(payload))
        assert back == payload
        for k, stream in streams.items():
            ends = 0
            for packet, seconds in zip(stream.packets, stream.seconds):
                ends += ogg.samples_of(packet)
                assert seconds == ends / ogg.RATE, (size, k)
