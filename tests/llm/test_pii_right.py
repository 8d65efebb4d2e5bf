"""Checks, scripts, distinctness and termination of surrogates, and the whole mapping beside plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from nestra.llm import pii


def replaced(spark, texts):
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in pii.replace(data).orderBy("doc_id").collect()]


def valid_card(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits)) % 10 == 0


def valid_iban(text):
    bare = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def test_checks_decide_and_hold(spark):
    texts = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "GB12 ABCD EFGH IJKL", "AB12 CODE WORD THIS", "4111 1111 1111 1111", "4111 1111 1111 1112", "order 9807915762804490 came"]
    out = replaced(spark, texts)
    assert out[2:4] == texts[2:4] and out[5:] == texts[5:]
    for i in (0, 1):
        assert out[i] != texts[i] and valid_iban(out[i]) and out[i][:2] == texts[i][:2] and re.sub("[0-9A-Z]", "x", out[i]) == re.sub("[0-9A-Z]", "x", texts[i])
    assert out[4] != texts[4] and valid_card(out[4]) and re.fullmatch(r"\d{4}( \d{4}){3}", out[4])


def test_names_keep_script_case_and_gender(spark):
    texts = ["Mr Smith and Mr SMITH", "Dr Παπαδόπουλος", "Госпожа Анна Иванова", "Herr Կարապետյան", "Mary Jones met Mr. J. Jones", "Frau Łukasiewicz", "Dr Ⴀბგ"]
    out = replaced(spark, texts)
    a, b = re.fullmatch(r"Mr (\w+) and Mr (\w+)", out[0]).groups()
    assert a != "Smith" and b == a.upper()
    assert re.fullmatch(r"Dr [Α-Ωα-ωά-ώ]+", out[1]) and out[1] != texts[1]
    assert re.fullmatch(r"Госпожа [А-Яа-я]+на [А-Яа-я]+", out[2]) and "Иванова" not in out[2]
    assert re.fullmatch(r"Herr [Ա-և]+", out[3]) and out[3] != texts[3]
    given, one, initial, two = re.fullmatch(r"(\w+na) (\w+) met Mr\. (\w\.) (\w+)", out[4]).groups()
    assert one == two != "Jones" and given != "Mary"
    assert re.fullmatch(r"Frau [A-Z][a-z]+", out[5])


def test_national_telephones(spark):
    texts = ["call 020 7946 0958 now", "0170 1234567", "(020) 7946 0958", "since 1999 2000 men", "0.5 and 007", "+1 (843) 555-7672 170.106.47.2"]
    out = replaced(spark, texts)
    assert out[3:5] == texts[3:5]
    for i in range(3):
        assert out[i] != texts[i] and re.sub("[1-9]", "0", out[i]) == re.sub("[1-9]", "0", texts[i])
    assert re.search(r"[0-9]+", out[0])[0][0] == "0"
    assert re.sub("[^0-9]", "", out[0].split("call")[1]) == re.sub("[^0-9]", "", out[2])
    phone, ip = re.fullmatch(r"(\+1 \(\d{3}\) \d{3}-\d{4}) ([\d.]+)", out[5]).groups()
    assert phone not in texts[5] and ip.count(".") == 3 and ip != "170.106.47.2"


def test_a_full_space_ends(spark):
    """All hundred numbers of a format are real: none is free, until the numbers grow."""
    texts = [f"+112{i:02d}3 or +112{i:02d}3" for i in range(100)]
    texts = [f"+1 {i:02d}55" for i in range(100)]
    out = replaced(spark, texts)
    assert len(set(out)) == 100 and not set(out) & set(texts)


def test_colliding_surrogates_take_another_attempt(spark, monkeypatch):
    drawn = pii._drawn
    monkeypatch.setattr(pii, "_drawn", lambda stream, i, below: drawn(stream, i, below) % 2)  # few surrogates
    texts = [f"{i}.2.3.4 and {i}.2.3.4 of Mr John Smith{chr(97 + i % 26)} and Mr Jack Smith{chr(97 + i % 26)}" for i in range(1, 60)]
    out = [re.fullmatch(r"(\S+) and (\S+) of Mr (\w+) (\w+) and Mr (\w+) (\w+)", t).groups() for t in replaced(spark, texts)]
    assert all(o[0] == o[1] and o[3] == o[5] for o in out)
    assert len({o[0] for o in out}) == 59 and len({o[3] for o in out}) == 26
    assert len({o[2] for o in out}) == len({o[4] for o in out}) == 1 and out[0][2] != out[0][4]


KINDS = {
    "email": (r"[\w.]+@[\w.]+", str.lower),
    "ip": (r"\d+\.\d+\.\d+\.\d+", str),
    "secret": (r"\b[0-9a-f]{40}\b", str),
    "card": (r"\b\d{16}\b", str),
    "phone": (r"\+1 \(\d{3}\) \d{3}-\d{4}", lambda s: re.sub(r"\D", "", s)),
}


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whole_table_beside_plain_python(spark, d):
    """Which entities are replaced, that the mapping is one function of the entity, one to one, and keeps the rest."""
    rows = pii.replace(spark.read.parquet(f"{d}/documents.parquet")).collect()
    old = {(r["doc_id"], r["n_chars"]): r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    before = {}
    for (doc, _), text in old.items():
        before.setdefault(doc, []).append(text)
    mapping = {k: {} for k in KINDS}
    for r in rows:
        (text,) = before[r["doc_id"]]
        if text is None:
            assert r["text"] is None and r["pii"] == 0
            continue
        pattern = "|".join(f"(?P<{k}>(?<![\\w.+]){p}(?!\\w))" for k, (p, _) in KINDS.items())
        found = [m for m in re.finditer(pattern, text, re.A) if m.lastgroup != "card" or valid_card(m[0])]
        assert r["pii"] == len(found), (r["doc_id"], [m[0] for m in found], r["text"][:500])
        assert r["n_chars"] == len(r["text"])
        at = then = 0
        for m in found:
            between = text[then : m.start()]
            assert r["text"].startswith(between, at)
            at += len(between)
            new = re.compile(KINDS[m.lastgroup][0], re.A).match(r["text"], at)
            fold = KINDS[m.lastgroup][1]
            assert new and mapping[m.lastgroup].setdefault(fold(m[0]), fold(new[0])) == fold(new[0])
            assert m.lastgroup != "card" or valid_card(new[0])
            at, then = new.end(), m.end()
        assert r["text"][at:] == text[then:]
    for of in mapping.values():
        assert len(set(of.values())) == len(of) and not set(of) & set(of.values())


def test_odd_rows_and_names(spark, odd):
    made = odd.withColumn("pieces", F.lit(1)).withColumn("row", F.lit("r")).withColumn("taken", F.lit(2)).withColumn("new", F.lit(3)).withColumn("__mark", F.lit(4)).withColumn("PII", F.lit(5))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("  a@b.org  "))
    out = pii.replace(made.withColumn("text", text))
    assert out.columns == [*made.columns, "pii_2"]
    rows = out.collect()
    assert len(rows) == 7 and all(r["pii_2"] == 1 and r["PII"] == 5 and r["row"] == "r" and r["new"] == 3 for r in rows)
    assert all(re.search("  \\w@\\w+\\.example\\.org  $", r["text"]) for r in rows)
    assert pii.replace(made.limit(0)).count() == 0
