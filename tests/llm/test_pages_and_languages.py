"""The queries on pages and languages beside plain Python."""

import html
import math
import re
from collections import Counter, defaultdict

import pytest

from nestra.llm import html_content, language, queries

_BLOCKS = "p|h[1-6]|ul|ol|li|br|div|section|blockquote|table|tr|td|th|pre|figure|figcaption|hr"


def article(page):
    """Of the test pages: what stands in their article element, without the parts of it that are none."""
    m = re.search(r"<article[^>]*>(.*?)</article>", page or "", re.S)
    inner = re.sub(r"<!--.*?-->|<(script|style|nav|aside|form|footer)\b.*?</\1>", "\n", m[1] if m else "", flags=re.S)
    inner = re.sub(rf"</?(?:{_BLOCKS})\b[^>]*>", "\n", inner)
    return re.sub(r"[ \t\n\f\r\v]+", " ", html.unescape(re.sub(r"<[^>]*>", "", inner))).strip(" ")


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_pages(spark, d):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = queries.op6_html(spark, d).collect()
    assert len(got) == len(pages)
    wrong = [r["page_id"] for r in got if r["text"] != article(pages[r["page_id"]]["html"])]
    assert not wrong, (len(wrong), pages[wrong[0]]["html"][:3000])
    assert all(r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"] for r in got)


def test_odd_pages(spark):
    rows = [(1, "u", None, 1), (1, "u", None, 1), (2, None, "", 2), (None, "x", "no markup at all, but a few words of text", 3), (4, "y", "<p>" + "long text here " * 100_000, 4)]
    data = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r["page_id"], r["url"], r["n_chars"]) for r in html_content.extract(data).collect()), key=repr)
    assert len(got) == 5 and [x[2] for x in got if x[0] in (1, 2)] == [0, 0, 0]
    assert dict((x[0], x[2]) for x in got)[4] == 1_500_000 - 1
    assert html_content.extract(data.limit(0)).count() == 0


def plain(rows, model):
    """The fusion spelled out: rows are (text, declared, address)."""
    names, scored = model.languages, []
    for text, declared, address in rows:
        logs = model.evidence((text or "").encode())
        host = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://|[/?#:].*$", "", address).lower() if address is not None else None
        domain = re.search(r"([^.]+\.[^.]+)$", host or "")
        suffix = re.search(r"\.([^.]+)$", host or "")
        told = bool((logs != 0).any())
        scored.append((logs, int(logs.argmax()) if told else None, declared.strip(" ").lower() if declared is not None else None, host, domain[1] if domain else "", suffix[1] if suffix else ""))
    every = [0.0] * len(names)
    by = defaultdict(lambda: [0.0] * len(names))
    for _, guess, declared, host, domain, suffix in scored:
        if guess is not None:
            every[guess] += 1
            for key in (("d", declared), ("h", host), ("m", domain if host is not None else None), ("s", suffix)):
                by[key][guess] += 1
    whole = [(n + 1) / (sum(every) + len(names)) for n in every]
    smooth = lambda n, base: [(c + language.HOST_WEIGHT * p) / (sum(n) + language.HOST_WEIGHT) for c, p in zip(n, base)]

    def table(n, own):
        belief = [language.TABLE_WEIGHT * language.HELD if name == own else language.TABLE_WEIGHT * (1 - language.HELD) / max(1, len(names) - 1) for name in names]
        return [(c + b) / (e + language.TABLE_WEIGHT) for c, b, e in zip(n, belief, every)]

    out = []
    for logs, guess, declared, host, domain, suffix in scored:
        prior = smooth(by["h", host], smooth(by["m", domain], whole)) if host is not None and ("h", host) in by else None
        said = table(by["d", declared], declared) if declared is not None and ("d", declared) in by else None
        under = table(by["s", suffix], language.SUFFIXES.get(suffix, "")) if suffix and ("s", suffix) in by else None
        if guess is None and declared is None and prior is None and under is None:
            out.append((language.UNKNOWN, 1.0))
            continue
        fused = [t + math.log(h) + math.log(d) + math.log(s) for t, h, d, s in zip(logs, prior or whole, said or [1] * len(names), under or [1] * len(names))]
        top = max(fused)
        out.append((names[fused.index(top)], 1 / sum(math.exp(x - top) for x in fused)))
    return out


def test_fusion(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    hosts = ["http://a.example.de/x", "https://b.example.de:80/y", "ftp://c.test.fr", None, "plain", "http://de.only.org/q?z#f"]
    rows = [(i, t, l if i % 5 else None, hosts[i % 6] if l == "de" or i % 7 == 0 else s) for i, t, l, s in rows]
    rows += [(900, "12 34 56", None, "http://a.example.de/other"), (901, "?!", " DE ", None), (902, None, None, None), (903, "", None, "http://never.seen.xx/"), (904, "die der und in", "en", "http://a.example.de/z")]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.fit(docs)
    got = {r["doc_id"]: r for r in language.identify(data, model).collect()}
    for (i, *_), (name, posterior) in zip(rows, plain([r[1:] for r in rows], model)):
        assert got[i]["language"] == name and math.isclose(got[i]["posterior"], posterior, rel_tol=1e-6), i
        assert got[i]["kept"] == (name != language.UNKNOWN and posterior >= language.LEAST)
    assert got[900]["language"] == "de"  # no letters, no declaration: the host decides
    assert got[902]["language"] == got[903]["language"] == language.UNKNOWN


def test_hosts_decide_between_likely_languages(spark):
    """The same short text of two languages, without a declaration, under hosts of either."""
    words = {"aa": "tamo piru seko", "bb": "tamo piru vela"}
    rows = [(i, f"{words[k]} " * 6, k, f"http://{k}.site.org/{i}") for i, k in enumerate(["aa", "bb"] * 60)]
    rows += [(1000, "tamo", None, "http://aa.site.org/q"), (1001, "tamo", None, "http://bb.site.org/q")]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["language"] for r in language.identify(data).collect()}
    assert (got[1000], got[1001]) == ("aa", "bb")
    assert Counter(got[i] for i in range(120)) == {"aa": 60, "bb": 60}
