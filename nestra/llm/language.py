"""Language identification by Bayesian evidence fusion.

    posterior(l) ~ text likelihood(l)^T * P(declared | l) * P(address suffix | l) * P(l | host)

* The text model counts byte trigrams of letters, hashed to ``BUCKETS``, on at most about ``SAMPLE`` labelled
  documents a language (a seeded hash of the doc_id picks them; a language with fewer is learned from all of
  them, were it one); whole texts are counted. One more class, "und",
  gives every trigram the same chance and takes what no language explains.
* P(declared | l) and P(suffix | l) are counted over all documents by the language that the text alone suggests,
  with a belief that declarations mostly hold and that a country's suffix mostly speaks its language.
* P(l | host) is smoothed towards the host's domain, that towards all documents: grouped counts again.

Everything but the sample covers all documents. Counts by host, domain and declaration are joined back with a
checked broadcast, else with a shuffle.

Cases: null and empty texts, and texts without letters, have no text evidence: declaration, suffix and host decide,
and if there is nothing of these either (none, or none that a text with letters has), the language is "und" and the
document is rejected. A null declaration or host is no evidence. Repeated rows count as often as they stand. Extra columns are kept by ``keep`` and ignored by
``identify``. Without any labelled row there is only "und".
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, WORD_TABLE, free_names, small, stored, utf8

BUCKETS = 1 << 16
#: Labelled documents a language that fit the text model, about; of a language with fewer, all.
SAMPLE = 400
#: Trigrams overlap: a third of their log-likelihood counts, and at most that of MOST of them.
TEMPER, MOST = 1 / 3, 300
UNKNOWN = "und"
#: Strength of each level of the host hierarchy and of the declared table, in documents.
HOST_WEIGHT, TABLE_WEIGHT, HELD = 20.0, 50.0, 0.9
LEAST = 0.5
# Languages that are mostly spoken under an address suffix.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "it": "it", "nl": "nl", "pt": "pt", "br": "pt", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "uk": "en", "us": "en", "au": "en"}

_LETTERS = bytes(32 if 48 <= b <= 57 else b for b in WORD_TABLE)


def trigrams(text: bytes) -> np.ndarray:
    """Bucket of each byte trigram of the lower-cased letters, with one blank between words."""
    data = b" ".join([b"", *text.translate(_LETTERS).split(), b""])
    if len(data) < 3:
        return np.empty(0, np.uint32)
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


class TextModel:
    """Log-probabilities of trigram buckets by language; the last column is the class of everything else."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, UNKNOWN]
        alpha = 0.05
        logs = np.log(counts + alpha) - np.log(counts.sum(0, keepdims=True) + alpha * BUCKETS)
        self.logs = np.hstack([logs, np.full((BUCKETS, 1), -math.log(BUCKETS))]).astype(np.float32)

    def evidence(self, text: bytes) -> np.ndarray:
        """Tempered log-likelihoods; zeros if there are no letters."""
        at = trigrams(text)
        if not len(at):
            return np.zeros(len(self.languages))
        total = np.zeros(len(self.languages))
        for start in range(0, len(at), 1 << 18):
            total += self.logs[at[start : start + (1 << 18)]].sum(0, dtype=np.float64)
        return total * (TEMPER * min(1.0, MOST / len(at)))


def fit(documents: DataFrame, declared: str = "lang", sample: int = SAMPLE) -> TextModel:
    """The text model of the languages declared. ``documents`` has doc_id, text and ``declared``."""
    label = F.lower(F.trim(F.col(declared)))
    sizes = {r["l"]: r["n"] for r in documents.groupBy(label.alias("l")).agg(F.count(F.lit(1)).alias("n")).where(f"l is not null and l not in ('', '{UNKNOWN}')").collect()}
    languages = sorted(sizes)
    if not languages:
        return TextModel([], np.zeros((BUCKETS, 0)))
    share = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, sample / sizes[k])))), label), F.lit(0.0))
    picked = (F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 20)) / (1 << 20)) < share
    number = {k: i for i, k in enumerate(languages)}
    schema = T.StructType([T.StructField("l", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                held = counts.setdefault(number[k], np.zeros(BUCKETS, np.int64))
                held += np.bincount(trigrams(text or b""), minlength=BUCKETS)
        for l, held in counts.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), l, np.int32)), pa.array(at.astype(np.int32)), pa.array(held[at])], names=schema.names)

    rows = documents.where(picked).select(label.alias("l"), "text").mapInArrow(count, schema).groupBy("l", "b").agg(F.sum("n").alias("n"))
    table = np.zeros((BUCKETS, len(languages)))
    got = rows.toArrow()  # at most BUCKETS rows a language
    np.add.at(table, (got["b"].to_numpy(), got["l"].to_numpy()), got["n"].to_numpy())
    return TextModel(languages, table)


def _host(address: Column) -> Column:
    return F.lower(F.regexp_replace(address, r"^[a-zA-Z][a-zA-Z0-9+.-]*://|[/?#:].*$", ""))


def identify(documents: DataFrame, model: TextModel | None = None, declared: str = "lang", address: str = "source", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: ``keys``, language, posterior, declared, kept (boolean)."""
    model = model or fit(documents, declared)
    names = model.languages
    shared = documents.sparkSession.sparkContext.broadcast(model)
    inner = documents.select(*keys, F.lower(F.trim(F.col(declared))).alias("__declared"), _host(F.col(address)).alias("__host"), F.col("text").alias("__text"))
    at = len(keys)
    schema = T.StructType([*(inner.schema[k] for k in keys), T.StructField("__declared", T.StringType()), T.StructField("__host", T.StringType()), T.StructField("__logs", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            logs = pa.array([model.evidence(t or b"") for t in utf8(batch.column(at + 2))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: at + 2], logs], names=schema.names)

    scored = inner.mapInArrow(run, schema)
    best = F.array_max("__logs")
    told = (F.size(F.filter("__logs", lambda x: x != 0)) > 0).alias("__told")
    scored = stored(
        scored.withColumn("__guess", F.when(told, F.array_position("__logs", best) - 1))
        .withColumn("__domain", F.regexp_extract("__host", r"([^.]+\.[^.]+)$", 1))
        .withColumn("__suffix", F.regexp_extract("__host", r"\.([^.]+)$", 1))
    )
    guessed = scored.where("__guess is not null").groupBy("__declared", "__host", "__domain", "__suffix", "__guess").count()
    guessed = stored(guessed)
    of = lambda i: F.sum(F.when(F.col("__guess") == i, F.col("count")).otherwise(0)).cast("double")
    counts = lambda *by: guessed.groupBy(*by).agg(F.array(*(of(i) for i in range(len(names)))).alias("n"))
    first = counts().first()
    every = np.array(first["n"] if first and first["n"][0] is not None else [0.0] * len(names))
    prior = (every + 1) / (every.sum() + len(names))
    # hosts lean on their domain's distribution, domains on that of all documents
    smooth = lambda n, base: F.zip_with(n, base, lambda c, p: (c + HOST_WEIGHT * p) / (F.aggregate(n, F.lit(0.0), lambda a, x: a + x) + HOST_WEIGHT))
    whole = F.array(*(F.lit(float(p)) for p in prior))
    domains = counts("__domain").where("__domain is not null").select("__domain", smooth(F.col("n"), whole).alias("p"))
    hosts = counts("__host", "__domain").where("__host is not null").join(small(stored(domains.withColumnRenamed("p", "base")), max(1, 2 * BROADCAST_ROWS // len(names))), "__domain", "left")
    hosts = stored(hosts.select("__host", smooth(F.col("n"), F.coalesce("base", whole)).alias("__prior")))
    # P(value | language) over the values that occur, with a pseudo-count for what the value says of itself
    said = _table(counts("__declared").where("__declared is not null"), "__declared", names, every, lambda v: v)
    under = _table(counts("__suffix").where("__suffix <> ''"), "__suffix", names, every, lambda v: _spoken(v))
    # a row here has a number for each language
    joined = scored.join(small(hosts, max(1, 2 * BROADCAST_ROWS // len(names))), "__host", "left").join(small(said), "__declared", "left").join(small(under), "__suffix", "left")
    fused = F.transform(
        F.arrays_zip(
            F.col("__logs").alias("t"), F.coalesce("__prior", whole).alias("h"), F.coalesce("__declared_p", F.array_repeat(F.lit(1.0), len(names))).alias("d"), F.coalesce("__suffix_p", F.array_repeat(F.lit(1.0), len(names))).alias("s")
        ),
        lambda z: z["t"] + F.log(z["h"]) + F.log(z["d"]) + F.log(z["s"]),
    )
    out = joined.withColumn("__fused", fused).withColumn("__top", F.array_max("__fused"))
    total = F.aggregate("__fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__top")))
    language = F.element_at(F.array(*map(F.lit, names)), F.array_position("__fused", F.col("__top")).cast("int"))
    nothing = F.col("__guess").isNull() & F.col("__declared_p").isNull() & F.col("__prior").isNull() & F.col("__suffix_p").isNull()
    out = out.select(*keys, F.when(nothing, UNKNOWN).otherwise(language).alias("language"), F.when(nothing, F.lit(1.0)).otherwise(1 / total).alias("posterior"), F.col("__declared").alias("declared"))
    return out.withColumn("kept", (F.col("language") != UNKNOWN) & (F.col("posterior") >= LEAST))


def _spoken(suffix: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, suffix), F.lit(""))


def _table(counts: DataFrame, by: str, names: list[str], every: np.ndarray, says) -> DataFrame:
    """(value, P(value | language) for each language)."""
    own = says(F.col(by))
    believed = F.array(*(F.when(own == name, F.lit(TABLE_WEIGHT * HELD)).otherwise(F.lit(TABLE_WEIGHT * (1 - HELD) / max(1, len(names) - 1))) for name in names))
    p = F.transform(F.arrays_zip(F.col("n").alias("n"), believed.alias("b"), F.array(*(F.lit(float(x)) for x in every)).alias("e")), lambda z: (z["n"] + z["b"]) / (z["e"] + TABLE_WEIGHT))
    return stored(counts.select(by, p.alias(f"{by}_p")))


def keep(documents: DataFrame, model: TextModel | None = None, declared: str = "lang", address: str = "source") -> DataFrame:
    """``documents`` without those rejected: of no language known, or of none with at least ``LEAST`` posterior.
    Decisions are per row; those of few rejected are looked up by doc_id and text hash."""
    mark, gone_id, gone_mark = free_names([*documents.columns, *_INNER], "mark", "gone_id", "gone_mark")
    marked = documents.withColumn(mark, F.xxhash64("text", declared, address))
    found = identify(marked, model, declared, address, ("doc_id", mark))
    gone = small(stored(found.where(~F.col("kept")).select(F.col("doc_id").alias(gone_id), F.col(mark).alias(gone_mark)).distinct()))
    return marked.join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(mark) == F.col(gone_mark)), "left_anti").select(*documents.columns)


#: Names that :func:`identify` gives its own columns.
_INNER = ("language", "posterior", "declared", "kept")
