"""Quality by perplexity under an interpolated modified Kneser-Ney model of word bigrams in trusted text.

A text is its white-space separated words between a start and an end. The ``VOCABULARY`` most frequent words of the
trusted text have numbers; any other word is "unknown" and is spelled out by a Kneser-Ney model of its bytes, learned
from the different words of the trusted text, so that no word is left out of a document's probability.

With g(v) the weight that context v leaves to the lower order and q(w) the lower order's probability of w,

    log p(w | v) = log g(v) + log q(w) + [log(1 + a(v, w) / (g(v) q(w))) if v w was seen in trusted text]

where a is the discounted share of the pair. The first two depend on one word each: two arrays of bounded size. The
last is looked up where the pair's count is:

1. Trusted documents are counted by task; pairs go to one of ``SHARDS`` shards by a scrambled pair number, packed
   with their counts into four bytes each. A shard merges its pairs and keeps them as one sorted array; the table of
   shards is written. What is gathered grows with the trusted text. A shard has at most 2 ** 20 pairs by design.
2. Grouped sums over the shards give, for each word, its count and kinds of successors as a context, and how many
   different words precede it; discounts come from counts of counts.
3. The pairs of every document go, packed in the same way, to the shard that has their counts and are looked up
   there; what comes back is summed by document, first in the task, then over the tasks. The most frequent pairs
   of each shard are known to all tasks and need no journey, so that pairs of very many documents burden no shard.
   Of any other pair a shard gets four bytes a document and occurrence, read as a stream.
4. A document is kept if its perplexity per byte is at most ``SLACK`` times the ``QUANTILE`` of its language's
   trusted documents. One trusted document in ``HELD_OUT`` takes no part in the counts and only sets this threshold.

Cases: null and empty texts have no words, a null perplexity and are kept (there is nothing against them). A null
language is a language. Documents of a language without trusted text have a null threshold and are kept; if none of
a language's trusted documents is held out, all of them set its threshold. Repeated rows count as often as they
stand; a document with several labels is trusted if one says so and none says that it is toxic. A null doc_id is
never trusted. Extra columns are ignored; empty tables give empty results. Documents are numbered as they are read:
a task that is repeated must read the same rows in the same order, as tasks on files do.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small, stored, utf8

#: Words with a number; three more numbers are taken by unknown words, the start and the end.
VOCABULARY = (1 << 16) - 3
UNKNOWN, START, END, FIRST_WORD = 0, 1, 2, 3
IDS = 1 << 16
SHARD_BITS = 12
SHARDS, LOW_BITS = 1 << SHARD_BITS, 32 - SHARD_BITS
#: Most frequent pairs of a shard that all tasks know.
KNOWN = 64
#: A language's limit: this quantile of its held-out trusted documents' perplexities, times the slack.
QUANTILE, SLACK, HELD_OUT = 0.98, 1.25, 8
#: Words of pairs that a task packs at a time, and documents of such a pack (a document's place has 12 bits).
PACKED_WORDS, PACKED_DOCS = 1 << 21, 1 << 12
#: Different words that a task holds before it hands them on, and packs whose sums a shard's task holds.
HELD, HELD_PACKS = 400_000, 1024
#: What a worker looks at in one go: texts of a batch, bytes of a text, pairs of a pack.
STEP_TEXTS, STEP_BYTES, STEP_PAIRS = 256, 1 << 17, 1 << 16
#: Bytes of an n-gram of the spelling model: there are at most 2 ** 24 of them.
SPELLED = 3

# an odd factor scrambles pair numbers, and its inverse restores them
_SCRAMBLE = 2654435761
_RESTORE = pow(_SCRAMBLE, -1, 1 << 32)
_MASK = np.uint64(0xFFFFFFFF)


_BLANK = bytes(32 if b < 33 else b for b in range(256))


def _words(text: bytes) -> Iterator[list[bytes]]:
    """White-space separated words, case and punctuation kept, in lists of bounded length: as objects words take many
    times the room of their text."""
    blank, start = text.translate(_BLANK), 0
    while start < len(blank):
        end = blank.find(b" ", start + STEP_BYTES)
        end = len(blank) if end < 0 else end
        yield blank[start:end].split()
        start = end


def _texts(column: pa.Array) -> Iterator[list[bytes | None]]:
    """A string column as bytes, some rows at a time."""
    for i in range(0, len(column), STEP_TEXTS):
        yield utf8(column.slice(i, STEP_TEXTS))


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Distinct doc_ids with a label of quality 1 and none that says toxic (a column that may be missing)."""
    toxic = F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))) if "toxic" in labels.columns else F.lit(False)
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), toxic.alias("bad"))
    return said.where("good and not bad").select("doc_id")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("held out"), doc_id), F.lit(HELD_OUT)) == 0


def discounts(counts_of_counts: Iterable[int]) -> np.ndarray:
    """0, D1, D2 and D3 from the numbers of n-grams that were seen once, twice, three and four times."""
    n1, n2, n3, n4 = (max(1, int(n)) for n in counts_of_counts)
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))])


def _less(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return counts - d[np.minimum(counts, 3)]


# --- spelling of unknown words


def byte_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ``SPELLED`` bytes up to each byte of the words and to their ends (three in one number), and how many a word has."""
    joined = b"\x02" * (SPELLED - 1) + (b"\x03" + b"\x02" * (SPELLED - 1)).join(words) + b"\x03"
    x = np.frombuffer(joined, np.uint8).astype(np.int64)
    grams = sum(x[i : len(x) - SPELLED + 1 + i] << 8 * (SPELLED - 1 - i) for i in range(SPELLED))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    # what would end in the start bytes of the next word predicts nothing
    begin = np.cumsum(lengths + SPELLED - 1) - lengths - SPELLED + 1
    return grams[np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())], lengths


class Spelling:
    """Interpolated modified Kneser-Ney model of the bytes of words. ``grams`` are sorted, with their counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.orders = []
        for k in range(SPELLED, 0, -1):
            if k < SPELLED:  # how many different bytes come before
                grams, counts = np.unique(grams & ((1 << 8 * k) - 1), return_counts=True)
            d = discounts(np.count_nonzero(counts == n) for n in (1, 2, 3, 4))
            contexts, of = np.unique(grams >> 8, return_inverse=True)
            total = np.bincount(of, counts, len(contexts))
            left = np.bincount(of, d[np.minimum(counts, 3)], len(contexts)) / total if len(contexts) else total
            self.orders.append((grams, _less(counts, d) / total[of], contexts, left))
        self.orders.reverse()

    def logs(self, words: list[bytes]) -> np.ndarray:
        """Log-probability of each word and its end."""
        if not words:
            return np.empty(0)
        grams, lengths = byte_grams(words)
        keys, back = np.unique(grams, return_inverse=True)
        p = np.full(len(keys), 1 / 256)
        for k, (have, alpha, contexts, left) in enumerate(self.orders, 1):
            of = keys & ((1 << 8 * k) - 1)
            p = _find(have, alpha, of, 0.0) + _find(contexts, left, of >> 8, 1.0) * p
        return np.bincount(np.repeat(np.arange(len(words)), lengths), np.log(p)[back], len(words))


def _find(have: np.ndarray, values: np.ndarray, keys: np.ndarray, missing: float) -> np.ndarray:
    if not len(have):
        return np.full(len(keys), missing)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return np.where(have[at] == keys, values[at], missing)


# --- words and pairs as numbers


def _scrambled(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = v.astype(np.uint64)
    out <<= np.uint64(16)
    out |= w.astype(np.uint64)
    out *= np.uint64(_SCRAMBLE)
    out &= _MASK
    return out


def _restored(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    plain = (pairs * np.uint64(_RESTORE)) & _MASK
    return (plain >> np.uint64(16)).astype(np.int64), (plain & np.uint64(0xFFFF)).astype(np.int64)


def _packs(pairs: np.ndarray, payload: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Shard and packed rows: 20 bits of the pair and 12 of payload, sorted."""
    rows = pairs << np.uint64(12)
    rows |= payload.astype(np.uint64)
    return _by_shard(rows)


def _by_shard(rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """:func:`_packs` of pairs and payload in one number; ``rows`` are sorted in place."""
    rows.sort()
    cut = np.searchsorted(rows, np.arange(SHARDS + 1, dtype=np.uint64) << np.uint64(LOW_BITS + 12))
    for shard in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        yield shard, rows[cut[shard] : cut[shard + 1]].astype(np.uint32).tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The pairs' low bits and the payload."""
    rows = np.frombuffer(data, np.uint32)
    return rows >> np.uint32(12), rows & np.uint32(0xFFF)


@dataclass
class _Pack:
    """Documents: where the pairs of each begin, first and second word numbers of all pairs, symbols by document, and
    the words without a number, one after another, with their number by document."""

    starts: np.ndarray
    first: np.ndarray
    second: np.ndarray
    symbols: np.ndarray
    unknown: bytes
    unknowns: np.ndarray


def _numbered(batches: Iterable[list[bytes | None]], number: dict[bytes, int], words: int = PACKED_WORDS, docs: int = PACKED_DOCS) -> Iterator[_Pack]:
    """Packs of documents. Of each word only its number is kept, or its bytes where it has none. An empty document has
    one pair, of start and end."""
    get = number.get
    empty = lambda: (array("H"), array("q"), array("q"), bytearray(), array("q"))
    second, starts, symbols, unknown, unknowns = empty()

    def pack() -> _Pack:
        w, begin = np.frombuffer(second, np.uint16), np.frombuffer(starts, np.int64)
        first = np.empty_like(w)
        first[1:] = w[:-1]
        first[begin] = START
        return _Pack(begin, first, w, np.frombuffer(symbols, np.int64), bytes(unknown), np.frombuffer(unknowns, np.int64))

    for texts in batches:
        for text in texts:
            starts.append(len(second))
            size = others = 0
            for seq in _words(text or b""):
                ids = np.fromiter((get(w, UNKNOWN) for w in seq), np.uint16, len(seq))
                second.frombytes(ids.tobytes())
                size += sum(map(len, seq)) + len(seq)
                at = np.flatnonzero(ids == UNKNOWN).tolist()
                others += len(at)
                if at:
                    unknown += b" ".join([seq[i] for i in at]) + b" "
            second.append(END)
            symbols.append(size)
            unknowns.append(others)
            if len(second) >= words or len(starts) == docs:
                yield pack()
                second, starts, symbols, unknown, unknowns = empty()
    if starts:
        yield pack()


# --- counting


def word_counts(trusted: DataFrame) -> DataFrame:
    """(word, n) over the column text. A task counts before anything is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in chain.from_iterable(_texts(batch.column(0))):
                for seq in _words(text or b""):
                    seen.update(seq)
                    if len(seen) > HELD:
                        yield rows(seen)
                        seen.clear()
        if seen:
            yield rows(seen)

    def rows(seen: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return trusted.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def spelling(words: DataFrame) -> Spelling:
    """Of the different words; at most 2 ** 24 counts come to the driver, one for each n-gram of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, n = np.unique(byte_grams(batch.column(0).to_pylist())[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], names=["gram", "n"])

    got = words.select("word").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow().sort_by("gram")
    return Spelling(got["gram"].to_numpy(), got["n"].to_numpy())


def pair_counts(trusted: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(shard, pack): the pairs of the trusted texts with their counts, one row a shard. A count of more than 12 bits
    takes several entries."""
    shared = trusted.sparkSession.sparkContext.broadcast(number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _numbered(chain.from_iterable(_texts(b.column(0)) for b in batches), shared.value, PACKED_WORDS, 1 << 30):
            # a text without words has no pair
            said = (p.first != START) | (p.second != END)
            yield rows(_packs(*_split(*np.unique(_scrambled(p.first[said], p.second[said]), return_counts=True))))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, size = None, [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            low, n = (np.concatenate(c) for c in zip(*held))
            keys, of = np.unique(low, return_inverse=True)
            return keys, np.bincount(of, n, len(keys)).astype(np.int64)

        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if shard != here and held:
                    yield rows(_packs(*_split(_whole(here, (got := merged())[0]), got[1])))
                    held, size = [], 0
                here = shard
                held.append(_unpacked(data.as_py()))
                size += len(held[-1][0])
                if size > 1 << (LOW_BITS + 1):
                    held = [merged()]
                    size = len(held[0][0])
        if held:
            yield rows(_packs(*_split(_whole(here, (got := merged())[0]), got[1])))

    def rows(packs: Iterable[tuple[int, bytes]]) -> pa.RecordBatch:
        packs = list(packs)
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in packs], pa.int32()), pa.array([d for _, d in packs], pa.binary())], names=["shard", "pack"])

    schema = "shard int, pack binary"
    return trusted.select("text").mapInArrow(count, schema).repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, schema)


def _whole(shard: int, low: np.ndarray) -> np.ndarray:
    return np.uint64(shard << LOW_BITS) | low.astype(np.uint64)


def _split(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of 12 bits at the most, larger ones as several."""
    if not len(n) or n.max() <= 4095:
        return pairs, n
    times = (n + 4094) // 4095
    last = np.cumsum(times) - 1
    out = np.full(int(times.sum()), 4095, np.int64)
    out[last] = n - 4095 * (times - 1)
    return np.repeat(pairs, times), out


def _counted(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A shard's pairs (low bits, sorted) and their counts."""
    low, n = _unpacked(data)
    keys, start = np.unique(low, return_index=True)
    return keys, np.add.reduceat(n.astype(np.int64), start) if len(low) else n.astype(np.int64)


@dataclass
class Model:
    """What all tasks know: arrays by word number, the frequent pairs, and the spelling of other words."""

    number: dict[bytes, int]
    total: np.ndarray
    log_left: np.ndarray
    log_lower: np.ndarray
    discount: np.ndarray
    spelling: Spelling
    known: np.ndarray
    known_gain: np.ndarray

    def gain(self, pairs: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a seen pair adds to the logarithm."""
        v, w = _restored(pairs)
        return np.log1p(_less(n, self.discount) / self.total[v] * np.exp(-self.log_left[v] - self.log_lower[w]))


def fit(trusted: DataFrame, vocabulary: int = VOCABULARY) -> tuple[Model, DataFrame]:
    """The model of the column text, and the table of its pairs (shard, pack)."""
    words = stored(word_counts(trusted))
    top = words.orderBy(F.desc("n"), "word").limit(min(vocabulary, VOCABULARY)).select("word").toArrow()["word"].to_pylist()
    number = {w: i for i, w in enumerate(top, FIRST_WORD)}
    pairs = stored(pair_counts(trusted, number))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By word number: as a context its count and its successors seen once, twice and more often; its predecessors.
        Row -1: pairs seen once to four times."""
        by = np.zeros((IDS, 5), np.int64)
        kinds = np.zeros(4, np.int64)
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                low, n = _counted(data.as_py())
                v, w = _restored(_whole(shard, low))
                by[:, 0] += np.bincount(v, n, IDS).astype(np.int64)
                for i in (1, 2, 3):
                    by[:, i] += np.bincount(v[np.minimum(n, 3) == i], minlength=IDS)
                by[:, 4] += np.bincount(w, minlength=IDS)
                kinds += np.array([np.count_nonzero(n == i) for i in (1, 2, 3, 4)])
        at = np.flatnonzero(by.any(1))
        columns = [np.append(at, -1), *(np.append(by[at, i], kinds[i] if i < 4 else 0) for i in range(5))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "a", "b", "c", "d", "e"])

    got = pairs.mapInArrow(sums, "id bigint, a bigint, b bigint, c bigint, d bigint, e bigint").groupBy("id").agg(*(F.sum(c).alias(c) for c in "abcde")).toArrow()
    by, kinds = np.zeros((IDS, 5), np.int64), np.zeros(4, np.int64)
    rows = np.stack([got[c].to_numpy() for c in "abcde"], axis=1)
    inner = (ids := got["id"].to_numpy()) >= 0
    by[ids[inner]] = rows[inner]
    if (~inner).any():
        kinds = rows[~inner][0, :4]
    model = _model(number, by, kinds, spelling(words))
    shared = trusted.sparkSession.sparkContext.broadcast(model)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                low, n = _counted(data.as_py())
                most = np.sort(np.argsort(-n, kind="stable")[:KNOWN])
                whole = _whole(shard, low[most])
                yield pa.RecordBatch.from_arrays([pa.array(whole.astype(np.int64)), pa.array(shared.value.gain(whole, n[most]))], names=["pair", "gain"])

    known = pairs.mapInArrow(frequent, "pair bigint, gain double").toArrow().sort_by("pair")  # at most KNOWN a shard
    model.known, model.known_gain = known["pair"].to_numpy().astype(np.uint64), known["gain"].to_numpy()
    return model, pairs


def _model(number: dict[bytes, int], by: np.ndarray, kinds: np.ndarray, spelled: Spelling) -> Model:
    d = discounts(kinds)
    total, before = by[:, 0], by[:, 4]
    left = np.where(total > 0, by[:, 1:4] @ d[1:] / np.maximum(total, 1), 1.0)
    # the lower order: words by how many different words precede them, interpolated with an even share
    below = discounts(np.count_nonzero(before == n) for n in (1, 2, 3, 4))
    all_pairs, choices = max(1, before.sum()), len(number) + 2
    rest = below[np.minimum(before, 3)].sum() / all_pairs if before.any() else 1.0
    lower = _less(before, below) / all_pairs + rest / choices
    return Model(number, total, np.log(left), np.log(lower), d, spelled, np.empty(0, np.uint64), np.empty(0))


# --- scoring

_ROWS = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("first", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("lang", T.StringType()),
        T.StructField("symbols", T.LongType()),
        T.StructField("logs", T.DoubleType()),
        T.StructField("pack", T.BinaryType()),
    ]
)
_ARROW = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.binary()]
_COUNTS, _PAIRS, _SUMS, _DOCUMENT = 0, 1, 2, 3


def _batch(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], t) if f.name in columns else pa.nulls(n, t) for f, t in zip(_ROWS, _ARROW)], names=_ROWS.names)


def _sent(documents: DataFrame, model: Model) -> DataFrame:
    """Rows of kind _DOCUMENT (what needs no shard) and of kind _PAIRS (the pairs that a pack of documents has for one
    shard). ``first`` is the first row of the pack, whose rows stand one after another."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        spelled: dict[bytes, float] = {}
        waiting: list[pa.RecordBatch] = []

        def texts() -> Iterator[list[bytes | None]]:
            for batch in batches:
                # a copy, as columns of a batch share one buffer with its texts
                waiting.append(batch.select([0, 1, 2]).take(pa.array(np.arange(batch.num_rows))))
                yield from _texts(batch.column(3))

        def spellings(words: list[bytes]) -> list[float]:
            if len(spelled) > HELD:
                spelled.clear()
            new = list({w for w in words if w not in spelled})
            spelled.update(zip(new, model.spelling.logs(new).tolist()))
            return [spelled[w] for w in words]

        def rows(p: _Pack) -> Iterator[pa.RecordBatch]:
            n = len(p.starts)
            ids = pa.Table.from_batches(waiting)
            mine, rest = ids.slice(0, n), ids.slice(n)
            waiting[:] = rest.to_batches()
            row = mine.column(0).to_numpy()
            # documents of a task have consecutive row numbers
            place = np.repeat(np.arange(n, dtype=np.uint16), np.diff(np.append(p.starts, len(p.second))))
            total, sent, size = np.zeros(n), np.empty(len(place), np.uint64), 0
            for i in range(0, len(place), STEP_PAIRS):
                first, second, of = (x[i : i + STEP_PAIRS] for x in (p.first, p.second, place))
                logs = model.log_left[first] + model.log_lower[second]
                pairs = _scrambled(first, second)
                at = np.minimum(np.searchsorted(model.known, pairs), max(0, len(model.known) - 1))
                known = model.known[at] == pairs if len(model.known) else np.zeros(len(pairs), bool)
                logs[known] += model.known_gain[at[known]]
                np.add.at(total, of, logs)
                more = pairs[~known] << np.uint64(12) | of[~known].astype(np.uint64)
                sent[size : size + len(more)] = more
                size += len(more)
            spelt, of, i = np.zeros(n), np.repeat(np.arange(n, dtype=np.uint16), p.unknowns), 0
            for seq in _words(p.unknown):
                np.add.at(spelt, of[i : i + len(seq)], spellings(seq))
                i += len(seq)
            yield _batch(
                n, shard=(-1 - row % SHARDS).astype(np.int32), kind=np.full(n, _DOCUMENT, np.int32), first=np.full(n, row[0]), row=row, doc_id=mine.column(1).combine_chunks(), lang=mine.column(2).combine_chunks(), symbols=p.symbols, logs=total + spelt
            )
            if size:
                packs = list(_by_shard(sent[:size]))
                yield _batch(len(packs), shard=[s for s, _ in packs], kind=np.full(len(packs), _PAIRS, np.int32), first=np.full(len(packs), row[0]), pack=[d for _, d in packs])

        for p in _numbered(texts(), model.number):
            yield from rows(p)

    return documents.select("row", "doc_id", "lang", "text").mapInArrow(run, _ROWS)


def _looked_up(rows: DataFrame, model: Model) -> DataFrame:
    """Documents as they came, and rows of kind _SUMS: what a task's shards add to the documents of a pack. There are
    at most as many of these as rows of pairs."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        here, keys, gains = None, np.empty(0, np.uint32), np.empty(0)
        held: dict[int, np.ndarray] = {}

        def sums() -> pa.RecordBatch:
            firsts = list(held)
            packs = [_sparse(held.pop(first)) for first in firsts]
            return _batch(len(packs), kind=np.full(len(packs), _SUMS, np.int32), first=firsts, pack=packs)

        for batch in batches:
            kind = batch.column(1).to_numpy()
            if (kind == _DOCUMENT).any():
                yield batch.filter(pa.array(kind == _DOCUMENT))
            for i in np.flatnonzero(kind != _DOCUMENT).tolist():
                shard, data = batch.column(0)[i].as_py(), batch.column(8)[i].as_py()
                if shard != here:
                    here, keys, gains = shard, np.empty(0, np.uint32), np.empty(0)
                if kind[i] == _COUNTS:
                    keys, n = _counted(data)
                    gains = model.gain(_whole(shard, keys), n)
                elif len(keys):
                    low, place = _unpacked(data)
                    at = np.minimum(np.searchsorted(keys, low), len(keys) - 1)
                    seen = keys[at] == low
                    np.add.at(held.setdefault(batch.column(2)[i].as_py(), np.zeros(PACKED_DOCS)), place[seen], gains[at[seen]])
                    if len(held) > HELD_PACKS:
                        yield sums()
        if held:
            yield sums()

    return rows.repartition("shard").sortWithinPartitions("shard", "kind", "first").mapInArrow(run, _ROWS)


def _sparse(of: np.ndarray) -> bytes:
    places = np.flatnonzero(of)
    return places.astype(np.uint16).tobytes() + of[places].tobytes()


def _added_up(found: DataFrame) -> DataFrame:
    """(doc_id, lang, symbols, logs): the sums of a pack come before its documents."""
    schema = T.StructType(_ROWS[4:8])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, total = None, np.zeros(PACKED_DOCS)
        for batch in batches:
            kind, first = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            documents = np.flatnonzero(kind == _DOCUMENT)
            logs = np.zeros(batch.num_rows)
            logs[documents] = batch.column(7).to_numpy(zero_copy_only=False)[documents]
            row = batch.column(3).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            for start, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(first)]):
                if first[start] != here:
                    here, total = first[start], np.zeros(PACKED_DOCS)
                sums = start + int(np.count_nonzero(kind[start:end] == _SUMS))
                for i in range(start, sums):
                    data = batch.column(8)[i].as_py()
                    n = len(data) // 10
                    total[np.frombuffer(data, np.uint16, n)] += np.frombuffer(data, np.float64, n, 2 * n)
                logs[sums:end] += total[(row[sums:end] - here).astype(np.int64)]
            mine = pa.array(documents)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(mine) for i in (4, 5, 6)), pa.array(logs[documents])], names=schema.names)

    return found.repartition("first").sortWithinPartitions("first", "kind").mapInArrow(run, schema)


def score(documents: DataFrame, labels: DataFrame, vocabulary: int = VOCABULARY) -> DataFrame:
    """Per document: doc_id, lang ('' if null), symbols (bytes and ends of words), perplexity (by symbol), trusted,
    held_out (trusted and not counted)."""
    trusted_ids = stored(trusted_documents(labels))
    known = small(trusted_ids)
    trusted = documents.select("doc_id", "text").join(known, "doc_id", "left_semi").where(~held_out(F.col("doc_id")))
    model, pairs = fit(trusted, vocabulary)
    docs = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text").withColumn("row", F.monotonically_increasing_id())
    counts = pairs.select("shard", F.lit(_COUNTS).alias("kind"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in _ROWS[2:8]), "pack")
    out = _added_up(_looked_up(_sent(docs, model).unionByName(counts), model))
    out = out.select("doc_id", "lang", "symbols", F.when(F.col("symbols") > 0, F.round(F.exp(-F.col("logs") / F.col("symbols")), 9)).alias("perplexity"))
    ids = small(trusted_ids.withColumnRenamed("doc_id", "__trusted"))
    out = out.join(ids, F.col("doc_id") == F.col("__trusted"), "left")
    trusted_one = F.col("__trusted").isNotNull()
    return out.select("doc_id", "lang", "symbols", "perplexity", trusted_one.alias("trusted"), (trusted_one & F.coalesce(held_out(F.col("doc_id")), F.lit(False))).alias("held_out"))


def classify(documents: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, vocabulary: int = VOCABULARY) -> DataFrame:
    """Per document: doc_id, lang, symbols, perplexity, threshold (its language's), kept."""
    scored = stored(score(documents, labels, vocabulary))
    at = lambda where: F.percentile_approx(F.when(where, F.col("perplexity")), quantile, 10000)
    limits = scored.where("trusted and perplexity is not null").groupBy("lang").agg((slack * F.coalesce(at(F.col("held_out")), at(F.lit(True)))).alias("threshold"))
    out = scored.join(small(stored(limits)), "lang", "left")
    kept = F.col("perplexity").isNull() | F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold"))
    return out.select("doc_id", "lang", "symbols", "perplexity", "threshold", kept.alias("kept"))
