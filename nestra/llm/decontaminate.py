"""Benchmark decontamination with a generalised suffix automaton over normalised words.

The benchmark's items become one automaton over word numbers (per block of bounded size). Document words
stream through it; at every word the automaton holds the longest suffix that occurs in any item, and the
windows that end there are read from the current state. Nothing depends on how many documents share a
passage: rows are independent, there is no join and no shuffle.

Cases: a null or empty text has no words, hits or items. An item without words has no window; an item of
fewer words than a window is one window of its own length. Repeated documents and repeated items are
handled row by row (an item id counts once). A null item id is dropped from the list of items but its
windows count as hits. Extra columns are ignored. Empty tables give empty results or no hits.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_TABLE, free_names, stored, utf8, words

WINDOW = 10
#: Bytes of item text in one automaton; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 4 << 20
#: States whose windows a worker remembers.
REMEMBERED = 100_000


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences with the windows that each state completes.

    Nearly all states have one edge and all windows one length: states live in flat arrays, and only those with more
    edges, or with windows of several lengths, have a dictionary. That is about 240 bytes an item word: some 140 MB a worker for a full block.
    """

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW):
        items = [(key, seq) for key, seq in items if seq]
        self.number: dict[bytes, int] = {}
        self.word, self.to = array("q", [-1]), array("q", [0])  # a state's first edge
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("q", [-1]), array("q", [0])
        coded = [array("q", [self.number.setdefault(w, len(self.number)) for w in seq]) for _, seq in items]
        for seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.keys = [key for key, _ in items]
        # of each state that completes windows: items (by place) of those of ``window`` words, and of shorter ones by length
        self.whole: dict[int, int | frozenset[int]] = {}
        self.shorter: dict[int, dict[int, frozenset[int]]] = {}
        self.window = window
        for item, seq in enumerate(coded):
            n, state = min(window, len(seq)), 0
            for i, c in enumerate(seq):
                state = self.step(state, c)
                if i + 1 >= n:
                    at = state
                    while self.length[self.link[at]] >= n:
                        at = self.link[at]
                    if n == window:
                        held = self.whole.get(at)
                        self.whole[at] = item if held is None or held == item else (held if isinstance(held, frozenset) else frozenset((held,))) | {item}
                    else:
                        of = self.shorter.setdefault(at, {})
                        of[n] = of.get(n, frozenset()) | {item}
        self.shortest = min((min(window, len(seq)) for seq in coded), default=0)
        # the nearest state on the way of suffix links (itself included) that completes windows, worked out when met
        self._ending: dict[int, list[tuple[int, frozenset]]] = {}

    def step(self, state: int, c: int) -> int | None:
        if self.word[state] == c:
            return self.to[state]
        of = self.more.get(state)
        return of.get(c) if of else None

    def _edge(self, state: int, c: int, to: int) -> None:
        if self.word[state] in (-1, c):
            self.word[state], self.to[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _add(self, length: int, link: int) -> int:
        for held, value in ((self.length, length), (self.link, link), (self.word, -1), (self.to, 0)):
            held.append(value)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._add(self.length[p] + 1, self.link[q])
        self.word[clone], self.to[clone] = self.word[q], self.to[q]
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        self.link[q] = clone
        while p >= 0 and self.step(p, c) == q:
            self._edge(p, c, clone)
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.step(last, c)
        if q is not None:  # another item has this prefix already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._add(self.length[last] + 1, 0), last
        while p >= 0 and self.step(p, c) is None:
            self._edge(p, c, new)
            p = self.link[p]
        if p >= 0:
            q = self.step(p, c)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _ends(self, state: int) -> list[tuple[int, frozenset]]:
        """Windows that are suffixes of the state's strings, longest first, with their items."""
        if state not in self._ending:
            if len(self._ending) > REMEMBERED:
                self._ending.clear()
            found, at = [], state
            while at > 0:
                held = self.whole.get(at)
                if held is not None:
                    found.append((self.window, held if isinstance(held, frozenset) else frozenset((held,))))
                found += self.shorter.get(at, {}).items()
                at = self.link[at]
            self._ending[state] = sorted(found, key=lambda x: -x[0])
        return self._ending[state]

    def scan(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged [start, end) word spans of all window occurrences, and the keys of the items they are of."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        word, edge, more, link, length, shortest = self.word, self.to, self.more, self.link, self.length, self.shortest
        nothing: dict[int, int] = {}
        state = matched = 0
        for i, c in enumerate(map(self.number.get, seq)):
            if c is None:
                state = matched = 0
                continue
            to = edge[state] if word[state] == c else more.get(state, nothing).get(c)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = edge[state] if word[state] == c else more.get(state, nothing).get(c)
            if to is None:
                continue
            state = to
            matched += 1
            if matched >= shortest:
                longest = 0
                for n, of in self._ends(state):
                    if n <= matched:
                        longest = longest or n
                        items |= of
                if longest:
                    start = i + 1 - longest
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, {self.keys[k] for k in items}


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", SPAN),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[list[tuple[object, bytes]]]:
    """The items in blocks of about ``block_bytes``; a driver holds one table of test items, not of documents."""
    items = benchmark.select(F.col("item_id").cast("string").alias("k"), F.col("text").cast("binary").alias("v"))
    blocks: list[list[tuple[object, bytes]]] = [[]]
    held = 0
    for k, v in items.where("v is not null").toLocalIterator():
        if held and held + len(v) > block_bytes:
            blocks.append([])
            held = 0
        blocks[-1].append((k, bytes(v)))
        held += len(v)
    return blocks


class _Scanner:
    """Pickles as the items' texts; each worker builds the automaton once, on first use."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.items, self.window, self._built = items, window, None

    def __getstate__(self):
        return {"items": self.items, "window": self.window, "_built": None}

    def automaton(self) -> SuffixAutomaton:
        if self._built is None:
            self._built = SuffixAutomaton(((k, words(v)) for k, v in self.items), self.window)
        return self._built


def matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, spans (merged [start, end) word spans of windows), items (sorted ids)."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text")
    blocks = item_blocks(benchmark, block_bytes)

    def scan_block(block):
        shared = spark.sparkContext.broadcast(_Scanner(block, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = shared.value.automaton()
            for batch in batches:
                out: list[list] = [[], [], []]
                for text in utf8(batch.column(1)):
                    seq = words(text or b"")
                    spans, keys = automaton.scan(seq)
                    out[0].append(len(seq))
                    out[1].append([{"start": a, "end": b} for a, b in spans])
                    out[2].append(sorted(k for k in keys if k is not None))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(x, f.type) for x, f in zip(out, list(_ARROW)[1:]))], schema=_ARROW
                )

        return run

    if len(blocks) == 1:
        return docs.mapInArrow(scan_block(blocks[0]), _SCHEMA)
    # Several blocks: each scans all documents; equal rows have equal results, so they meet under one key.
    keyed = docs.select(F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).alias("key"), "text")
    parts = None
    for block in blocks:
        of = keyed.select("key.doc_id", "text", "key.h").mapInArrow(_keyed(scan_block(block)), T.StructType([*_SCHEMA, T.StructField("h", T.StringType())]))
        parts = of if parts is None else parts.unionByName(of)
    met = parts.groupBy("doc_id", "h").agg(
        F.first("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        (F.count(F.lit(1)) / len(blocks)).cast("int").alias("copies"),
    )
    return (
        met.withColumn("spans", _merged("spans"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies")))
        .select("doc_id", "n_words", "spans", "items")
    )


def _keyed(run):
    def of(batches):
        for batch in batches:
            for out in run(iter([batch])):
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column(2)], names=[*out.schema.names, "h"])

    return of


def _merged(spans: str):
    """Overlapping and touching spans of a sorted array joined into one."""
    empty = F.array().cast(SPAN)

    def step(acc, s):
        last = F.element_at(acc, -1)
        joined = F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))),
        )
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty, step)


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of :func:`matches`."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def scrub(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_span: int = 1, max_coverage: float = 0.5, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``documents`` without benchmark passages; all columns stay and ``n_chars``, if there, follows the text.

    Spans of at least ``min_span`` hit words are cut out, again and again until none is left, as a cut can join
    two halves of a window; the blocks of a larger benchmark are searched in the same text before each cut. A document of which more than ``max_coverage`` of the words were hit is dropped.
    Documents without a hit pass unchanged, null texts included.
    """
    blocks = item_blocks(benchmark, block_bytes)
    if len(blocks) > 1:
        return _scrub_blocks(documents, blocks, window, min_span, max_coverage)
    shared = documents.sparkSession.sparkContext.broadcast(_Scanner(blocks[0], window))
    at = documents.columns.index("text")

    def run(batches):
        automaton = shared.value.automaton()
        for batch in batches:
            texts = utf8(batch.column(at))
            yield _with_texts(batch, texts, [cut(raw, automaton, min_span, max_coverage) if raw else raw for raw in texts])

    return documents.mapInArrow(run, documents.schema)


_STATE = [T.ArrayType(T.LongType()), T.LongType(), T.LongType(), T.BooleanType()]


def _scrub_blocks(documents: DataFrame, blocks: list[list[tuple[object, bytes]]], window: int, min_span: int, max_coverage: float) -> DataFrame:
    """:func:`scrub` with the items in several blocks. A round collects the spans of all blocks in one text before
    anything is cut; rows that were cut go into another round, until no block finds a hit in them."""
    spark = documents.sparkSession
    own = free_names(documents.columns, "spans", "total", "hit", "cut")
    names = [*documents.columns, *own]
    schema = T.StructType([*documents.schema, *(T.StructField(n, t) for n, t in zip(own, _STATE))])
    at, spans_at = documents.columns.index("text"), len(documents.columns)

    def find(shared):
        def run(batches):
            automaton = shared.value.automaton()
            for batch in batches:
                held = batch.column(spans_at)
                found = [[*old, *(p for s in automaton.scan(words(raw))[0] for p in s)] if raw else old for old, raw in zip(held.to_pylist(), utf8(batch.column(at)))]
                yield batch.set_column(spans_at, names[spans_at], pa.array(found, held.type))

        return run

    def apply(batches):
        for batch in batches:
            old, new, totals, hits, moved = utf8(batch.column(at)), [], [], [], []
            for raw, flat, total, hit in zip(old, *(batch.column(spans_at + i).to_pylist() for i in range(3))):
                spans = [s for s in _union(zip(flat[::2], flat[1::2])) if s[1] - s[0] >= min_span]
                if spans:
                    total = total or len(words(raw))
                    hit += sum(b - a for a, b in spans)
                new.append(raw if not spans else None if hit > max_coverage * total else _without(raw, spans))
                totals.append(total)
                hits.append(hit)
                moved.append(bool(spans))
            state = [[[]] * len(new), totals, hits, moved]
            for i, values in enumerate(state, spans_at):
                batch = batch.set_column(i, names[i], pa.array(values, batch.column(i).type))
            yield _with_texts(batch, old, new)

    start = (F.array().cast(_STATE[0]), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(False))
    live = documents.select("*", *(c.alias(n) for c, n in zip(start, own)))
    shared = [spark.sparkContext.broadcast(_Scanner(block, window)) for block in blocks]
    done = None
    while True:
        for of in shared:
            live = live.mapInArrow(find(of), schema)
        after = stored(live.mapInArrow(apply, schema))
        rest = after.where(~F.col(own[3])).select(*documents.columns)
        done = rest if done is None else done.union(rest)
        live = after.where(F.col(own[3]))
        if not live.limit(1).count():
            return done


def _union(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined, as :meth:`SuffixAutomaton.scan` joins them."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _with_texts(batch: pa.RecordBatch, old: list[bytes | None], new: list[bytes | None]) -> pa.RecordBatch:
    """``batch`` with the new texts; rows whose text became None are left out. ``n_chars`` follows a changed text."""
    keep = [i for i, (o, t) in enumerate(zip(old, new)) if o is None or t is not None]
    changed = any(new[i] is not old[i] for i in keep)
    if len(keep) < batch.num_rows:
        batch = batch.take(pa.array(keep, pa.int64()))
    if changed:
        decoded = [None if new[i] is None else new[i].decode() for i in keep]
        at = batch.schema.get_field_index("text")
        batch = batch.set_column(at, batch.schema.field(at), pa.array(decoded, batch.schema.field(at).type))
        if (at := batch.schema.get_field_index("n_chars")) >= 0:
            sizes = [o if t is None or o is None else len(t) for o, t in zip(batch.column(at).to_pylist(), decoded)]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(sizes, batch.schema.field(at).type))
    return batch


def cut(raw: bytes, automaton: SuffixAutomaton, min_span: int, max_coverage: float) -> bytes | None:
    """``raw`` without hit spans (the same object if there is none); None if too much of it was hit."""
    total = hit = 0
    while True:
        seq = words(raw)
        total = total or len(seq)
        spans = [s for s in automaton.scan(seq)[0] if s[1] - s[0] >= min_span]
        if not spans:
            return raw
        hit += sum(b - a for a, b in spans)
        if hit > max_coverage * total:
            return None
        raw = _without(raw, spans)


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    where = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(WORD_TABLE))]
    kept, begin = [], 0
    for a, b in spans:
        kept.append(raw[begin : where[a][0]])
        begin = where[b - 1][1]
    return b"".join([*kept, raw[begin:]])


def digest_of(n_words: int, spans: list[tuple[int, int]], items: Iterable[str]) -> tuple:
    """The digest columns of one document in plain Python, for tests."""
    hit, ids = sum(b - a for a, b in spans), sorted(items)
    return n_words, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0
