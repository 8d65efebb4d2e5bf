"""SimHash near-duplicates by a segment-popcount embedding and a grid range join.

A 64-bit fingerprint maps to 32 counts: the set bits of each 2-bit segment. The Manhattan distance of two such
vectors never exceeds the Hamming distance of the fingerprints, so every pair within ``k`` bits is within ``k``
in the embedding, and of any ``blocks`` groups of segments at least ``blocks - k`` agree in all their counts.
The grid's cells are those agreeing counts: a fingerprint enters one cell for each choice of ``blocks - k``
groups, pairs meet within cells, and whatever passes the Manhattan bound is verified on the bits.

Exact copies collapse to one fingerprint before anything is joined. ``blocks`` is 7, more for
over 7 million different fingerprints, so that a cell holds a few of them at any corpus size. Cells are read as one sorted stream;
of a cell the links kept are a spanning forest (enough for components), never all pairs. A cell of more than ``CELL``
fingerprints is not compared: its members enter the grid of a finer embedding, the counts of one-bit segments, in 16
groups of four of which 13 agree. Such a cell cannot hold more than 4,096 fingerprints. No pair is lost in either.

``deduplicate`` also finds copies with scattered edits, which differ in many shingles but few words: every text has
``ALIKE`` fingerprints more, of the set of its words under other hashes. Word fingerprints within 3 bits make a link
if the shingle fingerprints agree in at least 0.8 of their bits (differ in ``VERIFIED`` at most), which word order and
everything else must uphold. Texts of one word fingerprint are compared with the smallest shingle fingerprint among
them, and different word fingerprints through these, so that a group of any size makes as many links as members.

Cases: a null or empty text has no shingles and the fingerprint zero, which links like any other; fewer words
than a shingle make one shingle of all of them. Rows that share a doc_id count row by row; a null doc_id takes
part but never names a component unless all ids in it are null. Extra columns are ignored by ``near_duplicates``
and kept by ``deduplicate``. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, release, small, space_words, stored, utf8
from .components import components

SHINGLE, SEED, BITS = 3, 42, 3
#: Fingerprints in one cell that a task compares with one another.
CELL = 4096
#: Candidate pairs a fingerprint may meet in its cells, as expected of independent bits.
EXPECTED = 4.0
#: Groups of segments up to 7 million fingerprints: till there cells, and all that is sent, grow in proportion to them.
BLOCKS = 7
#: Bits by which one segment's count tells two independent fingerprints apart: -log2(1/16 + 1/4 + 1/16).
SEGMENT_BITS = 1.415
#: Fingerprints of a text's set of words, and the bits in which shingle fingerprints may differ where these are alike.
ALIKE, VERIFIED = 4, 12
_HASH = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(data: bytes) -> int:
    """The 64-bit SimHash of one UTF-8 text as a signed integer."""
    seq = space_words(data)
    if not seq:
        return 0
    shingles = [b" ".join(seq)] if len(seq) < SHINGLE else map(b" ".join, zip(*(seq[i:] for i in range(SHINGLE))))
    hashes = np.fromiter(map(_HASH, shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):  # 4 MB of bits at a time
        ones += np.unpackbits(hashes[part : part + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def word_fingerprints(data: bytes) -> list[int]:
    """``ALIKE`` 64-bit SimHashes of the set of words, each under a hash of its own."""
    seq = set(space_words(data))
    if not seq:
        return [0] * ALIKE
    many = sorted(seq)
    halves = [b"".join(map(partial(xxhash.xxh3_128_digest, seed=i), many)) for i in range(ALIKE // 2)]
    bits = [np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 16), axis=1) for h in halves]
    ones = np.concatenate([b.sum(0, dtype=np.int64) for b in bits])
    return np.packbits(2 * ones > len(many)).view(">i8").tolist()


def fingerprints(documents: DataFrame, *columns: str, name: str = "fp", alike: str | None = None) -> DataFrame:
    """``columns`` of the documents, their fingerprint (long) as ``name``, and their word fingerprints (an array) as
    ``alike`` if that is given."""
    kept = documents.select(*columns, *(() if "text" in columns else ("text",)))
    at = kept.columns.index("text")
    own = [T.StructField(name, T.LongType())] + ([T.StructField(alike, T.ArrayType(T.LongType()))] if alike else [])
    schema = T.StructType([documents.schema[c] for c in columns] + own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in utf8(batch.column(at))]
            more = [pa.array(map(fingerprint, texts), pa.int64())] + ([pa.array(map(word_fingerprints, texts), pa.list_(pa.int64()))] if alike else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *more], names=schema.names)

    return kept.mapInArrow(run, schema)


def blocks_for(n: int, k: int = BITS) -> int:
    """Groups of segments by which ``n`` fingerprints meet about ``EXPECTED`` others at most, ``BLOCKS`` at least."""
    for blocks in range(max(k + 2, BLOCKS), 17):
        if n * comb(blocks, k) * 2.0 ** (-SEGMENT_BITS * 32 * (blocks - k) / blocks) <= EXPECTED:
            return blocks
    return 16


def _counts(fp: Column) -> Column:
    """The 32 counts of two-bit segments, two bits each: 00, 01 or 10."""
    odd = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _masks(blocks: int, k: int, width: int) -> list[int]:
    """For each choice of ``blocks - k`` blocks, the bits under them; blocks are runs of ``width``-bit segments."""
    n = 64 // width
    of = [sum(((1 << width) - 1) << (width * s) for s in range(n) if s * blocks // n == b) for b in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(c)) for c in combinations(of, blocks - k)]


_LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_EVEN = np.uint64(0x5555555555555555)


def _forest(ws: np.ndarray, fps: np.ndarray, k: int, verified: int) -> Iterator[tuple[int, int]]:
    """Spanning links of one cell. Rows of the distance matrix are visited breadth first from unseen members."""
    bits, told = ws.view(np.uint64), fps.view(np.uint64)
    counts = (bits & _EVEN) + ((bits >> np.uint64(1)) & _EVEN)
    left = np.ones(len(ws), bool)
    for root in range(len(ws)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue and left.any():
            i = queue.pop()
            rest = np.flatnonzero(left)
            near = rest[_manhattan(counts[rest], counts[i]) <= k]
            near = near[np.bitwise_count(bits[near] ^ bits[i]) <= k]
            near = near[np.bitwise_count(told[near] ^ told[i]) <= verified]
            left[near] = False
            queue += near.tolist()
            for j in near.tolist():
                yield int(fps[i]), int(fps[j])


def _manhattan(many: np.ndarray, one: np.uint64) -> np.ndarray:
    """Sum over the 32 two-bit fields of |a - b|; fields hold 0, 1 or 2."""
    differ = many ^ one  # 01 for the counts 0 and 1, 11 for 1 and 2, 10 for 0 and 2
    ones = differ & _EVEN
    twos = (differ >> np.uint64(1)) & _EVEN & ~ones
    return np.bitwise_count(ones).astype(np.int64) + 2 * np.bitwise_count(twos)


def _link_cells(masks: list[int], width: int, k: int, verified: int, cell: int | None):
    """Rows (choice, w, fp) that are sorted by cell of w to links of fp. Of a cell of more than ``cell`` members each w
    comes out as a row without b instead."""
    of = np.array(masks, np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held, size, crowded = None, [], 0, False

        def close() -> tuple[list[int], list[int]]:
            if crowded or size < 2:
                return [], []
            pairs = list(_forest(*(np.concatenate(x) for x in zip(*held)), k, verified))
            return [x for x, _ in pairs], [y for _, y in pairs]

        for batch in batches:
            a: list[int] = []
            b: list[int | None] = []
            c, w, fp = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            bits = w.view(np.uint64)
            value = ((bits & _EVEN) + ((bits >> np.uint64(1)) & _EVEN) if width == 2 else bits) & of[c]
            cuts = np.flatnonzero((c[1:] != c[:-1]) | (value[1:] != value[:-1])) + 1
            starts, ends = np.append(0, cuts), np.append(cuts, len(c))
            # cells of one member are done unless they are the first or the last of the batch
            full = np.flatnonzero(ends - starts > 1)
            for i in np.unique(np.concatenate([[0], full, [len(starts) - 1]])).tolist():
                key, part = (int(c[starts[i]]), int(value[starts[i]])), slice(starts[i], ends[i])
                if key != open_key:
                    x, y = close()
                    a += x
                    b += y
                    open_key, held, size, crowded = key, [], 0, False
                size += ends[i] - starts[i]
                if not crowded:
                    held.append((w[part], fp[part]))
                if cell and size > cell:
                    a += np.concatenate([x for x, _ in held]).tolist() if not crowded else w[part].tolist()
                    held, crowded = [], True
                    b += [None] * (len(a) - len(b))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        x, y = close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return run


def _linked(rows: DataFrame, blocks: int, width: int, k: int, verified: int, cell: int | None) -> DataFrame:
    masks = _masks(blocks, k, width)
    counts = _counts(F.col("w")) if width == 2 else F.col("w")
    value = F.get(F.array(*map(F.lit, masks)), F.col("c")).bitwiseAND(counts)
    celled = rows.select(F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("c"), "w", "fp")
    # a cell's value is not sent: it follows from the choice of groups and the fingerprint
    return celled.repartition("c", value).sortWithinPartitions("c", value).mapInArrow(_link_cells(masks, width, k, verified, cell), _LINK)


def links(fps: DataFrame, k: int = BITS, blocks: int | None = None, cell: int = CELL) -> DataFrame:
    """Different fingerprints (column ``fp``) to links (a, b) that join the same fingerprints as all pairs within k."""
    return _grid(fps.select(F.col("fp").alias("w"), "fp"), k, 64, blocks, cell)


def _grid(rows: DataFrame, k: int, verified: int, blocks: int | None = None, cell: int = CELL) -> DataFrame:
    """Links of fp between rows (w, fp) of different w within k bits whose fp differ in ``verified`` bits at most."""
    found = stored(_linked(rows, blocks or blocks_for(rows.count(), k), 2, k, verified, cell))
    crowded = found.where("b is null").select(F.col("a").alias("w")).distinct()
    if not crowded.limit(1).count():
        return found
    inside = rows.join(small(crowded), "w", "left_semi")
    return found.where("b is not null").unionByName(_linked(inside, 16, 4, k, verified, None))


def alike_links(marked: DataFrame, alike: str, k: int = BITS, verified: int = VERIFIED) -> DataFrame:
    """Links (a, b) of fp between rows (fp, ``alike``) whose word fingerprints are close, by each of them in turn."""
    pairs = stored(marked.select("fp", F.posexplode(alike).alias("i", "w")).distinct())
    first = stored(pairs.groupBy("i", "w").agg(F.min("fp").alias("rep"), F.count(F.lit(1)).alias("n")))
    # only word fingerprints of several shingle fingerprints need the second look
    several = first.where("n > 1").select(F.col("i").alias("_i"), F.col("w").alias("_w"), "rep")
    out = pairs.join(small(several), (F.col("i") == F.col("_i")) & (F.col("w") == F.col("_w"))).select(F.col("fp").alias("a"), F.col("rep").alias("b"))
    out = out.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= verified))
    for i in range(ALIKE):
        out = out.unionByName(_grid(first.where(F.col("i") == i).select("w", F.col("rep").alias("fp")), k, verified))
    return out


def near_duplicates(documents: DataFrame, k: int = BITS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable)."""
    marked = stored(fingerprints(documents, "doc_id"))
    named = _named(marked, k)
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(marked: DataFrame, k: int, more: DataFrame | None = None) -> DataFrame:
    """(doc_id, fp) to (fp, root, component_id), a row per different fingerprint. ``root`` is a fingerprint of the
    component, the same for all of it; the smallest doc_id may be in several components, or null."""
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = links(classes.select("fp"), k)
    rooted = components(found if more is None else found.unionByName(more)).withColumnRenamed("node", "fp")
    # only fingerprints with links need the second look
    linked = stored(rooted.join(classes, "fp"))
    lowest = linked.groupBy("root").agg(F.min("first_id").alias("lowest"))
    better = linked.select("fp", "root").join(lowest, "root").select("fp", "root", "lowest")
    return classes.join(small(stored(better)), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("lowest", "first_id").alias("component_id"))


def deduplicate(documents: DataFrame, k: int = BITS) -> DataFrame:
    """``documents`` with one row of each component: its smallest doc_id. All columns are kept as they are.

    Fingerprints are worked out once and written beside the documents. What is dropped is looked up, not what stays:
    the table of dropped (doc_id, fingerprint) is broadcast if it is small. Rows that agree in doc_id and fingerprint
    are repeats of one document; one of them stays. Rows of one doc_id (or of none) in different components are
    different documents and all stay.
    """
    fp, alike, gone_id, gone_fp = free_names(documents.columns, "fingerprint", "alike", "gone_id", "gone_fingerprint")
    full = stored(fingerprints(documents, *documents.columns, name=fp, alike=alike))
    marked = full.select("doc_id", F.col(fp).alias("fp"))
    more = alike_links(full.select(F.col(fp).alias("fp"), F.col(alike).alias("alike")), "alike", k)
    named = stored(marked.join(_named(marked, k, more), "fp"))
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    heads = stored(named.where(first).groupBy("doc_id", "fp", "root").agg(F.count(F.lit(1)).alias("n")))
    # the smallest doc_id of a component may have several fingerprints in it: the smallest of these stays
    several = heads.groupBy("root").agg(F.min("fp").alias("stays"), F.count(F.lit(1)).alias("fps")).where("fps > 1").select("root", "stays")
    surplus = heads.join(small(stored(several)), "root").where("fp <> stays").select("doc_id", "fp")
    gone = stored(named.where(~first).select("doc_id", "fp").union(surplus).distinct())
    again = stored(heads.where("n > 1").select("doc_id", "fp"))

    def of(some: DataFrame) -> tuple[DataFrame, Column]:
        few = small(some.toDF(gone_id, gone_fp))
        return few, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(fp) == F.col(gone_fp))

    kept = full.join(*of(gone), "left_anti")
    if again.limit(1).count():
        once = kept.join(*of(again), "left_anti")
        kept = once.unionByName(kept.join(*of(again), "left_semi").dropDuplicates(["doc_id", fp]))
    return kept.select(*documents.columns)
