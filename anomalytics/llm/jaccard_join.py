"""Exact n-gram Jaccard join as a metric-space join.

The points are the distinct shingle sets, the metric is the Jaccard distance; two sets link within ``radius`` = 1/4.

0. A shingle that no other set holds is in no intersection. The shingles of all sets are dealt to slices by their hashes
   and counted there, which tells every set how many of its shingles some other set may hold too. A set with fewer than
   3/4 of such shingles links with nothing and takes no part below. The sets that are left, each of them once, are counted
   anew among themselves, and the numbers of two sets bound their intersection.
1. First-level pivots are the shingles themselves: the set {s} is a point, at distance 1 - 1/|x| from every x that
   holds s and at distance 1 from all others. Under one order of the shingles (commonest last) a set lies in the cell
   of its first shingle, and a set within the radius of it holds one of its first |x| - ceil(3/4 |x|) + 1 shingles; a
   boundary set is replicated to the cells of all of these. So any two linked sets meet in the cell of the first shingle
   that they share, where their intersection holds no shingle before it: a set's place in the cell bounds the
   intersection, and sets that no size in the cell can link with leave it. (Random texts share no shingle and are at
   distance 1 from each other, so document pivots alone would leave them in one region.)
2. Inside a cell, documents are pivots. Each round takes up to ``pivots`` sets per cell (eight times as many the next
   round), those with the fewest shingles of their own first, as they lie amid their near copies, measures their distance from the other sets of the cell, links those within the radius, and settles the
   pivots. The sets that a pivot reaches are one component, so pairs inside a component are not looked at again; cells
   whose sets are all of one component are finished, and the others go into the next round. Few pivots are enough for
   a group of near copies; cells that stay open hold many sets apart. The links of a round are links between the
   components of the rounds before, so that only these are merged.
3. A distance is bounded from below first: by the numbers of step 0, and by the parity sketch of a set, a fixed point of a Hamming
   space to which the symmetric difference only contracts. By the triangle inequality a pair whose bound is beyond the
   radius cannot link. Only the other pairs are measured on the full sets.

The sets themselves, a multiple of the input, are never written: every step takes the sets that it needs from the texts
anew, and only the prefixes and sketches of sets that may link are kept. Tables of a step are deleted once the next
ones are written.

Order, slices and sketches decide the cost only; every pair that could link is compared in full.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anomalytics.llm.common import discard, free_worker, materialize, prepare, release
from anomalytics.llm.components import components
from anomalytics.llm.words import words_in

WIDTH = 5
NEAR = 75                      # per cent of the union
SLICES = 64                    # at least, of the shingles' hashes
SLICE_SHINGLES = 1 << 21       # of a slice, about
BLOCK_SHINGLES = 1 << 20       # of the sets that a task deals to the slices at once
COMMON = 1 << 20               # most shingles that are told to be common, each of them in COMMON_FROM sets or more
COMMON_FROM = 8
SKETCH_BITS = 1 << 16          # most bits of a set's parity sketch
NODE_BITS = 63                 # of a set's number; sets that share one are told apart by their 128-bit keys


def _folded(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width`` tokens from every place on."""
    total = np.full(max(0, len(tokens) - width + 1), width, dtype=np.uint64)
    for j in range(width):
        total = (total ^ tokens[j:j + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(32)
    return total


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Of each text, the sorted hashes of its distinct shingles; with fewer words the whole sequence is one shingle."""
    words = words_in(texts)
    counts = words.counts
    begin = np.cumsum(counts) - counts
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    ends = np.cumsum(sizes)
    inside = np.arange(len(words.hashes)) - np.repeat(begin, counts) + width <= np.repeat(counts, counts)
    flat = np.empty(int(sizes.sum()), dtype=np.uint64)
    folded = _folded(words.hashes, width)
    flat[np.repeat(counts >= width, sizes)] = folded[inside[:len(folded)]]
    for i in np.flatnonzero((counts > 0) & (counts < width)).tolist():
        flat[ends[i] - 1] = _folded(words.hashes[begin[i]:begin[i] + counts[i]], int(counts[i]))[0]
    out = []
    for start, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        own = flat[start:end]
        own.sort()
        again = own[1:] == own[:-1]
        out.append(np.concatenate([own[:1], own[1:][~again]]) if again.any() else own)
    return out


def sets_in(batches, own: dict[bytes, int]):
    """Of every batch, and of each text in its first column: (node, key, set, whether this task has had the set).
    ``key`` is a 128-bit digest of the set and ``node`` NODE_BITS bits of it, or the number that ``own`` has for the key."""
    free_worker()
    told = set()
    for batch in batches:
        out = []
        for found in shingle_sets(batch.column(0)):
            key = hashlib.blake2b(found.astype("<u8").tobytes(), digest_size=16).digest()
            out.append((own.get(key, int.from_bytes(key[:8], "little") >> (64 - NODE_BITS)), key, found, key in told))
            told.add(key)
        yield batch, out


def parity_sketch(hashes: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of 2^k hash cells, at least two cells a shingle (up to SKETCH_BITS)."""
    bits = min(SKETCH_BITS, max(64, 1 << int(2 * len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Fewest shingles in which the two sets can differ, from their sketches (the finer one is folded)."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def prefix_of(hashes: np.ndarray, codes: np.ndarray, counts: np.ndarray, slices: int) -> np.ndarray:
    """The first |x| - ceil(NEAR |x|) + 1 shingles; common ones (``counts`` by the sorted ``codes``) come last, commonest
    at the end."""
    n = len(hashes)
    size = n - -(-NEAR * n // 100) + 1
    if not len(codes):
        return hashes[:size]
    own = codes_of(hashes, slices)
    at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
    return hashes[np.argsort(np.where(codes[at] == own, counts[at], 0), kind="stable")[:size]]


def spread(hashes: np.ndarray) -> np.ndarray:
    """The hashes mixed anew: 32 bits, twice."""
    mixed = hashes * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32)) ^ (mixed << np.uint64(32))


def slices_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    return ((spread(hashes) >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)


def codes_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    """What slices know a shingle by: their number and 32 bits of the hash."""
    return (slices_of(hashes, slices) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def numbered_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, key, n) of every row."""
    def run(batches):
        for batch, found in sets_in(batches, {}):
            columns = zip(*((node, key, len(x)) for node, key, x, _ in found), strict=True) if found else [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.int64()), strict=True))],
                names=["id", "node", "key", "n"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id")).mapInArrow(
        run, f"id {id_type}, node bigint, key binary, n bigint")


def lone_shingles(rows: DataFrame, sets, slices: int) -> DataFrame:
    """What the slices tell of the blocks of sets: (block, nodes, docs, n). ``sets`` gives (node, set) of a task's batches.

    Of every block there is a row with its ``nodes`` and their sizes ``n``, and a row from each slice with the places
    ``docs`` of sets and the numbers ``n`` of their shingles in it that occur once in all sets. Rows without a block hold
    codes (``nodes``) and counts (``n``) of common shingles. A set that comes again counts as another, and shingles of
    the same code count as one: fewer shingles are told to be alone then, never more.
    """
    def deal(batches):
        free_worker()
        first = TaskContext.get().partitionId() << 32
        blocks, held, size = 0, [], 0

        def block():
            number = first + blocks
            sizes = np.array([len(x) for _, x in held], np.int64)
            flat, docs = np.concatenate([x for _, x in held]), np.repeat(np.arange(len(held), dtype=np.uint16), sizes)
            at = slices_of(flat, slices).astype(np.uint32)
            order = np.argsort(at, kind="stable")
            ends = np.cumsum(np.bincount(at, minlength=slices))
            flat, docs = flat[order].astype("<u4"), docs[order].astype("<u2")          # the lower 32 bits
            some = [(s, a, b) for s, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist())) if b > a]
            return pa.RecordBatch.from_pydict({
                "slice": pa.array([-1 - number, *(s for s, _, _ in some)], pa.int64()),
                "block": pa.array([number] * (len(some) + 1), pa.int64()),
                "rests": pa.array([np.array([node for node, _ in held], "<i8").tobytes(), *(flat[a:b].tobytes() for _, a, b in some)], pa.binary()),
                "docs": pa.array([sizes.astype("<i8").tobytes(), *(docs[a:b].tobytes() for _, a, b in some)], pa.binary())})

        for node, found in sets(batches):
            if held and (size + len(found) > BLOCK_SHINGLES or len(held) == 1 << 16):
                yield block()
                blocks, held, size = blocks + 1, [], 0
            held.append((node, found))
            size += len(found)
        if held:
            yield block()

    def count(dealt: pa.Table) -> pa.Table:
        free_worker()
        number = dealt.column("slice")[0].as_py()
        out = {"block": [], "nodes": [], "docs": [], "n": []}
        if number < 0:
            out = {"block": dealt.column("block"), "nodes": dealt.column("rests"), "docs": [b""] * dealt.num_rows, "n": dealt.column("docs")}
        else:
            rests = [np.frombuffer(x, "<u4") for x in dealt.column("rests").to_pylist()]
            found, at, counts = np.unique(np.concatenate(rests), return_inverse=True, return_counts=True)
            alone = np.split(counts[at] == 1, np.cumsum([len(x) for x in rests])[:-1])
            for block, docs, mine in zip(dealt.column("block").to_pylist(), dealt.column("docs").to_pylist(), alone, strict=True):
                n = np.bincount(np.frombuffer(docs, "<u2")[mine])
                some = np.flatnonzero(n)
                for key, value in (("block", block), ("nodes", b""), ("docs", some.astype("<u2").tobytes()), ("n", n[some].astype("<u4").tobytes())):
                    out[key].append(value)
            most = np.argsort(-counts, kind="stable")[:max(1, COMMON // slices)]
            most = most[counts[most] >= COMMON_FROM]
            codes = (np.uint64(number) << np.uint64(32)) | found[most].astype(np.uint64)
            for key, value in (("block", None), ("nodes", codes.astype("<u8").tobytes()), ("docs", b""), ("n", counts[most].astype("<u4").tobytes())):
                out[key].append(value)
        return pa.table(out, schema=pa.schema([("block", pa.int64()), ("nodes", pa.binary()), ("docs", pa.binary()), ("n", pa.binary())]))

    return (rows.mapInArrow(deal, "slice bigint, block bigint, rests binary, docs binary")
            .groupBy("slice").applyInArrow(count, "block bigint, nodes binary, docs binary, n binary"))


def sets_of_texts(own: dict[bytes, int]):
    """Reads (node, set) from texts; a task gives a set once."""
    return lambda batches: ((node, x) for _, sets in sets_in(batches, own) for node, _, x, again in sets if len(x) and not again)


def sets_of_rows(batches):
    """Reads (node, set) from rows (node, shingles)."""
    for batch in batches:
        for node, x in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
            yield node, np.frombuffer(x, "<u8")


def may_link(told: DataFrame) -> DataFrame:
    """(node, n, u) of the sets that may link with another, from ``lone_shingles``; u: shingles not known to be alone."""
    def total(block: pa.Table) -> pa.Table:
        free_worker()
        rows = list(zip(*(block.column(c).to_pylist() for c in ("nodes", "docs", "n")), strict=True))
        nodes, sizes = next((np.frombuffer(x, "<i8"), np.frombuffer(n, "<i8")) for x, _, n in rows if x)
        shared = sizes.copy()
        for _, docs, n in (r for r in rows if not r[0]):
            shared[np.frombuffer(docs, "<u2")] -= np.frombuffer(n, "<u4")
        keep = 100 * shared >= NEAR * sizes
        return pa.table({"node": nodes[keep], "n": sizes[keep], "u": shared[keep]})

    return (told.where("block is not null").groupBy("block").applyInArrow(total, "node bigint, n bigint, u bigint")
            .groupBy("node").agg(F.first("n").alias("n"), F.min("u").alias("u")))


def common_shingles(told: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of at most COMMON shingles, by code."""
    rows = told.where("block is null").select("nodes", "n").collect()           # 12 bytes a shingle
    codes = np.frombuffer(b"".join(bytes(r.nodes) for r in rows), "<u8")
    order = np.argsort(codes)
    return codes[order], np.frombuffer(b"".join(bytes(r.n) for r in rows), "<u4")[order]


def prefixes(texts: DataFrame, own: dict[bytes, int], linkable: DataFrame, codes: np.ndarray, counts: np.ndarray, slices: int) -> DataFrame:
    """(node, n, u, prefix, sketch) of the sets of ``linkable``."""
    shared = texts.sparkSession.sparkContext.broadcast((codes.tobytes(), counts.tobytes()))

    def made(found: np.ndarray) -> tuple[bytes, bytes]:
        codes, counts = shared.value
        prefix = prefix_of(found, np.frombuffer(codes, "<u8"), np.frombuffer(counts, "<u4"), slices)
        return prefix.astype("<u8").tobytes(), parity_sketch(found)

    rows = _only_wanted(texts, own, linkable.select("node"), made, ("prefix", "sketch"))
    return (rows.groupBy("node").agg(F.first(F.struct("prefix", "sketch")).alias("of")).join(linkable, "node")
            .select("node", "n", "u", "of.prefix", "of.sketch"))


def told_apart(rows: DataFrame) -> dict[bytes, int]:
    """Numbers below zero, by key, for sets that share a node number (few, if any: about n^2 / 2^64 of n sets)."""
    shared = (rows.where("n > 0").groupBy("node").agg(F.min("key").alias("k1"), F.max("key").alias("k2"))
              .where("k1 <> k2").select("node"))
    shared = materialize(shared, "jaccard-shared")
    if shared.isEmpty():
        return {}
    keys = rows.join(shared, "node", "left_semi").where("n > 0").select("key").distinct().collect()
    return {bytes(row.key): -1 - i for i, row in enumerate(sorted(keys))}


def _numbered(rows: DataFrame, own: dict[bytes, int]) -> DataFrame:
    if not own:
        return rows
    numbers = rows.sparkSession.createDataFrame([(bytearray(k), n) for k, n in own.items()], "key binary, own bigint")
    return rows.join(F.broadcast(numbers), "key", "left").withColumn("node", F.coalesce("own", "node")).drop("own")


def cells(sets: DataFrame) -> DataFrame:
    """(s, node, n, u, r): the cells of every set (node, n, u, prefix). ``r`` bounds the intersection with a set whose first
    shared shingle is s: the shingles from s on in the order, and no more than ``u``."""
    def run(batches):
        free_worker()
        for batch in batches:
            prefix = [np.frombuffer(x, "<i8") for x in batch.column("prefix").to_pylist()]
            sizes = [len(x) for x in prefix]
            out = {"s": np.concatenate(prefix) if prefix else np.empty(0, np.int64)}
            out |= {k: np.repeat(batch.column(k).to_numpy(), sizes) for k in ("node", "n", "u")}
            place = np.arange(len(out["s"])) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_pydict(out | {"r": np.minimum(out["u"], out["n"] - place)})

    return sets.select("node", "n", "u", "prefix").mapInArrow(run, "s bigint, node bigint, n bigint, u bigint, r bigint")


def near_enough(shared: Column, an: Column, bn: Column) -> Column:
    """False where sets of ``an`` and ``bn`` shingles cannot link as their intersection has ``shared`` of them at most. As
    that is no more than an or bn, it holds for sizes far apart too."""
    return shared * (100 + NEAR) >= (an + bn) * NEAR


def measured(pairs: DataFrame, texts: DataFrame, own: dict[bytes, int], sketch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b): the components ``ca`` and ``cb`` of the pairs of ``pairs`` (a, an, ca, b, bn, cb) that link, and the
    written table that this reads."""
    def bounded(batches):
        free_worker()
        for batch in batches:
            keep = []
            for i, (an, bn, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("an", "bn", "x", "y")), strict=True)):
                differ = least_difference(x, y)               # links need 100 (an + bn - d) >= NEAR (an + bn + d)
                keep.append(100 * (an + bn - differ) >= NEAR * (an + bn + differ))
            at = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(at) for c in ("a", "b", "ca", "cb")],
                                             names=["a", "b", "ca", "cb"])

    def exact(batches):
        free_worker()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= NEAR * (len(x) + len(y) - common))
            at = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("ca").filter(at), batch.column("cb").filter(at)], names=["a", "b"])

    left = materialize(
        pairs.join(sketch.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a")
        .join(sketch.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
        .select("a", "b", "ca", "cb", "an", "bn", "x", "y")
        .mapInArrow(bounded, "a bigint, b bigint, ca bigint, cb bigint"), "jaccard-pairs")
    wanted = whole_sets(texts, own, left.select(F.explode(F.array("a", "b")).alias("node")))
    links = (
        left.join(wanted.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        .join(wanted.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        .select("ca", "cb", "x", "y").mapInArrow(exact, "a bigint, b bigint"))
    return links, left


def whole_sets(texts: DataFrame, own: dict[bytes, int], nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the sets of ``nodes`` (and of some others), each once."""
    rows = _only_wanted(texts, own, nodes, lambda found: (found.astype("<u8").tobytes(),), ("shingles",))
    return rows.groupBy("node").agg(F.first("shingles").alias("shingles"))             # several tasks may have kept it


def _only_wanted(texts: DataFrame, own: dict[bytes, int], nodes: DataFrame, made, names: tuple[str, ...], bits: int = 1 << 24) -> DataFrame:
    """(node, ``names``) of the texts' sets but for those whose node is surely not in ``nodes``, which a bitmap of fixed
    size tells, so that few are shuffled. ``made`` gives the binary columns ``names`` of a set."""
    bit = F.pmod(F.col("node"), F.lit(bits))
    rows = (nodes.groupBy(F.bitmap_bucket_number(bit).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bitmap")).collect())     # bits / 8 bytes
    bitmap = np.zeros(((bits >> 15) + 1, 4096), dtype=np.uint8)
    for row in rows:
        bitmap[row.bucket] = np.frombuffer(bytes(row.bitmap), np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def run(batches):
        found = np.frombuffer(shared.value, np.uint8)
        for _, sets in sets_in(batches, own):
            sets = [(node, x) for node, _, x, again in sets if len(x) and not again]
            bucket, place = _bucket_of(np.array([node for node, _ in sets], dtype=np.int64) % bits)
            keep = np.flatnonzero((found[bucket * 4096 + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 == 1).tolist()
            columns = zip(*(made(sets[i][1]) for i in keep), strict=True) if keep else [()] * len(names)
            yield pa.RecordBatch.from_pydict({"node": pa.array([sets[i][0] for i in keep], pa.int64())}
                                             | {k: pa.array(c, pa.binary()) for k, c in zip(names, columns, strict=True)})

    return texts.mapInArrow(run, ", ".join(["node bigint", *(f"{k} binary" for k in names)]))


def _bucket_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and position in Spark's bitmap functions: bits 1 .. 32768 are bucket 1, and so on; bit 0 is bucket 0."""
    return np.where(at > 0, 1 + (at - 1) // 32768, 0), np.where(at > 0, (at - 1) % 32768, 0)


def _relabelled(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """``rows`` with the component that their ``comp`` went into."""
    found = merged.select(F.col("node").alias("comp"), "component")
    return rows.join(found, "comp", "left").withColumn("comp", F.coalesce("component", "comp")).drop("component")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pivots: int = 16) -> DataFrame:
    """(id, n_shingles, component_id) of every row: the least id that is reachable over links, its own included.

    A text's set holds its distinct shingles of five words (ASCII white space between words, A-Z in lower case); with
    fewer words the whole sequence is one shingle. Two rows link when 100 |intersection| >= 75 |union|.

    * A null text, or one without words, has the empty set and links with nothing: its component is its own id.
    * Rows with equal sets are one point and share a component; so do rows that repeat an id only if their sets link.
    * Rows with a null id are points too; a component without any id has a null component_id.
    * Very long texts are compared as whole sets. Other columns are not read. An empty table gives an empty result.
    * The texts are read once a step, so ``docs`` must give the same rows each time.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select(text_col)
    kept = materialize(numbered_sets(docs, id_col, text_col), "jaccard-keys")
    own = told_apart(kept)
    rows = materialize(_numbered(kept, own).select("id", "node", "n"), "jaccard-rows")
    classes = materialize(rows.where("n > 0").groupBy("node").agg(F.min("id").alias("first_id")), "jaccard-classes")
    discard(kept)
    slices = max(SLICES, (rows.agg(F.sum("n")).first()[0] or 0) // SLICE_SHINGLES)
    told = materialize(lone_shingles(texts, sets_of_texts(own), slices), "jaccard-told")
    release(spark)
    linkable = materialize(may_link(told), "jaccard-linkable")
    discard(told)
    slices = max(SLICES, (linkable.agg(F.sum("n")).first()[0] or 0) // SLICE_SHINGLES)
    told = materialize(lone_shingles(whole_sets(texts, own, linkable.select("node")), sets_of_rows, slices), "jaccard-told")
    discard(linkable)
    release(spark)
    linkable = materialize(may_link(told), "jaccard-linkable")
    codes, counts = common_shingles(told)
    sketches = materialize(prefixes(texts, own, linkable, codes, counts, slices), "jaccard-prefixes")
    found = materialize(cells(sketches), "jaccard-cells")
    discard(told, linkable)
    release(spark)

    regions, spent = found.withColumn("comp", F.col("node")), [found]
    merged = []                                       # of each round: the components before -> after
    while True:
        # sets outside the largest component of their cell are still to be compared with the rest of the cell, those that
        # may link with its least size if with any
        largest = (regions.groupBy("s", "comp").agg(F.count("*").alias("c"), F.min("n").alias("least")).groupBy("s")
                   .agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("n_comps"), F.min("least").alias("least"))
                   .where("n_comps > 1").select("s", "least", F.col("top.comp").alias("main")))
        fits = near_enough(F.col("r"), F.col("n"), F.col("least"))
        order = Window.partitionBy("s").orderBy(F.col("n") - F.col("u"), "node")
        open_cells = materialize(
            regions.join(largest, "s").where(fits & (F.col("comp") != F.col("main"))).withColumn("place", F.row_number().over(order))
            .where(F.col("place") <= pivots).groupBy("s")
            .agg(F.first("least").alias("least"),
                 F.collect_list(F.struct(F.col("node").alias("p"), F.col("n").alias("pn"), F.col("r").alias("pr"), F.col("comp").alias("pc"))).alias("pivots")),
            "jaccard-pivots")
        if open_cells.isEmpty():
            break
        regions = materialize(regions.join(open_cells, "s").where(fits).drop("least"), "jaccard-regions")
        discard(open_cells, *spent)
        spent = [regions]
        del largest, fits, open_cells
        release(spark)
        # of every set, the pivots that it may link with in any of its cells, each once
        near = F.filter("pivots", lambda p: (p["pc"] != F.col("comp")) & near_enough(F.least("r", p["pr"]), F.col("n"), p["pn"]))
        asked = (regions.select("node", "n", "comp", F.transform(near, lambda p: p.dropFields("pr")).alias("near"))
                 .where(F.size("near") > 0).groupBy("node", "n", "comp").agg(F.collect_set("near").alias("all"))     # at most its own cells
                 .select("node", "n", "comp", F.explode(F.array_distinct(F.flatten("all"))).alias("p")))
        pairs = (asked
                 .select(F.least("node", "p.p").alias("a"), F.greatest("node", "p.p").alias("b"),
                         F.when(F.col("node") < F.col("p.p"), F.col("n")).otherwise(F.col("p.pn")).alias("an"),
                         F.when(F.col("node") < F.col("p.p"), F.col("p.pn")).otherwise(F.col("n")).alias("bn"),
                         F.when(F.col("node") < F.col("p.p"), F.col("comp")).otherwise(F.col("p.pc")).alias("ca"),
                         F.when(F.col("node") < F.col("p.p"), F.col("p.pc")).otherwise(F.col("comp")).alias("cb")).distinct())
        pairs = materialize(pairs, "jaccard-asked")
        links, left = measured(pairs, texts, own, sketches)
        merged.append(materialize(components(links), "jaccard-labels") if not left.isEmpty() else None)
        discard(pairs, left)
        del near, asked, pairs, links, left
        release(spark)
        # settled pivots leave their cell; the others take their new component
        rest = regions.where(~F.exists("pivots", lambda p: p["p"] == F.col("node"))).select("s", "node", "n", "u", "r", "comp")
        regions = materialize(rest if merged[-1] is None else _relabelled(rest, merged[-1]), "jaccard-regions")
        discard(*spent)
        spent = [regions]
        pivots *= 8

    discard(open_cells, sketches, *spent)
    named = classes.select("node", "first_id", F.col("node").alias("comp"))
    for step in (m for m in merged if m is not None):
        named = _relabelled(named, step)
    named = materialize(named, "jaccard-named")
    least = materialize(named.groupBy("comp").agg(F.min("first_id").alias("component_id")), "jaccard-components")
    names = materialize(named.select("node", "comp").join(least, "comp").select("node", "component_id"), "jaccard-names")
    empty = F.col("n") == 0
    return rows.select("id", "n", "node").join(names, "node", "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(empty, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
