"""Phrase collocations: multikey three-way quicksort of suffix pointers.

Every word of a piece begins a suffix; a phrase is a prefix of a suffix. A task sorts the pointers of its suffixes word
by word: at each depth a pivot word splits them into less, equal and greater, the equal part goes one word deeper, and
its size is the number of times that the phrase of that depth occurs. Small parts are finished by one stable sort.

The counted phrases of all tasks are routed by a hash of their leading words, merged by the same sort (a pointer then
weighs as much as its count), and parts that stay under the threshold are abandoned. This happens twice: first to a
depth of two words; then suffixes go on only while their leading pairs were frequent, as every pair inside a frequent
phrase is. A filter tells that: its false positives cost time and are abandoned at the second routing. As tasks count
before they route, a phrase that is a third of the corpus is one entry from each block of ``BLOCK`` words.

What follows - cutting each candidate in two, the longer phrases that contain it, the ranking - joins the frequent
phrases with themselves in DataFrame functions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anomalytics.llm.common import free_worker, materialize, prepare

DEPTH = 4                      # words of the longest phrase
BLOCK = 1 << 21                # words that a task sorts at a time, and entries routed together, on the average
ROUTES = 64                    # routes at least
GROUP = 10_000                 # candidates that are ranked together before all are, on the average
SMALL = 1 << 15                # pointers of a part that one stable sort finishes
FILTER_BITS = 1 << 28          # of the filter of frequent pairs, at most
#: fixed values: what ends a piece (with \x0A-\x0D)
ENDS = b".,;:!?\n\x0b\x0c\r"
_TO_DOTS = bytes(ord(".") if i in ENDS else i for i in range(256))
WORDS_SCHEMA = "lang string, route int, words binary, ids binary, n binary, depth int"


def piece_words(text: bytes) -> list[bytes]:
    """Lower-cased words; a dot, which no word holds, ends each piece."""
    return text.translate(_TO_DOTS).lower().replace(b".", b" . ").split()


class _Ids(dict):
    """word -> number, from 1; the end of a piece is 0."""

    def __init__(self):
        super().__init__({b".": 0})
        self.words = [b"."]

    def __missing__(self, word: bytes) -> int:
        self[word] = made = len(self.words)
        self.words.append(word)
        return made


def multikey_sort(keys: list[np.ndarray], small: int = SMALL) -> np.ndarray:
    """The order of the rows of ``keys`` (one array for each depth), sorted depth by depth by three-way partitions.

    A row whose key is 0 at some depth ends before it; 0 goes no deeper.
    """
    out = np.arange(len(keys[0]))
    open_parts = [(0, len(out), 0)]
    while open_parts:
        start, stop, depth = open_parts.pop()
        part = out[start:stop]
        if stop - start <= small:
            out[start:stop] = part[np.lexsort([k[part] for k in reversed(keys[depth:])])] if stop - start > 1 else part
            continue
        own = keys[depth][part]
        sample = np.sort(own[::max(1, len(own) // 1023)])
        pivot = sample[len(sample) // 2]
        less, equal = own < pivot, own == pivot
        n_less, n_equal = int(less.sum()), int(equal.sum())
        out[start:stop] = np.concatenate([part[less], part[equal], part[~(less | equal)]])
        open_parts.append((start, start + n_less, depth))
        open_parts.append((start + n_less + n_equal, stop, depth))
        if pivot and depth + 1 < len(keys):
            open_parts.append((start + n_less, start + n_less + n_equal, depth + 1))
    return out


def equal_parts(keys: list[np.ndarray], order: np.ndarray, weights: np.ndarray | None, depth: int,
                least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(first row, weight) of every part whose rows agree in the first ``depth`` keys, none of them 0.

    Parts under ``least`` are abandoned."""
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys[:depth]:
        own = k[order]
        new[1:] |= own[1:] != own[:-1]
    starts = np.flatnonzero(new)
    sizes = (np.diff(np.append(starts, len(order))) if weights is None
             else np.add.reduceat(weights[order], starts) if len(starts) else starts)
    rows = order[starts]
    keep = (keys[depth - 1][rows] > 0) & (sizes >= least)
    return rows[keep], sizes[keep]


def phrase_hash(words: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Hash of the phrases given by word numbers; ``words`` holds the hash of each word, 0 of number 0."""
    total = np.zeros(len(keys[0]), dtype=np.uint64)
    for k in keys:
        total = (total ^ words[k]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([0, *map(xxhash.xxh64_intdigest, words[1:])], dtype=np.uint64)


def _entries(lang: str, words: list[bytes], hashes: np.ndarray, keys: list[np.ndarray], n: np.ndarray, routes: int):
    """Record batches (WORDS_SCHEMA) of counted phrases of one length, by route."""
    depth = len(keys)
    route = (phrase_hash(hashes, keys) >> np.uint64(20)) % np.uint64(routes)
    order = np.argsort(route, kind="stable")
    cuts = np.searchsorted(route[order], np.arange(routes + 1))
    for r in range(routes):
        own = order[cuts[r]:cuts[r + 1]]
        if len(own):
            used, at = np.unique(np.concatenate([k[own] for k in keys]), return_inverse=True)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang], pa.string()), "route": pa.array([r], pa.int32()),
                "words": pa.array([b"\n".join([words[i] for i in used])], pa.binary()),
                "ids": pa.array([at.astype("<u4").tobytes()], pa.binary()),
                "n": pa.array([n[own].astype("<u8").tobytes()], pa.binary()), "depth": pa.array([depth], pa.int32())})


def _in_filter(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    seen = np.frombuffer(bits, np.uint8)
    at = hashes & np.uint64(len(bits) * 8 - 1)
    return (seen[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def counted(docs: DataFrame, depths: tuple[int, int], routes: int, pairs=None) -> DataFrame:
    """Entries of the phrases of ``depths`` words in (lang, text binary), counted block by block.

    With ``pairs``, a broadcast filter, only suffixes whose leading pairs are in it go to these depths. From depth 1 on
    the number of all words is counted as well, as the empty phrase (depth 0).
    """
    def sort_block(lang: str, ids: _Ids, texts: list[np.ndarray]):
        flow = np.concatenate([*texts, np.zeros(DEPTH, np.int32)])
        hashes = word_hashes(ids.words)
        at = np.flatnonzero(flow)
        if depths[0] == 1:
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang], pa.string()), "route": pa.array([0], pa.int32()), "words": pa.array([b""], pa.binary()),
                "ids": pa.array([b""], pa.binary()), "n": pa.array([np.array([len(at)], "<u8").tobytes()], pa.binary()),
                "depth": pa.array([0], pa.int32())})
        if pairs is not None:
            good = np.zeros(len(flow), dtype=bool)
            both = at[flow[at + 1] > 0]
            named = phrase_hash(hashes, [flow[both], flow[both + 1]]) ^ lang_hash(lang)
            good[both[_in_filter(pairs.value, named)]] = True
            at = at[good[at] & good[at + 1]]                          # both pairs of the first three words
        keys = [flow[at + i] for i in range(depths[1])]
        if pairs is not None:
            keys[3][~good[at + 2]] = 0
        order = multikey_sort(keys)
        for depth in range(depths[0], depths[1] + 1):
            rows, n = equal_parts(keys, order, None, depth)
            yield from _entries(lang, ids.words, hashes, [k[rows] for k in keys[:depth]], n, routes)

    def run(batches):
        free_worker()
        ids, held, size = _Ids(), {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = piece_words(text)
                found.append(b".")
                held.setdefault(lang, []).append(np.fromiter(map(ids.__getitem__, found), np.int32, len(found)))
                size += len(found)
                if size >= BLOCK:
                    for own in held:
                        yield from sort_block(own, ids, held[own])
                    ids, held, size = _Ids(), {}, 0
        for own in held:
            yield from sort_block(own, ids, held[own])

    return docs.mapInArrow(run, WORDS_SCHEMA)


def lang_hash(lang: str) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(lang.encode()))


def frequent(entries: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, depth, f, pair): phrases of all entries whose counts add up to ``least``; ``pair`` is the hash
    that the filter holds, of phrases of two words."""
    def merge(table: pa.Table) -> pa.Table:
        groups: dict = {}
        for row in table.to_pylist():
            groups.setdefault((row["lang"], row["depth"]), []).append(row)
        out = {"lang": [], "phrase": [], "depth": [], "f": [], "pair": []}
        for (lang, depth), rows in groups.items():
            ids, columns, weights = _Ids(), [], []
            for row in rows:
                own = np.fromiter(map(ids.__getitem__, row["words"].split(b"\n")), np.int32) if depth else None
                if depth:
                    columns.append(own[np.frombuffer(row["ids"], "<u4")].reshape(depth, -1))
                weights.append(np.frombuffer(row["n"], "<u8").astype(np.int64))
            weight = np.concatenate(weights)
            if depth == 0:
                phrases, f, pair = [""], [int(weight.sum())], [None]
            else:
                keys = list(np.concatenate(columns, axis=1))
                at, f = equal_parts(keys, multikey_sort(keys), weight, depth, least)
                kept = [k[at] for k in keys]
                phrases = [b" ".join([ids.words[i] for i in row]).decode("utf-8", "replace") for row in zip(*kept, strict=True)]
                pair = ((phrase_hash(word_hashes(ids.words), kept) ^ lang_hash(lang)).view(np.int64).tolist() if depth == 2
                        else [None] * len(at))
                f = f.tolist()
            out["lang"] += [lang] * len(f)
            out["depth"] += [depth] * len(f)
            out["phrase"], out["f"], out["pair"] = out["phrase"] + phrases, out["f"] + f, out["pair"] + pair
        kinds = {"lang": pa.string(), "phrase": pa.string(), "depth": pa.int32(), "f": pa.int64(), "pair": pa.int64()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    return entries.groupBy("route").applyInArrow(merge, "lang string, phrase string, depth int, f bigint, pair bigint")


def pair_filter(found: DataFrame, n_pairs: int) -> bytes:
    """The pairs' hashes as a bitmap of 32 bits for each, up to FILTER_BITS."""
    bits = min(FILTER_BITS, max(1 << 20, 1 << int(32 * n_pairs).bit_length()))
    place = F.col("pair").bitwiseAND(F.lit(bits - 1))
    rows = (found.where("depth = 2").select(F.shiftright(place, 15).alias("bucket"), place.bitwiseAND(F.lit(32767)).alias("at"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bitmap")).collect())     # bits / 8 bytes
    out = bytearray(bits // 8)
    for row in rows:
        out[row.bucket * 4096:(row.bucket + 1) * 4096] = bytes(row.bitmap)
    return bytes(out)


def _words(phrase: Column, start: Column, length: Column) -> Column:
    """``length`` words of a phrase from ``start`` (from 1) on."""
    return F.array_join(F.slice(F.split(phrase, " "), start, length), " ")


def _first(rows: DataFrame, group: list[str], top: int) -> DataFrame:
    ranked = Window.partitionBy(*group).orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000,
                 factor: int = 2_000_000, held_in: tuple[int, int] = (80, 100)) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to 4 words, see the module.

    ``a`` is how often the phrase occurs, ``l`` and ``r`` how often its parts do at the cut with the lowest
    floor(factor a / (l + r)), the smallest such cut; ``n`` counts all words of the language. Phrases under ``least``
    are no candidates; candidates inside a longer one that occurs at least 80 / 100 as often are dropped.

    * A null language is ``und``. Null and empty texts hold no words. Documents are cut into pieces on their own, no
      phrase crosses two. Repeated rows count again; ids are not read, nor are other columns.
    * Very long texts count whole; a block takes one text more than it needs. Equal scores go to the larger ``a``, then
      the smaller phrase in byte order. Languages without candidates, and empty tables, give no rows.
    * Counts are exact: phrases are compared as words, hashes only route them. Scores are DECIMAL before the division.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.where(F.col(text_col).isNotNull()).select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    routes = max(ROUTES, n_bytes // (6 * BLOCK))                     # some six bytes a word
    first = materialize(frequent(counted(texts, (1, 2), routes), least), "phrases")
    n_pairs = first.where("depth = 2").count()
    shared = spark.sparkContext.broadcast(pair_filter(first, n_pairs))
    second = materialize(frequent(counted(texts, (3, DEPTH), routes, shared), least), "phrases")

    words = first.where("depth = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    known = first.where("depth > 0").drop("pair").unionByName(second.drop("pair"))
    candidates = known.where("depth > 1")
    cut = candidates.select("lang", "phrase", "depth", F.col("f").alias("a"),
                            F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("k"))
    head = _words(F.col("phrase"), F.lit(1), F.col("k"))
    tail = _words(F.col("phrase"), F.col("k") + 1, F.col("depth") - F.col("k"))
    parts = known.select("lang", F.col("phrase").alias("part"), "f")
    scored = (
        cut.withColumn("head", head).withColumn("tail", tail)
        .join(parts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
        .join(parts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
        .withColumn("score", F.expr(f"(CAST(a AS DECIMAL(20,0)) * {factor}L) div (CAST(l AS DECIMAL(20,0)) + r)"))
        .groupBy("lang", "phrase", "depth", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")))
    inside = candidates.where("depth > 2").select(
        "lang", "f", "phrase", "depth", F.explode(F.sequence(F.lit(2), F.col("depth") - 1)).alias("m")).select(
        "lang", "f", "phrase", "depth", "m", F.explode(F.sequence(F.lit(1), F.col("depth") - F.col("m") + 1)).alias("s"))
    longer = (inside.select("lang", "f", _words(F.col("phrase"), F.col("s"), F.col("m")).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    share, of = held_in
    contained = F.col("longer").cast("decimal(20,0)") * of >= F.col("a").cast("decimal(20,0)") * share
    judged = scored.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(contained, F.lit(False))).select(
        "lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))
    groups = max(1, (n_pairs + second.count()) // GROUP)             # the first of each group, then the first of all
    best = _first(judged.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(groups))), ["lang", "group"], top)
    return _first(best, ["lang"], top).join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
