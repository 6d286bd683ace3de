"""Language-model scoring with a log-frequency Bloom filter.

Unigram and bigram counts of the training texts are quantised to powers of two: an n-gram of count c has the levels
1 .. 1 + floor(log2 c). The filter holds one entry (n-gram hash, level) per level. To read a count, levels are probed
one after the other until a probe fails; the last level that was found stands for the count 1.5 * 2^(level - 1)
(1 for the first). The probability of a token is its bigram estimate, smoothed with the unigram probability.

* The filter lies in slices, one for each part of the range of the n-gram hashes; the number of parts grows with the
  number of tokens. A slice has ``bits_per_entry`` bits for every entry that was counted in its part, so it holds all of
  them and the filter grows with the corpus. In its slice an n-gram is known by 32 bits of its hash; two of a slice share
  them far more rarely (under 0.1 %) than a probe of the filter is wrong anyway (about 5 %).
* A filter that surely has at most ``filter_bits`` is built first, collected and broadcast. For a larger one, the texts
  are kept in chunks and every chunk sends its n-grams to their parts once: a part adds up those of the training texts,
  fills its slice, reads the levels of all n-grams that it was sent off the slice, and sends these back to the chunks.
  Both ways read the same bits and give the same scores.
* The exact base score needs exact counts: the ``head_words`` commonest words are broadcast with theirs, the other
  words of a document are joined with the counts table. ``score`` takes no count from there: every word's count is the
  one that the filter stands for, whatever ``head_words`` is. Only the number of training texts is exact in it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anomalytics.llm.common import discard, free_worker, long_rows, materialize, prepare, release
from anomalytics.llm.words import Words, hash_word, words_in
from anomalytics.llm.words import mix as _mix

PROBES = 4
FLUSH_WORDS, FLUSH_TOKENS = 400_000, 2_000_000
CHUNK_CHARS = 2_000_000
START, END = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03          # hashes that stand for the two ends of a text
KEY = np.uint64(0xFFFFFFFF)                                  # the bits of a hash that tell n-grams of a slice apart


def bigram_hashes(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Hash of (previous token, token) for every token."""
    return _mix(before * np.uint64(0xA0761D6478BD642F) + tokens)


class WordHashes(dict):
    """word -> 64-bit hash, for single words."""

    def __missing__(self, word: bytes | None) -> int:
        self[word] = made = END if word is None else hash_word(word)        # None: the end of a text
        return made


@dataclass
class Laid:
    """The tokens of some texts, which are worked on together: the words of each and its end."""
    words: Words
    sizes: np.ndarray       # tokens of each text
    last: np.ndarray        # where each text ends
    inner: np.ndarray       # which tokens are words
    tokens: np.ndarray      # hashes
    bigrams: np.ndarray     # hashes of the tokens with those before them

    @property
    def first(self) -> np.ndarray:
        return self.last - self.sizes + 1


def laid_out(texts: pa.Array) -> Laid:
    words = words_in(texts)
    sizes = words.counts + 1
    last = np.cumsum(sizes) - 1
    inner = np.ones(int(sizes.sum()), dtype=bool)
    inner[last] = False
    tokens = np.full(len(inner), END, dtype=np.uint64)
    tokens[inner] = words.hashes
    before = np.roll(tokens, 1)
    before[last - sizes + 1] = START
    return Laid(words, sizes, last, inner, tokens, bigram_hashes(before, tokens))


def _grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of every value among them."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(values), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def count_words(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all texts; each task adds up its own words first."""
    def run(batches):
        free_worker()
        held, size = [], 0                                      # of each: hashes, counts, words

        def added_up():
            hashes, counts, words = zip(*held, strict=True)
            distinct, place = _grouped(np.concatenate(hashes))
            first = np.empty(len(distinct), dtype=np.int64)
            first[place] = np.arange(len(place))
            total = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)
            return distinct, total, pa.concat_arrays(words).take(pa.array(first))

        for batch in batches:
            words = words_in(batch.column(0))
            distinct, place = _grouped(words.hashes)
            first = np.empty(len(distinct), dtype=np.int64)
            first[place] = np.arange(len(place))
            held.append((distinct, np.bincount(place, minlength=len(distinct)), words.texts(first)))
            size += len(distinct)
            if size >= FLUSH_WORDS:
                held = [added_up()]
                size = len(held[0][0])
                if size >= FLUSH_WORDS // 2:
                    yield pa.RecordBatch.from_arrays([held[0][2], pa.array(held[0][1])], names=["word", "n"])
                    held, size = [], 0
        if held:
            _, total, words = added_up()
            yield pa.RecordBatch.from_arrays([words, pa.array(total)], names=["word", "n"])

    return texts.select(text_col).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _part_of(hashes: np.ndarray, part_bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - part_bits)).astype(np.int64)


def _probes(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and step of (hash, level), as shares of 2^32."""
    mixed = _mix((hashes & KEY) + np.uint64(level * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    return mixed & np.uint64(0xFFFFFFFF), (mixed >> np.uint64(32)) | np.uint64(1)


def _place(first: np.ndarray, step: np.ndarray, probe: int, size: np.ndarray | np.uint64) -> np.ndarray:
    """Bit position of a probe in a slice of ``size`` bits (under 2^32)."""
    return (((first + np.uint64(probe) * step) & np.uint64(0xFFFFFFFF)) * size >> np.uint64(32)).astype(np.int64)


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]               # 1 + floor(log2(count))


def filled(hashes: np.ndarray, counts: np.ndarray, bits_per_entry: float) -> tuple[int, np.ndarray]:
    """(size, bits) of the slice for the n-grams of a part with their counts."""
    levels = _levels(counts)
    size = 8 * int(np.ceil(int(levels.sum()) * bits_per_entry / 8))
    bits = np.zeros(size, dtype=np.uint8)
    for level in range(1, int(levels.max()) + 1):
        first, step = _probes(hashes[levels >= level], level)
        for probe in range(PROBES):
            bits[_place(first, step, probe, np.uint64(size))] = 1
    return size, np.packbits(bits, bitorder="little")


def part_bits_of(n_tokens: int) -> int:
    return max(6, int(np.ceil(np.log2(max(1, n_tokens / (1 << 20))))))


def build_filter(texts: DataFrame, text_col: str, n_tokens: int, filter_bits: int, bits_per_entry: float) -> dict:
    """The filter over the unigrams and bigrams of all texts: {bits, part_bits, starts, sizes} if it has at most
    ``filter_bits`` bits, else {slices, part_bits} with the table (part, size, bits) of its slices."""
    part_bits = part_bits_of(n_tokens)
    shift = np.uint64(64 - part_bits)

    def count(batches):
        free_worker()
        held, size = [], 0

        def flush():
            hashes, place = _grouped(np.concatenate(held))
            counts = np.bincount(place)
            cut = np.searchsorted(hashes >> shift, np.arange((1 << part_bits) + 1, dtype=np.uint64))
            parts = np.flatnonzero(cut[1:] > cut[:-1])
            rows = [slice(cut[p], cut[p + 1]) for p in parts]
            return pa.RecordBatch.from_pydict({
                "part": pa.array(parts, pa.int32()), "keys": pa.array([(hashes[s] & KEY).astype("<u4").tobytes() for s in rows], pa.binary()),
                "counts": pa.array([counts[s].astype("<u4").tobytes() for s in rows], pa.binary())})

        for batch in batches:
            laid = laid_out(batch.column(0))
            held += [_mix(laid.tokens), laid.bigrams]
            size += 2 * len(laid.tokens)
            if size >= FLUSH_TOKENS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def fill(batches):
        free_worker()
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for part, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.setdefault(part, []).append((np.frombuffer(keys, "<u4"), np.frombuffer(counts, "<u4")))
        for part, found in parts.items():
            keys, place = _grouped(np.concatenate([k for k, _ in found]))
            counts = np.bincount(place, weights=np.concatenate([c for _, c in found])).astype(np.int64)
            size, bits = filled(keys.astype(np.uint64), counts, bits_per_entry)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "size": pa.array([size], pa.int64()),
                "bits": pa.array([bits.tobytes()], pa.binary())})

    packed = texts.select(text_col).mapInArrow(count, "part int, keys binary, counts binary")
    slices = materialize(packed.repartition(1 << part_bits, "part").mapInArrow(fill, "part int, size bigint, bits binary"), "lm-filter")
    if (slices.agg(F.sum("size")).first()[0] or 0) > filter_bits:
        return {"slices": slices, "part_bits": part_bits}
    sizes = np.zeros(1 << part_bits, dtype=np.uint64)
    for row in slices.select("part", "size").collect():
        sizes[row.part] = row.size
    starts = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    bits = bytearray(int(starts[-1]) >> 3)
    for row in slices.toLocalIterator():                        # at most filter_bits / 8 bytes in all, one file at a time
        bits[starts[row.part] >> 3:starts[row.part + 1] >> 3] = row.bits
    return {"bits": bytes(bits), "part_bits": part_bits, "starts": starts[:-1], "sizes": sizes}


def _found(bits: np.ndarray, hashes: np.ndarray, base: np.ndarray | None, size: np.ndarray | np.uint64) -> np.ndarray:
    """Levels that are found in the slices of ``size`` bits from ``base`` on: probed until one is missing."""
    found, left, level = np.zeros(len(hashes), dtype=np.uint8), np.arange(len(hashes)), 1
    while left.size and level < 64:
        first, step = _probes(hashes[left], level)
        for probe in range(PROBES):
            at = _place(first, step, probe, size if base is None else size[left])
            if base is not None:
                at += base[left]
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            left, first, step = left[hit], first[hit], step[hit]
        found[left] = level
        level += 1
    return found


def probe_levels(model: dict, hashes: np.ndarray) -> np.ndarray:
    found = np.zeros(len(hashes), dtype=np.uint8)
    part = _part_of(hashes, model["part_bits"])
    size = model["sizes"][part]
    here = np.flatnonzero(size)                                 # nothing was counted in the other parts
    found[here] = _found(model["bits"], hashes[here], model["starts"][part[here]], size[here])
    return found


def counts_of(levels: np.ndarray) -> np.ndarray:
    """Counts that the levels stand for."""
    return np.where(levels > 1, 1.5 * 2.0 ** (levels.astype(np.float64) - 1), levels)


def probe_counts(model: dict, hashes: np.ndarray) -> np.ndarray:
    """Counts that the filter stands for: levels are probed until one is missing."""
    return counts_of(probe_levels(model, hashes))


def _kept_chunks(docs: DataFrame, id_type: str) -> DataFrame:
    """(chunk, ids, texts, train): the rows (id, text, train) in chunks of about CHUNK_CHARS, written once so that a
    chunk stays what it is."""
    def run(batches):
        free_worker()
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for start, stop in _chunks(batch.column(1)):
                lists = [pa.ListArray.from_arrays(pa.array([0, stop - start], pa.int32()), c.slice(start, stop - start)) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), *lists], names=["chunk", "ids", "texts", "train"])
                row += stop - start

    return materialize(docs.mapInArrow(
        run, f"chunk bigint, ids array<{id_type}>, texts array<string>, train array<boolean>"), "lm-chunks")


def _chunks(texts: pa.Array) -> list[tuple[int, int]]:
    """Ranges of texts with about CHUNK_CHARS characters."""
    sizes, cuts, size = pc.fill_null(pc.utf8_length(texts), 0).to_pylist(), [0], 0
    for i, n in enumerate(sizes):
        if size >= CHUNK_CHARS:
            cuts.append(i)
            size = 0
        size += n
    return [*zip(cuts, [*cuts[1:], len(sizes)], strict=True)] if sizes else []


def _sent(laid: Laid, train: np.ndarray, part_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a chunk sends: (hashes, counts, place, order, cuts). ``hashes`` are those of the distinct tokens, which
    ``counts`` has for the training texts, then all bigrams; ``place`` is where a token's own is. ``order`` sorts them by
    part, and within a part into distinct tokens, bigrams of training texts and other bigrams, which begin at ``cuts``."""
    trained = np.repeat(train, laid.sizes)
    distinct, place = _grouped(laid.tokens)
    hashes = np.concatenate([_mix(distinct), laid.bigrams])
    counts = np.bincount(place[trained], minlength=len(distinct))
    kind = np.concatenate([np.zeros(len(distinct), np.int64), np.where(trained, 1, 2)])
    key = 3 * _part_of(hashes, part_bits) + kind
    if 3 << part_bits <= 1 << 16:                               # short keys are sorted by radix
        key = key.astype(np.uint16)
    order = np.argsort(key, kind="stable")
    return hashes, counts, place, order, np.searchsorted(key[order], np.arange((3 << part_bits) + 1))


def _levels_in_slices(chunks: DataFrame, part_bits: int, bits_per_entry: float) -> DataFrame:
    """(chunk, found: array of (part, levels)): the levels of what a chunk sends, read off the slices of the filter that
    the training texts of all chunks fill."""
    def send(batches):
        free_worker()
        for batch in batches:
            for chunk, texts, train in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                hashes, counts, _, order, cuts = _sent(laid_out(texts.values), np.array(train.as_py(), dtype=bool), part_bits)
                keys, counts = (hashes & KEY).astype("<u4")[order], counts.astype("<u4")
                begin, pairs, other, end = cuts[:-1:3], cuts[1::3], cuts[2::3], cuts[3::3]
                parts = np.flatnonzero(end > begin)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(parts, pa.int32()), "chunk": pa.array([chunk] * len(parts), pa.int64()),
                    "learned": pa.array((other - pairs)[parts], pa.int32()),
                    "counts": pa.array([counts[order[begin[p]:pairs[p]]].tobytes() for p in parts], pa.binary()),
                    "keys": pa.array([keys[begin[p]:end[p]].tobytes() for p in parts], pa.binary())})

    def answer(batches):
        free_worker()
        parts: dict[int, list[tuple]] = {}
        for batch in batches:
            for part, chunk, learned, counts, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts, keys = np.frombuffer(counts, "<u4"), np.frombuffer(keys, "<u4")
                parts.setdefault(part, []).append((chunk, learned, counts, keys))
        while parts:
            part, sent = parts.popitem()
            size = np.array([len(keys) for *_, keys in sent])
            distinct, place = _grouped(np.concatenate([keys for *_, keys in sent]))
            counts = np.zeros(len(place))
            for begin, (_, learned, own, _) in zip((np.cumsum(size) - size).tolist(), sent, strict=True):
                counts[begin:begin + len(own)] = own
                counts[begin + len(own):begin + len(own) + learned] = 1
            counts = np.bincount(place, weights=counts).astype(np.int64)
            distinct, known, levels = distinct.astype(np.uint64), counts > 0, np.zeros(len(distinct), np.uint8)
            if known.any():
                slice_size, bits = filled(distinct[known], counts[known], bits_per_entry)
                levels = _found(bits, distinct, None, np.uint64(slice_size))
            found = np.split(levels[place], np.cumsum(size)[:-1])
            for i in range(0, len(sent), 1024):
                rows = range(i, min(i + 1024, len(sent)))
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([sent[r][0] for r in rows], pa.int64()), "part": pa.array([part] * len(rows), pa.int32()),
                    "levels": pa.array([found[r].tobytes() for r in rows], pa.binary())})

    sent = chunks.select("chunk", "texts", "train").mapInArrow(send, "part int, chunk bigint, learned int, counts binary, keys binary")
    return (sent.repartition(1 << part_bits, "part").mapInArrow(answer, "chunk bigint, part int, levels binary")
            .groupBy("chunk").agg(F.collect_list(F.struct("part", "levels")).alias("found")))


def _commonest(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of the commonest words, at most ``most``: all words over a count found from a
    histogram, but for words that share a hash."""
    step = F.floor(F.log2("n") * 16).cast("int")
    histogram = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)      # 16 rows a power of two
    least, size = None, 0
    for row in histogram:
        size += row["count"]
        if size > most:
            break
        least = row.step
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.float64)
    rows = counts.where(step >= least).collect()
    hashes = words_in(pa.array([row.word for row in rows], pa.string())).hashes
    own, place = _grouped(hashes)
    n = np.bincount(place, weights=[row.n for row in rows])
    alone = np.bincount(place) == 1
    return own[alone], n[alone]


def lm_score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text",
             head_words: int = 200_000, filter_bits: int = 1 << 28, bits_per_entry: float = 6.0,
             weight: float = 10.0) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Tokens are the words and one end. ``base_score`` is the sum of log10((c + 0.1) / (N + 0.1 (V + 1))) with exact
    counts of the rows where ``training`` holds. ``score`` is the model's log10 probability: for each token
    (b + weight * u) / (p + weight), with the filter's counts b of the bigram and p of the token before, and the
    unigram probability u by the filter's count of the token. ``weight`` is the strength of the smoothing.
    ``filter_bits`` is the size up to which the filter is broadcast (a filter that could be larger is not); it and
    ``head_words`` decide the cost only.

    * A null or empty text is one token, its end. Without training rows every count is 0, and base_score and score
      both come from the smoothing alone (V = N = 0: every token has probability 1).
    * Rows are scored one by one: repeated rows and null ids stay, a row each. Other columns are not read. An empty
      table gives an empty result. Very long texts are scored whole, one at a time.
    """
    spark = prepare(docs.sparkSession)
    train = docs.where(training)
    counts = materialize(count_words(train, text_col), "lm-words")
    n_train = train.count()
    words, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = words + n_train, vocabulary + (n_train > 0)
    whole = 2 * n * bits_per_entry <= filter_bits               # an n-gram has at most as many entries as its count
    shape = build_filter(train, text_col, n, filter_bits, bits_per_entry) if whole else {"part_bits": part_bits_of(n)}
    bits, part_bits = spark.sparkContext.broadcast(shape.pop("bits", b"")), shape["part_bits"]
    head = spark.sparkContext.broadcast(_commonest(counts, head_words))
    below = n + 0.1 * (v + 1)

    def score(laid, distinct, place, of_words, of_bigrams):
        """Columns of some texts from the counts that the filter stands for."""
        head_hashes, head_counts = head.value
        owner = np.repeat(np.arange(len(laid.sizes)), laid.sizes)
        exact = np.zeros(len(distinct))
        if len(head_hashes):
            at = np.minimum(np.searchsorted(head_hashes, distinct), len(head_hashes) - 1)
            exact = np.where(head_hashes[at] == distinct, head_counts[at], 0.0)
        exact, uni = exact[place], of_words[place]
        exact[laid.last] = uni[laid.last] = n_train
        prior = np.roll(uni, 1)
        prior[laid.first] = n_train
        both = np.minimum(of_bigrams, np.minimum(uni, prior))
        share = (both + weight * (uni + 0.1) / below) / (prior + weight) if n_train else np.ones(len(exact))
        seen = exact > 0
        total = lambda values: np.bincount(owner, weights=values, minlength=len(laid.sizes))
        # the other words of a text, each once
        rest = np.flatnonzero(~seen & laid.inner)
        rest = rest[np.lexsort((laid.tokens[rest], owner[rest]))]
        new = np.ones(len(rest), dtype=bool)
        new[1:] = (laid.tokens[rest[1:]] != laid.tokens[rest[:-1]]) | (owner[rest[1:]] != owner[rest[:-1]])
        times = np.diff(np.append(np.flatnonzero(new), len(rest)))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[rest[new]], minlength=len(laid.sizes)))]).astype(np.int32)
        tails = laid.words.texts(rest[new] - owner[rest[new]])                     # every text before has an end too
        return [pa.array(laid.sizes, pa.int64()), pa.array(total(seen).astype(np.int64)),
                pa.array(total(np.where(seen, np.log10((exact + 0.1) / below), 0.0))), pa.array(total(np.log10(np.minimum(share, 1.0)))),
                pa.ListArray.from_arrays(pa.array(offsets), tails), pa.ListArray.from_arrays(pa.array(offsets), pa.array(times, pa.int32()))]

    def scored_rows(ids, row, *found):
        return pa.RecordBatch.from_arrays([ids, pa.array(np.arange(row, row + len(ids))), *score(*found)],
                                          names=["id", "row", "n_tokens", "known", "base", "score", "words", "times"])

    def run(batches):
        free_worker()
        from pyspark import TaskContext

        model = {**shape, "bits": np.frombuffer(bits.value, np.uint8)}
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for start, stop in _chunks(batch.column(1)):
                laid = laid_out(batch.column(1).slice(start, stop - start))
                distinct, place = _grouped(laid.tokens)
                yield scored_rows(batch.column(0).slice(start, stop - start), row, laid, distinct, place,
                                  probe_counts(model, _mix(distinct)), probe_counts(model, laid.bigrams))
                row += stop - start

    def run_answered(batches):
        free_worker()
        for batch in batches:
            for chunk, ids, texts, train, found in zip(*batch.columns, strict=True):
                laid = laid_out(texts.values)
                _, learned, place, order, _ = _sent(laid, np.array(train.as_py(), dtype=bool), part_bits)
                levels = np.empty(len(order), dtype=np.uint8)
                levels[order] = np.frombuffer(b"".join(f["levels"] for f in sorted(found.as_py(), key=lambda f: f["part"])), np.uint8)
                counted, distinct = counts_of(levels), np.empty(len(learned), np.uint64)
                distinct[place] = laid.tokens
                yield scored_rows(ids.values, chunk.as_py(), laid, distinct, place, counted[:len(learned)], counted[len(learned):])

    id_type = docs.schema[id_col].dataType.simpleString()
    result = (f"id {id_type}, row bigint, n_tokens bigint, known bigint, base double, score double, "
              "words array<string>, times array<int>")
    kept = []
    if whole:
        found = docs.select(id_col, text_col).mapInArrow(run, result)
    else:
        chunks = _kept_chunks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("train")), id_type)
        release(spark)
        with long_rows(spark):
            answers = materialize(_levels_in_slices(chunks, part_bits, bits_per_entry), "lm-answers")
        release(spark)
        found, kept = chunks.join(answers, "chunk").mapInArrow(run_answered, result), [chunks, answers]
    with long_rows(spark):
        scored = materialize(found, "lm-scored")
    discard(*kept)
    c = F.coalesce("n", F.lit(0))
    rest = (
        scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("t"))
        .select("row", F.col("t.words").alias("word"), F.col("t.times").alias("times"))
        .join(counts, "word", "left").groupBy("row")
        .agg(F.sum(F.col("times") * F.log10((c + 0.1) / below)).alias("rest"),
             F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more")))
    return scored.join(rest, "row", "left").select(
        "id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score")
