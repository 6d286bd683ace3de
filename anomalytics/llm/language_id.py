"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over a bounded sample of its labelled text. A text is then parsed
against each automaton: the longest piece that occurs in the language's sample is one phrase, the next phrase begins
behind it. Few phrases mean that the text is made of long pieces of that language. The number of phrases, times the
logarithm of the sample's length and divided by the text's length, is the cross-parsing estimate of the entropy in
bits per symbol; the language with the least estimate wins.

The alphabet is every letter of all samples. The ``max_symbols`` commonest are one symbol each; a rarer one is written
with two digits (three, if there are more than 64 * 64 of them) of 64 symbols kept for that, so no two letters share a
code and an automaton's rows stay short whatever the scripts are. Symbol 0 is left for letters that no sample holds.

Texts are parsed side by side: a batch is cut into blocks of ``BLOCK`` symbols (each begins a new phrase), and one
NumPy step moves all blocks on by one symbol.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anomalytics.llm.common import free_worker, prepare

BLOCK = 2048
LANES = 1 << 16
SPACE = 1           # symbol 0 is a letter that no sample holds
DIGITS = 64         # rarer letters are numbers to this base


def fold(code_point: int) -> int:
    """Lower-case code point of a letter, else 0."""
    char = chr(code_point)
    if not char.isalpha():
        return 0
    lower = char.lower()
    return ord(lower[0])


def code_length(alphabet: list[str], singles: int) -> int:
    """Digits of a letter beyond the first ``singles`` ones: 0 if there is none."""
    rare = len(alphabet) - singles
    return 0 if rare <= 0 else 2 if rare <= DIGITS ** 2 else 3


def symbol_count(alphabet: list[str], singles: int) -> int:
    """Symbols that occur: one for unknown letters, the space, the single letters and the digits."""
    return 2 + min(len(alphabet), singles) + (DIGITS if code_length(alphabet, singles) else 0)


def symbol_table(alphabet: list[str], singles: int = 62) -> np.ndarray:
    """code point -> code: 1 for what is no letter, 0 for letters outside the alphabet.

    The first ``singles`` letters have the symbols from 2 on. The n-th one after them has a code above 255: n + 256,
    which ``symbols_of`` writes out as digits.
    """
    table = np.full(0x110000, SPACE, dtype=np.int32)
    place = {ord(c): i + 2 if i < singles else i - singles + 256 for i, c in enumerate(alphabet)}
    for code_point in range(0x110000):
        if 0xD800 <= code_point < 0xE000:
            continue
        low = fold(code_point)
        if low:
            table[code_point] = place.get(low, 0)
    return table


def codes_of(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts in a row, runs of what is no letter as one space, and the number of each text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    found = table[points]
    owner = np.repeat(np.arange(len(texts)), sizes)
    space = found == SPACE
    begins = np.ones(len(found), dtype=bool)
    if len(found):
        begins[1:] = owner[1:] != owner[:-1]
    follows = np.zeros(len(found), dtype=bool)
    follows[1:] = space[:-1]
    keep = ~(space & (follows | begins))        # of a run of spaces the first one, none at the beginning
    return found[keep], np.bincount(owner[keep], minlength=len(texts))


def spelled(codes: np.ndarray, lengths: np.ndarray, digits: int, first_digit: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts in a row and their number in each text: codes above 255 become digits."""
    rare = codes >= 256
    if not digits or not rare.any():
        return codes.astype(np.uint8), lengths
    size = np.where(rare, digits, 1)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]), dtype=np.uint8)
    out[ends[~rare] - 1] = codes[~rare]
    number = codes[rare] - 256
    for place in range(digits):                 # the last digit first
        out[ends[rare] - 1 - place] = first_digit + number % DIGITS
        number //= DIGITS
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return out, np.bincount(owner, weights=size, minlength=len(lengths)).astype(np.int64)


def symbols_of(texts: list[str], table: np.ndarray, digits: int = 0, first_digit: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row and the number of them in each text."""
    return spelled(*codes_of(texts, table), digits, first_digit)


def suffix_automaton(text: bytes, width: int) -> np.ndarray:
    """Packed transitions (state * width, breaks) of the suffix automaton of ``text``, with failed steps resolved.

    Where the automaton has no step the phrase ends (one break) and the symbol begins the next one at the root; a
    symbol that the sample does not hold at all is a phrase of its own.
    """
    link, size, step = [-1], [0], [{}]
    last = 0
    for symbol in text:
        here = len(step)
        link.append(0)
        size.append(size[last] + 1)
        step.append({})
        at = last
        while at >= 0 and symbol not in step[at]:
            step[at][symbol] = here
            at = link[at]
        if at >= 0:
            to = step[at][symbol]
            if size[at] + 1 == size[to]:
                link[here] = to
            else:
                copy = len(step)
                link.append(link[to])
                size.append(size[at] + 1)
                step.append(dict(step[to]))
                while at >= 0 and step[at].get(symbol) == to:
                    step[at][symbol] = copy
                    at = link[at]
                link[to] = link[here] = copy
        last = here
    table = np.full((len(step), width), -1, dtype=np.int32)
    for state, steps in enumerate(step):
        for symbol, to in steps.items():
            table[state, symbol] = to
    root = table[0]
    restart = np.where(root >= 0, root * width * 4, 0)          # the state after a break
    breaks = np.where(root >= 0, 1, 2)                          # an unknown symbol also ends its own phrase
    packed = np.where(table >= 0, table * width * 4, restart + breaks)
    packed[0] = np.where(root >= 0, root * width * 4, 1)        # nothing to break off at the root
    return packed.astype(np.int32)


def count_phrases(symbols: np.ndarray, lengths: np.ndarray, automata: list[np.ndarray], width: int) -> np.ndarray:
    """Phrases of each text (rows) in each language (columns)."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    blocks = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(lengths)), blocks)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = starts[owner] + within * BLOCK
    size = np.minimum(BLOCK, lengths[owner] - within * BLOCK)
    out = np.zeros((len(lengths), len(automata)), dtype=np.int64)
    order = np.argsort(-size, kind="stable")                    # longest blocks first: the live ones stay in front
    for part in range(0, len(order), LANES):
        lanes = order[part:part + LANES]
        live = np.searchsorted(-size[lanes], -np.arange(size[lanes[0]]), side="left")
        found = np.zeros((len(automata), len(lanes)), dtype=np.int32)
        state = np.zeros((len(automata), len(lanes)), dtype=np.int32)
        at = first[lanes]
        for t, n in enumerate(live):
            symbol = symbols[at[:n] + t]
            for k, automaton in enumerate(automata):
                step = automaton.take(state[k, :n] + symbol)
                found[k, :n] += step & 3
                state[k, :n] = step >> 2
        found += state > 0                                      # the phrase that the end cuts off
        for k in range(len(automata)):
            out[:, k] += np.bincount(owner[lanes], weights=found[k], minlength=len(lengths)).astype(np.int64)
    return out


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", sample_docs: int = 256,
        sample_chars: int = 40_000, max_symbols: int = 62, max_cells: int = 1 << 27) -> dict:
    """One suffix automaton per language, from a bounded sample: {langs, alphabet, singles, tables, bits}.

    The sample of a language is its ``sample_docs`` distinct texts of smallest hash, cut at ``sample_chars`` symbols in
    all; the alphabet is all their letters, the ``max_symbols`` (at most 190) commonest ones written with one symbol.
    So what reaches the driver is bounded per language; with very many languages ``sample_chars`` shrinks so that all automata hold at most ``max_cells``
    transitions. Texts are chosen in two steps, within 64 shares of a language first, so no task ranks all of a language.
    """
    order = Window.partitionBy("lang").orderBy("h")
    share = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h")
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    chosen = usable.select("lang", "h").distinct()
    for ranked in (share, order):
        chosen = chosen.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= sample_docs).drop("n")
    # at most sample_docs rows a language, so that texts are filtered where they are read and only the sample is shuffled
    rows = (usable.join(F.broadcast(chosen), ["lang", "h"], "left_semi").groupBy("lang", "h")
            .agg(F.min(F.substring("text", 1, sample_chars)).alias("text")).orderBy("lang", "h").collect())
    samples: dict[str, list[str]] = {}
    for row in rows:
        samples.setdefault(row.lang, []).append(row.text)
    langs = sorted(samples)
    letters: dict[str, int] = {}
    for texts in samples.values():
        for c in "".join(texts):
            low = fold(ord(c))
            if low:
                letters[chr(low)] = letters.get(chr(low), 0) + 1
    alphabet = sorted(sorted(letters), key=lambda c: -letters[c])
    width, digits = symbol_count(alphabet, max_symbols), code_length(alphabet, max_symbols)
    table = symbol_table(alphabet, max_symbols)
    most = min(sample_chars, max_cells // (2 * width * max(1, len(langs))))
    tables, bits = [], []
    for lang in langs:
        symbols = symbols_of([" ".join(samples[lang])], table, digits, width - DIGITS)[0][:most]
        tables.append(suffix_automaton(symbols.tobytes(), width))
        bits.append(float(np.log2(max(2, len(symbols)))))
    return {"langs": langs, "alphabet": alphabet, "singles": max_symbols, "tables": tables, "bits": bits}


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score, bits, phrase_len[, kept columns]) of every whole text.

    ``score`` is 1 - best / second-best entropy estimate (1 with a single language), ``bits`` the best estimate and
    ``phrase_len`` the mean number of letters and spaces of a phrase of the winner.

    * A null text, or one without a letter, is ``und`` with score 0. So is every text if nothing could be learned.
    * Equal estimates go to the language that sorts first, with score 0. Letters that no sample holds are phrases of
      their own in every language. Repeated rows and null ids stay, a row each. An empty table gives an empty result.
    * Very long texts are parsed whole; each block of ``BLOCK`` symbols begins a new phrase.
    * Only the id, the text and the kept columns are read; the last are passed through and are no input.
    """
    spark = prepare(docs.sparkSession)
    langs, alphabet, singles = model["langs"], model["alphabet"], model["singles"]
    width, digits = symbol_count(alphabet, singles), code_length(alphabet, singles)
    shared = spark.sparkContext.broadcast((symbol_table(alphabet, singles).tobytes(), [t.tobytes() for t in model["tables"]]))
    bits = np.array(model["bits"])

    def run(batches):
        free_worker()
        table = np.frombuffer(shared.value[0], dtype=np.int32)
        automata = [np.frombuffer(t, dtype=np.int32) for t in shared.value[1]]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            pred, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            best_bits, phrase = np.zeros(len(texts)), np.zeros(len(texts))
            if langs and texts:
                codes, places = codes_of(texts, table)
                symbols, lengths = spelled(codes, places, digits, width - DIGITS)
                letters = np.flatnonzero(lengths > 0)
                estimate = count_phrases(symbols, lengths, automata, width)[letters] * bits / lengths[letters, None]
                order = np.sort(estimate, axis=1)
                winner = estimate.argmin(axis=1)
                pred[letters] = np.array(langs, dtype=object)[winner]
                score[letters] = 1 - order[:, 0] / order[:, 1] if len(langs) > 1 else 1.0
                best_bits[letters] = order[:, 0]
                phrase[letters] = bits[winner] / order[:, 0] * (places[letters] / lengths[letters])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(best_bits), pa.array(phrase),
                 *[batch.column(i) for i in range(2, 2 + len(keep))]],
                names=["id", "lang_pred", "score", "bits", "phrase_len", *[f"kept_{c}" for c in keep]])

    kind = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = f"id {kind[id_col]}, lang_pred string, score double, bits double, phrase_len double"
    schema += "".join(f", `kept_{c}` {kind[c]}" for c in keep)
    return docs.select(F.col(id_col), F.col(text_col), *[F.col(c).alias(f"kept_{c}") for c in keep]).mapInArrow(run, schema)
