"""Byte-level BPE encoding and decoding through a lazily determinised finite-state transducer.

A token sequence is the BPE encoding of its bytes exactly when every token encodes to itself and every two neighbours
encode to themselves. That gives a non-deterministic transducer whose states are (last token, node of the vocabulary's
prefix tree): reading a byte goes down the tree, and where a token ends that may follow the last one, a boundary opens
at the root. Determinised, a state is the set of live hypotheses, and a transition tells which token ends at the byte.
A hypothesis dies as soon as its bytes leave the tree, so after a look-ahead of at most the longest token one is left,
and the tokens before it are emitted. States and transitions are made when a text first needs them and kept; beyond ``max_states`` the tables
start afresh, so memory stays bounded.

Decoding feeds token bytes in pieces to an incremental UTF-8 state machine, which holds back an unfinished character.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame

from anomalytics.llm.common import kept_in_worker, prepare


#: a transition is (state << 8 + TOKEN_BITS | token): without the token, the state is in place for the next byte
TOKEN_BITS = 24
TOKEN_MASK = (1 << TOKEN_BITS) - 1
LOOKAHEAD = 256                # bytes of a longer match between two looks for what is settled
ROWS = 1024                    # texts that a task hands on at a time


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """token bytes -> rank of a file of base64 tokens and ranks."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge(ranks: dict[bytes, int], data: bytes, below: int = 1 << 62) -> list[int]:
    """BPE by its definition: join the neighbours of lowest rank, leftmost first, by ranks under ``below``.

    Only single tokens go through this, when the transducer first meets them.
    """
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        options = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))
                   if ranks.get(a + b, below) < below]
        if not options:
            break
        at = min(options)[1]
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class _Steps(dict):
    """(state, byte) -> next state and the token that ends there, made when it is first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: int) -> int:
        made = self[key] = self.make(key >> 8, key & 255)
        return made


class Transducer:
    """Lazily determinised BPE transducer; ``encode`` takes the bytes of one pre-token.

    A hypothesis is (last token, node of the prefix tree). Those of a state are kept longest node first; the one at
    the root comes last, and there is always exactly one, as every text has one encoding. A state is kept as bytes, eight
    a hypothesis ((last token + 1) << 32 | node): a worker holds up to ``max_states``.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000):
        self.ranks, self.max_states = ranks, max_states
        self.tokens = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}            # node * 256 + byte -> node; the root is 0
        self.rank_at: list[int] = [-1]             # the token that ends at a node, whether or not it can be reached
        self.grows: list[bool] = [True]            # a longer token goes on from this node
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.grows[node] = True
                at = self.child.get(node << 8 | byte)
                if at is None:
                    at = self.child[node << 8 | byte] = len(self.rank_at)
                    self.rank_at.append(-1)
                    self.grows.append(False)
                node = at
            self.rank_at[node] = rank
        self.reached: dict[int, bool] = {}         # token -> its bytes encode to itself
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.size = {i: len(t) for t, i in ranks.items()}
        self._restart()

    def _restart(self) -> None:
        self.states = [bytes(8)]
        self.ids = {self.states[0]: 0}
        self.next = _Steps(self._step)             # state * 256 + byte -> (next state * 256, token that ends there)
        self.pairs: dict[int, bool] = {}

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one last; None for a single byte."""
        if token not in self.halves:
            data = self.tokens[token]
            parts = merge(self.ranks, data, token) if len(data) > 1 else []
            self.halves[token] = tuple(parts) if len(parts) == 2 else None
        return self.halves[token]

    def _reachable(self, token: int) -> bool:
        if token not in self.reached:
            self.reached[token] = merge(self.ranks, self.tokens[token]) == [token]
        return self.reached[token]

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether no merge ever crosses the border of the two tokens.

        Undoes the merges next to the border, the latest first. At each stage the two pieces at the border existed
        until the merge that was just undone; if they form a token of a lower rank, that merge came first.
        """
        a, b, until = left, right, len(self.ranks) << 1
        while True:
            joined = self.ranks.get(self.tokens[a] + self.tokens[b], until)
            if joined < until:
                return False
            split_a, split_b = self._split(a), self._split(b)
            if split_a is None and split_b is None:
                return True
            if split_b is None or (split_a is not None and a > b):
                until, a = a, split_a[1]           # a tie of ranks: the left one was merged first
            else:
                until, b = b + 1, split_b[0]

    def _step(self, state: int, byte: int) -> int:
        live, border = [], -1
        child, grows, rank_at, pairs = self.child, self.grows, self.rank_at, self.pairs
        for held in memoryview(self.states[state]).cast("Q"):
            at = child.get((held & 0xFFFFFFFF) << 8 | byte)
            if at is None:
                continue
            last = (held >> 32) - 1
            if grows[at]:
                live.append(last + 1 << 32 | at)
            if border < 0:
                token = rank_at[at]
                if token >= 0:
                    key = last << 32 | token
                    fits = pairs.get(key)
                    if fits is None:
                        fits = pairs[key] = self._reachable(token) and (last < 0 or self._may_follow(last, token))
                    if fits:
                        border = token
        live.append(border + 1 << 32)
        reached = array("Q", live).tobytes()
        target = self.ids.get(reached)
        if target is None:
            target = self.ids[reached] = len(self.states)
            self.states.append(reached)
        return target << 8 + TOKEN_BITS | border

    def encode(self, data: bytes) -> list[int]:
        """Tokens of a pre-token. What lies before a state with one hypothesis is settled and is emitted there."""
        if len(self.states) > self.max_states:
            self._restart()
        out: list[int] = []
        borders: list[int] = []
        step, following = 0, self.next
        for at in range(0, len(data), LOOKAHEAD):
            borders += [step := following[step >> TOKEN_BITS | byte] for byte in data[at:at + LOOKAHEAD]]
            if len(data) > LOOKAHEAD:
                sure = len(borders)
                while sure and len(self.states[borders[sure - 1] >> 8 + TOKEN_BITS]) > 8:
                    sure -= 1
                out += self._settled(borders[:sure])
                del borders[:sure]
        return out + self._settled(borders) if out else self._settled(borders)

    def _settled(self, borders: list[int]) -> list[int]:
        """The tokens behind the last border, found from the token that ends at each border."""
        size, at, out = self.size, len(borders), []
        while at:
            token = borders[at - 1] & TOKEN_MASK
            out.append(token)
            at -= size[token]
        out.reverse()
        return out


class _Packed(dict):
    """text -> packed ids, filled by ``make``.

    Beyond ``most`` entries the older half goes; an old entry that is asked for again is kept.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most // 2, {}

    def __missing__(self, key: str) -> bytes:
        made = self.old.get(key)
        if made is None:
            made = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = made
        return made


class Encoder:
    """Text -> ids packed as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 300_000):
        import re

        import regex

        self.transducer, self.ranks = Transducer(ranks), ranks
        self.findall = regex.compile(pattern).findall
        # A space between two characters that are not white space always begins a match of the pattern, so the text
        # may be cut there and a piece looked up on its own.
        self.uneven = re.compile(r"\s | \s|^ | $").search
        self.letters_join = all(self.findall(x) == [x] for x in (" aZ", " z\u00e9\u024f", " \u00aax"))
        self.matches = _Packed(self._match, most)
        self.pieces = _Packed(self._piece, 2 * most)

    def _match(self, text: str) -> bytes:
        data = text.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else self.transducer.encode(data)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _slow(self, text: str) -> bytes:
        matches, pieces = self.matches, self.pieces
        # a space and letters are kept once, as the piece that they are elsewhere
        return b"".join([pieces[m[1:]] if m[0] == " " and self._letters(m[1:]) else matches[m] for m in self.findall(text)])

    def _letters(self, piece: str) -> bool:
        """Letters that all Unicode versions agree on, which are one match with the space before them."""
        return self.letters_join and piece.isalpha() and max(piece) < "\u0250"

    def _piece(self, piece: str) -> bytes:
        """A space and what follows it. Letters are one match and are taken without asking the pattern."""
        if self._letters(piece):
            return self._match(" " + piece)
        return self._slow(" " + piece)

    def encode(self, text: str) -> bytes:
        if not text or self.uneven(text):
            return self._slow(text)
        first, *rest = text.split(" ")
        pieces = self.pieces
        return self._slow(first) + b"".join([pieces[p] for p in rest])


class Utf8Machine:
    """Incremental UTF-8 decoding: the state is the unfinished character (at most three bytes)."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.held + data
        cut = len(data)
        if not last:
            for back in range(1, min(3, len(data)) + 1):
                lead = data[-back]
                if lead >= 0xC0:                                  # a lead byte: are its followers all there?
                    cut -= back if back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) else 0
                    break
                if lead < 0x80:
                    break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")


def decode(vocabulary: list[bytes], ids, piece: int = 65_536):
    """Yields (bytes, text) for every ``piece`` ids; the text never ends inside a character."""
    machine = Utf8Machine()
    for at in range(0, len(ids), piece):
        data = b"".join([vocabulary[i] for i in ids[at:at + piece]])
        yield data, machine.feed(data, at + piece >= len(ids))


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
               outputs: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>][, decoded string]) of every whole text.

    Each match of ``pattern`` is encoded separately by the ranks of the file at ``ranks_path`` (read on the driver,
    its size is the vocabulary's), without special tokens; the ids are decoded again. ``outputs`` names the results
    that are wanted besides the hashes: ``ids`` and ``decoded``.

    * A null or empty text has no tokens: n_tokens 0, the hashes are those of no bytes.
    * Very long texts and matches are encoded in time linear in their bytes. Repeated rows and null ids stay, a row
      for each. Other columns are not read. An empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        data = f.read()
    shared = spark.sparkContext.broadcast(data)
    key = hashlib.sha256(data + pattern.encode()).hexdigest()

    def make():
        ranks = parse_ranks(shared.value)
        vocabulary = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            vocabulary[rank] = token
        return Encoder(ranks, pattern), vocabulary

    def run(batches):
        encoder, vocabulary = kept_in_worker(key, make)

        def rows(ids_column, texts):
            sizes, ids_hash, back_hash, packed_all, decoded = [0], [], [], [], []
            for text in texts:
                packed = encoder.encode(text or "")
                ids = memoryview(packed).cast("I")
                back, parts = hashlib.sha256(), []
                for data, part in decode(vocabulary, ids):
                    back.update(data)
                    parts.append(part)
                sizes.append(sizes[-1] + len(ids))
                ids_hash.append(hashlib.sha256(packed).hexdigest())
                back_hash.append(back.hexdigest())
                if "ids" in outputs:
                    packed_all.append(packed)
                if "decoded" in outputs:
                    decoded.append("".join(parts))
            columns = {"id": ids_column, "n_tokens": pa.array([b - a for a, b in zip(sizes, sizes[1:], strict=False)], pa.int64()),
                       "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(back_hash, pa.string())}
            if "ids" in outputs:
                whole = pa.Array.from_buffers(pa.int32(), sizes[-1], [None, pa.py_buffer(b"".join(packed_all))])
                columns["ids"] = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), whole)
            if "decoded" in outputs:
                columns["decoded"] = pa.array(decoded, pa.string())
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for at in range(0, len(batch), ROWS):
                yield rows(batch.column(0).slice(at, ROWS), batch.column(1).slice(at, ROWS).to_pylist())

    id_type = docs.schema[id_col].dataType.simpleString()
    extra = {"ids": ", ids array<int>", "decoded": ", decoded string"}
    schema = f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(run, schema + "".join(x for k, x in extra.items() if k in outputs))
