"""Secret scan with a trigram inverted index.

Each rule's regex is parsed into a Boolean trigram query (AND / OR of trigrams that every match must hold). Every
Arrow batch of documents becomes one segment of an inverted index: trigram -> sorted row numbers of the texts that
hold it. A rule's postings are intersected and united as its query says, and only those candidates are read by the
regex. A rule without mandatory trigrams scans every text. The index works on texts with A-Z in lower case, so one
index serves rules in either case.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anomalytics.llm.common import free_worker, prepare

#: kind, pattern, case matters, group whose length counts, least length. The three base kinds first,
#: then the spans the index adds at no extra scan (well-known public token formats).
BASE_RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", False, 2, 12),
    ("access", r"AKIA[A-Z0-9]+", True, 0, 18),
    ("hex", r"[0-9a-f]+", True, 0, 16),
)
EXTRA_RULES = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", True, 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", True, 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", True, 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", True, 0, 30),
)
MAX_EXACT = 64      # strings that a part of a pattern may spell out before it is cut


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND of ORs of ANDs: each entry is a list of alternatives, one of whose trigram sets a match must hold in full.

    An empty list means that the pattern has no mandatory trigram. Literals are lower-cased.
    """
    from re import _constants as C
    from re import _parser

    clauses: list[list[frozenset[str]]] = []

    def cut(strings: set[str]) -> None:
        """What stands before a part of unknown text: one of these strings must occur."""
        options = {_trigrams(s) for s in strings}
        if options and frozenset() not in options:
            clauses.append([o for o in options if not any(p < o for p in options)])

    def spell(items) -> set[str] | None:
        """All strings that these parts can match if there are few, else None."""
        whole = {""}
        for op, arg in items:
            part = spell_one(op, arg)
            if part is None or len(whole) * len(part) > MAX_EXACT:
                return None
            whole = {a + b for a in whole for b in part}
        return whole

    def spell_one(op, arg) -> set[str] | None:
        if op is C.LITERAL:
            return {chr(arg).lower()}
        if op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 8:
            return {chr(a).lower() for _, a in arg}
        if op is C.SUBPATTERN:
            return spell(arg[3])
        if op is C.BRANCH:
            parts = [spell(p) for p in arg[1]]
            return None if None in parts else set().union(*parts)
        if op is C.MAX_REPEAT and arg[1] <= 1:
            part = spell(arg[2])
            return part if part is None or arg[0] == 1 else part | {""}
        return None

    whole = {""}
    for op, arg in _parser.parse(pattern):
        part = spell_one(op, arg)
        if part is None or len(whole) * len(part) > MAX_EXACT:
            cut(whole)
            whole = {""} if part is None else part
        else:
            whole = {a + b for a in whole for b in part}
    cut(whole)
    return clauses


def _candidates(clauses: list[list[frozenset[str]]], postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Row numbers that satisfy the Boolean query (all rows, if it is empty)."""
    rows = np.arange(n)
    for options in clauses:
        alternatives = [reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True),
                               sorted((postings[t] for t in option), key=len)) for option in options]
        rows = np.intersect1d(rows, reduce(np.union1d, alternatives), assume_unique=True)
    return rows


def _lower(text: str) -> str:
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode(
        "utf-8", "surrogatepass")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                rules: tuple = BASE_RULES + EXTRA_RULES) -> DataFrame:
    """All secret spans of every text: (id, spans array<struct<kind, start, end>>), ordered by start, then rule.

    Matches of a rule are leftmost and do not overlap; a match whose counted group is too short is dropped and the
    search goes on behind it. Positions are code points, the end is exclusive.

    * A null or empty text has no spans (an empty array). Null ids and repeated rows are kept, one result per row.
    * Matches that start at the same place are ordered as the rules are listed.
    * Other columns are not read. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    order = {kind: i for i, (kind, *_) in enumerate(rules)}
    plan = [(kind, pattern, cased, group, least, trigram_query(pattern)) for kind, pattern, cased, group, least in rules]
    vocabulary = sorted({t for *_, clauses in plan for options in clauses for o in options for t in o})

    def scan(batches):
        free_worker()
        compiled = []
        for kind, pattern, cased, group, least, clauses in plan:
            run = re.fullmatch(r"(\[[^\]]+\])\+", pattern)      # a bare run: its least length can go into the regex
            if run and group == 0 and least:
                pattern = f"{run[1]}{{{least},}}"
            compiled.append((kind, re.compile(pattern, re.ASCII | (0 if cased else re.IGNORECASE)), group, least, clauses))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            lowered = [_lower(t) for t in texts]
            postings = {t: np.array([i for i, x in enumerate(lowered) if t in x], dtype=np.int64) for t in vocabulary}
            found: list[list[tuple[int, int, int, str]]] = [[] for _ in texts]
            for kind, regex, group, least, clauses in compiled:
                for i in _candidates(clauses, postings, len(texts)):
                    for m in regex.finditer(texts[i]):
                        if m.end(group) - m.start(group) >= least:
                            found[i].append((m.start(), order[kind], m.end(), kind))
            spans = [[{"kind": k, "start": s, "end": e} for s, _, e, k in sorted(x)] for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                                                      ("end", pa.int64())])))], names=["id", "spans"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        scan, f"id {id_type}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
