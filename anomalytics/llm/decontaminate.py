"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, the units behind them and names become typed placeholders, other words are lower-cased, so a benchmark
question and its copy with other numbers or names have the same template. Candidates come from keys of one or two
template tokens: items index groups that do not overlap, documents ask at every offset. An item of ``n`` tokens that
agrees with a document but for ``m`` tokens has at most ``m`` groups that differ, and a run that agrees holds all
groups inside it, so every (document, item, offset) that the rule below accepts shares a known number of groups
(``needed_groups``). Half of that number, the commonest groups, are not indexed; offsets that share fewer of the others
than must be left go. What is left is aligned in full:
literal tokens must be equal, and the slots must be consistent - one value of the item always stands for the same
value of the document, and the other way round. Inconsistent slots count as mismatches.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anomalytics.llm.common import materialize, prepare

END, NUMBER, UNIT, NAME = "\uE000", "\uE001", "\uE002", "\uE003"      # private-use marks in the template text
#: fixed values: units that are recognised behind a number
UNITS = ("%|km/h|kmh|mph|km|cm|mm|nm|kg|mg|ml|kb|mb|gb|tb|hz|khz|mhz|ghz|kw|mw|ft|in|lb|lbs|oz|m|g|l|s|h|"
         "meters?|metres?|kilometers?|kilometres?|miles?|feet|foot|inch(?:es)?|grams?|kilograms?|kilos?|pounds?|"
         "liters?|litres?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|degrees?")
#: fixed values: words that are no names where they open a sentence
OPENERS = ("a|an|the|this|that|these|those|he|she|it|they|we|you|i|his|her|its|their|our|my|your|there|here|if|when|while|"
           "after|before|since|because|as|at|by|for|from|in|into|of|on|to|with|and|but|or|so|then|how|what|which|who|whom|"
           "whose|why|where|is|are|was|were|do|does|did|has|have|had|can|could|will|would|should|let|find|each|every|all|"
           "some|both|one|two|three|no|not|now|given|suppose|assume|calculate|compute|determine|take")
BROADCAST_ROWS = 500_000


def marked(text: Column) -> Column:
    """Lower-cased text in which every slot is written as mark, value, end mark. Marks that the text itself holds are
    no letters, so they become spaces."""
    marks = END + NUMBER + UNIT + NAME
    held = functools.reduce(operator.or_, [F.contains(text, F.lit(m)) for m in marks])
    out = F.when(held, F.translate(text, marks, " " * len(marks))).otherwise(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"([0-9](?:[0-9.,:/]*[0-9])?)", f" {NUMBER}$1{END} ")
    out = F.regexp_replace(out, rf"({END} )\s?((?i:{UNITS}))(?![\p{{L}}\p{{N}}])", f"$1{UNIT}$2{END} ")
    out = F.regexp_replace(out, r"(?=\p{Lu})(?:(?<=[\p{Ll},;] )|(?<=^|\n|[.!?:] |[.!?:][\"')] )"
                                rf"(?!(?i:{OPENERS})(?![\p{{L}}\p{{N}}])))(\p{{Lu}}\p{{L}}+)", f" {NAME}$1{END} ")
    return F.lower(out)


def slot_tokens(text_marked: Column) -> Column:
    """Tokens of a marked text with the values of the slots: mark + value for a slot, the word otherwise."""
    return F.regexp_extract_all(text_marked, F.lit(rf"[\p{{L}}\p{{N}}]++|[{NUMBER}{UNIT}{NAME}][^{END}]*+"), F.lit(0))


def template_tokens(text_marked: Column) -> Column:
    """Tokens of the template: a bare mark for a slot, the word otherwise."""
    return F.transform(slot_tokens(text_marked), lambda t: F.when(is_slot(t), F.substring(t, 1, 1)).otherwise(t))


def is_slot(token: Column) -> Column:
    """True for a token that begins with one of the marks, which are neighbours."""
    return (token >= NUMBER) & (token < chr(ord(NAME) + 1))


def keys(tokens: Column, width: int) -> Column:
    """Hashes of the ``width`` (1 or 2) template tokens from every position on."""
    if width == 1:
        return F.transform(tokens, lambda x: F.xxhash64(x))
    return F.transform(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))),
                       lambda x, i: F.xxhash64(x, F.get(tokens, i + 1)))


def needed_groups(n_tokens: Column, width: int, min_run: int, min_share: float) -> Column:
    """How many of an item's groups of ``width`` tokens agree at least where the item is held."""
    agreeing = F.greatest(F.ceil(min_share * n_tokens - 1e-9), F.lit(1))
    by_share = F.floor(n_tokens / width) - (n_tokens - agreeing)
    return F.when(n_tokens >= min_run, F.least(by_share, F.lit((min_run - width + 1) // width))).otherwise(by_share).cast("int")


def item_groups(items: DataFrame, id_col: str, text_col: str, min_run: int, min_share: float) -> DataFrame:
    """(width, hash, item_id, item_pos, n_tokens, needed) of the groups that an item is looked up by: pairs, or single
    tokens where pairs could all differ.

    An item that must share ``needed`` groups may leave out ``needed // 2`` of them and still shares the rest. Those
    with the fewest letters are left out: short words make the pairs that most documents hold. (Which ones go decides
    the cost only.)
    """
    tokens = (items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), template_tokens(marked(F.col(text_col))).alias("t"))
              .where(F.size("t") > 0))
    by_pairs, by_ones = (needed_groups(F.size("t"), width, min_run, min_share) for width in (2, 1))
    found = tokens.withColumn("width", F.when(by_pairs >= 1, 2).otherwise(1)).withColumn(
        "shared", F.when(F.col("width") == 2, by_pairs).otherwise(F.greatest(by_ones, F.lit(1))))
    letters = lambda i: F.length(F.regexp_replace(F.concat(
        F.get("t", i), F.when(F.col("width") == 2, F.get("t", i + 1)).otherwise("")), f"[{NUMBER}{UNIT}{NAME}]", ""))
    hashes = F.when(F.col("width") == 2, keys(F.col("t"), 2)).otherwise(keys(F.col("t"), 1))
    groups = F.filter(F.transform(hashes, lambda h, i: F.struct(letters(i).alias("letters"), i.alias("item_pos"), h.alias("hash"))),
                      lambda g: g["item_pos"] % F.col("width") == 0)
    left_out = F.floor(F.col("shared") / 2).cast("int")
    return (
        found.select("item_id", "width", (F.col("shared") - left_out).alias("needed"), F.size("t").alias("n_tokens"),
                     F.explode(F.slice(F.array_sort(groups), left_out + 1, F.size(groups))).alias("g"))
        .select("width", "g.hash", "item_id", "g.item_pos", "n_tokens", "needed"))


def _aligned(rows: DataFrame) -> DataFrame:
    """Adds flags ('1' / '0' per aligned position) and verbatim (agreeing slots hold equal values) to rows of aligned
    token arrays ``a`` and ``b``. Each step is a column, so that it is computed once per row."""
    same_kind = lambda p: is_slot(p["a"]) & (F.substring(p["a"], 1, 1) == F.substring(p["b"], 1, 1))
    only = lambda p, side: F.size(F.filter("slots", lambda q: q[side] == p[side])) == 1
    agree = lambda p: F.coalesce(F.when(is_slot(p["a"]), F.array_contains("sound", p))
                                 .otherwise(p["a"] == p["b"]), F.lit(False))
    return (
        rows.withColumn("pairs", F.arrays_zip("a", "b"))
        .withColumn("slots", F.array_distinct(F.filter("pairs", same_kind)))
        .withColumn("sound", F.filter("slots", lambda p: only(p, "a") & only(p, "b")))
        .withColumn("flags", F.array_join(F.transform("pairs", lambda p: F.when(agree(p), "1").otherwise("0")), ""))
        .withColumn("verbatim", F.forall("sound", lambda p: p["a"] == p["b"]))
    )


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text",
                 min_run: int = 13, min_share: float = 0.6) -> DataFrame:
    """(id, item_id, n_tokens, n_match, longest_run, kind) of every document that holds a benchmark item.

    A document holds an item if, at one offset, at least ``min_run`` tokens in a row agree (all tokens of a shorter
    item) or at least ``min_share`` of the item's tokens do. ``kind`` is ``verbatim`` if all agreeing slots have the
    item's values, else ``reparameterised``. One row per document and item, for its best offset.

    * Null or empty texts hold nothing, null or empty items are held by nothing. Rows with a null document or item id
      are left out. Rows that repeat an id are one document: the best of them counts.
    * Items of any length are found anywhere in a document. Items with equal texts each get a row. Other columns are not read. An empty table on either side gives an empty result.
    """
    prepare(docs.sparkSession)
    index = materialize(item_groups(items, item_id_col, item_text_col, min_run, min_share), "benchmark-groups")
    n_groups = {row.width: row["count"] for row in index.groupBy("width").count().collect()}
    # written once: the look-up and the alignment both need it, and its regular expressions are a good part of their time
    texts = materialize(docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), marked(F.col(text_col)).alias("doc_text")), "marked-texts")
    tokens = texts.select("id", template_tokens(F.col("doc_text")).alias("t"))
    shared = None
    for width in sorted(n_groups) or [2]:
        own = index.where(F.col("width") == width).drop("width")
        if n_groups.get(width, 0) <= BROADCAST_ROWS:        # about 20 MB; beyond it the planner chooses the join
            own = F.broadcast(own)
        met = (tokens.select("id", F.posexplode(keys(F.col("t"), width)).alias("pos", "hash")).join(own, "hash")
               .select("id", "item_id", (F.col("pos") - F.col("item_pos")).alias("offset"), "n_tokens", "needed"))
        shared = met if shared is None else shared.unionByName(met)
    candidates = materialize(
        shared.groupBy("id", "item_id", "offset").agg(F.count("*").alias("n"), F.max("needed").alias("needed"), F.max("n_tokens").alias("n_tokens"))
        .where(F.col("n") >= F.col("needed")).select("id", "item_id", "offset", "n_tokens"), "benchmark-candidates")

    item_texts = items.select(F.col(item_id_col).alias("item_id"), slot_tokens(marked(F.col(item_text_col))).alias("item"))
    asked = candidates.groupBy("id").agg(F.collect_list(F.struct("item_id", "offset", "n_tokens")).alias("all"))
    whole = asked.join(texts, "id").select("id", "all", slot_tokens(F.col("doc_text")).alias("doc"))     # once a document
    from_item, from_doc = (lambda c: F.greatest(-c, F.lit(0))), (lambda c: F.greatest(c, F.lit(0)))
    parts = whole.select("id", F.explode(F.transform("all", lambda c: F.struct(
        c["item_id"].alias("item_id"), c["offset"].alias("offset"), F.slice(
            F.col("doc"), from_doc(c["offset"]) + 1, F.greatest(F.lit(0), F.least(
                c["n_tokens"] - from_item(c["offset"]), F.size("doc") - from_doc(c["offset"])))).alias("b")))).alias("c")).select("id", "c.*")
    alike = lambda x, y: (x == y) | (is_slot(x) & (F.substring(x, 1, 1) == F.substring(y, 1, 1)))
    met = (
        parts.join(item_texts, "item_id")
        .withColumn("a", F.slice("item", from_item(F.col("offset")) + 1, F.size("b")))
        .where(F.size(F.filter(F.zip_with("a", "b", alike), lambda x: x))
               >= F.least(F.lit(min_run), F.ceil(min_share * F.size("item") - 1e-9))))
    judged = (
        _aligned(met.select("id", "item_id", F.size("item").alias("n_tokens"), "a", "b"))
        .select("id", "item_id", "n_tokens", "verbatim", F.length(F.regexp_replace("flags", "0", "")).alias("n_match"),
                F.regexp_extract_all("flags", F.lit("1+"), F.lit(0)).alias("runs"))
        .withColumn("longest_run", F.coalesce(F.array_max(F.transform("runs", F.length)), F.lit(0)))
        .where((F.col("longest_run") >= F.least(F.lit(min_run), F.col("n_tokens")))
               | (F.col("n_match") >= min_share * F.col("n_tokens"))))
    best = F.max(F.struct("n_match", "longest_run", "verbatim", "n_tokens")).alias("best")
    return judged.groupBy("id", "item_id").agg(best).select(
        "id", "item_id", F.col("best.n_tokens").alias("n_tokens"), F.col("best.n_match").alias("n_match"),
        F.col("best.longest_run").alias("longest_run"),
        F.when(F.col("best.verbatim"), "verbatim").otherwise("reparameterised").alias("kind"))
