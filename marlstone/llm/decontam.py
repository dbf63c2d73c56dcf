"""Operator 8: benchmark decontamination by a prefix-filtered set join. DataFrame functions only."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import plain_words, row_key
from marlstone.operators.joins import join_by_size, small_side
from marlstone.session import materialise, release

SHINGLE = 3
#: A broadcast side has 8 or 16 bytes a row; beyond this many rows the join is a shuffled one.
BROADCAST_ROWS = 500_000


def _shingles(words: Column, k: int) -> Column:
    """A hash of the ``k`` words from each position on. Positions too near the end match nothing verified."""
    return F.transform(words, lambda w, i: F.xxhash64(F.lit(k), w, *[F.get(words, i + j) for j in range(1, k)]))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``wid, w (words), k, items``: every run of ``window`` words of an item; a shorter item is one window.

    Equal windows are one, with the ids of all their items in it; a null id is an item too.
    """
    words = items.select(F.col(id_col).cast("string").alias("item"), plain_words(F.col(text_col)).alias("ws")).filter("size(ws) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - window + 1, F.lit(1)))
    out = words.select("item", "ws", F.explode(starts).alias("at")).select("item", F.slice("ws", F.col("at"), F.lit(window)).alias("w"))
    # A set leaves nulls out, so ids travel in structs.
    out = out.groupBy("w").agg(F.collect_set(F.struct("item")).alias("items"))
    return out.select(F.monotonically_increasing_id().alias("wid"), "w", F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), "items")


def _known_positions(docs: DataFrame, known: DataFrame, ks: list[int]) -> DataFrame:
    """``__k1, __k2, n, pos, h``: where documents have a shingle of a window; the only pass over all texts' words."""
    words = docs.select("__k1", "__k2", plain_words(F.col("__text")).alias("ws")).filter(F.size("ws") > 0)
    made = None
    for k in ks:
        one = words.select("__k1", "__k2", F.size("ws").alias("n"), F.posexplode(_shingles(F.col("ws"), k)).alias("pos", "h"))
        made = one if made is None else made.unionByName(one)
    return made.join(known, "h", "left_semi")


def _candidates(docs: DataFrame, windows: DataFrame, ks: list[int]) -> DataFrame:
    """``__k1, __k2, cands``: per document the windows that may occur, with the words and the possible starts of each."""
    shingled = F.when(F.col("k") == 3, _shingles(F.col("w"), 3)).when(F.col("k") == 2, _shingles(F.col("w"), 2)).otherwise(_shingles(F.col("w"), 1))
    own = windows.select("wid", F.size("w").alias("size"), "k", F.posexplode(shingled).alias("p", "h")).filter(F.col("p") <= F.col("size") - F.col("k"))
    known = small_side(materialise(own.select("h").distinct()), BROADCAST_ROWS)
    hits = materialise(_known_positions(docs, known, ks))
    counts = hits.groupBy("h").agg(F.count("*").alias("c"))
    rarest = own.join(counts, "h", "left").groupBy("wid", "size").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "h", "p")).alias("r")).filter("r.c > 0")
    prefixes = materialise(rarest.groupBy("r.h", "r.c").agg(F.collect_list(F.struct("wid", "size", "r.p")).alias("ws")))
    found = join_by_size(hits, prefixes, ["h"], "c").select("__k1", "__k2", "n", "pos", F.inline("ws"))
    start = F.col("pos") - F.col("p")
    found = found.select("__k1", "__k2", "wid", "size", "n", start.alias("start")).filter((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n")))
    placed = materialise(found.groupBy("__k1", "__k2", "wid").agg(F.collect_set("start").alias("starts")))
    named = placed.groupBy("wid").agg(F.count("*").alias("docs")).join(windows, "wid").select("wid", "w", "items", "docs")
    out = materialise(join_by_size(placed, named, ["wid"], "docs").groupBy("__k1", "__k2").agg(F.collect_list(F.struct("w", "items", "starts")).alias("cands")))
    release(hits, prefixes, placed)
    return out


def _judged(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, hit_share: float) -> DataFrame:
    share = Fraction(str(hit_share))
    windows = materialise(item_windows(items, item_col, item_text_col, window))
    ks = sorted(r["k"] for r in windows.select("k").distinct().collect())  # at most SHINGLE values
    source = docs.select(F.col(id_col).alias("doc_id"), *row_key(id_col, text_col), F.col(text_col).alias("__text"))
    none = source.select("doc_id", "__k1", "__k2", F.coalesce(F.regexp_count("__text", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")), F.lit(0)).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    out = none
    if ks:
        candidates = _candidates(source, windows, ks)
        keys = small_side(candidates.select("__k1", "__k2"), BROADCAST_ROWS)
        words = source.join(keys, ["__k1", "__k2"], "left_semi").join(candidates, ["__k1", "__k2"]).select("doc_id", "__k1", "__k2", "cands", plain_words(F.col("__text")).alias("ws"))
        sure = F.filter(F.transform("cands", lambda c: F.struct(c["items"].alias("items"), F.size(c["w"]).alias("size"), F.filter(c["starts"], lambda s: F.slice("ws", s + 1, F.size(c["w"])) == c["w"]).alias("starts"))), lambda c: F.size(c["starts"]) > 0)
        words = words.withColumn("sure", sure)
        spans = F.array_sort(F.flatten(F.transform("sure", lambda c: F.transform(c["starts"], lambda s: F.struct(s.alias("s"), (s + c["size"]).alias("e"))))))
        covered = F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")), lambda a: a["n"])
        listed = F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform("sure", lambda c: c["items"])), lambda x: x["item"])))
        hit = words.select("doc_id", "__k1", "__k2", F.size("ws").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), listed.alias("items"))
        out = hit.unionByName(none.join(keys, ["__k1", "__k2"], "left_anti"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share.denominator * F.col("n_hit") >= share.numerator * F.col("n_words")))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, hit_share: float = 0.05) -> DataFrame:
    """``doc_id, n_words, n_hit, items (array), contaminated`` for every row of ``docs``.

    A window of an item is the set of its shingles. Shingles are ordered by rarity, counted over
    all documents; as containment must be whole, one shingle, the rarest, is a window's necessary
    prefix, and documents are joined on prefixes only. A candidate must start at or after the
    document's first word and end by its last (position and length bounds); then the words
    themselves are compared over the item-sized window, in documents that have a candidate. ``n_hit``
    counts document words inside any window found; ``contaminated`` means
    ``n_hit >= hit_share * n_words`` (``hit_share`` as the decimal fraction written) and more than none.

    Null and empty texts have no words. Null ids are kept; repeated rows are judged alike. An item
    without an id is an item: words in its windows are hit, and ``items`` ends with a null for it.
    Items without words take no part; without items nothing is contaminated; without documents there
    are no rows. A very long text is one array of words in its task, about ten times its size.
    """
    return _judged(docs, items, id_col, text_col, item_col, item_text_col, window, hit_share).drop("__k1", "__k2")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, hit_share: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, each judged by its own text.

    A row with a null id goes if its text is contaminated; a clean row stays though another of the
    same id goes. Null and empty texts stay. All columns stay as they are.
    """
    bad = _judged(docs, items, id_col, text_col, item_col, item_text_col, window, hit_share).filter("contaminated").select("__k1", "__k2").distinct()
    here = row_key(id_col, text_col)
    keyed = docs.select("*", here[0].alias("__j1"), here[1].alias("__j2"))
    gone = small_side(materialise(bad), BROADCAST_ROWS)
    return keyed.join(gone, (F.col("__j1") == F.col("__k1")) & (F.col("__j2") == F.col("__k2")), "left_anti").drop("__j1", "__j2")
