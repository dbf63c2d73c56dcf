"""Operator 4: language identification by compression with per-language zstandard dictionaries."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import map_rows

UNKNOWN = "und"


@dataclass(frozen=True)
class Dictionaries:
    """Raw dictionary contents by language. They are small (``dict_bytes`` each) and travel with the tasks."""

    content: dict[str, bytes]
    window: int = 2048
    level: int = 3
    min_margin: float = 0.01


#: Pieces of a long text that a dictionary may hold, and the order in which they are taken: any first few lie all over it.
PIECE, ORDER = 256, (0, 4, 2, 6, 1, 5, 3, 7)


def _allowance(sizes: list[int], budget: int) -> int:
    """How many bytes each text may give so that all together fill ``budget``, short ones giving all they have."""
    left = budget
    for i, size in enumerate(sorted(sizes)):
        share = left // (len(sizes) - i)
        if size > share:
            return share
        left -= size
    return max(sizes, default=0)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 96, dict_bytes: int = 98304, **options) -> Dictionaries:
    """Dictionaries from a bounded sample: about ``docs_per_lang`` texts of each language.

    Only rows with an id, a text and a language take part; the caller removes what may not be
    learnt from. The sample is picked by a hash of the id, so reruns agree. Every language is
    learnt; all its sampled texts share ``dict_bytes`` evenly, each giving pieces from all over it.
    The driver holds 2 KB of each sampled text. An empty table gives no languages, and every
    prediction is then ``und``.
    """
    usable = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).filter("i is not null and l is not null and length(t) > 0")
    counts = {r["l"]: r["n"] for r in usable.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Dictionaries({}, **options)
    spread = 1 << 30
    pick = F.pmod(F.xxhash64("i"), F.lit(spread))
    shares = usable.sparkSession.createDataFrame([(k, min(spread, math.ceil(spread * docs_per_lang / n))) for k, n in counts.items()], "l string, share long")
    size = F.char_length("t")
    step = (size - PIECE) / (len(ORDER) - 1)
    pieces = F.concat_ws("\n", *[F.substring(F.col("t"), (F.floor(i * step) + 1).cast("int"), F.lit(PIECE)) for i in ORDER])
    part = F.when(size <= PIECE * len(ORDER), F.col("t")).otherwise(pieces)
    rows = usable.join(F.broadcast(shares), "l").filter(pick < F.col("share")).select("l", pick.alias("p"), part.alias("t"), "i").collect()
    texts: dict[str, list[bytes]] = {lang: [] for lang in sorted(counts)}
    for r in sorted(rows, key=lambda r: (r["p"], str(r["i"]), r["t"])):
        texts[r["l"]].append(r["t"].encode("utf-8", "replace"))
    content = {k: b"\n".join([t[: _allowance([len(x) for x in v], dict_bytes)] for t in v]) for k, v in texts.items() if v}
    return Dictionaries(content, **options)


def _sizer(model: Dictionaries):
    import zstandard

    made = []
    for lang, content in sorted(model.content.items()):
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=model.level)
        made.append((lang, zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False)))

    def sizes(text: str) -> list[tuple[int, str]]:
        raw = text.encode("utf-8", "replace")
        parts = [raw[i : i + model.window] for i in range(0, len(raw), model.window)]
        return sorted((sum(len(c.compress(p)) for p in parts), lang) for lang, c in made)

    return sizes


def predict(df: DataFrame, model: Dictionaries, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, lang_pred, score, margin, rejected``.

    The whole text is encoded window by window with each language's dictionary; the smallest sum
    wins, ties go to the first language by name. ``rejected`` marks margins under
    ``min_margin`` of the runner-up's size; a caller that wants no guess there reads it. A null
    text, or one without a letter, is ``und`` with score 0. Rows are independent; other
    columns are not read.
    """
    cell: list = []

    def run(ids: list, texts: list) -> list:
        if not cell:
            cell.append(_sizer(model))
        out = []
        for t in texts:
            ranked = cell[0](t) if t and any(c.isalpha() for c in t) else []
            if not ranked:
                out.append((UNKNOWN, 0.0, 0.0, True))
                continue
            best = ranked[0][0]
            margin = (ranked[1][0] - best) / ranked[1][0] if len(ranked) > 1 else 1.0
            score = 1.0 / sum(math.exp((best - s) / (0.01 * best)) for s, _ in ranked)
            out.append((ranked[0][1], score, margin, margin < model.min_margin))
        return [ids, *([r[i] for r in out] for i in range(4))]

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df, [id_col, text_col], run, f"doc_id {kind}, lang_pred string, score double, margin double, rejected boolean")
