"""Operator 6: substring dedup by content-defined chunking with a gear rolling hash."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import map_rows
from marlstone.operators.joins import join_by_size
from marlstone.session import materialise, release

_GEAR = np.random.default_rng(97).integers(0, 2**16, 256, dtype=np.uint16)
_END = np.uint16(65535)


@dataclass(frozen=True)
class Chunking:
    """Cuts behind the byte whose rolling hash is the least of the ``reach`` hashes on either side.

    The 16-bit hash covers the last 16 bytes and nothing else moves a cut, so equal passages are cut
    alike from 16 + ``reach`` bytes in, whatever was inserted before them. Chunks have more than
    ``reach`` bytes, about 47 on average; where a text repeats within that distance no hash is the
    least, and the least one in ``most`` bytes (255 at most) cuts. A run of repeated chunks is
    extended by up to ``edge`` bytes on either side, which covers the 16 + ``reach`` bytes that a
    passage's surroundings reach into it and one whole chunk behind them; passages under ``min_run``
    bytes are not reported.
    """

    reach: int = 23
    most: int = 144
    edge: int = 192
    min_run: int = 200


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """The gear hash behind every byte: h = 2h + gear[byte] mod 2^16, by doubling the span four times."""
    h = _GEAR[raw]
    for span in (1, 2, 4, 8):
        more = h.copy()
        more[span:] += h[:-span] << np.uint16(span)
        h = more
    return h


def _least_ahead(h: np.ndarray, reach: int) -> np.ndarray:
    """The least of the ``reach`` values behind each place; nothing is less than the end."""
    low, span = np.append(h[1:], _END), 1
    while span < reach:
        step = min(span, reach - span)
        low[:-step] = np.minimum(low[:-step], low[step:])
        span += step
    return low


def cut_points(raw: np.ndarray, c: Chunking) -> np.ndarray:
    """Ends of the chunks of ``raw``, the last one its length. A cut never splits a UTF-8 character."""
    h = gear_hash(raw) >> np.uint16(1)
    h[:-1][(raw[1:] & 0xC0) == 0x80] = _END
    ahead, behind = _least_ahead(h, c.reach), _least_ahead(h[::-1], c.reach)[::-1]
    marks = np.flatnonzero((h < behind) & (h <= ahead)) + 1
    ends, last = [], 0
    for m in [*marks.tolist(), raw.size]:
        while m - last > c.most:
            near = slice(last + c.reach, last + c.most)
            last = near.start + 1 + int(h[near].argmin())
            ends.append(last)
        if m > last:
            ends.append(m)
            last = m
    return np.array(ends, np.int64)


def chunk(text: str | None, c: Chunking) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests, tags, starts and shifts of a text's chunks.

    A tag has 16 further bits of the digest, the code points and the bytes of the chunk. A start is
    in bytes; a shift is twice what to take from it to get code points, one more for the last chunk.
    """
    import xxhash

    data = (text or "").encode("utf-8", "replace")
    raw = np.frombuffer(data, np.uint8)
    if not raw.size:
        return (np.empty(0, np.int64),) * 4
    ends = cut_points(raw, c)
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
    wide = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]), ">u8").astype(np.uint64).reshape(-1, 2)
    points = np.add.reduceat(((raw & 0xC0) != 0x80).astype(np.int64), starts)
    tags = (wide[:, 0] & np.uint64(0x7FFF)).astype(np.int64) << 16 | points << 8 | (ends - starts)
    shifts = 2 * (starts - np.concatenate((np.zeros(1, np.int64), np.cumsum(points)[:-1])))
    shifts[-1] += 1
    return wide[:, 1].view(np.int64), tags, starts, shifts


def chunks(df: DataFrame, id_col: str, text_col: str, c: Chunking) -> DataFrame:
    """``doc_id, k, digests, tags, starts, shifts``: a row per document; ``k`` stands for its id and text."""

    def run(ids: list, keys: list, texts: list) -> list:
        made = [chunk(t, c) for t in texts]
        kinds = (np.int64, np.int32, np.int32, np.int32)
        return [ids, keys, *[pa.array([m[i].astype(t) for m in made], pa.list_(pa.from_numpy_dtype(t))) for i, t in enumerate(kinds)]]

    source = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("k"), F.col(text_col).alias("text"))
    return map_rows(source, ["doc_id", "k", "text"], run, f"doc_id {df.schema[id_col].dataType.simpleString()}, k long, digests array<long>, tags array<int>, starts array<int>, shifts array<int>")


def _hits(cut: DataFrame) -> DataFrame:
    """``doc_id, k, hits``: a document's chunks that several ids hold, each with the first of these ids."""
    every = cut.select("doc_id", F.inline(F.arrays_zip(F.col("digests").alias("digest"), F.col("tags").alias("tag"))))
    seen = every.groupBy("digest", "tag").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    repeated = materialise(seen.filter("first <> last").select("digest", "tag", "first", "n"))
    placed = cut.select("doc_id", "k", F.inline(F.arrays_zip(F.col("digests").alias("digest"), F.col("tags").alias("tag"), F.col("starts").alias("s"), F.col("shifts").alias("shift"))))
    found = join_by_size(placed, repeated, ["digest", "tag"], least=5000)
    return materialise(found.groupBy("doc_id", "k").agg(F.collect_set(F.struct("s", "digest", "tag", "shift", "first")).alias("hits")))


def _passages(hits: DataFrame) -> DataFrame:
    """``doc_id, k, parts``: runs of neighbouring hits, in parts that have the same first document."""

    def run(ids: list, keys: list, found: list) -> list:
        out = []
        for hit in found:
            parts: list[dict] = []
            for h in sorted(hit, key=lambda h: h["s"]):
                size, points = h["tag"] & 255, h["tag"] >> 8 & 255
                at = h["s"] - (h["shift"] >> 1)
                if parts and parts[-1]["hi"] == h["s"] and parts[-1]["first"] == h["first"]:
                    p = parts[-1]
                    p["hi"], p["to"], p["n"] = h["s"] + size, at + points, p["n"] + 1
                else:
                    p = {"lo": h["s"], "hi": h["s"] + size, "at": at, "to": at + points, "n": 1, "first": h["first"], "left": h["s"] > 0, "d0": h["digest"], "t0": h["tag"]}
                    parts.append(p)
                p["d1"], p["t1"], p["right"] = h["digest"], h["tag"], not h["shift"] & 1
            out.append(parts)
        return [ids, keys, out]

    kind = hits.schema["doc_id"].dataType.simpleString()
    part = f"struct<lo:int,hi:int,at:int,to:int,n:int,first:{kind},left:boolean,right:boolean,d0:long,t0:int,d1:long,t1:int>"
    return materialise(map_rows(hits, ["doc_id", "k", "hits"], run, f"doc_id {kind}, k long, parts array<{part}>"))


def _edges(passages: DataFrame) -> DataFrame:
    """``doc_id, k, first, side, at, digest, tag``: where a part ends inside its text, beside another part or not; side -1 is its left end."""
    p = F.col("p")
    ends = F.array(F.struct(F.lit(-1).alias("side"), p["left"].alias("open"), p["lo"].alias("at"), p["d0"].alias("digest"), p["t0"].alias("tag")), F.struct(F.lit(1).alias("side"), p["right"].alias("open"), p["hi"].alias("at"), p["d1"].alias("digest"), p["t1"].alias("tag")))
    rows = passages.select("doc_id", "k", F.explode("parts").alias("p")).select("doc_id", "k", p["first"].alias("first"), F.explode(ends).alias("e"))
    return rows.filter("e.open").select("doc_id", "k", "first", "e.side", "e.at", "e.digest", "e.tag")


def _common(a: bytes, b: bytes, side: int) -> int:
    """How many bytes ``a`` and ``b`` agree, from their start or, for side -1, from their end, in whole characters of ``a``."""
    if side < 0:
        a, b = a[::-1], b[::-1]
    n = most = min(len(a), len(b))
    if a[:most] != b[:most]:
        x, y = (np.frombuffer(v[:most], np.uint8) for v in (a, b))
        n = int((x != y).argmax())
    if side > 0:
        while n and n < len(a) and a[n] & 0xC0 == 0x80:
            n -= 1
    else:
        while n and a[n - 1] & 0xC0 == 0x80:
            n -= 1
    return n


def _extensions(passages: DataFrame, hits: DataFrame, texts: DataFrame, c: Chunking) -> DataFrame:
    """``doc_id, k, side, at, bytes, points``: how much further the text at an edge agrees with the first document's.

    Only the ``edge`` bytes beside an edge are compared: those of every edge, and those beside the
    same chunk in its first document. An edge in that document gets the longest agreement that
    others have with it.
    """
    edges = _edges(passages)
    sought = edges.filter("first <> doc_id")
    wanted = sought.select("digest", "tag", "side").distinct()
    h = F.col("h")
    owned = hits.select("doc_id", "k", F.explode("hits").alias("h")).filter(h["first"] == F.col("doc_id")).groupBy(h["digest"].alias("digest"), h["tag"].alias("tag")).agg(F.min(F.struct(F.col("doc_id"), F.col("k"), h["s"].alias("s"))).alias("o"))
    place = F.when(F.col("side") < 0, F.col("o.s")).otherwise(F.col("o.s") + F.col("tag").bitwiseAND(F.lit(255)))
    origins = wanted.join(owned, ["digest", "tag"]).select("o.doc_id", "o.k", "side", place.alias("at"), "digest", "tag", F.lit(True).alias("origin"))
    asked = sought.select("doc_id", "k", "side", "at", "digest", "tag", F.lit(False).alias("origin")).unionByName(origins)
    by_doc = asked.groupBy("doc_id", "k").agg(F.collect_set(F.struct("side", "at", "digest", "tag", "origin")).alias("asked"))

    def look(ids: list, keys: list, asked: list, values: list) -> list:
        out: list[list] = [[] for _ in range(8)]
        for doc, k, ask, text in zip(ids, keys, asked, values):
            data = text.encode("utf-8", "replace")
            for a in ask:
                lo, hi = (max(0, a["at"] - c.edge), a["at"]) if a["side"] < 0 else (a["at"], min(len(data), a["at"] + c.edge))
                while lo < hi and data[lo] & 0xC0 == 0x80:
                    lo += 1
                while lo < hi < len(data) and data[hi] & 0xC0 == 0x80:
                    hi -= 1
                for column, value in zip(out, (doc, k, a["side"], a["at"], a["digest"], a["tag"], a["origin"], data[lo:hi])):
                    column.append(value)
        return out

    kind = passages.schema["doc_id"].dataType.simpleString()
    near = materialise(map_rows(by_doc.join(texts, ["doc_id", "k"]), ["doc_id", "k", "asked", "text"], look, f"doc_id {kind}, k long, side int, at int, digest long, tag int, origin boolean, beside binary"))
    mine = near.filter("not origin").drop("origin").distinct()
    counts = mine.groupBy("digest", "tag", "side").agg(F.count("*").alias("n"))
    theirs = near.filter("origin").select("digest", "tag", "side", F.col("k").alias("fk"), F.col("at").alias("fat"), F.col("beside").alias("other")).dropDuplicates(["digest", "tag", "side"])
    theirs = materialise(theirs.join(counts, ["digest", "tag", "side"]))

    def compare(*columns: list) -> list:
        agree = [_common(a, b, s) for a, b, s in zip(columns[-2], columns[-1], columns[2])]
        points = [sum(x & 0xC0 != 0x80 for x in (a[:n] if s > 0 else a[len(a) - n :])) for a, n, s in zip(columns[-2], agree, columns[2])]
        return [*columns[:-2], agree, points]

    pairs = join_by_size(mine, theirs, ["digest", "tag", "side"])
    carried = ["doc_id", "k", "side", "at", "digest", "tag", "fk", "fat"]
    found = materialise(map_rows(pairs, [*carried, "beside", "other"], compare, f"doc_id {kind}, k long, side int, at int, digest long, tag int, fk long, fat int, bytes int, points int"))
    best = found.groupBy("digest", "tag", "side", "fk", "fat").agg(F.max(F.struct("bytes", "points")).alias("b"))
    kept = edges.filter("first = doc_id").join(best.withColumnsRenamed({"fk": "k", "fat": "at"}), ["digest", "tag", "side", "k", "at"]).select("doc_id", "k", "side", "at", "b.bytes", "b.points")
    release(near, theirs)
    return found.select("doc_id", "k", "side", "at", "bytes", "points").unionByName(kept)


def _by_earliest(parts: list[dict], least: int) -> list[tuple]:
    """Parts that overlap, cut so that every byte goes to the earliest document that holds it.

    Gives ``(lo, hi, at, to, n, first)`` in order. What is left of a part between others holds no
    chunk if it has fewer than ``least`` bytes, and goes.
    """
    points = {p["lo"]: p["at"] for p in parts} | {p["hi"]: p["to"] for p in parts}
    marks = sorted(points)
    waiting = sorted(parts, key=lambda p: -p["lo"])
    live: list[tuple] = []
    out: list[list] = []
    counted: set[int] = set()
    for lo, hi in zip(marks, marks[1:]):
        while waiting and waiting[-1]["lo"] <= lo:
            p = waiting.pop()
            heapq.heappush(live, (p["first"], p["lo"], p["hi"], id(p), p["n"]))
        while live and live[0][2] <= lo:
            heapq.heappop(live)
        if not live:
            continue
        first, _, _, part, n = live[0]
        n = 0 if part in counted else n
        counted.add(part)
        if out and out[-1][1] == lo and out[-1][5] == first:
            out[-1][1], out[-1][3], out[-1][4] = hi, points[hi], out[-1][4] + n
        else:
            out.append([lo, hi, points[lo], points[hi], n, first])
    return [tuple(o) for o in out if o[1] - o[0] >= least]


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunking: Chunking | None = None) -> DataFrame:
    """``doc_id, k, start, end, n_chunks, n_bytes, first_doc_id, kept``: passages that other documents share.

    A chunk repeats if its digest (80 bits, with its size) occurs under several ids. Neighbouring
    repeated chunks with one first document, the one of the least id that holds them, form a part,
    extended at both ends by comparing bytes with that document, across its neighbours too: texts
    are cut differently near the ends of what they share, so a chunk there may be known to later
    documents only, though an earlier one holds its bytes. Every byte goes to the earliest document
    of the parts over it, and each stretch with one such document is a row. ``start`` and ``end``
    (exclusive) are code points. Stretches that touch count together towards ``min_run`` bytes;
    longer ones are reported whole. ``kept`` marks what the document itself holds first, the copy
    that stays.

    Only repeats in different documents count, not those inside one. Null and empty texts have no
    chunks; rows with a null id are left out; repeated rows (same id and text) count as one
    document; an empty table gives no rows. A very long text costs its worker about ten times its size.
    """
    c = chunking or Chunking()
    known = df.filter(F.col(id_col).isNotNull())
    cut = materialise(chunks(known, id_col, text_col, c))
    hits = _hits(cut)
    release(cut)
    passages = _passages(hits)
    texts = known.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("k"), F.col(text_col).alias("text"))
    further = _extensions(passages, hits, texts, c).groupBy("doc_id", "k").agg(F.collect_set(F.struct("side", "at", "bytes", "points")).alias("further"))

    def report(ids: list, keys: list, found: list, more: list) -> list:
        out: list[list] = [[] for _ in range(8)]
        for doc, k, parts, ext in zip(ids, keys, found, more):
            reach = {(e["side"], e["at"]): e for e in ext or []}
            for p in parts:
                left, right = reach.get((-1, p["lo"])), reach.get((1, p["hi"]))
                if left:
                    p["lo"], p["at"] = p["lo"] - left["bytes"], p["at"] - left["points"]
                if right:
                    p["hi"], p["to"] = p["hi"] + right["bytes"], p["to"] + right["points"]
            runs: list[list[tuple]] = []
            for q in _by_earliest(parts, c.reach):
                if runs and runs[-1][-1][1] == q[0]:
                    runs[-1].append(q)
                else:
                    runs.append([q])
            for run_ in runs:
                if run_[-1][1] - run_[0][0] >= c.min_run:
                    for lo, hi, at, to, n, first in run_:
                        for column, value in zip(out, (doc, k, at, to, n, hi - lo, first, first == doc)):
                            column.append(value)
        return out

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(passages.join(further, ["doc_id", "k"], "left"), ["doc_id", "k", "parts", "further"], report, f"doc_id {kind}, k long, start long, end long, n_chunks long, n_bytes long, first_doc_id {kind}, kept boolean")


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunking: Chunking | None = None) -> DataFrame:
    """``df`` with every passage that an earlier document already has taken out of the text.

    Rows without such a passage, with a null id or a null text stay as they are; all columns and all
    rows stay, repeated rows are treated alike, and an empty table gives an empty one.
    """
    gone = repeated_spans(df, id_col, text_col, chunking).filter("not kept")
    spans = gone.groupBy("doc_id", "k").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__spans")).select(F.col("doc_id").alias("__id"), F.col("k").alias("__k"), "__spans")
    joined = df.join(spans, (F.col(id_col) == F.col("__id")) & (F.xxhash64(id_col, text_col) == F.col("__k")), "left")
    text = F.col(text_col)
    fold = F.aggregate("__spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), lambda a, s: F.struct(F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))).alias("out"), F.greatest(a["at"], s["end"]).alias("at")), lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.char_length(text))))
    cleaned = F.when(F.col("__spans").isNull(), text).otherwise(fold)
    return joined.select(*[cleaned.alias(c) if c == text_col else F.col(c) for c in df.columns])
