"""Operator 11: byte-level BPE encoding and decoding by a contiguous rank array per word."""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters and numbers that Unicode got after version 16. The tokenizers library
#: takes them as neither, the regex module as what they are now.
LATE_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
LATE_NUMBERS = ((0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6))

#: Fixed value: the split of a text into pieces; L and N stand for the letter and number classes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\sLN]+|\s+(?!\S)|\s+"

_NO_RANK = 1 << 31
#: Words of more bytes than this are merged from a heap: a scan per merge would be quadratic.
LONG = 128
#: A worker keeps the ids of up to twice this many pieces, none longer than so many characters.
CACHED, CACHED_CHARS = 150_000, 64


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary file: itself if it prints, else the next one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)) - set(prints))
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizer(dict):
    """A byte-level BPE vocabulary; as a mapping it gives the ids of a piece of text, four bytes each, and keeps those of common pieces.

    ``merges`` has the rank of a merge by the ids of its left and its right part, ``made`` the id
    that each rank makes, ``byte_ids`` the id of each byte, ``tokens`` the bytes of each id, and
    ``special`` the ids of the special tokens by their text.
    """

    def __init__(self, vocab: dict[str, int], merges: list, special: dict[str, int]):
        alphabet = byte_alphabet()
        self.merges: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]
        for rank, (a, b) in enumerate(merges):
            self.merges[vocab[a]][vocab[b]] = rank
        self.made = [vocab[a + b] for a, b in merges]
        self.byte_ids = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.tokens = {i: bytes(map(alphabet.__getitem__, t)) for t, i in vocab.items() if t not in special} | {i: t.encode() for t, i in special.items()}
        self.special = special
        self._compile()

    def _compile(self) -> None:
        import regex

        def ranges(pairs: tuple) -> str:
            return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in pairs) + "]"

        plain = SPLIT.replace("[^\\sLN]", "[^\\s\\p{L}\\p{N}]").replace("L+", "\\p{L}+").replace("N+", "\\p{N}+")
        letters, numbers = f"[\\p{{L}}--{ranges(LATE_LETTERS)}]", f"[\\p{{N}}--{ranges(LATE_NUMBERS)}]"
        exact = SPLIT.replace("[^\\sLN]", f"(?:(?!\\s|{letters}|{numbers})[\\s\\S])").replace("L+", f"{letters}+").replace("N+", f"{numbers}+")
        self._plain, self._exact = regex.compile(plain), regex.compile(exact, regex.V1)
        self._ascii = re.compile(SPLIT.replace("\\sLN", "\\sA-Za-z0-9").replace("L+", "[A-Za-z]+").replace("N+", "[0-9]+"), re.ASCII)
        self._late = regex.compile(ranges(LATE_LETTERS + LATE_NUMBERS))
        self._high = regex.compile(f"[{chr(LATE_LETTERS[0][0])}-\U0010ffff]")
        self._marks = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        self._older: dict[str, bytes] = {}
        # All tokens' bytes in one row, with the place and length of each; the last entry, of none, is for unknown ids.
        sizes = np.zeros(max(self.tokens) + 2, np.int64)
        for i, t in self.tokens.items():
            sizes[i] = len(t)
        self._sizes, self._places = sizes, np.cumsum(sizes) - sizes
        self._bytes = np.frombuffer(b"".join(t for _, t in sorted(self.tokens.items())), np.uint8)

    def __reduce__(self):
        return _restore, ({k: v for k, v in self.__dict__.items() if not k.startswith("_")},)

    def pieces(self, text: str) -> list[str]:
        """The pieces within which parts are merged; a special token is no piece."""
        if text.isascii():
            return self._ascii.findall(text)
        late = self._high.search(text) and self._late.search(text)
        return (self._exact if late else self._plain).findall(text)

    def __missing__(self, piece: str) -> bytes:
        found = self._older.get(piece)
        if found is None:
            parts = [self.byte_ids[b] for b in piece.encode("utf-8", "replace")]
            found = array("i", self._scan(parts) if len(parts) <= LONG else self._heap(parts)).tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self._older = dict(self)
                self.clear()
            self[piece] = found
        return found

    def _scan(self, parts: list[int]) -> list[int]:
        """Merge a short word in two contiguous arrays: its parts, one per boundary, and the ranks of adjacent parts.

        The least rank is sought by a scan; taking it deletes a boundary and renews the two ranks beside it.
        """
        merges, made = self.merges, self.made
        near = [merges[a].get(b, _NO_RANK) for a, b in zip(parts, parts[1:])]
        while near:
            best = min(near)
            if best == _NO_RANK:
                break
            i = near.index(best)
            parts[i] = here = made[best]
            del parts[i + 1], near[i]
            if i:
                near[i - 1] = merges[parts[i - 1]].get(here, _NO_RANK)
            if i < len(near):
                near[i] = merges[here].get(parts[i + 1], _NO_RANK)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        """The same merges for a long word: the least rank comes from a heap, parts are linked both ways."""
        n, merges, made = len(parts), self.merges, self.made
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        heap = [(r << 32) + i for i in range(n - 1) if (r := merges[parts[i]].get(parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            best, at = divmod(heapq.heappop(heap), 1 << 32)
            mid = after[at]
            # A part that was merged away is -1; a pair that has changed since has another rank or none.
            if parts[at] < 0 or mid >= n or merges[parts[at]].get(parts[mid]) != best:
                continue
            parts[at], parts[mid] = made[best], -1
            end = after[at] = after[mid]
            if end < n:
                before[end] = at
            for left, right in ((before[at], at), (at, end)):
                if left >= 0 and right < n and (r := merges[parts[left]].get(parts[right])) is not None:
                    heapq.heappush(heap, (r << 32) + left)
        return [p for p in parts if p >= 0]

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids of a text, four bytes each. Special tokens count wherever their text stands."""
        if not text:
            return b""
        if not any(t in text for t in self.special):
            return b"".join(map(self.__getitem__, self.pieces(text)))
        parts = self._marks.split(text)
        return b"".join(b"".join(map(self.__getitem__, self.pieces(p))) if i % 2 == 0 else array("i", [self.special[p]]).tobytes() for i, p in enumerate(parts))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def decode_bytes(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of many texts' ids in one row, and where each text ends in it; ``ends`` are in ids."""
        ids = np.where((ids < 0) | (ids >= self._sizes.size), self._sizes.size - 1, ids)
        sizes = self._sizes[ids]
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
        places = np.repeat(self._places[ids] - upto[:-1], sizes)
        places += np.arange(places.size)
        return self._bytes[places].tobytes(), upto[ends]

    def decode(self, ids: list[int] | None) -> str:
        """The text of the ids; unknown ids give nothing, bytes that are no UTF-8 the replacement character."""
        made = np.array(ids or [], np.int64)
        return self.decode_bytes(made, np.array([made.size]))[0].decode("utf-8", "replace")


def _restore(state: dict) -> Tokenizer:
    made = Tokenizer.__new__(Tokenizer)
    made.__dict__.update(state)
    made._compile()
    return made


def load_tokenizer(path: str) -> Tokenizer:
    """Read a byte-level BPE ``tokenizer.json``, a file of a few MB, on the driver.

    Raises ValueError for what is not built: normalizers, other pre-tokenizers, dropout, or added
    tokens that strip or match whole words only.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or spec.get("normalizer") or any(split.get(k) != v for k, v in plain.items()):
        raise ValueError(f"{path} is no plain byte-level BPE")
    added = spec.get("added_tokens") or []
    if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
        raise ValueError(f"{path} has added tokens with rules of their own")
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return Tokenizer(model["vocab"], merges, {t["content"]: t["id"] for t in added})


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``most`` bytes, so that a worker's memory stays bounded; a row is never cut."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def encode(df: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: a row per row of ``df`` with the token ids of its whole text.

    The vocabulary is broadcast (its size is fixed); texts stay in their partitions. Null and empty
    texts have no ids; null ids of rows and repeated rows are allowed; other columns of any name are
    not read; an empty table gives an empty one. A very long text is one array in its task.
    """
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 4 << 20):
            found = [shared.value.encode_bytes(t) for t in part.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int64) // 4
            flat = pa.array(np.frombuffer(b"".join(found), np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)], names=["doc_id", "ids"])

    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, ids, text``: a row per row of ``df`` with the text of its token ids.

    Ids that the vocabulary lacks, or null ones, give nothing, a null array the empty text.
    Otherwise as :func:`encode`.
    """
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 4 << 20):
            ids = part.column(1)
            ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            data, upto = shared.value.decode_bytes(ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False), ends)
            starts = np.concatenate((np.zeros(1, np.int64), upto))
            texts = pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(starts), pa.py_buffer(data))
            try:
                texts.validate(full=True)
                texts = texts.cast(pa.string())
            except pa.ArrowInvalid:  # ids that cut a character
                texts = pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(starts, starts[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), ids, texts], names=["doc_id", "ids", "text"])

    source = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return source.mapInArrow(run, f"doc_id {df.schema[id_col].dataType.simpleString()}, ids array<int>, text string")
