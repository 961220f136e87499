"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k takes lengths in (capacity/(k+1), capacity/k], and a bin of class k
holds exactly k pieces. Every task fills its own bins, so nothing is shuffled and no task waits for another. A length that
would waste more than ``max_waste`` of its class's bins is first cut at capacity//(k+1), the next class's exact share; what
remains is shorter than capacity/(k(k+1)), so a document is cut few times. Bins still open when a task ends are laid out as
one run and cut at the capacity; its last stretch is cut at powers of two, which need no padding.

Edge cases: a null or empty text is one piece holding only the end id; repeated rows are packed once for each row; a null id
stays null; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words whose ids a worker remembers, and the longest word remembered. Only speed depends on them.
REMEMBERED, LONGEST = 600_000, 48


class _Words(dict):
    """word -> packed little-endian ids of " " + word; words are encoded when first met."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        packed = np.array(self.encode(" " + word), "<u4").tobytes()
        if len(word) <= LONGEST:
            self[word] = packed
        return packed


class Encoder:
    """Byte-level BPE ids, equal to the ``tokenizers`` file's own.

    Byte-level BPE starts a new pre-token at any blank that is followed by a non-blank, so such a text is encoded word by word
    from a memory of words. Texts with other white space next to a blank, or with a special token's mark, go to ``tokenizers`` whole.
    ``ranks_path`` (the same vocabulary as ranks) speeds up new words; without it ``tokenizers`` encodes them too.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None, pattern: str | None):
        self.path, self._whole = tokenizer_path, None
        if ranks_path and pattern:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.piece = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            self.piece = self.whole
        self.words = _Words(self.piece)

    def whole(self, text: str) -> list[int]:
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray:
        first, *rest = text.split(" ")
        if "<|" in text or (rest and not all(map(len, rest))) or any(word[0].isspace() for word in rest if not word[0].isalnum()):
            return np.array(self.whole(text), "<u4")
        if len(self.words) > REMEMBERED:
            self.words.clear()
        return np.frombuffer(np.array(self.piece(first), "<u4").tobytes() + b"".join(map(self.words.__getitem__, rest)), "<u4")


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(*key) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def harmonic_cuts(length: int, capacity: int, max_waste: float) -> list[tuple[int, int]]:
    """(piece length, class) of a document of ``length`` tokens, in order."""
    pieces = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if k * rest >= capacity * (1 - max_waste):
            pieces.append((rest, k))
            break
        share = capacity // (k + 1)
        pieces.append((share, capacity // share))
        rest -= share
    return pieces


class Bins:
    """One task's open bins. ``add`` and ``close`` yield rows of SCHEMA."""

    def __init__(self, capacity: int, max_waste: float, first_id: int):
        self.capacity, self.max_waste, self.next_id = capacity, max_waste, first_id
        self.open: dict[int, list] = {}

    def _laid(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids), zlib.crc32(ids), total, self.next_id, offset
            offset += len(ids)
        self.next_id += 1

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        for length, k in harmonic_cuts(len(ids), self.capacity, self.max_waste):
            held = self.open.setdefault(k, [])
            held.append((doc_id, start, ids[start : start + length].copy(), len(ids)))
            start += length
            if len(held) == k:
                yield from self._laid(self.open.pop(k))

    def close(self) -> Iterator[tuple]:
        run = [piece for k in sorted(self.open) for piece in self.open[k]]
        left = sum(len(piece[2]) for piece in run)
        room, held = self._room(left), []
        for doc_id, start, ids, total in run:
            while len(ids):
                part, ids = ids[:room], ids[room:]
                held.append((doc_id, start, part, total))
                start, room, left = start + len(part), room - len(part), left - len(part)
                if not room:
                    yield from self._laid(held)
                    room, held = self._room(left), []
        self.open = {}

    def _room(self, left: int) -> int:
        return self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1) if left else 0


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, max_waste: float = 1 / 64, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Pack every document's ids, then ``end_id``, into sequences of at most ``capacity`` ids. Returns SCHEMA, a row for each piece."""
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in zip(*rows, strict=True)], names=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, bins, rows = encoder(tokenizer_path, ranks_path, pattern), Bins(capacity, max_waste, TaskContext.get().partitionId() << 32), []
        end = np.array([end_id], "<u4")
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows.extend(bins.add(doc_id, np.concatenate([ids_of(text.as_py() or ""), end])))
                if len(rows) >= 20_000:
                    yield table(rows)
                    rows = []
        rows.extend(bins.close())
        if rows:
            yield table(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
