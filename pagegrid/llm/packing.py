"""Sum-of-squares online packing of token sequences into windows.

Each input partition is one stream. A document's ids and the closing id are cut into whole
windows and a rest; the rest goes on the fill level for which the sum over all levels of the
squared number of windows at that level becomes least (level 0 opens a window). Only a level
array and the windows still open are kept. At the end of the stream the open windows are
topped up with pieces cut from the emptiest ones, so at most one stays partly filled; it is
cut into sequences whose lengths are powers of two, which need no padding.

Defined cases: null text is the empty text, whose only id is the closing one. Repeated rows
are packed each on its own. An empty table gives no rows. Other columns are ignored. Which
documents share a window depends on the input's partitions, the padding hardly does.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrid.llm.bpe import codec, definition_of
from pagegrid.llm.common import text_of

WINDOW = 4096
CLOSING_ID = 2
#: Windows kept open by one stream; beyond, they are topped up as at its end.
MOST_OPEN = 2048
ROWS = 4096
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)
#: doc_id, start, ids as little-endian uint32 bytes, tokens of the document.
Piece = tuple[int | None, int, bytes, int]


class Packer:
    """One stream of documents; ``done`` holds the rows of windows that are closed."""

    def __init__(self, window: int, first_id: int) -> None:
        self.window, self.next_id = window, first_id
        self.counts = np.zeros(window + 1, np.int64)
        self.levels: dict[int, list[list[Piece]]] = {}
        self.open = 0
        self.done: list[tuple] = []

    def close(self, pieces: list[Piece]) -> None:
        offset = 0
        for doc_id, start, code, tokens in pieces:
            length = len(code) // 4
            self.done.append(
                (doc_id, start, length, zlib.crc32(code), tokens, self.next_id, offset)
            )
            offset += length
        self.next_id += 1

    def add(self, doc_id: int | None, code: bytes) -> None:
        tokens, width = len(code) // 4, 4 * self.window
        whole = len(code) - len(code) % width
        for at in range(0, whole, width):
            self.close([(doc_id, at // 4, code[at : at + width], tokens)])
        if rest := code[whole:]:
            self.place((doc_id, whole // 4, rest, tokens))

    def place(self, piece: Piece) -> None:
        size = len(piece[2]) // 4
        before = self.counts[: self.window - size + 1]
        after = self.counts[size:]
        # (n + 1)**2 - n**2 where the window arrives, (n - 1)**2 - n**2 where it leaves;
        # a new window leaves no level, a full one arrives at none that counts.
        arrives, leaves = 2 * after + 1, 1 - 2 * before
        arrives[-1], leaves[0] = 0, 0
        change = arrives + leaves
        change[1:][before[1:] == 0] = np.iinfo(np.int64).max
        level = int(np.argmin(change))
        pieces = self.take(level) if level else []
        self.put([*pieces, piece], level + size)
        if self.open > MOST_OPEN:
            self.top_up()

    def take(self, level: int) -> list[Piece]:
        self.counts[level] -= 1
        self.open -= 1
        return self.levels[level].pop()

    def put(self, pieces: list[Piece], level: int) -> None:
        if level == self.window:
            self.close(pieces)
        elif level:
            self.counts[level] += 1
            self.open += 1
            self.levels.setdefault(level, []).append(pieces)

    def top_up(self) -> None:
        """Fill the fullest open windows with pieces cut from the emptiest."""
        bins = [x for level in sorted(self.levels) for x in self.levels[level]]
        self.levels, self.open = {}, 0
        self.counts[:] = 0
        low, spare = 0, []
        for high in range(len(bins) - 1, -1, -1):
            pieces, room = bins[high], self.window - sum(len(p[2]) // 4 for p in bins[high])
            while room and (spare or low < high):
                if not spare:
                    spare, low = bins[low], low + 1
                doc_id, start, code, tokens = spare.pop()
                size = min(room, len(code) // 4)
                pieces.append((doc_id, start, code[: 4 * size], tokens))
                if code := code[4 * size :]:
                    spare.append((doc_id, start + size, code, tokens))
                room -= size
            if high < low:
                break
            self.put(pieces, self.window - room)
        if spare:
            self.put(spare, sum(len(p[2]) // 4 for p in spare))

    def finish(self) -> None:
        self.top_up()
        for level in list(self.levels):
            for pieces in self.levels.pop(level):
                self.close_in_powers(pieces, level)

    def close_in_powers(self, pieces: list[Piece], level: int) -> None:
        for power in (1 << k for k in range(level.bit_length() - 1, -1, -1) if level >> k & 1):
            own: list[Piece] = []
            while power:
                doc_id, start, code, tokens = pieces.pop(0)
                size = min(power, len(code) // 4)
                own.append((doc_id, start, code[: 4 * size], tokens))
                if code := code[4 * size :]:
                    pieces.insert(0, (doc_id, start + size, code, tokens))
                power -= size
            self.close(own)


def _pack(definition, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(definition.value, by_library=True)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        closing = np.array([CLOSING_ID], "<u4").tobytes()
        for batch in batches:
            for doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                packer.add(doc_id, bpe.encode(text) + closing)
                if len(packer.done) >= ROWS:
                    yield _rows(packer)
        packer.finish()
        yield _rows(packer)

    return run


def _rows(packer: Packer) -> pa.RecordBatch:
    done, packer.done = packer.done, []
    columns = zip(*done, strict=True) if done else [()] * 7
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: its document, place there, length, checksum, sequence and offset."""
    definition = definition_of(docs.sparkSession, tokenizer)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    return texts.mapInArrow(_pack(definition, window), SCHEMA)
