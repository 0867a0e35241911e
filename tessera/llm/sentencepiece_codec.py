"""SentencePiece encoding and decoding by a distinct-chunk table.

A model whose pieces have whitespace markers at their start only can never merge
across the border between a character and a following marker. A text is then a
sequence of chunks (a run of markers and the characters up to the next marker)
that are segmented on their own. Each worker keeps a table of the distinct chunks
that it has met: a chunk is segmented, and its ids are decoded, once; a text's
ids and decoded text are joined from that table by the chunks' positions.

The table lives in the Python worker, which later tasks find again, and is emptied
at ``table_chunks`` entries or ``TABLE_BYTES`` bytes, as chunks have any length, so that its memory is bounded and a lost executor
costs only its tasks. One table for the
whole corpus would need a shuffle of every occurrence of every word and of its
position to bring the ids back; this one moves nothing.

Defined results: a very long text is split into words and encoded like any other, in
one row; a null text counts as empty; an empty text has no ids and
decodes to the empty text; rows, repeated ones too, are treated alone; columns
other than the two that are named are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Bytes of a worker's table, and what an entry takes besides its text and ids, about.
TABLE_BYTES, ENTRY_BYTES = 64_000_000, 150


def load(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def check_model(processor) -> None:
    """Raise unless chunks can be segmented alone and joined without change.

    Pieces must not hold a marker after another character, white space must stay
    as it is and get one marker in front, and unknown characters must become
    bytes (else neighbouring unknowns would merge).
    """
    n = processor.get_piece_size()
    crossing = [p for p in map(processor.id_to_piece, range(n)) if re.search(f"[^{MARK}]{MARK}", p)]
    plain = processor.encode("  a  b ") == [i for c in (f"{MARK}{MARK}{MARK}a", f"{MARK}{MARK}b", MARK) for i in _alone(processor, c)]
    if crossing or not plain or not any(map(processor.is_byte, range(n))):
        raise ValueError(f"this model's pieces can cross white space: {crossing[:3]}")


def _alone(processor, chunk: str) -> list[int]:
    """A chunk's ids. The library puts a marker in front, which here is the chunk's first one."""
    return processor.encode(chunk[1:]) if len(chunk) > 1 else [processor.piece_to_id(MARK)]


class ChunkTable:
    """Distinct chunks with their ids, and the decoded texts that differ from the chunk, keyed by the chunk without its first marker."""

    def __init__(self, processor, table_chunks: int):
        self.processor, self.limit = processor, table_chunks
        self.starts_chunk = np.array([processor.id_to_piece(i).startswith(MARK) for i in range(processor.get_piece_size())])
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.changed: dict[int, str] = {}
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.held = 0

    def grow(self, fresh: list[str]) -> None:
        """Segment the chunks that the table lacks."""
        ids = self.segment(fresh)
        at = len(self.lengths)
        for i, (chunk, text) in enumerate(zip(fresh, self.processor.decode(ids))):
            if text != chunk:
                text = " " + text
                if text != (MARK + chunk).replace(MARK, " "):
                    self.changed[at + i] = text
                    self.held += getsizeof(text)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))])
        self.held += sum(map(getsizeof, fresh)) + ENTRY_BYTES * len(fresh) + self.flat.itemsize * int(lengths.sum())

    def segment(self, fresh: list[str]) -> list[list[int]]:
        """The ids of each chunk.

        Chunks of one marker go to the library a few hundred at a time, joined by
        spaces; their ids are parted where a piece starts with a marker.
        """
        plain = [c for c in fresh if c and MARK not in c]
        parted: list[list[int]] = []
        for joined in self.processor.encode([" ".join(plain[i : i + 400]) for i in range(0, len(plain), 400)], num_threads=1):
            first = np.flatnonzero(self.starts_chunk[np.asarray(joined)]).tolist()
            parted += [joined[a:b] for a, b in zip(first, [*first[1:], len(joined)])]
        if len(parted) != len(plain):
            raise ValueError("a chunk was not segmented alone")
        if len(plain) == len(fresh):
            return parted
        rest = iter(parted)
        return [next(rest) if c and MARK not in c else _alone(self.processor, MARK + c) for c in fresh]

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts end to end, how many each has, and the decoded texts."""
        if len(self.place) > self.limit or self.held > TABLE_BYTES:
            self.clear()
        place, fresh, rows = self.place, [], []
        for text in texts:
            chunks = split(text)
            try:
                rows.append([place[c] for c in chunks])
            except KeyError:
                for c in chunks:
                    if c not in place:
                        place[c] = len(place)
                        fresh.append(c)
                rows.append([place[c] for c in chunks])
        if fresh:
            self.grow(fresh)
        per_text = np.fromiter(map(len, rows), np.int64, len(rows))
        at = np.fromiter(chain.from_iterable(rows), np.int64, int(per_text.sum()))
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.starts[at] - (ends - lengths), lengths)]
        sums = np.concatenate([[0], ends])
        borders = np.concatenate([[0], np.cumsum(per_text)])
        return ids, sums[borders[1:]] - sums[borders[:-1]], [self.decoded(text, row) for text, row in zip(texts, rows)]

    def decoded(self, text: str, row: list[int]) -> str:
        """Chunks whose decoded text is the chunk with spaces for markers, as nearly all are, are not kept a second time."""
        if not self.changed or self.changed.keys().isdisjoint(row):
            return text.replace(MARK, " ")
        parts = [self.changed.get(i) or (MARK + c).replace(MARK, " ") for i, c in zip(row, split(text))]
        return "".join(parts)[1:]


def split(text: str) -> list[str]:
    """A text's chunks, each without its first marker."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [c[1:] for c in CHUNK.findall(MARK + text.replace(" ", MARK))]


_TABLES: dict[tuple[str, int], ChunkTable] = {}


def worker_table(model: str, table_chunks: int) -> ChunkTable:
    if (model, table_chunks) not in _TABLES:
        processor = load(model)
        check_model(processor)
        _TABLES[model, table_chunks] = ChunkTable(processor, table_chunks)
    return _TABLES[model, table_chunks]


def encode_decode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", table_chunks: int = 1_000_000, batch_chars: int = 1_000_000) -> DataFrame:
    """Per row: the id column, ``ids`` array<int> and ``decoded`` string."""
    id_type = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = worker_table(model, table_chunks)
        for batch in batches:
            begin, texts, chars = 0, [], 0
            for i in range(batch.num_rows):
                texts.append(batch.column(1)[i].as_py() or "")
                chars += len(texts[-1])
                if chars >= batch_chars or i + 1 == batch.num_rows:
                    ids, n, decoded = chunks.of(texts)
                    offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, i + 1 - begin), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])
                    begin, texts, chars = i + 1, [], 0

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type.simpleString()}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of what encode_decode returns."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
