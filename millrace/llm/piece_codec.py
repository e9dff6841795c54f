"""SentencePiece encoding and decoding with a table of distinct marked words.

A model of which no piece holds a white-space marker after another character cannot merge across the start of a run
of markers. So the normalised text, "▁" + text with each space as "▁", falls into chunks (a run of markers and what
follows it) that are segmented on their own; each distinct chunk of a task is segmented once, and its ids are joined
back by position. The table is bounded: when full it is emptied and filled again, which changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm._shared import BATCH_BYTES, FEW_BYTES, kept_beside, mapped, slices, small_batches

MARK = "▁"
#: Entries of a task's table, and characters of the longest chunk that it keeps.
TABLE_ENTRIES, TABLE_CHARS = 300_000, 64
#: Texts that a normaliser must leave as they are, but for the markers, so that chunks can be told before it.
PROBES = ["a", " a", "a ", "a  b", "  ", "\tx\n\ny", "ﬁ Ａ é e\u0301 ①", "A\u00a0b\u3000c\u200bd"]
_CHUNK = re.compile(" *[^ ]+| +$")


class ChunkTable:
    """Encodes texts as model_file does, a distinct chunk at a time."""

    def __init__(self, model_file: str, add_eos: bool = True) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        crossing = [p for p in map(self.model.id_to_piece, range(self.model.get_piece_size())) if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces cross white-space markers: {crossing[:3]}")
        changed = [x for x in PROBES if self.model.normalize(x) != MARK + x.replace(" ", MARK)]
        if changed:
            raise ValueError(f"the model's normaliser changes texts: {changed[:3]}")
        self.lone = self.model.piece_to_id(MARK)
        self.tail = np.array([self.model.eos_id()] if add_eos else [], np.int32).tobytes()
        self.table: dict[str, tuple[bytes, str]] = {}

    def chunks(self, text: str) -> list[str]:
        """The chunks, each without its first marker."""
        if MARK in text:
            text = text.replace(MARK, " ")
        if text[0] != " " and text[-1] != " " and "  " not in text:
            return text.split(" ")
        found = _CHUNK.findall(text)
        return [found[0], *(x[1:] for x in found[1:])]

    def segment(self, chunks: list[str]) -> None:
        ids = [i or [self.lone] for i in self.model.encode(chunks, num_threads=1)]
        for chunk, i, text in zip(chunks, ids, self.model.decode(ids, num_threads=1), strict=True):
            self.table[chunk] = (np.array(i, np.int32).tobytes(), text)

    def code(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text, the ids as 32-bit integers, and decode(ids)."""
        if len(self.table) > TABLE_ENTRIES:
            self.table.clear()
        table, cut = self.table, [self.chunks(x) if x else [] for x in texts]
        new = list({x for chunks in cut for x in chunks}.difference(table))
        if new:
            self.segment(new)
        out = []
        for chunks in cut:
            found = [table[x] for x in chunks]
            out.append((b"".join([x[0] for x in found]) + self.tail, " ".join([x[1] for x in found])))
        for x in new:
            if len(x) > TABLE_CHARS:
                del table[x]
        return out


def encode_decode(df: DataFrame, model_file: str, add_eos: bool = True, text: str = "text") -> DataFrame:
    """df's columns besides `text`, with ids (array of int) and decoded (string), whatever the texts' lengths.

    A null text is empty; an empty text has no ids but the end id, and decodes to the empty string. Equal texts give
    equal rows; an empty table gives an empty one. Columns of df named ids or decoded are replaced.
    """
    small_batches(df.sparkSession, size=BATCH_BYTES)
    rows, keep, own, fields = kept_beside(df, text, [text, "ids", "decoded"])
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            for part in slices(batch, own, FEW_BYTES):
                codec = codec or ChunkTable(model_file, add_eos)
                coded = codec.code([t or "" for t in part.column(own).to_pylist()])
                ends = np.concatenate([[0], np.cumsum([len(x[0]) // 4 for x in coded])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(x[0] for x in coded), np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), ids, pa.array([x[1] for x in coded], pa.string())], names=[*keep, "ids", "decoded"])

    return mapped(rows, run, schema)
