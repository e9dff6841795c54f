"""Token counts of whole texts by overlap resynchronisation.

For a byte-level BPE whose words are split by the usual pattern (which the file is checked for; else texts are encoded whole), the place between a non-space character and a space
is a boundary of words whatever surrounds it: no alternative of the pattern holds a space after another character, and
its look-ahead only concerns runs of white space. So tokens on either side of such a place don't depend on the other.

Huge texts are encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced at a stable boundary of
their overlap, if both have a token boundary there and the tokens from there to the next one agree; if there is none,
the overlap is widened until there is, at most to the text's end. Other texts fall into words at stable boundaries,
and each distinct word of a task is encoded once.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm._shared import kept_beside, slices, small_batches

#: Characters of a chunk of a huge text, and of the first overlap.
CHUNK, OVERLAP = 16_384, 256
TABLE_ENTRIES, TABLE_CHARS = 300_000, 64
_SPLIT = re.compile(r"(?<=\S) ")
_STABLE = re.compile(r"(?<=[!-~]) ")


def splits_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer file is one for which the place before a space behind another character is a boundary.

    It is for byte-level words by the usual pattern, if nothing changes the text before, no model state crosses words, and no added
    token holds white space or takes in what is beside it.
    """
    words, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    usual = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space")
    plain = model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    alone = all(not re.search(r"\s", t["content"]) and not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in spec.get("added_tokens") or [])
    return bool(usual and plain and alone and spec.get("normalizer") is None)


class TokenCounter:
    def __init__(self, tokenizer_file: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.table: dict[str, int] = {}
        self.widened = 0
        with open(tokenizer_file, encoding="utf-8") as file:
            #: Whether texts are encoded whole, since no place in them is known to be a boundary.
            self.whole = not splits_at_spaces(json.load(file))

    def encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch(texts, add_special_tokens=False)

    def count(self, texts: list[str]) -> list[int]:
        if self.whole:
            return [len(e) for e in self.encode(texts)]
        short = iter(self.by_word([x for x in texts if len(x) <= self.chunk]))
        return [next(short) if len(x) <= self.chunk else self.spliced(x) for x in texts]

    def by_word(self, texts: list[str]) -> list[int]:
        """Counts of texts, each distinct word encoded once."""
        if len(self.table) > TABLE_ENTRIES:
            self.table.clear()
        table, cut = self.table, []
        for text in texts:
            first, *rest = _SPLIT.split(text)
            cut.append([first, *[" " + w for w in rest]] if text else [])
        new = list({w for words in cut for w in words}.difference(table))
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            table[w] = len(e)
        out = [sum([table[w] for w in words]) for words in cut]
        for w in new:
            if len(w) > TABLE_CHARS:
                del table[w]
        return out

    def spliced(self, text: str) -> int:
        """The sum of what each chunk has between its splices."""
        start, end = 0, self.chunk + self.overlap
        left, total, done = self.encode([text[:end]])[0], 0, 0  # done: tokens of `left` before its first splice
        while end < len(text):
            at, wide = end - self.overlap, self.overlap
            right = self.encode([text[at : end + self.chunk]])[0]
            while (found := self.splice(text, start, left, at, right, end)) is None and end < len(text):
                end += 3 * wide
                wide *= 4
                self.widened += 1
                left, right = self.encode([text[start:end], text[at : end + self.chunk]])
            if found is None:  # no stable boundary up to the end: `left` has it all
                break
            total += found[0] - done
            start, end, left, done = at, end + self.chunk, right, found[1]
        return total + len(left) - done

    def splice(self, text: str, start: int, left, at: int, right, end: int) -> tuple[int, int] | None:
        """Tokens of left and of right before a boundary at which they are aligned."""
        places = [m.start() for m in _STABLE.finditer(text, at + 1, min(end, len(text)))]
        before = None
        for b in places:
            i, j = left.char_to_token(b - 1 - start), right.char_to_token(b - 1 - at)
            if i is None or j is None:
                before = None
                continue
            if before is not None and left.ids[before[0] : i + 1] == right.ids[before[1] : j + 1]:
                return before
            before = (i + 1, j + 1)
        return None


def count_tokens(df: DataFrame, tokenizer_file: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """df's columns besides `text`, with the number of tokens of each whole text, without added special tokens.

    A null text counts as empty, with 0 tokens. Strings of special tokens in a text are handled as by the library's
    default. Texts of any length are counted whole; equal texts have equal counts; an empty table gives an empty one.
    A column of df of the same name as `out` is replaced.
    """
    small_batches(df.sparkSession)
    rows, keep, own, fields = kept_beside(df, text, [text, out])
    schema = T.StructType([*fields, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(tokenizer_file)
        for batch in batches:
            for part in slices(batch, own):
                n = counter.count([t or "" for t in part.column(own).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(np.array(n, np.int64))], names=[*keep, out])

    return rows.mapInArrow(run, schema)
