"""Documents as pieces of at most SEQUENCE tokens, with the byte-level vocabulary."""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE = 1024
#: The id that ends a document.
END = 2
#: Fixed value: how the byte-level format splits text.
PATTERN = r"'(?:[stmd]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in vocabulary files: itself where printable, else the next one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def unassigned(text: str) -> bool:
    """True if the text has a code point that this Python's Unicode tables don't know: others may take it for a letter."""
    return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text))


class Encoder:
    """Ids of whole texts as little-endian 32-bit numbers.

    Ordinary texts go through the same vocabulary as ranks, which is some times as fast; texts with control tokens or
    unassigned code points through the tokenizers library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte = {letter: b for b, letter in byte_letters().items()}
        ranks = {bytes(map(byte.__getitem__, token)): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in self.special}
        self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special) or unassigned(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranked.encode_ordinary(text)
        return np.asarray(ids, "<u4").tobytes()


def cuts(length: int, most: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces: full ones, after a first one with what is left over."""
    first = length % most or most
    starts = [0, *range(first, length, most)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], length])]


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", most: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids and the end id; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(vocabulary), np.asarray([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(text or "") + end
                rows += [(doc_id, i, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)])) for i, (a, n) in enumerate(cuts(len(ids) // 4, most))]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
