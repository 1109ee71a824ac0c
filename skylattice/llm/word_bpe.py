"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that stand together in no token of the vocabulary can never be merged, so a word may be cut between them:
the fragments are encoded on their own and their ids joined. A fragment's merges come from a heap, so that very long ones take
little more than linear time. Words repeat, so their results are kept in a bounded memo; a task keeps
nothing else.

Text is prepared as the vocabulary file says: canonical composition, white space as one space, lower case letter by letter, then
contractions, letter runs, single digits and symbol runs; white space is dropped. Code points that this Python's Unicode tables don't
know are left to the tokenizers library's tables: it splits the texts that hold some, and encodes nothing. The two control tokens are found in the raw text.

Defined results: null text counts as empty: no ids, hashes of the empty string. Any other text, however long, is encoded whole.
Repeated rows give repeated results; an empty table an empty one. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.memo import Memo
from skylattice.llm.piece_tokens import byte_letters, unassigned

#: Parts up to which a fragment is merged by looking through all its pairs.
SHORT = 40
#: Fixed values of the vocabulary's format.
SUFFIX = "</w>"
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


def joined(found: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    """One result of several."""
    found = [x for x in found if x[0]]
    return sum([x[0] for x in found]), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.letters = byte_letters()
        self.together = {x[i : i + 2] for t in self.ids for x in [t.removesuffix(SUFFIX)] for i in range(len(x) - 1)}
        self.word = regex.compile(WORD)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = Memo(self.of_word)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        # splits texts whose code points this Python's tables don't know; it never encodes
        self.library = Tokenizer.from_file(path)

    def cut(self, word: str) -> list[str]:
        """The word's byte letters, cut wherever two of them never stand together in a token."""
        at = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.together), len(word)]
        return [word[a:b] for a, b in zip(at, at[1:])]

    def merged(self, fragment: str, last: bool) -> list[str]:
        """The tokens of a fragment; the last one of a word carries the suffix. The pair of least rank is merged first, of such pairs the leftmost."""
        parts: list[str] = list(fragment)
        if last:
            parts[-1] += SUFFIX
        if len(parts) > SHORT:
            return self.merged_by_heap(parts)
        none, get = len(self.ranks), self.ranks.get
        ranks = [get(p, none) for p in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
        return parts

    def merged_by_heap(self, parts: list[str]) -> list[str]:
        """The same for many parts: the pairs wait in a heap, the parts are a linked list."""
        n, get = len(parts), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i) for i in range(n - 1) if (rank := get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            # what was merged meanwhile has left the place empty or made another pair of it
            if not parts[i] or j >= n or get((parts[i], parts[j])) != rank:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (rank, i))
            h = before[i]
            if h >= 0 and (rank := get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (rank, h))
        return [p for p in parts if p]

    def of_letters(self, letters: str) -> tuple[int, str, str]:
        """Number of ids, the ids and the tokens, each joined by spaces, of a word's byte letters."""
        pieces = self.cut(letters)
        tokens = [t for i, p in enumerate(pieces) for t in self.merged(p, i == len(pieces) - 1) if t in self.ids]
        return len(tokens), " ".join(str(self.ids[t]) for t in tokens), " ".join(tokens)

    def of_word(self, word: str) -> tuple[int, str, str]:
        return self.of_letters("".join([self.letters[b] for b in word.encode("utf-8", "surrogatepass")]))

    def prepared(self, text: str) -> str:
        """White space is dropped by the word pattern, so its runs can stay as they are."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma: each letter on its own
        return text.lower()

    def of_text(self, text: str) -> list[tuple[int, str, str]]:
        """As of_word(), of the words of a text without control tokens."""
        if unassigned(text):
            return [self.of_letters(x) for x, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]
        return list(map(self.words.__getitem__, self.word.findall(self.prepared(text))))

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by spaces, the decoded text."""
        if self.specials and "<|" in text:
            found = [x for part in self.specials.split(text) for x in ([(1, str(self.special[part]), part)] if part in self.special else self.of_text(part))]
        else:
            found = self.of_text(text)
        return joined(found)

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary file names no decoder: tokens are joined by spaces; unknown ids are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def encoded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (joined by spaces), decoded: one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in batches:
            rows = [codec.encode(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.large_string()).cast(pa.string()), pa.array([r[2] for r in rows], pa.large_string()).cast(pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")


def digested(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encoded(), with SHA-256 of ids and decoded text in place of both, taken where they are made."""

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                n, i, t = codec.encode(text or "")
                counts.append(n)
                ids.append(digest(i))
                decoded.append(digest(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
