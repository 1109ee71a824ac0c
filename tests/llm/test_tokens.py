"""Packing and BPE against the tokenizers library."""

import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skylattice.llm import packing, word_bpe
from skylattice.llm.packing import runs
from skylattice.llm.piece_tokens import Encoder
from skylattice.runtime import table

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
TRICKY = [
    None, "", " ", "\n\n \t x", "Hello WORLD's don't they'LL 123 4567 ½ Ⅷ", "naïve café ΣΑΣ İstanbul ǅ ß ﬁ", "中文字符 日本語 한국어 ไทย", "a b c​d﻿", "👩‍👩‍👧 👍🏽 ... !!! ---",
    "<|startoftext|>x<|endoftext|> y <|endoftext|>z <|end", "x" * 5000, "ab " * 3000, "\x00\x01\x7f\x85\x1c\x1d", "don’t “quote” — dash… 50%", "'s't're 've'm 'll'd", "a" * 64 + "é" * 64, "  lead and trail  ", "Ünïcödé ÀÉÎÕÜ Ÿ Ω Å", "مرحبا بالعالم שלום",
]


def library(path):
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def texts():
    r = random.Random(2)
    letters = "abcdefghijklmnop  \n\t.,'!?0123456789äéßñΣσς中文<|>"
    return TRICKY + ["".join(r.choice(letters) for _ in range(r.randint(1, 200))) for _ in range(150)]


def test_forced_boundaries_as_library(spark):
    docs = list(enumerate(texts()))
    made = {r["doc_id"]: r for r in word_bpe.digested(spark.createDataFrame(docs, "doc_id long, text string"), WORDS).collect()}
    plain = {r["doc_id"]: r for r in word_bpe.encoded(spark.createDataFrame(docs, "doc_id long, text string"), WORDS).collect()}
    want = library(WORDS)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d, text in docs:
        ids = want.encode(text or "", add_special_tokens=False).ids
        assert plain[d]["ids"] == " ".join(map(str, ids)), repr(text)
        decoded = want.decode(ids, skip_special_tokens=False)
        assert plain[d]["decoded"] == decoded, repr(text)
        assert (made[d]["n_tokens"], made[d]["ids_sha256"], made[d]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))
    codec = word_bpe.Codec(WORDS)
    assert codec.decode([320, 10**9, 49406]) == want.decode([320, 49406], skip_special_tokens=False)


def test_any_code_point_as_library():
    r = random.Random(4)
    planes = [(0x20, 0x250), (0x300, 0x3000), (0x1C80, 0x1C90), (0xA700, 0xAB70), (0x10000, 0x12700), (0x1D000, 0x1E700), (0x30000, 0x40000), (0x200B, 0x200C)]
    some = ["".join(chr(r.randrange(*r.choice(planes))) for _ in range(8)) for _ in range(1500)]
    words, pieces, codec, encoder = library(WORDS), library(BYTES), word_bpe.Codec(WORDS), Encoder(BYTES)
    for text in some:
        assert codec.encode(text)[1] == " ".join(map(str, words.encode(text, add_special_tokens=False).ids)), ascii(text)
        assert encoder.encode(text) == np.array(pieces.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), ascii(text)


def test_runs_of_white_space_as_library():
    r = random.Random(6)
    some = ["".join(r.choice(["a", "b'", "'s", " ", " ", "\n", "\t", "\u3000", "\x1c", "7", "."]) for _ in range(12)) for _ in range(3000)]
    words, pieces, codec, encoder = library(WORDS), library(BYTES), word_bpe.Codec(WORDS), Encoder(BYTES)
    for text in some:
        assert codec.encode(text)[1] == " ".join(map(str, words.encode(text, add_special_tokens=False).ids)), ascii(text)
        assert encoder.encode(text) == np.array(pieces.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), ascii(text)


def test_very_long_fragments():
    codec, want = word_bpe.Codec(WORDS), library(WORDS)
    r = random.Random(8)
    for text in ("ab" * 20_000, "a" * 40_000, "".join(r.choice("aeinorst") for _ in range(30_000))):
        assert codec.encode(text)[1] == " ".join(map(str, want.encode(text, add_special_tokens=False).ids))
    began = time.perf_counter()
    assert codec.encode("ab" * 500_000)[0] > 0
    assert time.perf_counter() - began < 60


def check_packed(rows, docs):
    """Every document's ids are there, cut only where too long; sequences are gapless and within the limit."""
    want, by_doc, by_sequence = library(BYTES), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == {d for d, _ in docs}
    for d, text in docs:
        ids = np.array([*want.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[d], key=lambda r: r["piece"])
        at = 0
        for i, r in enumerate(pieces):
            assert (r["piece"], r["start"]) == (i, at)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert r["length"] == 1024 or i == 0
            at += r["length"]
        assert at == len(ids)
        assert len(pieces) == -(-len(ids) // 1024)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    return len(by_sequence), -(-total // 1024)


def test_packing_as_library(spark):
    docs = [(d, t) for d, t in enumerate(texts())]
    made = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), BYTES).collect()
    used, least = check_packed(made, docs)
    assert used <= least + 2


def test_packing_of_the_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    used, least = check_packed(packing.pack(table(spark, SF, "documents"), BYTES).collect(), docs)
    assert used <= least * 1.02 + 1


@pytest.mark.parametrize("seed", range(5))
def test_runs_use_every_piece_once(seed):
    r = np.random.default_rng(seed)
    lengths, n = np.unique(np.minimum(1024, r.lognormal(5, 1.2, 4000).astype(int) + 1), return_counts=True)
    counts = dict(zip(lengths.tolist(), n.tolist()))
    found = runs(counts, 1024)
    for length, own in found.items():
        at = 0
        for first, number, _, _ in sorted(own):
            assert first == at
            at += number
        assert at == counts[length]
    assert set(found) == set(counts)


def sequences_used(counts):
    """The number of sequences; every place in them is checked to be held once at most."""
    spans = defaultdict(list)
    for n, own in runs(counts, 1024).items():
        for _, number, sequences, offset in own:
            assert number % len(sequences) == 0
            spans[sequences].append((offset, offset + n * (number // len(sequences))))
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= 1024
        assert all(a[1] == b[0] for a, b in zip(own, own[1:]))
    assert sum(map(len, spans)) == max(s.stop for s in spans)
    return sum(map(len, spans))


def test_many_short_lengths():
    assert sequences_used({100: 1_000_000}) == 100_000
    assert sequences_used({1: 5_000_000}) == -(-5_000_000 // 1024)
    r = np.random.default_rng(3)
    short = {n: int(r.integers(1, 200_000)) for n in range(5, 342)}
    hot = {n: int(r.integers(1, 2_000)) for n in range(1, 1025)} | {90: 3_000_000}
    log = np.unique(np.minimum(1024, r.lognormal(4.5, 1, 1_000_000).astype(int) + 1), return_counts=True)
    for counts in (short, hot, dict(zip(*(x.tolist() for x in log)))):
        least = -(-sum(n * c for n, c in counts.items()) // 1024)
        assert sequences_used(counts) <= least * 1.02


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "same", 5), (1, "same", 5), (None, None, None)], "doc_id long, text string, length int")
    made = packing.pack(docs, BYTES).collect()
    assert len(made) == 3 and len({(r["sequence_id"], r["offset"]) for r in made}) == 3
    assert packing.pack(docs.limit(0), BYTES).count() == 0
    assert word_bpe.digested(docs.limit(0), WORDS).count() == 0
    assert [r["n_tokens"] for r in word_bpe.digested(docs, WORDS).collect()].count(0) == 1
