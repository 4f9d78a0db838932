import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerloom.llm import packing
from tests.llm.samples import SMALL, awkward, documents, empty


def check(rows, out, length=1024):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(
        (zlib.crc32(np.array(ids[b : b + length], "<u4").tobytes()), -1 if d is None else d, b, len(ids[b : b + length]), len(ids))
        for d, t in rows
        for ids in [plain.encode(t or "", add_special_tokens=False).ids + [0]]
        for b in range(0, len(ids), length)
    )
    assert want == sorted((r.ids_crc32, -1 if r.doc_id is None else r.doc_id, r.start, r.length, r.doc_tokens) for r in out)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    used = 0
    for places in sequences.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= length
        used += at
    return used / (len(sequences) * length)


def test_small_table(spark):
    out = packing.packed_digest(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    assert check([(d, t) for d, t, _ in documents()], out) > 0.9


def test_awkward(spark):
    frame, rows = awkward(spark)
    check(rows, packing.packed_digest(frame).collect())
    assert packing.packed_digest(empty(spark)).collect() == []


def test_place_keeps_every_piece():
    histogram = {1000: 3, 600: 5, 400: 7, 100: 11, 24: 40, 1024: 2}
    patterns = packing.place(histogram, 1024)
    placed = defaultdict(int)
    for count, sizes in patterns:
        assert sum(sizes) <= 1024
        for size in sizes:
            placed[size] += count
    assert placed == histogram
    ranks = defaultdict(list)
    for size, first, end, _, _ in packing.intervals(patterns):
        ranks[size].append((first, end))
    for size, own in ranks.items():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] == histogram[size]
        assert all(a[1] == b[0] for a, b in zip(own, own[1:]))


def test_chunks_encode_like_the_whole():
    coder = packing.ByteTokens(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), limit=3)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("a b", " a", "a  b", "a \n b", "it's we'll  'S 12ab-- x\t\ty ", "x  y z", "é è\n\nü", "end ", "a\n b", "<|endoftext|> a"):
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_bytes_that_are_no_text(spark):
    frame = spark.range(1).selectExpr("id AS doc_id", "CAST(concat(encode('one  two ', 'utf-8'), X'FF80', encode(' three', 'utf-8')) AS STRING) AS text")
    assert check([(0, "one  two �� three")], packing.packed_digest(frame).collect()) > 0
