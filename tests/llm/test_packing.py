import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from tidebars.llm import packing
from tidebars.llm.queries import tokenizer_paths

from .conftest import odd_rows


def test_words_encode_like_whole_texts():
    coder = packing.Encoder(*tokenizer_paths())
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "é", "1", "12", ".", "!", "'s", "'ll", " ", " ", "😀", "word", "<|endoftext|>", "\r", "\x1c", "　", "́", "٣", "\x00"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(2000)]
    assert coder.encode(texts) == coder.by_tokenizers(texts)


def test_patterns_hold_every_piece_once():
    rng = random.Random(2)
    for _ in range(50):
        counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, 64), rng.randint(1, 30))}
        packs = packing.shortest_pack_first(dict(counts), 64)
        got = Counter()
        for lengths, often in packs:
            assert sum(lengths) <= 64 and often > 0
            for n in lengths:
                got[n] += often
        assert got == Counter(counts)


def check_pieces(rows, texts, length):
    coder = packing.Encoder(*tokenizer_paths())
    want = Counter()
    for doc, text in texts:
        ids = np.frombuffer(coder.by_tokenizers([text or ""])[0], "<u4").tolist() + [0]
        for s in range(0, len(ids), length):
            part = np.array(ids[s:s + length], "<u4")
            want[doc, s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    return len(sequences)


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "_TILE", 7)
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choices(["alpha", "beta", "x", "longword"], k=rng.choice([1, 3, 20, 200])))) for i in range(150)]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), *tokenizer_paths(), length=64).collect()
    n = check_pieces(rows, texts, 64)
    assert n <= 1.05 * sum(r.length for r in rows) / 64 + 1


def test_odd_and_empty_tables(spark, odd, none):
    check_pieces(packing.pack(odd, *tokenizer_paths()).collect(), [r[:2] for r in odd_rows()], 1024)
    assert packing.pack(none, *tokenizer_paths()).count() == 0
