import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.queries import op11_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(pieces, texts, size=1024):
    """Every id lies in one piece, sequences are gapless and short enough, checksums are those of the library's ids; returns the padding."""
    library = Tokenizer.from_file(PATH)
    cover, sequences = defaultdict(list), defaultdict(list)
    all_ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    for p in pieces:
        ids = all_ids[p.doc_id]
        assert p.doc_tokens == len(ids) and p.length > 0
        assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[p.start : p.start + p.length]))
        cover[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert set(cover) == set(texts)
    for i, spans in cover.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == len(all_ids[i])
    padded = total = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
        total += at
        padded += 0 if at & (at - 1) == 0 else size - at
    return padded, total


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    padded, total = check(op11_packing(spark, d).collect(), texts)
    assert padded <= 0.002 * total


@pytest.mark.parametrize("broadcast", [packing.BROADCAST_ROWS, -1])
def test_odd_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", broadcast)
    rnd = random.Random(5)
    texts = {2**60 + i: " ".join(rnd.choice(["a", "the", "ürg", "<|endoftext|>", "日本", "\n", "x" * 9]) for _ in range(rnd.choice([0, 1, 5, 40, 300, 2000, 9000]))) for i in range(60)}
    texts.update({1: None, 2: "", 3: "a" * 100_000, 4: "same text", 5: "same text", 6: "<|endoftext|>"})
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").selectExpr("*", "1 as id", "2 as part", "'x' as ids", "3 as length").repartition(5)
    check(packing.pack(rows, PATH).collect(), texts)
    small = packing.pack(rows, PATH, size=64, with_ids=True)
    padded, total = check(small.collect(), texts, 64)
    assert padded < 0.1 * total
    whole = packing.sequences(small).collect()
    assert sum(r.length for r in whole) == total and all(len(r.ids) == 4 * r.length == 4 * sum(r.pieces) for r in whole)
    library, parts = Tokenizer.from_file(PATH), defaultdict(list)
    for p in small.collect():
        parts[p.doc_id].append((p.start, p.ids))
    for i, text in texts.items():
        joined = b"".join(ids for _, ids in sorted(parts[i]))
        assert joined == struct.pack(f"<{len(joined) // 4}I", *library.encode(text or "", add_special_tokens=False).ids, 0)


def test_missing_and_repeated_ids_and_no_rows(spark):
    rows = spark.createDataFrame([(None, "a b"), (None, "c d e"), (2**60 + 1, "x"), (2**60 + 1, "x")], "doc_id bigint, text string")
    got = packing.pack(rows, PATH).collect()
    assert sum(p.length for p in got) == 3 + 4 + 2 + 2 and sorted((p.doc_id for p in got if p.doc_id), key=str)[0] == 2**60 + 1
    assert packing.pack(rows.limit(0), PATH).count() == 0


def test_plans_of_histograms():
    rnd = random.Random(2)
    for size, least in ((64, 1), (64, 8), (1024, 8)):
        for kind in range(6):
            histogram = [0] * size
            for _ in range(rnd.choice([1, 5, 2000])):
                histogram[rnd.randrange(1, size) if kind < 3 else rnd.choice([1, 2, size // 2 + 1, size - 1])] += rnd.choice([1, 1, 7, 10**6 if kind == 5 else 3])
            rows, n = packing.plan_rows(histogram, size, least)
            tokens, used = defaultdict(int), defaultdict(int)
            for length, a, b, stride, _, copies, _, take, first, _ in rows:
                count = (b - a) // stride
                tokens[length] += count * copies * take
                used[first, count] += copies * take
            assert all(tokens[x] == x * h for x, h in enumerate(histogram))
            assert all(u <= size for u in used.values())
            assert n == sum(c for _, c in used)
            assert len(rows) < 30 * size
            padded = sum(c * (size - u) for (_, c), u in used.items() if u & (u - 1))
            assert padded <= n * (least - 1) + size


def test_the_fast_way_is_the_library(spark):
    library, encoder, rnd = Tokenizer.from_file(PATH), packing.Encoder(PATH), random.Random(1)
    assert encoder.ranks is not None
    for _ in range(3000):
        text = "".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x20, 0x2FF), rnd.randrange(0x3000, 0xD7FF), rnd.randrange(0x10000, 0x2FFFF), 32, 10, 39])) for _ in range(rnd.randint(0, 20)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.packed(text) == struct.pack(f"<{len(ids)}I", *ids)
    other = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert other.ranks is None and len(other.packed("some words")) % 4 == 0
