import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from rankloom.llm.packing import LevelPacker, pack_documents
from rankloom.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")
TEXTS = [None, "", "Hello, world's   straße ÉTÉ 12³!", "a\tb\x1cc dİΣ", "don't <|endoftext|> it", "one " * 5000, "x" * 300, "é é ##$$", "one " * 5000, "日本語 text"]


def expected(text):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_pieces_hold_each_id_once(spark):
    docs = spark.createDataFrame([(i % 8, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "b c", "y", 2)], "doc_id long, text string, ids string, offset int")
    rows = pack_documents(docs.coalesce(1), PATH, window=64).collect()
    spans, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        spans[r.doc_id].append((r.start, ids.tolist(), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, len(ids)))
    for i, text in enumerate(TEXTS):
        if i % 8 == i and i not in (0, 1):
            got = [x for _, ids, _ in sorted(spans[i]) for x in ids]
            assert got == expected(text)
            assert {n for *_, n in spans[i]} == {len(got)}
    assert sum(len(ids) for v in spans.values() for _, ids, _ in v) == sum(len(expected(t)) for t in [*TEXTS, "b c"])
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64
    assert sum(sum(n for _, n in p) < 64 for p in sequences.values()) <= 1


def test_level_choice_is_least_sum_of_squares():
    rng = np.random.default_rng(1)
    packer = LevelPacker(32, 0)
    for k in range(300):
        size = int(rng.integers(1, 32))
        n = packer.count.copy()

        def after(h):
            m = n.copy()
            if h:
                m[h] -= 1
            if h + size < 32:
                m[h + size] += 1
            return int((m[1:32] ** 2).sum())

        choices = [h for h in range(0, 33 - size) if h == 0 or n[h]]
        best = packer.best_level(size)
        assert best in choices
        assert after(best) == min(map(after, choices))
        packer.add(k, np.arange(size, dtype=np.uint16))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(docs, PATH).count() == 0


def test_crc_column(spark):
    from pyspark.sql import functions as F

    row = pack_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), PATH).withColumn("c", F.crc32("ids")).first()
    assert row.c == zlib.crc32(np.array(expected("a b"), "<u4").tobytes())
