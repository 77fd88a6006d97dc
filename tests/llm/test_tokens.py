import random
import struct
import sys
import types
import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from folioflow.llm import packing, tokens
from folioflow.llm.queries import op7_token_files, tokenizer_path


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 70_000])
@pytest.mark.parametrize("high", [1, 2, 50_257, 2**32])
def test_blocks_round_trip(n, high):
    values = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    values[::17] = high - 1
    assert (packing.decode(packing.encode(values)) == values).all()
    assert (packing.decode(packing.encode(values, 0.5)) == values).all()


def test_outliers_are_exceptions_not_width():
    values = np.arange(1024, dtype=np.uint32) % 16 + 7
    values[5] = 2**31
    (block,) = packing.encode(values)
    assert struct.unpack_from(packing.HEAD, block) == (7, 4, 1023, 1)


TEXTS = ["", " ", "a", " a b", "a  b", "a\nb", "a \n b", "tab\there", "end ", "end\n", "\n\n", "it's, isn't it?", "naïve ñandú 日本語", "x<|endoftext|>y",
         "a b", "a\x1cb", "1 2 33 4a", "a\r\nb", " lead", "\nlead", "!! ??", "word" * 3000, "a b c", "🙂 🙂\n🙂"]


def test_chunks_give_the_ids_of_the_whole_text():
    rng = random.Random(3)
    made = ["".join(rng.choice(["a", "Bc", " ", "\n", "'s", ".", "9", "é", "  "]) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    encoder = tokens.Encoder(tokenizer_path())
    for text, ids in zip(TEXTS + made, encoder.encode(TEXTS + made), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def expected(rows):
    """(doc_id, start, n_tokens, crc) by the library's plain call on every document."""
    from tokenizers import Tokenizer

    whole, out, start = Tokenizer.from_file(tokenizer_path()), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents_round_trip(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, "a"), (3, "again"), (None, "no id"), (40, None), (-5, "first")]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, start=1, ids="x") for i, t in rows]).repartition(3)
    found = tokens.token_files(docs, tokenizer_path(), docs_per_file=4).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected(rows)


def test_empty_table(spark):
    assert tokens.token_files(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).collect() == []


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op7_token_files(spark, sf_dir).collect())) == sorted(expected(rows))


def test_texts_without_spaces_are_not_remembered():
    import tracemalloc

    rng = random.Random(1)
    encoder = tokens.Encoder(tokenizer_path())
    encoder.encode(["warm up"])
    tracemalloc.start()
    for _ in range(250):  # 50,000 texts of 200 characters
        encoder.encode(["".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(200)) for _ in range(200)])
    assert len(encoder.known) < 100 and tracemalloc.get_traced_memory()[0] < 20 << 20
    tracemalloc.stop()


def test_remembered_chunks_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 20_000)
    encoder = tokens.Encoder(tokenizer_path())
    for k in range(50):
        texts = [f"word{n} other{n * 7}, {n}\nnext{n}" for n in range(k * 50, k * 50 + 50)]
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) < 20_000 // tokens.EACH + 300


def test_a_worker_keeps_its_encoder_between_tasks_and_drops_it_when_idle(monkeypatch):
    monkeypatch.setitem(sys.modules, "folioflow_worker", types.ModuleType("folioflow_worker"))
    held = sys.modules["folioflow_worker"]
    with tokens.worker_encoder(tokenizer_path()) as first:
        pass
    with tokens.worker_encoder(tokenizer_path()) as second:
        assert second is first
    held.timer.cancel()
    monkeypatch.setattr(tokens, "IDLE", 0.01)
    with tokens.worker_encoder(tokenizer_path()) as third:
        assert third is first
    held.timer.join()
    assert held.own is None
    with tokens.worker_encoder(tokenizer_path()) as fourth:
        assert fourth is not first
        assert fourth.encode(["a b"]) == first.encode(["a b"])
    held.timer.join()
