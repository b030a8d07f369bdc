"""Token files with more different ids than a table has entries."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from keyhold.llm import rans, token_files
from keyhold.llm.queries import BYTE_TOKENIZER


def test_escapes_in_blocks():
    """Ids without an entry, below, at and above the escape's own number; blocks with and without them, full and not."""
    rng = np.random.default_rng(3)
    counts = np.zeros(300, dtype=np.int64)
    counts[10:200:3] = rng.integers(1, 1000, 64)
    counts[299] = 40  # the escape
    coder = rans.Coder(rans.table(counts), True)
    known = np.flatnonzero(counts)[:-1]
    odd = np.array([0, 11, 298, 299, 300, 2**31, 2**32 - 1], dtype=np.uint32)
    blocks = [rng.choice(known, rans.BLOCK), rng.choice(np.concatenate((known, odd)), rans.BLOCK), odd[3:4], np.tile(odd, 77), rng.choice(known, 33)]
    blocks = [b.astype(np.uint32) for b in blocks]
    data = coder.encode(blocks)
    assert [d[:4] for d in data] == [rans.MAGIC, rans.MAGIC_RARE, rans.MAGIC_RARE, rans.MAGIC_RARE, rans.MAGIC]
    for order in ([0, 1, 2, 3, 4], [3, 1], [2]):
        assert all((got == blocks[i]).all() and len(got) == len(blocks[i]) for i, got in zip(order, coder.decode([data[i] for i in order])))
    plain = rans.Coder(rans.table(counts[:299]))
    assert plain.decode(plain.encode([blocks[0]]))[0].tolist() == blocks[0].tolist()
    with pytest.raises(ValueError, match="hasn't"):
        plain.encode([odd])
    with pytest.raises(ValueError, match="rare ids"):
        plain.decode([data[3]])
    with pytest.raises(ValueError, match="checksum"):
        coder.decode([data[3][:-6] + b"xx" + data[3][-4:]])


@pytest.mark.parametrize("entries", [1, 2, 40, 100_000])
def test_round_trip_with_few_entries(spark, monkeypatch, tmp_path, entries):
    monkeypatch.setattr(token_files, "MAX_VOCAB", entries)
    texts = [f"word {i * i} and {'again ' * (i % 5)}" for i in range(60)] + ["", None, "äöü 漢字 🙂" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    files = token_files.write_tokens(docs, str(tmp_path / "t"), BYTE_TOKENIZER, 0)
    freq, escapes = files.frequencies(spark)
    whole = Tokenizer.from_file(BYTE_TOKENIZER)
    want = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    different = {x for ids in want.values() for x in ids}
    assert escapes == (len(different) > entries) and np.count_nonzero(freq) == min(entries, len(different)) and freq.sum() == 1 << rans.SCALE
    got = {}
    for r in sorted(token_files.decoded(spark, files).collect(), key=lambda r: (r.doc_id, r.part)):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == want
    start = 0
    for r in token_files.summary(spark, files).orderBy("doc_id").collect():
        raw = np.array(want[r.doc_id], "<u4").tobytes()
        assert tuple(r) == (r.doc_id, start, len(want[r.doc_id]), zlib.crc32(raw))
        start += r.n_tokens
