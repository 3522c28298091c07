"""Windows over the capacity: the window count rises and all is differenced again."""

import pytest

from steploom.llm import packing

P = pytest.importorskip("public_tokenizers")


def test_pack_raises_the_window_count(docs):
    table = docs([(i, " word" * 59) for i in range(5)]).coalesce(1)  # 60 tokens each with the end: one fits a window of 100
    def packed(**how):
        return packing.pack(table, P.path("byte_bpe_50k.json"), 1, capacity=100, group=4, **how).collect()

    got = packed()
    assert [r["length"] for r in got] == [60] * 5 and len({r["sequence_id"] for r in got}) == 5
    assert len({r["sequence_id"] for r in packed(cut=True)}) == 3
