"""What a Python worker keeps of the tokenizer's answers is bounded, and gone after the task."""

import pyarrow as pa

from leadloom.llm import packing, tokens
from leadloom.llm.queries import TOKENIZER


def test_answers_kept_are_bounded():
    known = tokens.Chunks(TOKENIZER)
    texts = [" ".join(f"a{i:x}." for i in range(at, at + 500)).encode() for at in range(0, 300_000, 500)]
    first = known.ids(texts[0])
    for text in texts:
        known.ids(text)
        assert len(known.chunks) <= 200_500 and len(known.pieces) <= 200_500
    assert known.ids(texts[0]) == first
    known.forget()
    assert not known.chunks and not known.pieces and known.ids(texts[0]) == first


def test_nothing_is_kept_after_a_task(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('some words, number ', id) AS text").repartition(1)
    assert packing.pieces(docs, TOKENIZER).count() == 40

    def kept(batches):
        yield from (pa.RecordBatch.from_arrays([pa.array([len(known.chunks) + len(known.pieces)])], names=["n"]) for _ in batches if (known := tokens.loaded(TOKENIZER)))

    assert [r["n"] for r in spark.range(1).repartition(1).mapInArrow(kept, "n long").collect()] == [0]
