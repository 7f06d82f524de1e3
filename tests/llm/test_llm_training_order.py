"""Training order: a permutation both ways, and shards read back exactly."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import tokens, training_order


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_slots_are_a_permutation(count, key):
    slots = training_order.permuted(np.arange(count), count, key)
    assert sorted(slots.tolist()) == list(range(count))
    assert training_order.permuted(slots, count, key, backwards=True).tolist() == list(range(count))


def test_shards_hold_every_token_once(spark, tmp_path):
    texts = [f"text number {i} " * (i % 40) for i in range(120)] + [None, "x" * 5000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, slot int")
    folder = f"file://{tmp_path}/shards"
    manifest = training_order.materialise(docs.repartition(4), folder, key=7, size=64, shard_sequences=16).orderBy("slot").collect()
    assert [r.slot for r in manifest] == list(range(len(manifest)))
    assert {r.shard for r in manifest} == {r.slot // 16 for r in manifest}
    assert [r.sequence_id for r in manifest] != sorted(r.sequence_id for r in manifest)
    records = list(training_order.read_slots(folder, 0, len(manifest), 64, 16))
    held = {}
    for row, record in zip(manifest, records):
        assert not record[row.tokens :].any() and row.byte == row.slot % 16 * 128
        held[row.sequence_id] = record[: row.tokens]
    whole = sorted(np.concatenate([np.append(tokens.encode(t), 0) for t in texts]).tolist())
    assert sorted(np.concatenate(list(held.values())).tolist()) == whole
    later = list(training_order.read_slots(folder, 20, 5, 64, 16))
    assert all((a == b).all() for a, b in zip(later, records[20:25]))


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert training_order.materialise(docs, f"file://{tmp_path}/none", key=1).collect() == []
