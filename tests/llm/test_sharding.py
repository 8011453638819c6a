import numpy as np
import pytest
import xxhash
from corpus_helpers import empty, odd_documents, rows

from staffline.llm import sharding


def plain_table(shards, size):
    """Turns written out one by one."""
    order = []
    for s in shards:
        offset, skip = xxhash.xxh64_intdigest(s, 1) % size, xxhash.xxh64_intdigest(s, 2) % (size - 1) + 1
        order.append([(offset + k * skip) % size for k in range(size)])
    table = [None] * size
    while None in table:
        for i in sorted(range(len(shards)), key=lambda i: shards[i]):
            if None in table:
                table[next(s for s in order[i] if table[s] is None)] = i
    return table


def test_table_equals_turns_written_out():
    shards = [f"s{i}" for i in (3, 1, 2, 0, 4)]
    assert sharding.fill_table(shards, 211).tolist() == plain_table(shards, 211)


def test_shards_are_even_weights_count_and_few_slots_move():
    names = [f"s{i}" for i in range(20)]
    table = sharding.fill_table(names)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    heavy = np.bincount(sharding.fill_table(names, weights=[3] + [1] * 19))
    assert heavy[0] / heavy[1:].mean() == pytest.approx(3, rel=0.01)
    assert sharding.moved(table, sharding.fill_table(names[:-1]), names, names[:-1]) < 0.1
    reverse = names[::-1]
    assert sharding.moved(table, sharding.fill_table(reverse), names, reverse) == 0


@pytest.mark.parametrize("shards, size, weights", [([], 11, None), (["a", "a"], 11, None), (["a", "b"], 12, None), (["a", "b"], 11, [1, 0])])
def test_bad_arguments_are_refused(shards, size, weights):
    with pytest.raises(ValueError):
        sharding.fill_table(shards, size, weights)


def test_placement_of_odd_documents(spark):
    docs = odd_documents(spark)
    placed = sharding.place(docs, ["doc_id"], ["a", "b", "c"], 101, spare=["text"])
    assert placed.columns == [*docs.columns, "slot_", "shard"] and placed.count() == docs.count()
    owner = sharding.fill_table(["a", "b", "c"], 101)
    for r in placed.collect():
        assert r.shard == "abc"[owner[r.slot_]]
        if r.doc_id is not None:
            h = xxhash.xxh64_intdigest(r.doc_id.to_bytes(8, "little", signed=True), 42)
            assert r.slot_ == (h - (1 << 64) if h >= 1 << 63 else h) % 101
    assert len({r.slot_ for r in placed.where("doc_id IS NULL").collect()}) == 2
    assert sharding.place(empty(docs), ["doc_id"], ["a"], 101).count() == 0


def test_written_shards_hold_every_row(spark, tmp_path):
    placed = sharding.place(odd_documents(spark), ["doc_id"], ["a", "b"], 101, spare=["text"])
    sharding.write_shards(placed, f"{tmp_path}/shards", salts=3)
    assert rows(spark.read.parquet(f"{tmp_path}/shards"), "doc_id", "shard") == rows(placed, "doc_id", "shard")
