"""Sharding by virtual slots: the contract's columns by brute force, and edits of the map."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from weftline.llm import sharding as S


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(2)
    rows = [(k, "é" * rnd.randint(0, 300), "clash") for k in range(700)]
    rows += [(None, None, "x"), (None, "null id", "x"), (None, "null id", "x"), (5, rows[5][1], "x"), (701, "long " * 20_000, None), (702, "", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)


def test_each_row_once_and_bytes_near_equal(docs):
    got = S.sharded(docs.where("doc_id IS NULL OR doc_id != 701"), slots=512).collect()
    raw = lambda r: (r.text or "").encode()
    want = Counter((r.doc_id, len(raw(r)) + 1, zlib.crc32(raw(r))) for r in docs.collect() if r.doc_id != 701)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    by, size = defaultdict(list), Counter()
    for r in got:
        by[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert set(by) == set(range(16)) and all(sorted(x) == list(range(len(x))) for x in by.values())
    in_slot = Counter()
    for r in got:
        in_slot[r.virtual_slot] += r.size
    assert max(size.values()) - min(size.values()) <= max(in_slot.values())
    assert len({(r.virtual_slot, r.shard) for r in got}) == len({r.virtual_slot for r in got})


def test_map_equals_a_plain_fold(spark):
    rnd = random.Random(4)
    size = {k: rnd.randint(0, 50) for k in range(64) if k % 5}
    first = S.first_map(spark, 4, 64)
    sizes = spark.createDataFrame([(k, v, 1) for k, v in size.items()], "virtual_slot int, bytes long, n long")
    got = {r.virtual_slot: r.shard for r in S.rebalanced(first, sizes, 5).collect()}
    share, load, want, free = -(-sum(size.values()) // 5), [(0, 0)] * 5, {}, []
    put = lambda k, b: load.__setitem__(k, (load[k][0] + b, load[k][1] + 1))
    for s in sorted(range(64), key=lambda s: (-size.get(s, 0), s)):
        if load[s % 4][0] + size.get(s, 0) <= share:
            put(s % 4, size.get(s, 0))
            want[s] = s % 4
        else:
            free.append(s)
    for s in free:
        k = load.index(min(load))
        put(k, size.get(s, 0))
        want[s] = k
    assert got == want


def test_a_new_shard_takes_slots_only_into_itself_and_a_lost_one_gives_all(spark):
    sizes = spark.createDataFrame([(k, 10, 1) for k in range(240)], "virtual_slot int, bytes long, n long")
    four = S.first_map(spark, 4, 240)
    was = {r.virtual_slot: r.shard for r in four.collect()}
    five = S.rebalanced(four, sizes, 5)
    now = {r.virtual_slot: r.shard for r in five.collect()}
    assert {now[s] for s in now if now[s] != was[s]} == {4} and sum(now[s] != was[s] for s in now) == 48
    three = {r.virtual_slot: r.shard for r in S.rebalanced(five, sizes, 3, tolerance=0.02).collect()}
    assert set(three.values()) == {0, 1, 2} and max(Counter(three.values()).values()) <= 82


def test_versions_are_kept(spark, tmp_path, docs):
    folder = f"file://{tmp_path}/map"
    S.save_version(S.first_map(spark, 3, 128), folder)
    docs = docs.where("doc_id IS NULL OR doc_id != 701")
    a = {(r.doc_id, r.text_crc32, r.slot): r.shard for r in S.sharded(docs, 3, slots=128, tolerance=0.2, folder=folder).collect()}
    assert S.load_version(spark, folder).first().version == 1 and S.load_version(spark, folder, 0).count() == 128
    again = {(r.doc_id, r.text_crc32, r.slot): r.shard for r in S.sharded(docs, 3, slots=128, tolerance=0.2, folder=folder).collect()}
    assert again == a  # nothing is over its share, so nothing moves
    with pytest.raises(Exception, match="exists|EXISTS"):
        S.save_version(S.first_map(spark, 3, 128), folder)


def test_empty_table(spark, docs):
    assert S.sharded(docs.limit(0)).count() == 0
