import collections
import math
import zlib

import pytest
import xxhash
from cases import documents, frame, save, with_clashes
from tractlake.llm.sharding import Shard, build_out, op1_sharding, place, slots

U64 = 2**64


def draw(key, child, weight):
    """The same draw in plain Python: xxhash64 of the key's bytes, then of the child's."""
    seed = 42
    if key is not None:
        seed = xxhash.xxh64(key.to_bytes(8, "little", signed=True), seed=seed).intdigest()
    bits = xxhash.xxh64(child.encode(), seed=seed).intdigest() >> 11
    return -math.log((bits + 0.5) * 2.0**-53) / weight


def descend(key, shards):
    def win(weights, prefix):
        return min(sorted(weights), key=lambda c: draw(key, f"{prefix}/{c}", weights[c]))

    regions = collections.Counter()
    for s in shards:
        regions[s.region] += s.weight
    region = win(regions, "") if len(regions) > 1 else shards[0].region
    inside = [s for s in shards if s.region == region]
    racks = collections.Counter()
    for s in inside:
        racks[f"{region}/{s.rack}"] += s.weight
    rack = win(racks, region) if len(racks) > 1 else next(iter(racks))
    leaves = {f"{s.number:09d}": s.weight for s in inside if f"{region}/{s.rack}" == rack}
    return int(win(leaves, rack)) if len(leaves) > 1 else int(next(iter(leaves)))


@pytest.mark.parametrize(
    "shards",
    [
        build_out(24),
        build_out(25, settled=24),
        [Shard(0, "x", "a", 3), Shard(1, "x", "b", 0.5), Shard(2, "y", "a"), Shard(3, "y", "a", 2)],
    ],
)
def test_same_place_as_plain_python(spark, shards):
    keys = [(k,) for k in [*range(200), -5, 2**62, None]]
    placed = place(spark.createDataFrame(keys, "doc_id long"), shards)
    assert {(r.doc_id, r.shard) for r in placed.collect()} == {(k, descend(k, shards)) for (k,) in keys}


def test_shares_follow_the_weights(spark):
    shards = [Shard(0, "x", "a", 6), Shard(1, "x", "b", 2), Shard(2, "y", "a", 1), Shard(3, "y", "a", 0)]
    counts = {r.shard: r["count"] for r in place(spark.range(9000).toDF("doc_id"), shards).groupBy("shard").count().collect()}
    for n, weight in ((0, 6), (1, 2), (2, 1)):
        assert abs(counts[n] - 1000 * weight) < 4 * math.sqrt(1000 * weight)
    assert 3 not in counts


def test_rows_move_only_through_the_part_that_changed(spark):
    before = [Shard(n, f"r{n // 4}", f"k{n // 2 % 2}") for n in range(12)]
    after = [Shard(s.number, s.region, s.rack, 3.0 if s.number == 5 else 1.0) for s in before]
    keys = spark.range(6000).toDF("doc_id")
    both = place(place(keys, before), after, name="new").filter("shard <> new").collect()
    assert both
    for row in both:  # within the region of shard 5, or from elsewhere into it
        assert before[row.new].region == "r1"
        if before[row.shard].region == "r1" and before[row.shard].rack == "k0":
            assert row.new == 5


def test_one_more_shard_takes_rows_only_into_itself(spark):
    keys = spark.range(4000).toDF("doc_id")
    for n in (1, 8, 24, 27):
        moved = place(place(keys, build_out(n, 24)), build_out(n + 1, min(n, 24)), name="new").filter("shard <> new")
        assert {r.new for r in moved.collect()} == {n}


def test_bad_trees_are_refused(spark):
    for shards in ([], [Shard(0, "x", "a", 0)], [Shard(0, "x", "a", -1)], [Shard(0, "x", "a"), Shard(0, "x", "a")]):
        with pytest.raises(ValueError):
            place(spark.range(1).toDF("doc_id"), shards)


def test_slots_have_no_gap(spark):
    rows = [(i % 7, i if i % 3 else None) for i in range(500)] + [(1, 1)] * 50
    df = slots(spark.createDataFrame(rows, "shard int, v long"), ["v"])
    found = collections.defaultdict(list)
    for r in df.collect():
        found[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in found.values())
    assert sum(map(len, found.values())) == len(rows)


def test_query(spark, tmp_path):
    rows = documents()
    out = op1_sharding(spark, save(with_clashes(frame(spark, rows)), tmp_path)).collect()
    wanted = collections.Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key", descend(i, build_out(24)), descend(i, build_out(25, 24)))
        for i, t, *_ in rows
    )
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in out) == wanted
    slot = collections.defaultdict(list)
    for r in out:
        slot[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slot.values())


def test_empty_table(spark, tmp_path):
    assert op1_sharding(spark, save(frame(spark, []), tmp_path)).collect() == []
