import random

import pytest
from pyspark.sql import functions as F

from harbinger.llm.packing import pack, pack_documents, pack_lengths, sequence_cost


def plain_best_fit(lengths, bins):
    """Where each length goes when every opened capacity is known: least room left, first of equals."""
    room, where = [], []
    for n in lengths:
        fits = [(r, b) for b, r in enumerate(room) if r >= n]
        if fits:
            b = min(fits)[1]
        else:
            b = len(room)
            room.append(bins[b])
        room[b] -= n
        where.append(b)
    return where


def test_best_fit_and_downsizing():
    draw = random.Random(4)
    sizes = (16, 32, 64)
    costs = tuple(map(sequence_cost, sizes))
    for _ in range(40):
        lengths = sorted((draw.randint(1, 64) for _ in range(draw.randint(1, 60))), reverse=True)
        where, final = pack_lengths(lengths, sizes, costs)
        load = [sum(n for n, b in zip(lengths, where) if b == k) for k in range(len(final))]
        assert all(f == min(c for c in sizes if c >= n) for f, n in zip(final, load))
        assert set(where) == set(range(len(final)))
        # a piece opens a sequence only when none that is open has room at its opened size or more
        opened = {b: max(n for n, w in zip(lengths, where) if w == b) for b in set(where)}
        assert all(opened[b] <= final[b] for b in opened)


def test_opens_the_cheapest_length():
    sizes, costs = (10, 20), (10.0, 15.0)
    where, final = pack_lengths([9, 9, 9], sizes, costs)
    assert final == [20, 10] and where == [0, 0, 1]
    where, final = pack_lengths([9, 9], sizes, (10.0, 40.0))
    assert final == [10, 10]
    assert where == plain_best_fit([9, 9], [10, 10])


def test_pieces_cover_every_row(spark, documents):
    lengths = F.when(F.col("doc_id") == 9, 100).otherwise(F.col("n_chars") % 9)
    out = pack(documents, lengths, (8, 16)).collect()
    want = {}
    for r in documents.select("doc_id", lengths.alias("n")).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + (r.n or 0)
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    bins = {}
    for r in out:
        if r.length:
            bins.setdefault((r.shard, r.bin_no, r.capacity), []).append((r.offset, r.length))
    for (_, _, capacity), parts in bins.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and (capacity == 8 or at > 8)
    assert all(r.bin_no is None for r in out if r.length == 0)


def test_empty_and_bad_input(empty, documents):
    assert pack_documents(empty).collect() == []
    assert pack_documents(documents).where("length > 0").agg(F.sum("length")).first()[0] > 60_000
    with pytest.raises(ValueError):
        pack(documents, F.lit(1), ())


def exhaustive_open(length, waiting, capacities, costs):
    """Piece by piece, the largest that fits, to the end; the cheapest length for each token held."""
    rates = []
    for capacity, cost in sorted(zip(capacities, costs, strict=True)):
        if capacity >= length:
            left = capacity - length
            for piece in sorted(waiting, reverse=True):
                if piece <= left:
                    left -= piece
            rates.append((cost / (capacity - left), capacity))
    return min(r for r in rates)[1] if rates else None


def exhaustive_pack(lengths, capacities, costs):
    open_, bins = [], []
    for at, length in enumerate(lengths):
        fits = [(left, b) for b, left in enumerate(open_) if left >= length]
        if fits:
            b = min(fits)[1]
        else:
            b = len(open_)
            capacity = exhaustive_open(length, lengths[at + 1 :], capacities, costs)
            open_.append(capacity)
            bins.append([])
        open_[b] -= length
        bins[b].append(length)
    return sorted(sum(b) for b in bins)


def test_equals_exhaustive_packing():
    draw = random.Random(6)
    for _ in range(60):
        capacities = tuple(sorted(draw.sample([16, 32, 64, 128, 200], 3)))
        costs = tuple(c * draw.uniform(0.5, 1.5) for c in capacities)
        lengths = sorted((draw.randint(1, draw.choice([3, 40, capacities[-1]])) for _ in range(draw.randint(1, 150))), reverse=True)
        lengths = [min(x, capacities[-1]) for x in lengths]
        where, bins = pack_lengths(lengths, capacities, costs)
        sums = {}
        for b, length in zip(where, lengths, strict=True):
            sums[b] = sums.get(b, 0) + length
        assert sorted(sums.values()) == exhaustive_pack(lengths, capacities, costs)
        assert all(bins[b] == min(c for c in capacities if c >= s) for b, s in sums.items())


def test_many_short_pieces_fill_the_cheapest_length():
    _, bins = pack_lengths([11] * 2000, (512, 1024, 2048, 4096), (512.0, 1000.0, 1900.0, 3500.0))
    # 372 pieces fill 4,096 all but 4 tokens; the last 140 pieces are cheapest in shorter ones
    assert sorted(bins) == [512, 512, 1024] + [4096] * 5


def test_rows_without_an_id_spread(spark):
    frame = spark.range(9000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"))
    out = pack_documents(frame)
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert sum(sizes) == 9000 and len(sizes) == 5 and max(sizes) < 3000
