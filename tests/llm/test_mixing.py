import random
from fractions import Fraction

import pytest
from common import DOCS, clashing, documents, odd

from pagewarden.llm import mixing
from pagewarden.llm.queries import op9_mix_sources, table


def lag(order, parts):
    """The largest distance of any source from its share, in blocks, over all slots."""
    period, worst, seen = sum(parts.values()), Fraction(0), dict.fromkeys(parts, 0)
    for slot, name in enumerate(order, 1):
        seen[name] += 1
        worst = max(worst, *(abs(Fraction(parts[n] * slot, period) - seen[n]) for n in parts))
    return worst


@pytest.mark.parametrize("seed", range(5))
def test_every_source_is_within_a_block_of_its_share(seed):
    rng = random.Random(seed)
    weights = {f"s{i}": rng.random() ** 4 for i in range(rng.randrange(1, 40))}
    parts = mixing.parts_of(weights, 500)
    assert sum(parts.values()) == 500 and min(parts.values()) >= 1
    order = mixing.period_order(parts)
    assert {n: order.count(n) for n in parts} == parts
    assert lag(order * 2, parts) < 1


def test_too_many_sources():
    with pytest.raises(ValueError):
        mixing.parts_of({i: 1 for i in range(11)}, 10)


@pytest.mark.parametrize("n", [2, 20, 500, 1500])
def test_lag_behind_the_weights_themselves_stays_under_a_block(n):
    rng = random.Random(n)
    weights = {None: n / 2} | {f"s{i}": 0.5 + rng.random() for i in range(n - 1)}
    whole = sum(map(Fraction, weights.values()))
    # Sources of uneven lengths; each is held against its weight until it ends.
    blocks = {name: rng.randrange(1, 40) for name in weights} | {None: 4000}
    slots = mixing.exact_slots(blocks, weights)
    assert {name: len(at) for name, at in slots.items()} == blocks
    assert len({slot for at in slots.values() for slot in at}) == sum(blocks.values())
    for name, at in slots.items():
        share = Fraction(weights[name]) / whole
        assert at == sorted(at)
        for i, slot in enumerate(at):
            # Just before its slot a block is not overdue, just after it is not early.
            assert abs(share * slot - i) < 1 and abs(share * (slot + 1) - (i + 1)) < 1


def test_parts_are_the_nearest_to_the_weights():
    weights = {"large": 500, **{f"s{i}": 500 / 499 for i in range(499)}}
    assert mixing.parts_of(weights)["large"] == 500
    parts = mixing.parts_of({"large": 1000, **{f"s{i}": 1 for i in range(499)}}, 600)
    assert parts["large"] == 101 and sum(parts.values()) == 600


def test_unweighted_sources_come_last():
    slots = mixing.exact_slots({"a": 3, "b": 2, None: 2}, {"a": 1, "b": 0, None: 0})
    assert slots["a"] == [0, 1, 2] and sorted(slots["b"] + slots[None]) == [3, 4, 5, 6]


def test_more_sources_than_a_period_has_slots(spark):
    rows = [(i, "z" * 50, None, f"src{i % 1200}", None) for i in range(2400)]
    mixed = mixing.mix(spark.createDataFrame(rows, DOCS), block_chars=60)
    assert mixed.count() == 2400
    assert mixed.select("source", "block", "slot").distinct().groupBy("slot").count().where("count > 1").count() == 0


def brute(rows, weights, period, block_chars):
    """Slots by walking through the blocks one by one, releases and deadlines included."""
    parts = mixing.parts_of(weights, period)
    blocks = {}
    for name, members in rows.items():
        at = 0
        for doc_id, size in members:
            blocks.setdefault((name, at // block_chars), []).append(doc_id)
            at += size
    out = {}
    last = {name: max((b for n, b in blocks if n == name), default=-1) for name in rows}
    done, slot = dict.fromkeys(parts, 0), 0
    while any(done[n] <= last[n] for n in parts):
        ready = [n for n in parts if done[n] * period // parts[n] <= slot]
        due = {n: -(-(done[n] + 1) * period // parts[n]) for n in ready}
        name = min(ready, key=lambda n: (due[n], n is not None, str(n)))
        for doc_id in blocks.get((name, done[name]), []):
            out[doc_id] = (done[name], slot)
        done[name] += 1
        slot += 1
    return out


def test_slots_match_a_walk(spark):
    rng = random.Random(5)
    frame = documents(spark, ["y" * rng.randrange(0, 400) for _ in range(300)])
    weights = {"src0": 5, "src1": 2, "src2": 1, None: 3}
    mixed = mixing.mix(frame, weights, period=20, block_chars=500, ranges=4).collect()
    by_source = {}
    for r in sorted(mixed, key=lambda r: r["place"]):
        by_source.setdefault(r["source"], []).append((r["doc_id"], len(r["text"])))
    assert {r["doc_id"]: (r["block"], r["slot"]) for r in mixed} == brute(by_source, weights, 20, 500)


def test_no_row_is_lost(spark):
    frame = clashing(odd(spark), "size", "slot", "key", "before")
    mixed = mixing.in_order(mixing.mix(frame))
    assert sorted((r["doc_id"], r["text"]) for r in mixed.na.fill(-1).na.fill("").collect()) == sorted(
        (r["doc_id"], r["text"]) for r in frame.na.fill(-1).na.fill("").collect()
    )
    assert {r["key"] for r in mixed.collect()} == {"extra key"}
    assert mixed.columns.count("slot") == 1


def test_unweighted_source_and_empty_table(spark):
    frame = documents(spark, ["abc"] * 30)
    assert mixing.mix(frame, {"src0": 1}).count() == 30
    assert mixing.mix(frame.limit(0)).count() == 0


def test_query_keeps_every_document_once(spark):
    folder = "/root/testdata/sf0.01"
    rows = op9_mix_sources(spark, folder)
    assert rows.count() == table(spark, folder, "documents").count()
    assert rows.groupBy("slot", "place").count().where("count > 1").count() == 0
    assert rows.groupBy("slot").agg({"source": "count"}).count() > 1


def test_what_is_planned_has_a_bound():
    for total in (10**6, 10**11, 10**14):
        sizes = {None: total // 3, **{f"s{i}": total // 30 for i in range(20)}}
        block, ranges = mixing.granularity(sizes)
        assert sum(n // block + 1 for n in sizes.values()) <= mixing.MOST_BLOCKS + len(sizes)
        assert sizes[None] <= ranges * mixing.RANGE_CHARS < 1 << 50
    assert mixing.granularity({"a": 5}) == (mixing.BLOCK_CHARS, mixing.RANGES)
    assert mixing.granularity({}) == (mixing.BLOCK_CHARS, mixing.RANGES)


def test_rows_follow_a_walk(spark):
    """Blocks, slots and places of the default way, held against one walk through each source."""
    rng = random.Random(3)
    texts = ["w" * rng.randrange(0, 400) for _ in range(300)]
    frame = documents(spark, texts)
    rows = mixing.mix(frame, block_chars=500, ranges=4).collect()
    assert len(rows) == 300
    by_source = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        by_source.setdefault(r["source"], []).append(r)
    sizes = {name: sum(len(r["text"]) for r in some) for name, some in by_source.items()}
    weights = {name: max(1.0, float(size) ** 0.5) for name, size in sizes.items()}
    slots = mixing.exact_slots({name: size // 500 + 1 for name, size in sizes.items()}, weights)
    for name, some in by_source.items():
        before = 0
        for r in some:
            assert r["block"] == before // 500 and r["slot"] == slots[name][before // 500]
            before += len(r["text"])
    order = [(r["slot"], r["place"]) for r in mixing.in_order(mixing.mix(frame, block_chars=500)).collect()]
    assert order == sorted(order)
