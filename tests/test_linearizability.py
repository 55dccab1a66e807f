"""Linearizability by composed segments, against all orders of small histories."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tidemill import schemas
from tidemill.config import CHUNK_EVENTS
from tidemill.operators import linearizability as lin


def by_all_orders(ops):
    """Some order of all known operations and of some unknown puts respects time and values."""
    known, lost = [o for o in ops if o[1] < lin.NEVER], [o for o in ops if o[1] >= lin.NEVER]
    for mask in range(1 << len(lost)):
        some = known + [o for k, o in enumerate(lost) if mask >> k & 1]
        for order in permutations(some):
            value, good = None, True
            for i, (call, _, put, x) in enumerate(order):
                if any(later[1] < call for later in order[i + 1 :]) or (not put and value != x):
                    good = False
                    break
                value = x if put else value
            if good:
                return True
    return False


def history(r, n):
    ops = []
    for _ in range(n):
        call = r.randrange(20)
        put = r.random() < 0.5
        lost = put and r.random() < 0.3
        ops.append((call, lin.NEVER if lost else call + r.choice([1, 2, 6]), put, r.choice("ab") if put or r.random() < 0.8 else None))
    return ops


def test_search_equals_all_orders():
    r = random.Random(1)
    seen = {True: 0, False: 0}
    for _ in range(700):
        ops = history(r, r.randrange(1, 7))
        want = by_all_orders(ops)
        seen[want] += 1
        assert lin.linearizable(ops) == want, ops
    assert min(seen.values()) > 50


def cut(ops):
    """The segments of a history, as ``segments`` cuts them."""
    parts, until = [], -1
    for o in sorted(ops, key=lambda o: o[:2]):
        if not parts or (until < 0 or o[0] > until):
            parts.append([])
        parts[-1].append(o)
        until = max(until, o[1] if o[1] < lin.NEVER else -1)
    return parts


def test_composed_segments_equal_all_orders():
    r = random.Random(2)
    many = 0
    for _ in range(700):
        ops = history(r, r.randrange(2, 8))
        lost = {o[3] for o in ops if o[1] >= lin.NEVER}
        parts = [lin.relations((*o, o[3] in lost) for o in p) for p in cut(ops)]
        many += len(parts) > 2
        whole = lin._NOTHING
        for p in parts:
            whole = lin.compose(whole, p)
        assert lin.holds_from(whole) == by_all_orders(ops), ops
        right = lin._NOTHING
        for p in reversed(parts):
            right = lin.compose(p, right)
        assert lin.holds_from(right) == lin.holds_from(whole) and lin._relation(lin._text(whole)) == whole
    assert many > 100


def frame(spark, histories):
    rows = [(0, "put" if p else "get", k, v if v is not None else "", v is not None, ret >= lin.NEVER, call, -1 if ret >= lin.NEVER else ret) for k, ops in histories.items() for call, ret, p, v in ops]
    return spark.createDataFrame(rows, schemas.OPS)


def test_check_equals_all_orders(spark):
    r = random.Random(3)
    histories = {f"k{i}": history(r, r.randrange(1, 8)) for i in range(60)} | {None: history(r, 5)}
    for how in ({}, {"block_ops": 1, "fan": 2, "chunk": 2}):
        got = {x["key"]: (x["ops"], x["linearizable"]) for x in lin.check(frame(spark, histories), **how).collect()}
        assert got == {k: (len(ops), by_all_orders(ops)) for k, ops in histories.items()}
    assert lin.check(frame(spark, {})).count() == 0


@pytest.mark.parametrize("stale", [None, 5_001])
def test_a_hot_key_spreads(spark, stale):
    """One key of 20,000 operations, up to three at a time, with unknown puts, is cut into many blocks; one old value in the middle is found."""
    n = F.col("id")
    last = n - n % 3
    value = F.when(n == stale, "3") if stale else F.when(F.lit(False), "")
    ops = spark.range(20_000).select(
        F.lit(0).alias("client"), F.when(n % 3 == 0, "put").otherwise("get").alias("kind"), F.lit("hot").alias("key"), value.otherwise(last.cast("string")).alias("value"), F.lit(True).alias("found"),
        ((n % 3 == 0) & (n % 30 == 0)).alias("unknown"), (n * 10).alias("call_ns"), (n * 10 + 5 + n % 7 * 4).alias("ret_ns"),
    )
    parts = lin.segments(ops).withColumn("block", F.floor(F.col("segment") / 500))
    assert parts.groupBy("block").count().agg(F.max("count")).first()[0] < 520 and parts.select("block").distinct().count() == 40
    got = lin.check(ops, block_ops=500, fan=4).first()
    assert (got["ops"], got["linearizable"]) == (20_000, stale is None)


def test_unknown_puts_are_carried_across_cuts(spark):
    put, get = (lambda c, v: (c, lin.NEVER, True, v)), (lambda c, v: (c, c + 1, False, v))
    known = lambda c, v: (c, c + 1, True, v)
    once = [put(0, "x"), known(10, "a"), get(20, "x")]
    twice = [*once, known(30, "b"), get(40, "x")]
    two = [put(1, "x"), *twice]
    early = [known(10, "a"), get(20, "x"), put(30, "x")]
    got = {x["key"]: x["linearizable"] for x in lin.check(frame(spark, {"once": once, "twice": twice, "two": two, "early": early}), block_ops=1, fan=2, chunk=CHUNK_EVENTS).collect()}
    assert got == {"once": True, "twice": False, "two": True, "early": False}
