"""Whether a register history is linearizable, key by key, for keys of any length.

No order of effects can cross a moment at which nothing is pending. So a key's operations are cut there into segments, and each segment is searched by itself for the relation
between the value before it and the value after it. Relations compose, so blocks of segments become one relation each in their own tasks, and the blocks' relations are composed up a
tree; no task sees a whole key. What can't be cut is a segment: its concurrency bounds the search.

A put whose outcome is unknown may take effect at any time after its call, once, or never. It matters only where its value is read, so it is taken to act right before
such a read. A relation therefore also says how many of these puts it needs from segments before it, and how many of its own it leaves to those after it.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CHUNK_EVENTS
from .ordering import earlier, numbered

NEVER = 1 << 62
#: Whole segments that begin within so many operations of a key are one task's group; so many relations are composed at a time.
BLOCK_OPS, FAN = 2048, 64
#: Operations of a key are numbered in slots of so many nanoseconds of their calls.
SLOT_NS = 60_000_000_000
_ANY, _SAME = ("any",), ("same",)

#: (value before, value after, puts needed, puts left): values are ("is", value), any value, or the same as before; puts are sorted pairs (value, number).
Relation = tuple[tuple, tuple, tuple, tuple]
#: call, return, is a put, value (None: not found), whether the key has puts of unknown outcome of the value, and gets that read it
Op = tuple[int, int, bool, str | None, bool]


def _more(counts: tuple, value: str, by: int = 1) -> tuple:
    c = Counter(dict(counts))
    c[value] += by
    return tuple(sorted((+c).items()))


def relations(ops: Iterable[Op]) -> set[Relation]:
    """All relations of a segment; none: it can't be linearized whatever came before."""
    ops = sorted(ops, key=lambda o: o[:2])
    pending = [(o[0], o[3]) for o in ops if o[1] >= NEVER and o[4]]
    ops = [o for o in ops if o[1] < NEVER]
    own = Counter(v for _, v in pending)
    found, start = set(), (0, frozenset(), _ANY, _SAME, (), ())
    stack, seen = [start], {start}
    while stack:
        low, ahead, first, now, needs, used = stack.pop()
        if low == len(ops):
            found.add((first, now, needs, tuple(sorted((own - Counter(dict(used))).items()))))
            continue
        ready, until = [], NEVER  # what was called before anything left has returned
        for i in range(low, len(ops)):
            if i in ahead:
                continue
            if ops[i][0] > until:
                break
            ready.append(i)
            until = min(until, ops[i][1])
        for i in ready:
            _, _, put, value, maybe = ops[i]
            holds = ("is", value)
            nexts = []
            if put:
                nexts.append((first, holds, needs, used))
            elif now == holds or (now == _SAME and first == holds):
                nexts.append((first, now, needs, used))
            else:
                if now == _SAME and first == _ANY:
                    nexts.append((holds, now, needs, used))
                if maybe:
                    if sum(c <= until and v == value for c, v in pending) > dict(used).get(value, 0):
                        nexts.append((first, holds, needs, _more(used, value)))
                    else:  # one of its own is never worse, as another would stay for later
                        nexts.append((first, holds, _more(needs, value), used))
            if not nexts:
                continue
            at, then = low, ahead | {i}
            while at in then:
                then -= {at}
                at += 1
            for n in nexts:
                state = (at, then, *n)
                if state not in seen:
                    seen.add(state)
                    stack.append(state)
    return _best(found)


def compose(left: set[Relation], right: set[Relation]) -> set[Relation]:
    """The relation of two stretches, one after the other."""
    found = set()
    for first, now, needs, leaves in left:
        for then, after, more, rest in right:
            value = first if now == _SAME else now
            if then != _ANY and value not in (_ANY, then):
                continue
            free, needed, kept = Counter(dict(leaves)), Counter(dict(needs)), Counter(dict(rest))
            asked = Counter(dict(more))
            needed += asked - free
            kept += free - asked
            begins = then if value == _ANY else first
            ends = now if after == _SAME else after
            found.add((begins, ends, tuple(sorted(needed.items())), tuple(sorted(kept.items()))))
    return _best(found)


def _best(found: set[Relation]) -> set[Relation]:
    """Without relations to which another of the same values is as good: it needs no more, and what it leaves beyond its needs is no less."""
    if len(found) < 2:
        return found

    def as_good(q: Relation, r: Relation) -> bool:
        a, b, c, d = (Counter(dict(x)) for x in (q[2], r[2], q[3], r[3]))
        return q[:2] == r[:2] and not a - b and all(c[v] - a[v] >= d[v] - b[v] for v in {*a, *b, *c, *d})

    kept: set[Relation] = set()
    for r in sorted(found, key=lambda r: sum(n for _, n in r[2])):
        if not any(as_good(q, r) for q in kept):
            kept = {q for q in kept if not as_good(r, q)} | {r}
    return kept


def holds_from(relation: set[Relation], value: str | None = None) -> bool:
    """Whether a stretch is linearizable if the register has this value before it."""
    return any(first in (_ANY, ("is", value)) and not needs for first, _, needs, _ in relation)


_NOTHING: set[Relation] = {(_ANY, _SAME, (), ())}


def linearizable(ops: list[tuple[int, int, bool, str | None]]) -> bool:
    """One short history at once. ops: (call, return (NEVER: unknown), is a put, value)."""
    unknown = {o[3] for o in ops if o[1] >= NEVER}
    return holds_from(_best(relations((*o, o[3] in unknown) for o in ops)))


def _text(relation: set[Relation]) -> str:
    return json.dumps(sorted(relation, key=repr))


def _relation(text: str) -> set[Relation]:
    pairs = lambda xs: tuple((v, n) for v, n in xs)
    return {(tuple(a), tuple(b), pairs(c), pairs(d)) for a, b, c, d in json.loads(text)}


def segments(ops: DataFrame, chunk: int = CHUNK_EVENTS, slot_ns: int = SLOT_NS) -> DataFrame:
    """key (not null), nth (the operation's number in its key), segment (the number of its segment's first), call, ret, put, value and maybe. Gets of unknown outcome say nothing and are left out."""
    put = F.col("kind") == "put"
    rows = ops.where(put | ~F.col("unknown")).select(
        "key", F.col("call_ns").alias("call"), F.when(F.col("unknown"), F.lit(NEVER)).otherwise(F.col("ret_ns")).alias("ret"), put.alias("put"), F.when(put | F.col("found"), F.col("value")).alias("value")
    )
    both = rows.groupBy("key", "value").agg(F.bool_or(F.col("ret") == NEVER).alias("lost"), F.bool_or(~F.col("put")).alias("read")).where("lost and read")
    rows = rows.join(both.select("key", "value", F.lit(True).alias("maybe")), ["key", "value"], "left").withColumn("maybe", F.coalesce("maybe", F.lit(False)))
    rows = numbered(rows, ["key"], "call", slot_ns, "nth", "ret", "value").withColumn("known", F.when(F.col("ret") < NEVER, F.col("ret")))
    rows = earlier(rows, ["key"], "nth", chunk, F.max, "known", "until")
    rows = rows.withColumn("cut", F.when(F.col("until").isNull() | (F.col("call") > F.col("until")), F.col("nth")))
    rows = earlier(rows, ["key"], "nth", chunk, F.max, "cut", "begun")
    return rows.select("key", "nth", F.coalesce("cut", "begun").alias("segment"), "call", "ret", "put", "value", "maybe")


def check(ops: DataFrame, block_ops: int = BLOCK_OPS, fan: int = FAN, chunk: int = CHUNK_EVENTS) -> DataFrame:
    """key, number of operations and whether they are linearizable. A null key is a key; gets of unknown outcome count but say nothing."""
    ops = ops.withColumn("key", F.coalesce(F.concat(F.lit("="), "key"), F.lit("")))  # joins lose null keys
    counts = ops.groupBy("key").agg(F.count("*").alias("ops"))
    rows = segments(ops, chunk).withColumn("block", F.floor(F.col("segment") / block_ops))
    kind = "key string, block long, relation string"

    def search(name: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("nth")
        whole = _NOTHING
        for _, own in part.groupby("segment", sort=True):
            values = [None if pd.isna(v) else v for v in own["value"]]
            whole = compose(whole, relations(zip(own["call"].tolist(), own["ret"].tolist(), own["put"].tolist(), values, own["maybe"].tolist(), strict=True)))
        return pd.DataFrame({"key": [name[0]], "block": [name[1]], "relation": [_text(whole)]})

    def climb(name: tuple, part: pd.DataFrame) -> pd.DataFrame:
        whole = reduce(compose, map(_relation, part.sort_values("block")["relation"]), _NOTHING)
        return pd.DataFrame({"key": [name[0]], "block": [name[1]], "relation": [_text(whole)]})

    tree = rows.groupBy("key", "block").applyInPandas(search, kind)
    longest = counts.agg(F.coalesce(F.max("ops"), F.lit(1))).first()[0]
    width = longest // block_ops + 1
    while True:
        tree = tree.groupBy("key", F.floor(F.col("block") / fan).alias("block")).applyInPandas(climb, kind)
        width = -(-width // fan)
        if width <= 1:
            break
    good = F.udf(lambda text: holds_from(_relation(text)), "boolean")  # one row a key
    done = tree.select("key", good("relation").alias("linearizable"))
    name = F.when(F.col("key") != "", F.substr("key", F.lit(2)))
    return counts.join(done, "key", "left").select(name.alias("key"), "ops", F.coalesce("linearizable", F.lit(True)).alias("linearizable"))


def example_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts and gets, up to three of a key at a time, a third of them of one key. Each operation acts when it is called, so all is linearizable, also where every tenth put's outcome is unknown;
    but in key k3 one get returns the first value again."""
    key = F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("event_id") % 16))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", key.alias("key"))
    rows = numbered(rows, ["key"], "event_id", CHUNK_EVENTS, "n")
    n = F.col("n")
    put: Column = n % 3 == 0
    stale = (F.col("key") == "k3") & (n == 31)
    return rows.select(
        F.lit(0).alias("client"), F.when(put, "put").otherwise("get").alias("kind"), "key", F.when(stale, "0").otherwise((n - n % 3).cast("string")).alias("value"),
        F.lit(True).alias("found"), (put & (n % 30 == 0)).alias("unknown"), (n * 10).alias("call_ns"), (n * 10 + 5 + n % 7 * 4).alias("ret_ns"),
    )
