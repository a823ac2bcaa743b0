"""Sharding by histogram sort, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from korpusmill.llm.common import cut, fresh, text_size

#: A key has two halves of 60 bits, each probed in five digits of 12 bits.
_BITS, _DIGITS = 12, 5


def _low_edge(node: tuple[int, int, int], digit: int) -> tuple[int, int]:
    """The smallest key (high, low) of a bucket. node: level, high prefix, low prefix."""
    level, high, low = node
    if level < _DIGITS:
        return ((high << _BITS) + digit) << (_BITS * (_DIGITS - 1 - level)), 0
    return high, ((low << _BITS) + digit) << (_BITS * (2 * _DIGITS - 1 - level))


def splitters(keys: DataFrame, n_shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Boundaries between ``n_shards`` shards of near equal bytes.

    keys: ``high``, ``low`` (60 bits each) and ``size``. Each round counts the exact bytes in the buckets between
    candidate boundaries, in one aggregation of at most 4,096 counts for each unsettled boundary. A boundary settles when
    the bytes below it are within ``tolerance`` of a shard of their target; otherwise the bucket around the target is probed
    more finely. A bucket that holds a single high half goes on with the low half at once.
    """
    state = {k: ((0, 0, 0), 0) for k in range(1, n_shards)}  # node, bytes below it
    found: dict[int, tuple[int, int]] = {}
    total = None
    while state:
        nodes = sorted({node for node, _ in state.values()})
        node, digit = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, (level, high, low) in enumerate(nodes):
            if level < _DIGITS:
                inside = F.shiftright("high", _BITS * (_DIGITS - level)) == F.lit(high) if level else F.lit(True)
                here = F.shiftright("high", _BITS * (_DIGITS - 1 - level)).bitwiseAND(F.lit((1 << _BITS) - 1))
            else:
                deep = level - _DIGITS
                inside = (F.col("high") == F.lit(high)) & (F.shiftright("low", _BITS * (_DIGITS - deep)) == F.lit(low) if deep else F.lit(True))
                here = F.shiftright("low", _BITS * (_DIGITS - 1 - deep)).bitwiseAND(F.lit((1 << _BITS) - 1))
            node, digit = F.when(inside, F.lit(i)).otherwise(node), F.when(inside, here).otherwise(digit)
        counts: dict[int, list] = {i: [] for i in range(len(nodes))}
        for r in (
            keys.select(node.alias("node"), digit.alias("digit"), "high", "size").filter(F.col("node").isNotNull())
            .groupBy("node", "digit").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("high").alias("a"), F.max("high").alias("b"))
            .collect()
        ):
            counts[r.node].append(r)
        for rows in counts.values():
            rows.sort(key=lambda r: r.digit)
        if total is None:
            total = sum(r.bytes for r in counts[0])
            if not total:
                return [(1 << 60, 0)] * (n_shards - 1)
        slack, after = tolerance * total / n_shards, {}
        for k, (at, below) in state.items():
            target = total * k / n_shards
            for r in counts[nodes.index(at)]:
                if below + r.bytes >= target:
                    break
                below += r.bytes
            edges = [(abs(below - target), _low_edge(at, r.digit)), (abs(below + r.bytes - target), _low_edge(at, r.digit + 1))]
            level = at[0]
            if min(edges)[0] <= slack or r.n == 1 or level == 2 * _DIGITS - 1:
                found[k] = min(edges)[1]
            elif level < _DIGITS and r.a == r.b:
                after[k] = ((_DIGITS, r.a, 0), below)
            elif level < _DIGITS - 1:
                after[k] = ((level + 1, (at[1] << _BITS) + r.digit, 0), below)
            else:
                after[k] = ((level + 1, at[1], (at[2] << _BITS) + r.digit), below)
        state = after
    return [found[k] for k in range(1, n_shards)]


def _fixed(edge: tuple[int, int]) -> tuple[int, int]:
    """An edge past the last low key of a high key is the first key of the next."""
    return (edge[0] + 1, 0) if edge[1] >= 1 << 60 else edge


def shard(
    docs: DataFrame, n_shards: int = 16, tolerance: float = 0.01, rows_per_task: int = 2_000, broadcast_rows: int = 1_000_000,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """All columns of ``docs`` with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    The law is ``bytes``: shards hold near equal sums of size (UTF-8 bytes of the text plus 1). Rows are sorted by the hash
    of the text, then the hash of the id, and cut at splitters found by :func:`splitters`. Equal texts lie together in one
    shard, unless their group is so large that keeping it whole would miss the tolerance; then it is cut between ids.
    The text moves at most once, in the exchange that numbers the slots.

    Null texts count one byte and group with empty ones; rows with a null id are told apart by their text; rows alike in both
    are interchangeable and stay in one shard; an empty table gives an empty result; columns of ``docs`` named ``shard`` or ``slot`` are replaced.
    """
    docs = docs.drop("shard", "slot")
    high, low, sub, start = (fresh(docs, x) for x in ("high", "low", "sub", "start"))
    half = lambda c: F.shiftrightunsigned(c, 4)
    keyed: Column = half(F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    other: Column = half(F.xxhash64(F.lit("id"), F.col(doc_id), F.when(F.col(doc_id).isNull(), F.col(text))))
    keys = cut(docs.select(keyed.alias("high"), other.alias("low"), (text_size(F.col(text)) + 1).alias("size")))
    at = [_fixed(x) for x in splitters(keys, n_shards, tolerance)]
    n = keys.count()
    parts = max(1, math.ceil(n / n_shards / rows_per_task))

    def places(df: DataFrame, a: str, b: str) -> DataFrame:
        which = F.lit(0)
        for h, lo in at:
            which = which + F.when((F.col(a) > F.lit(h)) | ((F.col(a) == F.lit(h)) & (F.col(b) >= F.lit(lo))), 1).otherwise(0)
        return df.withColumn("shard", which.cast("int")).withColumn(sub, F.pmod(F.col(b), F.lit(parts)).cast("int"))

    starts = places(keys, "high", "low").groupBy("shard", sub).agg(F.count("*").alias("rows")).select(
        "shard", sub, (F.sum("rows").over(W.partitionBy("shard").orderBy(sub).rowsBetween(W.unboundedPreceding, -1))).alias(start),
    )
    if n_shards * parts <= broadcast_rows:  # as many rows at the most
        starts = F.broadcast(starts)
    order = W.partitionBy("shard", sub).orderBy(low, high)
    out = places(docs.withColumns({high: keyed, low: other}), high, low)
    out = out.withColumn("slot", F.row_number().over(order).cast("long") - 1).join(starts, ["shard", sub])
    return out.select(*docs.columns, "shard", (F.col("slot") + F.coalesce(F.col(start), F.lit(0))).alias("slot"))
