"""Percentiles with bounded error from summaries that can be combined (problem 4).

A q-digest: values are quantized to a bounded ordered universe, the leaves of a dyadic tree. A summary holds counts of tree
nodes; nodes with small counts are merged into their parents. Summaries are merged by adding the counts of equal nodes, so
those of partitions and days combine in any order. A node covers a range of values; the counts of nodes above a leaf bound
the rank error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.runtime import ship

#: Values below 2**MANTISSA are their own code; larger ones keep this many leading bits, a relative error under 2**-MANTISSA.
MANTISSA = 12
#: Levels of the tree: the codes of 63-bit values fit into LEVELS - 1 bits; negative values have the other half of the leaves.
LEVELS = 19
_ZERO = 1 << (LEVELS - 1)
#: Rank error allowed, as a share of a group's values.
EPSILON = 0.001
#: Rows of a partition that are summarised together.
BATCH_ROWS = 1 << 19
#: Parts that every group is split into before it is summarised, so that none, however large, is one task's.
PARTS = 256


def code_of_array(values: np.ndarray) -> np.ndarray:
    """The leaves of values, in their order; -1 - v mirrors v."""
    v = values.astype(np.int64)
    sign = v >> 63
    v = v ^ sign
    bits = np.frexp(v.astype(np.float64))[1]
    bits = np.where((v >> np.maximum(bits - 1, 0)) == 0, bits - 1, bits)
    shift = np.maximum(bits - (MANTISSA + 1), 0)
    return (((shift.astype(np.int64) << MANTISSA) + (v >> shift)) ^ sign) + _ZERO


def value_range(leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of leaves."""
    signed = leaf - _ZERO
    sign = signed >> 63
    code = signed ^ sign
    shift = np.maximum((code >> MANTISSA) - 1, 0)
    low = (code - (shift << MANTISSA)) << shift
    high = low + (np.int64(1) << shift) - 1
    return np.where(sign < 0, -1 - high, low), np.where(sign < 0, -1 - low, high)


def compress(groups: np.ndarray, nodes: np.ndarray, counts: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge small nodes into their parents, for all groups at once; groups are numbered from 0.

    Nodes are heap numbers: the leaf of a code is 2**LEVELS + code, a node's parent is half of it. Going up level by level, a
    pair of children and their parent with no more than epsilon * n / LEVELS values together become the parent. A group's
    greatest leaf stays, so that the greatest value isn't lost.
    """
    totals = np.bincount(groups, weights=counts)
    allowed = np.floor(epsilon * totals / LEVELS)
    greatest = np.zeros(len(totals), dtype=np.int64)
    np.maximum.at(greatest, groups, nodes)
    done_g, done_n, done_c = [], [], []
    key = (groups.astype(np.int64) << (LEVELS + 1)) | nodes
    for level in range(LEVELS, 0, -1):
        deep = (key & ((1 << (LEVELS + 1)) - 1)) >= (1 << level)
        here, here_c = key[deep], counts[deep]
        key, counts = key[~deep], counts[~deep]
        here, here_c = _added(here, here_c)
        g, node = here >> (LEVELS + 1), here & ((1 << (LEVELS + 1)) - 1)
        parents = (g << (LEVELS + 1)) | (node >> 1)
        both, both_c = _added(np.concatenate([parents, key]), np.concatenate([here_c, counts]))
        family = both_c[np.searchsorted(both, parents)]
        small = (family <= allowed[g]) & (node != greatest[g])
        done_g.append(g[~small])
        done_n.append(node[~small])
        done_c.append(here_c[~small])
        key, counts = _added(np.concatenate([key, parents[small]]), np.concatenate([counts, here_c[small]]))
    done_g.append(key >> (LEVELS + 1))
    done_n.append(key & ((1 << (LEVELS + 1)) - 1))
    done_c.append(counts)
    return np.concatenate(done_g), np.concatenate(done_n), np.concatenate(done_c)


def _added(key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key, counts
    order = np.argsort(key, kind="stable")
    key, counts = key[order], counts[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(counts, first)


def parts(records: DataFrame, keys: list[str], metrics: list[str], record_id: str, by: list[str] | None = None, epsilon: float = EPSILON) -> DataFrame:
    """(*keys, metric, node, n): summaries of the parts of each group and metric, from one row a record.

    Repeated rows of a record count once. Null values don't count; null keys make groups of their own. Records are moved once,
    by ``by`` (keys that are summed up later; all keys if not given) and one of PARTS parts of each, which also finds repeated rows; every partition summarises what it
    holds, so a group that holds a third of all rows costs no task more than its share, and equal nodes meet before anything
    else is shuffled. Put a day among the keys for summaries that are kept and combined later.
    """
    ship(records.sparkSession)
    by = keys if by is None else by
    part = F.pmod(F.xxhash64(record_id), F.lit(PARTS)).cast("int")
    moved = records.select(record_id, *keys, *metrics, part.alias("_part")).repartition(*by, "_part")
    once = moved.dropDuplicates([record_id, *keys, "_part"]).drop(record_id, "_part")
    kinds = dict(once.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", metric string, node long, n long"

    def summarised(table: pa.Table) -> Iterator[pa.RecordBatch]:
        label = np.zeros(len(table), dtype=np.int64)
        for name in keys:
            codes = pc.dictionary_encode(table[name].combine_chunks(), null_encoding="encode")
            label = np.unique(label * len(codes.dictionary) + codes.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        _, first = np.unique(label, return_index=True)
        for metric in metrics:
            values = table[metric].combine_chunks()
            valid = values.is_valid().to_numpy(zero_copy_only=False)
            if not valid.any():
                continue
            codes = code_of_array(values.fill_null(0).to_numpy()[valid])
            g, node, n = compress(label[valid], codes + (1 << LEVELS), np.ones(valid.sum(), dtype=np.int64), epsilon)
            rows = table.select(keys).take(first[g]).append_column("metric", pa.array([metric] * len(g), pa.string()))
            yield from rows.append_column("node", pa.array(node)).append_column("n", pa.array(n.astype(np.int64))).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BATCH_ROWS:
                yield from summarised(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield from summarised(pa.Table.from_batches(held))

    return once.mapInArrow(run, schema)


def digests(records: DataFrame, keys: list[str], metrics: list[str], record_id: str, epsilon: float = EPSILON) -> DataFrame:
    """(*keys, metric, node, n): one summary of each group and metric; see ``parts``."""
    return merge(parts(records, keys, metrics, record_id, None, epsilon), keys)


def merge(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Add summaries of partitions or days: (*keys, metric, node, n)."""
    return summaries.groupBy(*keys, "metric", "node").agg(F.sum("n").alias("n"))


def compacted(merged: DataFrame, keys: list[str], epsilon: float = EPSILON) -> DataFrame:
    """Merged summaries compressed again, for keeping: at most 3 * LEVELS / epsilon nodes a group, however much was merged.

    The rank error adds to that of the summaries merged. A group has no more nodes than the tree, so one task holds it.
    """
    ship(merged.sparkSession)
    group, kinds = [*keys, "metric"], dict(merged.dtypes)

    def run(table: pa.Table) -> pa.Table:
        _, node, n = compress(np.zeros(len(table), dtype=np.int64), table["node"].to_numpy(), table["n"].to_numpy(), epsilon)
        return table.select(group).take(np.zeros(len(node), dtype=np.int64)).append_column("node", pa.array(node)).append_column("n", pa.array(n.astype(np.int64)))

    return merged.select(*group, "node", "n").groupBy(*group).applyInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in group) + ", node long, n long")


def quantiles(merged: DataFrame, keys: list[str], shares: list[float], epsilon: float = EPSILON) -> DataFrame:
    """(*keys, metric, share, values, low, estimate, high, rank_error) of each group.

    Nodes in order of their greatest leaf, smaller ranges first, are run through until the wanted rank is reached; the
    answer is that node's greatest leaf, or the group's if that is smaller; its values lie between low and high. Its rank is off by at most rank_error. A
    group has no more nodes than the tree, whatever the number of its records, so one task can hold it.
    """
    ship(merged.sparkSession)
    group, kinds = [*keys, "metric"], dict(merged.dtypes)

    def run(table: pa.Table) -> pa.Table:
        node, n = table["node"].to_numpy(), table["n"].to_numpy()
        above = LEVELS + 1 - np.frexp(node.astype(np.float64))[1]
        last = ((node + 1) << above) - 1 - (1 << LEVELS)
        order = np.lexsort((above, last))
        upto = np.cumsum(n[order])
        ranks = np.maximum(np.ceil(np.array(shares) * upto[-1]), 1)
        leaf = np.minimum(last[order[np.searchsorted(upto, ranks)]], last[above == 0].max())
        low, high = value_range(leaf)
        out = table.select(group).take(np.zeros(len(shares), dtype=np.int64))
        columns = {"share": np.array(shares, dtype=float), "values": np.full(len(shares), upto[-1]), "low": low, "estimate": np.round((low + high) / 2.0, 3), "high": high, "rank_error": np.full(len(shares), int(upto[-1] * epsilon))}
        for name, values in columns.items():
            out = out.append_column(name, pa.array(values))
        return out

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in group) + ", share double, values long, low long, estimate double, high long, rank_error long"
    return merged.select(*group, "node", "n").groupBy(*group).applyInArrow(run, schema)


def rank_check(records: DataFrame, answers: DataFrame, keys: list[str], metrics: list[str], record_id: str) -> DataFrame:
    """(*keys, metric, share, n_values, within): whether each answer of ``quantiles`` keeps its stated rank error, from exact ranks.

    The values of a group are counted before they meet its answers, whose number depends on the groups only.
    """
    once = records.select(record_id, *keys, *metrics).dropDuplicates([record_id])
    long = once.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics))).alias("x")).select(*keys, "x.metric", "x.v")
    counted = long.where("v is not null").groupBy(*keys, "metric", "v").agg(F.count("*").alias("_n"))
    same = [counted[c].eqNullSafe(answers[c]) for c in (*keys, "metric")]
    met = counted.join(answers, same).select(*(answers[c] for c in (*keys, "metric")), "share", "low", "high", "rank_error", "v", "_n")
    summed = met.groupBy(*keys, "metric", "share", "rank_error").agg(
        F.sum("_n").alias("n_values"), F.sum(F.when(F.col("v") < F.col("low"), F.col("_n")).otherwise(0)).alias("_below"), F.sum(F.when(F.col("v") <= F.col("high"), F.col("_n")).otherwise(0)).alias("_upto")
    )
    rank = F.greatest(F.ceil(F.col("share") * F.col("n_values")), F.lit(1))
    within = (F.col("_below") - F.col("rank_error") < rank) & (rank <= F.col("_upto") + F.col("rank_error"))
    return summed.select(*keys, "metric", "share", "n_values", within.alias("within"))
