"""Answers that break off (problem 2).

Two kinds of evidence are combined as log odds. Length: for each source, right-censored log-normal length distributions are
fitted by maximum likelihood at candidate limits (in characters and in bytes); at each accepted limit, of which a source may
have several, the censoring posterior is the share of values there that the uncensored density does not explain. Ending: its
form (unclosed JSON, fences, quotations, table rows, broken characters) and a terminal-context model, which says how often the
characters before the end are followed by the end of a unit and how often the text goes on. What a context ratio tells is not
set by hand: answers at the limits, weighted by their censoring posterior, say how the contexts of cut answers are spread, and
the ends of whole sentences with their mark taken off how those of complete ones are. Away from limits each source has its own
rate of breaking off, fitted with these two spreads.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm import answers as A
from folioforge.llm.endings import CELLS, Endings, learned, with_cells
from folioforge.llm.visual import visual_form
from folioforge.runtime import cut, ship, spread

#: Share of answers whose end only the context can tell that break off away from any limit, before anything is fitted.
BASE_RATE = 0.05
#: Rows that what is known before anything is fitted counts as: what a context's counts say by themselves, and BASE_RATE.
PRIOR_ROWS = 20
#: Log odds of an unclosed form (JSON, fence, quotation, table row, broken character): its end is missing by definition.
OPEN_ODDS = 10.0
#: A limit is accepted if so many answers lie at it, and so many times more than the density explains.
LEAST_AT_LIMIT, LEAST_RATIO = 6, 5.0
#: ... and if at least this share of those have an ending that isn't closed.
LEAST_UNCLOSED = 0.3
#: Where longer answers are more, or the ratio is less: logarithm of the chance that any length of a source has so many.
LOG_CHANCE = math.log(1e-4)
_EVIDENCE = "result_id string, variant string, n_chars int, n_bytes int, state string, hashes array<long>, defect string, given double, adds boolean, foreign boolean"
_TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
_SCHEMA = pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in _EVIDENCE.split(", "))])


def _read(batches: Iterator[pa.RecordBatch], model: Endings, all_defects: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        rows = list(zip(*(batch[c].to_pylist() for c in ("result_id", "variant", "question", "answer")), strict=True))
        forms = [None if A.carries_nothing(row[3]) else visual_form(row[3]) for row in rows]
        bare = A.bare_forms([f or "" for f in forms])
        for (result_id, variant, question, answer), form, own_letters in zip(rows, forms, bare, strict=True):
            question = question or ""
            if form is None:
                out.append((result_id, variant, 0, 0, None, None, "empty", None, True, False))
                continue
            kept = answer.rstrip("\ufffd")
            size = (len(answer), len(kept.encode("utf-8", "surrogatepass")))
            given, adds = A.beyond_question(question, own_letters)
            defect = "refusal" if all_defects and A.refuses(form, model.phrases) else None
            state, stem = A.ending(answer)
            # Closed sentences, their marks taken off, are examples of complete ends.
            whole = stem.rstrip(A.TERMINAL) if state == "closed" and stem[-1:] in A.TERMINAL else ""
            hashes = A.context_hashes(whole or stem) if whole or state.startswith("ask") else None
            foreign = all_defects and defect is None and A.other_language(question, answer)
            out.append((result_id, variant, *size, state, hashes, defect, given, adds, foreign))
        columns = list(zip(*out, strict=True)) or [()] * len(_SCHEMA)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def answer_evidence(results: DataFrame, all_defects: bool) -> DataFrame:
    """One narrow row an answer: length, state of the ending, its context ratio, what it adds to its question, defects seen in the pair."""
    spark = ship(results.sparkSession)
    model = spark.sparkContext.broadcast(learned(results, phrases=all_defects))
    read = spread(results.select("result_id", "variant", "question", "answer")).mapInArrow(lambda b: _read(b, model.value, all_defects), _EVIDENCE)
    return cut(with_cells(cut(read.withColumn("variant", F.coalesce("variant", F.lit("")))).dropDuplicates(["result_id"]), results))


def _fit(lengths: np.ndarray, counts: np.ndarray, limit: int) -> tuple[float, float]:
    """Mean and deviation of log length by maximum likelihood, values at or above the limit being right-censored."""
    return _fit_censored(np.minimum(lengths, limit), counts, lengths >= limit)


def _fit_censored(lengths: np.ndarray, counts: np.ndarray, cut: np.ndarray) -> tuple[float, float]:
    """Mean and deviation of log length by maximum likelihood, the values in ``cut`` being right-censored where they are."""
    logs, own = np.log(lengths[~cut]), counts[~cut]
    tops, place = np.unique(lengths[cut], return_inverse=True)
    tops, n_cut = np.log(tops), np.bincount(place, weights=counts[cut], minlength=len(tops))
    mean, dev = np.average(np.log(lengths), weights=counts), 1.0
    for _ in range(60):
        z = (tops - mean) / dev
        tail = np.maximum([0.5 * math.erfc(x / math.sqrt(2)) for x in z], 1e-12)
        hazard = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
        first = mean + dev * hazard
        second = dev * dev * (1 + z * hazard) + 2 * mean * (first - mean) + mean * mean
        new = (np.dot(logs, own) + np.dot(n_cut, first)) / counts.sum()
        var = (np.dot(logs**2, own) + np.dot(n_cut, second)) / counts.sum() - new * new
        moved, mean, dev = abs(new - mean), new, math.sqrt(max(var, 1e-4))
        if moved < 1e-6:
            break
    return mean, dev


def _log_chance(n: float, expected: float) -> float:
    """Logarithm of a bound of the chance that a Poisson number with this mean is n or more."""
    return 0.0 if n <= expected else n - expected - n * math.log(n / expected)


def _log_share_chance(k: float, n: float, share: float) -> float:
    """Logarithm of a bound of the chance that k or more of n are of a kind that has this share."""
    if k <= n * share:
        return 0.0
    return -(k * math.log(k / n / share) + (0.0 if k >= n else (n - k) * math.log((1 - k / n) / (1 - share))))


def _limits(frame: pd.DataFrame) -> pd.DataFrame:
    """The limits of one source from its histogram of lengths: unit, limit, posterior of being cut for a value that lies there.

    Every length is tested. The limit with most answers beyond those the density explains is taken, then the answers that lie at
    it count as censored, and the rest is tested again in both units, until nothing is left to explain.
    """
    found, variant = [], frame["variant"].iloc[0]
    n, unclosed = (frame[c].to_numpy(float) for c in ("n", "unclosed"))
    size = {unit: frame[f"n_{unit}s"].to_numpy(float) for unit in ("char", "byte")}
    taken = np.zeros(len(frame), dtype=bool)
    while True:
        best = None
        for unit, at, here, near in _candidates(size, n, unclosed, taken):
            slack = 0 if unit == "char" else 2
            inside = ~taken & (size[unit] >= at - slack) & (size[unit] <= at)
            mean, dev = _fit_censored(np.where(inside, max(at - slack, 2), size[unit]), n, taken | inside)
            z = (math.log(at) - mean) / dev
            natural = n.sum() * math.exp(-z * z / 2) / (dev * math.sqrt(2 * math.pi) * at) * (1 + slack)
            expected = max(natural, near, 0.05)
            if not _accepted(size[unit], at, here, expected, n, unclosed, taken, inside):
                continue
            # Texts of one-byte characters have the same length in both units: bytes need a clearly greater number.
            # Of windows that hold the same answers, the one that ends with most of them is the limit's.
            gain = (here - expected + 0.1 * n[inside & (size[unit] == at)].sum()) * (1.25 if unit == "char" else 1)
            if best is None or gain > best[0]:
                best = gain, inside, (variant, unit, int(at), here / n.sum(), 1 - expected / here, mean, dev)
        if best is None:
            break
        taken |= best[1]
        found.append(best[2])
    return pd.DataFrame(found, columns=["variant", "unit", "limit", "share", "posterior", "log_mean", "log_dev"])


def _candidates(size: dict[str, np.ndarray], n: np.ndarray, unclosed: np.ndarray, taken: np.ndarray) -> Iterator[tuple[str, float, float, float]]:
    """(unit, length, answers there, answers to expect from the lengths around it) of each length that could be a limit."""
    for unit, sizes in size.items():
        slack = 0 if unit == "char" else 2
        lengths, place = np.unique(sizes[~taken], return_inverse=True)
        sums = [np.append(0, np.cumsum(np.bincount(place, weights=w[~taken], minlength=len(lengths)))) for w in (n, unclosed)]
        between = lambda low, high, k=0: sums[k][np.searchsorted(lengths, high, "right")] - sums[k][np.searchsorted(lengths, low)]  # noqa: E731, B023
        here, open_here = between(lengths - slack, lengths), between(lengths - slack, lengths, 1)
        near = np.maximum(between(lengths - slack - 25, lengths - slack - 1), between(lengths + 1, lengths + 25)) / 25 * (1 + slack)
        for k in np.flatnonzero((here >= LEAST_AT_LIMIT) & (open_here >= LEAST_UNCLOSED * here) & (here > near)):
            old = between(lengths[k] + 1, lengths[-1]) <= here[k] and here[k] >= LEAST_RATIO * near[k]
            if old or _log_chance(here[k], max(near[k], 0.05)) < LOG_CHANCE - math.log(len(lengths)):
                yield unit, lengths[k], here[k], near[k]


def _accepted(sizes: np.ndarray, at: float, here: float, expected: float, n: np.ndarray, unclosed: np.ndarray, taken: np.ndarray, inside: np.ndarray) -> bool:
    """Whether a length is a limit: few longer answers and clearly more there than expected, or else more there than any length of
    the source has by chance, and so many of them with an ending that isn't closed, compared with answers a little shorter or longer.

    Short answers, such as amounts, have peaks of their own and no mark at the end; their neighbours haven't one either.
    """
    rest = ~taken & ~inside
    if n[rest & (sizes > at)].sum() <= here and here >= LEAST_RATIO * expected:
        return True
    overall = unclosed[rest].sum() / max(n[rest].sum(), 1)
    low = sizes[inside].min()
    near = [rest & side for reach in (25, min(25, max(at // 4, 2))) for side in ((sizes < at) & (sizes >= low - reach), (sizes > at) & (sizes <= at + reach))]
    open_rate = max((unclosed[side].sum() + 2 * overall) / (n[side].sum() + 2) for side in near)
    least = LOG_CHANCE - math.log(len(np.unique(sizes[~taken])))
    return _log_chance(here, expected) < least and _log_share_chance(unclosed[inside].sum(), here, max(open_rate, 0.01)) < least


def field_limits(evidence: DataFrame) -> DataFrame:
    """(variant, unit, limit, share, posterior, log_mean, log_dev) of every limit of every source; lengths are counted first."""
    lengths = evidence.where("state is not null and n_chars > 1 and n_bytes > 1").select("variant", (F.col("state") != "closed").alias("unclosed"), "n_chars", "n_bytes")
    histogram = lengths.groupBy("variant", "n_chars", "n_bytes").agg(F.count("*").alias("n"), F.count_if("unclosed").alias("unclosed"))
    schema = "variant string, unit string, limit int, share double, posterior double, log_mean double, log_dev double"
    return histogram.groupBy("variant").applyInPandas(_limits, schema)


def _odds(rate: float) -> float:
    return math.log(rate / (1 - rate))


def _posterior(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def fit_evidence(table: pd.DataFrame) -> np.ndarray:
    """Log likelihood ratio, broken off against complete, of each cell of contexts.

    ``table`` has (closed, posterior, cell, n). Answers at a limit (with a censoring posterior) and not closed show how cut
    ends are spread, closed sentences how complete ones are. Among contexts that ended somewhere, and among those that never did,
    the ratio doesn't fall from a cell to one where texts go on oftener: neighbours that say otherwise share theirs.
    """
    cell, n = table["cell"].to_numpy(int), table["n"].to_numpy(float)
    closed, posterior = table["closed"].to_numpy(bool), table["posterior"].to_numpy(float)
    spreads, known = [], np.array(CELLS)
    for weight, start in ((np.where(closed, 0, np.nan_to_num(posterior)), _posterior(known)), (closed.astype(float), _posterior(-known))):
        seen = np.bincount(cell, weights=n * weight, minlength=len(CELLS)) + PRIOR_ROWS * start / start.sum()
        spreads.append(seen / seen.sum())
    ratio = np.log(spreads[0] / spreads[1])
    for chain in (np.argsort(known[:12], kind="stable"), range(12, 17)):
        runs: list = []
        for k in chain:
            runs.append(([k], spreads[0][k], spreads[1][k]))
            while len(runs) > 1 and runs[-2][1] * runs[-1][2] > runs[-1][1] * runs[-2][2]:
                (cells, *sums), (more, *others) = runs[-2:]
                runs[-2:] = [(cells + more, sums[0] + others[0], sums[1] + others[1])]
        for cells, broken, whole in runs:
            ratio[cells] = math.log(broken / whole)
    return ratio


def fit_rate(cell: np.ndarray, n: np.ndarray, ratio: np.ndarray, base: float = BASE_RATE) -> float:
    """Rate of breaking off of answers that lie at no limit, drawn towards ``base`` by PRIOR_ROWS rows; by EM."""
    rate = base
    for _ in range(200):
        old, rate = rate, (np.dot(n, _posterior(_odds(rate) + ratio[cell])) + PRIOR_ROWS * base) / (n.sum() + PRIOR_ROWS)
        rate = min(max(float(rate), 1e-4), 1 - 1e-4)
        if abs(old - rate) < 1e-6:
            break
    return rate


def judged_endings(results: DataFrame, all_defects: bool = False) -> DataFrame:
    """Every answer once with ``log_odds`` of breaking off, its source's limits, the one with most answers first, and the defects seen in the pair.

    Null and empty answers carry nothing that could break off: their ``log_odds`` is null. So is that of closed endings, where
    nothing of what was being written is missing, at a limit too; that of an open form is OPEN_ODDS. Every other answer has
    the censoring posterior of the limits it lies at, or its source's rate of breaking off elsewhere if that is greater, and
    what its context tells. Repeated rows count once.
    """
    evidence = answer_evidence(results, all_defects)
    limits = field_limits(evidence).groupBy("variant").agg(F.sort_array(F.collect_list(F.struct("share", "unit", "limit", "posterior")), False).alias("limits"))

    def lies_at(limit):
        length = F.when(limit["unit"] == "char", F.col("n_chars")).otherwise(F.col("n_bytes"))
        return (length <= limit["limit"]) & (length >= limit["limit"] - F.when(limit["unit"] == "char", 0).otherwise(2))

    posterior = F.array_max(F.transform(F.filter("limits", lies_at), lambda x: x["posterior"]))
    judged = cut(evidence.join(limits, "variant", "left").withColumn("posterior", posterior))
    closed = F.col("state") == "closed"
    counted = cut(judged.where("cell is not null").groupBy("variant", closed.alias("closed"), F.round("posterior", 2).alias("posterior"), "cell").agg(F.count("*").alias("n")))
    table = counted.groupBy("closed", "posterior", "cell").agg(F.sum("n").alias("n")).toPandas()
    ratio = fit_evidence(table)
    away = table[~table["closed"] & table["posterior"].isna()]
    base = fit_rate(away["cell"].to_numpy(int), away["n"].to_numpy(float), ratio)

    def rate_of(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"variant": frame["variant"].iloc[:1], "rate": [fit_rate(frame["cell"].to_numpy(int), frame["n"].to_numpy(float), ratio, base)]})

    rates = counted.where("not closed and posterior is null").groupBy("variant").applyInPandas(rate_of, "variant string, rate double")
    prior = F.greatest("posterior", F.coalesce("rate", F.lit(base)))
    told = F.get(F.array(*(F.lit(float(x)) for x in ratio)), F.col("cell"))
    odds = F.when(F.col("state") == "open", OPEN_ODDS).when(F.col("state").startswith("ask"), F.log(prior / (1 - prior)) + told)
    return judged.join(rates, "variant", "left").select(
        "result_id", "variant", "n_chars", "limits", F.col("posterior").isNotNull().alias("at_limit"), "posterior", "state",
        odds.alias("log_odds"), "defect", "given", "adds", "foreign",
    )


def copies_question(judged: DataFrame) -> Column:
    """Whether an answer only repeats its question, from the share of it that is left once the question is known."""
    counts = judged.where("given is not null").groupBy(F.floor(F.least(F.col("given"), F.lit(1.2)) * 100).cast("int").alias("bin")).agg(F.count("*").alias("n")).toPandas()
    return (F.col("given") <= A.copy_threshold(counts["bin"].to_numpy(int), counts["n"].to_numpy(float))) & ~F.col("adds")


def broken_off(results: DataFrame) -> DataFrame:
    """result_id of each answer that breaks off; an answer that only repeats its question is a copy, not broken off."""
    judged = judged_endings(results)
    return judged.where((F.col("log_odds") > 0) & F.col("defect").isNull() & ~copies_question(judged)).select("result_id")


def broken_off_share(results: DataFrame) -> DataFrame:
    """How often each source's answers break off, and at which limits; ``limit_unit`` and ``field_limit`` are the first of them."""
    judged = judged_endings(results)
    broken = F.coalesce((F.col("log_odds") > 0) & F.col("defect").isNull() & ~copies_question(judged), F.lit(False))
    return judged.groupBy("variant").agg(
        F.count("*").alias("answers"),
        F.count_if(broken).alias("broken_off"),
        F.round(F.avg(broken.cast("double")), 6).alias("share"),
        F.max(F.get("limits", F.lit(0))["unit"]).alias("limit_unit"),
        F.max(F.get("limits", F.lit(0))["limit"]).alias("field_limit"),
        F.max(F.transform("limits", lambda x: F.concat_ws(" ", x["unit"], x["limit"]))).alias("limits"),
        F.count_if(broken & F.col("at_limit")).alias("at_limit"),
    )
