"""Named procedures over ordered series, run per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat_value(points: DataFrame, keys: list[str], order: str, value: str, share: float = 0.05) -> DataFrame:
    """Per group the mean over the outermost points while each next one inward stays within a share of the mean so far;
    null for fewer than three points. ``n_used`` is how many count. A null value ends the run.

    Points are dealt by group and sorted outermost first, and a task streams them with one group's sum in hand, so that a
    group may be of any size.
    """
    ranked = points.select(*keys, F.col(order).alias("_o"), F.col(value).cast("double").alias("_v")).repartition(*keys)
    ranked = ranked.sortWithinPartitions(*keys, F.col("_o").desc(), F.col("_v").desc()).select(*keys, "_v")
    schema = T.StructType([*[ranked.schema[k] for k in keys], T.StructField("flat", T.DoubleType()), T.StructField("n_used", T.IntegerType())])

    def fold(batches):
        import pyarrow as pa

        made = None  # types of the keys come with the first batch

        def out(done):
            flat = [s / n if n >= 3 else None for _, s, n in done]
            columns = [pa.array([key[k] for key, _, _ in done], t) for k, t in enumerate(made)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(flat, pa.float64()), pa.array([n for _, _, n in done], pa.int32())], schema.names)

        here, total, n, stop, done = None, 0.0, 0, False, []
        for batch in batches:
            made = made or [batch.column(k).type for k in range(len(keys))]
            for *key, v in zip(*[c.to_pylist() for c in batch.columns]):
                if here is None or any(a != b and (a == a or b == b) for a, b in zip(key, here)):
                    if here is not None:
                        done.append((here, total, n))
                    here, total, n, stop = key, 0.0, 0, False
                if not stop and v is not None and (n == 0 or abs(v - total / n) <= share * abs(total / n)):
                    total, n = total + v, n + 1
                else:
                    stop = True
            if done:
                yield out(done)
                done = []
        if here is not None:
            yield out([(here, total, n)])

    return ranked.mapInArrow(fold, schema)


def orthogonal_fit(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Per group the line with the least squared orthogonal distances: slope, intercept, rms distance, n.

    The line follows from five sums, so groups of any size are summed before the shuffle; null for fewer than two
    distinct points.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    s = points.where(a.isNotNull() & b.isNotNull()).groupBy(key).agg(
        F.count("*").alias("n"), F.avg(a).alias("mx"), F.avg(b).alias("my"), F.var_pop(a).alias("vx"), F.var_pop(b).alias("vy"), F.covar_pop(a, b).alias("c")
    )
    root = F.sqrt(F.pow(F.col("vy") - F.col("vx"), F.lit(2)) + 4 * F.pow("c", F.lit(2)))
    slope = F.when(F.col("c") != 0, (F.col("vy") - F.col("vx") + root) / (2 * F.col("c")))
    s = s.withColumn("slope", slope).withColumn("rms", F.sqrt(F.greatest((F.col("vx") + F.col("vy") - root) / 2, F.lit(0.0))))
    return s.select(key, "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "rms", "n")


def relation_fit(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Per group the scale g of the relation y = x / (1 - exp(-sqrt(x / g))) in logarithms, by Gauss-Newton steps.

    Points are binned by a hundredth of a decade of x first, so that a group handed to one task has a bounded number
    of rows whatever it held. Groups of fewer than three bins give null.
    """
    binned = points.where((F.col(x) > 0) & (F.col(y) > 0)).groupBy(key, F.floor(F.log10(x) * 100).alias("_b"))
    binned = binned.agg(F.avg(F.ln(x)).alias("lx"), F.avg(F.ln(y)).alias("ly"), F.count("*").cast("double").alias("w"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_b")
        lx, ly, w = (rows[c].to_numpy() for c in ("lx", "ly", "w"))
        out = {key: [rows[key].iloc[0]], "scale": [None], "rms": [None], "n_bins": [len(rows)]}
        if len(rows) >= 3:
            model = lambda lg: lx - np.log(-np.expm1(-np.exp((lx - lg) / 2)))
            lg = float(np.average(lx, weights=w))
            for _ in range(60):
                r = ly - model(lg)
                j = (model(lg + 1e-5) - model(lg - 1e-5)) / 2e-5
                step = float((w * j * r).sum() / max((w * j * j).sum(), 1e-12))
                lg += float(np.clip(step, -1, 1))
                if abs(step) < 1e-10:
                    break
            r = ly - model(lg)
            out |= {"scale": [float(np.exp(lg))], "rms": [float(np.sqrt((w * r * r).sum() / w.sum()))]}
        return pd.DataFrame(out)

    kind = points.schema[key].dataType.simpleString()
    return binned.groupBy(key).applyInPandas(fit, f"{key} {kind}, scale double, rms double, n_bins int")
