"""Instance metrics from contingencies (keys, t, p, n) and areas, and their means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Steps of the sweep; the values are start + i * (next - start), whose last bits differ from i * 0.05.
SWEEP_STEPS = 10
#: Two-sided 95 % points of Student's t by degrees of freedom; beyond the table the normal's value holds.
T_975 = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042]
Z_975 = 1.96


def sweep(spark: SparkSession) -> DataFrame:
    """(i, tau): thresholds 0.5, 0.55, ... as floating-point steps from 0.5."""
    return spark.range(SWEEP_STEPS).select(F.col("id").cast("int").alias("i"), (F.lit(0.5) + F.col("id") * (F.lit(0.55) - F.lit(0.5))).alias("tau"))


def ious(pairs: DataFrame, true_areas: DataFrame, pred_areas: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, p, n, iou); areas: keys, label, area. Pairs that share nothing are absent."""
    t = true_areas.select(*keys, F.col("label").alias("t"), F.col("area").alias("ta"))
    p = pred_areas.select(*keys, F.col("label").alias("p"), F.col("area").alias("pa"))
    return pairs.join(t, [*keys, "t"]).join(p, [*keys, "p"]).withColumn("iou", F.col("n") / (F.col("ta") + F.col("pa") - F.col("n")))


def one_to_one(iou: DataFrame, taus: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, tau, tp): the greedy one-to-one count of disjoint label maps at thresholds of 0.5 or more.

    There the candidates form stars, so the count is distinct trues + distinct preds - pairs.
    """
    hit = iou.join(F.broadcast(taus), F.col("iou") >= F.col("tau"))
    return hit.groupBy(*keys, "i", "tau").agg((F.count_distinct("t") + F.count_distinct("p") - F.count("*")).alias("tp"))


def greedy_matches(iou: DataFrame, keys: list[str], tau: float) -> DataFrame:
    """(keys, t, p, iou) of the greedy one-to-one matching at any threshold: best first, ties by t then p."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        used_t, used_p, out = set(), set(), []
        for row in group[group["iou"] >= tau].sort_values(["iou", "t", "p"], ascending=[False, True, True]).itertuples(index=False):
            if row.t not in used_t and row.p not in used_p:
                used_t.add(row.t)
                used_p.add(row.p)
                out.append(row)
        return pd.DataFrame(out, columns=group.columns)

    return iou.groupBy(*keys).applyInPandas(fold, iou.schema)


def precision_recall(samples: DataFrame, tp: DataFrame, taus: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, tau, tp, precision, recall, f1); samples: keys, n_true, n_pred. Both empty is 1, one empty is 0."""
    df = samples.join(F.broadcast(taus)).join(tp.drop("tau"), [*keys, "i"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    none, one = (F.col("n_true") == 0) & (F.col("n_pred") == 0), (F.col("n_true") == 0) | (F.col("n_pred") == 0)
    share = lambda top, n: F.when(none, 1.0).when(one, 0.0).otherwise(top / F.nullif(n, F.lit(0)))
    return df.select(*keys, "i", "tau", "tp", share(F.col("tp"), F.col("n_pred")).alias("precision"), share(F.col("tp"), F.col("n_true")).alias("recall"), share(2 * F.col("tp"), F.col("n_true") + F.col("n_pred")).alias("f1"))


def jaccard(trues: dict[int, int], preds: dict[int, int], pairs: list[tuple[int, int, int]]) -> tuple[int, int, float]:
    """(inter, uni, aji) of one image from areas by label and shared pixels (t, p, n): see ``aggregated_jaccard``."""
    by: dict[int, list] = {}
    for t, p, n in pairs:
        by.setdefault(t, []).append((n / (trues[t] + preds[p] - n), -p, n))
    left, inter, uni = dict(preds), 0, 0
    for t, area in sorted(trues.items()):
        best = max((x for x in by.get(t, []) if -x[1] in left), default=None)
        if best:
            inter, uni = inter + best[2], uni + area + left.pop(-best[1]) - best[2]
        else:
            uni += area
    uni += sum(left.values())
    return inter, uni, 1.0 if not trues and not preds else inter / uni if uni else 0.0


def raster_jaccard(true: np.ndarray, pred: np.ndarray) -> tuple[int, int, float]:
    """(inter, uni, aji) of two label maps of one shape; 0 is no label."""
    count = lambda x: {int(i): int(n) for i, n in enumerate(np.bincount(x)) if i and n}
    t, p = true.ravel(), pred.ravel()
    both, width = (t > 0) & (p > 0), int(p.max(initial=0)) + 1
    codes, n = np.unique(t[both].astype(np.int64) * width + p[both], return_counts=True)
    return jaccard(count(t), count(p), list(zip((codes // width).tolist(), (codes % width).tolist(), n.tolist(), strict=True)))


def aggregated_jaccard(samples: DataFrame, iou: DataFrame, true_areas: DataFrame, pred_areas: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, inter, uni, aji): trues in ascending order each take the best prediction left, by a fold per sample.

    One group is one image's pairs and areas, which is bounded by its number of instances.
    """
    pairs = iou.groupBy(*keys).agg(F.collect_list(F.struct("t", "p", "n", "iou")).alias("pairs"))
    trues = true_areas.groupBy(*keys).agg(F.collect_list(F.struct("label", "area")).alias("trues"))
    preds = pred_areas.groupBy(*keys).agg(F.collect_list(F.struct("label", "area")).alias("preds"))
    rows = samples.select(*keys).join(pairs, keys, "left").join(trues, keys, "left").join(preds, keys, "left")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                pairs, trues, preds = ([] if x is None else x for x in (row.pairs, row.trues, row.preds))
                areas = ({int(x["label"]): int(x["area"]) for x in side} for side in (trues, preds))
                out.append((*(getattr(row, k) for k in keys), *jaccard(*areas, [(int(x["t"]), int(x["p"]), int(x["n"])) for x in pairs])))
            yield pd.DataFrame(out, columns=[*keys, "inter", "uni", "aji"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in samples.select(*keys).schema) + ", inter long, uni long, aji double"
    return rows.mapInPandas(fold, schema)


AP_FIELDS = ["ap", "ap50", "ap75", "aps", "apm", "apl", "ar1", "ar10", "ar100"]
AP_TAUS = np.linspace(0.5, 0.95, 10)
AREAS = {"all": (0, 1e10), "s": (0, 32**2), "m": (32**2, 96**2), "l": (96**2, 1e10)}


def _matched(iou: np.ndarray, ignored: np.ndarray, tau: float) -> tuple[np.ndarray, np.ndarray]:
    """By detection (best first): matched, and matched to an ignored truth. Truths: those that count come first."""
    taken = np.zeros(iou.shape[1], bool)
    hit, ign = np.zeros(len(iou), bool), np.zeros(len(iou), bool)
    for d in range(len(iou)):
        best, m = min(tau, 1 - 1e-10), -1
        for g in range(iou.shape[1]):
            if taken[g]:
                continue
            if m > -1 and not ignored[m] and ignored[g]:
                break
            if iou[d, g] < best:
                continue
            best, m = iou[d, g], g
        if m > -1:
            taken[m] = hit[d] = True
            ign[d] = ignored[m]
    return hit, ign


def average_precision(truths: list[tuple[int, float]], found: list[tuple[int, float, float]], iou: dict[tuple[int, int], float]) -> list[float]:
    """The nine AP and AR values of one image; truths (label, area), found (label, area, score)."""
    if not truths:
        return [-1.0] * 9
    found = sorted(found, key=lambda x: (-x[2], x[0]))[:100]
    out: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    for name, (low, high) in AREAS.items():
        order = sorted(truths, key=lambda x: (not low <= x[1] < high, x[0]))
        ignored = np.array([not low <= a < high for _, a in order])
        count = int((~ignored).sum())
        table = np.array([[iou.get((t, p), 0.0) for t, _ in order] for p, _, _ in found]).reshape(len(found), len(order))
        outside = np.array([not low <= a < high for _, a, _ in found], bool)
        # detections are matched best first, so fewer of them are a prefix of the same matching
        matches = [_matched(table, ignored, tau) for tau in AP_TAUS] if count else []
        for most in (1, 10, 100):
            precisions, recalls = [], []
            for hit, ign in matches:
                hit, ign = hit[:most], ign[:most] | ~hit[:most] & outside[:most]
                tp, fp = np.cumsum(hit & ~ign), np.cumsum(~hit & ~ign)
                recall, precision = tp / count, tp / np.maximum(tp + fp, np.spacing(1))
                precision = np.maximum.accumulate(precision[::-1])[::-1]
                at = np.searchsorted(recall, np.linspace(0, 1, 101), side="left")
                precisions.append(np.append(precision, 0.0)[np.minimum(at, len(precision))])
                recalls.append(recall[-1] if len(recall) else 0.0)
            out[name, most] = (np.array(precisions), np.array(recalls))
    mean = lambda x: float(np.mean(x)) if len(x) else -1.0
    p = out["all", 100][0]
    return [mean(p), mean(p[0]), mean(p[5]), *(mean(out[a, 100][0]) for a in "sml"), *(mean(out["all", m][1]) for m in (1, 10, 100))]


def mask_ap(samples: DataFrame, true_areas: DataFrame, detections: DataFrame, iou: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ap, ap50, ...) by image; detections: keys, label, area, score. A group is one image's instances."""
    pairs = iou.groupBy(*keys).agg(F.collect_list(F.struct("t", "p", "iou")).alias("pairs"))
    trues = true_areas.groupBy(*keys).agg(F.collect_list(F.struct("label", "area")).alias("trues"))
    found = detections.groupBy(*keys).agg(F.collect_list(F.struct("label", "area", "score")).alias("found"))
    rows = samples.select(*keys).join(pairs, keys, "left").join(trues, keys, "left").join(found, keys, "left")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = lambda x: [] if x is None else x
        for batch in batches:
            yield pd.DataFrame(
                [
                    (*(getattr(row, k) for k in keys), *average_precision([(int(x["label"]), x["area"]) for x in some(row.trues)], [(int(x["label"]), x["area"], x["score"]) for x in some(row.found)], {(int(x["t"]), int(x["p"])): x["iou"] for x in some(row.pairs)}))
                    for row in batch.itertuples(index=False)
                ],
                columns=[*keys, *AP_FIELDS],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in samples.select(*keys).schema) + "".join(f", {k} double" for k in AP_FIELDS)
    return rows.mapInPandas(fold, schema)


def detection_matches(iou: DataFrame, scores: DataFrame, keys: list[str], tau: float) -> DataFrame:
    """(keys, p, t): each detection, best score first, takes the free truth with the highest IoU of at least tau."""
    rows = iou.where(F.col("iou") >= tau).join(scores.select(*keys, F.col("label").alias("p"), "score"), [*keys, "p"]).select(*keys, "p", "t", "iou", "score")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for (_, p), part in group.sort_values(["score", "p"], ascending=[False, True]).groupby([-group["score"], "p"], sort=True):
            free = part[~part["t"].isin(taken)].sort_values(["iou", "t"], ascending=[False, False])
            if len(free):
                taken.add(free["t"].iloc[0])
                out.append((*group.iloc[0][keys], p, free["t"].iloc[0]))
        return pd.DataFrame(out, columns=[*keys, "p", "t"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in iou.select(*keys, "p", "t").schema)
    return rows.groupBy(*keys).applyInPandas(fold, schema)


def sentinel_means(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, n, mean) over finite values of 0 or more; null if there are none."""
    v = F.col(value)
    good = ~F.isnan(v) & (v >= 0) & (v < float("inf"))
    return values.groupBy(*keys).agg(F.count(F.when(good, v)).alias("n"), F.avg(F.when(good, v)).alias("mean"))


def nan_means(values: DataFrame, keys: list[str], sample: str, value: str = "value") -> DataFrame:
    """(keys, mean) without NaNs, NaN if nothing is left; only for keys with more than one sample."""
    v = F.col(value)
    out = values.groupBy(*keys).agg(F.count_distinct(sample).alias("samples"), F.avg(F.when(~F.isnan(v), v)).alias("mean"))
    return out.where("samples > 1").select(*keys, F.coalesce("mean", F.lit(float("nan"))).alias("mean"))


def mean_with_interval(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, n, mean, ci): the half-width of the 95 % interval, 0 for fewer than two values; NaNs are left out."""
    v = F.col(value)
    out = values.where(~F.isnan(v)).groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    t = F.coalesce(F.get(F.array(*map(F.lit, T_975)), (F.col("n") - 2).cast("int")), F.lit(Z_975))
    return out.withColumn("ci", F.when(F.col("n") < 2, 0.0).otherwise(F.col("sd") / F.sqrt("n") * t)).drop("sd")
