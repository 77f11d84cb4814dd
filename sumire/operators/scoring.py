"""Recognition scores: edit distances, alignments, rates, detection and region metrics."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import text as tx

# Quotation marks that count as variants of each other.
DOUBLE_QUOTES = "“”\""
SINGLE_QUOTES = "‘’'"


def _variants(a: str, b: str) -> bool:
    return bool(a and b) and (a in DOUBLE_QUOTES and b in DOUBLE_QUOTES or a in SINGLE_QUOTES and b in SINGLE_QUOTES)


def quote_weighted_distance(reference: str, prediction: str) -> float:
    """Edit distance with half cost for quotation variants, for spaces typed beside a reference quotation mark whose
    variant stands next to the space in the prediction, and for two single marks against one double mark."""
    if reference == prediction:
        return 0.0
    n, m = len(reference), len(prediction)
    solid = [i for i, c in enumerate(prediction) if c != " "]
    before = {j: prediction[max((i for i in solid if i < j), default=-1)] if any(i < j for i in solid) else "" for j in range(m) if prediction[j] == " "}
    after = {j: prediction[min(i for i in solid if i > j)] if any(i > j for i in solid) else "" for j in range(m) if prediction[j] == " "}

    def typed(i: int, j: int) -> float:
        if prediction[j] != " ":
            return 1.0
        left, right = reference[i - 1] if i else "", reference[i] if i < n else ""
        return 0.5 if _variants(before[j], left) or _variants(after[j], right) else 1.0

    table = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if not i and not j:
                continue
            costs = []
            if i:
                costs.append(table[i - 1][j] + 1)
            if j:
                costs.append(table[i][j - 1] + typed(i, j - 1))
            if i and j:
                a, b = reference[i - 1], prediction[j - 1]
                costs.append(table[i - 1][j - 1] + (0 if a == b else 0.5 if _variants(a, b) else 1))
                if i > 1 and b in DOUBLE_QUOTES and a in SINGLE_QUOTES and reference[i - 2] in SINGLE_QUOTES:
                    costs.append(table[i - 2][j - 1] + 0.5)
                if j > 1 and a in DOUBLE_QUOTES and b in SINGLE_QUOTES and prediction[j - 2] in SINGLE_QUOTES:
                    costs.append(table[i - 1][j - 2] + 0.5)
            table[i][j] = min(costs)
    return table[n][m]


def alignment(reference: str, prediction: str) -> list[tuple[str, str, str, int, int]]:
    """(kind, reference, prediction, reference_index, prediction_index) of a least edit script; where several are
    least, traced from the end, a match or substitution comes before a deletion and that before an insertion."""
    if reference == prediction:
        return []
    same, most = 0, min(len(reference), len(prediction))  # the trace runs along a common end, whatever comes before it
    while same < most and reference[-1 - same] == prediction[-1 - same]:
        same += 1
    reference, prediction = reference[: len(reference) - same], prediction[: len(prediction) - same]
    n, m = len(reference), len(prediction)
    # All least scripts of up to `limit` edits lie in a band of diagonals, so the trace meets the same values in it.
    gap, limit, far = m - n, max(abs(m - n), 2), n + m + 1
    while True:
        slack = (limit - abs(gap)) // 2
        low, high = min(0, gap) - slack, max(0, gap) + slack
        rows = [[j if j <= high else far for j in range(m + 1)]]
        for i, a in enumerate(reference, 1):
            above, row, first = rows[-1], [far] * (m + 1), max(1, i + low)
            row[0] = left = i if i + low <= 0 else far
            if first > 1:
                left = far
            for j in range(first, min(m, i + high) + 1):
                best = above[j - 1] + (a != prediction[j - 1])
                up = above[j] + 1
                left += 1
                if up < best:
                    best = up
                if left < best:
                    best = left
                row[j] = left = best
            rows.append(row)
        if rows[n][m] <= limit:
            break
        limit *= 2
    out, i, j = [], n, m
    while i or j:
        a, b = reference[i - 1 : i], prediction[j - 1 : j]
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (a != b):
            i, j = i - 1, j - 1
            if a != b:
                out.append(("substitution", a, b, i, j))
        elif i and rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
            out.append(("deletion", a, "", i, j))
        else:
            j -= 1
            out.append(("insertion", "", b, i, j))
    return out[::-1]


_EXCUSABLE = re.compile("[.)）] | [(（]")


def without_free_spaces(reference: str, prediction: str) -> str:
    """prediction without the spaces that the reference's punctuation excuses: after a period or closing parenthesis
    that the prediction has before the space, or before an opening one that it has after it. Traced along a least
    edit script that prefers matches, then deletions, then insertions."""
    if reference == prediction or not _EXCUSABLE.search(prediction):
        return prediction
    n, m = len(reference), len(prediction)

    def free(i: int, j: int) -> bool:
        left, right = reference[i - 1 : i] if i else "", reference[i : i + 1]
        return prediction[j] == " " and bool(left and left in ".)）" and j and prediction[j - 1] == left or right and right in "(（" and prediction[j + 1 : j + 2] == right)

    # A way of cost `limit` deletes so many characters at most, which bounds its diagonals however many spaces are free.
    gap, limit, far = m - n, max(n - m, 0), n + m + 1
    while True:
        cost, step = [[far] * (m + 1) for _ in range(n + 1)], [[""] * (m + 1) for _ in range(n + 1)]
        cost[0][0] = 0
        for i in range(n + 1):
            for j in range(max(0, i - limit), min(m, i + gap + limit) + 1):
                ways = []
                if i and j:
                    ways.append((cost[i - 1][j - 1] + (reference[i - 1] != prediction[j - 1]), 0, "match"))
                if i:
                    ways.append((cost[i - 1][j] + 1, 1, "delete"))
                if j:
                    f = free(i, j - 1)
                    ways.append((cost[i][j - 1] + (not f), 2, "free" if f else "insert"))
                if ways:
                    cost[i][j], _, step[i][j] = min(ways)
        if cost[n][m] <= limit:
            break
        limit = 2 * limit + 1
    kept, i, j = [], n, m
    while i or j:
        s = step[i][j]
        if s != "delete":
            j -= 1
            if s != "free":
                kept.append(prediction[j])
        if s in ("match", "delete"):
            i -= 1
    return "".join(reversed(kept))


def weighted_distance(reference: Column, prediction: Column) -> Column:
    """The quotation-weighted distance; without a quotation mark in the reference it is the plain one, computed in the JVM."""
    quoted = reference.rlike("[“”\"‘’']")
    return F.coalesce(_quoted_distance(F.when(quoted, reference), prediction), F.levenshtein(reference, prediction).cast("double"))


_EDITS = T.ArrayType(T.StructType([*(T.StructField(n, T.StringType()) for n in ("kind", "reference", "prediction")), *(T.StructField(n, T.IntegerType()) for n in ("reference_index", "prediction_index"))]))


def _codes(texts: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(texts), width), np.uint32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _marks(codes: np.ndarray) -> np.ndarray:
    """1 for double quotation marks, 2 for single ones, 0 for the rest."""
    return np.isin(codes, [ord(c) for c in DOUBLE_QUOTES]).astype(np.int8) + 2 * np.isin(codes, [ord(c) for c in SINGLE_QUOTES]).astype(np.int8)


def _solid_neighbours(codes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Of each position, the mark class of the last character before it that is no space."""
    out, last = np.zeros_like(marks), np.zeros(len(marks), np.int8)
    for j in range(codes.shape[1]):
        out[:, j] = last
        last = np.where(codes[:, j] == 0x20, last, marks[:, j])
    return out


def quote_weighted_distances(references: list[str], predictions: list[str]) -> np.ndarray:
    """quote_weighted_distance of many pairs: one table whose cells are arrays over the pairs."""
    n, m = np.array([len(t) for t in references]), np.array([len(t) for t in predictions])
    a, b = _codes(references, int(n.max(initial=0))), _codes(predictions, int(m.max(initial=0)))
    qa, qb = _marks(a), _marks(b)
    left = _solid_neighbours(b, qb)
    # Reversed rows begin with the padding, which is no space and no mark.
    right = _solid_neighbours(b[:, ::-1], qb[:, ::-1])[:, ::-1]
    # From here on a row is a position and its entries are the pairs, so every step reads whole rows.
    a, b, qa, qb, left, right = (np.ascontiguousarray(x.T) for x in (a, b, qa, qb, left, right))
    space = b == 0x20
    double_b, single_b = qb == 1, qb == 2
    pair_b = np.zeros_like(single_b)
    pair_b[1:] = single_b[1:] & single_b[:-1]
    has_left, has_right = space & (left > 0), space & (right > 0)
    quotes_b = np.flatnonzero((qb > 0).any(axis=1))
    quoted = set(quotes_b.tolist())
    spaced = set(np.flatnonzero((has_left | has_right).any(axis=1)).tolist())
    none = np.zeros(len(n), np.int8)
    half, one = np.float32(0.5), np.float32(1)
    out = np.zeros(len(n))
    above2 = above = None
    for i in range(a.shape[0] + 1):
        row = np.empty((b.shape[0] + 1, len(n)), np.float32)
        row[0] = i
        back, front = (qa[i - 1] if i else none), (qa[i] if i < a.shape[0] else none)
        marked = bool(i) and bool((qa[i - 1] > 0).any())
        pair_a = (qa[i - 1] == 2) & (qa[i - 2] == 2) if i > 1 and marked else None
        for j in range(1, b.shape[0] + 1):
            k = j - 1
            if k in spaced:
                cheap = (has_left[k] & (left[k] == back)) | (has_right[k] & (right[k] == front))
                best = row[k] + np.where(cheap, half, one)
            else:
                best = row[k] + one
            if i:
                swap = (a[i - 1] != b[k]).astype(np.float32)
                if marked and k in quoted:
                    swap[(swap > 0) & (qa[i - 1] > 0) & (qa[i - 1] == qb[k])] = half
                np.minimum(best, above[j] + one, out=best)
                np.minimum(best, above[k] + swap, out=best)
                if pair_a is not None and k in quoted:
                    best = np.where(pair_a & double_b[k], np.minimum(best, above2[k] + half), best)
                if marked and j > 1 and k in quoted:
                    best = np.where((qa[i - 1] == 1) & pair_b[k], np.minimum(best, above[j - 2] + half), best)
            row[j] = best
        ended = np.flatnonzero(n == i)
        out[ended] = row[m[ended], ended]
        above2, above = above, row
    return out


@F.pandas_udf(T.DoubleType())
def _quoted_distance(reference: pd.Series, prediction: pd.Series) -> pd.Series:
    out = np.full(len(reference), np.nan)
    known = [i for i, (a, b) in enumerate(zip(reference, prediction)) if a is not None and b is not None]
    known.sort(key=lambda i: len(reference[i]))
    for at in range(0, len(known), 2048):
        own = known[at : at + 2048]
        out[own] = quote_weighted_distances([reference[i] for i in own], [prediction[i] for i in own])
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


@F.pandas_udf(_EDITS)
def edits(reference: pd.Series, prediction: pd.Series) -> pd.Series:
    keys = ("kind", "reference", "prediction", "reference_index", "prediction_index")
    return pd.Series([None if a is None or b is None else [dict(zip(keys, e)) for e in alignment(a, b)] for a, b in zip(reference, prediction)])


@F.pandas_udf(T.StringType())
def excuse_spaces(reference: pd.Series, prediction: pd.Series) -> pd.Series:
    return pd.Series([b if a is None or b is None else without_free_spaces(a, b) for a, b in zip(reference, prediction)], dtype="object")


def evaluation_texts(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """df (reference, prediction) in the order that scoring needs: aliases on both, then excused spaces on the prediction."""
    return df.withColumn("reference", tx.alias_normalise(F.col("reference"), mapping)).withColumn("prediction", tx.alias_normalise(F.col("prediction"), mapping)).withColumn("prediction", excuse_spaces("reference", "prediction"))


def totals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sums that can be merged: samples, exact_matches, character_errors, reference_characters per key."""
    sums = [F.count(F.lit(1)).alias("samples"), F.sum((F.col("reference") == F.col("prediction")).cast("long")).alias("exact_matches"), F.sum(F.levenshtein("reference", "prediction")).cast("long").alias("character_errors"), F.sum(F.length("reference")).cast("long").alias("reference_characters")]
    return df.groupBy(*keys).agg(*sums)


def with_rates(sums: DataFrame) -> DataFrame:
    """Micro rates from sums: exact_accuracy and cer (which may exceed 1); null where nothing was counted."""
    return sums.withColumn("exact_accuracy", F.col("exact_matches") / F.nullif(F.col("samples"), F.lit(0))).withColumn("cer", F.col("character_errors") / F.nullif(F.col("reference_characters"), F.lit(0)))


def confusions(df: DataFrame) -> DataFrame:
    """(kind, reference, prediction, count, reference_occurrences, rate): edits by character; the rate's base is the
    character's occurrences in the references, null for insertions."""
    events = df.select(F.explode(edits("reference", "prediction")).alias("e")).groupBy("e.kind", "e.reference", "e.prediction").agg(F.count(F.lit(1)).alias("count"))
    seen = df.select(F.explode(tx.characters(F.col("reference"))).alias("reference")).groupBy("reference").agg(F.count(F.lit(1)).alias("reference_occurrences"))
    return events.join(seen, "reference", "left").select("kind", "reference", "prediction", "count", "reference_occurrences", (F.col("count") / F.col("reference_occurrences")).alias("rate"))


_SEQUENCE_ROWS = "pattern string, occurrences long, reference_characters long, deleted_occurrences long, deleted_characters long, substituted_occurrences long, substituted_characters long"


def _sequences(batches):
    word = re.compile(tx.ENGLISH_WORD.replace(r"\p{L}\p{N}_", r"\w"))
    for pdf in batches:
        sums = {p: [0] * 6 for p in tx.SEQUENCE_PATTERNS}
        for ref, pred in zip(pdf.reference, pdf.prediction):
            if ref is None or pred is None:
                continue
            hit = {"deletion": set(), "substitution": set(), "insertion": set()}
            for kind, _, _, i, _ in alignment(ref, pred):
                hit[kind].add(i)
            for w in word.finditer(ref):
                for p, s in sums.items():
                    at = ref.find(p, w.start(), w.end())
                    while at >= 0:
                        span = set(range(at, at + len(p)))
                        d, x = len(span & hit["deletion"]), len(span & hit["substitution"])
                        for k, v in enumerate((1, len(p), d > 0, d, x > 0, x)):
                            s[k] += int(v)
                        at = ref.find(p, at + 1, w.end())
        yield pd.DataFrame([(p, *s) for p, s in sums.items()], columns=[c.split()[0] for c in _SEQUENCE_ROWS.split(", ")])


def sequence_rates(df: DataFrame) -> DataFrame:
    """Per letter sequence, overlapping occurrences in whole words and how many lost or changed letters; rates are null
    where a sequence does not occur. Batches are summed before they are shuffled."""
    names = [c.split()[0] for c in _SEQUENCE_ROWS.split(", ")][1:]
    sums = df.select("reference", "prediction").mapInPandas(_sequences, _SEQUENCE_ROWS).groupBy("pattern").agg(*[F.sum(n).alias(n) for n in names])
    return sums.withColumn("deletion_rate", F.col("deleted_occurrences") / F.nullif(F.col("occurrences"), F.lit(0))).withColumn("deleted_character_rate", F.col("deleted_characters") / F.nullif(F.col("reference_characters"), F.lit(0)))


def worst(df: DataFrame, condition: str, k: int, order: str) -> DataFrame:
    """The k rows of each condition with the greatest cer, ties by `order`; k bounds what each partition sends."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(condition).orderBy(F.desc("cer"), order))).where(F.col("rank") <= k)


def checked_pairs(references: DataFrame, predictions: DataFrame, key: str = "image") -> DataFrame:
    """references joined with predictions; (key, problem) rows go to `problem`: missing, duplicate, unverified.

    A full join on keys that were counted per side: a repeated or unmatched key is reported, never joined twice.
    """
    r = references.groupBy(key).agg(F.count(F.lit(1)).alias("rn"), F.min("reference").alias("reference"), F.min(F.coalesce("reference_verified", F.lit(False))).alias("ok"))
    p = predictions.groupBy(key).agg(F.count(F.lit(1)).alias("pn"), F.min("prediction").alias("prediction"))
    problem = F.when(F.col("rn").isNull() | F.col("pn").isNull(), "missing").when((F.col("rn") > 1) | (F.col("pn") > 1), "duplicate").when(~F.col("ok"), "unverified")
    return r.join(p, key, "full_outer").select(key, "reference", "prediction", problem.alias("problem"))


def deltas(baseline: DataFrame, candidate: DataFrame, key: str = "image") -> DataFrame:
    """(key, baseline_errors, candidate_errors, error_delta)."""
    b, c = baseline.select(key, F.col("errors").alias("baseline_errors")), candidate.select(key, F.col("errors").alias("candidate_errors"))
    return b.join(c, key).withColumn("error_delta", F.col("candidate_errors") - F.col("baseline_errors"))


def detection_scores(df: DataFrame, keys: list[str]) -> DataFrame:
    """Micro recall, precision and F1 from matches, ground_truth and predictions; 0 where a base is 0."""
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"), *[F.sum(c).alias(c) for c in ("matches", "ground_truth", "predictions")])
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    m, g, p = F.col("matches"), F.col("ground_truth"), F.col("predictions")
    return sums.withColumn("recall", ratio(m, g)).withColumn("precision", ratio(m, p)).withColumn("f1", ratio(2 * m, g + p))


def region_metrics(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pixels, mean_probability, fraction_at_05) of rows (probability, inside); null for an empty region."""
    return pixels.groupBy(*keys).agg(F.count_if("inside").alias("pixels"), F.avg(F.when(F.col("inside"), F.col("probability"))).alias("mean_probability"), F.avg(F.when(F.col("inside"), (F.col("probability") >= 0.5).cast("double"))).alias("fraction_at_05"))


def weighted_merge(parts: DataFrame, keys: list[str], value: str, weight: str = "pixels") -> DataFrame:
    """Mean of a per-sample metric weighted by its pixels; samples without the metric count for nothing but their pixels."""
    known = F.when(F.col(value).isNotNull(), F.col(weight))
    return parts.groupBy(*keys).agg(F.sum(weight).alias(weight), (F.sum(F.col(value) * known) / F.nullif(F.sum(weight), F.lit(0))).alias(value))


def boundary_scores(pixels: DataFrame, sample: str, channel: str) -> DataFrame:
    """Per channel the mean over samples of MAE, soft Dice, precision, recall and F1 with smoothing 1e-6, of rows
    (probability, target, valid)."""
    e = 1e-6
    p, t = F.col("probability"), F.col("target")
    pb, tb = (p >= 0.5).cast("double"), (t >= 0.5).cast("double")
    v = F.col("valid").cast("double")
    one = pixels.groupBy(sample, channel).agg(
        (F.sum(F.abs(p - t) * v) / F.greatest(F.lit(1.0), F.sum(v))).alias("mae"),
        ((2 * F.sum(p * t * v) + e) / (F.sum((p + t) * v) + e)).alias("soft_dice"),
        ((F.sum(pb * tb * v) + e) / (F.sum(pb * v) + e)).alias("precision_at_05"),
        ((F.sum(pb * tb * v) + e) / (F.sum(tb * v) + e)).alias("recall_at_05"),
        ((2 * F.sum(pb * tb * v) + e) / (F.sum((pb + tb) * v) + e)).alias("f1_at_05"),
    )
    return one.groupBy(channel).agg(*[F.avg(c).alias(c) for c in ("mae", "soft_dice", "precision_at_05", "recall_at_05", "f1_at_05")])


def simple_f1(tp: Column, predicted: Column, actual: Column) -> Column:
    """F1 that is 1 where nothing is predicted and nothing is there."""
    return F.coalesce(2 * tp / F.nullif(predicted + actual, F.lit(0)), F.lit(1.0))


def epochs_since_best(df: DataFrame, run: str, epoch: str, value: str, patience: int) -> DataFrame:
    """Per run and epoch the best value so far, the epoch that first reached it, and whether patience has run out."""
    w = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    best = F.min(F.struct(F.col(value), F.col(epoch))).over(w)
    rows = df.withColumn("best", best)
    return rows.select(run, epoch, value, F.col("best")[value].alias("best_value"), F.col("best")[epoch].alias("best_epoch"), (F.col(epoch) - F.col("best")[epoch] >= patience).alias("stop"))


def ctc_collapse(path: Column, blank: int = 0) -> Column:
    """Token ids without repeats of the one before, then without blanks. Each id is paired with the one before it first,
    so the path is not looked up again for every element."""
    before = F.concat(F.array(F.lit(None).cast("int")), F.slice(path, F.lit(1), F.greatest(F.lit(0), F.size(path) - 1)))
    paired = F.zip_with(path, before, lambda x, p: F.struct(x.alias("x"), p.alias("p")))
    kept = F.filter(paired, lambda e: e["x"].isNotNull() & ~e["x"].eqNullSafe(e["p"]) & (e["x"] != blank))
    return F.transform(kept, lambda e: e["x"])


def adjacent_repeats(text: Column) -> Column:
    """Characters equal to the one before."""
    return F.regexp_count(text, F.lit(r"(?s)(.)(?=\1)"))


def otsu_levels(histogram: DataFrame, image: str, level: str, n: str) -> DataFrame:
    """(image, level): the level that splits each image's histogram into two classes of the greatest variance between
    them; the least such level if there are several, null if all pixels have one level."""
    w = Window.partitionBy(image).orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(image)
    rows = histogram.groupBy(image, level).agg(F.sum(n).alias("n_")).withColumn("below", F.sum("n_").over(w)).withColumn("mass", F.sum(F.col("n_") * F.col(level)).over(w)).withColumn("all_", F.sum("n_").over(whole)).withColumn("all_mass", F.sum(F.col("n_") * F.col(level)).over(whole))
    rest = F.col("all_") - F.col("below")
    gap = F.col("mass") * rest - (F.col("all_mass") - F.col("mass")) * F.col("below")
    between = F.when(rest > 0, gap.cast("double") * gap / (F.col("below").cast("double") * rest))
    return rows.withColumn("between_", between).groupBy(image).agg(F.max(F.when(F.col("between_") > 0, F.struct(F.col("between_").alias("b"), (-F.col(level)).alias("l")))).alias("x")).select(image, (-F.col("x.l")).alias(level))


def length_group(low: Column, high: Column) -> Column:
    """Name of a grid's length condition; any other pair of bounds is an error."""
    return F.when((low == 5) & (high == 5), "short5").when((low == 20) & (high == 25), "normal").when((low == 80) & (high == 80), "long80").otherwise(F.raise_error(F.lit("unknown length condition")).cast("string"))


def best_results(best: DataFrame, log: DataFrame, run: str, kinds: list[str], first: str = "validation") -> DataFrame:
    """(run, epoch, step, kind, value): what was measured at each run's best checkpoint.

    best (run, epoch, step, value), log (run, epoch, step, kind, value). Only events of the given kinds at the best's
    own epoch and step count, never the last epoch's. A run without an event of kind `first` there gets best's value.
    """
    at = best.select(run, "epoch", "step")
    found = log.where(F.col("kind").isin(kinds)).join(at, [run, "epoch", "step"], "left_semi").select(run, "epoch", "step", "kind", "value")
    have = found.where(F.col("kind") == first).select(run).distinct()
    return found.unionByName(best.join(have, run, "left_anti").select(run, "epoch", "step", F.lit(first).alias("kind"), "value"))


def alias_decision(separate: Column, supported: Column, identical: Column) -> Column:
    """What an audit of look-alike characters decides, from how many fonts have all of them and in how many they are drawn
    alike. The wording is fixed."""
    return (
        F.when(separate, "別クラス維持（方針）")
        .when(supported == 0, "判定不能（共通の対応書体なし）")
        .when(identical == supported, "統合候補（比較できた全書体で一致）")
        .when(identical > 0, "統合検討（書体によって一致・不一致）")
        .otherwise("要目視確認（完全一致なし）")
    )


def audited_pairs(pairs: DataFrame, glyphs: DataFrame) -> DataFrame:
    """(a, b, supported, identical, decision) of pairs (a, b, separate), by glyphs (font, character, signature): fonts with
    both characters, and those where both have one signature."""
    one = glyphs.groupBy("font", "character").agg(F.min("signature").alias("signature"))
    a, b = one.select("font", F.col("character").alias("a"), F.col("signature").alias("sa")), one.select("font", F.col("character").alias("b"), F.col("signature").alias("sb"))
    met = pairs.join(a, "a").join(b, ["font", "b"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("supported"), F.count_if(F.col("sa") == F.col("sb")).alias("identical"))
    rows = pairs.join(met, ["a", "b"], "left").withColumn("supported", F.coalesce("supported", F.lit(0))).withColumn("identical", F.coalesce("identical", F.lit(0)))
    return rows.select("a", "b", "supported", "identical", alias_decision(F.col("separate"), F.col("supported"), F.col("identical")).alias("decision"))


def condition_grid(fonts: DataFrame, lengths: DataFrame) -> DataFrame:
    """(font, length_group): every Japanese with every Western font (columns japanese, western, a parameter table) under
    every length condition (low, high)."""
    keys = fonts.where("japanese").select(F.col("font").alias("j")).crossJoin(fonts.where("western").select(F.col("font").alias("w")))
    return keys.crossJoin(lengths.select(length_group(F.col("low"), F.col("high")).alias("length_group"))).select(F.concat_ws("+", "j", "w").alias("font"), "length_group")


@F.pandas_udf(T.StructType([T.StructField("mantissa", T.LongType()), T.StructField("exponent", T.IntegerType())]))
def _parts(value: pd.Series) -> pd.DataFrame:
    """value = mantissa x 2^exponent with a whole mantissa, exactly."""
    m, e = np.frexp(value.to_numpy(np.float64))
    known = np.isfinite(m)
    mantissa = np.where(known, m, 0.0) * 2.0**53
    return pd.DataFrame({"mantissa": pd.Series(mantissa.astype(np.int64)).where(known), "exponent": pd.Series(e - 53).where(known)})


@F.pandas_udf(T.DoubleType())
def _exact(parts: pd.Series) -> pd.Series:
    from fractions import Fraction

    return pd.Series([None if p is None else float(sum((Fraction(int(x["n"])) * Fraction(2) ** int(x["exponent"]) for x in p), Fraction(0))) for p in parts])


def exact_sums(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, total): sums of doubles rounded once at the end, whatever the order of the rows; nulls, infinities and what is
    no number are left out. Mantissas are summed as whole numbers per exponent, so what is gathered per key is at most
    one number for each of the 2,100 exponents."""
    each = df.select(*keys, _parts(F.col(value)).alias("p")).groupBy(*keys, "p.exponent").agg(F.sum(F.col("p.mantissa").cast("decimal(38,0)")).alias("n"))
    gathered = each.groupBy(*keys).agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("exponent", "n"))).alias("parts"))
    return gathered.select(*keys, _exact("parts").alias("total"))
