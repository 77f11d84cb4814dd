"""Repetition inside a document: exact shares, and cutoffs with a proven limit on false rejection.

Every text gets a screening score that is never below its exact share and costs a fraction of it. Labelled holdouts
with exact binomial bounds give each stratum the score from which on a text is rejected at once; between the share
asked for and that cutoff the exact share decides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import Workspace, spread

#: Characters of the shortest stretch that counts as repeated.
STRETCH = 20
#: Characters handled at once; a longer document is handled alone.
CHUNK = 2_000_000
#: Strata (languages and the like) that there can be.
STRATA = 10_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, text of each, number per text), digits and white space left out."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = _codes("".join(texts))
    doc = np.repeat(np.arange(len(texts)), lengths)
    table = np.zeros(0x110000, bool)
    table[[c for c in np.unique(codes).tolist() if (ch := chr(c)).isspace() or ch.isdecimal()]] = True
    keep = ~table[codes]
    return codes[keep], doc[keep], np.bincount(doc[keep], minlength=len(texts))


def _window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """64-bit polynomial hashes of all windows of a width, built from hashes of half windows by binary powers."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * _MULT
    h ^= h >> np.uint64(29)
    size, parts, done = 1, width, None
    with np.errstate(over="ignore"):
        while parts:
            if parts & 1:
                done = (h, size) if done is None else (done[0][: len(h) - done[1]] * np.uint64(0xC2B2AE3D27D4EB4F) + h[done[1] :], done[1] + size)
                done = (done[0] ^ (done[0] >> np.uint64(31)), done[1])
            parts >>= 1
            if parts:
                h = h[: len(h) - size] * np.uint64(0xD6E8FEB86659FD93) + h[size:]
                h ^= h >> np.uint64(32)
                size *= 2
    return done[0][: len(codes) - width + 1]


def _again(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which of the hashes, in order of place, stood earlier in the same text: one sort of (text, hash) keys."""
    with np.errstate(over="ignore"):
        key = h ^ ((doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(h), bool)
    ranked = key[order]
    again[order[1:]] = ranked[1:] == ranked[:-1]
    return again


def _covered(starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, count: int) -> np.ndarray:
    """Per text, the characters inside any of the spans."""
    edge = np.bincount(starts, minlength=len(doc) + 1) - np.bincount(ends, minlength=len(doc) + 1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=count)


def repeated_counts(texts: list[str], stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """(kept characters, repeated characters) of each text, digits and white space left out.

    A character is repeated if it lies in a window of `stretch` characters that already began earlier in the same
    text (overlaps count). All texts of the list are compared at once.
    """
    codes, doc, kept = _letters(texts)
    n = len(codes)
    if n < stretch:
        return kept, np.zeros(len(texts), np.int64)
    h = _window_hashes(codes, stretch)
    at = np.flatnonzero(doc[: n - stretch + 1] == doc[stretch - 1 :])
    begins = at[_again(h[at], doc[at])]
    return kept, _covered(begins, begins + stretch, doc, len(texts))


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """Least or greatest of every `width` neighbouring values."""
    size = 1
    while size * 2 <= width:
        values = best(values[:-size], values[size:])
        size *= 2
    return values if size == width else best(values[: len(values) - (width - size)], values[width - size :])


def screened_counts(texts: list[str], stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """(kept characters, characters that may be repeated) of each text: never less than repeated_counts gives.

    Of the slightly shorter windows inside each stretch those of least hash are its marks, so equal stretches have an
    equal mark at the same place. A mark that stood earlier in the text may lie in a repeated stretch, and all
    characters of the stretches it can lie in are counted. Only marks, two fifths of all windows, are sorted. The longer
    the short windows, the more marks there are, and the closer the score comes to the share.
    """
    codes, doc, kept = _letters(texts)
    short = max(1, stretch - 3)
    span = stretch - short + 1
    n = len(codes) - stretch + 1
    if n <= 0:
        return kept, np.zeros(len(texts), np.int64)
    h = _window_hashes(codes, short) | np.uint64(1)
    least = _sliding(h, span, np.minimum)
    least = np.where(doc[:n] == doc[stretch - 1 :], least, np.uint64(0))
    pad = np.zeros(span - 1, np.uint64)
    marks = np.flatnonzero(_sliding(np.concatenate((pad, least, pad)), span, np.maximum) == h)
    marks = marks[_again(h[marks], doc[marks])]
    first = np.concatenate(([0], np.cumsum(kept)))
    own = doc[marks]
    return kept, _covered(np.maximum(marks - span + 1, first[own]), np.minimum(marks + stretch, first[own + 1]), doc, len(texts))


def _chunks(texts: list[str]):
    """(start, end) of parts of the list with about CHUNK characters; a longer text is a part of its own."""
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        yield start, end
        start = end


def _measure(stretch: int):
    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            kept, repeated = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for start, end in _chunks(texts):
                kept[start:end], repeated[start:end] = repeated_counts(texts[start:end], stretch)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("stratum"), pa.array(kept), pa.array(repeated)], names=["id", "stratum", "kept", "repeated"])

    return run


def _screen(stretch: int, share: float):
    """Scores of all texts; exact shares of those that were drawn for a holdout or score at least `share`."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            score, exact = np.zeros(len(texts)), np.full(len(texts), np.nan)
            drawn = batch.column("drawn").to_numpy(zero_copy_only=False)
            for start, end in _chunks(texts):
                kept, may = screened_counts(texts[start:end], stretch)
                score[start:end] = may / np.maximum(kept, 1)
                needed = np.flatnonzero(drawn[start:end] | (score[start:end] >= share)) + start
                kept, repeated = repeated_counts([texts[i] for i in needed], stretch)
                exact[needed] = repeated / np.maximum(kept, 1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("stratum"), batch.column("drawn"), pa.array(score), pa.array(exact, mask=np.isnan(exact))], names=["id", "stratum", "drawn", "score", "share"])

    return run


def _rows(documents: DataFrame, key: str, text: str, stratum: str) -> DataFrame:
    return documents.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(stratum).cast("string"), F.lit("none")).alias("stratum"), F.col(text).alias("text"))


def repetition_shares(documents: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", stretch: int = STRETCH) -> DataFrame:
    """(id, stratum, kept, repeated, share): one row per document, whole texts.

    Null and empty texts, and texts of nothing but digits and space, have share 0. A null stratum is `none`.
    """
    out = spread(_rows(documents, key, text, stratum)).mapInArrow(_measure(stretch), "id long, stratum string, kept long, repeated long")
    return out.withColumn("share", F.when(F.col("kept") > 0, F.col("repeated") / F.col("kept")).otherwise(F.lit(0.0)))


def screened(documents: DataFrame, share: float, per_stratum: int, key: str = "doc_id", text: str = "text", stratum: str = "lang", stretch: int = STRETCH) -> DataFrame:
    """(id, stratum, drawn, score, share): every document's score, an upper bound of its share, from its whole text.

    `drawn` marks about 4 x per_stratum rows of each stratum by hash, from which holdouts are taken. These and texts that
    score at least `share` get their exact share in the same pass; for others it is null. Texts are read once and never
    shuffled. More than STRATA strata are a ValueError.
    """
    rows = _rows(documents, key, text, stratum)
    sizes = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_")).limit(STRATA + 1).collect()
    if len(sizes) > STRATA:
        raise ValueError(f"more than {STRATA} strata")
    sizes = documents.sparkSession.createDataFrame([(r.stratum, r.n_) for r in sizes], "stratum string, n_ long")
    u = F.pmod(F.xxhash64(F.lit("holdout"), "id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = spread(rows).join(F.broadcast(sizes), "stratum").select("id", "stratum", "text", (u * F.col("n_") < 4 * per_stratum + 40).alias("drawn"))
    return drawn.mapInArrow(_screen(stretch, share), "id long, stratum string, drawn boolean, score double, share double")


def upper_bound(wrong: int, n: int, delta: float) -> float:
    """Exact (Clopper-Pearson) upper confidence bound of a rate, `wrong` of `n` seen, at confidence 1 - delta."""
    if n <= 0 or wrong >= n:
        return 1.0

    def below(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(wrong + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = wrong / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if 0 < mid < 1 and below(mid) > delta:
            low = mid
        else:
            high = mid
    return high


def holdout(scored: DataFrame, per_stratum: int) -> DataFrame:
    """At most per_stratum rows of each stratum, those of least hash.

    A stratum's size sets a hash threshold below which about twice as many rows lie; only these are ranked, so a
    stratum of any size reaches a task as a bounded number of rows.
    """
    order = F.xxhash64(F.lit("holdout"), "id")
    u = F.pmod(order, F.lit(1 << 30)) / float(1 << 30)
    sizes = scored.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_"))
    near = scored.join(sizes, "stratum").where(u * F.col("n_") < 2 * per_stratum + 20).drop("n_")
    ranked = near.withColumn("rank_", F.row_number().over(Window.partitionBy("stratum").orderBy(order, "id")))
    return ranked.where(F.col("rank_") <= per_stratum).drop("rank_")


def calibrate(labelled: DataFrame, grid: list[float], alpha: float = 0.002, delta: float = 0.05) -> dict[str, float]:
    """The least certified cutoff of each stratum, from labelled rows (stratum, score, good).

    For each stratum and cutoff, false rejections are good rows of at least that score. A cutoff is certified if
    the exact binomial upper bound of their rate is at most alpha, each test at delta / (strata x cutoffs)
    (Bonferroni), so with probability 1 - delta all certified cutoffs hold at once. Strata without a certified
    cutoff are absent. Only strata x cutoffs counts reach the driver.
    """
    tests = [F.sum((F.col("good") & (F.col("score") >= c)).cast("long")).alias(f"c{i}") for i, c in enumerate(grid)]
    counts = labelled.groupBy("stratum").agg(F.sum(F.col("good").cast("long")).alias("n"), *tests).orderBy("stratum").collect()
    each = delta / max(1, len(counts) * len(grid))
    out = {}
    for row in counts:
        held = [c for i, c in enumerate(grid) if upper_bound(row[f"c{i}"] or 0, row["n"] or 0, each) <= alpha]
        if held:
            out[row["stratum"]] = min(held)
    return out


def cutoff_grid(share: float) -> list[float]:
    """Cutoffs that are tried: even steps of a twelfth between the share and 1. The first lies above the share, because
    scores do: what scores closer to the share than that always gets its exact share."""
    return [round(share + (1 - share) * i / 12, 6) for i in range(1, 12)]


def _cutoff(found: dict[str, float]):
    """The stratum's certified cutoff; above every score where none was certified."""
    cutoff = F.lit(2.0)
    for stratum, c in found.items():
        cutoff = F.when(F.col("stratum") == stratum, F.lit(c)).otherwise(cutoff)
    return cutoff


def _labelled(scored: DataFrame, share: float, per_stratum: int, half: int) -> DataFrame:
    """A holdout (id, stratum, score, good) from one half of the drawn rows by hash; labels are the exact shares."""
    half_ = scored.where(F.col("drawn") & (F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2)) == half))
    return holdout(half_, per_stratum).select("id", "stratum", "score", (F.col("share") < share).alias("good"))


def repeated_documents(documents: DataFrame, share: float = 0.30, per_stratum: int = 4000, alpha: float = 0.002, delta: float = 0.05) -> DataFrame:
    """(id, stratum, score, cutoff, share): documents rejected for repetition.

    Every text is screened. A holdout per language (at most `per_stratum` rows by hash, the only sample taken), labelled
    by the exact share (good: below `share`), gives each language the least score from which on at most `alpha` of its
    good texts would be rejected, all such statements holding together with probability 1 - `delta`. Texts from the
    cutoff on are rejected by their score; texts that score below `share` are not, since their exact share is lower
    still; those between, and all of a language too small to certify a cutoff, are rejected if their exact share is at
    least `share`. Null and empty texts are never rejected. Repeated ids are judged row by row.
    """
    work = Workspace(documents.sparkSession)
    scored = work.write(screened(documents, share, per_stratum), "scores")
    found = calibrate(_labelled(scored, share, per_stratum, 0), cutoff_grid(share), alpha, delta)
    judged = scored.where((F.col("score") >= share) & F.col("id").isNotNull()).withColumn("cutoff", _cutoff(found))
    return judged.where((F.col("score") >= F.col("cutoff")) | (F.col("share") >= share)).select("id", "stratum", "score", "cutoff", "share")


def rejection_risk(documents: DataFrame, share: float = 0.30, per_stratum: int = 4000, alpha: float = 0.002, delta: float = 0.05) -> DataFrame:
    """(stratum, cutoff, good, false_rejections, rate, bound): the certified cutoffs on a second holdout.

    The second holdout comes from the half of the ids that calibration never sees and is labelled alike; bound is the
    exact upper bound of its rate at confidence 1 - delta. cutoff is null where none was certified (then nothing is
    rejected without its exact share).
    """
    work = Workspace(documents.sparkSession)
    scored = work.write(screened(documents, share, per_stratum), "scores")
    found = calibrate(_labelled(scored, share, per_stratum, 0), cutoff_grid(share), alpha, delta)
    second = _labelled(scored, share, per_stratum, 1).withColumn("cutoff", _cutoff(found))
    sums = second.groupBy("stratum", "cutoff").agg(F.count_if("good").alias("good"), F.count_if(F.col("good") & (F.col("score") >= F.col("cutoff"))).alias("false_rejections")).collect()
    rows = [(r.stratum, r.cutoff if r.cutoff <= 1 else None, r.good, r.false_rejections, r.false_rejections / r.good if r.good else None, upper_bound(r.false_rejections, r.good, delta)) for r in sums]
    return documents.sparkSession.createDataFrame(rows, "stratum string, cutoff double, good long, false_rejections long, rate double, bound double")
