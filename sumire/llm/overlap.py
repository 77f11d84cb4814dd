"""Same or nearly the same records across splits: an edit-distance segment join.

Two texts within k edits of each other share at least one of any k + 1 disjoint segments of the first, and at a place
in the second that the edits left can reach. Evaluation texts are cut into k + 1 segments, training substrings are
matched at the allowed positions, and candidates are verified by banded dynamic programming. Which segments are cut
is free, so each text gets those that the training texts hold least often; this changes the work, never the result.
"""

from __future__ import annotations

import pickle
import re
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from ..session import Workspace, spread
from . import lookalike

#: Lengths a segment can have. Three characters are for texts of six or seven; shorter ones for greater percentages,
#: where k + 1 segments of three do not fit.
LENGTHS = (3, 4, 6, 9)
SHORT = (1, 2)
#: Percentage up to which k + 1 segments of one character fit into every text.
MOST_PERCENT = 45
#: Longer texts are cut at even places.
EVEN = 2000
#: Texts whose edits can shift a segment further than this are met wherever the segment stands.
REACH = 128
#: Width of the position buckets that are part of a segment's key.
BUCKET = 16
#: Bytes of evaluation text in one block; its index takes about six times as much.
BLOCK = 8_000_000
#: Blocks met in one job, and candidates that are held before they are verified.
TURN = 16
HELD = 2_000_000
#: Bits of a block's filter of segment keys.
FILTER_BITS = 25
#: Classes of the character counts that bound a distance from below.
CLASSES = 64
#: Grams of four characters held by more than this share of the texts are frequent; at most 1 / COMMON times the mean
#: length of a text exist.
COMMON = 1 / 2000
_GRAM = 4
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def bound(length: int, percent: int) -> int:
    return percent * length // 100


def longest_partner(n: int, percent: int) -> int:
    """The greatest m with m - n <= percent of m."""
    m = n
    while m + 1 - n <= bound(m + 1, percent):
        m += 1
    return m


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Packed:
    """Texts as one array of code points, with the hashes of all windows of one length."""

    def __init__(self, texts: list[str]):
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, position, hash) of every window of the length inside a text."""
        n = len(self.codes) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            h = np.full(n, np.uint64(length))
            for i in range(length):
                h = h * _A + self.codes[i : i + n].astype(np.uint64) + np.uint64(1)
            h = _mix(h)
        at = np.flatnonzero(self.doc[:n] == self.doc[length - 1 :])
        return self.doc[at], at - self.starts[self.doc[at]], h[at]

    def counts(self) -> np.ndarray:
        """Characters of each text in each of CLASSES hash classes, at most 255."""
        with np.errstate(over="ignore"):
            kind = (_mix(self.codes.astype(np.uint64) * _B) % np.uint64(CLASSES)).astype(np.int64)
        n = len(self.lengths)
        return np.minimum(np.bincount(self.doc * CLASSES + kind, minlength=n * CLASSES), 255).astype(np.uint8).reshape(n, CLASSES)


def _keyed(h: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(h + bucket.astype(np.uint64) * _B)


def _frequent_grams(share: float, chunk: int = 100_000):
    """Grams that a chunk of the partition's texts holds often; the chunks' counts are summed afterwards."""

    def run(batches):
        held: list[str] = []

        def flush():
            doc, _, h = Packed(held).windows(_GRAM)
            keys, n = np.unique(h, return_counts=True)
            often = n >= max(3, share * len(held) / 2)
            return pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["gram", "n"])

        for batch in batches:
            held += [t for t in batch.column("norm").to_pylist() if t]
            if len(held) >= chunk:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return run


def cut(texts: list[str], grams: np.ndarray, shares: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of the k + 1 disjoint segments of each text that cost least.

    A segment costs the share of texts that hold its rarest gram; grams that are not frequent count as COMMON, halved
    for each further one in the segment. Texts that allow no edit get none: their partners are equal. All texts of
    one length go through the dynamic programme together; long texts are cut evenly.
    """
    if not 0 <= percent <= MOST_PERCENT:
        raise ValueError(f"k + 1 segments fit into every text up to {MOST_PERCENT} percent only")
    packed = Packed(texts)
    doc, pos, h = packed.windows(_GRAM)
    value = np.full(len(h), 0.0, np.float32)
    if len(grams) and len(h):
        at = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
        value = np.where(grams[at] == h, shares[at], 0.0).astype(np.float32)
    out_doc, out_start, out_len = [], [], []
    for n in np.unique(packed.lengths):
        n = int(n)
        k = bound(longest_partner(n, percent), percent)
        if k == 0:
            continue
        own = np.flatnonzero(packed.lengths == n)
        if n > EVEN:
            each = max(x for x in (*SHORT, *LENGTHS) if x * (k + 1) <= n)
            at = np.arange(k + 1) * n // (k + 1)
            out_doc.append(np.repeat(own, k + 1))
            out_start.append(np.tile(at, len(own)))
            out_len.append(np.full(len(own) * (k + 1), each))
            continue
        lengths = LENGTHS if (k + 1) * LENGTHS[0] <= n else (*SHORT, *LENGTHS)
        for part in np.array_split(own, max(1, len(own) * n // 400_000)):
            cost = _costs(part, n, doc, value, lengths)
            best = np.zeros((len(part), n + 1), np.float32)
            picks = []
            for _ in range(k + 1):
                total = np.full((len(part), n + 1), np.inf, np.float32)
                used = np.zeros((len(part), n + 1), np.int8)
                for length in lengths:
                    if length > n:
                        continue
                    new = best[:, : n + 1 - length] + cost[length]
                    better = new < total[:, length:]
                    total[:, length:][better] = new[better]
                    used[:, length:][better] = length
                # Skipping characters costs nothing: the best end so far, and where it was.
                run = np.minimum.accumulate(total, axis=1)
                ends = np.where(total == run, np.arange(n + 1), 0)
                where = np.maximum.accumulate(np.where(np.concatenate((np.ones((len(part), 1), bool), total[:, 1:] < run[:, :-1]), axis=1), ends, 0), axis=1)
                picks.append((used, where))
                best = run
            at = np.full(len(part), n)
            rows = np.arange(len(part))
            for used, where in reversed(picks):
                end = where[rows, at]
                length = used[rows, end].astype(np.int64)
                out_doc.append(part)
                out_start.append(end - length)
                out_len.append(length)
                at = end - length
    if not out_doc:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(out_doc), np.concatenate(out_start), np.concatenate(out_len)


def _costs(part, n, doc, value, lengths) -> dict[int, np.ndarray]:
    lo = np.searchsorted(doc, part)
    width = max(0, n - _GRAM + 1)
    grams = value[lo[:, None] + np.arange(width)] if width else np.zeros((len(part), 0), np.float32)
    out = {}
    for length in lengths:
        if length > n:
            continue
        if length < _GRAM:
            out[length] = np.full((len(part), n - length + 1), 0.05 * 8.0 ** (3 - length), np.float32)
            continue
        held = np.lib.stride_tricks.sliding_window_view(grams, length - _GRAM + 1, axis=1)
        light = (held == 0).sum(axis=2)
        out[length] = np.where(light > 0, np.float32(COMMON) * np.float32(0.5) ** (light - 1), held.min(axis=2)).astype(np.float32)
    return out


class Block:
    """The segments of a block of evaluation texts, ready to be met by training substrings."""

    def __init__(self, cls: np.ndarray, texts: list[str], grams: np.ndarray, shares: np.ndarray, percent: int):
        self.cls, self.texts, self.percent = cls, texts, percent
        packed = Packed(texts)
        self.lengths, self.counts = packed.lengths, packed.counts()
        doc, start, length = cut(texts, grams, shares, percent)
        self.filter = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        #: Of each segment length, with places and without: keys, where each begins, texts and places.
        self.sizes, self.anywhere = [], []
        lengths, which = np.unique(self.lengths, return_inverse=True)
        reaches = np.array([bound(longest_partner(int(n), percent), percent) for n in lengths] or [0])[which if len(which) else slice(0, 0)]
        for size in (*SHORT, *LENGTHS):
            own = np.flatnonzero(length == size)
            if not len(own):
                continue
            d, s = doc[own], start[own]
            wd, wp, wh = packed.windows(size)
            h = wh[np.searchsorted(wd * (1 << 32) + wp, d * (1 << 32) + s)]
            near = reaches[d] <= REACH
            if near.any():
                self.sizes.append((size, *self._placed(h[near], d[near], s[near], reaches[d[near]])))
            if not near.all():
                far = np.unique(np.stack([_keyed(h[~near], np.full((~near).sum(), -1)).view(np.int64), d[~near]]), axis=1)
                self.anywhere.append((size, *self._indexed(far[0].view(np.uint64), far[1], np.full(far.shape[1], -1))))

    def _placed(self, h, d, s, reach):
        """One key for each bucket of places that the edits can move a segment to."""
        first, last = np.maximum(0, s - reach) // BUCKET, (s + reach) // BUCKET
        times = last - first + 1
        each = np.repeat(np.arange(len(h)), times)
        bucket = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
        return self._indexed(_keyed(h[each], bucket), d[each], s[each])

    def _indexed(self, keys, d, s):
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        slot = (keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
        np.bitwise_or.at(self.filter, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[heads], np.append(heads, len(keys)), d[order].astype(np.int32), s[order].astype(np.int32)

    def met(self, packed: Packed, limit: int = 4_000_000):
        """(evaluation, training) numbers of the pairs that share a segment at a reachable place and whose lengths and
        character counts allow the bound; in pieces of bounded size, however often a segment occurs."""
        counts = packed.counts()
        for size, *index in self.sizes:
            d, p, h = packed.windows(size)
            yield from self._hits(packed, counts, _keyed(h, p // BUCKET), d, p, index, limit)
        for size, *index in self.anywhere:
            d, p, h = packed.windows(size)
            _, once = np.unique(np.stack([d, h.view(np.int64)]), axis=1, return_index=True)
            yield from self._hits(packed, counts, _keyed(h[once], np.full(len(once), -1)), d[once], p[once], index, limit)

    def _hits(self, packed, counts, k, d, p, index, limit):
        keys, heads, docs, starts = index
        slot = (k & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
        on = np.flatnonzero(self.filter[slot >> 3] >> (slot & 7) & 1)
        at = np.minimum(np.searchsorted(keys, k[on]), len(keys) - 1)
        good = keys[at] == k[on]
        on, at = on[good], at[good]
        times = heads[at + 1] - heads[at]
        upto = np.cumsum(times)
        begin = 0
        while begin < len(on):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + limit, "right")))
            for low in range(0, int(times[begin]) if end == begin + 1 else 1, limit):
                t = np.minimum(times[begin:end] - low, limit) if end == begin + 1 else times[begin:end]
                each = np.repeat(np.arange(begin, end), t)
                member = heads[at[each]] + low + np.arange(len(each)) - np.repeat(np.cumsum(t) - t, t)
                yield self._reachable(packed, counts, docs[member], starts[member], d[on[each]], p[on[each]])
            begin = end

    def _reachable(self, packed, counts, e, e_pos, t, t_pos):
        n, m = self.lengths[e], packed.lengths[t]
        most = self.percent * np.maximum(n, m) // 100
        shift, grown = np.where(e_pos < 0, 0, t_pos - e_pos), m - n
        ok = np.flatnonzero(np.abs(shift) + np.abs(grown - shift) <= most)
        e, t, most = e[ok].astype(np.int64), t[ok], most[ok]
        # Few pairs pass the counts, so they are tested before repeats are removed.
        keep = []
        for part in range(0, len(e), 100_000):
            x, y = self.counts[e[part : part + 100_000]], counts[t[part : part + 100_000]]
            keep.append((np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.uint16) <= 2 * most[part : part + 100_000])
        keep = np.flatnonzero(np.concatenate(keep)) if keep else np.zeros(0, np.int64)
        pairs = np.unique(e[keep] << 32 | t[keep])
        return pairs >> 32, pairs & 0xFFFFFFFF


def _save(block: Block, folder: str) -> str:
    """Writes a block's index under a fresh name (a task that runs again leaves the first file unused)."""
    path = f"{folder}/{uuid.uuid4().hex}"
    fs, inside = pa.fs.FileSystem.from_uri(path)
    fs.create_dir(inside.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(inside) as out:
        out.write(pickle.dumps(block, pickle.HIGHEST_PROTOCOL))
    return path


@lru_cache(1)
def _load(path: str) -> Block:
    fs, inside = pa.fs.FileSystem.from_uri(path)
    with fs.open_input_stream(inside) as file:
        return pickle.loads(file.read())


def _matches(path: str):
    """Verified pairs of a block's evaluation texts and a partition's training texts."""

    def run(batches):
        block = None
        for batch in batches:
            block = block or _load(path)
            texts = batch.column("norm").to_pylist()
            if not texts or not len(block.texts):
                continue
            cls = batch.column("cls").to_numpy(zero_copy_only=False)
            held, size = [], 0
            right = [np.zeros(0, np.int64)]

            def verify():
                right.append(_verified(block, cls, texts, np.unique(np.concatenate(held))))
                held.clear()

            packed = Packed(texts)
            for e, t in block.met(packed):
                held.append(e << 32 | t)
                size += len(e)
                if size >= HELD:
                    verify()
                    size = 0
            if held:
                verify()
            # A pair that shares several segments can have been verified in several parts.
            pairs = np.unique(np.concatenate(right))
            yield pa.RecordBatch.from_arrays([pa.array(block.cls[pairs >> 32]), pa.array(cls[pairs & 0xFFFFFFFF])], names=["evaluation", "training"])

    return run


def _verified(block: Block, cls: np.ndarray, texts: list[str], pairs: np.ndarray) -> np.ndarray:
    """Those of the pairs (evaluation << 32 | training) of different texts that are within the bound."""
    e, t = pairs >> 32, pairs & 0xFFFFFFFF
    other = block.cls[e] != cls[t]
    e, t = e[other], t[other]
    size = np.maximum(block.lengths[e], [len(texts[i]) for i in t]).astype(np.int64)
    most = block.percent * size // 100
    order = np.argsort(size, kind="stable")
    ok = np.zeros(len(e), bool)
    begin = 0
    while begin < len(order):
        # Together the tables of the pairs of one part have some millions of cells.
        end = min(len(order), begin + 4096)
        while end > begin + 1 and (end - begin) * (2 * int(most[order[end - 1]]) + int(size[order[end - 1]])) > 2_000_000:
            end = begin + (end - begin) // 2
        own = order[begin:end]
        ok[own] = distances([block.texts[i] for i in e[own]], [texts[i] for i in t[own]], most[own].copy()) <= most[own]
        begin = end
    return (e << 32 | t)[ok]


def distances(left: list[str], right: list[str], limits: np.ndarray) -> np.ndarray:
    """Edit distances of pairs, limit + 1 where they exceed their limit; a band of limit on each side of the diagonal,
    all pairs at once."""
    n = np.fromiter(map(len, left), np.int64, len(left))
    m = np.fromiter(map(len, right), np.int64, len(right))
    out = limits + 1
    if not len(left):
        return out
    band = int(limits.max())
    rows, width = int(n.max()), 2 * band + 1
    a = np.zeros((len(left), rows), np.uint32)
    for i, t in enumerate(left):
        a[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    b = np.zeros((len(left), rows + 2 * band + int(m.max()) + 1), np.uint32)
    for i, t in enumerate(right):
        b[i, band : band + len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    # Outside the table stands more than any distance; short integers are enough for short texts.
    far = rows + int(m.max()) + width + 1
    kind = np.int16 if far + width < 32_000 else np.int32
    big, one = kind(far), kind(1)
    offset = np.arange(-band, band + 1, dtype=kind)
    # d[:, o] is the distance of the first i characters of a and the first i + o - band of b.
    d = np.where(offset >= 0, offset, big)[None, :].repeat(len(left), 0).astype(kind)
    live = n == 0
    out[live] = np.minimum(out[live], m[live])
    for i in range(1, rows + 1):
        same = b[:, i - 1 : i - 1 + width] != a[:, i - 1 : i]
        new = d + same
        np.minimum(new[:, :-1], d[:, 1:] + one, out=new[:, :-1])
        if i <= band:
            new[:, : band - i] = big
            new[:, band - i] = i
        new = np.minimum.accumulate(new - offset, axis=1) + offset
        d = new
        ended = np.flatnonzero(n == i)
        if len(ended):
            o = m[ended] - i + band
            inside = (o >= 0) & (o < width)
            out[ended[inside]] = np.minimum(out[ended[inside]], d[ended[inside], o[inside]])
    return out


_SPACES = re.compile(r"\s+")


def _normalised(model):
    def run(batches):
        for batch in batches:
            norm = [_SPACES.sub("", model.value.canonical(t).lower()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("article_id"), pa.array(norm, pa.string())], names=["row_id", "article_id", "norm"])

    return run


def valid_splits(article_splits: DataFrame) -> DataFrame:
    """(article_id, split, source) as of the latest assigned_at of each article."""
    last = article_splits.where("article_id is not null").groupBy("article_id").agg(F.max(F.struct("assigned_at", "split", "source")).alias("x"))
    return last.select("article_id", "x.split", "x.source")


def _built(grams: np.ndarray, shares: np.ndarray, percent: int, folder: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = Block(pdf.cls.to_numpy(), pdf.norm.tolist(), grams, shares, percent)
        return pd.DataFrame({"path": [_save(block, folder)]})

    return run


def class_pairs(classes: DataFrame, percent: int, work: Workspace | None = None, block: int = BLOCK) -> DataFrame:
    """(evaluation, training): pairs of different texts, of classes (cls, norm, evaluation, training), within the bound.

    The evaluation texts, a stated query set, are taken in blocks of about `block` bytes by hash. Executors build a
    block's index and put it into the shared folder; each training partition reads one block at a time and meets it
    where it lies, so neither substrings nor candidates are shuffled, no segment, however frequent, gathers in one
    task, and the driver sees names of blocks and counts only. The work grows with blocks times training texts.
    Workers open the shared folder by pyarrow (local, hdfs, s3, gs and abfs addresses).
    """
    if not 0 <= percent <= MOST_PERCENT:
        raise ValueError(f"percent must lie between 0 and {MOST_PERCENT}")
    spark = classes.sparkSession
    work = work or Workspace(spark)
    total, size = classes.agg(F.count(F.lit(1)), F.sum(F.when(F.col("evaluation"), F.octet_length("norm") + 1))).first()
    schema = "evaluation long, training long"
    if not size:
        return spark.createDataFrame([], schema)
    # At most the mean length of a text / COMMON grams are frequent.
    grams = classes.select("norm").mapInArrow(_frequent_grams(COMMON), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > COMMON * total).toArrow()
    order = np.argsort(grams.column("gram").to_numpy().view(np.uint64))
    keys, shares = grams.column("gram").to_numpy().view(np.uint64)[order], (grams.column("n").to_numpy()[order] / max(1, total)).astype(np.float32)
    trained = spread(classes.where("training").select("cls", "norm"))
    number = F.pmod(F.xxhash64(F.lit("block"), "cls"), F.lit(-(-size // block)))
    build = _built(keys, shares, percent, f"{work.address()}/blocks")
    blocks = [r.path for r in classes.where("evaluation").select(number.alias("number"), "cls", "norm").groupBy("number").applyInPandas(build, "path string").collect()]
    parts = []
    for begin in range(0, len(blocks), TURN):
        found = None
        for path in blocks[begin : begin + TURN]:
            one = trained.mapInArrow(_matches(path), schema)
            found = one if found is None else found.unionByName(one)
        parts.append(work.write(found, f"near{begin}"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def overlap_classes(train: DataFrame, article_splits: DataFrame, aliases: DataFrame | None = None, percent: int = 15) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (row_id, split, source, cls) of all rows with text, article and split, one class per
    distinct text in the consistent form without case and white space; pairs (evaluation, training) of classes within
    percent, equal ones included. Copies are never expanded here."""
    work = Workspace(train.sparkSession)
    model = lookalike.fit(train.select("text"), aliases)
    usable = spread(train.where("text is not null and article_id is not null").select("row_id", "article_id", "text"))
    norm = usable.mapInArrow(_normalised(train.sparkSession.sparkContext.broadcast(model)), "row_id long, article_id string, norm string")
    splits = valid_splits(article_splits).where("split in ('train', 'validation', 'test')")
    rows = norm.join(splits, "article_id").select("row_id", "split", "source", "norm", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"))
    rows = work.write(rows, "rows")
    classes = work.write(
        rows.groupBy("h1", "h2").agg(F.min("row_id").alias("cls"), F.first("norm").alias("norm"), F.max(F.col("split") != "train").alias("evaluation"), F.max(F.col("split") == "train").alias("training")), "classes"
    )
    near = class_pairs(classes, percent, work)
    same = classes.where("evaluation and training").select(F.col("cls").alias("evaluation"), F.col("cls").alias("training"))
    return rows.join(classes.select("h1", "h2", "cls"), ["h1", "h2"]).select("row_id", "split", "source", "cls"), near.unionByName(same)


def cross_split_pairs(train: DataFrame, article_splits: DataFrame, aliases: DataFrame | None = None, percent: int = 15) -> DataFrame:
    """(row_a, row_b, split, source): pairs row_a < row_b of a training row and a validation or test row whose texts,
    in the consistent form without case and white space, are within percent of the longer one's characters.

    `split` and `source` are those of the evaluation row. Rows without text, article or split are in no pair; empty
    texts are equal to each other. Equal texts are joined once per class and expanded here, at the end, because rows
    are asked for; overlap_report counts without expanding.
    """
    members, pairs = overlap_classes(train, article_splits, aliases, percent)
    e = members.where("split <> 'train'").select(F.col("cls").alias("evaluation"), F.col("row_id").alias("e"), "split", "source")
    t = members.where("split = 'train'").select(F.col("cls").alias("training"), F.col("row_id").alias("t"))
    return pairs.join(e, "evaluation").join(t, "training").select(F.least("e", "t").alias("row_a"), F.greatest("e", "t").alias("row_b"), "split", "source")


def overlap_report(train: DataFrame, article_splits: DataFrame, aliases: DataFrame | None = None, percent: int = 15) -> DataFrame:
    """(split, source, pairs): number of overlapping row pairs per evaluation split and source of the evaluation row,
    from the classes and how many rows each has."""
    members, pairs = overlap_classes(train, article_splits, aliases, percent)
    e = members.where("split <> 'train'").groupBy(F.col("cls").alias("evaluation"), "split", "source").agg(F.count(F.lit(1)).alias("e"))
    t = members.where("split = 'train'").groupBy(F.col("cls").alias("training")).agg(F.count(F.lit(1)).alias("t"))
    return pairs.join(t, "training").groupBy("evaluation").agg(F.sum("t").alias("t")).join(e, "evaluation").groupBy("split", "source").agg(F.sum(F.col("e") * F.col("t")).alias("pairs"))


def overlap_links(train: DataFrame, article_splits: DataFrame, aliases: DataFrame | None = None, percent: int = 15) -> DataFrame:
    """(row_id, split, cls, links): one row per row with text, article and split: its class and how many classes of the
    other side it is linked to."""
    members, pairs = overlap_classes(train, article_splits, aliases, percent)
    both = pairs.select(F.col("evaluation").alias("cls"), F.lit(False).alias("train_")).unionByName(pairs.select(F.col("training").alias("cls"), F.lit(True).alias("train_"))).groupBy("cls", "train_").agg(F.count(F.lit(1)).alias("links"))
    rows = members.withColumn("train_", F.col("split") == "train")
    return rows.join(both, ["cls", "train_"], "left").select("row_id", "split", "cls", F.coalesce("links", F.lit(0)).alias("links"))
