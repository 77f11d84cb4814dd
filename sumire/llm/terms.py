"""Frequency of every distinct term: integer dictionary, block count arrays, sums by identifier range."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import Workspace

#: Identifiers of one count array.
BLOCK = 65_536
#: Rows of a partition that are combined at once; distinct terms beyond it are passed on in parts.
COMBINE = 500_000


def dictionary(terms: DataFrame, work: Workspace) -> DataFrame:
    """(term, term_id): consecutive identifiers in term order over the whole collection.

    A range partitioning sorts the distinct terms; each partition numbers its own, and the driver learns only the
    number of terms of each partition.
    """
    local = work.write(terms.select("term").distinct().repartitionByRange("term").sortWithinPartitions("term").withColumn("mid", F.monotonically_increasing_id()), "ranked")
    sizes = local.groupBy(F.shiftright("mid", 33).cast("int").alias("part")).count().orderBy("part").collect()
    before, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    starts = terms.sparkSession.createDataFrame(offsets, "part int, start long")
    return local.withColumn("part", F.shiftright("mid", 33).cast("int")).join(F.broadcast(starts), "part").select("term", (F.col("start") + F.col("mid").bitwiseAND((1 << 33) - 1)).alias("term_id"))


def _combine(batches):
    """Adds up equal terms of a partition, so that what is shuffled is a row per partition and distinct term, however
    often the term occurs."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def added() -> pa.Table:
        table = pa.Table.from_batches(held).group_by("term").aggregate([("occurrences", "sum"), ("records", "sum")])
        return pa.table({"term": table["term"], "occurrences": table["occurrences_sum"], "records": table["records_sum"]})

    for batch in batches:
        # Spark's batches declare their counts as not null, combined tables don't; tables are made of one schema only.
        held.append(pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names))
        rows += batch.num_rows
        if rows >= COMBINE:
            table = added()
            if table.num_rows > COMBINE // 2:
                yield from table.to_batches()
                held, rows = [], 0
            else:
                held, rows = table.combine_chunks().to_batches(), table.num_rows
    if rows:
        yield from added().to_batches()


def _accumulate(batches):
    """Adds encoded counts of a partition into arrays, one per block of identifiers met; only cells that were met are
    passed on."""
    occ: dict[int, np.ndarray] = {}
    rec: dict[int, np.ndarray] = {}

    def flush():
        for b in list(occ):
            at = np.flatnonzero((occ[b] != 0) | (rec[b] != 0))
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), *(pa.array([x], pa.list_(t)) for x, t in ((at.astype(np.int32), pa.int32()), (occ[b][at], pa.int64()), (rec[b][at], pa.int64())))], names=["block", "at", "occ", "rec"])
        occ.clear()
        rec.clear()

    for batch in batches:
        term, n, m = (batch.column(c).to_numpy() for c in ("term_id", "occurrences", "records"))
        block = term // BLOCK
        for b in np.unique(block).tolist():
            own = block == b
            if b not in occ:
                if len(occ) == 256:
                    yield from flush()
                occ[b], rec[b] = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
            np.add.at(occ[b], term[own] % BLOCK, n[own])
            np.add.at(rec[b], term[own] % BLOCK, m[own])
    yield from flush()


def _sum(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sum of a block's arrays."""
    occ, rec = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
    for at, n, m in zip(pdf["at"], pdf["occ"], pdf["rec"]):
        occ[at] += n
        rec[at] += m
    met = np.flatnonzero((occ != 0) | (rec != 0))
    return pd.DataFrame({"term_id": pdf.block.iloc[0] * BLOCK + met, "occurrences": occ[met], "records": rec[met]})


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, occurrences, records) of rows (term, occurrences, records); null terms are ignored, null counts are 0.

    Rows may be raw (1, 1) or already counted. Equal terms of a partition are combined where they lie; the dictionary
    numbers all terms; the partitions' counts are encoded by it and added into arrays of BLOCK identifiers; and the
    arrays are summed by range of identifiers. A term that holds a third of all rows is one row per partition.
    """
    work = Workspace(rows.sparkSession)
    count = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    schema = "term string, occurrences long, records long"
    partial = work.write(rows.where("term is not null").select("term", count("occurrences"), count("records")).mapInArrow(_combine, schema), "partial")
    words = work.write(dictionary(partial, work), "dictionary")
    coded = partial.join(words, "term").select("term_id", "occurrences", "records")
    arrays = coded.mapInArrow(_accumulate, "block long, at array<int>, occ array<long>, rec array<long>")
    sums = arrays.groupBy("block").applyInPandas(_sum, "term_id long, occurrences long, records long")
    return words.join(sums, "term_id", "left").select("term", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce("records", F.lit(0)).alias("records"))


def array_terms(df: DataFrame, terms: str) -> DataFrame:
    """Raw rows for term_counts from an array column: each occurrence once, each record once per distinct term."""
    every = df.select(F.explode(terms).alias("term"), F.lit(1).alias("occurrences"), F.lit(0).alias("records"))
    return every.unionByName(df.select(F.explode(F.array_distinct(terms)).alias("term"), F.lit(0).alias("occurrences"), F.lit(1).alias("records")))


def mark(records: Column, total: Column, rare_below: int, common_above: float) -> Column:
    return F.when(records < rare_below, "rare").when(records > F.lit(common_above) * total, "common")


def latest_counts(coverage: DataFrame) -> DataFrame:
    """Valid rows of coverage: the latest by counted_at of each shard and character (ties: largest coverage_id)."""
    last = coverage.where("character is not null").groupBy("shard", "character").agg(F.max(F.struct("counted_at", "coverage_id", "sample_count", "corpus_occurrences")).alias("x"))
    return last.select("shard", "character", "x.sample_count", "x.corpus_occurrences")


def anchor_and_character_terms(train: DataFrame, coverage: DataFrame) -> DataFrame:
    """(field_name, term, occurrences, records, mark): all anchors and covered characters, unmarked ones with null.

    Terms stay as written. An anchor is rare below 3 rows and common above 0.5 % of the rows with an anchor; a
    character is rare below 3 rows over all shards and common above 5 % of all train rows.
    """
    anchors = term_counts(train.select(F.col("anchor").alias("term"), F.lit(1).alias("occurrences"), F.lit(1).alias("records")))
    chars = term_counts(latest_counts(coverage).select(F.col("character").alias("term"), F.col("corpus_occurrences").alias("occurrences"), F.col("sample_count").alias("records")))
    totals = train.agg(F.count("anchor").alias("with_anchor"), F.count(F.lit(1)).alias("all_rows"))
    out = anchors.crossJoin(F.broadcast(totals)).select(F.lit("anchor").alias("field_name"), "term", "occurrences", "records", mark(F.col("records"), F.col("with_anchor"), 3, 0.005).alias("mark"))
    return out.unionByName(chars.crossJoin(F.broadcast(totals)).select(F.lit("character").alias("field_name"), "term", "occurrences", "records", mark(F.col("records"), F.col("all_rows"), 3, 0.05).alias("mark")))
