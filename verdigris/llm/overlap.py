"""Problem 3: records of an evaluation split that stand, exactly or nearly, in the training split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.sets import shingle_set
from verdigris.plans.scratch import keep, materialise, scratch

BLOCK = 4_000_000  # shingles of training texts that a task indexes at once
SEEN = 1 << 25  # places of a block's first sieve
BINS = 1 << 21  # counters of a sample of at most about BLOCK shingles, which order an evaluation text's shingles
BATCH = 2000  # evaluation texts compared with a block at once


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles fall in each of ``BINS``."""
    n = np.zeros(BINS, np.int64)
    for b in batches:
        n += np.bincount(b["x"].flatten().to_numpy(zero_copy_only=False) & (BINS - 1), minlength=BINS)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (some.astype(np.int32), n[some].astype(np.int32))], ["bin", "n"])


def _asked(files: list[str]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """The evaluation texts, some at a time: their names, shingles and where each one's begin and end."""
    for uri in files:
        fs, path = pa_fs.FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            for b in pq.ParquetFile(f).iter_batches(BATCH, columns=["txt", "x"]):
                x = b["x"]
                if len(x):
                    ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)
                    yield b["txt"], np.frombuffer(x.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.int64), (ends - ends[0]) // 8


class _Block:
    """Training texts and which of them have a shingle."""

    def __init__(self, txt: list[pa.Array], keys: list[np.ndarray], sizes: list[np.ndarray]):
        self.txt, self.keys, n = pa.concat_arrays(txt), np.concatenate(keys), np.concatenate(sizes)
        self.ends = np.r_[0, np.cumsum(n)]
        order = np.argsort(self.keys)
        s = self.keys[order]
        self.owner = np.repeat(np.arange(len(n), dtype=np.int32), n)[order]
        self.first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        self.items, self.df = s[self.first], np.diff(np.r_[self.first, len(s)])
        self.seen = np.zeros(SEEN, bool)
        self.seen[self.items & (SEEN - 1)] = True

    def met(self, x: np.ndarray, ends: np.ndarray, free: np.ndarray, least: np.ndarray, agree: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (evaluation text, training text) that meet in ``least`` of the probes, the first ``free + agree`` shingles of a text."""
        n = np.minimum(np.diff(ends), free + agree)
        at = np.repeat(ends[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        y, e = x[at], np.repeat(np.arange(len(n)), n)
        hit = np.flatnonzero(self.seen[y & (SEEN - 1)])
        hit = hit[(np.bincount(e[hit], minlength=len(n)) >= least)[e[hit]]]
        y, e = y[hit], e[hit]
        at = np.minimum(np.searchsorted(self.items, y), len(self.items) - 1)
        hit = self.items[at] == y
        e, at = e[hit], at[hit]
        hit = (np.bincount(e, minlength=len(n)) >= least)[e]
        e, at = e[hit], at[hit]
        df = self.df[at]
        upto, lo = np.cumsum(df), 0
        while lo < len(e):  # whole texts at a time; one has at most all of the block
            hi = max(np.searchsorted(upto, upto[lo] - df[lo] + BLOCK // 2, "right"), lo + 1)
            hi = np.searchsorted(e, e[hi - 1], "right") if e[hi - 1] == e[lo] or hi == len(e) else np.searchsorted(e, e[hi], "left")
            d = df[lo:hi]
            rows = np.repeat(self.first[at[lo:hi]] - (np.cumsum(d) - d), d) + np.arange(d.sum())
            code = np.repeat(e[lo:hi], d) * len(self.txt) + self.owner[rows]
            code.sort()
            start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            a, b = np.divmod(code[start], len(self.txt))
            hit = np.diff(np.r_[start, len(code)]) >= least[a]
            yield a[hit], b[hit]
            lo = hi


def split_overlap(texts: DataFrame, splits: DataFrame, id_col: str, text: str, split: str, train: str = "train", width: int = 3, share: tuple[int, int] = (3, 4), agree: int = 8) -> tuple[DataFrame, DataFrame]:
    """Which texts outside the split ``train`` have ``share`` of their distinct word runs within a training text.

    ``texts`` has the id and its text, in any number of rows; ``splits`` the id and its split.
    Returns ``members(id, txt, ev, tr)``, the distinct text of each id and whether the id is on the evaluation or
    the training side, and ``pairs(e, t, common, contained)`` of distinct texts, ``e`` the evaluation text. Equal
    texts are one text, so copies cost nothing; a text on both sides pairs with itself. Rows with a null id,
    text or split do not count, nor do texts of fewer than ``width`` words; repeated rows count once; an id with
    several texts has a row for each. Other columns are ignored. Empty tables give empty results.

    The shared part of a long training text may be small, so signatures tuned to a Jaccard similarity would lose
    pairs. Each task holds a block of training texts, with an index from shingle to text, and reads all evaluation texts,
    whose shingles were written once; no pair of texts travels or is written but those of the result, and the disk
    used is in proportion to the texts. An evaluation text of n shingles, of which f = n - ceil(share * n) may be missing,
    probes f + ``agree`` of them, those that are rarest in a sample of the training texts: of any f + c shingles a true partner has at least c, so a
    pair met in fewer than ``agree`` probes goes and no true pair is lost. Rare shingles are those that
    few blocks have, where most texts end, and stock phrases, which most texts have, are hardly ever probed.
    Candidates are verified on whole shingle sets. Tasks read the evaluation texts with Arrow, which must know the shared
    folder's file system. What a task holds is bounded by ``BLOCK``, whatever the size of the tables.
    """
    num, den = share
    rows = texts.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    rows = rows.withColumn("txt", F.concat(F.hex(F.xxhash64("text")), F.lit("."), F.hex(F.xxhash64(F.lit(11), F.col("text")))))
    sides = splits.select(F.col(id_col).cast("string").alias("id"), F.lower(F.trim(F.col(split))).alias("split")).where("id is not null and split is not null")
    sides = sides.groupBy("id").agg(F.max(F.col("split") != train).alias("ev"), F.max(F.col("split") == train).alias("tr"))
    size = BLOCK

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingle sets as bytes, which are read back without being taken apart, a text's rarest shingles first."""
        often = bins.value
        for b in batches:
            flat, n = b["x"].flatten().to_numpy(zero_copy_only=False), pc.list_value_length(b["x"]).to_numpy(zero_copy_only=False)
            flat = flat[np.lexsort((flat, often[flat & (BINS - 1)], np.repeat(np.arange(len(n)), n)))]
            ends = np.r_[0, np.cumsum(n)].astype(np.int32) * 8
            yield pa.RecordBatch.from_arrays([b["txt"], pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(flat)])], ["txt", "x"])

    def compare(block: _Block, files: list[str]) -> Iterator[pa.RecordBatch]:
        for names, x, ends in _asked(files):
            n = np.diff(ends)
            need = -(-n * num // den)
            for a, b in block.met(x, ends, n - need, np.minimum(agree, need), agree):
                common = np.array([len(np.intersect1d(x[ends[i] : ends[i + 1]], block.keys[block.ends[j] : block.ends[j + 1]], assume_unique=True)) for i, j in zip(a, b)], np.int32)
                ok = common >= need[a]
                a, b, common = a[ok], b[ok], common[ok]
                if len(a):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), block.txt.take(pa.array(b)), pa.array(common), pa.array(common / n[a])], ["e", "t", "common", "contained"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have = ([], [], []), 0
        for batch in batches:
            n = pc.list_value_length(batch["x"]).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, ends, lo = batch["x"].flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(n)], 0
            while lo < len(n):
                hi = max(int(np.searchsorted(ends, ends[lo] + size - have, "right")) - 1, lo + (not have))
                for part, new in zip(held, (batch["txt"].slice(lo, hi - lo), flat[ends[lo] : ends[hi]].copy(), n[lo:hi])):
                    part.append(new)
                have, lo = have + int(ends[hi] - ends[lo]), hi
                if lo < len(n):
                    yield from compare(_Block(*held), files)
                    held, have = ([], [], []), 0
        if have:
            yield from compare(_Block(*held), files)

    spark = texts.sparkSession
    with scratch(spark):
        members = keep(materialise(rows.select("id", "txt").distinct().join(sides, "id"), "members"))
        flags = members.groupBy("txt").agg(F.max("ev").alias("ev"), F.max("tr").alias("tr"))
        pool = materialise(rows.select("txt", "text").distinct().join(flags, "txt"), "texts")
        sets = lambda side: pool.where(side).select("txt", shingle_set(F.col("text"), width).alias("x")).where(F.size("x") > 0)
        length = pool.where("tr").agg(F.sum(F.length("text"))).first()[0] or 0
        some = sets("tr").where(F.pmod(F.xxhash64("txt"), F.lit(1 + length // size)) == 0).mapInArrow(_tally, "bin binary, n binary")
        counts = np.zeros(BINS, np.int64)
        for r in some.collect():
            counts[np.frombuffer(r.bin, np.int32)] += np.frombuffer(r.n, np.int32)
        bins = spark.sparkContext.broadcast(np.minimum(counts, 65535).astype(np.uint16))
        files = materialise(sets("ev").mapInArrow(packed, "txt string, x binary"), "asked").inputFiles()
        training = sets("tr").coalesce(max(3 * spark.sparkContext.defaultParallelism, length // size))  # few blocks, as each reads all evaluation texts
        pairs = training.mapInArrow(blocks, "e string, t string, common int, contained double")
        return members, keep(materialise(pairs, "overlaps"))


def overlapping_ids(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(eval_id, train_id, contained)`` for all ids of the texts in ``pairs``."""
    e = members.where("ev").select(F.col("id").alias("eval_id"), F.col("txt").alias("e"))
    t = members.where("tr").select(F.col("id").alias("train_id"), F.col("txt").alias("t"))
    return pairs.join(e, "e").join(t, "t").where("eval_id <> train_id").select("eval_id", "train_id", "contained")


def partner_counts(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(id, partners)``: with how many training ids each evaluation id overlaps, of those that do with any.

    Ids are counted a text, and the counts multiplied out over the pairs of texts; only ids that have several texts or stand on
    both sides are listed pair by pair.
    """
    single = members.groupBy("id").agg((F.count("*") == 1).alias("single"))
    m = members.join(single, "id")
    counts = m.where("tr and single").groupBy(F.col("txt").alias("t")).agg(F.count("*").alias("n"))
    plain = pairs.join(counts, "t").groupBy("e").agg(F.sum("n").alias("n"))
    several = m.where("tr and not single").select("id", F.col("txt").alias("t"))
    listed = pairs.join(several, "t").groupBy("e").agg(F.countDistinct("id").alias("n"))
    a_text = plain.union(listed).groupBy(F.col("e").alias("txt")).agg(F.sum("n").alias("partners"))
    simple = m.where("ev and single and not tr").join(a_text, "txt").select("id", "partners")
    rest = overlapping_ids(members.join(m.where("ev and (not single or tr)").select("id").distinct().withColumn("asks", F.lit(True)), "id", "left").withColumn("ev", F.col("ev") & F.col("asks").isNotNull()), pairs)
    return simple.union(rest.groupBy(F.col("eval_id").alias("id")).agg(F.countDistinct("train_id").alias("partners")))
