"""Target-distribution importance resampling of documents.

Hashed word and word-pair features of all documents and of the target's texts
give a gain for each bucket. Documents are scored by arrays: a block's words are
checksummed together, and a document's weight is a sum over its buckets. Each
task writes its eligible rows as sorted runs. Rows that may be drawn are dealt
into score ranges, and a tournament tree merges the segments of the runs in a
range, giving ranks until the exact number is drawn.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, column_bytes, fold, lean, lean_group


@dataclass(frozen=True)
class Resampling:
    """``percent`` of the documents with at least ``words`` words are drawn; ``run`` and ``cell`` are rows of a run and of a merged range."""

    seed: int = 7
    percent: int = 25
    words: int = 20
    buckets: int = 10_000
    run: int = 1 << 17
    cell: int = 1 << 17


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words, after lower-casing: digits, a-z and all of other characters.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> np.uint32(1)), _CRC >> np.uint32(1))
#: Longer words are checksummed one by one.
_LONG = 64


class Checksums:
    """CRC-32 of many slices of ``data`` at once: byte by byte, over the slices that are long enough."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.order = np.argsort(starts - ends, kind="stable")
        self.starts, self.ends, self.data = starts[self.order], ends[self.order], data
        sizes = self.ends - self.starts
        top = int(min(_LONG, sizes[0])) if len(sizes) else 0
        self.active = np.searchsorted(-sizes, -np.arange(top), "left")
        self.long = int(np.searchsorted(-sizes, -_LONG, "left"))

    def onto(self, crc: np.ndarray) -> np.ndarray:
        """The checksums ``crc`` of what stands before each slice, carried on over it."""
        c = ~crc[self.order]
        for at, n in enumerate(self.active):
            c[:n] = _CRC[(c[:n] ^ self.data[self.starts[:n] + at]) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
        c = ~c
        for k in range(self.long):
            c[k] = zlib.crc32(self.data[self.starts[k] + _LONG : self.ends[k]], int(c[k]))
        out = np.empty_like(c)
        out[self.order] = c
        return out


def features(column, buckets: int, chars: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of words, rows of features, buckets of features) of an Arrow string column, block by block.

    Blocks of about ``chars`` bytes end where no word is cut; the last word of a block is kept for the pair with the next block's first.
    """
    data, offsets = column_bytes(column)
    begins = np.unique(offsets[:-1])
    at, row, crc = 0, -1, np.zeros(1, np.uint32)  # row and checksum of the word before the block
    while at < len(data):
        end = min(at + chars, len(data))
        while end < len(data):  # on to the end of the word
            low = _LOWER[data[end - 1 : end + 4095]]
            stop = np.flatnonzero(~(_WORD[low[:-1]] & _WORD[low[1:]]))
            if len(stop):
                end += int(stop[0])
                break
            end += len(low) - 1
        low = _LOWER[data[at:end]]
        first = np.zeros(len(low) + 1, bool)
        first[0] = first[-1] = True
        first[begins[np.searchsorted(begins, at) : np.searchsorted(begins, end)] - at] = True
        word = np.concatenate(([False], _WORD[low], [False]))
        starts = np.flatnonzero(word[1:-1] & (~word[:-2] | first[:-1]))
        ends = np.flatnonzero(word[1:-1] & (~word[2:] | first[1:])) + 1
        rows = np.searchsorted(offsets, starts + at, "right") - 1
        sums = Checksums(low, starts, ends)
        single = sums.onto(np.zeros(len(starts), np.uint32))
        before = np.concatenate((crc, single))[:-1]
        paired = np.concatenate(([row], rows))[:-1] == rows
        spaced = ~(_CRC[(~before ^ np.uint32(32)) & np.uint32(255)] ^ (~before >> np.uint32(8)))
        double = sums.onto(spaced)[paired]
        yield rows, np.concatenate((rows, rows[paired])), np.concatenate((single, double)) % np.uint32(buckets)
        if len(starts):
            row, crc = int(rows[-1]), single[-1:]
        at = end


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: features of all texts; each task adds up its own first."""

    @lean
    def run(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, found in features(b.column("text"), buckets):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return fold(texts, "text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of each bucket, in thousandths; as many numbers as there are buckets."""
    counts = np.zeros((2, buckets), np.int64)
    for own, texts in zip(counts, (source, target), strict=True):
        for r in bucket_counts(texts, buckets).collect():
            own[r.bucket] = r.n
    total_s, total_t = (float(int(c.sum()) + buckets) for c in counts)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * total_s / ((float(s) + 1) * total_t))) for s, t in counts.T.tolist()], np.int64)


def sort_keys(score: np.ndarray, doc_id: np.ndarray, null: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Order of the draw: score from high to low, smaller ids first, null ids last, then fewer features."""
    return [-score, null, np.where(null, 0, doc_id), n]


def scored(docs: DataFrame, gain: np.ndarray, p: Resampling) -> DataFrame:
    """doc_id, n_features, weight, score, run, pos of every row; rows that can't be drawn have no run.

    A run is sorted by the order of the draw; its number is the task's and the run's in it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    key = F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")

    @lean
    def run(batches):
        import pyarrow as pa

        gain, task, number = sent.value, TaskContext.get().partitionId() << 32, 0
        names = ["doc_id", "n_features", "weight", "score", "run", "pos"]
        held, size = [], 0

        def flush():
            nonlocal number
            t = pa.Table.from_batches(held).combine_chunks()
            null, doc_id = t["doc_id"].is_null().to_numpy(), t["doc_id"].fill_null(0).to_numpy()
            order = np.lexsort(sort_keys(t["score"].to_numpy(), doc_id, null, t["n_features"].to_numpy())[::-1])
            t = t.take(pa.array(order)).append_column("run", pa.array(np.full(len(order), task + number))).append_column("pos", pa.array(np.arange(len(order))))
            number += 1
            yield from t.combine_chunks().to_batches(max_chunksize=1 << 16)

        for b in batches:
            words, n, weight = (np.zeros(len(b), np.int64) for _ in range(3))
            for of_words, of_features, found in features(b.column("text"), p.buckets):
                low = int(of_words[0]) if len(of_words) else 0
                for total, add in ((words, np.bincount(of_words - low)), (n, np.bincount(of_features - low)), (weight, np.bincount(of_features - low, gain[found]).astype(np.int64))):
                    total[low : low + len(add)] += add
            weight = np.where(n > 0, weight // np.maximum(n, 1), 0)
            score = weight + np.floor(-1000 * np.log(-np.log((b.column("h").to_numpy() + 0.5) / 4294967296))).astype(np.int64)
            rows = pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, (n, weight, score))], names[:4])
            may = words >= p.words
            if not may.all():
                rest = rows.filter(pa.array(~may))
                none = pa.nulls(len(rest), pa.int64())
                yield pa.RecordBatch.from_arrays([*rest.columns, none, none], names)
            if may.any():
                held.append(rows.filter(pa.array(may)))
                size += len(held[-1])
            if size >= p.run:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    rows = fold(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), h.alias("h"), "text")
    return rows.mapInArrow(run, "doc_id long, n_features long, weight long, score long, run long, pos long")


class Tournament:
    """Merges sorted lists: each inner node of the tree keeps the loser of its match, and a new head plays its way up only."""

    END = (math.inf,)

    def __init__(self, lists: list[list[tuple]]):
        self.lists, self.at = lists, [0] * len(lists)
        self.size = 1 << max(0, (len(lists) - 1).bit_length())
        self.losers: list = [None] * self.size
        won = [None] * self.size + [(self.head(k), k) for k in range(self.size)]
        for node in range(self.size - 1, 0, -1):
            won[node], self.losers[node] = sorted(won[2 * node : 2 * node + 2])
        self.winner = won[1]

    def head(self, k: int) -> tuple:
        return self.lists[k][self.at[k]] if k < len(self.lists) and self.at[k] < len(self.lists[k]) else self.END

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(list, position) of each element, in order."""
        while self.winner[0] is not self.END:
            k = self.winner[1]
            yield k, self.at[k]
            self.at[k] += 1
            best, node = (self.head(k), k), (self.size + k) >> 1
            while node:
                if self.losers[node] < best:
                    self.losers[node], best = best, self.losers[node]
                node >>= 1
            self.winner = best


def merge_range(table, base: int, draw: int):
    """Rows of one range with their ranks from ``base`` + 1 on; past ``draw`` the merge stops, and the rest has none."""
    import pyarrow as pa

    table = table.sort_by([("run", "ascending"), ("pos", "ascending")])
    run = table["run"].to_numpy()
    cuts = np.concatenate(([0], np.flatnonzero(run[1:] != run[:-1]) + 1, [len(run)]))
    null, doc_id = table["doc_id"].is_null().to_numpy(), table["doc_id"].fill_null(0).to_numpy()
    keys = list(zip(*(k.tolist() for k in sort_keys(table["score"].to_numpy(), doc_id, null, table["n_features"].to_numpy())), strict=True))
    tree = Tournament([keys[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    rank = np.zeros(len(run), np.int64)
    for k, (_, (which, at)) in enumerate(zip(range(draw - base), tree, strict=False)):
        rank[cuts[which] + at] = base + k + 1
    return table.select(["doc_id", "n_features", "weight", "score"]).append_column("rank", pa.array(rank, mask=rank == 0))


def resample(docs: DataFrame, target: DataFrame, p: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; rank is null for rows that aren't drawn.

    Null and empty texts have no features and weight 0. Rows with a null doc_id
    are scored like an empty id and come last among equal scores; rows that
    are equal in score and id follow by n_features, so repeated rows are drawn one
    by one. Long texts are read in blocks. Extra columns are left out; an empty
    table gives no rows, an empty target gains by the source's counts alone.

    The counts of equal scores (at most some 100,000, as scores are bounded whole
    numbers) settle which score the draw ends at; only rows from it on are dealt
    into ranges. Ranges are cut by score, id, run and place, so no tie makes one large.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.table(scored(docs, gains(docs, target, p.buckets), p))
    counts = sorted(((r.score, r.n) for r in rows.where("run is not null").groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draw = p.percent * sum(n for _, n in counts) // 100
    cut, near = None, 0
    for score, n in counts:
        if near >= draw:
            break
        cut, near = score, near + n
    none = F.lit(None).cast("long").alias("rank")
    out = ["doc_id", "n_features", "weight", "score"]
    if cut is None:
        return rows.select(*out, none)
    may = F.coalesce(F.col("run").isNotNull() & (F.col("score") >= cut), F.lit(False))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-near // p.cell))
    ranged = rows.where(may).repartitionByRange(parts, F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "run", "pos")
    ranged = scratch.table(ranged.withColumn("cell", F.spark_partition_id()))
    base, bases = 0, {}
    for r in ranged.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").collect():  # a row for each range
        bases[r.cell] = base
        base += r.n
    sent = spark.sparkContext.broadcast(bases)
    merge = lean_group(lambda table: merge_range(table, sent.value[table["cell"][0].as_py()], draw))
    merged = ranged.groupBy("cell").applyInArrow(merge, "doc_id long, n_features long, weight long, score long, rank long")
    return rows.where(~may).select(*out, none).unionByName(merged)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: CRC-32 has no function there: its table follows from the polynomial 0xEDB88320, and each distinct feature is folded over its bytes once.
OP11_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
  FROM range(256) AS t(i)
), texts AS (
  SELECT 's' AS side, row_number() OVER () AS k, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark
), words AS (
  SELECT side, k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), grams AS (
  SELECT side, k, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM words WHERE len(w) > 0
), counted AS (
  SELECT side, k, gram, count(*) AS n FROM grams GROUP BY ALL
), hexed AS (
  SELECT gram, hex(gram) AS h FROM (SELECT DISTINCT gram FROM counted)
), hashed AS (
  SELECT gram, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
         lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM hexed, crc
), cells AS (
  SELECT side, k, bucket, n FROM counted JOIN hashed USING (gram)
), sizes AS (
  SELECT bucket, sum(CASE WHEN side = 's' THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 't' THEN n ELSE 0 END) AS t FROM cells GROUP BY bucket
), totals AS (
  SELECT sum(s) AS ss, sum(t) AS tt FROM sizes
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(ss AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(tt AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM sizes, totals
), weights AS (
  SELECT k, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight
  FROM cells JOIN gains USING (bucket) WHERE side = 's' GROUP BY k
), scores AS (
  SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (k) WHERE side = 's'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, 25 * sum(CASE WHEN words >= 20 THEN 1 ELSE 0 END) OVER () // 100 AS draw FROM scores
)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= draw THEN place END AS rank FROM ranked
"""

QUERIES = {"op11_resampling": op11_resampling}
ORACLES = {"op11_resampling": OP11_SQL}
