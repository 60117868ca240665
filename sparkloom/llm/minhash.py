"""Near-duplicate documents by circulant MinHash.

One permutation of the shingle universe spreads the shingles; a second one,
read at circularly shifted places, gives every signature coordinate. So a
shingle's K values are K neighbours in one table and a signature is the
element-wise minimum of table slices. Equal bands propose links; each link is
confirmed on the whole shingle sets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, components, fold, lean, meet, mix64, runs, text_shingles


@dataclass(frozen=True)
class MinHash:
    """bands x rows coordinates: a pair at similarity 0.8 is missed with (1 - 0.8**5)**32, 3 in a million.

    Sets of a bucket are compared in blocks of ``block``, each pair of blocks as work of its own.
    """

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    rounds: int = 2
    block: int = 256
    log_universe: int = 20
    seed: int = 7


_tables: dict = {}


def circulant(p: MinHash) -> tuple[np.ndarray, np.ndarray]:
    """First permutation, and windows on the second: row s holds its K values from place s on, round the circle."""
    if p not in _tables:
        rng = np.random.default_rng(p.seed)
        d, k = 1 << p.log_universe, p.bands * p.rows
        first, second = rng.permutation(d).astype(np.uint32), rng.permutation(d).astype(np.uint32)
        _tables[p] = first, np.lib.stride_tricks.sliding_window_view(np.concatenate((second, second[: k - 1])), k)
    return _tables[p]


def signature(shingles: np.ndarray, p: MinHash) -> np.ndarray:
    first, second = circulant(p)
    places = first[(shingles & np.uint64((1 << p.log_universe) - 1)).astype(np.int64)]
    low = None
    for at in range(0, len(places), 2048):
        part = second[places[at : at + 2048]].min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return low


def band_keys(sig: np.ndarray, p: MinHash) -> np.ndarray:
    sig = sig.reshape(p.bands, p.rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.arange(1, p.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(p.rows):
            key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + sig[:, k])
    return key.view(np.int64)


def describe(docs: DataFrame, p: MinHash) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, the band keys (null for empty sets) and the set's bitmap."""

    @lean
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, one, two, keys, bits = [], [], [], [], []
            for s in text_shingles(batch.column("text"), p.words):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    one.append(int(np.add.reduce(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))).view(np.int64)) if len(s) else 0)
                    two.append(int(np.add.reduce(mix64(s * np.uint64(0xC2B2AE3D27D4EB4F))).view(np.int64)) if len(s) else 0)
                keys.append(band_keys(signature(s, p), p) if len(s) else None)
                bits.append(bitmap(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands", "bits"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, bits array<long>")


BITS = 1024


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A bit for each hash value modulo ``BITS`` that the set holds, in longs."""
    held = np.zeros(BITS, bool)
    held[(shingles >> np.uint64(20)).astype(np.int64) & (BITS - 1)] = True
    return np.packbits(held).view(np.int64)


def may_link(n_x, bits_x, n_y, bits_y, p: MinHash):
    """False only if the bitmaps prove too small an intersection: a bit that one set lacks is a shingle that it lacks.

    Set sizes and rows of zeros and ones of two lists of sets; a row of the result for each of the first.
    """
    both = bits_x @ bits_y.T
    shared = np.minimum((n_x - bits_x.sum(axis=1))[:, None] + both, (n_y - bits_y.sum(axis=1))[None, :] + both)
    return 100 * shared >= p.percent * (n_x[:, None] + n_y[None, :] - shared)


def plausible_pairs(state: DataFrame, p: MinHash) -> DataFrame:
    """Distinct pairs (a < b) of members (rep) of a bucket (key) that are in different components (part) and may link.

    Left out are pairs with a bucket's hub, which are tried already, and pairs that provably can't link: by their sizes,
    by their similarities to the hub, as Jaccard distance is a metric, and by their bitmaps, whose common bits are a
    matrix product. Bitmaps and similarities say nothing of an id with several ``sets``.

    Most members of a large bucket are in one component, and needn't meet each other: the largest component of a bucket
    and its other members are dealt into blocks of ``block``; each pair of blocks of both, and of the others, is a run.
    """

    @lean
    def run(batches):
        import pyarrow as pa

        for batch, cuts in runs(batches, ["key", "i", "j"]):
            rep, n, part, sets, own, i, j, most = (batch.column(c).to_numpy() for c in ("rep", "n", "part", "sets", "own", "i", "j", "most"))
            first_of = i - most  # below 0 if the run's first block is of the largest component
            main = batch.column("main").to_numpy(zero_copy_only=False)
            hub, sim = batch.column("hub").to_numpy(), batch.column("sim").to_numpy(zero_copy_only=False)
            bits = np.unpackbits(batch.column("bits").flatten().to_numpy().view(np.uint8)).reshape(len(batch), -1)
            first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                at = np.arange(lo, hi)
                if first_of[lo] < 0:
                    x, y = at[main[lo:hi]], at[~main[lo:hi]]
                else:
                    x, y = at[own[lo:hi] == first_of[lo]], at[own[lo:hi] == j[lo]]
                apart = (part[x][:, None] != part[y][None, :]) & (rep[x] != hub[x])[:, None] & (rep[y] != hub[y])[None, :]
                if first_of[lo] == j[lo]:
                    apart = np.triu(apart, 1)
                big, small = np.maximum(n[x][:, None], n[y][None, :]), np.minimum(n[x][:, None], n[y][None, :])
                apart &= 100 * small >= p.percent * big
                if not apart.any():
                    continue
                one = (sets[x] == 1)[:, None] & (sets[y] == 1)[None, :]
                near = ~(np.abs(sim[x][:, None] - sim[y][None, :]) > 1 - p.percent / 100 + 1e-9)  # also if one isn't known
                may = may_link(n[x].astype(np.float64), bits[x].astype(np.float32), n[y].astype(np.float64), bits[y].astype(np.float32), p)
                u, v = np.nonzero(apart & (near & may | ~one))
                first.append(np.minimum(rep[x[u]], rep[y[v]]))
                second.append(np.maximum(rep[x[u]], rep[y[v]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(second))], ["a", "b"])

    blocks = lambda c: F.ceil(c / p.block).cast("int")
    size = state.groupBy("key", "part").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "part")).alias("top"), F.sum("k").alias("all"))
    size = size.select("key", F.col("top.part").alias("top"), blocks(F.col("top.k")).alias("most"), blocks(F.col("all") - F.col("top.k")).alias("rest"))
    rows = meet(state, size, F.xxhash64("rep")).withColumn("main", F.col("part") == F.col("top"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("main"), F.col("most")).otherwise(F.col("rest"))).cast("int"))
    count, own = lambda c: F.sequence(F.lit(0), F.col(c) - 1), F.col("own")
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    with_main = F.transform(count("most"), lambda k: cell(k, own))
    with_rest = F.transform(count("rest"), lambda k: cell(F.col("most") + F.least(own, k), F.greatest(own, k)))
    cells = F.when(F.col("main"), F.transform(count("rest"), lambda k: cell(own, k))).otherwise(F.concat(with_main, with_rest))
    rows = rows.withColumn("cell", F.explode(cells)).select("key", "cell.i", "cell.j", "own", "most", "main", "rep", "n", "hub", "sim", "part", "sets", "bits")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(run, "a long, b long").distinct()


def measure(pairs: DataFrame, texts: DataFrame, p: MinHash) -> DataFrame:
    """a, b, sim (shared over union of the whole sets) and linked (100 * shared >= percent * union) for each pair.

    Only texts named by a pair are shuffled; a hub's pairs arrive together, so its set is built once per run.
    """

    @lean
    def run(batches):
        import pyarrow as pa

        last, hub = None, None
        for batch in batches:
            a, sim, linked = batch.column("a").to_pylist(), [], []
            left = batch.column("text_a")
            for k, other in enumerate(text_shingles(batch.column("text_b"), p.words)):
                text = left[k]
                if last is None or last[0] != a[k] or not last[1].equals(text):
                    last, hub = (a[k], text), next(text_shingles(pa.array([text.as_py()], pa.string()), p.words))
                both = np.concatenate((hub, other))
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                sim.append(shared / max(1, len(both) - shared))
                linked.append(len(both) > 0 and 100 * shared >= p.percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sim, pa.float64()), pa.array(linked, pa.bool_())], ["a", "b", "sim", "linked"])

    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    out = pairs.hint("merge").join(b.hint("merge"), "b").join(a.hint("merge"), "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, sim double, linked boolean")
    return out.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("linked").alias("linked"))


def near_duplicates(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents with equal sets are one class. Classes that share a band are
    compared with the bucket's smallest id, then (for all but the last of ``rounds``) with another
    member of the bucket if they are still in another component, and at last with
    all members of the bucket in other components. So the components are those
    that all pairs of all buckets would give, but pairs within a component are
    never made. The last step leaves out pairs that can't link: those whose bitmaps
    prove too few common shingles, and those whose similarities to the bucket's
    first hub differ by more than a link allows, as Jaccard distance is a metric.

    Null text counts as empty; empty texts and texts of white space have no
    shingles and link with nothing. A row with null doc_id links with nothing,
    its component_id is null and kept is true. Repeated rows share a component; a
    doc_id with several texts links what any of them links. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = fold(docs, "doc_id", "text")
    described = scratch.table(describe(docs, p))
    some = described.where("doc_id is not null and n_shingles > 0")
    classes = scratch.table(some.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("bits", "doc_id").alias("bits")))
    members = classes.select(F.explode("bands").alias("key"), "rep", F.col("n_shingles").alias("n"))
    hubs = members.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1").select("key", "hub")
    shared = scratch.table(members.join(hubs, "key").select("key", "rep", "n", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")))
    fits = lambda x, y: 100 * F.least(x, y) >= p.percent * F.greatest(x, y)
    texts = scratch.table(docs.join(shared.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").distinct())
    pairs = shared.where((F.col("rep") != F.col("hub")) & fits(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    tried = scratch.table(measure(pairs, texts, p))
    state = scratch.table(
        shared.drop("hub_n").join(tried.select(F.col("a").alias("hub"), F.col("b").alias("rep"), "sim"), ["hub", "rep"], "left").withColumn("sim", F.when(F.col("rep") == F.col("hub"), 1.0).otherwise(F.col("sim")))
    )
    links = tried.where("linked").select("a", "b")
    parts = scratch.table(components(links, scratch))
    for turn in range(p.rounds):
        state = scratch.table(mixed_buckets(state, parts))
        if state.isEmpty():
            break
        if turn < p.rounds - 1:
            draw = F.xxhash64("key", "rep", F.lit(turn))
            other = state.groupBy("key").agg(F.min_by(F.struct("rep", "n", "part"), draw).alias("x"))
            pairs = meet(state, other, F.xxhash64("rep")).where((F.col("part") != F.col("x.part")) & fits(F.col("n"), F.col("x.n")) & (F.col("rep") != F.col("hub")) & (F.col("x.rep") != F.col("hub"))).select(F.col("x.rep").alias("a"), F.col("rep").alias("b"))
        else:
            state = scratch.table(state.join(classes.select("rep", "bits").groupBy("rep").agg(F.min("bits").alias("bits"), F.count("*").alias("sets")), "rep"))
            pairs = plausible_pairs(state, p)
        found = scratch.table(measure(pairs.distinct(), texts, p))
        parts = scratch.table(components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).union(found.where("linked").select("a", "b")), scratch))
    named = classes.select("set_a", "set_b", "n_shingles", "rep").join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return (
        described.drop("bands", "bits")
        .join(named, ["set_a", "set_b", "n_shingles"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def mixed_buckets(state: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, with their component as ``part``."""
    state = state.drop("part").join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component")
    mixed = state.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("size")).where("lo < hi and size > 2").select("key")
    return meet(state, mixed, F.xxhash64("rep"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), MinHash(words=2))


QUERIES = {"op10_minhash": op10_minhash}
ORACLES = {}
