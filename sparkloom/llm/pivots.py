"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by its nearest pivots (reference vectors), in order. The
first of these choose its inverted lists, one for each pair of them, so that
lists stay short; in a list, vectors that share enough of their nearest pivots
are candidates. A pair that meets in several lists is a candidate in one of
them only. Each candidate is verified by its cosine in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, cells, components, fold, lean


@dataclass(frozen=True)
class Pivots:
    """``pivots`` reference vectors, of which a vector is described by the ``nearest``.

    Two vectors are candidates if at least ``shared`` of those are common. Pivots
    come from a sample of at most ``sample`` rows, chosen by a hash of the id.
    A list key is a pair of a vector's ``prefix`` first pivots in either order, as
    near vectors may swap two. A list of more than ``block`` vectors is dealt into
    blocks, and each pair of blocks is work of its own.
    """

    cosine: float = 0.93
    pivots: int = 256
    nearest: int = 12
    prefix: int = 6
    shared: int = 5
    sample: int = 4096
    block: int = 512
    seed: int = 13


def choose(rows: np.ndarray, p: Pivots) -> np.ndarray:
    """Unit reference vectors: directions of sampled rows, each added only if it isn't close to an earlier one."""
    rng = np.random.default_rng(p.seed)
    dim = rows.shape[1] if rows.size else 1
    rows = rows[rng.permutation(len(rows))] if rows.size else rows
    out: list = []
    for v in rows:
        if len(out) == p.pivots:
            break
        if not out or np.max(np.array(out) @ v) < 0.8:
            out.append(v)
    while len(out) < p.pivots:
        v = rng.standard_normal(dim)
        out.append(v / np.linalg.norm(v))
    return np.array(out, np.float32)


def describe(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the nearest pivots of each vector, nearest first."""
    near = vectors.astype(np.float32) @ pivots.T
    part = np.argpartition(-near, nearest - 1, axis=1)[:, :nearest]
    by = np.argsort(-np.take_along_axis(near, part, axis=1), axis=1, kind="stable")
    return np.take_along_axis(part, by, axis=1).astype(np.int32)


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, so that squares neither overflow nor vanish."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def by_size(column, kind: str):
    """(row numbers, matrix of their vectors) for each length of the vectors in an Arrow binary column without nulls."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data, width = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.dtype(kind).itemsize
    size = np.diff(offsets)
    for n in np.unique(size):
        which = np.flatnonzero(size == n)
        yield which, data[offsets[which][:, None] + np.arange(n)].view(kind).reshape(len(which), n // width)


def packed(rows: DataFrame, kind: str) -> DataFrame:
    """vec_id, label and the vector's bytes, null for vectors that link with nothing."""

    @lean
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            lists = b.column("embedding")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            flat = lists.flatten().cast(pa.from_numpy_dtype(kind)).to_numpy(zero_copy_only=False).astype(kind, copy=False)  # null components become NaN
            stop = np.cumsum(size)
            bad = np.append(0, np.cumsum(~np.isfinite(flat)))
            some = np.append(0, np.cumsum(flat != 0))
            sound = (bad[stop] == bad[stop - size]) & (some[stop] > some[stop - size])
            out = [flat[z - n : z].tobytes() if ok else None for z, n, ok in zip(stop.tolist(), size.tolist(), sound.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "v"])

    return rows.mapInArrow(run, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, v binary")


def sampled_pivots(rows: DataFrame, kind: str, p: Pivots) -> dict:
    """Pivots by vector length, out of a sample of ``rows`` (vec_id, v)."""
    some = rows.where("v is not null").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(p.sample).select("v").collect()
    sizes: dict = {}
    for r in some:
        sizes.setdefault(len(r.v) // np.dtype(kind).itemsize, []).append(np.frombuffer(bytes(r.v), kind))
    return {n: choose(units(np.array(x)), p) for n, x in sizes.items()}


def indexed_classes(classes: DataFrame, pivots: dict, kind: str, p: Pivots) -> DataFrame:
    """``classes`` (class, label, rep, copies, v) with the nearest pivots of each vector, nearest first."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)  # at most ``sample`` vectors

    @lean
    def run(batches):
        import pyarrow as pa

        known = dict(shared.value)
        for b in batches:
            near = np.empty((len(b), p.nearest), np.int32)
            for which, m in by_size(b.column("v"), kind):
                n = m.shape[1]
                if n not in known:  # no vector of the sample has this length
                    known[n] = choose(np.zeros((0, n)), p)
                for at in range(0, len(which), 4096):
                    near[which[at : at + 4096]] = describe(units(m[at : at + 4096]), known[n], p.nearest)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * p.nearest, pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "near"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    return classes.mapInArrow(run, f"{kinds}, near array<int>")


def bits_of(pivots: np.ndarray, words: int) -> np.ndarray:
    """Rows of pivot numbers as bitmaps of ``words`` longs."""
    out = np.zeros((len(pivots), words), np.uint64)
    for k in range(pivots.shape[1]):
        np.bitwise_or.at(out, (np.arange(len(pivots)), pivots[:, k] >> 6), np.uint64(1) << (pivots[:, k] & 63).astype(np.uint64))
    return out


def inverted_lists(indexed: DataFrame, kind: str, p: Pivots) -> DataFrame:
    """A row (key, class) for each vector and pair of its first pivots, with bitmaps of longs.

    near*: the nearest pivots; first*: the ``prefix`` first of them; before*: those of the first that stand before
    the list's pair. The key holds the vector's length and the pair.
    """
    words = -(-p.pivots // 64)
    one, two = np.triu_indices(p.prefix, 1)

    @lean
    def run(batches):
        import pyarrow as pa

        width = np.dtype(kind).itemsize
        for batch in batches:
            for at in range(0, len(batch), 4096):
                b = batch.slice(at, 4096)
                near = b.column("near").flatten().to_numpy().astype(np.int64).reshape(len(b), -1)
                own, every = np.sort(near[:, : p.prefix], axis=1), np.repeat(np.arange(len(b)), len(one))
                s, t = own[:, one].ravel(), own[:, two].ravel()
                first = bits_of(own, words)[every]
                below = np.clip(t[:, None] - 64 * np.arange(words), 0, 64)  # bits of each long that stand before t
                mask = np.where(below == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(below, 63).astype(np.uint64)) - np.uint64(1)) & ~bits_of(s[:, None], words)
                size = b.column("size").to_numpy() // width
                key = (size[every] * p.pivots + s) * p.pivots + t
                bitmaps = [pa.array(np.ascontiguousarray(x[:, w]).view(np.int64)) for x in (bits_of(near, words)[every], first, first & mask) for w in range(words)]
                take = pa.array(every)
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column("label").take(take), b.column("class").take(take), *bitmaps], names)

    bitmaps = [f"{n}{w}" for n in ("near", "first", "before") for w in range(words)]
    names = ["key", "label", "class", *bitmaps]
    rows = indexed.select("label", "class", "near", F.octet_length("v").cast("long").alias("size"))
    made = rows.mapInArrow(run, f"key long, label {rows.schema['label'].dataType.simpleString()}, class long, " + ", ".join(f"{n} long" for n in bitmaps))
    return made.withColumn("key", F.xxhash64("label", "key")).drop("label")


def candidates(indexed: DataFrame, kind: str, scratch: Scratch, p: Pivots) -> DataFrame:
    """Pairs (a < b) of classes that meet in a list and share enough pivots.

    Each pair once: in the list of the two least of the first pivots that both have, so none may stand before the list's.
    """
    one, two = cells(scratch.table(inverted_lists(indexed, kind, p)), p.block, F.xxhash64("class"))
    x, y = one.alias("x"), two.alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    words = range(-(-p.pivots // 64))
    both = lambda u, v, w: F.col(f"x.{u}{w}").bitwiseAND(F.col(f"y.{v}{w}"))
    shared = sum((F.bit_count(both("near", "near", w)) for w in words), F.lit(0))
    earlier = F.lit(0).cast("long")
    for w in words:
        earlier = earlier.bitwiseOR(both("before", "first", w))
    return x.join(y, same & (F.col("x.class") < F.col("y.class")) & (earlier == 0) & (shared >= p.shared)).select(F.col("x.class").alias("a"), F.col("y.class").alias("b"))


def verified(pairs: DataFrame, indexed: DataFrame, kind: str, p: Pivots) -> DataFrame:
    """a, b, copies_a, copies_b of the pairs with equal labels and lengths and a cosine of at least ``cosine``."""

    @lean
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for at in range(0, len(batch), 1 << 14):
                part = batch.slice(at, 1 << 14)
                for (which, m), (_, n) in zip(by_size(part.column("v_a"), kind), by_size(part.column("v_b"), kind), strict=True):
                    keep[at + which] = (units(m) * units(n)).sum(axis=1) >= p.cosine
            yield batch.filter(pa.array(keep)).select(["a", "b", "copies_a", "copies_b"])

    one, two = (indexed.select(F.col("class").alias(c), F.col("v").alias(f"v_{c}"), F.col("copies").alias(f"copies_{c}"), F.col("label").alias(f"label_{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b").where((F.col("label_a") == F.col("label_b")) & (F.octet_length("v_a") == F.octet_length("v_b")))
    return both.select("a", "b", "copies_a", "copies_b", "v_a", "v_b").mapInArrow(run, "a long, b long, copies_a long, copies_b long")


def near_vectors(embeddings: DataFrame, p: Pivots = Pivots()) -> DataFrame:
    """One row for each row of ``embeddings`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Links join different vectors with equal labels that aren't null and a cosine
    of ``cosine`` or more. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with null vec_id, link with nothing; vectors of
    different length don't link. Equal vectors of a label are one class, whose
    links are counted (by distinct vec_id) without being emitted, so n_links is
    exact for what is found. A vec_id with several vectors is judged vector by
    vector. An empty table gives an empty result. Ids are whole numbers.
    """
    scratch = Scratch(embeddings.sparkSession)
    rows = fold(embeddings, "vec_id", "embedding", "label").withColumn("vec_id", F.col("vec_id").cast("long"))
    kind = "<f4" if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    rows = scratch.table(packed(rows, kind))
    pivots = sampled_pivots(rows, kind, p)
    classes = rows.where("v is not null and label is not null and vec_id is not null").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"))
    classes = classes.select(F.monotonically_increasing_id().alias("class"), "label", "rep", "copies", "v")  # numbers that the written table keeps
    indexed = scratch.table(indexed_classes(classes, pivots, kind, p))
    links = scratch.table(verified(candidates(indexed, kind, scratch, p), indexed, kind, p))
    counts = links.select(F.col("a").alias("class"), F.col("copies_b").alias("n")).union(links.select("b", "copies_a")).groupBy("class").agg(F.sum("n").alias("n"))
    parts = components(links.select("a", "b"), scratch).select(F.col("id").alias("class"), "component")
    least = parts.join(indexed.select("class", "rep"), "class").groupBy("component").agg(F.min("rep").alias("least"))
    named = indexed.select("class", "label", "v", "rep", "copies").join(counts, "class", "left").join(parts, "class", "left").join(least, "component", "left")
    named = named.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    own = rows.withColumn("v", F.when(F.col("vec_id").isNotNull(), F.col("v"))).join(named, ["label", "v"], "left")
    out = own.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op1_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op1_pivots": op1_pivots}
ORACLES = {}
