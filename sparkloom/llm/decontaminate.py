"""Benchmark passages in documents, found by edit distance.

An item with at most k edits, cut into k + 1 pieces, keeps a piece unchanged
wherever the edits are, and of runs of u pieces one has fewer than u edits. So
every place of a document is looked up among the pieces; each hit names a run
of pieces (a block), whose edit distance to the text around the hit is computed
for many hits at once; and where a block fits, the edit distance of the whole
item is computed exactly. No step loses a passage within the limit, whatever
the item's length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, column_bytes, fold, lean, mix64, row_key

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Characters in 64 classes for the blocks' bit masks; the last one stands between texts and is in no block.
_CLASS = (np.arange(256) % 27 + 36).astype(np.uint8)
_CLASS[97:123], _CLASS[48:58] = np.arange(26), np.arange(26, 36)
_BETWEEN = 63
#: The longest run that one machine word of the bit-parallel distance holds, and the most bytes of a piece in its key.
_BLOCK, _KEY = 64, 16


@dataclass(frozen=True)
class Limits:
    """``edits`` is the largest edit distance as a share of the item's characters.

    Items go to the executors in chunks of about ``chunk_bytes`` of text at most,
    whose pieces take some 25 times that; each chunk is a pass over the documents.
    """

    edits: float = 0.1
    chunk_bytes: int = 2 << 20


def plain(data: bytes) -> str:
    """Lower-case A-Z and single spaces."""
    return " ".join(data.translate(_LOWER).decode("utf-8", "replace").split())


def narrow(text: str) -> np.ndarray:
    """A byte for each character. Equal characters have equal bytes, so distances never grow."""
    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 128, c, c & 127 | 128).astype(np.uint8)


def edit_distance_within(item: str, text: str) -> int:
    """Least edit distance of the item to any part of the text, by bit-parallel dynamic programming."""
    if item in text:
        return 0
    m, where = len(item), {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = where.get(c, 0)
        x = eq | down
        d = (((x & up) + up) ^ up) | x
        hp = down | (full & ~(d | up))
        hn = d & up
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = hp << 1, hn << 1
        up = full & (hn | ~(d | hp))
        down = full & hp & d
        best = min(best, score)
    return best


def piece_keys(text: np.ndarray, size: int) -> np.ndarray:
    """A key for the ``size`` bytes from every place, up to the last bytes of the array, which are padding."""
    eight = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
    if size < 8:
        return mix64(eight & np.uint64((1 << 8 * size) - 1) | np.uint64(size << 56))
    with np.errstate(over="ignore"):
        key = eight[: len(eight) - size + 8] * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        key += eight[size - 8 :]
        key *= np.uint64(0xC2B2AE3D27D4EB4F)
    key ^= key >> np.uint64(32)
    with np.errstate(over="ignore"):
        key *= np.uint64(0xFF51AFD7ED558CCD)
    return key


class Index:
    """Pieces of a chunk of items, and the blocks that they belong to."""

    def __init__(self, items: list[tuple[list[str], str]], p: Limits):
        self.items = items
        self.limit = [int(p.edits * len(t)) for _, t in items]
        item, offset, size, spare, found, where = [], [], [], [], {}, []
        for n, (_, t) in enumerate(items):
            text, pieces = narrow(t), self.limit[n] + 1
            cuts = [len(text) * k // pieces for k in range(pieces + 1)]
            k = 0
            while k < pieces:
                end = k + 1
                while end < pieces and cuts[end + 1] - cuts[k] <= _BLOCK:
                    end += 1
                stop = min(cuts[end], cuts[k] + _BLOCK)
                for j in range(k, end):
                    width = min(cuts[j + 1] - cuts[j], _KEY)
                    if not width:  # as many edits as characters are allowed
                        continue
                    found.setdefault(width, []).append((n, cuts[j], len(item), cuts[j] - cuts[k]))
                item.append(n)
                offset.append(cuts[k])
                size.append(stop - cuts[k])
                spare.append(end - k - 1)
                where.append(text[cuts[k] : stop])
                k = end
        self.block_item, self.block_offset, self.block_size, self.block_spare = (np.array(x, np.int64) for x in (item, offset, size, spare))
        self.masks = np.zeros((len(item) + 1) * 64, np.uint64)
        for b, text in enumerate(where):
            np.bitwise_or.at(self.masks, b * 64 + _CLASS[text].astype(np.int64), np.uint64(1) << np.arange(len(text), dtype=np.uint64))
        self.tables = {}
        narrowed = [np.append(narrow(t), np.zeros(_KEY, np.uint8)) for _, t in items]
        for width, rows in found.items():
            own = np.concatenate([narrowed[n][at : at + _KEY] for n, at, _, _ in rows] + [np.zeros(_KEY, np.uint8)])
            key = piece_keys(own, width)[: len(own) - _KEY : _KEY]
            by = np.argsort(key, kind="stable")
            bits = max(16, len(key).bit_length() + 5)
            may = np.zeros(1 << bits, bool)
            may[(key >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.tables[width] = key[by], np.array([r[2] for r in rows])[by], np.array([r[3] for r in rows])[by], bits, may

    def hits(self, text: np.ndarray, most: int = 1 << 18):
        """(block, place where the block would begin, place of the piece) of every piece in ``text``, which ends with ``_KEY`` bytes
        of padding; about ``most`` at a time."""
        for width, (key, block, ahead, bits, may) in self.tables.items():
            keys = piece_keys(text, width)
            at = np.flatnonzero(may[(keys >> np.uint64(64 - bits)).view(np.int64)])
            lo = np.searchsorted(key, keys[at])
            n = np.searchsorted(key, keys[at], "right") - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            total, i = np.append(0, np.cumsum(n)), 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
                k = np.arange(total[j] - total[i]) + np.repeat(lo[i:j] - total[i:j] + total[i], n[i:j])
                place = np.repeat(at[i:j], n[i:j])
                yield block[k], place - ahead[k], place
                i = j

    def fits(self, kind: np.ndarray, block: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Whether the text at each place (as classes) holds the block with no more edits than it may have."""
        out = np.empty(len(block), bool)
        for a in range(0, len(block), 1 << 14):
            b, spare = block[a : a + (1 << 14)], self.block_spare[block[a : a + (1 << 14)]]
            size = self.block_size[b]
            row, place = b * 64, begin[a : a + (1 << 14)] - spare
            top = (size - 1).astype(np.uint64)
            up, down = np.full(len(b), ~np.uint64(0)), np.zeros(len(b), np.uint64)
            score, one = size.copy(), np.uint64(1)
            best = score.copy()
            with np.errstate(over="ignore"):
                for k in range(int((size + 2 * spare).max())):
                    eq = self.masks[row + kind[np.clip(place + k, 0, len(kind) - 1)]]
                    x = eq | down
                    d = (((x & up) + up) ^ up) | x
                    hp = down | ~(d | up)
                    hn = d & up
                    score += ((hp >> top) & one).view(np.int64)
                    score -= ((hn >> top) & one).view(np.int64)
                    hp <<= one
                    up = (hn << one) | ~(d | hp)
                    down = hp & d
                    np.minimum(best, score, out=best)
            out[a : a + (1 << 14)] = best <= spare
        return out


def plain_blocks(column, chars: int = 1 << 20):
    """First row and plain texts of an Arrow string column, in blocks of about ``chars`` bytes."""
    data, offsets = column_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chars, "right")) - 1)
        yield row, [plain(data[offsets[k] : offsets[k + 1]].tobytes()) for k in range(row, stop)]
        row = stop


def leaks_of(column, index: Index):
    """(row, item number, edits) for every text and item within the limit."""
    limit, length = np.array(index.limit, np.int64), np.array([len(t) for _, t in index.items], np.int64)
    for row, texts in plain_blocks(column):
        sizes = np.array([len(t) for t in texts])
        first = np.cumsum(sizes + 1) - sizes - 1
        text = np.zeros(int(sizes.sum()) + len(texts) + _KEY, np.uint8)
        between = np.ones(len(text), bool)
        for t, a, n in zip(texts, first.tolist(), sizes.tolist(), strict=True):
            text[a : a + n] = narrow(t)
            between[a : a + n] = False
        kind = _CLASS[text].astype(np.int64)
        kind[between] = _BETWEEN
        kept: list = [np.zeros((3, 0), np.int64)]
        for block, begin, place in index.hits(text):
            fit = index.fits(kind, block, begin)
            kept.append(np.stack((np.searchsorted(first, place[fit], "right") - 1, index.block_item[block[fit]], begin[fit] - index.block_offset[block[fit]])))
        doc, item, at = np.unique(np.concatenate(kept, axis=1), axis=1)
        lo = np.maximum(at - limit[item] - first[doc], 0)
        hi = np.minimum(at + length[item] + limit[item] - first[doc], sizes[doc])
        # Places of an item ascend within a document, so what overlaps is one stretch of text.
        new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])))[: len(doc)])
        last = np.append(new[1:], len(doc))[: len(new)] - 1
        best: dict = {}
        for d, n, a, b in zip(doc[new].tolist(), item[new].tolist(), lo[new].tolist(), hi[last].tolist(), strict=True):
            if best.get((d, n)) != 0:
                e = edit_distance_within(index.items[n][1], texts[d][a:b])
                best[d, n] = min(e, best.get((d, n), e))
        for (d, n), e in best.items():
            if e <= index.limit[n]:
                yield row + d, n, e


def numbered(benchmark: DataFrame) -> DataFrame:
    """item_id, text and text_id, a digest of the text, of the items that have both."""
    some = fold(benchmark, "item_id", "text").where("item_id is not null and text is not null")
    return some.select(F.col("item_id").cast("long").alias("item_id"), "text", F.sha2("text", 256).alias("text_id"))


def chunks(benchmark: DataFrame, p: Limits) -> list[DataFrame]:
    """The distinct texts of the items, under their digests, in chunks whose text fits ``chunk_bytes``, dealt by a hash of the text."""
    some = numbered(benchmark).select("text_id", "text").distinct()
    size = some.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = 1 + 2 * int(size) // p.chunk_bytes
    return [some if n == 1 else some.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) for k in range(n)]


def leaks(docs: DataFrame, benchmark: DataFrame, p: Limits) -> DataFrame:
    """key, text_id (of an item's text), edits of ``docs`` (key, text); a key may come several times."""
    spark, out = docs.sparkSession, None
    kind = docs.schema["key"].dataType.simpleString()
    for chunk in chunks(benchmark, p):
        by: dict = {}
        for r in chunk.collect():  # at most about chunk_bytes of text
            by.setdefault(plain(r.text.encode()), set()).add(r.text_id)
        index = spark.sparkContext.broadcast(Index(sorted((sorted(ids), t) for t, ids in by.items() if t), p))

        @lean
        def run(batches, index=index):
            import pyarrow as pa

            for b in batches:
                rows = [(k, i, d) for k, item, d in leaks_of(b.column("text"), index.value) for i in index.value.items[item][0]]
                keys = b.column("key").take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["key", "text_id", "edits"])

        part = docs.mapInArrow(run, f"key {kind}, text_id string, edits long")
        out = part if out is None else out.union(part)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, p: Limits = Limits()) -> DataFrame:
    """doc_id, item_id, edits: every document and benchmark item within the edit limit.

    ``edits`` is the least edit distance (characters, A-Z lower-cased, white space
    as single spaces) of the item to a part of the text, whole words or not. The
    limit is rounded down, so an item of few characters may have no edits and is
    found wherever its characters stand. Null and empty texts and
    items match nothing, items with equal texts all match, repeated documents
    give one row an id, and a null doc_id is returned as such. Empty tables on either
    side give no rows.
    """
    found = leaks(fold(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("key"), "text"), benchmark, p)
    found = found.groupBy("key", "text_id").agg(F.min("edits").alias("edits"))
    ids = numbered(benchmark).select("item_id", "text_id").distinct()
    return found.join(ids, "text_id").groupBy(F.col("key").alias("doc_id"), "item_id").agg(F.min("edits").alias("edits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: Limits = Limits()) -> DataFrame:
    """The documents that hold no benchmark item; all columns stay.

    A doc_id goes with all its rows; rows without an id are judged by their own text.
    """
    found = leaks(docs.select(row_key().alias("key"), "text"), benchmark, p)
    hit = Scratch(docs.sparkSession).table(found.select(F.col("key").alias("_hit")).distinct())
    return docs.join(hit, row_key() == F.col("_hit"), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op3_decontamination": op3_decontamination}
ORACLES = {}
