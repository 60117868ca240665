"""Sampled piece segmentations by forward filtering and backward sampling, and lossless decoding.

White space is written as word marks, so no piece crosses the start of a run of
marks and the lattice of a text falls into the lattices of its words. Forward
sums are computed once for each distinct word of a block; each occurrence is
then sampled backward with numbers drawn from the row's key and the place in
the text, so that a row gets the same pieces in any partition.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import fold, lean, mix64, powers
from sparkloom.llm.pieces import MARK, PIECE_MODEL, Pieces, load_pieces

_SPACE, _ALIEN = ord(MARK), 0x110000  # a mark that the text itself holds is no space
_BASE = 0xD1B54A32D192ED03
_INV = pow(_BASE, -1, 1 << 64)


@dataclass(frozen=True)
class Sampling:
    """A piece of rank r weighs (r + 1) ** -``sharpness``; a character outside the vocabulary weighs ``strange``, in logs."""

    sharpness: float = 1.0
    strange: float = -20.0
    seed: int = 5


class Lattice:
    """Tables over a vocabulary: a hashed trie, log weights and the bytes of each piece."""

    def __init__(self, pieces: Pieces, p: Sampling = Sampling()):
        self.p, n = p, len(pieces.text)
        self.weight = -p.sharpness * np.log1p(np.array(pieces.rank))
        step, end = {}, [-1]
        for i, text in enumerate(pieces.text):
            if i in pieces.special:
                continue
            v = 0
            for c in text:
                v = step.setdefault((v, ord(c)), len(end))
                if v == len(end):
                    end.append(-1)
            end[v] = i
        self.end = np.array(end)
        key = np.array([(v << 21) | c for v, c in step], np.uint64)
        to = np.array(list(step.values()), np.int64)
        self.bits = max(4, int(len(key)).bit_length() + 2)
        self.keys, self.to = np.full(1 << self.bits, np.uint64(1 << 63)), np.zeros(1 << self.bits, np.int64)
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = self.keys[slot[left]] == np.uint64(1 << 63)
            put, at = np.unique(slot[left[free]], return_index=True)
            chosen = left[free][at]
            self.keys[put], self.to[put] = key[chosen], to[chosen]
            left = np.setdiff1d(left, chosen)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        data = [t.replace(MARK, " ").encode() for t in pieces.text]
        for byte, i in enumerate(pieces.bytes_):
            data[i] = bytes([byte])
        for i in pieces.special - set(pieces.bytes_):
            data[i] = b""
        self.length = np.array([len(d) for d in data])
        self.offset = np.concatenate(([0], np.cumsum(self.length)))[:n]
        self.data = np.frombuffer(b"".join(data), np.uint8)
        self.byte = np.array(pieces.bytes_)

    def _slot(self, key):
        with np.errstate(over="ignore"):
            return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Trie nodes that follow; 0 where there is none."""
        key = (state.astype(np.uint64) << np.uint64(21)) | char.astype(np.uint64)
        slot = self._slot(key)
        seen = self.keys[slot]
        out = np.where(seen == key, self.to[slot], 0)
        left = np.flatnonzero((seen != key) & (seen != np.uint64(1 << 63)))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[left]]
            hit = seen == key[left]
            out[left[hit]] = self.to[slot[left[hit]]]
            left = left[~hit & (seen != np.uint64(1 << 63))]
        return out

    def words(self, chars: np.ndarray, starts: np.ndarray, length: np.ndarray):
        """Incoming edges of every lattice node of the given words, with cumulative shares of the forward sum.

        Nodes run by place in the word, then by word (longest first), so that the
        nodes of one place follow each other. Returns the node of place t of word
        w as base[t] + rank[w], and for each node its slice of (length, piece, share).
        """
        order = np.argsort(-length, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        alive = np.searchsorted(-length[order], -np.arange(1, length.max() + 1), "right")  # words with place t
        base = np.concatenate(([0], [len(length)], len(length) + np.cumsum(alive)))[: length.max() + 1]
        owner = np.repeat(np.arange(len(length), dtype=np.int32), length)
        inside = (np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)
        left = np.repeat(length, length).astype(np.int32) - inside
        text = chars[starts[owner] + inside]
        row = rank[owner]
        before, after = (base[inside] + row).astype(np.int32), (base[inside + 1] + row).astype(np.int32)
        del owner, inside, row
        state, at = np.zeros(len(text), np.int64), np.arange(len(text), dtype=np.int32)
        count = np.zeros(base[-1] + alive[-1] + 1, np.int32)
        edges, k = [], 0
        while len(at):
            state = self.step(state, text[at + k] if k else text)
            done = np.where(state > 0, self.end[state], -1)
            if k == 0:  # a character that is no piece still has an edge of its own
                edges.append((at, done.astype(np.int32), np.zeros(len(at), np.int32)))
                count[after] = 1
            else:
                ends = done >= 0
                start = at[ends]
                node = after[start + k]
                edges.append((start, done[ends].astype(np.int32), count[node]))
                count[node] += 1
            more = (state > 0) & (left[at] > k + 1)
            at, state = at[more], state[more]
            k += 1
        first = np.concatenate(([0], np.cumsum(count[:-1])))
        n = int(first[-1])
        size, piece, weight, source = np.empty(n, np.int32), np.empty(n, np.int32), np.empty(n), np.empty(n, np.int32)
        for k, (start, done, nth) in enumerate(edges):
            put = first[after[start + k]] + nth
            size[put], piece[put], source[put] = k + 1, done, before[start]
            weight[put] = np.where(done >= 0, self.weight[done], self.p.strange)
        del edges, before, after, left, text
        total, share = np.zeros(len(first)), np.empty(n)
        for t in range(1, len(base)):
            a, b = int(base[t]), int(base[t] + alive[t - 1])
            lo, hi = int(first[a]), int(first[b])
            v, heads = total[source[lo:hi]] + weight[lo:hi], first[a:b] - lo
            top = np.maximum.reduceat(v, heads)
            run = np.diff(np.append(heads, hi - lo))
            e = np.exp(v - np.repeat(top, run))
            s = np.add.reduceat(e, heads)
            total[a:b] = top + np.log(s)
            c = np.cumsum(e)
            share[lo:hi] = (c - np.repeat(c[heads] - e[heads], run)) / np.repeat(s, run)
        share[first[1:][np.diff(first) > 0] - 1] = 2.0  # the last edge of a node takes what rounding leaves
        return base, rank, first, size, piece, share

    def encode(self, texts: list, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts and where each text's ids end."""
        raw = [(" " + t).encode("utf-32-le", "surrogatepass") for t in texts]
        size = np.array([len(r) // 4 for r in raw])
        source = np.frombuffer(b"".join(raw), np.uint32)
        cuts = np.concatenate(([0], np.cumsum(size)))
        chars = np.where(source == 32, _SPACE, np.where(source == _SPACE, _ALIEN, source)).astype(np.int64)
        mark = chars == _SPACE
        head = mark.copy()
        head[1:] &= ~mark[:-1]
        head[cuts[:-1]] = True
        starts = np.flatnonzero(head)
        length = np.diff(np.append(starts, len(chars)))
        with np.errstate(over="ignore"):
            part = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(chars.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(chars)))))
            name = mix64((part[starts + length] - part[starts]) * powers(_INV, len(chars))[starts] + length.astype(np.uint64))
        del part
        _, sample, word = np.unique(name, return_index=True, return_inverse=True)
        base, rank, first, step, piece, share = self.words(chars, starts[sample], length[sample])
        text = np.searchsorted(cuts, starts, "right") - 1
        with np.errstate(over="ignore"):
            key = mix64(mix64(keys.astype(np.uint64) + np.uint64(self.p.seed)) + np.uint64(0x632BE59BD9B4E019))[text]
        place, row, out = length.copy(), rank[word], []
        live = np.arange(len(starts))
        while len(live):
            node = base[place[live]] + row[live]
            with np.errstate(over="ignore"):
                draw = mix64(key[live] + (starts[live] - cuts[text[live]] + place[live]).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
            draw = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = first[node]
            on = np.flatnonzero(share[edge] <= draw)
            while len(on):
                edge[on] += 1
                on = on[share[edge[on]] <= draw[on]]
            place[live] -= step[edge]
            out.append((live, piece[edge], starts[live] + place[live]))
            live = live[place[live] > 0]
        count = np.zeros(len(starts), np.int64)
        for who, _, _ in out:
            count[who] += 1
        after = np.cumsum(count)
        ids, at = np.empty(after[-1], np.int64), np.empty(after[-1], np.int64)
        for k, (who, what, where) in enumerate(out):
            ids[after[who] - 1 - k], at[after[who] - 1 - k] = what, where
        count = np.add.reduceat(count, np.searchsorted(text, np.arange(len(texts))))
        odd = np.flatnonzero(ids < 0)
        if len(odd):  # characters outside the vocabulary go byte by byte
            data = [chr(c).encode("utf-8", "surrogatepass") for c in source[at[odd]]]
            width = np.ones(len(ids), np.int64)
            width[odd] = [len(d) for d in data]
            count = np.add.reduceat(width, np.concatenate(([0], np.cumsum(count)[:-1])))
            wide = np.repeat(ids, width)
            wide[wide < 0] = self.byte[np.frombuffer(b"".join(data), np.uint8)]
            ids = wide
        return ids.astype(np.int32), np.cumsum(count)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """UTF-8 of all texts, and where each ends. A text's first byte is the space put before it and is dropped."""
        width = self.length[ids]
        stop = np.cumsum(width)
        data = self.data[np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.offset[ids] - stop + width, width)]
        ends = stop[ends - 1]
        return np.delete(data, np.concatenate(([0], ends[:-1]))).tobytes(), ends - np.arange(1, len(ends) + 1)


_lattices: dict = {}


def segment(docs: DataFrame, pieces: Pieces, p: Sampling = Sampling(), block: int = 1 << 20) -> DataFrame:
    """doc_id, pieces, n_pieces, lossless for each row: sampled ids and whether they decode to the very text.

    Null texts count as empty and give one piece, the space put before a text; a
    null doc_id counts as key 0. Repeated rows get the same pieces. An empty table gives no rows. Texts are
    taken whole, in blocks of about ``block`` bytes (a longer text is a block of its own).
    """
    shared = docs.sparkSession.sparkContext.broadcast((pieces, p))  # as large as the vocabulary file
    name = uuid.uuid4().hex

    @lean
    def run(batches):
        import pyarrow as pa

        if name not in _lattices:
            _lattices.clear()
            _lattices[name] = Lattice(*shared.value)
        lattice = _lattices[name]
        for b in batches:
            ids_of, texts, size = b.column("doc_id"), [], 0
            start = 0
            for k in range(len(b)):
                texts.append(b.column("text")[k].as_py() or "")
                size += len(texts[-1])
                if size >= block or k == len(b) - 1:
                    keys = ids_of.slice(start, k + 1 - start)
                    ids, ends = lattice.encode(texts, keys.fill_null(0).to_numpy())
                    data, stops = lattice.decode(ids, ends)
                    starts = [0, *stops[:-1]]
                    same = [data[a:z] == t.encode("utf-8", "surrogatepass") for a, z, t in zip(starts, stops, texts, strict=True)]
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([keys, lists, pa.array(np.diff(ends, prepend=0)), pa.array(same)], ["doc_id", "pieces", "n_pieces", "lossless"])
                    texts, size, start = [], 0, k + 1

    return fold(docs, "doc_id", "text").mapInArrow(run, "doc_id long, pieces array<int>, n_pieces long, lossless boolean")


def join_pieces(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, text: ``pieces`` decoded; a null or empty list gives an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)

    @lean
    def run(batches):
        import pyarrow as pa

        lattice = Lattice(shared.value)
        for b in batches:
            out = [lattice.decode(np.array(x, np.int64), np.array([len(x)]))[0].decode("utf-8") if x else "" for x in b.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return fold(encoded, "doc_id", "pieces").mapInArrow(run, "doc_id long, text string")


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(spark.read.parquet(f"{sf_dir}/documents.parquet"), load_pieces(PIECE_MODEL))


QUERIES = {"op8_sampled_pieces": op8_sampled_pieces}
ORACLES = {}
