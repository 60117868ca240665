"""Hierarchical packing of token ids into windows of several lengths.

A document's whole windows of the longest length stand alone. What is left of
it is routed to the tier (a power of two) that just holds it. Each tier is
packed in turn, from the longest: a window starts with the longest piece of its
tier, its gap takes the longest pieces of shorter tiers that fit, and a piece is
cut only where none fits. Windows are full, so none is padded. The windows of a
tier are then dealt to step groups of equal length and about equal attention
cost.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.chat import TOKENIZER
from sparkloom.llm.common import fold, lean


@dataclass(frozen=True)
class Packing:
    """``longest`` and ``shortest`` window of the tiers, powers of two; ids packed together; ids of a step; the id after each document."""

    longest: int = 1024
    shortest: int = 64
    group: int = 1 << 20
    step: int = 1 << 14
    end: int = 0

    def __post_init__(self):
        if any(x < 1 or x & (x - 1) for x in (self.longest, self.shortest, self.step)) or not self.shortest <= self.longest <= self.step:
            raise ValueError("windows and steps are powers of two, the shortest first")

    @property
    def tiers(self) -> list[int]:
        """From the longest to the shortest."""
        return [1 << k for k in range(self.longest.bit_length() - 1, self.shortest.bit_length() - 2, -1)]


#: A piece is (document, first id, number of ids); a document is its place in the task and its ids.
Piece = tuple[tuple, int, int]


class Stock:
    """Pieces by length; the lengths at hand are the bits of one number, so the longest that fits is found at once."""

    def __init__(self):
        self.by: dict[int, list[Piece]] = {}
        self.bits = 0

    def put(self, piece: Piece) -> None:
        self.by.setdefault(piece[2], []).append(piece)
        self.bits |= 1 << piece[2]

    def take(self, most: int) -> Piece | None:
        """The last one put of the longest pieces of at most ``most`` ids."""
        length = (self.bits & ((2 << most) - 1)).bit_length() - 1
        if length < 1:
            return None
        same = self.by[length]
        piece = same.pop()
        if not same:
            self.bits ^= 1 << length
        return piece


def pack(stock: Stock, p: Packing) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows as (length, pieces), and the pieces of the one window that couldn't be filled any more."""
    windows, open_ = [], []
    for tier in p.tiers:
        above = tier // 2 if tier > p.shortest else 0
        while stock.bits >> (above + 1):
            held = [stock.take(tier)]
            gap = tier - held[0][2]
            while gap:
                piece = stock.take(gap)
                if piece is None:
                    piece = stock.take(tier)  # nothing fits: the longest piece left gives its first ids
                    if piece is None:
                        break
                    doc, start, length = piece
                    stock.put((doc, start + gap, length - gap))
                    piece = doc, start, gap
                held.append(piece)
                gap -= piece[2]
            if gap:
                open_ = held
            else:
                windows.append((tier, held))
    return windows, open_


def split_open(pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """The last pieces of a task as full windows: their total is a sum of powers of two."""
    windows, rest, queue = [], sum(x[2] for x in pieces), pieces[::-1]
    while rest:
        size = 1 << (rest.bit_length() - 1)
        held, gap = [], size
        while gap:
            doc, start, length = queue.pop()
            if length > gap:
                queue.append((doc, start + gap, length - gap))
                length = gap
            held.append((doc, start, length))
            gap -= length
        windows.append((size, held))
        rest -= size
    return windows


def in_steps(windows: list[tuple[int, list[Piece]]], p: Packing):
    """Lists of (length, pieces): the steps of each tier, numbers of windows even, costs (squares of the pieces' lengths) dealt to and fro."""
    for size in sorted({w[0] for w in windows}, reverse=True):
        own = sorted((w for w in windows if w[0] == size), key=lambda w: -sum(x[2] ** 2 for x in w[1]))
        n = -(-len(own) * size // p.step)
        steps = [[] for _ in range(n)]
        for k, w in enumerate(own):
            lap, place = divmod(k, n)
            steps[place if lap % 2 == 0 else n - 1 - place].append(w)
        yield from steps


def token_ranks(data: str) -> tuple[dict[bytes, int], dict[str, int], str]:
    """Ranks of a byte-level tokenizer file, its special tokens and its pattern.

    Such a file writes a byte as one character: printable ones as themselves,
    the others as the characters from 256 on, in their order.
    """
    import public_tokenizers

    spec = json.loads(data)
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}, special, public_tokenizers.PATTERN


class Encoder:
    """Ids of a byte-level tokenizer file.

    The file's ranks are encoded by tiktoken, which takes a third of the time of
    the tokenizers library and gives the same ids (tests compare them).
    """

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int], pattern: str):
        import tiktoken

        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = tuple(special)

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.encoding.encode(text, allowed_special="all")
        return self.encoding.encode_ordinary(text)


_encoders: dict = {}


def pack_documents(docs: DataFrame, p: Packing = Packing(), tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, start, length, ids (binary, little-endian unsigned 32 bits), doc_tokens, sequence_id, offset, context, step of each piece.

    A task packs its own rows, some ``group`` ids at a time, and hands what doesn't
    fill a window to its next group; so nothing is shuffled, no key is hot, and memory
    holds a group and one document. Its last pieces make windows of smaller
    powers of two. Sequences and steps are numbered by task and place.

    Null and empty texts are one id, the end. Rows with a null or repeated doc_id
    are packed one by one like others; long texts give many windows. Extra columns
    are left out; a table without rows gives none.
    """
    spark = docs.sparkSession
    data = spark.sparkContext.wholeTextFiles(tokenizer).first()[1] if "://" in tokenizer else open(tokenizer, encoding="utf-8").read()
    vocabulary = spark.sparkContext.broadcast(token_ranks(data))  # as large as the tokenizer file
    name = uuid.uuid4().hex

    @lean
    def run(batches):
        import pyarrow as pa

        if name not in _encoders:
            _encoders.clear()
            _encoders[name] = Encoder(*vocabulary.value)
        encode, first = _encoders[name].ids, TaskContext.get().partitionId() << 40
        sequence, step, stock, alone, held = first, first, Stock(), [], 0
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "context", "step"]

        def rows(windows):
            nonlocal sequence, step
            for group in in_steps(windows, p):
                for size, pieces in group:
                    at = 0
                    for (doc_id, ids), start, length in pieces:
                        yield doc_id, start, length, ids[start : start + length].tobytes(), len(ids), sequence, at, size, step
                        at += length
                    sequence += 1
                step += 1

        def out(windows):
            part = []
            for row in rows(windows):
                part.append(row)
                if len(part) == 4096:
                    yield batch(part)
                    part = []
            if part:
                yield batch(part)

        def batch(part):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if n == "ids" else pa.int64()) for x, n in zip(zip(*part, strict=True), names, strict=True)], names)

        for b in batches:
            for doc_id, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                ids = np.array([*encode(text.as_py() or ""), p.end], "<u4")
                doc, whole = (doc_id.as_py(), ids), len(ids) // p.longest * p.longest
                alone += [(p.longest, [(doc, at, p.longest)]) for at in range(0, whole, p.longest)]
                if whole < len(ids):
                    stock.put((doc, whole, len(ids) - whole))
                held += len(ids)
                if held >= p.group:
                    windows, rest = pack(stock, p)
                    yield from out(alone + windows)
                    alone, held, stock = [], 0, Stock()
                    for piece in rest:
                        stock.put(piece)
        windows, rest = pack(stock, p)
        yield from out(alone + windows + split_open(rest))

    rows = fold(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, context long, step long"
    return rows.mapInArrow(run, kind)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of each piece; the packer itself gives the ids."""
    pieces = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step")


QUERIES = {"op12_packing": op12_packing}
ORACLES = {}
