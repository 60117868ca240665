"""Byte strings that repeat across documents, by difference-cover suffix sorting.

Sorting every suffix of a corpus moves many times its size, so the sort is
divided first, without losing a match. Of each window of ``length`` bytes the
gram with the least hash is its anchor; equal windows have equal anchors at
equal places. Anchors met in one document only are dropped, and each remaining
anchor's windows go to the anchor's bucket. There the suffixes of all contexts
are sorted by difference cover (sort sampled triples, recurse on their names,
merge the others in) as deep as a window is long, and adjacent prefixes are
compared; the smallest document of each run of equal windows decides.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import _TABLE, column_bytes, fold, lean_cogroup, lean_group, mix64, powers

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


@dataclass(frozen=True)
class Repeats:
    """Windows of ``length`` bytes, anchored at grams of ``gram`` bytes.

    Documents are dealt into some ``groups`` groups (and anchors into as many buckets) of ``group_bytes`` at
    least and ``most_bytes`` at most, so that the rows between them don't grow with the square of the input;
    a group's texts are read in blocks of ``group_bytes``.
    """

    length: int = 50
    gram: int = 26
    groups: int = 4096
    group_bytes: int = 4 << 20
    most_bytes: int = 32 << 20


# --- difference cover -------------------------------------------------------


_NARROW = 1 << 21


def ranked(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order of the rows of ``columns`` (most significant first) and where in it a new row begins."""
    if len(columns) == 1:
        order = np.argsort(columns[0], kind="stable")
    else:
        order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return order, new


def below(columns: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many rows of ``others`` (sorted) are less than each row of ``columns``."""
    if len(columns) == 1:
        return np.searchsorted(others[0], columns[0])
    n = len(columns[0])
    both = [np.concatenate(x) for x in zip(columns, others, strict=True)]
    order = np.lexsort([np.concatenate((np.zeros(n), np.ones(len(others[0])))), *both[::-1]])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(order >= n)
    return out[:n]


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``s`` (symbols from 1) by their suffixes; those equal over 3**depth symbols in any order."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    x = np.concatenate((s.astype(np.uint64), np.zeros(4, np.uint64)))
    narrow = n < _NARROW and int(s.max()) < _NARROW
    pack = lambda *c: [sum((v << np.uint64(21 * k) for k, v in enumerate(reversed(c))), np.uint64(0))] if narrow else list(c)
    sample = np.concatenate((np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)))
    order, new = ranked(pack(x[sample], x[sample + 1], x[sample + 2]))
    if not new.all() and depth > 1:
        name = np.empty(len(sample), np.int64)
        name[order] = np.cumsum(new)
        order = suffix_order(name, depth - 1)
        new[:] = True
    rank = np.zeros(n + 4, np.uint64)
    rank[sample[order]] = np.cumsum(new)
    placed = sample[order]
    placed = placed[placed < n]
    rest = np.arange(0, n, 3)
    one = lambda i: pack(x[i], rank[i + 1])
    two = lambda i: pack(x[i], x[i + 1], rank[i + 2])
    rest = rest[ranked(one(rest))[0]]
    before = np.zeros(len(placed), np.int64)
    for residue, key in ((1, one), (2, two)):
        mine = placed % 3 == residue
        before[mine] = below(key(placed[mine]), key(rest))
    at = np.arange(len(placed)) + np.maximum.accumulate(before)
    out, free = np.empty(n, np.int64), np.ones(n, bool)
    out[at] = placed
    free[at] = False
    out[free] = rest
    return out


# --- anchors ----------------------------------------------------------------


def string_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """A hash of each string data[start:stop], the same wherever it stands; ``start`` ascends. Works on some ``most`` bytes at a time."""
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        end = max(at + 1, int(np.searchsorted(start, start[at] + most)))
        lo = start[at]
        a, b = start[at:end] - lo, stop[at:end] - lo
        piece = data[lo : lo + b.max()]
        with np.errstate(over="ignore"):
            prefix = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_TABLE[piece] * powers(_BASE, len(piece)), out=prefix[1:])
            out[at:end] = mix64((prefix[b] - prefix[a]) * powers(_INV, len(piece) + 1)[a] + (b - a).astype(np.uint64))
        at = end
    return out


def ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    n = stop - start
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


def equal_strings(data: np.ndarray, start: np.ndarray, stop: np.ndarray, one: np.ndarray, two: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Whether the strings ``one`` and ``two`` (numbers of start and stop) are the same bytes. Contexts have few lengths, so those of a length go together."""
    size = stop - start
    same = size[one] == size[two]
    todo = np.flatnonzero(same & (one != two))
    todo = todo[np.argsort(size[one[todo]], kind="stable")]
    length = size[one[todo]]
    for lot in np.split(np.arange(len(todo)), np.flatnonzero(np.diff(length)) + 1) if len(todo) else ():
        rows = np.lib.stride_tricks.sliding_window_view(data, int(length[lot[0]]))
        step = max(1, most // int(length[lot[0]]))
        for at in range(0, len(lot), step):
            part = todo[lot[at : at + step]]
            same[part] = (rows[start[one[part]]] == rows[start[two[part]]]).all(axis=1)
    return same


def classes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings by class, and where in it a class begins: equal names propose a class, the bytes decide.

    Within a class the strings keep their order. Names of strings that differ from the first one of their class are changed.
    """
    name = name.copy()
    while True:
        order = np.argsort(name, kind="stable")
        new = np.concatenate(([True], name[order][1:] != name[order][:-1]))[: len(order)]
        first = order[new][np.cumsum(new) - 1]
        off = order[~equal_strings(data, start, stop, order, first)]
        if not len(off):
            return order, new
        name[off] = mix64(name[off] + np.uint64(1))


class Block:
    """Texts laid end to end, with the anchors of the windows that lie in one text."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray, p: Repeats):
        self.data, self.cuts, self.p = data, cuts, p

    def anchors(self, step: int = 1 << 18):
        """For each anchor with windows of a text: its place, first window, number of windows and its gram's hash.

        Works on ``step`` windows at a time, as nothing reaches beyond a window.
        """
        p, n = self.p, len(self.data)
        k, w = p.gram, p.length - p.gram + 1
        bits = np.uint64((step + p.length).bit_length())
        got: list = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]]
        for a in range(0, n - p.length + 1, step):
            b = min(a + step, n - p.length + 1)
            piece = self.data[a : b + p.length - 1]
            with np.errstate(over="ignore"):
                prefix = np.zeros(len(piece) + 1, np.uint64)
                np.cumsum(_TABLE[piece] * powers(_BASE, len(piece)), out=prefix[1:])
                hashes = mix64((prefix[k:] - prefix[:-k]) * powers(_INV, len(piece) - k + 1))
            low = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
            span = 1
            while span * 2 <= w:
                low = np.minimum(low[:-span], low[span:])
                span *= 2
            if span < w:
                low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
            # A window that begins less than its length before an edge lies in two texts.
            edges = self.cuts[np.searchsorted(self.cuts, a, "right") : np.searchsorted(self.cuts, b + p.length - 1)]
            crossing = np.zeros(b - a + 1, np.int64)
            np.add.at(crossing, np.maximum(edges - p.length + 1 - a, 0), 1)
            np.add.at(crossing, np.minimum(edges - a, b - a), -1)
            starts = np.flatnonzero(np.cumsum(crossing[:-1]) == 0)
            if not len(starts):
                continue
            anchor = (low[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
            place, first, count = anchor[new] + a, starts[new] + a, np.diff(np.append(new, len(starts)))
            last = got[-1]
            if len(last[0]) and last[0][-1] == place[0]:  # windows of one anchor on both sides of the step
                last[2][-1] += count[0]
                place, first, count, new = place[1:], first[1:], count[1:], new[1:]
            got.append([place, first, count, hashes[anchor[new]]])
        return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def blocks_of(table, p: Repeats):
    """Rows of a group in the order of (doc_id, text hash): row numbers, ids and a block of their texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    table = table.filter(pc.is_valid(table.column("doc_id"))).sort_by([("doc_id", "ascending"), ("mark", "ascending")])
    data, offsets = column_bytes(table.column("text").cast(pa.large_string()).combine_chunks())
    ids, row = table.column("doc_id").to_numpy().astype(np.int64), 0
    while row < len(ids):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + p.group_bytes, "right")) - 1)
        yield row, ids[row:stop], Block(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], p)
        row = stop


def pack(hashes: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel()


@dataclass(frozen=True)
class Sizes:
    """Numbers of groups and buckets, and bytes kept of an anchor's hash, all from the bytes of text.

    A short hash can only keep an anchor that it need not: at N anchors one in 2**14 of them at most.
    """

    groups: int
    width: int

    @staticmethod
    def of(n_bytes: int, p: Repeats) -> Sizes:
        size = min(max(p.group_bytes, n_bytes // p.groups), max(p.group_bytes, p.most_bytes))
        return Sizes(max(8, -(-n_bytes // size)), min(8, max(4, -(-(max(1, n_bytes // 10).bit_length() + 14) // 8))))

    def short(self, hashes: np.ndarray) -> np.ndarray:
        return hashes & np.uint64((1 << 8 * self.width) - 1)

    def bucket(self, short: np.ndarray) -> np.ndarray:
        return (mix64(short) % np.uint64(self.groups)).astype(np.int64)


def split(bucket: np.ndarray):
    """(bucket, rows in it) for each bucket."""
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
        yield int(bucket[part[0]]), part


def group_anchors(table, p: Repeats, z: Sizes):
    """Bucket rows of the anchors of a group's documents: those in one document, and those in more."""
    got, docs = [], []
    for row, ids, block in blocks_of(table, p):
        place, first, _, gram = block.anchors()
        if len(place):
            got.append(z.short(gram))
            docs.append(ids[np.searchsorted(block.cuts, first, "right") - 1])
    if not got:
        return
    got, docs = np.concatenate(got), np.concatenate(docs)
    order = np.argsort(got, kind="stable")
    got, docs = got[order], docs[order]
    new = np.flatnonzero(np.concatenate(([True], got[1:] != got[:-1])))
    many = np.minimum.reduceat(docs, new) < np.maximum.reduceat(docs, new)
    got = got[new]
    for bucket, part in split(z.bucket(got)):
        yield bucket, pack(got[part][~many[part]], z.width), pack(got[part][many[part]], z.width)


def bucket_marks(groups: list, once: list, many: list, z: Sizes):
    """(group, anchors of it that another group or document has too)."""
    hashes = [np.concatenate((unpack(a, z.width), unpack(b, z.width))) for a, b in zip(once, many, strict=True)]
    size = np.array([len(h) for h in hashes])
    sure = np.concatenate([np.arange(len(h)) >= len(h) - len(b) // z.width for h, b in zip(hashes, many, strict=True)])
    h, owner = np.concatenate(hashes), np.repeat(np.arange(len(hashes)), size)
    order = np.argsort(h, kind="stable")
    new = np.concatenate(([True], h[order][1:] != h[order][:-1]))[: len(order)]
    which = np.cumsum(new) - 1
    repeated = (np.bincount(which) > 1) | (np.bincount(which, weights=sure[order]) > 0)
    keep = np.empty(len(order), bool)
    keep[order] = repeated[which]
    ends = np.cumsum(size)
    for k, group in enumerate(groups):
        part = slice(ends[k] - size[k], ends[k])
        if keep[part].any():
            yield group, pack(h[part][keep[part]], z.width)


#: Of a context: row number in its group, document, first window, windows, anchor's place from the first window.
CONTEXT = np.dtype([("row", "<u4"), ("doc", "<i8"), ("start", "<u4"), ("windows", "u1"), ("anchor", "u1")])
SPAN = np.dtype([("row", "<u4"), ("start", "<u4"), ("stop", "<u4")])


def shrunk(data: bytes) -> bytes:
    """Compressed, behind its length: contexts are most of what is shuffled, and repeat by nature."""
    import pyarrow as pa

    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def grown(data: bytes) -> bytes:
    import pyarrow as pa

    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def columns_of(c: np.ndarray) -> bytes:
    """Records field by field, which compresses better than row by row."""
    return shrunk(b"".join(np.ascontiguousarray(c[f]).tobytes() for f in c.dtype.names))


def records_of(data: bytes, kind: np.dtype) -> np.ndarray:
    data = grown(data)
    out, at = np.empty(len(data) // kind.itemsize, kind), 0
    for f in kind.names:
        out[f] = np.frombuffer(data, kind[f], len(out), at)
        at += kind[f].itemsize * len(out)
    return out


def group_contexts(table, marks: list, p: Repeats, z: Sizes):
    """(bucket, context records, context bytes, spans) rows of a group.

    Contexts that several of the group's documents share leave it once, with the
    smallest document; the windows of the others are spans to remove at once.
    """
    if not marks:
        return
    marks = np.sort(np.concatenate([unpack(m, z.width) for m in marks]))
    for row, ids, block in blocks_of(table, p):
        place, first, count, gram = block.anchors()
        if not len(place):
            continue
        short = z.short(gram)
        at = np.minimum(np.searchsorted(marks, short), len(marks) - 1)
        hit = marks[at] == short
        place, first, count, short = place[hit], first[hit], count[hit], short[hit]
        if not len(place):
            continue
        text = np.searchsorted(block.cuts, first, "right") - 1
        stop = first + count + p.length - 1
        with np.errstate(over="ignore"):
            name = mix64(string_hashes(block.data, first, stop) + (place - first).astype(np.uint64))
        order, new = classes(block.data, first, stop, name)  # ids ascend within the block, so the smallest document is first
        least = np.empty(len(order), np.int64)
        least[order] = ids[text[order[new]]][np.cumsum(new) - 1]
        other = ids[text] > least
        if other.any():
            spans = np.zeros(int(other.sum()), SPAN)
            spans["row"], spans["start"], spans["stop"] = row + text[other], (first - block.cuts[text])[other], (stop - block.cuts[text])[other]
            yield 0, b"", b"", columns_of(spans)
        sent = np.flatnonzero(~other)
        for bucket, part in split(z.bucket(short[sent])):
            part = sent[part]
            c = np.zeros(len(part), CONTEXT)
            c["row"], c["doc"], c["start"], c["windows"], c["anchor"] = row + text[part], ids[text[part]], (first - block.cuts[text])[part], count[part], (place - first)[part]
            yield bucket, columns_of(c), shrunk(block.data[ranges(first[part], stop[part])].tobytes()), b""


def bucket_spans(groups: list, records: list, texts: list, p: Repeats, most: int = 1 << 20):
    """(group, spans) of a bucket's windows that a smaller document has too."""
    parts = [records_of(r, CONTEXT) for r in records]
    c, owner = np.concatenate(parts), np.repeat(groups, [len(x) for x in parts])
    data = np.frombuffer(b"".join(map(grown, texts)), np.uint8)
    size = c["windows"].astype(np.int64) + p.length - 1
    stop = np.cumsum(size)
    start = stop - size
    gram = start + c["anchor"]
    anchor = string_hashes(data, gram, gram + p.gram)
    with np.errstate(over="ignore"):
        name = mix64(string_hashes(data, start, stop) * np.uint64(31) + anchor + c["anchor"].astype(np.uint64))
    out_row, out_owner, out_start, out_stop = [], [], [], []

    def found(who, first, last):
        out_row.append(c["row"][who])
        out_owner.append(owner[who])
        out_start.append(c["start"][who].astype(np.int64) + first)
        out_stop.append(c["start"][who].astype(np.int64) + last + p.length)

    by_doc = np.argsort(c["doc"], kind="stable")
    order, new = classes(data, start[by_doc], stop[by_doc], name[by_doc])
    order = by_doc[order]
    klass = np.cumsum(new) - 1
    head = order[new]
    doc = c["doc"][head]
    later = order[c["doc"][order] > doc[klass]]
    found(later, np.zeros(len(later), np.int64), c["windows"][later].astype(np.int64) - 1)
    # What is left are the first documents of each distinct context; only anchors with several contexts need sorting.
    equal = order[c["doc"][order] == doc[klass]]
    member = klass[c["doc"][order] == doc[klass]]
    by = np.argsort(anchor[head], kind="stable")
    edge = np.concatenate(([True], anchor[head][by][1:] != anchor[head][by][:-1]))
    which = np.cumsum(edge) - 1
    several = np.bincount(which)[which] > 1
    by, edge = by[several], edge[several]
    least: dict = {}
    begin = 0
    bounds = np.append(np.flatnonzero(edge), len(by))
    weight = np.cumsum(np.append(0, size[head[by]]))
    while begin < len(bounds) - 1:
        end = max(begin + 1, int(np.searchsorted(weight[bounds], weight[bounds[begin]] + most, "right")) - 1)
        part = by[bounds[begin] : bounds[end]]
        begin = end
        for k, lo, hi in smaller_windows(data, start[head[part]], stop[head[part]], c["windows"][head[part]].astype(np.int64), doc[part], p):
            least.setdefault(int(part[k]), []).append((lo, hi))
    if least:
        hit = np.flatnonzero(np.isin(member, np.fromiter(least, np.int64, len(least))))
        who, lo, hi = [], [], []
        for k in hit:
            for a, b in least[int(member[k])]:
                who.append(equal[k])
                lo.append(a)
                hi.append(b)
        found(np.array(who), np.array(lo), np.array(hi))
    row, group, begin, end = (np.concatenate(x) for x in (out_row, out_owner, out_start, out_stop))
    for g, part in split(group):
        spans = np.zeros(len(part), SPAN)
        spans["row"], spans["start"], spans["stop"] = row[part], begin[part], end[part]
        yield g, columns_of(spans)


def smaller_windows(data, start, stop, windows, doc, p: Repeats):
    """(context, first, last window) runs of windows that are also in a context of a smaller document.

    The contexts are laid end to end, all suffixes sorted, and neighbours compared over a window's length.
    """
    text = data[ranges(start, stop)]
    depth = 1
    while 3**depth < p.length:
        depth += 1
    order = suffix_order(text.astype(np.int64) + 1, depth)
    owner = np.repeat(np.arange(len(start)), stop - start)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(stop - start) - (stop - start), stop - start)
    order = order[offset[order] < windows[owner[order]]]  # the starts of whole windows
    same = np.ones(len(order) - 1, bool)
    for k in range(p.length):
        live = np.flatnonzero(same)
        if not len(live):
            break
        same[live] = text[order[live] + k] == text[order[live + 1] + k]
    head = np.flatnonzero(np.concatenate(([True], ~same)))
    least = np.minimum.reduceat(doc[owner[order]], head)
    covered = np.zeros(len(text), bool)
    covered[order] = doc[owner[order]] > np.repeat(least, np.diff(np.append(head, len(order))))
    change = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
    for a, b in zip(change[::2], change[1::2], strict=True):  # runs can't cross contexts: a context's last bytes start no window
        yield int(owner[a]), int(offset[a]), int(offset[b - 1])


def grouped(docs: DataFrame, z: Sizes) -> DataFrame:
    """``docs`` dealt by id and text; rows without an id take no part, so they may go anywhere and are spread by their place."""
    carried = [c for c in docs.columns if c.startswith("carried_")]
    deal = F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id", "text"))
    return docs.select("doc_id", "text", *carried, F.xxhash64("text").alias("mark"), F.pmod(deal, F.lit(z.groups)).alias("group"))


def removed_spans(docs: DataFrame, p: Repeats) -> tuple[DataFrame, DataFrame, Sizes]:
    """The documents in groups, and (group, spans) rows."""
    z = Sizes.of(int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]), p)
    rows = grouped(docs, z)

    @lean_group
    def anchors(table):
        import pyarrow as pa

        got = list(group_anchors(table, p, z))
        group = table.column("group")[0].as_py()
        return pa.table({"bucket": pa.array([g[0] for g in got], pa.int64()), "group": pa.array([group] * len(got), pa.int64()), "once": pa.array([g[1] for g in got], pa.binary()), "many": pa.array([g[2] for g in got], pa.binary())})

    @lean_group
    def marks(table):
        import pyarrow as pa

        got = list(bucket_marks(*(table.column(c).to_pylist() for c in ("group", "once", "many")), z))
        return pa.table({"group": pa.array([g[0] for g in got], pa.int64()), "marks": pa.array([g[1] for g in got], pa.binary())})

    @lean_cogroup
    def contexts(table, marked):
        import pyarrow as pa

        got = list(group_contexts(table, marked.column("marks").to_pylist(), p, z)) if table.num_rows else []
        group = table.column("group")[0].as_py() if got else 0
        local = [i for i, g in enumerate(got) if g[3]]
        bucket = [-1 - group if i in local else g[0] for i, g in enumerate(got)]
        return pa.table({"bucket": pa.array(bucket, pa.int64()), "group": pa.array([group] * len(got), pa.int64()), "records": pa.array([g[1] or g[3] for g in got], pa.binary()), "texts": pa.array([g[2] for g in got], pa.binary())})

    @lean_group
    def spans(table):
        import pyarrow as pa

        group, records, texts = (table.column(c).to_pylist() for c in ("group", "records", "texts"))
        got = list(zip(group, records, strict=True)) if table.column("bucket")[0].as_py() < 0 else list(bucket_spans(group, records, texts, p))
        return pa.table({"group": pa.array([g[0] for g in got], pa.int64()), "spans": pa.array([g[1] for g in got], pa.binary())})

    found = rows.groupBy("group").applyInArrow(anchors, "bucket long, group long, once binary, many binary")
    found = found.groupBy("bucket").applyInArrow(marks, "group long, marks binary")
    found = rows.groupBy("group").cogroup(found.groupBy("group")).applyInArrow(contexts, "bucket long, group long, records binary, texts binary")
    return rows, found.groupBy("bucket").applyInArrow(spans, "group long, spans binary"), z


def in_order(table):
    """The rows of a group in the order of ``texts_with_spans``: null ids first."""
    import pyarrow as pa
    import pyarrow.compute as pc

    known = table.filter(pc.is_valid(table.column("doc_id"))).sort_by([("doc_id", "ascending"), ("mark", "ascending")])
    return pa.concat_tables([table.filter(pc.is_null(table.column("doc_id"))), known])


def texts_with_spans(table, spans: list):
    """(doc_id, bytes, mask of removed bytes) of every row of a group that is in order."""
    import pyarrow as pa

    unknown = table.column("doc_id").null_count
    for t in table.column("text").slice(0, unknown).to_pylist():
        yield None, (t or "").encode(), None
    table = table.slice(unknown)
    s = np.concatenate([records_of(b, SPAN) for b in spans]) if spans else np.zeros(0, SPAN)
    s = s[np.argsort(s["row"], kind="stable")]
    cut = np.searchsorted(s["row"], np.arange(table.num_rows + 1))
    for k, (i, t) in enumerate(zip(table.column("doc_id").to_pylist(), table.column("text"), strict=True)):
        data = t.cast(pa.binary()).as_py() or b""
        mask = None
        if cut[k] < cut[k + 1]:
            own = s[cut[k] : cut[k + 1]]
            delta = np.bincount(own["start"], minlength=len(data) + 1).astype(np.int64) - np.bincount(own["stop"], minlength=len(data) + 1)
            mask = np.cumsum(delta[:-1]) > 0
        yield i, data, mask


def per_text(docs: DataFrame, p: Repeats, finish, schema: str, carry: tuple = ()) -> DataFrame:
    """A row of ``schema`` for every row of ``docs``, with the columns ``carry`` of the same row after it."""
    carried = [f"carried_{k}" for k in range(len(carry))]
    docs = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, carried, strict=True)])
    rows, spans, _ = removed_spans(docs, p)
    names = [c.split()[0] for c in schema.split(", ")]
    out = ", ".join([schema, *(f"{n} {docs.schema[n].dataType.simpleString()}" for n in carried)])

    @lean_cogroup
    def run(table, marked):
        import pyarrow as pa

        table = in_order(table)
        got = [finish(*x) for x in texts_with_spans(table, marked.column("spans").to_pylist())] if table.num_rows else []
        kinds = {"long": pa.int64(), "string": pa.string()}
        made = {n: pa.array([g[k] for g in got], kinds[c.split()[1]]) for k, (n, c) in enumerate(zip(names, schema.split(", "), strict=True))}
        return pa.table(made | {n: table.column(n) for n in carried})

    made = rows.groupBy("group").cogroup(spans.groupBy("group")).applyInArrow(run, out)
    return made.select(*names, *[F.col(n).alias(c) for c, n in zip(carry, carried, strict=True)])


def repeated_bytes(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    A byte goes if a window over it also starts in a document with a smaller
    doc_id, judged on the input. Null texts are empty. Rows with a null doc_id
    take no part and keep all bytes. Rows that repeat a doc_id don't count as
    each other's smaller document. An empty table gives an empty result.
    """

    def finish(i, data, mask):
        if mask is None:
            return i, len(data), 0, 0, hashlib.sha256(data).hexdigest()
        kept = np.frombuffer(data, np.uint8)[~mask].tobytes()
        return i, len(data), int(mask.sum()), int(np.count_nonzero(np.diff(np.concatenate(([False], mask)).astype(np.int8)) == 1)), hashlib.sha256(kept).hexdigest()

    return per_text(docs, p, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, p: Repeats = Repeats(), carry: tuple = ()) -> DataFrame:
    """doc_id, kept_text for every row, and the columns ``carry`` of that row; a character stays if any byte of it stays."""

    def finish(i, data, mask):
        if mask is None:
            return i, data.decode()
        b = np.frombuffer(data, np.uint8)
        lead = np.flatnonzero((b & 0xC0) != 0x80)
        keep = np.repeat(np.logical_or.reduceat(~mask, lead), np.diff(np.append(lead, len(b))))
        return i, b[keep].tobytes().decode()

    return per_text(docs, p, finish, "doc_id long, kept_text string", carry)


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows meet at their anchor\'s bucket, and the difference-cover sort is a local step on what is there: nothing of the sort itself is distributed."""
    return repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_suffix_array": op7_suffix_array}
ORACLES = {}
