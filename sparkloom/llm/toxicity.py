"""Toxicity of whole texts by a bidirectional gated recurrent network.

A token's input is an embedding of its word joined with one of its character
n-grams. Two gated recurrent passes read each window, attention pools their
states, and a text's score is the highest of its overlapping windows. The net
is trained in numpy on a bounded sample of labelled rows; scoring is done where
the rows are, over all windows of all texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import _LOWER, column_bytes, fold, give_back, lean, mix64, row_key, words_of


@dataclass(frozen=True)
class Toxicity:
    """``positives`` and ``negatives`` bound the labelled rows that training reads, ``longest`` the bytes of each of them."""

    hidden: int = 8
    word_size: int = 8
    char_size: int = 8
    log_words: int = 13
    log_grams: int = 14
    grams: tuple = (3, 4, 5)
    window: int = 64
    step: int = 56
    positives: int = 1200
    negatives: int = 1600
    longest: int = 1 << 17
    epochs: int = 6
    batch: int = 64
    rate: float = 0.01
    threshold: float = 0.3
    seed: int = 11


@dataclass
class Words:
    """Distinct words of a block: word rows, and for each word its character n-gram rows."""

    word: np.ndarray
    gram: np.ndarray
    owner: np.ndarray
    starts: np.ndarray
    scale: np.ndarray = field(default=None)


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, p: Toxicity) -> Words:
    """``starts``/``ends`` of one occurrence of each distinct word in ``data``."""
    length = ends - starts + 2
    at = np.concatenate(([0], np.cumsum(length)))
    owner = np.repeat(np.arange(len(length)), length)
    inside = np.arange(at[-1]) - at[owner]
    source = starts[owner] + inside - 1
    chars = _LOWER[data[np.clip(source, 0, max(0, len(data) - 1))]].astype(np.uint64) if at[-1] else np.zeros(0, np.uint64)
    chars[inside == 0] = 60
    chars[inside == length[owner] - 1] = 62
    gram, count, packed = [], np.zeros(len(length)), np.zeros(len(chars), np.uint64)
    top = max(p.grams)
    for k in range(top):
        packed[: len(chars) - k] |= chars[k:] << np.uint64(8 * k)
        if k + 1 in p.grams:
            fits = inside + k < length[owner]
            with np.errstate(over="ignore"):
                row = (mix64(packed * np.uint64(2 * k + 1)) & np.uint64((1 << p.log_grams) - 1)).astype(np.int64)
            gram.append(np.where(fits, row, 1 << p.log_grams))
            count += np.maximum(length - k, 0)
    return Words((hashes & np.uint64((1 << p.log_words) - 1)).astype(np.int64), np.array(gram).reshape(len(p.grams), -1), owner, at[:-1], 1 / np.sqrt(np.maximum(count, 1)))


def sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Net:
    def __init__(self, p: Toxicity):
        rng, h, d = np.random.default_rng(p.seed), p.hidden, p.word_size + p.char_size
        draw = lambda *s, by=0.3: (rng.standard_normal(s) * by).astype(np.float32)
        self.p = p
        self.w = {
            "word": draw((1 << p.log_words), p.word_size, by=0.05),
            "gram": draw((1 << p.log_grams) + 1, p.char_size, by=0.05),
            "x": draw(2, d, 3 * h),
            "bias": np.zeros((2, 3 * h), np.float32),
            "u": draw(2, h, 3 * h),
            "att": draw(2 * h, h),
            "att_v": draw(h),
            "out": draw(2 * h),
            "out_b": np.full(1, -1, np.float32),
        }
        self.w["gram"][-1] = 0

    def inputs(self, words: Words) -> np.ndarray:
        g = sum(np.add.reduceat(self.w["gram"][row], words.starts, axis=0) for row in words.gram) * words.scale[:, None].astype(np.float32)
        return np.concatenate((self.w["word"][words.word], g.astype(np.float32)), axis=1)

    def gates(self, words: Words) -> np.ndarray:
        """For each distinct word what the gates of both directions receive: (2, words, 3h)."""
        return np.matmul(self.inputs(words), self.w["x"]) + self.w["bias"][:, None]

    def forward(self, gates: np.ndarray, tokens: np.ndarray, keep: bool = False):
        """tokens: (windows, time) rows of ``gates``. Logits, and with ``keep`` what backward needs."""
        h, (n, time) = self.p.hidden, tokens.shape
        state = np.zeros((2, n, h), np.float32)
        states = np.empty((time, n, 2 * h), np.float32)
        u, kept, at = self.w["u"], [], np.ascontiguousarray(tokens.T)
        g, rec = np.empty((2, n, 3 * h), np.float32), np.empty((2, n, 3 * h), np.float32)
        for t in range(time):
            np.take(gates[0], at[t], axis=0, out=g[0], mode="clip")
            np.take(gates[1], at[time - 1 - t], axis=0, out=g[1], mode="clip")
            np.matmul(state, u, out=rec)
            zr = g[..., : 2 * h] + rec[..., : 2 * h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[..., :h], zr[..., h:]
            new = r * rec[..., 2 * h :]
            new += g[..., 2 * h :]
            np.tanh(new, out=new)
            if keep:
                kept.append((state, z, r, new, rec[..., 2 * h :].copy()))
            state = state - new
            state *= z
            state += new
            states[t, :, :h], states[time - 1 - t, :, h:] = state[0], state[1]
        a = np.tanh(states @ self.w["att"])
        e = a @ self.w["att_v"]
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", alpha, states)
        logit = pooled @ self.w["out"] + self.w["out_b"][0]
        return (logit, (states, a, alpha, pooled, kept)) if keep else logit

    def gradient(self, words: Words, tokens: np.ndarray, labels: np.ndarray) -> dict:
        used, tokens = np.unique(tokens, return_inverse=True)
        tokens = tokens.reshape(len(labels), -1)
        length = np.diff(np.append(words.starts, len(words.owner)))[used]
        owner = np.repeat(np.arange(len(used)), length)
        take = np.arange(len(owner)) + (words.starts[used] - np.cumsum(length) + length)[owner]
        small = Words(words.word[used], words.gram[:, take], owner, np.searchsorted(owner, np.arange(len(used))), words.scale[used])
        x = self.inputs(small)
        logit, (states, a, alpha, pooled, kept) = self.forward(np.matmul(x, self.w["x"]) + self.w["bias"][:, None], tokens, True)
        w, h, (n, time) = self.w, self.p.hidden, tokens.shape
        d = {}
        dl = ((sigmoid(logit) - labels) / n).astype(np.float32)
        d["out"], d["out_b"] = pooled.T @ dl, dl.sum(keepdims=True)
        dp = dl[:, None] * w["out"]
        dalpha = np.einsum("nh,tnh->tn", dp, states)
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        d["att_v"] = np.einsum("tn,tnk->k", de, a)
        da = de[..., None] * w["att_v"] * (1 - a * a)
        d["att"] = np.einsum("tnh,tnk->hk", states, da)
        ds = alpha[..., None] * dp + da @ w["att"].T
        seen, du, back = np.empty((2, n, time, 3 * h), np.float32), np.zeros_like(w["u"]), np.zeros((2, n, h), np.float32)
        for t in range(time - 1, -1, -1):
            state, z, r, new, rec = kept[t]
            dh = back + np.stack((ds[t, :, :h], ds[time - 1 - t, :, h:]))
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (state - new) * z * (1 - z)
            dr = dn * rec * r * (1 - r)
            drec = np.concatenate((dz, dr, dn * r), axis=2)
            du += np.matmul(state.transpose(0, 2, 1), drec)
            back = dh * z + np.matmul(drec, w["u"].transpose(0, 2, 1))
            dg = np.concatenate((dz, dr, dn), axis=2)
            seen[0, :, t], seen[1, :, time - 1 - t] = dg[0], dg[1]
        order = np.argsort(tokens, axis=None, kind="stable")
        first = np.searchsorted(tokens.ravel()[order], np.arange(len(used)))
        dgates = np.add.reduceat(seen.reshape(2, -1, 3 * h)[:, order], first, axis=1)
        d["u"], d["bias"] = du, dgates.sum(axis=1)
        d["x"] = np.matmul(x.T, dgates)
        dx = np.matmul(dgates, w["x"].transpose(0, 2, 1)).sum(axis=0)
        d["word"], d["gram"] = np.zeros_like(w["word"]), np.zeros_like(w["gram"])
        np.add.at(d["word"], small.word, dx[:, : self.p.word_size])
        spread = (dx[:, self.p.word_size :] * small.scale[:, None].astype(np.float32))[owner]
        for row in small.gram:
            np.add.at(d["gram"], row, spread)
        d["gram"][-1] = 0
        return d


def blocks(column, p: Toxicity, chars: int = 1 << 20):
    """Texts in blocks: (row range, distinct words, token rows, token range of each text)."""
    data, offsets = column_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chars, "right")) - 1)
        base = offsets[row]
        # A space between texts keeps the last word of one apart from the first of the next.
        piece = np.concatenate([x for k in range(row, stop) for x in (data[offsets[k] : offsets[k + 1]], np.array([32], np.uint8))])
        starts, ends, hashes = words_of(piece)
        cuts = np.searchsorted(starts, offsets[row : stop + 1] - base + np.arange(stop - row + 1))
        uniq, first, tokens = np.unique(hashes, return_index=True, return_inverse=True)
        yield row, stop, distinct_words(piece, starts[first], ends[first], uniq, p) if len(uniq) else None, tokens, cuts
        row = stop


def windows(cuts: np.ndarray, p: Toxicity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner text, first token and length of every window; the last one of a text ends with it."""
    n = np.diff(cuts)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - p.window) // p.step)), 0)
    owner = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(n, p.window)[owner]
    return owner, cuts[owner] + np.minimum(nth * p.step, n[owner] - length), length


def window_logits(net: Net, words: Words, tokens: np.ndarray, first: np.ndarray, length: np.ndarray, batch: int = 512) -> np.ndarray:
    out, gates = np.empty(len(first), np.float32), net.gates(words)
    for size in np.unique(length):
        which = np.flatnonzero(length == size)
        for at in range(0, len(which), batch):
            part = which[at : at + batch]
            out[part] = net.forward(gates, tokens[first[part][:, None] + np.arange(size)])
    return out


def train(texts: list, labels: list, p: Toxicity = Toxicity()) -> Net:
    """Fit on (text, 0/1) rows. In each epoch a text teaches by its highest window, a clean text by a random one too."""
    import pyarrow as pa

    net, rng = Net(p), np.random.default_rng(p.seed)
    labels = np.asarray(labels, np.float32)
    got = list(blocks(pa.array(texts, pa.large_string()), p, chars=1 << 60))
    if not got or got[0][2] is None or not len(labels):
        return net
    _, _, words, tokens, cuts = got[0]
    owner, first, length = windows(cuts, p)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}
    beat = 0
    has = np.unique(owner, return_index=True)
    for epoch in range(p.epochs):
        logit = window_logits(net, words, tokens, first, length) if epoch else rng.standard_normal(len(first))
        order = np.lexsort((-logit, owner))
        best = order[has[1]]
        chance = rng.integers(has[1], np.append(has[1][1:], len(owner)))
        chosen = np.unique(np.concatenate((best, chance[labels[has[0]] == 0])))
        chosen = chosen[rng.permutation(len(chosen))]
        groups = [g[at : at + p.batch] for size in np.unique(length[chosen]) for g in (chosen[length[chosen] == size],) for at in range(0, len(g), p.batch)]
        for k in rng.permutation(len(groups)):
            g = groups[k]
            grad = net.gradient(words, tokens[first[g][:, None] + np.arange(length[g[0]])], labels[owner[g]])
            beat += 1
            for name, d in grad.items():
                m, v = moment[name]
                m += 0.1 * (d - m)
                v += 0.002 * (d * d - v)
                net.w[name] -= (p.rate * (1 - epoch / (p.epochs + 1)) * (m / (1 - 0.9**beat)) / (np.sqrt(v / (1 - 0.998**beat)) + 1e-7)).astype(np.float32)
    return net


def text_scores(column, net: Net) -> np.ndarray:
    """Highest window of each text; a text without words scores 0."""
    out = np.zeros(len(column))
    for row, stop, words, tokens, cuts in blocks(column, net.p):
        if words is not None:
            owner, first, length = windows(cuts, net.p)
            best = np.full(stop - row, -np.inf)
            np.maximum.at(best, owner, window_logits(net, words, tokens, first, length))
            out[row:stop] = np.where(np.isfinite(best), sigmoid(best.astype(np.float64)), 0)
    return out


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> Net:
    """Train on at most ``positives`` + ``negatives`` labelled rows that aren't held out, chosen by a hash of their id.

    An id that stands in several rows gives one of them, and texts of more than ``longest`` bytes give none, so what the driver
    reads is bounded by the three limits, whatever the tables hold. Scoring reads all texts whole.
    """
    named = fold(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    pick = lambda toxic, n: named.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = F.broadcast(pick(1, p.positives).union(pick(0, p.negatives)))  # bounded by the two limits
    texts = fold(docs, "doc_id", "text").where(F.octet_length("text") <= p.longest).join(chosen, "doc_id")
    one = texts.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"))
    rows = sorted(one.select("doc_id", "toxic", F.col("first.text").alias("text")).collect())
    net = train([r.text for r in rows], [r.toxic for r in rows], p)
    del rows
    give_back()
    return net


def scores(docs: DataFrame, net: Net) -> DataFrame:
    """key, score for every row of ``docs`` (key, text). Null and empty texts score 0."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    @lean
    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(text_scores(b.column("text"), model.value))], ["key", "score"])

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, score double")


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Null and empty texts score 0; a null doc_id isn't held out; repeated rows score alike."""
    out = scores(docs.select(F.col("doc_id").cast("long").alias("key"), "text"), net).withColumnRenamed("key", "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= net.p.threshold).cast("int").alias("predicted"))


def rejected(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> DataFrame:
    """The distinct ``row_key`` of the rows that the classifier rejects."""
    out = scores(docs.select(row_key().alias("key"), "text"), fit(docs, labels, p))
    return out.where(F.col("score") >= p.threshold).select("key").distinct()


def toxicity(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> DataFrame:
    """Fit on the labels and score every document. Without labels the untrained net scores; an empty table gives no rows."""
    return score(docs, fit(docs, labels, p))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES = {}
