"""Resampling, packing and fill-in-the-middle against brute force, and at their edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import chat, fim, packing, resample

DOCS = "doc_id long, text string"


def frame(spark, rows, kind=DOCS):
    return spark.createDataFrame(rows, kind)


def prose(rng, n):
    return " ".join("".join(rng.choices("aábcdE9", k=rng.randint(1, 6))) + rng.choice(["", ".", "\n"]) for _ in range(n))


# ---- resampling ----


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def drawn_by_hand(docs, target, p):
    bucket = lambda g: zlib.crc32(g.encode()) % p.buckets
    s, t = Counter(bucket(g) for _, x in docs for g in grams(x)[1]), Counter(bucket(g) for x in target for g in grams(x)[1])
    all_s, all_t = sum(s.values()) + p.buckets, sum(t.values()) + p.buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    out = []
    for i, x in docs:
        w, g = grams(x)
        weight = sum(gain(bucket(f)) for f in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(w) >= p.words])
    may = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(may[: p.percent * len(may) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def some_docs(n, seed=1):
    rng = random.Random(seed)
    rows = [(k, prose(rng, rng.choice([0, 1, 19, 20, 21, 60]))) for k in range(n)]
    return rows + [(None, prose(rng, 30)) for _ in range(20)] + [(None, rows[3][1])] * 5 + [(7, rows[7][1])] * 30 + [(n, None), (n + 1, ""), (n + 2, " . \n"), (n + 3, "x" * 3000 + " " + "Y" * 70 + " z" * 30)]


@pytest.mark.parametrize("p", [resample.Resampling(), resample.Resampling(percent=60, words=2, run=7, cell=9, buckets=50), resample.Resampling(percent=100, words=0), resample.Resampling(percent=0)])
def test_resampling(spark, p):
    docs, target = some_docs(120), [prose(random.Random(9), 40), None, "A B c"]
    got = resample.resample(frame(spark, docs).repartition(5).withColumn("rank", F.lit("clash")).withColumn("run", F.lit(1)), frame(spark, [(x,) for x in target], "text string"), p)
    want = drawn_by_hand(docs, target, p)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert p.percent == 0 or any(k[4] for k in want)


def test_resampling_edges(spark):
    empty = frame(spark, [], "text string")
    assert resample.resample(frame(spark, []), empty).collect() == []
    docs = some_docs(30)
    assert Counter(map(tuple, resample.resample(frame(spark, docs), empty).collect())) == drawn_by_hand(docs, [], resample.Resampling())
    equal = [(5, "a " * 25)] * 200  # one id and text: every row is a tie
    got = resample.resample(frame(spark, equal), empty, resample.Resampling(run=16, cell=8)).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 51))


@given(st.lists(st.text("aB9 .é😀", max_size=40), max_size=8), st.integers(1, 30))
@settings(max_examples=150, deadline=None)
def test_features_in_blocks(rows, chars):
    words, found = Counter(), Counter()
    for w, f, b in resample.features(pa.array(rows, pa.string()), 1 << 31, chars):
        words.update(w.tolist())
        found.update(zip(f.tolist(), b.tolist(), strict=True))
    assert words == Counter(k for k, x in enumerate(rows) for _ in grams(x)[0])
    assert found == Counter((k, zlib.crc32(g.encode()) % (1 << 31)) for k, x in enumerate(rows) for g in grams(x)[1])


@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_tournament(lists):
    lists = [sorted((x,) for x in one) for one in lists]
    assert [lists[k][at] for k, at in resample.Tournament(lists)] == sorted(x for one in lists for x in one)


# ---- packing ----


def check_packing(pieces, docs, p, tokenizer):
    """Every id in one piece, the tokenizer's own ids, sequences without gaps or padding."""
    want = Counter((i, tuple(tokenizer.encode(x or "", add_special_tokens=False).ids) + (p.end,)) for i, x in docs)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id, r.doc_tokens].append((r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())))
        by_sequence[r.sequence_id].append((r.offset, r.length, r.context, r.step))
        assert len(r.ids) == 4 * r.length > 0
    for rows in by_sequence.values():
        at = 0
        for offset, length, context, step in sorted(rows):
            assert offset == at and context == rows[0][2] <= p.longest and step == rows[0][3]
            at += length
        assert at == context and at & (at - 1) == 0
    repeated = Counter((i, len(x)) for i, x in want.elements())
    for (i, x), n in want.items():
        if repeated[i, len(x)] == 1:  # else pieces of several rows stand under one key
            assert n == 1 and sum((ids for _, ids in sorted(by_doc[i, len(x)])), ()) == x
            assert [a for a, _ in sorted(by_doc[i, len(x)])] == np.cumsum([0] + [len(ids) for _, ids in sorted(by_doc[i, len(x)])])[:-1].tolist()
    assert sum(map(len, (ids for rows in by_doc.values() for _, ids in rows))) == sum(len(x) * n for (_, x), n in want.items())


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(chat.TOKENIZER)


@pytest.mark.parametrize("p", [packing.Packing(), packing.Packing(longest=64, shortest=8, group=500, step=256, end=3)])
def test_packing(spark, tokenizer, p):
    rng = random.Random(4)
    docs = [(k, prose(rng, rng.choice([0, 1, 5, 40, 300, 2000]))) for k in range(150)] + [(200, None), (201, "a<|endoftext|>b"), (202, "é" * 5000)]
    docs += [(None, "no id"), (None, "none either here"), (0, docs[0][1] + " again")]
    rows = packing.pack_documents(frame(spark, docs).repartition(3).withColumn("ids", F.lit("clash")), p).collect()
    check_packing(rows, docs, p, tokenizer)
    by_step = defaultdict(dict)
    for r in rows:
        by_step[r.step][r.sequence_id] = r.context
    assert all(len(set(s.values())) == 1 and sum(s.values()) <= p.step for s in by_step.values())


def test_packing_edges(spark, tokenizer):
    assert packing.pack_documents(frame(spark, [])).collect() == []
    same = [(1, "the same text, again and again")] * 40
    rows = packing.pack_documents(frame(spark, same).coalesce(1)).collect()
    n = len(tokenizer.encode(same[0][1]).ids) + 1
    assert sum(r.length for r in rows) == 40 * n and all(r.doc_tokens == n for r in rows)
    with pytest.raises(ValueError):
        packing.Packing(longest=1000)


def test_ids_of_the_tokenizer(tokenizer):
    encode = packing.Encoder(*packing.token_ranks(open(chat.TOKENIZER, encoding="utf-8").read())).ids
    rng = random.Random(2)
    hard = ["", " ", "\n\n a", "a" * 5000, "<|endoftext|><|endoftext", "don't I'LL 's 'S", "１２ ½ ² ٣", "a 　b\x85\x1c c", "é ‍👩‍👧", "\x00\x01\x7f\xad"]
    hard += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000), rng.randrange(0x1F300, 0x1FAFF), 10, 32, 39])) for _ in range(200)) for _ in range(200)]
    assert [encode(x) for x in hard] == [tokenizer.encode(x, add_special_tokens=False).ids for x in hard]


def test_windows_are_full_and_few_pieces_cut():
    p, rng = packing.Packing(), random.Random(3)
    lengths = [min(1023, int(rng.lognormvariate(5, 1)) + 1) for _ in range(3000)]
    stock = packing.Stock()
    for k, n in enumerate(lengths):
        stock.put(((k, None), 0, n))
    windows, rest = packing.pack(stock, p)
    pieces = [x for _, w in windows for x in w] + rest
    assert all(sum(x[2] for x in w) == size for size, w in windows) and sum(x[2] for x in rest) < 1024
    assert sum(x[2] for x in pieces) == sum(lengths) and len(pieces) < 1.2 * len(lengths)
    assert [size for size, w in packing.split_open(rest)] == [1 << k for k in range(10, -1, -1) if sum(x[2] for x in rest) >> k & 1]


# ---- fill in the middle ----


def cut_by_hand(i, text, p):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in p.marks) or h[2] % 100 >= p.rate:
        return i, len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < p.spm:
        return i, len(units), "spm", len(pre), len(mid), p.suffix + suf + p.prefix + pre + p.middle + mid
    return i, len(units), "psm", len(pre), len(mid), p.prefix + pre + p.suffix + suf + p.middle + mid


@pytest.mark.parametrize("p", [fim.FillInMiddle(), fim.FillInMiddle(seed=3, rate=50, spm=10, prefix="<|a|>", suffix="<|b|>", middle="<|c|>")])
def test_fill_in_middle(spark, p):
    rng = random.Random(5)
    docs = [(k, "".join(rng.choice(["\n", "a line\n", "é😀 ", "\r\n", "<", "<P", ">", "\x00"]) for _ in range(rng.randint(0, 12)))) for k in range(200)]
    docs += [(None, "x\ny"), (None, None), (300, None), (301, ""), (302, "has <S> in it\n"), (303, "\n" * 5000), (304, "long " * 200_000), (305, "a\nb\nc")] + [(305, "a\nb\nc")] * 3
    got = fim.restored(fim.fill_in_middle(frame(spark, docs).withColumn("output", F.lit("clash")).withColumn("digest", F.lit(0)), p), p).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(cut_by_hand(i, x, p) for i, x in docs)
    assert Counter((r.doc_id, r.restored) for r in got) == Counter((i, x or "") for i, x in docs)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(frame(spark, [])).collect() == []


@given(st.text("ab\n<PSM>", max_size=30), st.lists(st.integers(0, 1 << 32), min_size=4, max_size=4))
def test_any_text_comes_back(text, draws):
    p = fim.FillInMiddle()
    ends = np.cumsum([len(x) for x in re.findall(r"[^\n]*\n|[^\n]+", text)]).astype(np.int64)
    form, _, _, output = fim.arrange(text, ends, draws, p)
    assert fim.restore(output, form, p) == text


def test_marks_that_overlap_are_refused():
    for marks in ({"prefix": "<S>"}, {"prefix": ""}, {"prefix": "<<P>"}):
        with pytest.raises(ValueError):
            fim.FillInMiddle(**marks)
