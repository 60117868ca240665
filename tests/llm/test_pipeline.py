"""The pipeline's stages on a small table: each decision takes effect and columns stay."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as c
from sparkloom.llm import decontaminate, pieces, sampling, toxicity
from sparkloom.llm.common import Scratch

from .test_operators import edits, shingle_set, smallest_reachable, texts

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s", len(t) if t else 0) for i, t in texts(60, 11)] + [(None, None, None, None, None)]
    spark.createDataFrame(rows, KIND).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i, _ in texts(60, 11)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, texts(60, 11)[5][1])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    docs, scratch = spark.read.parquet(f"{folder}/documents.parquet"), Scratch(spark)
    for n, (name, stage) in enumerate(c.STAGES):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = scratch.table(stage(spark, docs, folder))
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and (n == len(c.STAGES) - 1 or docs.columns == c.COLUMNS)
        if name == "near_duplicates":
            sets = [s for r in docs.collect() if (s := shingle_set(r.text, 5))]
            assert all(100 * len(a & b) < 80 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
        if name in ("repeated_passages", "pieces"):
            assert after == before
    assert docs.where("not lossless").count() == 0


def test_run_and_clashing_columns(spark, folder):
    assert c.run(spark, folder).columns == ["doc_id", "pieces", "n_pieces", "lossless"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS _bad", "'x' AS bands")
    assert c.drop_toxic(spark, docs, folder).columns == c.COLUMNS


def test_rows_without_id_are_judged_by_their_own_text(spark, folder, monkeypatch):
    rows = [(None, t, "en", "s", len(t)) for t in ("a blorgen one", "fine words stand here", "it holds the benchmark passage, in full")] + [(7, "fine too", "en", "s", 8), (None, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, KIND)
    monkeypatch.setattr("sparkloom.llm.toxicity.fit", lambda *_: toxicity.Net(toxicity.Toxicity()))
    monkeypatch.setattr("sparkloom.llm.toxicity.text_scores", lambda column, _: [float("blorg" in (t or "")) for t in column.to_pylist()])
    assert sorted(r.text or "" for r in c.drop_toxic(spark, docs, folder).collect()) == ["", "fine too", "fine words stand here", "it holds the benchmark passage, in full"]
    items = spark.createDataFrame([(1, "holds the benchmark passages, in full")], "item_id long, text string")
    assert sorted(r.text or "" for r in c.decontaminate(docs, items).collect()) == ["", "a blorgen one", "fine too", "fine words stand here"]


def test_one_of_equal_rows_stays_whatever_their_order(spark, folder):
    rows = [(1, "a b c d e f", lang, source, n) for lang, source, n in [("fr", "b", 1), ("en", "z", 3), ("en", "c", None), (None, "a", 2)]] * 3
    rows += [(None, "no id here", "en", "s", 1)] * 4 + [(None, "no id there", "en", "s", 1), (2, None, "en", "s", 0), (3, "a b c d e f", "de", "s", 1)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = c.drop_near_copies(spark, spark.createDataFrame(rows, KIND).repartition(1 + seed), folder).collect()
        assert sorted((r.doc_id or 0, r.text or "", r.lang or "", r.source) for r in got) == [(0, "no id here", "en", "s"), (0, "no id there", "en", "s"), (1, "a b c d e f", "", "a"), (2, "", "en", "s")]


def test_cut_repeats_keeps_each_row_of_an_id(spark, folder):
    passage = "a passage of more than fifty bytes that two documents hold in full"
    rows = [(1, passage, "en", "a", 66), (2, f"left {passage}", "en", "b", 71), (2, "zz another text", "fr", "c", 15), (2, None, "de", "d", 4), (None, passage, "it", "e", 66), (None, None, None, None, None)]
    got = c.cut_repeats(spark, spark.createDataFrame(rows, KIND), folder)
    want = [(1, passage, "en", "a", 66), (2, "left ", "en", "b", 5), (2, "zz another text", "fr", "c", 15), (2, None, "de", "d", 4), (None, passage, "it", "e", 66), (None, None, None, None, None)]
    assert got.columns == c.COLUMNS and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Toxic words, near copies, shared passages, benchmark items with edits, repeated ids and rows without one."""
    rng, d = random.Random(31), str(tmp_path_factory.mktemp("planted"))
    prose = lambda k: " ".join("".join(rng.choices("of the and th nd er in ti on re at".split(), k=rng.randint(2, 4))) for _ in range(k))
    passage, item = prose(25), prose(20)
    out = []
    for k in range(420):
        w = prose(rng.randint(15, 60)).split()
        kind = rng.random()
        if k % 5 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), "blorg" + rng.choice(["", "en", "ist"]))
        elif kind < 0.15 and out:
            w = rng.choice(out)[1].split()
            w[rng.randrange(len(w))] = "zz"
        elif kind < 0.3:
            w += passage.split()
        elif kind < 0.4:
            leak = list(item)
            for _ in range(rng.randint(0, len(item) // 9)):
                leak[rng.randrange(len(leak))] = "Q"
            w += "".join(leak).split()
        out.append((k, " ".join(w)))
    out += [(None, "a blorgen blorg blorgist one blorg"), (None, f"null id {item}"), (None, passage), (500, passage), (500, prose(9)), (501, ""), (502, None), (503, " \n"), (500, passage)]
    rows = [(i, t, rng.choice(["en", None]), "s", len(t) if t else 0) for i, t in out]
    spark.createDataFrame(rows, KIND).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int("blorg" in t)) for i, t in out[:420]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def kept_text(text, gone):
    """Characters of which a byte stays."""
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        if not gone[at : at + n].all():
            out.append(c)
        at += n
    return "".join(out)


def test_stages_by_brute_force(spark, planted):
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    labels, items = (spark.read.parquet(f"{planted}/{n}.parquet") for n in ("labels", "benchmark"))
    # Toxicity: every row by the score of its own text; an id goes with all its rows.
    net = toxicity.fit(docs, labels)
    before = rows_of(docs)
    score = toxicity.text_scores(pa.array([r[1] for r in before]), net)
    bad = {r[0] for r, s in zip(before, score, strict=True) if s >= 0.3 and r[0] is not None}
    want = [r for r, s in zip(before, score, strict=True) if s < 0.3 and r[0] not in bad]
    docs = scratch.table(c.drop_toxic(spark, docs, planted))
    assert rows_of(docs) == want and 60 < len(before) - len(want) < 120
    # Near duplicates: the smallest id of each component, and each of its texts once.
    before, sets = rows_of(docs), {}
    for r in before:
        if r[0] is not None:
            sets.setdefault(r[0], []).append(shingle_set(r[1], 5))
    links = [(a, b) for a, b in combinations(sets, 2) for x in sets[a] for y in sets[b] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    part = smallest_reachable(sets, links)
    want = {(r[0], r[1]) for r in before if r[0] is None or part[r[0]] == r[0]}
    docs = scratch.table(c.drop_near_copies(spark, docs, planted))
    after = rows_of(docs)
    assert {(r[0], r[1]) for r in after} == want and len(after) == len(want) and set(after) <= set(before) and len(links) > 5
    # Repeated passages: bytes under a window that also starts in a document with a smaller id.
    before, seen = after, {}
    for i, t, *_ in before:
        data = (t or "").encode()
        for k in range(len(data) - 49 if i is not None else 0):
            seen[data[k : k + 50]] = min(seen.get(data[k : k + 50], i), i)
    want = []
    for i, t, lang, source, n in before:
        gone = np.zeros(len((t or "").encode()), bool)
        for k in range(len(gone) - 49 if i is not None else 0):
            if seen[t.encode()[k : k + 50]] < i:
                gone[k : k + 50] = True
        new = kept_text(t, gone) if t is not None else None
        want.append((i, new, lang, source, n if t is None else len(new)))
    docs = scratch.table(c.cut_repeats(spark, docs, planted))
    assert rows_of(docs) == sorted(want, key=str) and sum(a[1] != b[1] for a, b in zip(before, want, strict=True)) > 10
    # Benchmark items: no document within a tenth of an item's characters stays.
    plain = lambda t: decontaminate.plain((t or "").encode())
    before, item = rows_of(docs), plain(items.first().text)
    leaks = [edits(item, plain(r[1])) <= len(item) // 10 for r in before]
    bad = {r[0] for r, x in zip(before, leaks, strict=True) if x and r[0] is not None}
    want = [r for r, x in zip(before, leaks, strict=True) if not x and r[0] not in bad]
    docs = scratch.table(c.drop_leaks(spark, docs, planted))
    assert rows_of(docs) == want and len(want) < len(before) and any(x and r[0] is None for r, x in zip(before, leaks, strict=True))
    # Pieces: every row comes back whole.
    out = scratch.table(c.to_pieces(spark, docs, planted))
    back = sampling.join_pieces(out, pieces.load_pieces()).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((r[0], r[1] or "") for r in rows_of(docs)), key=str)
    assert rows_of(c.run(spark, planted)) == rows_of(out)


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert c.run(spark, str(tmp_path)).collect() == []
