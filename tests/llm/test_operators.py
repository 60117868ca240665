"""Training-data operators against brute force on small tables, and at their edges."""

import hashlib
import random
import re
import time
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import chat, decontaminate, mainhtml, minhash, pieces, pivots, sampling, suffixes, tokencount, toxicity, urls

DOCS = "doc_id long, text string"
WORDS = "of the and th nd er in ti on re at".split()


def texts(n, seed=0, words=40):
    """Random texts with exact and near copies, shared passages, empty and null ones."""
    rng = random.Random(seed)
    prose = lambda k: " ".join("".join(rng.choices(WORDS, k=rng.randint(1, 4))) for _ in range(k))
    passage, out = prose(30), []
    for k in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            out.append(rng.choice(out))
        elif out and kind < 0.45:
            w = (rng.choice(out) or "x").split()
            for _ in range(rng.randint(1, max(1, len(w) // 15))):
                w[rng.randrange(len(w))] = prose(1)
            out.append(" ".join(w))
        elif kind < 0.6:
            out.append(prose(rng.randint(0, 20)) + passage[rng.randint(0, 40) :] + prose(5))
        else:
            out.append(prose(rng.randint(1, words)) + rng.choice(["", "\n", "é x", "  "]))
    return [(k * 3, t) for k, t in enumerate(out)] + [(n * 3, ""), (n * 3 + 1, None), (n * 3 + 2, " \n ")]


def frame(spark, rows, kind=DOCS):
    return spark.createDataFrame(rows, kind)


def smallest_reachable(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingle_set(text, size):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    size = min(size, len(w)) or 1
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()


@pytest.mark.parametrize("size", [2, 5])
def test_minhash(spark, size):
    rows = texts(60, size)
    sets = {i: shingle_set(t, size) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = smallest_reachable(sets, links)
    got = minhash.near_duplicates(frame(spark, rows), minhash.MinHash(words=size)).collect()
    assert links and {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_minhash_edges(spark):
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (5, "A b C"), (None, None)]
    got = minhash.near_duplicates(frame(spark, rows).withColumn("component", F.lit("clash")).withColumn("bands", F.lit(1))).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (5, 1, False)]
    assert minhash.near_duplicates(frame(spark, [])).collect() == []


def test_bitmaps_never_rule_out_a_link():
    p, rng = minhash.MinHash(), random.Random(4)
    links = out = 0
    unpacked = lambda x: np.unpackbits(minhash.bitmap(x).view(np.uint8)).astype(np.float32)[None]
    for _ in range(200):
        x = np.array(rng.sample(range(10**15), rng.randint(1, 300)), np.uint64)
        y = np.unique(np.concatenate((x[: rng.randint(0, len(x))], np.array(rng.sample(range(10**15), rng.randint(0, 60)), np.uint64))))
        if len(y):
            both = len(np.intersect1d(x, y))
            link = 100 * both >= 80 * (len(x) + len(y) - both)
            may = minhash.may_link(np.array([float(len(x))]), unpacked(x), np.array([float(len(y))]), unpacked(y), p)[0, 0]
            assert may or not link
            links, out = links + link, out + (not may)
    assert links > 5 and out > 20


def test_plausible_pairs_of_blocks(spark):
    """Buckets of many blocks give the pairs of a plain loop; runs of rows may span batches."""
    rng = random.Random(21)
    p, sets, rows = minhash.MinHash(block=4), {}, []
    for k in range(90):
        like = sets[rng.choice(list(sets))] if sets and rng.random() < 0.7 else rng.sample(range(10**6), rng.randint(5, 40))
        sets[k] = np.unique(np.array([v if rng.random() < 0.93 else rng.randrange(10**6) for v in like], np.uint64))
    sets = {k: np.unique(minhash.mix64(v)) for k, v in sets.items()}
    for key in range(3):
        for k in sets:
            if rng.random() < 0.6:
                rows.append((key, k, len(sets[k]), 0, None, k // 2, 1, minhash.bitmap(sets[k]).tolist()))
    kind = "key long, rep long, n long, hub long, sim double, part long, sets long, bits array<long>"
    got = [(r.a, r.b) for r in minhash.plausible_pairs(frame(spark, rows, kind).repartition(1), p).collect()]
    together = {(a[1], b[1]) for a, b in combinations(rows, 2) if a[0] == b[0] and a[5] != b[5] and 0 not in (a[1], b[1])}
    linked = {(a, b) for a, b in together if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert len(got) == len(set(got)) and linked <= set(got) <= together and len(linked) > 20


def removed_by_brute_force(rows):
    seen, out = {}, {}
    for i, t in rows:
        for k in range(len((t or "").encode()) - 49):
            w = (t or "").encode()[k : k + 50]
            seen[w] = min(seen.get(w, i), i)
    for i, t in rows:
        data = (t or "").encode()
        mask = np.zeros(len(data), bool)
        for k in range(len(data) - 49):
            if seen[data[k : k + 50]] < i:
                mask[k : k + 50] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], mask.astype(np.int8)))) == 1))
        out[i] = (len(data), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~mask].tobytes()).hexdigest())
    return out


def test_suffixes(spark):
    rows = texts(80, 7) + [(1000, "ab" * 400), (1001, "xab" + "ab" * 60), (1003, "Licence é " * 12)]
    got = suffixes.repeated_bytes(frame(spark, rows), suffixes.Repeats(group_bytes=3000)).collect()
    want = removed_by_brute_force(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert sum(v[1] for v in want.values()) > 1000


def test_suffix_edges(spark):
    long = "0123456789" * 6
    rows = [(None, long), (2, long), (2, long), (3, long), (4, None)]
    got = suffixes.repeated_bytes(frame(spark, rows).withColumn("group", F.lit(9)).withColumn("mark", F.lit("m"))).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (2, 0), (2, 0), (3, 60), (4, 0)]
    assert suffixes.repeated_bytes(frame(spark, [])).collect() == []
    kept = suffixes.without_repeats(frame(spark, [(1, "é" * 40), (2, "è" + "é" * 39 + "z")])).collect()
    assert {r.doc_id: r.kept_text for r in kept} == {1: "é" * 40, 2: "èz"}


@pytest.mark.parametrize("letters", [1, 2, 26])
def test_suffix_order(letters):
    rng = random.Random(letters)
    for _ in range(150):
        s = [rng.randint(1, letters) for _ in range(rng.randint(1, 50))]
        assert suffixes.suffix_order(np.array(s), 9).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        for depth in (1, 2):
            o, n = suffixes.suffix_order(np.array(s), depth).tolist(), 3**depth
            assert sorted(o) == list(range(len(s))) and all(s[a : a + n] <= s[b : b + n] for a, b in zip(o, o[1:], strict=False))


def test_wide_suffix_order(monkeypatch):
    monkeypatch.setattr(suffixes, "_NARROW", 5)
    test_suffix_order(2)


def edits(a, b):
    """Least edit distance of a to a part of b."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, e in enumerate(b, 1):
            last, row[j] = row[j], min(last + (c != e), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(2))
        assert decontaminate.edit_distance_within(a, b) == edits(a, b)


def test_decontamination(spark):
    rng = random.Random(5)
    prose = lambda k: " ".join("".join(rng.choices(WORDS, k=rng.randint(2, 4))) for _ in range(k))
    items = [(k, prose(30)) for k in range(12)] + [(90, "short one"), (91, None), (92, ""), (93, "  ")]
    docs = []
    for k in range(60):
        item = list(items[k % 12][1])
        for _ in range(rng.randint(0, len(item) // 11) if k % 3 else 0):
            item[rng.randrange(len(item))] = rng.choice("xyz ")
        body = "".join(item) if k % 4 else prose(10)
        docs.append((k, f"{prose(rng.randint(0, 30))} {body.upper() if k % 5 == 0 else body}\n{prose(rng.randint(0, 30))}"))
    docs += [(500, "a SHORT\n one b"), (501, None), (502, ""), (503, items[0][1]), (504, items[1][1][:60])]
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()}
    plain = lambda t: decontaminate.plain((t or "").encode())
    want = {(d, i): e for d, t in docs for i, x in items if plain(x) for e in [edits(plain(x), plain(t))] if e <= int(0.1 * len(plain(x)))}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and len(want) > 40
    assert all(got[k] == want[k] for k in got)
    kept = decontaminate.decontaminate(frame(spark, docs), frame(spark, items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.contaminated(frame(spark, docs), frame(spark, [], "item_id long, text string")).collect() == []


def leak_edits(spark, items, docs):
    return {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()}


def test_decontamination_of_joined_words(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(40)]
    item = " ".join(words)
    joined = " ".join([a + b for a, b in zip(words[:26:2], words[1:26:2], strict=True)] + words[26:])
    lost = len(item) - len(joined)
    assert lost == 13 and len(set(words) - set(joined.split())) > int(0.1 * len(item))
    assert leak_edits(spark, [(1, item)], [(5, f"before it {joined} after it")]) == {(5, 1): lost}


@pytest.mark.parametrize("spread", ["even", "random", "front"])
def test_decontamination_at_the_limit(spark, spread):
    rng = random.Random(spread)
    prose = lambda k: " ".join("".join(rng.choices(WORDS, k=rng.randint(1, 4))) for _ in range(k))
    items = [(k, prose(rng.choice([20, 40, 60])) + rng.choice(["", " é ñañ 日本"])) for k in range(60)]
    docs = []
    for k, t in items:
        most, out = int(0.1 * len(t)), list(t)
        where = [int((j + 0.5) * len(t) / most) for j in range(most)] if spread == "even" else rng.sample(range(len(t)), most) if spread == "random" else range(most)
        for j in where:
            out[j] = rng.choice(["Q", "", out[j] + "Z"])
        docs.append((k, f"{prose(rng.randint(0, 9))} {''.join(out)} {prose(rng.randint(0, 9))}"))
    plain = lambda t: decontaminate.plain(t.encode())
    want = {(k, k): e for (k, t), (_, d) in zip(items, docs, strict=True) for e in [edits(plain(t), plain(d))] if e <= int(0.1 * len(plain(t)))}
    assert len(want) > 40
    got = leak_edits(spark, items, docs)
    assert {k: got.get(k) for k in want} == want


def test_decontamination_of_short_items(spark):
    items = [(1, "what is the capital"), (2, "name two primes"), (3, "who am i"), (4, "日本 の 首都 は どこ です か")]
    docs = [(10, "q: (What is the capitol?)"), (11, '"name two primes".'), (12, "[who am I]"), (13, "name tvo primes"), (14, "who an i"), (15, "何 日本 の 首都 わ どこ です か"), (16, "whatisthe capital")]
    assert leak_edits(spark, items, docs) == {(10, 1): 1, (11, 2): 0, (12, 3): 0, (13, 2): 1, (15, 4): 1}
    rng = random.Random(2)
    items = [(k, "".join(rng.choices("ab c", k=rng.randint(1, 24)))) for k in range(40)]
    docs = [(k, "".join(rng.choices("ab c", k=rng.randint(1, 60)))) for k in range(60)]
    plain = lambda t: decontaminate.plain(t.encode())
    want = {(d, i): e for d, t in docs for i, x in items if plain(x) for e in [edits(plain(x), plain(t))] if e <= int(0.1 * len(plain(x)))}
    assert len(want) > 50 and leak_edits(spark, items, docs) == want


def test_pivots(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    rows = [(k, (base[k % 40] + rng.standard_normal(16) * (0.12 if k > 40 else 0)).tolist(), k % 3) for k in range(200)]
    rows += [(300, base[0].tolist(), 0), (301, (2 * base[0]).tolist(), 0), (302, None, 0), (303, [0.0] * 16, 0), (304, [float("nan")] * 16, 0), (305, [1.0, None], 0), (306, base[0].tolist(), None), (307, [1.0, 2.0], 0), (308, [2.0, 4.0], 0), (309, [], 0)]
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v, lab in rows if v and None not in v and np.all(np.isfinite(np.array(v, float))) and any(v) and lab is not None}
    label = {i: lab for i, _, lab in rows}
    links = [(a, b) for a, b in combinations(unit, 2) if label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    want = smallest_reachable(label, links)
    got = pivots.near_vectors(frame(spark, rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got) / 2
    assert 0.9 * len(links) <= found <= len(links) and len(links) > 50
    exact = {r.vec_id: r.n_links for r in got}
    assert all(exact[i] == 0 for i in (302, 303, 304, 305, 306, 309)) and exact[307] == exact[308] == 1
    assert sum(r.component_id == want[r.vec_id] for r in got) >= 0.9 * len(got)
    assert pivots.near_vectors(frame(spark, [], "vec_id long, embedding array<float>, label int")).collect() == []


def test_urls(spark):
    rows = [(1, None), (2, "nourl"), (3, "http://A.Example.NET/en/x?y"), (4, "http://x.SPAM-farm.example.org:80//a/b?x"), (5, "://"), (None, "http://spam-farm.example.org/fr/x"), (7, "http://myspam-farm.example.org"), (8, "ftp://net/#"), (8, "http://n.net#/x")]
    got = urls.url_verdicts(frame(spark, rows, "page_id long, url string").withColumn("key", F.lit("clash")), urls.default_listing(spark)).collect()
    assert sorted(((r.page_id or 0), r.host, r.path, r.rule, r.verdict) for r in got if r.page_id != 8) == [
        (0, "spam-farm.example.org", "/fr/x", "org/fr/", "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.net", "/en/x", "example.net/en/", "allow"),
        (4, "x.spam-farm.example.org:80", "//a/b", None, "block"), (5, "", "", None, "allow"), (7, "myspam-farm.example.org", "", None, "allow"),
    ]
    assert sorted((r.host, r.path, r.rule or "", r.verdict) for r in got if r.page_id == 8) == [("n.net", "", "", "allow"), ("net", "/", "net/", "block")]


def test_listed_suffixes_folders_and_queries(spark):
    listing = frame(spark, [("b.c.d.e.f.org/",), ("x.org/1/2/3/4/5/",), ("x.org/page?id=7",), ("y.org:8080/",)], "key string")
    listed = ["http://a.b.c.d.e.f.org/p", "http://x.org/1/2/3/4/5/6/7", "http://w.x.org/page?id=7#top", "http://y.org:8080/a"]
    free = ["http://c.d.e.f.org/", "http://x.org/1/2/3/4/6/", "http://x.org/page?id=8", "http://x.org/page", "http://y.org/a", "http://y.org:80/a"]
    got = urls.listed_urls(frame(spark, [(u,) for u in listed + free], "url string"), listing)
    assert sorted(r.url for r in got.collect()) == sorted(listed)


def test_long_urls_cost_their_length(spark):
    listing = frame(spark, [("x.org/1/2/3/4/5/",), ("b.c.d.org/",), ("y.org:8080/q?" + "k" * 3000,), ("z.org/a/",)], "key string")
    labels, folders = "a." * 1000, "f/" * 3000
    listed = [f"http://{labels}x.org/1/2/3/4/5/{folders}", f"http://{labels}b.c.d.org:80/{folders}", "http://y.org:8080/q?" + "k" * 3000, "http://z.org/" + "b/../" * 1600 + "a/c", "http://z.org" + "/" * 8000 + "a/"]
    free = [f"http://{labels}x.org/1/2/3/4/6/{folders}", f"http://{'x.' * 4000}org/", "http://z.org/" + "a/../" * 1600, "http://z.org/" + "a" * 8000, "http://" + "." * 8000 + "b/", "http://" + "@" * 8000, "http://z.org/" + "%2e" * 2600]
    seconds = {}
    for rows in (["http://z.org/a/", "http://z.org/b/"], listed + free):
        for k in range(2):  # the first run compiles
            began = time.time()
            got = urls.listed_urls(frame(spark, [(u,) for u in rows], "url string"), listing).collect()
            seconds[len(rows)] = time.time() - began
    assert sorted(r.url for r in got) == sorted(listed)
    assert seconds[len(listed + free)] < seconds[2] + len(listed + free)


def test_keys_within_the_shape_are_all_keys(spark):
    """A listing with few labels and folders finds what one with many finds."""
    rng = random.Random(6)
    part = lambda: rng.choice(["a", "b", "c", "org"])
    rows = [f"http://{'.'.join(part() for _ in range(rng.randint(1, 5)))}{rng.choice(['', ':81'])}/{'/'.join(part() for _ in range(rng.randint(0, 4)))}{rng.choice(['', '/', '?a'])}" for _ in range(300)]
    keys = [f"{'.'.join(part() for _ in range(rng.randint(1, 3)))}/{'/'.join(part() for _ in range(rng.randint(0, 2)))}{rng.choice(['', '/', '?a'])}" for _ in range(60)]
    found = [{r.url for r in urls.listed_urls(frame(spark, [(u,) for u in rows], "url string"), frame(spark, [(k,) for k in keys + more], "key string")).collect()} for more in ([], ["q." * 20 + "q/" + "q/" * 20])]
    assert found[0] == found[1] and 20 < len(found[0]) < 300


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_filter_keeps_every_listed_key(spark, limit):
    listing = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".org/")).alias("key"))
    keys = spark.range(9000).select(F.concat(F.lit("h"), "id", F.lit(".org/")).alias("key"))
    hits = urls.possible(keys, listing, urls.Bloom(broadcast_bytes=limit))
    assert hits.join(listing, "key").count() == 3000 and hits.count() < 3400
    assert urls.possible(keys, listing.limit(0), urls.Bloom()).count() == 0


HOSTILE = {
    "stray end tags": "<b>" * 30_000 + "</i>" * 30_000,
    "paragraphs in depth": "<b>" * 30_000 + "<p>w" * 30_000,
    "stray end tags in a menu": "<nav>" + "<b>" * 30_000 + "</i>" * 30_000 + "<i></i>" * 10_000,
    "heads": "<head>" * 40_000,
    "bodies in depth": "<b>" * 30_000 + "<body>" * 20_000,
    "lists in depth": "<ul><li><b>" * 15_000,
    "articles in depth": "<article><p>some words" * 10_000,
    "attributes": "<a " + "x " * 60_000 + ">" + '<a ="" ' * 20_000,
    "signs": "<" * 100_000 + "&amp" * 30_000,
    "raw text": "<textarea>" * 20_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_page_time_is_linear(name):
    began = time.process_time()
    mainhtml.main_text(HOSTILE[name])
    assert time.process_time() - began < 5  # quadratic time would be minutes


def test_toxicity_learns(spark):
    rng = random.Random(8)
    prose = lambda k: " ".join("".join(rng.choices(WORDS, k=rng.randint(1, 4))) for _ in range(k))
    rows = []
    for k in range(700):
        w = prose(rng.randint(20, 200)).split()
        if k % 4 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "blorg" + rng.choice(["", "en", "ist", "a"]))
        rows.append((k, " ".join(w)))
    docs = frame(spark, [*rows, (900, ""), (901, None), (None, "blorgen"), (902, "x" * 50000)])
    labels = frame(spark, [(k, int(k % 4 == 0)) for k in range(700)] + [(None, 1), (900, None), (5000, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels, toxicity.Toxicity(epochs=4)).collect()
    assert len(got) == 704 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 700]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert {r.doc_id: r.score for r in got}[900] == 0


def test_training_reads_a_bounded_sample(spark, monkeypatch):
    """Ids that repeat, with other texts and very long ones, give one row each at most, in any order of the rows."""
    read = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, p: read.append((texts, labels)) or toxicity.Net(p))
    rows = [(k, f"text {k}") for k in range(40)] + [(k, f"another text {k}") for k in range(10)] * 50 + [(5, "x" * 5000), (39, None)] + [(41, "y" * 5000)]
    labels = frame(spark, [(k, k % 2) for k in range(50)] * 2, "doc_id long, toxic int")
    p = toxicity.Toxicity(positives=8, negatives=9, longest=1000)
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        toxicity.fit(frame(spark, rows).repartition(3 + seed), labels, p)
    assert read[0] == read[1] and 0 < len(read[0][0]) <= 17 and max(map(len, read[0][0])) <= 1000
    assert len(set(read[0][0])) == len(read[0][0])


def test_toxicity_gradient():
    p = toxicity.Toxicity(hidden=3, word_size=2, char_size=2, log_words=4, log_grams=4)
    net = toxicity.Net(p)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    _, _, words, tokens, _ = next(toxicity.blocks(pa.array(["ab cd ab efg h ij kl m"]), p))
    tokens, labels = tokens[:8].reshape(2, 4), np.array([1.0, 0.0])

    def loss():
        q = 1 / (1 + np.exp(-net.forward(net.gates(words), tokens).astype(np.float64)))
        return -np.mean(labels * np.log(q) + (1 - labels) * np.log(1 - q))

    grad, rng = net.gradient(words, tokens, labels), np.random.default_rng(0)
    for name, g in grad.items():
        flat = net.w[name].reshape(-1)
        for k in rng.choice(flat.size, min(6, flat.size), replace=False):
            keep, step = flat[k], 1e-2
            flat[k] = keep + step
            up = loss()
            flat[k] = keep - step
            down = loss()
            flat[k] = keep
            if name != "gram" or k < flat.size - p.char_size:
                assert abs((up - down) / (2 * step) - g.reshape(-1)[k]) < 2e-3, name


def test_main_text(spark):
    page = '<html><head><title>t</title></head><body><nav><a href="/x">menu</a></nav><div class="ad">buy</div><article><h1>A &amp;amp; B</h1><p><b>one<br><p>two &lt;\n three<script>x</script></article><div id="comments"><p>first!</p></div><footer>f</footer>'
    assert mainhtml.main_text(page) == "A &amp; B one two < three"
    for x in (None, "", "<", "<!-- a", "<div" * 50, "<script>a", '<p class="'):
        assert mainhtml.main_text(x) in ("", "<")
    assert mainhtml.main_text("<div>" * 5000 + "deep") == "deep"
    rows = [(1, "u", page), (None, None, None), (1, "u", page)]
    got = mainhtml.extract(frame(spark, rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert sorted(r.n_chars for r in got) == [0, 25, 25]


def test_main_text_without_landmark():
    body = "".join(f"<p>{'word ' * 60}{k}</p>" for k in range(5))
    page = f'<body><ul><li><a href="a">one</a></li><li><a href="b">two</a></li></ul><div><div>{body}</div></div><div class="sidebar"><p>{"side " * 80}</p></div></body>'
    assert mainhtml.main_text(page) == " ".join(f"{('word ' * 60)}{k}" for k in range(5))


@pytest.mark.parametrize("wrapper", ['div class="layout has-sidebar"', 'div class="no-sidebar"', 'div class="share-enabled"', 'div class="post has-comments"', 'div id="widget-page"', "form", 'div role="form"'])
def test_main_text_in_a_named_wrapper(wrapper):
    body, end = "".join(f"<p>{'word ' * 60}{k}</p>" for k in range(5)), wrapper.split()[0]
    want = " ".join(f"{('word ' * 60)}{k}" for k in range(5))
    side = '<nav><a href="/x">menu</a></nav><div class="sidebar"><p>side</p></div><input value="x"><button>go</button><select><option>one</select>'
    assert mainhtml.main_text(f"<body><{wrapper}>{side}<article>{body}</article></{end}></body>") == want
    assert mainhtml.main_text(f"<body><{wrapper}>{side}<div>{body}</div></{end}></body>") == want
    assert mainhtml.main_text(f"<body><{wrapper}>{side}<main>{body}</main></{end}><form><p>mail <input></p></form></body>") == want


def test_main_text_without_comments_in_articles():
    post = "".join(f"<p>{'word ' * 30}{k}</p>" for k in range(3))
    page = f'<main><article>{post}</article><div id="comments" class="comments-area"><article class="comment-body"><p>{"reply " * 300}</p></article></div></main>'
    assert mainhtml.main_text(page) == " ".join(f"{('word ' * 30)}{k}" for k in range(3))


def test_main_text_beside_a_longer_advert():
    assert mainhtml.main_text(f'<body><div class="ad">{"buy " * 90}</div><article><h1>Title</h1><p>short one</article></body>') == "Title short one"


def test_chat_escapes():
    rng = random.Random(1)
    bits = ["<", "|", "\\", "[", "INST]", "/", "s>", chat.START, chat.END, "\n", "x", "%", "%0A", "é"]
    for _ in range(4000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 8)))
        assert chat.unescape(chat.escape(t)) == t and chat.unescape_role(chat.escape_role(t)) == t
        assert not any(c in chat.escape(t) for c in (chat.START, chat.END, "</s>", "[INST]", "[/INST]"))
        turns = [("".join(rng.choices(bits, k=rng.randint(0, 3))), t) for _ in range(3)]
        assert chat.read_back(chat.render(turns).text) == turns


def test_chat_mask(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "日本 <|end|> 😀"), (1, 2, "assistant", "x"), (2, None, None, None), (None, 0, "assistant", ""), (3, 0, "assistant", chat.HARD), (3, 0, "assistant", chat.HARD)]
    out = chat.format_chats(frame(spark, rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.chat_digests(out).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].loss_sha256 == sha("日本 <|end|> 😀x") and got[1].n_turns == 3 and got[2].loss_chars == 0
    assert got[3].loss_sha256 == sha(chat.HARD * 2) and got[3].turns_sha256 == sha(f"assistant\n{chat.HARD}\n" * 2)
    for r in out.collect():
        assert len(r.ids) == len(r.mask)
    assert chat.format_chats(frame(spark, [], "conv_id long, turn long, role string, text string")).collect() == []


def test_token_counts(spark):
    rng = random.Random(6)
    for _ in range(400):
        first, rest = (["".join(rng.choices("ab", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 5))] for _ in range(2))
        a = tokencount.Automaton(first, rest)
        for _ in range(10):
            w, i, n = "".join(rng.choices("ab", k=rng.randint(1, 9))), 0, 0
            while i < len(w) and n >= 0:
                j = next((j for j in range(len(w), i, -1) if w[i:j] in (rest if i else first)), None)
                i, n = (j, n + 1) if j else (len(w), -1)
            assert a.count(w) == n
    got = tokencount.token_counts(frame(spark, [(1, "ab, c"), (2, None), (None, "")]), ["a", ",", "ab"], ["b"]).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_tokens, r.n_unknown) for r in got) == [(0, 0, 0, 0), (1, 3, 3, 1), (2, 0, 0, 0)]


def test_sampled_pieces(spark):
    vocabulary = pieces.load_pieces()
    rows = [*texts(40, 9), (9001, "  a  b\n\t c▁d ▁ é 日本 😀 x"), (9002, "▁"), (9003, "y" * 30000), (None, "null id")]
    once = sampling.segment(frame(spark, rows), vocabulary)
    assert once.where("not lossless").count() == 0
    ids = {r.doc_id: r.pieces for r in once.collect()}
    again = {r.doc_id: r.pieces for r in sampling.segment(frame(spark, rows[::-1]).repartition(3), vocabulary, block=500).collect()}
    assert {k: v for k, v in ids.items() if k} == {k: v for k, v in again.items() if k}
    assert {r.doc_id: r.text for r in sampling.join_pieces(once, vocabulary).collect()} == {i: t or "" for i, t in rows}


def test_samples_follow_the_lattice():
    vocabulary = pieces.load_pieces()
    lattice, n, word = sampling.Lattice(vocabulary), 20000, "▁thing"
    index = {t: k for k, t in enumerate(vocabulary.text) if k not in vocabulary.special}

    def ways(s):
        return [[]] if not s else [[s[:k], *r] for k in range(1, len(s) + 1) if s[:k] in index for r in ways(s[k:])]

    weight = {tuple(index[t] for t in w): np.prod([1 / (vocabulary.rank[index[t]] + 1) for t in w]) for w in ways(word)}
    ids, ends = lattice.encode(["thing"] * n, np.arange(n))
    seen: dict = {}
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        seen[tuple(ids[a:b].tolist())] = seen.get(tuple(ids[a:b].tolist()), 0) + 1
    total = sum(weight.values())
    assert set(seen) <= set(weight) and max(abs(seen.get(w, 0) / n - v / total) for w, v in weight.items()) < 0.02


def slow_density(node):
    """(characters, tags, link characters, link tags) of a tree without names, straight from their definitions."""
    own = len("".join("".join(p for p in node.parts if isinstance(p, str)).split()))
    inner = [(k, slow_density(k)) for k in node.kids]
    chars = own + sum(x[0] for _, x in inner)
    links = chars if node.tag == "a" else sum(x[2] for _, x in inner)
    return chars, sum(x[1] + 1 for _, x in inner), links, sum(x[3] + (k.tag == "a") for k, x in inner)


def test_densities_and_threshold():
    rng = random.Random(20)

    def part(depth):
        tag = rng.choice(["div", "p", "a", "section", "ul", "span"])
        inside = "".join(part(depth - 1) if depth and rng.random() < 0.5 else "w " * rng.randint(0, 30) for _ in range(rng.randint(0, 4)))
        return f"<{tag}>{inside}</{tag}>"

    for _ in range(60):
        root = mainhtml.parse(f"<body>{''.join(part(3) for _ in range(4))}</body>")
        order = mainhtml.measure(root, names=False)
        chars, _, links, _ = slow_density(root)
        for n in order:
            c, t, lc, lt = slow_density(n)
            want = 0.0
            if c:
                base = np.log(np.log(c / max(1, c - lc) * lc + links / chars * c + np.e**2))
                want = c / max(1, t) * max(0.0, np.log(c / max(1, lc) * max(1, t) / max(1, lt))) / base
            assert abs(n.density - want) < 1e-9 * max(1, want) and abs(n.total - sum(k.density for k in n.kids)) < 1e-9
        body = next((n for n in order if n.tag == "body"), root)
        inside = mainhtml.postorder(body)
        chosen = mainhtml.content(root, names=False)
        best = max(n.total for n in inside)
        if best:
            tops = [n for n in inside if n.total == best]
            least = min(min(x.density for x in mainhtml.path_to(n, body)) for n in tops)
            assert any(id(n) in chosen for n in tops)
            assert all(n.total >= least for n in inside if id(n) in chosen)


def test_density_decides():
    """No name or landmark tells these parts apart, so taking all that isn't named would keep the boilerplate."""
    body = "".join(f"<p>{'word ' * 60}{k}</p>" for k in range(5))
    want = " ".join(f"{('word ' * 60)}{k}" for k in range(5))
    links = "".join(f'<li><a href="{k}">entry {k}</a></li>' for k in range(20))
    page = f'<body><div class="top">we value your visit</div><div class="x1"><ul>{links}</ul></div><div class="x2">{body}</div><div class="x3"><span>all rights</span> reserved</div></body>'
    assert mainhtml.main_text(page) == mainhtml.main_text(page, names=False) == want
    short = '<body><div class="ad">buy this now, it is the best there is</div><article><h1>Two</h1><p>words</article><footer>long words of a footer here</footer></body>'
    assert mainhtml.main_text(short) == "Two words" != mainhtml.main_text(short, names=False)


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "page-with-comments", "no-share", "sidebar", "share"])
def test_names_yield_to_most_of_the_text(name):
    body = "".join(f"<p>{'word ' * 60}{k}</p>" for k in range(5))
    want = " ".join(f"{('word ' * 60)}{k}" for k in range(5))
    end = '<div class="comments"><p>first!</p><p>second one</p></div><footer>imprint</footer>'
    assert mainhtml.main_text(f'<body><div class="{name}"><nav><a href="/">home</a></nav><div>{body}</div>{end}</div></body>') == want
    assert mainhtml.main_text(f'<body><div class="{name}"><article>{body}{end}</article></div></body>') == want


def test_main_text_edges(spark):
    kind = "page_id long, url string, html string"
    assert mainhtml.extract(frame(spark, [], kind)).collect() == []
    text = "word " * 300_000
    assert mainhtml.main_text(f"<body><article><p>{text}</p></article></body>") == text.strip()
    many = "<p>one two</p>" * 20_000
    assert mainhtml.main_text(f"<body><nav>menu</nav>{many}</body>") == " ".join(["one two"] * 20_000)


def test_urls_are_canonical(spark):
    listing = frame(spark, [("x.org/a/d/",), ("y.org:8080/p",), ("z.org/cAt",), ("com/",), ("a.b.c.d.e.f.com/",), ("w.org/1/2/3/4/5/6/",)], "key string")
    listed = ["http://u:p@X.org:80/a/./b/../d/e?q", "http://m.y.org:8080/p", "https://z.org:443/c%41t", "http://any.com", "http://w.a.b.c.d.e.f.com", "http://w.org/1/2/3/4/5/6/7", "http://x.org/../a//d/"]
    free = ["http://x.org/a/b/d/", "http://y.org/p", "http://z.org/c%zzt", "http://com.org/", "http://w.org/1/2/3/4/5/", "nothing"]
    got = urls.listed_urls(frame(spark, [(u,) for u in listed + free], "url string"), listing)
    assert sorted(r.url for r in got.collect()) == sorted(listed)


def test_urls_of_empty_tables(spark):
    kind = "page_id long, url string"
    assert urls.url_verdicts(frame(spark, [], kind), urls.default_listing(spark)).collect() == []
    rows = [(1, "http://spam-farm.example.org/"), (2, None), (2, None), (None, None)]
    got = urls.url_verdicts(frame(spark, rows, kind), frame(spark, [], "key string")).collect()
    assert sorted((r.page_id or 0, r.host, r.verdict) for r in got) == [(0, "", "allow"), (1, "spam-farm.example.org", "allow"), (2, "", "allow"), (2, "", "allow")]


def test_single_urls_of_the_listing(spark):
    rows = [(1, "http://tionble.example.org/es/7952?utm_source=feed"), (2, "http://www.tionble.example.org/es/7952?utm_source=feed"), (3, "http://tionble.example.org/es/7952")]
    k = next(k for k in range(urls.LISTED_URLS) if (k % 5, k // 5 % 4, k // 20 % 5) == (1, 0, 3))
    listed = f"{urls.LISTED_HOSTS[1]}/de/{k * 7 % urls.LISTED_NUMBERS}?utm_source=feed"
    rows += [(4, f"https://{listed}#top"), (5, f"https://m.{listed}"), (6, f"https://{listed}x")]
    got = {r.page_id: r.verdict for r in urls.url_verdicts(frame(spark, rows, "page_id long, url string"), urls.default_listing(spark)).collect()}
    keys = {r.key for r in urls.default_listing(spark).collect()}
    assert listed in keys and len(keys) > 6000 and (got[4], got[5], got[6]) == ("block", "block", "allow")


def test_shared_folder(spark, monkeypatch):
    from sparkloom.llm import common

    class Context:
        master = "spark://far:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def plain_score(text, net):
    """A text's score by plain loops over windows, directions and words."""
    p, w = net.p, {k: v.astype(np.float64) for k, v in net.w.items()}
    data = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, hashes = toxicity.words_of(data)
    inputs = []
    for a, z, h in zip(starts, ends, hashes, strict=True):
        word = b"<" + bytes(c + 32 if 65 <= c <= 90 else c for c in data[a:z].tobytes()) + b">"
        rows = [int(toxicity.mix64(np.array([int.from_bytes(word[k : k + n], "little") * (2 * n - 1) % 2**64], np.uint64))[0]) % (1 << p.log_grams) for n in p.grams for k in range(len(word) - n + 1)]
        gram = sum((w["gram"][r] for r in rows), np.zeros(p.char_size)) / np.sqrt(max(1, len(rows)))
        inputs.append(np.concatenate((w["word"][int(h) % (1 << p.log_words)], gram)))
    n, best = len(inputs), None
    for start in sorted({min(k, max(0, n - p.window)) for k in range(0, max(1, n - p.window + p.step), p.step)}) if n else ():
        part, states = inputs[start : start + p.window], []
        for side in (0, 1):
            state, seen = np.zeros(p.hidden), []
            for x in part if side == 0 else part[::-1]:
                g, rec = x @ w["x"][side] + w["bias"][side], state @ w["u"][side]
                z, r = (1 / (1 + np.exp(-(g + rec)[k * p.hidden : (k + 1) * p.hidden])) for k in (0, 1))
                new = np.tanh(g[2 * p.hidden :] + r * rec[2 * p.hidden :])
                state = z * state + (1 - z) * new
                seen.append(state)
            states.append(seen if side == 0 else seen[::-1])
        states = np.concatenate([np.array(s) for s in states], axis=1)
        e = np.exp(np.tanh(states @ w["att"]) @ w["att_v"])
        logit = (e / e.sum()) @ states @ w["out"] + w["out_b"][0]
        best = logit if best is None else max(best, logit)
    return 0.0 if best is None else 1 / (1 + np.exp(-best))


def test_toxicity_scores_by_plain_loops(spark):
    rng = random.Random(40)
    net = toxicity.Net(toxicity.Toxicity(log_words=6, log_grams=7))
    prose = lambda k: " ".join("".join(rng.choices(WORDS, k=rng.randint(1, 4))) for _ in range(k))
    rows = [prose(k) for k in (1, 2, 30, 63, 64, 65, 120, 121, 300)] + ["", None, " \n", "Ab é 日本", "x"]
    got = toxicity.text_scores(pa.array(rows), net)
    assert np.allclose(got, [plain_score(t, net) for t in rows], atol=1e-4)
    docs = frame(spark, [(3, rows[5]), (3, rows[5]), (None, rows[2])]).withColumn("key", F.lit("clash")).withColumn("score", F.lit(9))
    again = sorted((r.score for r in toxicity.score(docs, net).collect()))
    assert np.allclose(again, sorted([got[5], got[5], got[2]]), atol=1e-6)
    assert toxicity.score(frame(spark, []), net).collect() == []


def test_pivots_of_an_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (5, [1.0, 0.0], 0), (7, [0.0, 1.0], 0), (8, [0.0, 1.0], 0), (9, [0.0, 1.0], None), (None, [0.0, 1.0], 0)]
    got = pivots.near_vectors(frame(spark, rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [
        (0, 0, 0, True), (1, 1, 1, True), (1, 2, 1, True), (5, 1, 1, False), (7, 2, 1, False), (8, 2, 1, False), (9, 0, 9, True),
    ]


def test_pivots_find_planted_links(spark):
    """The shipped setting at the size of the driver's vectors, with links just above the least cosine and one large cluster."""
    rng = np.random.default_rng(17)
    rows = []
    for k in range(600):
        base = rng.standard_normal(64)
        base /= np.linalg.norm(base)
        for _ in range(300 if k == 0 else 3):
            noise = rng.standard_normal(64)
            noise -= (noise @ base) * base
            cosine = np.sqrt(rng.uniform(0.93, 0.97))  # of a member with its centre; of two members about its square
            v = cosine * base + np.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise)
            rows.append((len(rows), (v * rng.uniform(0.1, 9)).astype(np.float32).tolist(), k % 4))
    unit = pivots.units(np.array([r[1] for r in rows], np.float32))
    label = np.array([r[2] for r in rows])
    want = ((unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in pivots.near_vectors(frame(spark, rows, "vec_id long, embedding array<float>, label int"), pivots.Pivots(block=64)).collect()}
    found = np.array([got[k] for k in range(len(rows))])
    assert (found <= want).all() and want.sum() > 4000 and found.sum() >= 0.9 * want.sum()


def test_empty_tables_long_texts_and_clashing_columns(spark):
    vocabulary = pieces.load_pieces()
    long = "ab, " * 60_000
    rows = [(1, long), (1, long), (2, None), (None, "ab, c")]
    docs = frame(spark, rows).withColumn("pieces", F.lit(1)).withColumn("n_tokens", F.lit(2)).withColumn("edits", F.lit("x")).withColumn("key", F.lit(3)).withColumn("bucket", F.lit("b"))
    got = tokencount.token_counts(docs, ["a", ",", "ab"], ["b"]).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_tokens, r.n_unknown) for r in got) == [(0, 3, 3, 1), (1, 120_000, 120_000, 0), (1, 120_000, 120_000, 0), (2, 0, 0, 0)]
    once = sampling.segment(docs, vocabulary).collect()
    assert len(once) == 4 and all(r.lossless for r in once) and len({tuple(r.pieces) for r in once if r.doc_id == 1}) == 1
    items = frame(spark, [(7, "ab, ab, ab, c")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    assert {(r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(docs, items).collect()} == {(1, 7, 1)}
    cut = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffixes.repeated_bytes(docs.union(frame(spark, [(9, "ab, " * 50)]).selectExpr("*", "1", "2", "'x'", "3", "'b'"))).collect()}
    assert cut == {(1, 240_000, 0), (2, 0, 0), (None, 5, 0), (9, 200, 200)}
    near = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert near == {(1, 1), (2, 2), (None, None)}
    chats = frame(spark, [(1, 0, "assistant", long), (None, 1, "user", "x")], "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("mask", F.lit(2))
    assert {(r.conv_id, r.loss_chars) for r in chat.chat_digests(chat.format_chats(chats)).collect()} == {(1, 240_000), (None, 0)}
    empty = frame(spark, [])
    assert tokencount.token_counts(empty, ["a"], ["b"]).collect() == sampling.segment(empty, vocabulary).collect() == decontaminate.contaminated(empty, items).collect() == []


def test_many_items_with_one_text(spark):
    text = "a benchmark question that stands under many ids"
    items = frame(spark, [(k, text) for k in range(300)] + [(300, text.upper() + " "), (None, text), (301, None)], "item_id long, text string")
    docs = frame(spark, [(1, f"before {text} after"), (1, "other"), (2, "nothing of it"), (None, text.replace("many", "manx"))])
    got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(d, k, e) for d, e in ((1, 0), (None, 1)) for k in range(301)}
    assert sum(c.count() for c in decontaminate.chunks(items, decontaminate.Limits())) == 2
    assert [r.doc_id for r in decontaminate.decontaminate(docs, items).collect()] == [2]
