"""Ranges of files by source on sources and ids that the given tables don't have."""

import hashlib
import random

from sparkloom.plans.reader_queries import document_ranges
from sparkloom.session import new_folder


def test_order_and_odd_sources(spark):
    rng, folder = random.Random(3), new_folder(spark)
    sources = ["a+b", "a b", "", None, "é/%2B=", "one"]
    rows = [(k, rng.choice([None, "", f"text {k}"]), sources[k % 6] if k < 600 else "one") for k in range(60_000)] + [(None, "no id", "a+b")]
    rng.shuffle(rows)
    kind = "doc_id long, text string, source string"
    spark.createDataFrame(rows, kind).repartition(8).write.parquet(f"{folder}/documents.parquet")
    want = []
    for s in sources:
        mine = sorted((r for r in rows if r[2] == s), key=lambda r: (r[0] is None, r[0] or 0))
        digests = [None if r[1] is None else hashlib.md5(r[1].encode()).hexdigest() for r in mine]
        want += [(s, x) for n, x in enumerate(digests) if n >= 5 and (n - 5) % 10 < 3]
    got = [(r.source, r.digest) for r in document_ranges(spark, folder).collect()]
    key = lambda r: tuple((x is None, x or "") for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
