"""Readers and writers on small files written here."""

import io
import json
import lzma
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.sources import connectors, readers, writers, xz

POINTER = "version https://git-lfs.github.com/spec/v1\noid sha256:ab12\nsize 165\n"


def test_quoted_newlines_and_types(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_bytes(b'family,N_params_B,D_tokens_B,val_loss,is_converged\r\n"A\n (x)",7,10,2.5,1\r\n"B ""q""",1.0,10.0,2.0,0\r\n')
    rows = readers.read_table(spark, str(p), "scaling", "reported").orderBy("family").collect()
    assert [(r.family, r.N_params_B, r.D_tokens_B, r.provenance) for r in rows] == [("A (x)", 7.0, 10.0, "reported"), ('B "q"', 1.0, 10.0, "reported")]
    with pytest.raises(ValueError):
        readers.with_provenance(spark.range(1), "guessed")


def test_slash_names(spark, tmp_path):
    from sparkloom.operators.study import losses_long
    from sparkloom.plans.schemas import LOSS_DOMAINS

    p = tmp_path / "l.csv"
    p.write_text("index," + ",".join(f"metric/the_pile_{d}_val_loss" for d in LOSS_DOMAINS) + "\n0," + ",".join(["2.5"] * 13))
    rows = losses_long(readers.read_table(spark, str(p), "losses")).collect()
    assert len(rows) == 13 and {r.loss for r in rows} == {2.5}


def test_pointer_is_no_data(spark, tmp_path):
    p = tmp_path / "x.jsonl.xz"
    p.write_text(POINTER)
    assert readers.pointers(spark, str(tmp_path)).select("oid", "size").collect() == [("sha256:ab12", 165)]
    with pytest.raises(ValueError, match="pointer"):
        readers.read_xz_lines(spark, str(p), "a long")


def lines_of(n, width=60):
    return [json.dumps({"a": k, "t": f"é{k * 7919 % 1000003}" * (k % width)}) for k in range(n)]


def several_blocks(lines, block, end=b"\n", preset=6):
    out = io.BytesIO()
    packer = xz.Writer(out, block, preset)
    packer.write("\n".join(lines).encode() + end)
    packer.close()
    return out.getvalue()


@pytest.mark.parametrize("split", [100, 5000, 1 << 20])
@pytest.mark.parametrize("end", [b"", b"\n"])
def test_xz_lines_are_read_once(spark, tmp_path, split, end):
    """Files of one block, of many, of several streams with padding between, each line in one part."""
    lines = lines_of(2000)
    (tmp_path / "a.xz").write_bytes(lzma.compress("\n".join(lines[:300]).encode()))
    (tmp_path / "b.xz").write_bytes(several_blocks(lines[300:900], 4096, end))
    cut = [x.encode() + b"\n" for x in lines[900:]]
    whole = [lzma.compress(b"".join(cut[:100])), several_blocks(lines[1000:1500], 3000), lzma.compress(b""), lzma.compress(b"".join(cut[600:])[:-1] + end)]
    (tmp_path / "c.xz").write_bytes(whole[0] + whole[1] + b"\0" * 8 + whole[2] + whole[3] + b"\0" * 4)
    assert lzma.decompress((tmp_path / "b.xz").read_bytes()).decode().split("\n")[:600] == lines[300:900]  # as the library reads it
    got = readers.read_xz_lines(spark, str(tmp_path / "*.xz"), "a long, t string", split)
    assert sorted((r.a, r.t) for r in got.collect()) == [(k["a"], k["t"]) for k in map(json.loads, lines)]
    if split < 1 << 20:
        assert got.select(F.spark_partition_id()).distinct().count() > 3


@given(st.lists(st.text("ab\n", max_size=12)), st.integers(1, 20), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_every_cut_gives_the_same_lines(parts, block, chunk):
    text = "".join(parts).encode()
    out = io.BytesIO()
    packer = xz.Writer(out, block, 0)
    packer.write(text)
    packer.close()
    data = out.getvalue()
    want = text.split(b"\n")
    want = want[: -1 if not want[-1] else None]
    for split in (1, 50, 1000):
        cuts = range(0, len(data), split)
        assert [x for low in cuts for lines in xz.lines_between(io.BytesIO(data), len(data), low, low + split, chunk) for x in lines] == want


def test_xz_of_many_megabytes(spark, tmp_path):
    """60 MB in one stream of blocks, 40 MB in one block, and memory that doesn't follow."""
    rng = random.Random(1)
    words = [f"{rng.getrandbits(30):x}" for _ in range(5000)]
    lines = [json.dumps({"a": k, "t": " ".join(rng.choices(words, k=1500))}) for k in range(8000)]
    (tmp_path / "a.xz").write_bytes(several_blocks(lines[:5000], 8 << 20, preset=0))
    (tmp_path / "b.xz").write_bytes(lzma.compress("\n".join(lines[5000:]).encode(), preset=0))
    got = readers.read_xz_lines(spark, str(tmp_path / "*.xz"), "a long, t string", 4 << 20)
    assert got.agg(F.count("*"), F.sum("a"), F.sum(F.length("t"))).first() == (8000, 8000 * 7999 // 2, sum(len(json.loads(x)["t"]) for x in lines))


@pytest.mark.parametrize("spoil", ["half", "end", "byte", "text", "first stream"])
def test_damaged_xz_is_an_error(spark, tmp_path, spoil):
    data = bytearray(several_blocks(lines_of(1000), 20_000))
    if spoil == "byte":
        data[len(data) // 2] ^= 1
    data = {"half": data[: len(data) // 2], "end": data[:-4], "byte": data, "text": b"{}\n" * 900, "first stream": data[40:] + data}[spoil]
    (tmp_path / "a.xz").write_bytes(bytes(data))
    with pytest.raises(Exception, match="xz|index|block|orrupt|header"):
        readers.read_xz_lines(spark, str(tmp_path / "a.xz"), "a long, t string").collect()


def test_lines_that_do_not_fit_are_an_error(spark, tmp_path):
    (tmp_path / "a.xz").write_bytes(lzma.compress(b'{"a": 1}\nno json\n'))
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        readers.read_xz_lines(spark, str(tmp_path / "a.xz"), "a long").collect()


def test_sink_publishes_what_it_verified(spark, tmp_path):
    path, rows = f"file:{tmp_path}/out", spark.range(500).withColumn("t", F.concat(F.lit("é\n"), "id"))
    connectors.write_xz_lines(rows.repartition(3), path, block=1000)
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert files[0] == "_SUCCESS" and len(files) == 4 and json.loads((tmp_path / "out/_SUCCESS").read_text())["lines"] == 500
    assert sorted(readers.read_xz_lines(spark, path, "id long, t string", 500).collect()) == sorted(rows.collect())
    with pytest.raises(Exception, match="holds files already"):
        connectors.write_xz_lines(rows, path)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == files
    connectors.write_xz_lines(rows.limit(7), path, overwrite=True)
    assert readers.read_xz_lines(spark, path, "id long, t string").count() == 7
    with pytest.raises(ValueError, match="own"):
        connectors.write_xz_lines(rows, path, source=f"{tmp_path}//out")


def test_a_failing_check_leaves_no_output(spark, tmp_path):
    rows = spark.range(50)
    for totals in ((49, 0), (50, 1)):
        with pytest.raises(Exception, match="nothing is published"):
            connectors.write_xz_lines(rows, f"{tmp_path}/out", totals=totals)
        assert not (tmp_path / "out").exists()
    broken = rows.select(F.when(F.col("id") == 40, F.raise_error(F.lit("broken row"))).otherwise(F.col("id").cast("string")).alias("line"))
    spark.dataSource.register(connectors.XzLines)
    with pytest.raises(Exception, match="broken row"):
        broken.write.format("xz_lines").mode("append").save(f"{tmp_path}/out")
    assert not (tmp_path / "out").exists()


def test_a_retried_task_counts_once(tmp_path, monkeypatch):
    """Two attempts of a task have staged a file each; only the one that is told of is published."""
    sink = connectors.XzSink({"path": f"{tmp_path}/out", "lines": "2"}, False)
    monkeypatch.setattr(connectors.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})()))
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b"])], ["line"])
    attempts = [sink.write(iter([batch])) for _ in range(2)]
    sink.commit([attempts[1], None])
    kept = [p for p in (tmp_path / "out").iterdir() if p.suffix == ".xz"]
    assert [p.name for p in kept] == [attempts[1].path] and lzma.decompress(kept[0].read_bytes()) == b"a\nb\n"
    assert not [p for p in (tmp_path / "out").iterdir() if "staging" in p.name]


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


def test_ranges_read_what_they_ask(spark, tmp_path):
    data = bytes(range(256)) * 40_000
    (tmp_path / "a.bin").write_bytes(data)
    (tmp_path / "b.bin").write_bytes(data[:1000])
    got = readers.read_byte_range(spark, str(tmp_path), 500, 10, 5_000_000).collect()
    want = {("a.bin", at): data[at : at + 10] for at in range(500, len(data), 5_000_000)} | {("b.bin", 500): data[500:510]}
    assert {(r.path.split("/")[-1], r.start): bytes(r.bytes) for r in got} == want
    assert len(readers.read_byte_range(spark, str(tmp_path / "b.bin"), 995, 10).first().bytes) == 5  # the file ends there
    assert readers.read_byte_range(spark, str(tmp_path / "b.bin"), 1000, 10).collect() == []
    f = Counting(data)
    assert connectors.read_exactly(f, 9_000_000, 100) == data[9_000_000:9_000_100] and f.taken == 100
    f = Counting(several_blocks(lines_of(20_000), 100_000))
    size = len(f.getvalue())
    few = [x for lines in xz.lines_between(f, size, size // 2, size // 2 + 10_000) for x in lines]
    assert few and f.taken < size / 3  # index, own blocks and the next one, not the file
    reader = connectors.RangeReader({"path": str(tmp_path), "length": "100", "every": "100", "partitionbytes": "1000000"})
    assert len(reader.partitions()) == 12 and sum(len(p.ranges) for p in reader.partitions()) == len(data) // 100 + 10
    with pytest.raises(ValueError):
        connectors.RangeReader({"path": str(tmp_path), "length": "0"})


def test_cards(spark, tmp_path):
    folder = tmp_path / "m_details"
    folder.mkdir()
    body = {"all": {"t1": {"acc": 0.5, "alias": "x"}, "t2": {"acc": "N/A"}}, "t1": {}}
    (folder / "README.md").write_text("---\na: b\n---\n# Card\n## Latest results\n\n```python\n" + json.dumps(body, indent=4) + "\n```\nend")
    got = readers.read_cards(spark, f"{tmp_path}/*/README.md").orderBy("task", "metric").collect()
    assert [tuple(r) for r in got] == [("m_details", "t1", "acc", 0.5), ("m_details", "t1", "alias", None), ("m_details", "t2", "acc", None)]


def test_manifest_ranges_and_digests(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"problem": "A", "file": "x", "bytes": 3}, {"problem": "B", "file": "y", "bytes": 4, "note": "n"}]')
    assert [(r.file, r.bytes, r.note) for r in readers.read_manifest(spark, str(tmp_path / "m.json")).orderBy("file").collect()] == [("x", 3, None), ("y", 4, "n")]
    (tmp_path / "b.bin").write_bytes(b"0123456789")
    assert bytes(readers.read_byte_range(spark, str(tmp_path / "b.bin"), 3, 4).first()["bytes"]) == b"3456"
    import hashlib

    assert readers.file_digests(spark, str(tmp_path / "b.bin")).first().sha256 == hashlib.sha256(b"0123456789").hexdigest()


def test_sinks(spark, tmp_path):
    df = spark.range(4).withColumn("k", F.col("id") % 2)
    out = str(tmp_path / "out")
    with pytest.raises(ValueError, match="other than the source"):
        writers.write_table(df, out, source=out + "/")
    (tmp_path / "link").symlink_to(tmp_path)
    for same in (f"{tmp_path}/x/../out", f"file:{out}", f"file://{out}/", f"{tmp_path}/link/out"):
        with pytest.raises(ValueError, match="other than the source"):
            writers.write_table(df, out, source=same)
    assert writers.resolved("s3://b/a/../c/") == writers.resolved("s3://b//c") != writers.resolved("s3://d/c")
    writers.write_table(df, out, partition_by=["k"])
    assert spark.read.parquet(out).count() == 4
    writers.write_table(df, out + "j", "json")
    assert readers.read_json_folder(spark, out + "j", df.schema).count() == 4
    assert readers.read_parquet_folder(spark, out).count() == 4
