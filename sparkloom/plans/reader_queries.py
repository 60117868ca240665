"""Readers on files that are written from the driver's tables, so that SQL over the same tables gives the rows to expect."""

from __future__ import annotations

import json
import lzma

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import new_folder as folder
from sparkloom.session import table
from sparkloom.sources import readers
from sparkloom.sources.connectors import write_xz_lines

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered already")
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def put(spark: SparkSession, path: str, data: bytes) -> str:
    """Write a file where all executors can read it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(data)
    out.close()
    return path


def nations(spark: SparkSession, d: str) -> list:
    """The rows of a table of fixed size, for files that Spark has no writer for."""
    return table(spark, d, "nation").orderBy("n_nationkey").collect()


@query(
    """SELECT c_name || ' (x) "y"' AS family, CAST(c_custkey AS DOUBLE) AS n, c_acctbal AS d, c_nationkey AS converged, 'reported' AS provenance FROM customer"""
)
def read_csv(spark: SparkSession, d: str) -> DataFrame:
    """Quoted fields with newlines and doubled quotes, by a declared schema."""
    path = folder(spark)
    rows = table(spark, d, "customer").select(
        F.concat("c_name", F.lit('\n (x)  "y"')).alias("family"),
        F.col("c_custkey").alias("N_params_B"),
        F.col("c_acctbal").alias("D_tokens_B"),
        F.lit(2.5).alias("val_loss"),
        F.col("c_nationkey").alias("is_converged"),
    )
    rows.write.option("header", True).option("escape", '"').csv(path)
    got = readers.read_table(spark, path, "scaling", "reported")
    return got.select("family", F.col("N_params_B").alias("n"), F.col("D_tokens_B").alias("d"), F.col("is_converged").alias("converged"), "provenance")


@query("SELECT n_name AS file, CAST(n_nationkey * 1000 AS BIGINT) AS bytes, CASE WHEN n_nationkey % 2 = 0 THEN 'even' END AS note FROM nation")
def read_json_array(spark, d):
    rows = [{"problem": "A", "file": r.n_name, "bytes": r.n_nationkey * 1000} | ({"note": "even"} if r.n_nationkey % 2 == 0 else {}) for r in nations(spark, d)]
    path = put(spark, f"{folder(spark)}/manifest.json", json.dumps(rows, indent=1).encode())
    return readers.read_manifest(spark, path).select("file", "bytes", "note")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def read_json_files(spark, d):
    """A folder of JSON files, a document over many lines in each."""
    path = folder(spark)
    for r in nations(spark, d):
        put(spark, f"{path}/{r.n_regionkey}/{r.n_nationkey}.json", json.dumps(r.asDict(), indent=2).encode())
    return readers.read_json_folder(spark, path, table(spark, d, "nation").schema)


@query("SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS sizes FROM part GROUP BY ALL")
def read_parquet_files(spark, d):
    path = folder(spark)
    table(spark, d, "part").repartition(3).write.parquet(f"{path}/one/two")
    return readers.read_parquet_folder(spark, path).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("sizes"))


@query("SELECT n_nationkey AS a, n_name || chr(10) || 'é' AS t FROM nation")
def read_xz(spark, d):
    lines = "\n".join(json.dumps({"a": r.n_nationkey, "t": r.n_name + "\né"}) for r in nations(spark, d))
    path = put(spark, f"{folder(spark)}/rows.jsonl.xz", lzma.compress(lines.encode()))
    return readers.read_xz_lines(spark, path, "a int, t string")


@query("SELECT doc_id, md5(text) AS digest, lang, source, n_chars FROM documents")
def xz_documents(spark, d):
    """All documents, written as xz lines in blocks of 1 MB by the verifying sink, and read by the blocks that begin in each 4 MB."""
    path = folder(spark)
    write_xz_lines(table(spark, d, "documents").repartition(2), path, block=1 << 20)
    rows = readers.read_xz_lines(spark, path, table(spark, d, "documents").schema, split=4 << 20)
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "lang", "source", "n_chars")


@query(
    """SELECT source, digest FROM (SELECT source, md5(text) AS digest, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
    WHERE (n - 6) % 10 < 3 AND n > 5"""
)
def document_ranges(spark, d):
    """Three of every ten records of 33 bytes, from the sixth on, of files that hold a source's digests in the order of their ids."""
    path = folder(spark)
    folder_name = F.concat(F.lit("x"), F.hex(F.encode("source", "utf-8")))  # sources may be empty or hold any character
    digest = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("-" * 32))
    rows = table(spark, d, "documents").select(folder_name.alias("source"), "doc_id", digest.alias("digest")).repartition("source")
    rows = rows.sortWithinPartitions("source", F.asc_nulls_last("doc_id"))  # by source first, else the writer sorts by it again, which keeps no order of ids
    rows.select("source", "digest").write.partitionBy("source").text(path)
    got = readers.read_byte_range(spark, f"{path}/*/*.txt", 33 * 5, 33 * 3, 33 * 10)
    name = F.regexp_extract("path", "source=(x[0-9A-F]*)/", 1)  # none: the source is null
    source = F.when(name != "", F.decode(F.unhex(F.substr(name, F.lit(2))), "utf-8"))
    digests = F.explode(F.split(F.rtrim(F.decode("bytes", "utf-8"), F.lit("\n")), "\n"))
    return got.select(source.alias("source"), digests.alias("digest")).withColumn("digest", F.nullif(F.col("digest"), F.lit("-" * 32)))


@query("SELECT 'sha256:' || md5(n_name) AS oid, CAST(n_nationkey AS BIGINT) AS size FROM nation")
def read_pointers(spark, d):
    """Pointers that stand in place of data, among files that are data."""
    path = folder(spark)
    for r in table(spark, d, "nation").select("n_nationkey", F.md5(F.col("n_name").cast("binary")).alias("md")).collect():
        put(spark, f"{path}/{r.n_nationkey}.jsonl", f"{readers.POINTER}v1\noid sha256:{r.md}\nsize {r.n_nationkey}\n".encode())
    put(spark, f"{path}/data.jsonl", b"{}\n")
    return readers.pointers(spark, path).select("oid", "size")


@query(
    """SELECT r_name || '_details' AS model, n_name AS task, 'acc' AS metric, CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey / 100 END AS value
    FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def read_cards(spark, d):
    """Results inside evaluation cards, one for each region."""
    path = folder(spark)
    names = {r.r_regionkey: r.r_name for r in table(spark, d, "region").collect()}
    for key, name in names.items():
        tasks = {r.n_name: {"acc": r.n_nationkey / 100 if r.n_nationkey % 5 else "N/A"} for r in nations(spark, d) if r.n_regionkey == key}
        card = f"---\na: b\n---\n# Card\n## Latest results\n\n```python\n{json.dumps({'all': tasks}, indent=4)}\n```\nend"
        put(spark, f"{path}/{name}_details/README.md", card.encode())
    return readers.read_cards(spark, f"{path}/*/README.md").toDF("model", "task", "metric", "value")


@query("SELECT substr(string_agg(n_name, ',' ORDER BY n_nationkey), 12, 40) AS part FROM nation")
def read_range(spark, d):
    """Forty bytes from the twelfth of a file."""
    path = put(spark, f"{folder(spark)}/names.txt", ",".join(r.n_name for r in nations(spark, d)).encode())
    return readers.read_byte_range(spark, path, 11, 40).select(F.decode("bytes", "utf-8").alias("part"))


@query("SELECT sha256(string_agg(n_name, ',' ORDER BY n_nationkey)) AS sha256 FROM nation")
def file_digest(spark, d):
    path = put(spark, f"{folder(spark)}/names.txt", ",".join(r.n_name for r in nations(spark, d)).encode())
    return readers.file_digests(spark, path).select("sha256")
