"""Fill-in-the-middle transformation by lines, with an exact way back.

A pre-tokenizer of the tokenizers library splits a text into isolated matches
of the unit's pattern and gives their code-point offsets; nothing is trained.
The number of offsets is the number of units, and the offsets at two drawn
ranks cut the text into prefix, middle and suffix.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import fold, lean


@dataclass(frozen=True)
class FillInMiddle:
    """``rate`` and ``spm`` are percentages: of documents that are rearranged, and of those that start with the suffix."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = r"[^\n]*\n|[^\n]+"

    def __post_init__(self):
        marks = self.marks
        if len(set(marks)) < 3 or not all(marks) or any(m[0] in x[1:] for m in marks for x in marks):
            raise ValueError("marks must differ, and none may begin inside another")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def arrange(text: str, ends: np.ndarray, draws: list[int], p: FillInMiddle) -> tuple[str, int | None, int | None, str]:
    """form, prefix_chars, middle_chars and output of a text whose units end at ``ends`` (code points)."""
    if not text or any(m in text for m in p.marks) or draws[2] % 100 >= p.rate:
        return "plain", None, None, text
    cuts = np.concatenate(([0], ends))
    low, high = sorted(d % len(cuts) for d in draws[:2])
    a, b = int(cuts[low]), int(cuts[high])
    before, inner, after = p.prefix + text[:a], p.middle + text[a:b], p.suffix + text[b:]
    if draws[3] % 100 < p.spm:
        return "spm", a, b - a, after + before + inner
    return "psm", a, b - a, before + after + inner


def restore(output: str, form: str, p: FillInMiddle) -> str:
    """The text that ``arrange`` had; no mark stands inside its parts, so the first of each mark is the mark itself."""
    if form == "plain":
        return output
    inner = output.index(p.middle)
    at_prefix, at_suffix = output.index(p.prefix), output.index(p.suffix)
    before = output[at_prefix + len(p.prefix) : at_suffix if at_suffix > at_prefix else inner]
    after = output[at_suffix + len(p.suffix) : at_prefix if at_prefix > at_suffix else inner]
    return before + output[inner + len(p.middle) :] + after


_splitters: dict = {}


def splitter(p: FillInMiddle, name: str):
    """The unit's pre-tokenizer, made once a worker."""
    if name not in _splitters:
        from tokenizers import Regex, pre_tokenizers

        _splitters.clear()
        _splitters[name] = pre_tokenizers.Split(Regex(p.unit), "isolated")
    return _splitters[name]


def in_parts(rows, chars: int = 1 << 21):
    """Lists of rows whose texts (last field) hold about so many characters; a longer text is a list of its own."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[-1])
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def fill_in_middle(docs: DataFrame, p: FillInMiddle = FillInMiddle()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row.

    Draws depend on ``seed`` and doc_id only; a null id is drawn like an empty
    one, and repeated rows give repeated results. Null texts are empty; an empty
    text, one that holds a mark, and one beyond ``rate`` are plain and have null
    counts. Long texts are cut like others, one text at a time; extra columns are
    left out. A table without rows gives none.
    """
    name = uuid.uuid4().hex
    key = F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))

    @lean
    def run(batches):
        import pyarrow as pa

        units = splitter(p, name).pre_tokenize_str
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

        def rows(b):
            for i, digest, text in zip(b.column("doc_id"), b.column("digest"), b.column("text"), strict=True):
                text, digest = text.as_py() or "", digest.as_py()
                ends = np.array([span[1] for _, span in units(text)], np.int64)
                yield i.as_py(), len(ends), *arrange(text, ends, [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)], p)

        for b in batches:
            for part in in_parts(rows(b)):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part, strict=True), kinds, strict=True)], names)

    rows = fold(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(key.cast("binary"), 256).alias("digest"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(arranged: DataFrame, p: FillInMiddle = FillInMiddle()) -> DataFrame:
    """The rows of ``fill_in_middle`` with ``restored``, the text rebuilt from output and form alone."""

    @lean
    def run(batches):
        import pyarrow as pa

        for b in batches:
            at = 0
            for part in in_parts((form.as_py(), text.as_py()) for form, text in zip(b.column("form"), b.column("output"), strict=True)):
                own = b.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([restore(text, form, p) for form, text in part], pa.string())], [*b.schema.names, "restored"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in arranged.schema.fields)
    return arranged.mapInArrow(run, f"{kind}, restored string")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restored(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


OP13_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, text, units, len(units) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS c2,
         CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 AS suffix_first,
         text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 AS plain
  FROM units
), parts AS (
  SELECT doc_id, text, n, CASE WHEN plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:least(c1, c2)], '') AS pre, array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS mid,
         array_to_string(units[greatest(c1, c2) + 1:], '') AS suf
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
ORACLES = {"op13_fill_in_middle": OP13_SQL}
