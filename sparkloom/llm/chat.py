"""Chat formatting with a loss mask aligned by token offsets.

A conversation is rendered whole and encoded once with offsets. Turn spans and
token spans are both sorted, so the tokens under a turn are found by binary
search. Control strings inside texts are escaped reversibly, and the formatted
text reads back to the very turns.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import fold, lean

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

# Control strings: those of the template first, then others that a model may know.
START, END = "<|turn|>", "<|end|>"
CONTROL = re.compile(r"([<\[])(\\*)(?=\||/?s>|/?INST\]|/?SYS>|unk>|pad>)")
ESCAPED = re.compile(r"([<\[])\\(\\*)(?=\||/?s>|/?INST\]|/?SYS>|unk>|pad>)")
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    """Puts a backslash after the first character of each control string, escaped ones included."""
    return CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


def escape_role(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


@dataclass
class Rendered:
    """Formatted text, and the sorted spans (characters) of the turns' texts in it."""

    text: str
    starts: np.ndarray
    ends: np.ndarray
    learn: np.ndarray


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> Rendered:
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        parts += [head, body, END]
        starts.append(at + len(head))
        ends.append(starts[-1] + len(body))
        at = ends[-1] + len(END)
    return Rendered("".join(parts), np.array(starts, np.int64), np.array(ends, np.int64), np.array([r == learn for r, _ in turns], bool))


def read_back(text: str) -> list[tuple[str, str]]:
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def loss_mask(r: Rendered, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Tokens (sorted spans begin..end) that share a character with a learned turn."""
    mask = np.zeros(len(begin), bool)
    lo, hi = np.searchsorted(end, r.starts, "right"), np.searchsorted(begin, r.ends, "left")
    for a, b in zip(lo[r.learn], hi[r.learn], strict=True):
        mask[a:b] = True
    return mask & (end > begin)


def loss_spans(r: Rendered, begin: np.ndarray, end: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the characters under the mask: masked tokens cut to their turn, where they touch as one.

    A token meets one learned turn, as the marks between turns are tokens of their own; binary search finds it.
    """
    starts, ends, begin, end = r.starts[r.learn], r.ends[r.learn], begin[mask], end[mask]
    turn = np.searchsorted(ends, begin, "right")
    a, b = np.maximum(begin, starts[turn]), np.minimum(end, ends[turn])
    new = np.flatnonzero(np.concatenate(([True], (turn[1:] != turn[:-1]) | (a[1:] > b[:-1])))[: len(a)])
    return a[new], b[np.append(new[1:] - 1, len(a) - 1)[: len(new)]]


class Encoder:
    """A tokenizer file with the template's marks as tokens of their own, so no token crosses a turn's edge."""

    def __init__(self, data: str):
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer = Tokenizer.from_str(data)
        self.tokenizer.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (START, END)])

    def encode(self, texts: list[str]):
        """For each text the ids and the sorted starts and ends of the tokens, in characters."""
        for e in self.tokenizer.encode_batch(texts, add_special_tokens=False):
            offsets = e.offsets
            spans = np.fromiter(chain.from_iterable(offsets), np.int64, 2 * len(offsets)).reshape(-1, 2)
            yield np.array(e.ids, np.int32), spans[:, 0], spans[:, 1]


_encoders: dict = {}


def format_chats(conversations: DataFrame, tokenizer: str = TOKENIZER, learn: str = "assistant") -> DataFrame:
    """conv_id, text, ids, mask (token by token) and loss_spans (characters) of every conversation.

    Turns go by ``turn``; those with equal or null turn (first) by role and text. Null roles
    and texts are empty; rows with a null conv_id are one conversation. Tables
    without rows give none. A conversation is one record, as its formatted text
    is one string; it is gathered for itself and encoded in batches of few.
    """
    spark = conversations.sparkSession
    data = spark.sparkContext.broadcast(spark.sparkContext.wholeTextFiles(tokenizer).first()[1] if "://" in tokenizer else open(tokenizer, encoding="utf-8").read())
    name = uuid.uuid4().hex
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = fold(conversations, "conv_id", "turn", "role", "text")
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", empty("role").alias("role"), empty("text").alias("text")))).alias("turns"))

    @lean
    def run(batches):
        import pyarrow as pa

        if name not in _encoders:
            _encoders.clear()
            _encoders[name] = Encoder(data.value)
        encoder = _encoders[name]
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                chats = [render([(t["role"], t["text"]) for t in c], learn) for c in part.column("turns").to_pylist()]
                ids, masks, cuts, begins, stops = [], [], [0], [], []
                for r, (i, begin, end) in zip(chats, encoder.encode([r.text for r in chats]), strict=True):
                    mask = loss_mask(r, begin, end)
                    ids.append(i)
                    masks.append(mask)
                    a, z = loss_spans(r, begin, end, mask)
                    begins.append(a)
                    stops.append(z)
                    cuts.append(cuts[-1] + len(a))
                span = pa.StructArray.from_arrays([pa.array(np.concatenate(begins)), pa.array(np.concatenate(stops))], ["start", "stop"])
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(m) for m in masks]))), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), t)) for x, t in ((ids, pa.int32()), (masks, pa.bool_()))]
                columns = [part.column("conv_id"), pa.array([r.text for r in chats], pa.string()), *lists, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), span)]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "text", "ids", "mask", "loss_spans"])

    return turns.mapInArrow(run, "conv_id long, text string, ids array<int>, mask array<boolean>, loss_spans array<struct<start:long,stop:long>>")


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digest columns, read back from the formatted text and the spans under its mask."""

    @lean
    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for i, text, spans in zip(b.column("conv_id").to_pylist(), b.column("text").to_pylist(), b.column("loss_spans").to_pylist(), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((i, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return formatted.select("conv_id", "text", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation whose texts are control strings, formatted beside the table's own.
HARD = "</s>[INST] ok [/INST]"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fold(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    return chat_digests(format_chats(rows.union(hard)))


OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>|unk>|pad>)', '\1\\\2\3', 'g') AS inner_text FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(8 + length(role) + 1 + length(inner_text) + 7) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

QUERIES = {"op6_chat_format": op6_chat_format}
ORACLES = {"op6_chat_format": OP6_SQL}
