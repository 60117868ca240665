"""Greedy word-piece token counts by a linear longest-match automaton.

A trie of the vocabulary has failure links as in Aho-Corasick, and each node
holds how many pieces are popped when its link is followed. A word's length in
greedy longest-match-first pieces then takes one pass over its characters, and
no piece is built.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import fold, lean
from sparkloom.llm.pieces import MARK, PIECE_MODEL, load_pieces

#: Words are runs of letters, digits and marks; any other visible character is a word of its own.
WORD = re.compile(r"\w+|[^\w\s]")


class Automaton:
    """``first``: pieces that begin a word; ``rest``: pieces that go on inside one."""

    def __init__(self, first, rest):
        self.go: list[dict] = [{}, {}]  # 0 begins a word, 1 goes on in it
        ends = [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                v = root
                for c in piece:
                    if c not in self.go[v]:
                        self.go[v][c] = len(self.go)
                        self.go.append({})
                        ends.append(False)
                    v = self.go[v][c]
                ends[v] = v > 1
        self.link = [-1] * len(self.go)
        self.pops = [0] * len(self.go)
        queue = [0, 1]
        for v in queue:
            for c, w in self.go[v].items():
                queue.append(w)
                if ends[w]:
                    self.link[w], self.pops[w] = 1, 1
                    continue
                z, popped = self.link[v], self.pops[v]
                while z >= 0 and c not in self.go[z]:
                    popped += self.pops[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[w], self.pops[w] = self.go[z][c], popped

    def count(self, word: str) -> int:
        """Pieces of the word; -1 if greedy matching gets stuck, so that the word is unknown."""
        go, link, pops, v, n = self.go, self.link, self.pops, 0, 0
        for c in word:
            while c not in go[v]:
                n += pops[v]
                v = link[v]
                if v < 0:
                    return -1
            v = go[v][c]
        while v > 1:
            n += pops[v]
            v = link[v]
        return n if v == 1 or not word else -1


class Counts(dict):
    """Counts of the words met so far; ``limit`` bounds memory, as a full table starts again."""

    def __init__(self, automaton: Automaton, limit: int = 1 << 19):
        super().__init__()
        self.automaton, self.limit = automaton, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        n = self.automaton.count(word)
        if len(word) <= 64:
            self[word] = n
        return n


def from_pieces(path: str = PIECE_MODEL) -> tuple[list[str], list[str]]:
    """Pieces with the word mark begin words, those without it go on inside them."""
    p = load_pieces(path)
    names = [t for i, t in enumerate(p.text) if i not in p.special]
    return [t[1:] for t in names if t[:1] == MARK and t.strip(MARK)], [t for t in names if MARK not in t]


_counts: dict = {}


def token_counts(docs: DataFrame, first, rest) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for every row; an unknown word is one token.

    Null and empty texts count 0; repeated rows and null ids are counted like any others. An empty table gives no rows.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast((first, rest))  # as large as the vocabulary file
    name = uuid.uuid4().hex

    @lean
    def run(batches):
        import pyarrow as pa

        if name not in _counts:
            _counts.clear()
            _counts[name] = Counts(Automaton(*vocabulary.value))
        get, find = _counts[name].__getitem__, WORD.findall
        for b in batches:
            words, tokens, unknown = [], [], []
            for text in b.column("text"):
                got = [get(w) for w in find(text.as_py() or "")]
                miss = got.count(-1)
                words.append(len(got))
                tokens.append(sum(got) + 2 * miss)
                unknown.append(miss)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return fold(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), *from_pieces())


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLES = {}
