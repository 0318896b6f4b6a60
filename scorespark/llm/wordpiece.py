"""Token counts by a linear longest-match automaton.

Greedy word-piece segmentation takes, again and again, the longest vocabulary entry that
a word's rest starts with. The automaton is a trie over the entries (those that begin
a word below one root, those that continue one below another) with, for each node,
a failure link and the number of pieces that following the link completes. Reading
a word byte by byte, each failure adds its number to the count; no piece is ever built,
and the work is linear in the word's length.

For node v with string s: if s is itself an entry, one piece is popped and the link
goes to the continuation root; otherwise the link comes from the parent u by following
u's link (and the links from there) until a child for v's last byte is found, adding up
popped pieces; without one, v has no link and a word that fails there is unknown (one
token).

Defined cases: null and empty texts count 0; a word with bytes that no entry begins
with is one unknown token; repeated rows count alike, ids may be null; very long texts and words
are read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cache, table, texts_of
from .tokens import BYTE_BPE, _byte_table, tokenizer_path

INITIAL, CONTINUE = 0, 1


class LongestMatch:
    def __init__(self, initial: set[bytes], continuing: set[bytes]):
        """initial: entries that begin a word; continuing: entries that go on in one."""
        self.child: list[dict[int, int]] = [{}, {}]
        parent, letter, whole = [-1, -1], [0, 0], [False, False]
        for root, entries in ((INITIAL, initial), (CONTINUE, continuing)):
            for e in sorted(entries):
                v = root
                for c in e:
                    if c not in self.child[v]:
                        self.child[v][c] = len(parent)
                        self.child.append({})
                        parent.append(v)
                        letter.append(c)
                        whole.append(False)
                    v = self.child[v][c]
                if e:
                    whole[v] = True
        n = len(parent)
        self.link, self.popped = [-1] * n, [0] * n
        level = [v for root in (INITIAL, CONTINUE) for v in self.child[root].values()]
        while level:
            for v in level:
                if whole[v]:
                    self.link[v], self.popped[v] = CONTINUE, 1
                    continue
                u, pops = parent[v], 0
                z, pops = self.link[u], self.popped[u]
                while z >= 0 and letter[v] not in self.child[z]:
                    pops += self.popped[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[v], self.popped[v] = self.child[z][letter[v]], pops
            level = [w for v in level for w in self.child[v].values()]

    def count(self, word: bytes) -> int:
        """Pieces of the word; -1 if it is unknown. An empty word has none."""
        v, n = INITIAL, 0
        for c in word:
            while c not in self.child[v]:
                if self.link[v] < 0:
                    return -1
                n += self.popped[v]
                v = self.link[v]
            v = self.child[v][c]
        while v not in (INITIAL, CONTINUE):  # what is left is to be popped at the end
            if self.link[v] < 0:
                return -1
            n += self.popped[v]
            v = self.link[v]
        return n


def vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """Word-piece entries from a byte-level vocabulary file: what begins with the space
    mark begins a word, the rest continues one."""
    back = {ord(c): b for b, c in _byte_table().items()}
    initial, continuing = set(), set()
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    for token in entries:
        if all(ord(c) in back for c in token):
            raw = bytes(back[ord(c)] for c in token)
            (initial if raw[:1] == b" " else continuing).add(raw[1:] if raw[:1] == b" " else raw)
    return initial - {b""}, continuing


_built: dict[str, LongestMatch] = {}


def automaton(path: str) -> LongestMatch:
    if path not in _built:
        _built[path] = LongestMatch(*vocabulary(path))
    return _built[path]


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words (white space apart), n_tokens (pieces, unknown words as one each),
    n_unknown, of each whole text. The automaton is built once in each worker from
    the vocabulary file; word counts are cached, the cache is bounded."""
    path = path or tokenizer_path(BYTE_BPE)
    flat = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        auto = automaton(path)
        cache = Cache(auto.count, 400_000)
        for b in batches:
            rows = []
            for t in texts_of(b):
                counts = list(map(cache.__getitem__, t.encode("utf-8", "replace").split()))
                bad = counts.count(-1)
                rows.append((len(counts), sum(counts) + 2 * bad, bad))
                cache.trim()
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([r[j] for r in rows], pa.int64()) for j in range(3))], names=["id", "n_words", "n_tokens", "n_unknown"])

    kind = dict(flat.dtypes)["id"]
    return flat.mapInArrow(run, f"id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint").withColumnRenamed("id", id_col)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
