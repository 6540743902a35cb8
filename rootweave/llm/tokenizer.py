"""Byte-level BPE as a tokenization automaton.

Merges are compiled in rank order. The gadget of a merge u+v -> w does three things to the automaton over tokens:
it forks the state that arc u leads to and removes arc v there, it adds arc w wherever u then v could be read,
and lets arc w lead to a copy of the state v leads to. Arc w and that copy keep what held when the merge came,
so a gadget stores only its parts and its rank; an arc of the finished automaton is read off by following
these links (``arc``). Exactly one path of arcs spells any byte string: its tokenization.

Words are encoded by a deterministic automaton over bytes (``table``) that is compiled from these arcs. Its state
is the set of arcs that may be under way (the token before and the bytes read of the next one); since the path of
every prefix is unique, a state has one token that ends there. Encoding follows one transition per byte, and the
arc labels are read off backward. The transitions that spell the vocabulary are compiled before the tasks start;
the table is sparse, and a transition between tokens that never met is compiled when it is first taken.
"""

from __future__ import annotations

import base64
import itertools
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public tokenizer files lie, and how their texts are split into words.
FOLDER = os.environ.get("ROOTWEAVE_TOKENIZERS", "/opt/tokenizers")
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept with their ids by one Python worker, and states of the byte table; beyond these they start anew.
MEMO, STATES = 200_000, 2_000_000


def read_ranks(name: str = "byte_bpe_50k", folder: str = FOLDER) -> list[bytes]:
    """Tokens in the order of their ids, from ``name``.tiktoken."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Automaton:
    """Compiled from the tokens in rank order; picklable, its size is that of the vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.left, self.right = [-1] * len(tokens), [-1] * len(tokens)
        self.removed: dict[int, int] = {}  # arc v at the state of u (u << 20 | v) -> rank of the merge that took it
        self.step: dict[int, int] = {}  # byte transitions of the arc labels: node << 8 | byte -> node
        self.label: dict[int, int] = {}  # node -> token
        self.arcs: dict[int, bool] = {}
        for token, text in enumerate(tokens):
            if len(text) > 1:
                path = self._path(text)
                if len(path) != 2:
                    raise ValueError(f"token {token} is not one merge of earlier tokens")
                self.left[token], self.right[token] = path
                self.removed[path[0] << 20 | path[1]] = token
                self.arcs.clear()  # an arc may be gone now
            node = 0
            for b in text:
                node = self.step.setdefault(node << 8 | b, len(self.step) + 1)
            self.label[node] = token
        self.width = [len(text) for text in tokens]
        self._start()
        for text in tokens:
            self.spell(text)

    def _start(self) -> None:
        """An empty table: only the start state, before the first token."""
        self.table: dict[int, int] = {}  # state << 8 | byte -> state
        self.ends: list[int] = [-1]  # the token that ends at a state
        self.under_way: list[tuple[tuple[int, int], ...]] = [((-1, 0),)]  # its (token before, node of the next)
        self.numbers = {self.under_way[0]: 0}

    def _compile(self, state: int, byte: int) -> int:
        """The transition of a state by a byte."""
        ways, ended = [], -1
        for before, node in self.under_way[state]:
            node = self.step.get(node << 8 | byte)
            if node is not None:
                ways.append((before, node))
                token = self.label.get(node)
                if token is not None and ended < 0 and (before < 0 or self.arc(before, token)):
                    ended = token
        key = (*ways, (ended, 0))
        to = self.numbers.get(key)
        if to is None:
            to = self.numbers[key] = len(self.ends)
            self.ends.append(ended)
            self.under_way.append(key)
        self.table[state << 8 | byte] = to
        return to

    def arc(self, u: int, v: int) -> bool:
        """May token v follow token u?"""
        known = self.arcs.get(u << 20 | v)
        if known is None:
            known = self.arcs[u << 20 | v] = self._arc(u, v)
            if len(self.arcs) > 4 * MEMO:
                self.arcs.clear()
        return known

    def _arc(self, u: int, v: int) -> bool:
        """Follow the gadgets back: the boundary between u and v must outlast every merge before ``until``.

        The later of the two tokens stands for its gadget: before that merge its inner part met the other
        token. Equal merges go left to right, so a right part must also outlast the merge that made it, and a
        token met by itself was made on both sides at once.
        """
        until, removed, left, right = 1 << 30, self.removed, self.left, self.right
        while removed.get(u << 20 | v, until) >= until:
            made_u, made_v = u if left[u] >= 0 else -1, v if left[v] >= 0 else -1
            if made_u == made_v:
                if made_u < 0:
                    return True
                until, u, v = made_u, right[u], left[v]
            elif made_u > made_v:
                until, u = made_u, right[u]
            else:
                until, v = made_v + 1, left[v]
        return False

    def _path(self, text: bytes) -> list[int]:
        """The tokens of ``text`` under the merges so far, while the gadgets are built: arcs forward, labels backward."""
        n, step, label, arc = len(text), self.step, self.label, self.arc
        last, came = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            node = 0
            for k in range(i, n):
                node = step.get(node << 8 | text[k])
                if node is None:
                    break
                token = label.get(node)
                if token is not None and last[k + 1] < 0 and (not i or arc(last[i], token)):
                    last[k + 1], came[k + 1] = token, i
        path, at = [], n
        while at:
            path.append(last[at])
            at = came[at]
        return path[::-1]

    def spell(self, text: bytes) -> list[int]:
        """The tokens of the one accepted path for ``text``: one transition per byte, then the labels from the end."""
        if len(self.ends) > STATES:
            self._start()
        table, state, states = self.table, 0, []
        for byte in text:
            to = table.get(state << 8 | byte)
            state = self._compile(state, byte) if to is None else to
            states.append(state)
        path, at = [], len(text)
        while at:
            token = self.ends[states[at - 1]]
            path.append(token)
            at -= self.width[token]
        return path[::-1]

    def __getstate__(self):
        return self.__dict__ | {"arcs": {}}


class Memo(dict):
    """Words with their ids; a missing word is spelled by the automaton."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> list[int]:
        ids = self.automaton.spell(word.encode())
        if len(word) <= 64:
            self[word] = ids
        return ids


_workers: dict = {}


def _memo(shared) -> Memo:
    """One memo for each vocabulary and Python worker, over all its tasks."""
    key = shared.value[0]
    if key not in _workers or len(_workers[key]) > MEMO:
        _workers[key] = Memo(shared.value[1])
    return _workers[key]


def share(spark, name: str = "byte_bpe_50k", folder: str = FOLDER):
    """The compiled automaton as a broadcast; a vocabulary over a million tokens is refused."""
    tokens = read_ranks(name, folder)
    if len(tokens) > 1_000_000:
        raise ValueError("vocabulary too large to broadcast")
    return spark.sparkContext.broadcast((f"{folder}/{name}", Automaton(tokens)))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row. Null and empty texts have an empty list; special tokens
    are neither added nor recognised. Repeated rows come out repeatedly. No shuffle; whole texts."""
    shared, pattern = share(docs.sparkSession, name, folder), WORDS

    def run(batches):
        find = regex.compile(pattern).findall
        for batch in batches:
            memo, flat, ends = _memo(shared), [], [0]
            for value in batch.column(1).to_pylist():
                if value:
                    flat.extend(itertools.chain.from_iterable(map(memo.__getitem__, find(value))))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.record_batch([batch.column(0), ids], names=[key, "ids"])

    picked = docs.select(F.col(key), F.col(text).alias("text"))
    return picked.mapInArrow(run, f"`{key}` {picked.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """``key, text``: the labels of the arcs in turn. Bytes that are no UTF-8 become U+FFFD; a null list is ''."""
    shared = share(encoded.sparkSession, name, folder)

    def run(batches):
        labels = np.array(shared.value[1].tokens, dtype=object)
        for batch in batches:
            out = [b"".join(labels[x]).decode(errors="replace") if x else "" for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=[key, "text"])

    picked = encoded.select(F.col(key), F.col(ids).alias("ids"))
    return picked.mapInArrow(run, f"`{key}` {picked.schema[0].dataType.simpleString()}, text string")
