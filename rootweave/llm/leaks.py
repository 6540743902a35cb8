"""Passages of held-out items inside a corpus.

All items of a block form one generalised suffix automaton over words. A text streams through it once: after
every word the automaton knows the longest run of words, ending there, that is part of an item. A run of
``min_words`` or more names every item that holds it.

Items are spread over blocks of about BLOCK_WORDS words by a hash of their id. Tasks build the blocks' automata
and write them to the shared folder; a scan task reads the one it needs from there, so neither items nor automata
pass the driver, and a task holds one block, however many items there are. An item's matches depend on this item
alone, so results are the same for any number of blocks.
"""

from __future__ import annotations

import itertools
import math
import pickle
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
import regex
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rootweave.session import cut, new_place

BLOCK_WORDS = 200_000
# Characters dropped from texts, and letters that are words of their own.
_DROPPED = dict.fromkeys([0x200B, 0x200C, 0x200D, 0xFEFF, 0x00AD])
_SINGLE = r"\u3041-\u3096\u30a1-\u30fa\u3400-\u4dbf\u4e00-\u9fff"
_WORD = regex.compile(rf"[{_SINGLE}]|[[\p{{L}}\p{{N}}]--[{_SINGLE}]]+", regex.V1)
_PIECE = regex.compile(rf"[{_SINGLE}]\p{{M}}*|[^{_SINGLE}\s]+")


def words(text: str) -> list[str]:
    """Words of a text: characters dropped, NFKC, lower case, runs of letters and digits."""
    return _WORD.findall(unicodedata.normalize("NFKC", text.translate(_DROPPED)).lower())


class SuffixAutomaton:
    """Of several word sequences. ``items`` of a state: all items that hold its runs, if these have ``min_words``."""

    def __init__(self, sequences: list[tuple[int, list[str]]], min_words: int):
        self.min_words = min_words
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        ends: list[tuple[int, int]] = []
        for item, sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)))
                ends.append((last, item))
        found: dict[int, set[int]] = {}
        for state, item in ends:  # an item belongs to all suffixes of its prefixes
            while self.size[state] >= min_words and item not in found.setdefault(state, set()):
                found[state].add(item)
                state = self.link[state]
        self.items = {state: tuple(sorted(x)) for state, x in found.items()}
        self.shorter: dict[int, tuple[tuple[int, int], ...]] = {}

    def _shorter(self, state: int) -> tuple[tuple[int, int], ...]:
        """Items that hold only a shorter end of the state's runs, with the length of the longest one."""
        known = self.shorter.get(state)
        if known is None:
            seen, rest, at = set(self.items[state]), [], self.link[state]
            while self.size[at] >= self.min_words:
                rest += [(i, self.size[at]) for i in self.items[at] if i not in seen]
                seen.update(self.items[at])
                at = self.link[at]
            known = self.shorter[state] = tuple(rest)
        return known

    def _extend(self, last: int, word: int) -> int:
        follow, link, size = self.next, self.link, self.size
        there = follow[last].get(word)
        if there is not None and size[there] == size[last] + 1:
            return there

        def clone_of(state: int, parent: int) -> int:
            copy = len(size)
            follow.append(dict(follow[state]))
            link.append(link[state])
            size.append(size[parent] + 1)
            link[state] = copy
            at = parent
            while at >= 0 and follow[at].get(word) == state:
                follow[at][word] = copy
                at = link[at]
            return copy

        if there is not None:
            return clone_of(there, last)
        new = len(size)
        follow.append({})
        link.append(0)
        size.append(size[last] + 1)
        at = last
        while at >= 0 and word not in follow[at]:
            follow[at][word] = new
            at = link[at]
        if at >= 0:
            there = follow[at][word]
            link[new] = there if size[there] == size[at] + 1 else clone_of(there, at)
        return new

    def runs(self, text_words: list[str]) -> Iterator[tuple[int, int, int]]:
        """``end, length, state`` wherever the longest matching run has ``min_words`` or more; end is exclusive."""
        state = length = 0
        follow, link, size, least = self.next, self.link, self.size, self.min_words
        for end, word in enumerate(map(self.vocabulary.get, text_words), 1):
            if word is None:
                state = length = 0
                continue
            while state and word not in follow[state]:
                state = link[state]
                length = size[state]
            to = follow[state].get(word)
            if to is None:
                length = 0
                continue
            state, length = to, length + 1
            if length >= least:
                yield end, length, state

    def met(self, text_words: list[str]) -> dict[int, list[int]]:
        """Item -> longest run and number of places where a run of ``min_words`` of it ends."""
        found: dict[int, list[int]] = {}
        for _, length, state in self.runs(text_words):
            # The state may hold longer runs than this one, but the same items hold this one too.
            for item, longest in itertools.chain(zip(self.items[state], itertools.repeat(length)), self._shorter(state)):
                seen = found.setdefault(item, [0, 0])
                seen[0] = max(seen[0], longest)
                seen[1] += 1
        return found


def build_blocks(items: DataFrame, min_words: int, key: str, text: str) -> tuple[str, list[int]]:
    """Folder of the blocks' automata and the blocks' numbers. Items without id or text are left out; several rows
    of an id are parts of one item."""
    def split(batches):
        for batch in batches:
            found = [words(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.string())), pa.array(map(len, found), pa.int64())], names=["item_id", "words", "n"])

    picked = items.select(F.col(key).cast("bigint").alias("item_id"), F.col(text).alias("text")).where("item_id is not null and text is not null")
    tokens = cut(picked.mapInArrow(split, "item_id bigint, words array<string>, n bigint").where(F.col("n") >= min_words), "item-words")
    n_blocks = max(1, math.ceil((tokens.agg(F.sum("n").alias("n")).first()["n"] or 0) / BLOCK_WORDS))

    def build(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = [(i, w) for b in batches for i, w in zip(b.column("item_id").to_pylist(), b.column("words").to_pylist())]
        yield pa.record_batch([pa.array([group[0].as_py()], pa.int32()), pa.array([pickle.dumps(SuffixAutomaton(sequences, min_words))], pa.binary())], names=["block", "automaton"])

    numbered = tokens.select(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)).cast("int").alias("block"), "item_id", "words")
    place = new_place(items.sparkSession, "item-automata")
    numbered.groupBy("block").applyInArrow(build, "block int, automaton binary").write.partitionBy("block").parquet(place)
    return place, [r["block"] for r in numbered.select("block").distinct().collect()]


_held: dict[tuple[str, int], SuffixAutomaton] = {}


def _automaton(place: str, block: int) -> SuffixAutomaton:
    """A block's automaton; a Python worker holds one at a time, over all its tasks."""
    if (place, block) not in _held:
        _held.clear()
        files, path = FileSystem.from_uri(place)
        table = pq.read_table(f"{path}/block={block}", filesystem=files, columns=["automaton"])
        _held[place, block] = pickle.loads(table.column(0)[0].as_buffer())
    return _held[place, block]


def _scan(docs: DataFrame, place: str, block: int, look, schema: str) -> DataFrame:
    """``look(automaton, doc_id, text)`` gives the rows of a document; all documents stream past one block."""
    types = docs.sparkSession.createDataFrame([], schema)

    def run(batches):
        names = [f.name for f in arrow]
        for batch in batches:
            automaton = _automaton(place, block)
            out = [row for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for row in look(automaton, key, value)]
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], names=names)

    arrow = to_arrow_schema(types.schema)
    return docs.mapInArrow(run, schema)


def _picked(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text is not null")


def leaks(docs: DataFrame, items: DataFrame, min_words: int = 12, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """``doc_id, item_id, longest, hits``: every document and item that share ``min_words`` consecutive words;
    ``longest`` is their longest common run, ``hits`` the number of places where a shared run of ``min_words`` ends.

    Null, empty and short texts or items share nothing. Repeated documents come out repeatedly; repeated
    items once. The corpus is read once per block of items and never shuffled.
    """
    place, blocks = build_blocks(items, min_words, item, item_text)
    look = lambda automaton, key, value: [(key, i, *seen) for i, seen in automaton.met(words(value)).items()]
    schema = "doc_id bigint, item_id bigint, longest int, hits int"
    parts = [_scan(_picked(docs, doc, text), place, b, look, schema) for b in blocks]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def text_words(value: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words of a text with the span of the piece of text that each comes from."""
    found, spans = [], []
    for m in _PIECE.finditer(value):
        for w in words(m.group()):
            found.append(w)
            spans.append(m.span())
    return found, spans


def without(value: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; blanks that would meet white space at a seam go too."""
    kept, at = "", 0
    for a, b in [*spans, (len(value), len(value))]:
        part = value[at:max(at, a)]
        kept += part.lstrip(" \t") if at and kept[-1:].isspace() else part
        at = max(at, b)
    return kept


def scrub(docs: DataFrame, items: DataFrame, min_words: int = 12, drop_share: float = 0.5, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """``doc_id, n_words, n_leaked, dropped, clean_text`` for every document with a leak; rows of the same id and
    text come out once.

    Spans of ``min_words`` or more leaked words are cut out together with the marks attached to them; a
    document with more than ``drop_share`` of its words leaked is dropped (clean_text null). Every block of items
    sees the whole text; the spans that the blocks find in a document are united, and only documents with a leak
    move for that.
    """
    def look(automaton, key, value):
        found: list[list[int]] = []
        for end, length, _ in automaton.runs(text_words(value)[0]):
            if found and end - length <= found[-1][1]:
                found[-1] = [min(found[-1][0], end - length), end]
            else:
                found.append([end - length, end])
        return [(key, value, found)] if found else []

    def clean(batches):
        for batch in batches:
            out = []
            for key, value, found in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                tokens, spans = text_words(value)
                leaked = {i for a, b in found for i in range(a, b)}
                dropped = len(leaked) > drop_share * len(tokens)
                out.append((key, len(tokens), len(leaked), dropped, None if dropped else without(value, sorted({spans[i] for i in leaked}))))
            if out:
                types = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "n_words", "n_leaked", "dropped", "clean_text"])

    place, blocks = build_blocks(items, min_words, item, item_text)
    schema = "doc_id bigint, text string, spans array<array<int>>"
    parts = [_scan(_picked(docs, doc, text), place, b, look, schema) for b in blocks]
    found = reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)
    united = found.groupBy("doc_id", "text").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    return united.mapInArrow(clean, "doc_id bigint, n_words int, n_leaked int, dropped boolean, clean_text string")
