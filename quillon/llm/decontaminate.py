"""Benchmark decontamination by a generalised suffix automaton of the test items."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._shared import Scratch, pieces

#: A match of MAX_WORDS words, or one of MIN_WORDS that is COVERAGE of a test item, is removed.
MAX_WORDS, MIN_WORDS, COVERAGE = 13, 8, 0.5
#: Words in one automaton, which bounds what is broadcast and what a worker holds (about 1 kB a word);
#: more test items make more automata, each with a pass of its own over the documents.
SHARD_WORDS = 200_000


@dataclass
class Automaton:
    """Suffix automaton of several word sequences.

    ``next[s]`` maps a word's number to a state, ``link[s]`` is the suffix
    link, ``length[s]`` the longest string of s, and ``item[s]`` the length of
    the shortest item that contains it. ``vocabulary`` are the sorted hashes;
    a word's number is its place there.
    """

    vocabulary: np.ndarray
    next: list[dict[int, int]]
    link: list[int]
    length: list[int]
    item: list[int]

    @classmethod
    def of(cls, items: list[np.ndarray]) -> Automaton:
        vocabulary = np.unique(np.concatenate(items)) if items else np.zeros(0, np.uint64)
        nxt: list[dict[int, int]] = [{}]
        link, length, item = [-1], [0], [1 << 30]
        for words in items:
            last, size = 0, len(words)
            for c in np.searchsorted(vocabulary, words).tolist():
                have = nxt[last].get(c)
                if have is not None:
                    if length[have] == length[last] + 1:
                        last = have
                    else:
                        last = cls._clone(nxt, link, length, item, last, have, c)
                else:
                    cur = len(nxt)
                    nxt.append({})
                    link.append(0)
                    length.append(length[last] + 1)
                    item.append(1 << 30)
                    p = last
                    while p != -1 and c not in nxt[p]:
                        nxt[p][c] = cur
                        p = link[p]
                    if p != -1:
                        q = nxt[p][c]
                        link[cur] = q if length[q] == length[p] + 1 else cls._clone(nxt, link, length, item, p, q, c)
                    last = cur
                item[last] = min(item[last], size)
        for s in sorted(range(1, len(nxt)), key=lambda s: -length[s]):
            item[link[s]] = min(item[link[s]], item[s])
        return cls(vocabulary, nxt, link, length, item)

    @staticmethod
    def _clone(nxt: list, link: list, length: list, item: list, p: int, q: int, c: int) -> int:
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        item.append(item[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def covering(self, min_words: int, coverage: float) -> list[int]:
        """For each state, the length of the longest of its suffix links' strings, its own first, that covers enough of an item; 0 if none does."""
        out = [0] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            n = self.length[s]
            out[s] = n if n >= min_words and n >= coverage * self.item[s] else out[self.link[s]]
        return out

    def longest(self, words: list[int], covering: list[int], max_words: int, min_words: int, coverage: float) -> tuple[list[int], list[int]]:
        """For each word, the length of the longest match that ends there, and of the longest that is to be removed."""
        nxt, link, length, item = self.next, self.link, self.length, self.item
        state, size, sizes, removed = 0, 0, [], []
        for c in words:
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(c)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            sizes.append(size)
            if size >= max_words or (size >= min_words and size >= coverage * item[state]):
                removed.append(size)
            else:
                # a shorter match may cover a shorter item that stands inside the longer one
                removed.append(covering[link[state]] if state else 0)
        return sizes, removed


def _longest(automaton: Automaton, covering: list[int], words: _text.Words, max_words: int, min_words: int, coverage: float) -> tuple[np.ndarray, np.ndarray]:
    """The longest matches at all words of a batch, where they reach the least length (else 0), and the longest to be removed.

    Only stretches of at least as many known words are walked: no shorter one
    can hold such a match.
    """
    n, least = len(words.hashes), min(max_words, min_words)
    sizes, removed = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
    if not n or not len(automaton.vocabulary):
        return sizes, removed
    number = np.searchsorted(automaton.vocabulary, words.hashes)
    number[number == len(automaton.vocabulary)] = 0
    inside = np.concatenate([[False], automaton.vocabulary[number] == words.hashes, [False]])
    first = np.zeros(n + 1, dtype=bool)
    first[words.first] = True
    rise = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    fall = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    long = fall - rise >= least
    for s, e in zip(rise[long].tolist(), fall[long].tolist(), strict=True):
        got, out = automaton.longest(number[s:e].tolist(), covering, max_words, min_words, coverage)
        if max(got) >= least:
            sizes[s:e], removed[s:e] = got, out
    small = sizes < least
    sizes[small] = 0
    return sizes, removed


def scanned(w: _text.Words, automaton: Automaton, covering: list[int], max_words: int, min_words: int, coverage: float) -> tuple[np.ndarray, np.ndarray]:
    """(longest match of each text, whether each word is to be removed)."""
    n, docs = len(w.hashes), len(w.first) - 1
    sizes, cut = _longest(automaton, covering, w, max_words, min_words, coverage)
    gone = np.zeros(n + 1, dtype=np.int32)
    out = np.flatnonzero(cut)
    np.add.at(gone, out + 1 - cut[out], 1)
    np.add.at(gone, out + 1, -1)
    longest = np.zeros(docs, dtype=np.int32)
    hit = np.flatnonzero(sizes)
    np.maximum.at(longest, np.searchsorted(w.first, hit, side="right") - 1, sizes[hit])
    return longest, np.cumsum(gone[:-1]) > 0


def _edges(w: _text.Words, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the runs of words that are gone, within texts."""
    at = np.flatnonzero(gone)
    if not len(at):
        return at, at, at
    doc = np.searchsorted(w.first, at, side="right") - 1
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) > 1) | (np.diff(doc) > 0)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(at)) - 1
    base = w.first[doc[head]]
    return doc[head], at[head] - base, at[last] + 1 - base


def _cleaned(column: pa.Array, w: _text.Words, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts without the runs of words."""
    if not len(doc):
        return column.cast(pa.string())
    base, data = _text.utf8(column)
    texts = column.to_pylist()
    for d in np.unique(doc).tolist():
        raw, at, parts = data[base[d] : base[d + 1]].tobytes(), 0, []
        for i in np.flatnonzero(doc == d).tolist():
            parts.append(raw[at : w.starts[w.first[d] + start[i]] - base[d]])
            at = int(w.ends[w.first[d] + end[i] - 1] - base[d])
        texts[d] = b"".join([*parts, raw[at:]]).decode()
    return pa.array(texts, pa.string())


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _spans(docs: int, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    offsets = np.searchsorted(doc, np.arange(docs + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (start, end)], names=["start", "end"]))


def automata_of(benchmark: DataFrame, min_words: int = MIN_WORDS, shard_words: int = SHARD_WORDS) -> Iterator[Automaton]:
    """Automata of all items of at least min_words words, shard_words words in each, one after the other."""
    items, size = [], 0
    for row in benchmark.select("text").where("text is not null").orderBy("text").toLocalIterator():
        h = _text.words(pa.array([row["text"]], pa.string())).hashes
        if len(h) < min_words:
            continue
        if size and size + len(h) > shard_words:
            yield Automaton.of(items)
            items, size = [], 0
        items.append(h)
        size += len(h)
    yield Automaton.of(items)


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS, min_words: int = MIN_WORDS, coverage: float = COVERAGE, keep: tuple[str, ...] = ("doc_id",), shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs without what they share with the test items.

    Each document's words are streamed through the automaton of the items. A
    match of at least ``max_words`` words is removed, and so is one of at least
    ``min_words`` that makes up ``coverage`` of an item it stands in; overlapping
    matches are one span. From the first to the last word of a span, the text is
    cut; the rest is unchanged.

    Returns the columns ``keep`` of docs, then longest_match (words; 0 where it is
    under min_words), removed_words, spans (word positions), contaminated and
    text, the clean text; a column of docs of one of these names is replaced.
    Items of fewer than ``min_words`` words can't be told from chance and are
    ignored, as are null items; without items nothing is removed. Null texts stay
    null and empty ones empty; texts of any length are scanned whole. Each row is
    handled by itself, so repeated rows, ties and null ids need no rule; an empty
    table stays empty. Items of more than ``shard_words`` words together are
    scanned in passes, between which the documents are written.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "leaks")
    made = ("longest_match", "removed_words", "spans", "contaminated", "text")
    kept = [c for c in keep if c.lower() not in made]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col("text").cast("string").alias("q_text"), F.lit(0).alias("q_longest"), F.array().cast("array<struct<start:int,end:int>>").alias("q_spans"))
    own = ", ".join([*(f"k{i} {dict(docs.dtypes)[c]}" for i, c in enumerate(kept)), "q_text string, q_longest int, q_spans array<struct<start:int,end:int>>"])

    def scan(automaton, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "q_text"):
                w = _text.words(batch.column("q_text"))
                longest, gone = scanned(w, *automaton.value, max_words, min_words, coverage)
                before = batch.column("q_spans")
                if len(flat := before.flatten()):
                    at = np.repeat(w.first[:-1], np.diff(np.asarray(before.offsets)))
                    for s, e in zip((at + np.asarray(flat.field("start"))).tolist(), (at + np.asarray(flat.field("end"))).tolist(), strict=True):
                        gone[s:e] = True
                longest = np.maximum(longest, np.asarray(batch.column("q_longest")))
                doc, start, end = _edges(w, gone)
                text = _cleaned(batch.column("q_text"), w, doc, start, end) if last else batch.column("q_text")
                rest = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name[0] == "k"]
                out = [*rest, text, pa.array(longest), _spans(batch.num_rows, doc, start, end)]
                yield pa.record_batch(out, names=[*batch.schema.names[: len(rest)], "q_text", "q_longest", "q_spans"])

        return run

    n, waiting = 0, None
    for automaton in automata_of(benchmark, min_words, shard_words):
        if waiting is not None:
            rows = scratch.table(rows.mapInArrow(scan(waiting, False), own), f"pass{n}")
            waiting.unpersist()
            if n:
                scratch.drop(f"pass{n - 1}")
            n += 1
        waiting = spark.sparkContext.broadcast((automaton, automaton.covering(min_words, coverage)))
    out = rows.mapInArrow(scan(waiting, True), own)
    removed = F.aggregate("q_spans", F.lit(0), lambda s, x: s + x["end"] - x["start"])
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], F.col("q_longest").alias("longest_match"), removed.alias("removed_words"), F.col("q_spans").alias("spans"), (F.size("q_spans") > 0).alias("contaminated"), F.col("q_text").alias("text"))
