"""Benchmark decontamination with a generalised suffix automaton over words."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import bound_batches, per_batch, utf8

WINDOW = 13
#: Bytes other than digits, letters and those above 0x7F become spaces; A-Z become lower case.
NORMAL = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(NORMAL).split()


class Automaton:
    """Generalised suffix automaton of word sequences.

    A state is a set of end positions; ``items`` of a state holds the sequences in
    which its strings occur. Streaming a text keeps the longest suffix that occurs in
    some sequence; a match of ``window`` or more words covers all of its words.
    """

    def __init__(self, sequences: dict[object, list[bytes]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set] = [set()]
        self.short: dict[int, list] = {}
        self.least = window
        named = []
        for name, words in sequences.items():
            if words:
                tokens = [self.ids.setdefault(w, len(self.ids)) for w in words]
                named.append((name, tokens))
                self.least = min(self.least, len(tokens))
                last = 0
                for t in tokens:
                    last = self._extend(last, t)
        for name, tokens in named:
            state = 0
            for t in tokens:
                state, up = self.next[state][t], self.next[state][t]
                while up > 0 and name not in self.items[up]:
                    self.items[up].add(name)
                    up = self.link[up]
            if len(tokens) < window:
                self.short.setdefault(state, []).append((len(tokens), name))
        self._settle()

    def _extend(self, last: int, t: int) -> int:
        if t in self.next[last]:
            to = self.next[last][t]
            return to if self.length[to] == self.length[last] + 1 else self._clone(last, t, to)
        new = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            to = self.next[p][t]
            self.link[new] = to if self.length[to] == self.length[p] + 1 else self._clone(p, t, to)
        return new

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.items.append(set())
        return len(self.next) - 1

    def _clone(self, p: int, t: int, to: int) -> int:
        new = self._state(self.length[p] + 1)
        self.next[new] = dict(self.next[to])
        self.link[new], self.link[to] = self.link[to], new
        while p >= 0 and self.next[p].get(t) == to:
            self.next[p][t] = new
            p = self.link[p]
        return new

    def _settle(self) -> None:
        """Per state: where its suffix of ``window`` words lives, and the short items that end there."""
        by_length = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        self.at_window = [-1] * len(self.next)
        self.ends: list[tuple] = [()] * len(self.next)
        for s in by_length:
            up = self.link[s]
            if self.length[s] >= self.window:
                self.at_window[s] = s if self.length[up] < self.window else self.at_window[up]
            self.ends[s] = (*self.ends[up], *self.short.get(s, ()))

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are hit, and the items with windows that occur."""
        hit, items = np.zeros(len(words), bool), set()
        if len(words) < self.least:
            return hit, items
        get = self.ids.get
        tokens = [get(w, -1) for w in words]
        known = np.array(tokens) >= 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= self.least:
                self._run(tokens, a, b, hit, items)
        return hit, items

    def _run(self, tokens, a, b, hit, items) -> None:
        nexts, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        done = a  # a match starts no earlier than those before it, so all behind its start and before this is marked
        for i in range(a, b):
            t = tokens[i]
            while state and t not in nexts[state]:
                state = link[state]
                matched = length[state]
            if t in nexts[state]:
                state = nexts[state][t]
                matched += 1
            if matched >= window:
                hit[max(i - matched + 1, done) : i + 1] = True
                done = i + 1
                items |= self.items[self.at_window[state]]
            for n, name in self.ends[state]:
                if n <= matched:
                    hit[i - n + 1 : i + 1] = True
                    items.add(name)


def automaton_of(items: DataFrame, window: int = WINDOW, max_bytes: int = 8 << 20) -> Automaton:
    """Automaton of ``items(item_id, text)``; a test set above ``max_bytes`` is refused, not cut.

    Benchmarks do not grow with the corpus; the check keeps it so. A word makes up to two states, of about
    a kilobyte each as Python objects, so 8 MB of items are about 3 GB on the driver and in each worker.
    """
    size = items.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    if size > max_bytes:
        raise ValueError(f"{size} bytes of test items; raise max_bytes or split them")
    rows = items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).collect()
    sequences = {}
    for n, (name, text) in enumerate(rows):
        sequences[n, name] = words_of(text)
    return Automaton(sequences, window)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, cover: int = 20) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans)`` of every row of ``docs(doc_id, text)``.

    A word is hit if it lies in an occurrence of ``window`` successive words of an
    item, or of a whole shorter item. A document is contaminated if it has a hit and
    ``cover * n_hit >= n_words``. ``spans`` are the hit word ranges (from, to).

    The automaton is a broadcast of checked size; documents are streamed where they
    lie, without a shuffle, and only runs of words known to the items walk it. Null
    and empty texts have no words, and null or empty items no windows; items of equal
    id count once in ``n_items``, an item without an id hits words but is not listed.
    Repeated rows each get their row. Without items nothing is hit.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(automaton_of(items, window))
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), span]

    def run(batch):
        automaton = shared.value
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            hit, found = automaton.scan(words)
            listed = sorted({name for _, name in found if name is not None})
            n = int(hit.sum())
            edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).tolist() if n else []
            spans = [{"from": a, "to": b} for a, b in zip(edges[::2], edges[1::2])]
            rows.append((doc, len(words), n, len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), n > 0 and cover * n >= len(words), spans))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<from:long,to:long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(per_batch(run), schema)


def cut_spans(text: str, hit: np.ndarray, longest: int) -> str:
    """The text without its runs of more than ``longest`` hit words, from the first word's start to the last one's end."""
    data = utf8(text)
    places = [m.span() for m in re.finditer(rb"\S+", data.translate(NORMAL))]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).tolist()
    out, at = [], 0
    for a, b in zip(edges[::2], edges[1::2]):
        if b - a > longest:
            out.append(data[at : places[a][0]])
            at = places[b - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, cover: int = 20, longest: int | None = None) -> DataFrame:
    """``docs`` without what is contaminated, columns unchanged.

    A row goes whole if ``cover * n_hit >= n_words`` and it has a hit (see :func:`contamination`). Of
    the other rows, hit runs of more than ``longest`` words are cut out of the text if that
    limit is given, else they stay as they are. Null and empty texts have no hit and stay.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(automaton_of(items, window))
    at = docs.columns.index("text")

    def run(batch):
        keep, texts = [], batch.column(at).to_pylist()
        for i, text in enumerate(texts):
            hit = shared.value.scan(words_of(text))[0]
            n = int(hit.sum())
            keep.append(not (n and cover * n >= len(hit)))
            if n and longest is not None:
                texts[i] = cut_spans(text, hit, longest)
        columns = [pa.array(texts, batch.schema.field(i).type) if i == at else c for i, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(per_batch(run), docs.schema)
