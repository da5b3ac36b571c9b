"""Near-duplicate passages by compact windows of min-hashes."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import Scratch, WholeGroups, connected_components, per_batch, slices, utf8
from gneiss.llm.simhash import LOWER

SHINGLE, PASSAGE, SIMILAR = 5, 50, 0.8
#: Hash functions, and how many of them must agree on a common passage.
HASHES, AGREE = 4, 2
#: So many different surroundings of a key are paired unseen; those of larger keys are compared by their shingles.
PAIRS = 12
#: So many windows of a key are compared all with all at once, and so many at a time in larger ones.
SMALL = 48
#: Aligned passages may drift by so many words within one candidate.
DRIFT = 16
#: Slices that one row asks of a document; more are dealt over several rows.
REQUESTS = 256

_MASK = (1 << 64) - 1
_PLACE = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


#: A 64-bit number for each byte, A-Z as a-z, and which bytes are white space.
_BYTES = _mix((np.frombuffer(bytes(range(256)).translate(LOWER), np.uint8).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
#: Bytes of text whose words are hashed at once.
PIECE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, np.uint64(base)))])


def _word_hashes(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of texts that begin at ``begin`` in ``data``, and their places; a text ends a word."""
    space = _SPACE[data]
    gap = np.concatenate([[True], space, [True]])
    new = np.zeros(len(data) + 1, bool)
    new[begin] = True
    first = np.flatnonzero(~space & (gap[:-2] | new[:-1]))
    last = np.flatnonzero(~space & (gap[2:] | new[1:])) + 1
    if not len(first):
        return np.empty(0, np.uint64), first
    # Sums over pieces that hold whole words, so that few powers are needed.
    hashes, at = [], 0
    while at < len(first):
        end = max(at + 1, int(np.searchsorted(last, first[at] + PIECE, "right")))
        base, n = int(first[at]), int(last[end - 1] - first[at])
        if len(_word_hashes.up) <= n:
            _word_hashes.up, _word_hashes.down = (_powers(x, max(n, 1 << 16)) for x in (Runs.BASE, pow(Runs.BASE, -1, 1 << 64)))
        s, e = first[at:end] - base, last[at:end] - base
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data[base : base + n]] * _word_hashes.up[:n])])
            hashes.append(_mix((sums[e] - sums[s]) * _word_hashes.down[s]))
        at = end
    return np.concatenate(hashes), first


_word_hashes.up = _word_hashes.down = np.ones(1, np.uint64)


class Shingler:
    """64-bit hashes of word shingles; words are runs without ASCII white space, A-Z lower-cased."""

    def __init__(self, size: int = SHINGLE):
        self.size = size

    def __call__(self, text: str | None) -> np.ndarray:
        return self.texts(np.frombuffer(utf8(text), np.uint8), np.zeros(1, np.int64))[0]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of all texts of an Arrow column, and where each text's begin (and the last ones end)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
        return self.texts(data, offsets[:-1] - offsets[0])

    def texts(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, place = _word_hashes(data, begin)
        begin = np.append(np.searchsorted(place, begin), len(w))
        count = np.maximum(np.diff(begin) - self.size + 1, 0)
        starts = np.concatenate([[0], np.cumsum(count)])
        n = len(w) - self.size + 1
        if n <= 0 or not starts[-1]:
            return np.empty(0, np.uint64), starts
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(self.size):
                out = out * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n]
        whole = np.zeros(len(w) + 1, np.int8)  # shingles within one text
        np.add.at(whole, begin[:-1], (count > 0).astype(np.int8))
        np.add.at(whole, begin[:-1] + count, -(count > 0).astype(np.int8))
        return _mix(out[np.cumsum(whole[:n]).astype(bool)]), starts


def compact_windows(shingles: np.ndarray, width: int, hashes: int = HASHES) -> tuple[np.ndarray, ...]:
    """(key, centre, left, right) of all compact windows at least ``width`` shingles wide.

    For each hash function, every run of ``width`` shingles or more has its least hash at
    the centre of exactly one window that contains it: a node of the Cartesian tree over
    the hashes with its subtree as window. Nodes with wide subtrees are just the
    least of some run of ``width``, found by sliding minima; their bounds come from
    them alone, since the nearest smaller hash beside a wide subtree
    is the root of a wide one itself. Of equal hashes the leftmost counts as least.
    """
    return text_windows(shingles, np.array([0, len(shingles)]), width, hashes)[:4]


def text_windows(shingles: np.ndarray, begin: np.ndarray, width: int, hashes: int = HASHES) -> tuple[np.ndarray, ...]:
    """:func:`compact_windows` of texts whose shingles begin at ``begin``, as places in ``shingles``; last the number of the text."""
    size = np.diff(begin)
    some = np.flatnonzero(size >= width)
    n = len(shingles)
    if not len(some):
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none, none
    # Runs of ``width`` within a text: where they start, and which are the first of their text.
    runs = size[some] - width + 1
    starts = np.arange(int(runs.sum())) + np.repeat(begin[some] - np.cumsum(runs) + runs, runs)
    head = np.zeros(len(starts), bool)
    head[np.cumsum(runs) - runs] = True
    of = np.repeat(np.arange(len(some)), runs)
    place = np.arange(n, dtype=np.uint64) & _PLACE
    full = np.full(-(-n // width) * width, np.uint64(_MASK))
    out = []
    for k in range(hashes):
        h = _mix(shingles ^ np.uint64((k + 1) * 0xD6E8FEB86659FD93 & _MASK))
        full[:n] = (h & ~_PLACE) | place
        cells = full.reshape(-1, width)
        prefix = np.minimum.accumulate(cells, axis=1).ravel()
        suffix = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
        run = np.minimum(suffix[starts], prefix[starts + width - 1])
        # Where the least of successive runs stays the same, its place does too.
        at = np.flatnonzero(head | np.concatenate([[True], run[1:] != run[:-1]]))
        low, text, at = run[at], of[at], _places(run[at], starts[at], width)
        order = np.argsort(at, kind="stable")
        at, low, text = at[order], low[order], text[order]
        keep = np.concatenate([[True], at[1:] != at[:-1]])
        at, low, text = at[keep], low[keep], text[keep]
        left, right = _smaller(low, text)
        first, last = begin[some[text]], begin[some[text] + 1] - 1
        left = np.where(left < 0, first, at[left] + 1)
        right = np.where(right < 0, last, at[right] - 1)
        out.append(((h[at] & ~np.uint64(7)) | np.uint64(k % 8), at, left, right, some[text]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _smaller(low: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each value the nearest one before that is no larger and the nearest behind that is smaller, in its text; -1 if none.

    Links lead over larger values and are followed in step; each round doubles what they lead over.
    """
    n, out = len(low), []
    for step in (-1, 1):
        to = np.arange(n) + step
        edge = np.flatnonzero(text[1:] != text[:-1])
        to[[0] if step < 0 else [n - 1]] = -1
        to[edge + 1 if step < 0 else edge] = -1
        some = np.flatnonzero(to >= 0)
        while len(some):
            ahead = low[to[some]]
            some = some[ahead > low[some] if step < 0 else ahead >= low[some]]
            to[some] = to[to[some]]
            some = some[to[some] >= 0]
        out.append(to)
    return out[0], out[1]


def _places(low: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Place of each least value: its low bits, in the run that starts at ``first``."""
    at = (low & _PLACE).astype(np.int64)
    span = int(_PLACE) + 1
    return first + (at - first) % span


#: Kinds of rows: a window that goes on; equal ranges of two documents; windows of two documents that may belong
#: together, by their key or by words beside its centre; a window of a key that has too many to pair them unseen.
ON, COPY, PAIR, STRONG, DEEP = range(5)
#: ``f`` and ``h`` hash what lies around the centre, see :func:`_around`.
WINDOW = ["kind", "key", "doc", "c", "l", "r", "f", "h", "doc2", "c2", "l2", "r2"]
WINDOW_SCHEMA = "kind byte, key long, doc long, c int, l int, r int, f long, h int, doc2 long, c2 int, l2 int, r2 int"
KINDS = [pa.int8(), pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 3]


class Runs:
    """64-bit hashes of runs of a document's shingles."""

    BASE = 0x9E3779B97F4A7C15
    powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, shingles: np.ndarray):
        n = len(shingles)
        if len(Runs.powers[0]) <= n:
            size = 1 << max(12, n.bit_length())
            Runs.powers = tuple(_powers(x, size) for x in (self.BASE, pow(self.BASE, -1, 1 << 64)))
        up, self.down = Runs.powers
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(shingles * up[:n])])

    def __call__(self, begin: np.ndarray, length) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[begin + length] - self.sums[begin]) * self.down[begin])


def _around(shingles: np.ndarray, key: np.ndarray, c: np.ndarray, l: np.ndarray, r: np.ndarray, first: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Of windows in texts from ``first`` to ``end``: a hash of all that a run of ``width`` with the centre can reach (f), and for the first hash function of
    half a run up to and from the centre (h), 16 bits each, 0 where it is cut off.

    A run of ``width`` with the centre has one of the two halves whole. Marks of halves only say what to verify.
    """
    runs, c = Runs(shingles), c.astype(np.int64)
    lo, hi = np.minimum(c - l, width - 1), np.minimum(r - c, width - 1)
    f = _mix(runs(c - lo, lo + hi + 1) ^ _mix((lo * (2 * width) + hi + 1).astype(np.uint64)))
    some = np.flatnonzero(key & np.uint64(7) == 0)
    c, lo, hi, first, last = c[some], lo[some], hi[some], first[some], end[some]
    size = width // 2 + 1
    start, end = np.maximum(c - size + 1, first), np.minimum(c + size, last)
    left, right = ((runs(b, e - b) >> np.uint64(48)).astype(np.uint32) | np.uint32(1) for b, e in ((start, c + 1), (c, end)))
    h = np.zeros(len(key), np.uint32)
    h[some] = (left << np.uint32(16)) * (lo >= size - 1) | right * (hi >= size - 1)
    return f.view(np.int64), h.view(np.int32)


def _rows(kind: int, key: np.ndarray, one, two=None) -> pa.RecordBatch:
    """Rows of ``WINDOW``; ``one`` is (doc, c, l, r, f, h), ``two`` (doc, c, l, r)."""
    n = len(key)
    two = two or [None] * 4
    columns = [np.full(n, kind, np.int8), key, *one, *two]
    return pa.RecordBatch.from_arrays([pa.nulls(n, k) if x is None else pa.array(x, k) for x, k in zip(columns, KINDS)], WINDOW)


def _copies_of(key, w, i: np.ndarray, j: np.ndarray, width: int) -> pa.RecordBatch:
    """Rows of equal surroundings (i, j) as ranges; those of two documents that overlap in step come as one."""
    doc, c, l, r = w[:4]
    shift, b, e = c[j] - c[i], np.maximum(l[i], c[i] - width + 1), np.minimum(r[i], c[i] + width - 1) + 1
    order = np.lexsort((b, shift, doc[j], doc[i]))
    i, j, shift, b, e = i[order], j[order], shift[order], b[order], e[order]
    new = np.concatenate([[True], (doc[i][1:] != doc[i][:-1]) | (doc[j][1:] != doc[j][:-1]) | (shift[1:] != shift[:-1])])
    part = np.cumsum(new) << 32
    reach = np.maximum.accumulate(part + e)
    start = np.flatnonzero(np.concatenate([[True], part[1:] + b[1:] > reach[:-1]]))
    end = reach[np.concatenate([start[1:], [len(i)]]) - 1] - part[start]
    # A range has its first place in c and c2, and its length in f.
    none = [None] * 2
    return _rows(COPY, key[i[start]], (doc[i[start]], b[start], *none, end - b[start], None), (doc[j[start]], b[start] + shift[start], *none))


def _joined(key: np.ndarray, w: list[np.ndarray], width: int, last: bool):
    """What windows of whole keys have to do with one another.

    Windows of a key with equal surroundings are a class; its least document leads it. Of the first hash function
    each other member gives a copy of the leader, and the leader's own further windows one of the first of another
    document. Without ``last`` the leaders go on to meet those of other tasks; with it, the keys are whole and
    their classes are paired, see :func:`_paired`.
    """
    order = np.lexsort((w[1], w[0], w[4], key))
    key, w = key[order], [x[order] for x in w]
    doc, f, n = w[0], w[4], len(key)
    same = np.concatenate([[False], (key[1:] == key[:-1]) & (f[1:] == f[:-1])])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    own, exact = doc == doc[head], key & 7 == 0
    first = np.full(n, n)  # of each class, by its head: the first row of another document
    turn = np.flatnonzero(same & ~own & np.concatenate([[True], own[:-1]]))
    first[head[turn]] = turn
    at, further = np.flatnonzero(~own & exact), np.flatnonzero(same & own & exact)
    again = further[first[head[further]] < n]
    i, j = np.concatenate([head[at], again]), np.concatenate([at, first[head[again]]])
    if len(i):
        yield _copies_of(key, w, i, j, width)
    end = np.flatnonzero(np.concatenate([~same[1:], [True]]))
    end = end[~own[end] & exact[end]]
    if not last:
        go = np.zeros(n, bool)
        go[~same] = go[further] = go[end] = True
        yield _rows(ON, key[go], [x[go] for x in w])
        return
    # A leader of several classes of a key meets itself in them; so another member stands beside it.
    heads = np.flatnonzero(~same)
    heads = heads[np.lexsort((doc[heads], key[heads]))]
    again = (key[heads][1:] == key[heads][:-1]) & (doc[heads][1:] == doc[heads][:-1])
    several = np.zeros(n, bool)
    several[heads[1:][again]] = several[heads[:-1][again]] = True
    yield from _paired(key, w, np.concatenate([heads, end[several[head[end]]]]))


def _within(sizes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j in each of the groups that begin at ``begin``; groups are small."""
    i, j = [], []
    for m in np.unique(sizes[sizes > 1]).tolist():
        a, b = np.triu_indices(m, 1)
        at = begin[sizes == m][:, None]
        i.append((at + a).ravel())
        j.append((at + b).ravel())
    return (np.concatenate(i), np.concatenate(j)) if i else (np.empty(0, np.int64),) * 2


def _paired(key: np.ndarray, w: list[np.ndarray], heads: np.ndarray):
    """Pairs of the classes of each key, whose leaders are at ``heads``.

    Up to ``PAIRS`` classes are paired with one another; of a larger key all come out to be compared by content, see :func:`_large`.
    """
    doc, h = w[0], w[5]
    heads = heads[np.lexsort((doc[heads], key[heads]))]
    begin = np.flatnonzero(np.concatenate([[True], key[heads][1:] != key[heads][:-1]]))
    size = np.diff(np.append(begin, len(heads)))
    i, j = (heads[x] for x in _within(np.where(size <= PAIRS, size, 0), begin))
    ok = doc[i] != doc[j]
    i, j = i[ok], j[ok]
    half = np.zeros(len(i), bool)
    for side in (np.int32(-1 << 16), np.int32(0xFFFF)):
        half |= (h[i] & side == h[j] & side) & (h[i] & side != 0)
    half &= key[i] & 7 == 0
    for kind, some in ((STRONG, half), (PAIR, ~half)):
        if some.any():
            a, b = i[some], j[some]
            yield _rows(kind, key[a], [x[a] for x in w[:4]] + [None] * 2, [x[b] for x in w[:4]])
    deep = heads[np.repeat(size > PAIRS, size)]
    if len(deep):
        yield _rows(DEEP, key[deep], [x[deep] for x in w])


def _windows(shingle: int, width: int, hashes: int, hold: int = 1_500_000):
    """Windows of a partition, combined by key before the shuffle."""

    def run(batches):
        make, held, count = Shingler(shingle), [], 0
        for batch in batches:
            for part in slices(batch.filter(batch.column(0).is_valid())):
                doc = part.column(0).to_numpy()
                found, begin = make.column(part.column(1))
                key, c, l, r, text = text_windows(found, begin, width, hashes)
                if len(key):
                    first, end = begin[text], begin[text + 1]
                    held.append((key.view(np.int64), doc[text], c - first, l - first, r - first, *_around(found, key, c, l, r, first, end, width)))
                    count += len(key)
                if count > hold:
                    key, *w = (np.concatenate(x) for x in zip(*held))
                    held, count = [], 0
                    yield from _joined(key, w, width, False)
        if held:
            key, *w = (np.concatenate(x) for x in zip(*held))
            yield from _joined(key, w, width, False)

    return run


def _meet(width: int):
    """What windows of a partition that has all of each key, in their order, have to do with one another; other rows pass."""

    def run(batches):
        groups = WholeGroups("key")

        def met(tables):
            for table in tables:
                key, *w = (table.column(i).to_numpy() for i in range(1, 8))
                yield from _joined(key, w, width, True)

        for batch in batches:
            on = pc.equal(batch.column(0), pa.scalar(ON, pa.int8()))
            yield batch.filter(pc.invert(on))
            yield from met(groups.add(batch.filter(on)))
        yield from met(groups.last())

    return run


def _large(plain: DataFrame, met: DataFrame, width: int, similar: float, shingle: int, parts: int) -> DataFrame:
    """Pairs of windows, as ``STRONG`` rows, that connect the keys with more than ``PAIRS`` classes.

    Each window of such a key takes what a run of ``width`` with its centre can reach from the text, 32 bits a shingle, and
    windows of a key meet in one place, see :func:`_near`.
    """
    request = F.collect_list(F.struct("key", "c", "l", "r"))
    asked = met.where(F.col("kind") == DEEP).groupBy("doc").agg(request.alias("asked"))
    reach = plain.join(asked, F.col("doc_id") == F.col("doc")).select("doc", "text", "asked").mapInArrow(_reach(shingle, width), REACH_SCHEMA)
    return reach.repartition(parts, "key").sortWithinPartitions("key", "doc", "c").mapInArrow(_met_large(width, similar), "kind byte, key long, doc long, c int, l int, r int, doc2 long, c2 int, l2 int, r2 int")


REACH = ["key", "doc", "c", "l", "r", "h"]
REACH_SCHEMA = "key long, doc long, c int, l int, r int, h array<int>"


def _reach(shingle: int, width: int):
    """The shingles that a run of ``width`` with the centre of each asked window can reach."""

    def run(batches):
        make = Shingler(shingle)
        for batch in batches:
            for part in slices(batch):
                found, begin = make.column(part.column(1))
                asked = part.column(2)
                text = np.repeat(np.arange(part.num_rows), pc.list_value_length(asked).to_numpy())
                q = pc.list_flatten(asked)
                key, c, l, r = (q.field(n).to_numpy() for n in ("key", "c", "l", "r"))
                # Of several texts of one doc_id, it is that of a text with the shingle in this place.
                fits = r < (begin[1:] - begin[:-1])[text]
                key, c, l, r, text = (x[fits] for x in (key, c, l, r, text))
                k = key.view(np.uint64) & np.uint64(7)
                fits = (_hashed(found[begin[text] + c], k) & ~np.uint64(7)) | k == key.view(np.uint64)
                key, c, l, r, text = (x[fits] for x in (key, c, l, r, text))
                s, e = np.maximum(l, c - width + 1).astype(np.int64), np.minimum(r, c + width - 1).astype(np.int64) + 1
                ends = np.concatenate([[0], np.cumsum(e - s)])
                h = found.view(np.int64)[np.arange(ends[-1]) + np.repeat(begin[text] + s - ends[:-1], e - s)].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part.column(0).to_numpy()[text]), pa.array(c), pa.array(l), pa.array(r), lists], REACH)

    return run


def _hashed(shingles: np.ndarray, k) -> np.ndarray:
    """Hash function ``k`` of shingles."""
    with np.errstate(over="ignore"):
        return _mix(shingles ^ (np.asarray(k, np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def _met_large(width: int, similar: float):
    """Pairs of windows among those of a partition that has all of each key, in their order."""

    def met(tables):
        for table in tables:
            key, doc, c, l, r = (table.column(i).to_numpy() for i in range(5))
            h = table.column(5).combine_chunks()
            i, j = near_windows(key, doc, c - np.maximum(l, c - width + 1), h.flatten().to_numpy(), h.value_lengths().to_numpy(), width, similar)
            if len(i):
                one, two = ([pa.array(x[at]) for x in (doc, c, l, r)] for at in (i, j))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), STRONG, np.int8)), pa.array(key[i]), *one, *two], ["kind", "key", "doc", "c", "l", "r", "doc2", "c2", "l2", "r2"])

    def run(batches):
        groups = WholeGroups("key", 20_000)
        for batch in batches:
            yield from met(groups.add(batch))
        yield from met(groups.last())

    return run


def _distinct(before: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Least number of different shingles in a run of ``width``, by window; ``before`` is where each was seen last, or -1."""
    least = np.full(len(size), width)
    for start in range(int(size.max(initial=0)) - width + 1):
        run = np.count_nonzero(before[:, start : start + width] < start, axis=1)
        least = np.where(start + width <= size, np.minimum(least, run), least)
    return least


def _need(length, floor, similar: float):
    """So many shingles of a range of ``length`` different ones must be in another with at least ``floor``."""
    return np.maximum(similar * length, similar * (length + floor) / (1 + similar)) - 1e-6


def _fitting(common: np.ndarray, floor: np.ndarray, width: int, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Of windows of different shingles, first place and end of all ranges that may be a passage, where ``common`` says which may be common.

    Each begins and ends with one of these; there is none where the end is no larger than the first place.
    """
    n, span = common.shape
    count = np.zeros((n, span + 1), np.float32)
    np.cumsum(common, axis=1, out=count[:, 1:])
    places = np.arange(span + 1, dtype=np.float32)
    begins, ends = common.copy(), common.copy()
    if span < width:
        return np.full(n, span), np.zeros(n, np.int64)
    for slope, lift in ((similar, np.zeros(n)), (similar / (1 + similar), similar * floor / (1 + similar))):
        score = count - np.float32(slope) * places
        lift = (lift - 1e-3).astype(np.float32)[:, None]
        top = np.maximum.accumulate(np.where(common, score[:, 1:], -np.inf)[:, ::-1], axis=1)[:, ::-1]
        low = np.minimum.accumulate(np.where(common, score[:, :-1], np.inf), axis=1)
        begins[:, : span - width + 1] &= top[:, width - 1 :] - score[:, : span - width + 1] >= lift
        ends[:, width - 1 :] &= score[:, width:] - low[:, : span - width + 1] >= lift
    begins[:, span - width + 1 :] = False
    ends[:, : width - 1] = False
    first = np.where(begins.any(1), begins.argmax(1), span)
    return first, np.where(ends.any(1), span - ends[:, ::-1].argmax(1), 0)


def near_windows(key: np.ndarray, doc: np.ndarray, centre: np.ndarray, h: np.ndarray, size: np.ndarray, width: int, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of windows in the order of their key that have a common passage, see :func:`_near`.

    ``h`` holds all windows' shingles, ``size`` of each. A common passage has ranges of at least ``width`` on either side, with at
    least p and q different shingles; so c of them are in both with c / (p + q - c) >= similar. Where p is the least of any run of
    a window, ``similar`` times p of its shingles must be in windows of other documents. Windows that have fewer go, as often as that leaves others with fewer.
    """
    n, end = len(key), np.cumsum(size)
    begin = end - size
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])).astype(np.uint64)
    token = h.view(np.uint32).astype(np.uint64)
    win = np.repeat(np.arange(n), size)
    pos = np.arange(len(h)) - begin[win]
    own = (win.astype(np.uint64) << np.uint64(32)) | token
    order = np.argsort(own, kind="stable")
    again = np.flatnonzero(own[order][1:] == own[order][:-1])
    before = np.full(len(h), -1)
    before[order[again + 1]] = pos[order[again]]
    least, once = np.full(n, width), np.ones(n, bool)
    once[win[before >= 0]] = False
    span, some = 2 * width, np.flatnonzero(~once)
    seen = np.full((len(some), span), span)
    at = np.searchsorted(some, win[~once[win]])
    seen[at, pos[~once[win]]] = before[~once[win]]
    least[some] = _distinct(seen, size[some], width)
    first = before < 0
    win, pos, token = win[first], pos[first], (group[win[first]] << np.uint64(32)) | token[first]
    while len(win):
        order = np.argsort(token, kind="stable")  # stable: the documents of a token rise
        t, d = token[order], doc[win[order]]
        b = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        count = np.diff(np.append(b, len(t)))
        keep = np.zeros(len(t), bool)
        keep[order] = np.repeat(d[b] != d[b + count - 1], count)
        enough = np.bincount(win[keep], minlength=n) >= similar * least - 1e-9
        keep &= enough[win]
        # Shingles outside all ranges that may be passages go too.
        some = np.flatnonzero(np.bincount(win[keep], minlength=n).astype(bool) & once)
        floor = np.full(int(group[-1]) + 1, width)
        np.minimum.at(floor, group[win[keep]].astype(np.int64), least[win[keep]])
        row = np.full(n, -1)
        row[some] = np.arange(len(some))
        common = np.zeros((len(some), span), bool)
        own = keep & once[win]
        common[row[win[own]], pos[own]] = True
        low, high = _fitting(common, floor[group[some].astype(np.int64)], width, similar)
        keep[own] = (pos[own] >= low[row[win[own]]]) & (pos[own] < high[row[win[own]]])
        win, pos, token = win[keep], pos[keep], token[keep]
        if keep.all():
            break
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    b = np.flatnonzero(np.concatenate([[True], group[win][1:] != group[win][:-1]])) if len(win) else np.empty(0, np.int64)
    for s, e in zip(b.tolist(), np.append(b[1:], len(win)).tolist()):
        some, local = np.unique(win[s:e], return_inverse=True)
        parts = [h[x:y].astype(np.int64) for x, y in zip(begin[some].tolist(), end[some].tolist())]
        pairs = _near(doc[some], centre[some], parts, local, np.unique(token[s:e], return_inverse=True)[1], pos[s:e], least[some], once[some], width, similar)
        if pairs:
            i, j = np.array(pairs).T
            out.append((some[i], some[j]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _near(doc, centre, parts, win, token, pos, least, once, width: int, similar: float) -> list[tuple[int, int]]:
    """Pairs of one key's windows that connect what any pairs with a common passage connect, and together cover what they cover.

    ``win``, ``token`` and ``pos`` list each window's different shingles that other documents have too. Windows outside the largest class
    are compared with all others, until every pair of two classes was; then windows with shingles that lie in no
    passage yet are compared with all that hold those. So a family of copies takes a comparison a window, not all pairs.
    """
    m, span = len(doc), 2 * width
    at = np.searchsorted(win, np.arange(m + 1))
    held = np.bincount(token)
    by = np.argsort(token, kind="stable")
    places = np.concatenate([[0], np.cumsum(held)])
    floor = int(least.min())
    label = np.unique(doc, return_inverse=True)[1]
    covered = np.zeros((m, span), bool)
    out: list[tuple[int, int]] = []

    def holders(t: np.ndarray) -> np.ndarray:
        """How many of some shingles each window has."""
        n = places[t + 1] - places[t]
        ends = np.cumsum(n)
        return np.bincount(win[by[np.arange(ends[-1]) + np.repeat(places[t] - ends + n, n)]], minlength=m)

    def asked(one, two):
        """So many shingles must be in both of two windows."""
        one, two = least[one], least[two]
        return np.maximum(similar * (one + two) / (1 + similar), similar * np.maximum(one, two)) - 1e-9

    def compare(x, others: np.ndarray):
        """Of ``others`` that may have a passage with ``x`` (one window, or one for each): the place among them, 1 if it has, 0 if not, -1 if that must be asked, its range in x and its own."""
        n = at[others + 1] - at[others]
        ends = np.cumsum(n)
        e = np.arange(int(n.sum())) + np.repeat(at[others] - ends + n, n)
        row = np.repeat(np.arange(len(others)), n)
        if np.ndim(x):
            i = table[x[row], token[e]]
        else:
            own = slice(at[x], at[x + 1])
            mine[token[own]] = pos[own]
            i = mine[token[e]]
            mine[token[own]] = -1
        some = np.flatnonzero(i >= 0)
        both = np.bincount(row[some], minlength=len(others)) >= asked(x, others)
        some = some[both[row[some]]]
        if not len(some):
            return [np.empty(0, np.int64)] * 6
        i, row, j = i[some].astype(np.int64), row[some], pos[e[some]]
        new = np.concatenate([[True], row[1:] != row[:-1]])
        begin = np.flatnonzero(new)
        of, row = row[begin], np.cumsum(new) - 1
        end = np.append(begin[1:], len(i))
        y, x = others[of], x[of] if np.ndim(x) else np.full(len(of), x)
        # As in ``matches``, but for all at once; it is asked where shingles repeat or change their order.
        score = (1 + similar) * (np.arange(len(i)) - begin[row]) - similar * (i + j)
        lift = (len(begin) - row) * (8.0 * span)
        best = np.maximum.accumulate((score + lift)[::-1])[::-1] - lift
        far = np.zeros(len(i), np.int64)  # the first common shingle that is far enough, counted within the row
        masks = []
        for v in (i, j):
            common = np.zeros((len(begin), span), bool)
            common[row, v] = True
            masks.append(common)
            before = np.zeros((len(begin), span + width), np.int16)
            np.cumsum(common, axis=1, out=before[:, 1 : span + 1], dtype=np.int16)
            before[:, span + 1 :] = before[:, span : span + 1]
            far = np.maximum(far, before[row, v + width - 1])
        far += begin[row]
        ok = far < end[row]
        ok[ok] = best[far[ok]] >= score[ok] - (1 - similar) - 1e-6
        low = np.minimum.reduceat(np.where(ok, score, np.inf), begin)
        inside = score >= low[row] - (1 - similar) - 1e-6
        first = np.minimum.reduceat(np.where(ok, np.arange(len(i)), len(i) - 1), begin)
        last = np.maximum.reduceat(np.where(inside, np.arange(len(i)), 0), begin)
        last = np.maximum(last, begin)
        state = np.logical_or.reduceat(ok, begin).astype(np.int64)
        turns = np.concatenate([[False], (i[1:] < i[:-1]) & ~new[1:]])
        unsure = np.logical_or.reduceat(turns, begin) | ~once[y] | ~once[x]
        state[unsure] = -1
        for mask, one, two in ((masks[0], x, y), (masks[1], y, x)):  # but not where the common shingles are too few for any range
            some = np.flatnonzero(unsure & once[one])
            if len(some):
                b, f = _fitting(mask[some], least[two[some]], width, similar)
                state[some[f <= b]] = 0
        return of, state, i[first], i[last] + 1, j[first], j[last] + 1

    small = m <= SMALL
    if small:
        # All pairs at once; ``known`` has what ``compare`` tells of each.
        table = np.full((m, len(held)), -1, np.int16)
        table[win, token] = pos
        has = (table >= 0).astype(np.float32)
        x, y = np.triu_indices(m, 1)
        some = (doc[x] != doc[y]) & ((has @ has.T)[x, y] >= asked(x, y))
        x, y = x[some], y[some]
        known = np.zeros((5, m, m), np.int64)
        if len(x):
            of, *told = compare(x, y)
            known[:, x[of], y[of]] = told
            known[:, y[of], x[of]] = [told[0], *told[3:], *told[1:3]]
            if not known[0].any():
                return out
    else:
        mine = np.full(len(held), -1)

    def met(x: int, others: np.ndarray):
        """As ``compare``, with the windows."""
        if small:
            told = known[:, x, others]
            some = told[0] != 0
            return others[some], *told[:, some]
        of, *told = compare(x, others)
        return others[of], *told

    nothing: set[tuple[int, int]] = set()  # pairs that were asked in vain

    def ask(x: int, y: int) -> list[tuple[int, int, int, int]]:
        if (x, y) in nothing or (y, x) in nothing:
            return []
        ranges = matches(parts[x], parts[y], width, similar, int(centre[y] - centre[x]))
        if not ranges:
            nothing.add((x, y))
        return ranges

    def take(x: int, y: int, ranges):
        for b, e, b2, e2 in ranges:
            covered[x, b:e] = covered[y, b2:e2] = True
        out.append((x, y))

    seen = np.zeros(m, bool)
    while True:
        left = np.flatnonzero(~seen & (label != np.bincount(label).argmax()))
        if not len(left):
            break
        x = int(left[0])
        seen[x] = True
        others = ~seen & (label != label[x])
        if not small:
            others &= holders(token[at[x] : at[x + 1]]) >= asked(x, slice(None))
        y, state, *ranges = met(x, np.flatnonzero(others))
        yes = np.flatnonzero(state == 1)
        joins, one = np.unique(label[y[yes]], return_index=True)
        for k in yes[one].tolist():
            take(x, int(y[k]), [[int(v[k]) for v in ranges]])
        label[np.isin(label, joins)] = label[x]
        for v in y[state < 0].tolist():
            if label[v] != label[x] and (found := ask(x, v)):
                take(x, v, found)
                label[label == label[v]] = label[x]
    # Shingles that many windows have, as a row of flags each.
    often = np.flatnonzero(8 * held >= m) if not small else np.empty(0, np.int64)
    row_of = np.full(len(held), -1)
    row_of[often] = np.arange(len(often))
    flags = np.zeros((len(often), m), np.uint8)
    some = row_of[token] >= 0
    flags[row_of[token[some]], win[some]] = 1

    def having(t: np.ndarray) -> np.ndarray:
        """Which windows have each of some shingles."""
        out, at = np.zeros((len(t), m), np.uint8), row_of[t]
        out[at >= 0] = flags[at[at >= 0]]
        few = np.flatnonzero(at < 0)
        n = held[t[few]]
        ends = np.cumsum(n)
        if len(few):
            out[np.repeat(few, n), win[by[np.arange(ends[-1]) + np.repeat(places[t[few]] - ends + n, n)]]] = 1
        return out

    def ending(q: np.ndarray, has: np.ndarray, tried: np.ndarray) -> np.ndarray:
        """Windows not tried that have the first of some shingles and so many of those up to another one that the range may be a passage.

        ``q`` are their distances from the first, ``has`` says which windows have them.
        """
        some = np.flatnonzero((has[0] == 1) & ~tried)
        far = np.flatnonzero(q >= width - 1)
        if not len(some) or not len(far):
            return some[:0]
        has = has[:, some]
        count = np.cumsum(has, axis=0, dtype=np.uint8)
        need = np.ceil(_need(q[far] + 1, floor, similar)).astype(np.uint8)
        may = ((count[far[0] :] >= need[:, None]) & (has[far[0] :] == 1)).any(0)
        return some[may][np.argsort(-count[-1, may].astype(np.int64), kind="stable")]

    def cover(x: int, others: np.ndarray, goal: np.ndarray):
        """Pairs of ``x`` with some of ``others``, some at a time, until it is covered at all of ``goal``."""
        start, count = 0, SMALL
        while start < len(others) and not covered[x, goal].all():
            some, start, count = others[start : start + count], start + count, 4 * count
            y, state, *ranges = met(x, some)
            yes = np.flatnonzero(state == 1)
            if len(yes):  # all have the centre, so the farthest on either side cover what any cover
                for k in {int(yes[ranges[0][yes].argmin()]), int(yes[ranges[1][yes].argmax()])}:
                    if not covered[x, q[(q >= ranges[0][k]) & (q < ranges[1][k])]].all():
                        take(x, int(y[k]), [[int(v[k]) for v in ranges]])
            for v in y[state < 0].tolist():
                if covered[x, goal].all():
                    break
                found = ask(x, v)
                if any((~covered[x, q] & (q >= b) & (q < e)).any() for b, e, _, _ in found):
                    take(x, v, found)

    for x in range(m):
        q, own = pos[at[x] : at[x + 1]], token[at[x] : at[x + 1]]
        if covered[x, q].all():
            continue
        if small:
            cover(x, np.flatnonzero(known[0, x]), q)
            continue
        if not once[x]:
            have = holders(own[~covered[x, q]])  # those with the most of such shingles come first
            others = np.flatnonzero((have > 0) & (doc != doc[x]))
            cover(x, others[np.argsort(-have[others], kind="stable")], q)
            continue
        # A passage has the centre. So the outermost place not covered can only be covered by a passage that ends there, and then all up to the centre are.
        tried, has = doc == doc[x], having(own)
        for side in (1, -1):
            outer = np.arange(len(q))[::side]
            for k in outer[~covered[x, q[outer]] & (side * (q[outer] - centre[x]) <= 0)].tolist():
                if covered[x, q[k]]:
                    break
                tail = slice(k, None, side)
                others = ending(side * (q[tail] - q[k]), has[tail], tried)
                if len(others):
                    cover(x, others, q[k : k + 1])
                    if not covered[x, q[k]]:
                        tried[others] = True
    return out


def _regions(width: int, agree: int, drift: int):
    """Interval join of a pair's windows: places where enough hash functions agree, or words beside a centre do."""

    def of(rows):
        rows = sorted((r["c"] - r["c2"], max(r["l"], r["l2"] + r["c"] - r["c2"]), min(r["r"], r["r2"] + r["c"] - r["c2"]), 8 if r["strong"] else r["key"] & 7) for r in rows)
        out, i = [], 0
        while i < len(rows):
            j = i
            while j + 1 < len(rows) and rows[j + 1][0] - rows[j][0] <= drift and rows[j + 1][0] - rows[i][0] <= 4 * drift:
                j += 1
            group = [r for r in rows[i : j + 1] if r[2] - r[1] + 1 >= width or r[3] == 8]
            i = j + 1
            marks = sorted([(r[1], 1, r[3], r[0]) for r in group] + [(r[2] + 1, -1, r[3], r[0]) for r in group], key=lambda m: (m[0], m[1]))
            live: dict[int, int] = {}
            start, shifts, strong = None, [], False
            for at, sign, k, shift in marks:
                live[k] = live.get(k, 0) + sign
                enough = live.get(8, 0) > 0 or sum(v > 0 for v in live.values()) >= agree
                if sign > 0:
                    shifts.append(shift)
                if enough and start is None:
                    start = at
                    strong = live.get(8, 0) > 0
                elif enough:
                    strong |= live.get(8, 0) > 0
                elif start is not None:
                    if at - start >= width - drift * strong:  # words put in or left out move one side's ends
                        out.append((start, at - 1, shifts[len(shifts) // 2]))
                    start, shifts = None, [s for s in shifts[-1:]]
        return out

    def run(batch):
        cols = [[] for _ in range(5)]
        for a, b, rows in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for s, e, shift in of(rows):
                for col, v in zip(cols, (a, b, s, e, shift)):
                    col.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc", "doc2", "s", "e", "shift"])

    return per_batch(run)


def _slices(shingle: int):
    """The asked ranges of each document's shingle hashes, cut at the document's ends."""

    def run(batches):
        make = Shingler(shingle)
        for batch in batches:
            for part in slices(batch):
                found, begin = make.column(part.column(0))
                asked = part.column(1)
                text = np.repeat(np.arange(part.num_rows), pc.list_value_length(asked).to_numpy())
                q = pc.list_flatten(asked)
                first, size, s, e = begin[text], begin[text + 1] - begin[text], *(q.field(n).to_numpy().astype(np.int64) for n in ("s", "e"))
                s = np.maximum(s, 0)
                size = np.maximum(np.minimum(e + 1, size) - s, 0)
                ends = np.concatenate([[0], np.cumsum(size)])
                h = found.view(np.int64)[np.arange(ends[-1]) + np.repeat(first + s - ends[:-1], size)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h))
                yield pa.RecordBatch.from_arrays([q.field("pair"), q.field("side"), pa.array(s, pa.int32()), lists], ["pair", "side", "s", "h"])

    return run


def _chain(a: np.ndarray, b: np.ndarray, off: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal shingles that rise in both: the longest such sequence.

    Of several equal shingles in ``b``, the nearest to the place in ``a`` plus ``off`` counts.
    """
    order = np.argsort(b, kind="stable")
    ranked = b[order]
    low, high = np.searchsorted(ranked, a), np.searchsorted(ranked, a, "right")
    i = np.flatnonzero(high > low)
    j = order[low[i]]
    some = np.flatnonzero(high[i] - low[i] > 1)
    if len(some):
        want, first, end = i[some] + off, low[i[some]], high[i[some]]
        # Places rise within equal shingles: the last one before the wanted place or the first one from it on.
        step = 2 * (len(a) + len(b) + abs(off)) + 1
        ranks = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]])) * step
        at = np.searchsorted(ranks + order, ranks[first] + want)
        one, two = order[np.clip(at - 1, first, end - 1)], order[np.clip(at, first, end - 1)]
        j[some] = np.where(np.abs(one - want) <= np.abs(two - want), one, two)
    if (np.diff(j) > 0).all():
        return i, j
    tails: list[int] = []
    at, before, places = [], np.full(len(i), -1, np.int64), j.tolist()
    for k, v in enumerate(places):
        t = bisect.bisect_left(tails, v)
        before[k] = at[t - 1] if t else -1
        tails[t : t + 1], at[t : t + 1] = [v], [k]
    keep, k = [], at[-1] if at else -1
    while k >= 0:
        keep.append(k)
        k = before[k]
    keep = np.array(keep[::-1], np.int64)
    return i[keep], j[keep]


def _in(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a few numbers are among a few others."""
    b = np.sort(b)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a if len(b) else np.zeros(len(a), bool)


def _set(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def matches(a: np.ndarray, b: np.ndarray, width: int, similar: float, off: int = 0) -> list[tuple[int, int, int, int]]:
    """(begin in a, end in a, begin in b, end in b) in shingles of verified common passages.

    Runs of at least ``width`` equal shingles in place count, where ``off`` is the place in b less that in a.
    So do all ranges of at least ``width`` shingles in both that begin and end with a common shingle and
    have a Jaccard similarity of ``similar`` or more, whatever lies around them; those that overlap come as one.
    Where the order of common shingles differs, only the range from the first to the last is tried.
    """
    x, y = max(0, -off), max(0, off)
    n = min(len(a) - x, len(b) - y)
    equal = np.concatenate([[False], a[x : x + n] == b[y : y + n], [False]]).astype(np.int8)
    edges = np.flatnonzero(np.diff(equal))
    out = [(int(x + s), int(x + e), int(y + s), int(y + e)) for s, e in zip(edges[::2], edges[1::2]) if e - s >= width]
    if out and out[0][1] - out[0][0] == max(len(a), len(b)):
        return out
    # Common c of lengths p and q, both ``width`` at least: c / (p + q - c) >= similar asks for so many.
    if np.count_nonzero(_in(a, b)) < 2 * similar * width / (1 + similar) - 1e-9:
        return out
    i, j = _chain(a, b, off)
    if len(i) >= similar * width:
        # Such a range is a rise of ``score`` by similar - 1 or more.
        score = (1 + similar) * np.arange(len(i)) - similar * (i + j)
        best = np.maximum.accumulate(score[::-1])[::-1]
        last = np.searchsorted(-best, -(score - (1 - similar) - 1e-9), "right") - 1
        begin = np.flatnonzero((i[last] - i + 1 >= width) & (j[last] - j + 1 >= width))
        repeats = len(_set(a)) < len(a) or len(_set(b)) < len(b)
        if not repeats and len(begin):  # then a range is new if it ends behind all before
            reach = np.maximum.accumulate(last[begin])
            begin = begin[np.concatenate([[True], last[begin][1:] > reach[:-1]])]
        reach = -1
        for s, t in zip(begin.tolist(), last[begin].tolist()):
            if t <= reach:
                continue
            if repeats:
                one, two = _set(a[i[s] : i[t] + 1]), _set(b[j[s] : j[t] + 1])
                both = np.count_nonzero(_in(one, two))
                if both < similar * (len(one) + len(two) - both):
                    continue
            reach = t
            out.append((int(i[s]), int(i[t]) + 1, int(j[s]), int(j[t]) + 1))
    if not out:  # parts in another order
        p, q = np.flatnonzero(_in(a, b)), np.flatnonzero(_in(b, a))
        if len(p) and min(p[-1] - p[0], q[-1] - q[0]) + 1 >= width:
            one, two = _set(a[p[0] : p[-1] + 1]), _set(b[q[0] : q[-1] + 1])
            both = np.count_nonzero(_in(one, two))
            if both >= similar * (len(one) + len(two) - both):
                out.append((int(p[0]), int(p[-1]) + 1, int(q[0]), int(q[-1]) + 1))
    merged: list[tuple[int, int, int, int]] = []
    for p in sorted(out):
        q = merged[-1] if merged else None
        if q and p[0] <= q[1] and q[2] <= p[2] <= q[3]:
            merged[-1] = (q[0], max(q[1], p[1]), q[2], max(q[3], p[3]))
        else:
            merged.append(p)
    return merged


def _verify(width: int, similar: float, shingle: int):
    def parts(column: pa.ListArray) -> list[list[tuple[int, np.ndarray]]]:
        """(place, shingles) of the slices of each row, without a copy."""
        flat = column.flatten()
        hashes = flat.field("h")
        ends, values, at = hashes.offsets.to_numpy(), hashes.values.to_numpy(), flat.field("s").to_numpy().tolist()
        some = [(s, values[x:y]) for s, x, y in zip(at, ends[:-1].tolist(), ends[1:].tolist())]
        sizes = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]).tolist()
        return [some[x:y] for x, y in zip(sizes[:-1], sizes[1:])]

    def run(batch):
        cols = [[] for _ in range(6)]
        ids = (batch.column(i).to_pylist() for i in range(3))
        for doc, doc2, shift, ones, twos in zip(*ids, parts(batch.column(3)), parts(batch.column(4))):
            for one, a in ones:
                for two, b in twos:
                    for x, x2, y, y2 in matches(a, b, width, similar, one - shift - two):
                        for col, v in zip(cols, (doc, doc2, one + x, one + x2 + shingle - 1, two + y, two + y2 + shingle - 1)):
                            col.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc", "doc2", "b", "e", "b2", "e2"])

    return per_batch(run)


def passage_links(docs: DataFrame, scratch: Scratch, passage: int = PASSAGE, similar: float = SIMILAR, shingle: int = SHINGLE, hashes: int = HASHES, agree: int = AGREE) -> DataFrame:
    """``(doc, doc2, b, e, b2, e2)``: verified common passages, as word ranges, that connect each group.

    Windows of a key are first combined by their surroundings within an input partition, then among the
    partitions' leaders, so a passage of a third of all documents is a few rows per
    partition in any task. Classes of different surroundings are paired, see :func:`_paired`, and
    a pair whose windows overlap under ``agree`` hash functions, or with half a run in common, is verified by its texts.
    Keys of many classes are searched by content, see :func:`_large`; the pairs found are verified likewise.
    """
    width = passage - shingle + 1
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows = plain.mapInArrow(_windows(shingle, width, hashes), WINDOW_SCHEMA)
    # A copy already knows its ends: it is dealt by them, not by the key.
    dealt = F.when(F.col("kind") == ON, F.col("key")).otherwise(F.xxhash64("doc", "doc2", "c2"))
    met = scratch.cut(windows.repartition(parts, dealt).sortWithinPartitions("key").mapInArrow(_meet(width), WINDOW_SCHEMA))
    done = met.where(F.col("kind") == COPY).select("doc", "doc2", F.col("c").alias("b"), F.col("c2").alias("b2"), F.col("f").cast("int").alias("n"))
    end = lambda b: (F.col(b) + F.col("n") + shingle - 1).alias(b.replace("b", "e"))
    copies = done.select("doc", "doc2", "b", end("b"), "b2", end("b2"))
    turned = F.col("doc") > F.col("doc2")
    names = ("doc", "c", "l", "r")
    sides = [F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for n in names for a, b in ((n, n + "2"), (n + "2", n))]
    pairs = met.where(F.col("kind").isin(PAIR, STRONG)).unionByName(scratch.cut(_large(plain, met, width, similar, shingle, parts)), allowMissingColumns=True)
    pairs = pairs.select("key", (F.col("kind") == STRONG).alias("strong"), *sides)
    member = F.struct("key", "strong", *[n + x for x in ("", "2") for n in names[1:]])
    functions = F.expr("bit_count(bit_or(shiftleft(1, cast(key & 7 as int))))")
    paired = pairs.groupBy("doc", "doc2").agg(F.collect_set(member).alias("w"), functions.alias("n"), F.bool_or("strong").alias("s")).where((F.col("n") >= agree) | F.col("s")).drop("n", "s")
    regions = paired.mapInArrow(_regions(width, agree, DRIFT), "doc long, doc2 long, s int, e int, shift int")
    regions = scratch.cut(regions.withColumn("pair", F.xxhash64("doc", "doc2", "s", "e", "shift")))
    # Words put in or left out move a passage against the region; so both sides get some room.
    asked = regions.select(F.col("doc").alias("doc_id"), "pair", F.lit(0).alias("side"), (F.col("s") - DRIFT).alias("s"), (F.col("e") + DRIFT).alias("e")).unionByName(
        regions.select(F.col("doc2").alias("doc_id"), "pair", F.lit(1).alias("side"), (F.col("s") - F.col("shift") - DRIFT).alias("s"), (F.col("e") - F.col("shift") + DRIFT).alias("e"))
    )
    many = asked.groupBy("doc_id").agg(F.ceil(F.count("*") / REQUESTS).alias("chunks"))
    asked = asked.join(many, "doc_id").withColumn("chunk", F.pmod(F.col("pair"), F.col("chunks")))
    asked = scratch.cut(asked.groupBy("doc_id", "chunk").agg(F.collect_list(F.struct("pair", "side", "s", "e")).alias("asked")))
    slices = plain.join(asked, "doc_id").select("text", "asked").mapInArrow(_slices(shingle), "pair long, side int, s int, h array<long>")
    side = lambda n: F.collect_list(F.when(F.col("side") == n, F.struct("s", "h")))
    both = slices.groupBy("pair").agg(side(0).alias("one"), side(1).alias("two"))
    checked = regions.select("pair", "doc", "doc2", "shift").join(both, "pair").select("doc", "doc2", "shift", "one", "two")
    checked = checked.mapInArrow(_verify(width, similar, shingle), "doc long, doc2 long, b int, e int, b2 int, e2 int")
    return scratch.cut(checked.unionByName(copies))


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, similar: float = SIMILAR, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, n_repeated, spans, component_id, kept)`` of every row of ``docs(doc_id, text)``.

    Passages of ``passage`` words or more that another document has too, word for word or
    with a Jaccard similarity of ``similar`` over ``shingle``-word shingles, link the two
    documents. ``component_id`` is the smallest doc_id reachable, ``kept`` says that it is the
    row's own, ``spans`` are the merged word ranges (begin, end) verified by some link and
    ``n_repeated`` is the number of words in them. Links inside a document do not count.

    Word-for-word passages are all found: equal surroundings of a centre link at once, others by verified pairs,
    whatever other passages share a least hash. Of others, a pair of similarity s agrees in each
    hash function with probability s, and two of four must, or half a run must be equal. Up to ``PAIRS`` different
    surroundings of a key are all paired. More are compared by all their shingles, where one hash function is enough:
    no two of a key whose surroundings hold a common passage stay apart.

    Null, empty and shorter texts have no passage: they have their own class. Rows of one
    doc_id are one document; a null doc_id links with nothing and has a null class.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    links = passage_links(docs, scratch, passage, similar, shingle)
    classes = connected_components(links.select(F.col("doc").alias("a"), F.col("doc2").alias("b")), scratch)
    spans = links.select(F.col("doc").alias("node"), "b", "e").unionByName(links.select(F.col("doc2").alias("node"), F.col("b2").alias("b"), F.col("e2").alias("e"))).distinct()
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("b", "e"))), F.array().cast("array<struct<b:int,e:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)).e >= x.b), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1)).b.alias("b"), F.greatest(F.try_element_at(acc, F.lit(-1)).e, x.e).alias("e"))))).otherwise(F.concat(acc, F.array(x))),
    )
    per_doc = spans.groupBy("node").agg(merged.alias("spans")).join(classes, "node", "left")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = ids.join(per_doc, F.col("doc_id") == F.col("node"), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<b:int,e:int>>"))
    length = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + x.e - x.b)
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", length.alias("n_repeated"), spans.alias("spans"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
