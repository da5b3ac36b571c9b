"""Line dedup: cuckoo filters in shards, backed by exact reference counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.common import Scratch, per_batch, utf8
from gneiss.llm.simhash import LOWER

SPACE = b" \t\n\x0b\x0c\r"
SLOTS = 4
#: Filter bytes that may be broadcast; beyond it lines are dealt to the filters' shards, in so many parts each.
BROADCAST_BYTES, SHARD_PARTS = 64 << 20, 8
#: Frequent keys that one filter should hold.
SHARD_KEYS = 200_000


def line_keys(text: str | None) -> list[bytes]:
    """Key of each line, in order: stripped of ASCII white space, A-Z lower-cased."""
    return [x.strip(SPACE) for x in utf8(text).translate(LOWER).split(b"\n")]


class CuckooFilter:
    """Membership with deletion: 16-bit marks, four to a bucket, two buckets to a key.

    Keys are 64-bit hashes. Inserting a key that finds no place doubles the table
    from the caller's keys, so nothing inserted is ever lost.
    """

    def __init__(self, buckets: int):
        self.table = np.zeros((max(1, 1 << (max(1, buckets) - 1).bit_length()), SLOTS), np.uint16)

    @classmethod
    def of(cls, keys: np.ndarray, load: float = 0.8) -> CuckooFilter:
        keys = np.unique(keys.astype(np.uint64))
        buckets = int(len(keys) / (SLOTS * load)) + 1
        while True:
            made = cls(buckets)
            if all(made.insert(int(k)) for k in made._fill(keys)):
                return made
            buckets = 2 * len(made.table)

    def _fill(self, keys: np.ndarray) -> np.ndarray:
        """Insert distinct keys where one of their buckets has room, all at once; the rest comes back."""
        for other in (False, True):
            mark, one, two = self._places(keys)
            at = (two if other else one).astype(np.int64)
            order = np.argsort(at, kind="stable")
            at, mark, keys = at[order], mark[order], keys[order]
            start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, np.int64)
            rank = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
            slot = (self.table[at] != 0).sum(1) + rank
            fits = slot < SLOTS
            self.table[at[fits], slot[fits]] = mark[fits]
            keys = keys[~fits]
        return keys

    def _places(self, keys):
        keys = np.asarray(keys, np.uint64)
        mark = (keys >> np.uint64(48)).astype(np.uint64)
        mark = np.where(mark == 0, np.uint64(1), mark)
        mask = np.uint64(len(self.table) - 1)
        first = keys & mask
        return mark, first, self._other(first, mark)

    def _other(self, at, mark):
        with np.errstate(over="ignore"):
            return (at ^ (mark * np.uint64(0x5BD1E995))) & np.uint64(len(self.table) - 1)

    def insert(self, key: int) -> bool:
        mark, one, two = self._places([key])
        m, spots = mark[0], [int(one[0]), int(two[0])]
        for at in spots:
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = m
                return True
        at = spots[key & 1]
        for kick in range(500):
            slot = (int(m) + kick) % SLOTS
            m, self.table[at, slot] = np.uint64(self.table[at, slot]), m
            at = int(self._other(np.uint64(at), m))
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = m
                return True
        return False

    def delete(self, key: int) -> bool:
        mark, one, two = self._places([key])
        for at in (int(one[0]), int(two[0])):
            found = np.flatnonzero(self.table[at] == mark[0])
            if len(found):
                self.table[at, found[0]] = 0
                return True
        return False

    def contains(self, keys) -> np.ndarray:
        mark, one, two = self._places(keys)
        m = mark.astype(np.uint16)[:, None]
        return (self.table[one.astype(np.int64)] == m).any(1) | (self.table[two.astype(np.int64)] == m).any(1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        made = cls(1)
        made.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return made


def _hashes(keys: list[bytes]) -> np.ndarray:
    """128-bit hash of each key as (high, low)."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in keys), ">i8").reshape(-1, 2).astype(np.int64)


def occurrences(docs: DataFrame, least_chars: int = 1) -> DataFrame:
    """``(hi, lo, doc_id)``: each line key of a document once; equal doc_ids are one document."""

    def run(batch):
        ids, out = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys = [k for k in set(line_keys(text)) if len(k) >= least_chars and (least_chars < 2 or len(k.decode("utf-8", "surrogatepass")) >= least_chars)]
            ids += [doc] * len(keys)
            out += keys
        h = _hashes(out)
        return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64())], ["hi", "lo", "doc_id"])

    return _plain(docs).mapInArrow(per_batch(run), "hi long, lo long, doc_id long")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def count_references(lines: DataFrame, unique_ids: bool = True) -> DataFrame:
    """``(hi, lo, n_docs)``: in how many documents each key is found.

    Counts are summed before the shuffle, so a line of a third of all documents is a
    row per input partition. With ``unique_ids`` false, repeated doc_ids are merged first.
    """
    if not unique_ids:
        lines = lines.distinct()
    return lines.groupBy("hi", "lo").agg(F.count("*").alias("n_docs"))


class LineIndex:
    """Reversible state of line dedup: exact reference counts, and filters of frequent keys.

    ``counts`` is a table of (hi, lo, n_docs). Inserting adds a batch of documents
    to the counts, deleting takes them away again, and keys at zero go; both return a
    new index, so ``index.insert(d).delete(d)`` equals ``index``. Filters are built
    by shard from the keys that reach ``threshold``.
    """

    def __init__(self, counts: DataFrame, scratch: Scratch, threshold: int = 10, least_chars: int = 1):
        self.counts, self.scratch = counts, scratch
        self.threshold, self.least_chars = threshold, least_chars

    @classmethod
    def build(cls, docs: DataFrame, threshold: int = 10, least_chars: int = 1) -> LineIndex:
        scratch = Scratch(docs.sparkSession, "lines")
        counts = count_references(occurrences(docs, least_chars), has_unique_ids(docs))
        return cls(scratch.cut(counts), scratch, threshold, least_chars)

    def _with(self, docs: DataFrame, sign: int) -> LineIndex:
        change = count_references(occurrences(docs, self.least_chars), has_unique_ids(docs))
        change = change.withColumn("n_docs", F.col("n_docs") * sign)
        both = self.counts.unionByName(change).groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs")).where("n_docs > 0")
        return LineIndex(self.scratch.cut(both), self.scratch, self.threshold, self.least_chars)

    def insert(self, docs: DataFrame) -> LineIndex:
        """State after documents that are not in it yet are added."""
        return self._with(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """State after documents that are in it are taken out."""
        return self._with(docs, -1)

    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.threshold).select("hi", "lo")

    def filters(self, shards: int) -> DataFrame:
        """``(shard, filter)``: a cuckoo filter of each shard's frequent keys."""

        def build(batches):
            found = {}
            for batch in batches:
                lo = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                shard = (lo % np.uint64(shards)).astype(np.int64)
                for s in np.unique(shard).tolist():
                    found.setdefault(s, []).append(lo[shard == s] // np.uint64(shards))
            for s, keys in found.items():
                made = CuckooFilter.of(_mixed(np.concatenate(keys))).to_bytes()
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([made], pa.binary())], ["shard", "filter"])

        return self.frequent().select("lo").repartition(max(1, shards // 4), _shard_of("lo", shards)).mapInArrow(build, "shard int, filter binary")

    def clean(self, docs: DataFrame, shards: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """``docs`` with every line of a frequent key taken out, plus ``n_lines`` and ``n_dropped``.

        Filters hold about ``SHARD_KEYS`` keys each and leave of each document only keys that may be frequent. They
        go to all tasks if they are at most ``broadcast_bytes`` together; else the keys are dealt to
        their shards, each in ``SHARD_PARTS`` parts with its filter in front. What goes on is
        joined with the exact counts, so a false mark drops nothing. Texts move once, to meet their frequent keys.
        """
        spark = docs.sparkSession
        shards = shards or max(8, -(-self.frequent().count() // SHARD_KEYS))
        filters = self.scratch.cut(self.filters(shards))
        size = filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
        maybe = occurrences(docs, self.least_chars)
        if size <= broadcast_bytes:
            shared = spark.sparkContext.broadcast({r[0]: r[1] for r in filters.collect()})
            maybe = maybe.mapInArrow(_probe(shared, shards), maybe.schema)
        else:
            maybe = _probe_in_shards(maybe, filters, shards)
        hits = maybe.join(self.frequent(), ["hi", "lo"], "left_semi")
        mine, drop = _unused("doc", docs), _unused("drop", docs)
        drops = hits.groupBy(F.col("doc_id").alias(mine)).agg(F.collect_set("lo").alias(drop))
        plain = docs.drop("n_lines", "n_dropped")
        joined = plain.join(drops, plain.doc_id.cast("long").eqNullSafe(drops[mine]), "left").drop(mine)
        counts = [T.StructField(n, T.LongType()) for n in ("n_lines", "n_dropped")]
        return joined.mapInArrow(_rewrite(joined.columns.index("text"), drop), T.StructType([*plain.schema.fields, *counts]))


def _unused(name: str, df: DataFrame) -> str:
    """A column name that ``df`` doesn't have, whatever case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def _shard_of(column: str, shards: int):
    """``column`` modulo ``shards`` as an unsigned number."""
    return F.pmod(F.pmod(F.col(column), F.lit(shards)) + F.lit((1 << 64) % shards) * (F.col(column) < 0).cast("int"), F.lit(shards)).cast("int")


def _mixed(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def _probe(shared, shards: int):
    def run(batches):
        made = {s: CuckooFilter.from_bytes(b) for s, b in shared.value.items()}
        for batch in batches:
            lo = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            shard, keep = lo % np.uint64(shards), np.zeros(len(lo), bool)
            for s, one in made.items():
                at = np.flatnonzero(shard == s)
                keep[at] = one.contains(_mixed(lo[at] // np.uint64(shards)))
            if keep.any():
                yield batch.filter(pa.array(keep))

    return run


def _probe_in_shards(keys: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Rows of ``keys(hi, lo, doc_id)`` that their shard's filter may hold, probed beside it."""
    names = ["shard", "part", "filter", "hi", "lo", "doc_id"]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SHARD_PARTS)).cast("int")
    lines = keys.select(_shard_of("lo", shards).alias("shard"), part.alias("part"), F.lit(None).cast("binary").alias("filter"), "hi", "lo", "doc_id")
    none = [F.lit(None).cast("long").alias(n) for n in ("hi", "lo", "doc_id")]
    ahead = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SHARD_PARTS - 1))).alias("part"), "filter", *none)
    parts = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards * SHARD_PARTS // 4)

    def run(batches):
        now, made = None, None
        for batch in batches:
            shard, part = (batch.column(i).to_numpy() for i in (0, 1))
            edges = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (part[1:] != part[:-1])])) if len(shard) else np.empty(0, np.int64)
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(shard)]):
                if (shard[a], part[a]) != now:
                    now, data = (shard[a], part[a]), batch.column(2)[a].as_py()
                    made = None if data is None else CuckooFilter.from_bytes(data)
                rows = batch.slice(a, b - a)
                rows = rows.filter(rows.column(2).is_null())
                if made is not None and rows.num_rows:
                    lo = rows.column(4).to_numpy().view(np.uint64)
                    keep = made.contains(_mixed(lo // np.uint64(shards)))
                    yield pa.RecordBatch.from_arrays([rows.column(i) for i in (3, 4, 5)], names[3:]).filter(pa.array(keep))

    dealt = lines.unionByName(ahead).repartition(parts, "shard", "part").sortWithinPartitions("shard", "part", F.col("filter").isNull())
    return dealt.mapInArrow(run, keys.schema)


def _rewrite(at: int, dropped: str):
    def one(text, drop):
        keys = line_keys(text)
        if not drop:
            return text, len(keys), 0
        drop = set(drop)
        lows = _hashes(keys)[:, 1].tolist()
        lines = utf8(text).split(b"\n")
        kept = [line for line, key, low in zip(lines, keys, lows) if not key or low not in drop]
        return b"\n".join(kept).decode("utf-8", "surrogatepass"), len(keys), len(keys) - len(kept)

    def run(batch):
        names = batch.schema.names
        drops = batch.column(names.index(dropped)).to_pylist()
        made = [one(t, d) for t, d in zip(batch.column(at).to_pylist(), drops)]
        columns = [pa.array([m[0] for m in made], pa.string()) if i == at else c for i, c in enumerate(batch.columns) if names[i] != dropped]
        columns += [pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [n for n in names if n != dropped] + ["n_lines", "n_dropped"])

    return per_batch(run)


def has_unique_ids(docs: DataFrame) -> bool:
    """Whether no doc_id is repeated, so that counting needs no distinct."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.groupBy("doc_id").count().where("count > 1").isEmpty()


def dedup_lines(docs: DataFrame, threshold: int = 10, least_chars: int = 1) -> DataFrame:
    """``docs`` without the lines whose key is found in ``threshold`` documents, with ``n_lines``, ``n_dropped``.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased;
    keys of fewer than ``least_chars`` code points (empty ones) stay. Lines are split at
    newlines only; null and empty texts are one empty line, and a null text that loses
    nothing stays null. Rows of equal doc_id, null included, count as one document
    and each is rewritten. An empty table gives no rows; other columns pass through, but for
    any of the two names that are added.
    Within a document keys are told apart by 64 of the 128 hash bits.
    """
    return LineIndex.build(docs, threshold, least_chars).clean(docs)


def digest(cleaned: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` of :func:`dedup_lines`."""
    kept = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    return cleaned.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", kept.alias("kept_sha256"))
