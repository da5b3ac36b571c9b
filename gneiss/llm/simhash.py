"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import Scratch, WholeGroups, connected_components, forest, per_batch, utf8

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: Rows of variants that one shuffle partition should have; they are read key by key.
VARIANT_ROWS = 8_000_000
#: Stand-in ids of classes whose rows all lack an id; real ids lie below.
NO_ID = 1 << 62


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a text: majority bits over its word shingles.

    Words are runs without ASCII white space, ``A-Z`` lower-cased; repeated
    shingles count again. Fewer words than a shingle are one shingle; no word gives 0.
    """
    found = utf8(text).translate(LOWER).split()
    if not found:
        return 0
    line, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return digest(line, seed)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(found) - words + 1].tolist()
    h = np.array([digest(line[s:e], seed) for s, e in zip(starts, ends[words - 1 :].tolist())], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        counts += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` of every row, ``fp`` as a signed long."""

    def run(batch):
        fp = np.array([fingerprint(t, words, seed) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(per_batch(run), "doc_id long, fp long")


def block_masks(blocks: int) -> list[int]:
    """Masks of ``blocks`` runs of bits that together make up 64."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def _variants(blocks: int):
    """Per erased block: the bits kept, the block's mark, and the flips of radius 0 and 1."""
    out = []
    for k, mask in enumerate(block_masks(blocks)):
        rest = ((1 << 64) - 1) ^ mask
        low = (mask & -mask).bit_length() - 1
        flips = [0] + [1 << i for i in range(64) if rest >> i & 1]
        out.append((np.uint64(rest), np.array([f ^ (k << low) for f in flips], np.uint64)))

    def run(batch):
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        keys = np.concatenate([((fp & rest)[:, None] ^ flips[None, :]) for rest, flips in out], axis=1)
        own = np.repeat(fp, keys.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(own.view(np.int64))], ["key", "fp"])

    def chunked(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield run(batch.slice(at, 512))

    return chunked


def _linked(radius: int):
    """Edges that span the fingerprints within ``radius`` among those of one variant; rows come in the order of variants."""

    def group_edges(fp):
        fp = np.unique(fp)
        if len(fp) < 2:
            return None
        a, b = [], []
        for at in range(0, len(fp), 256):
            i, j = np.nonzero(np.bitwise_count(fp[at : at + 256, None] ^ fp[None, :]) <= radius)
            keep = i + at < j
            a.append(fp[i[keep] + at])
            b.append(fp[j[keep]])
            if sum(map(len, a)) > 1_000_000:
                nodes, root = forest(np.concatenate(a), np.concatenate(b))
                a, b = [nodes], [root]
        nodes, root = forest(np.concatenate(a), np.concatenate(b))
        keep = nodes != root
        return nodes[keep], root[keep]

    def edges(table):
        key, fp = table.column("key").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        two = starts[sizes == 2]
        x, y = fp[two], fp[two + 1]
        close = (np.bitwise_count(x ^ y) <= radius) & (x != y)
        a, b = [x[close]], [y[close]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            if got := group_edges(fp[s : s + n]):
                a.append(got[0])
                b.append(got[1])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            nodes, root = forest(a, b)
            keep = nodes != root
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep].view(np.int64)), pa.array(root[keep].view(np.int64))], ["a", "b"])

    def run(batches):
        groups = WholeGroups("key")
        for batch in batches:
            for table in groups.add(batch):
                yield from edges(table)
        for table in groups.last():
            yield from edges(table)

    return run


def meet(fps: DataFrame, blocks: int, parts: int) -> DataFrame:
    """``(a, b)``: edges that span the fingerprints of ``fps(fp)`` within three bits."""
    variants = fps.mapInArrow(_variants(blocks), "key long, fp long")
    return variants.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_linked(3), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, blocks: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row of ``docs(doc_id, text)``.

    Fingerprints at 3 or fewer differing bits link; ``component_id`` is the
    smallest doc_id reachable. Half of the radius is one and a half bits, so each
    of two linked fingerprints gives up one flipped bit and one erased block:
    whichever bits differ, erasing a block that holds one of them leaves at most two,
    and two balls of radius one meet. A fingerprint therefore emits, for each of
    ``blocks`` erased blocks, the rest of its bits and all single flips of them. Rows
    are dealt by variant, repeats of a fingerprint are merged before, and every pair
    that meets is verified on all 64 bits. No candidate is left out at any size.

    A variant's group holds distinct fingerprints only, at most ``49 * 2**16`` of
    them for four blocks; it is compared in blocks and leaves a spanning forest,
    not its pairs. Variants are sorted in their partitions and read group by group. Null and empty texts have fingerprint zero and link like others;
    repeated rows each get their row; a row without doc_id keeps null and its class
    takes the smallest id present (null if there is none). Ids lie below 2**62.
    An empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.cut(fingerprints(docs, words, seed))
    least = F.coalesce(F.min("doc_id"), F.lit(NO_ID) + F.shiftrightunsigned("fp", 3))
    own = scratch.cut(fps.groupBy("fp").agg(least.alias("rep")))
    variants = sum(65 - bin(mask).count("1") for mask in block_masks(blocks))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-own.count() * variants // VARIANT_ROWS))
    met = meet(own.select("fp"), blocks, parts)
    edges = scratch.cut(met.distinct())
    ends = edges.join(own.withColumnsRenamed({"fp": "a", "rep": "ra"}), "a").join(own.withColumnsRenamed({"fp": "b", "rep": "rb"}), "b")
    classes = connected_components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")), scratch)
    known = own.join(classes, own.rep == classes.node, "left").select("fp", F.coalesce("component", "rep").alias("c"))
    known = scratch.cut(known)
    return fps.join(known, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("c") < NO_ID, F.col("c")).alias("component_id"),
    )


def deduplicate(docs: DataFrame, **params) -> DataFrame:
    """Rows of ``docs`` with the smallest doc_id of their class, columns unchanged.

    Rows of one doc_id are one document and stay or go together; rows without an id
    cannot be named as copies of anything and stay.
    """
    kept = near_duplicates(docs, **params).where("doc_id = component_id or doc_id is null")
    kept = kept.select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs.doc_id.cast("long").eqNullSafe(kept._kept), "left_semi")
