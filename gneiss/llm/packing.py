"""Best-fit packing of token sequences by hierarchical residual packing."""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import Scratch, slices

LENGTH = 2048
#: Chunks outside of these characters are left to the tokenizers library.
UNUSUAL = re.compile("[^!-~\xa1-\xac\xae-įĲ-ɏ]|<\\|")
#: Chunks remembered by a Python worker before it starts anew.
REMEMBERED = 150_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by rule: printable Latin-1
    stands for itself, other bytes follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """Ids of a lower-casing BPE with word ends, as little-endian 32-bit bytes.

    Texts are cut at white space, which the tokenizer's own split drops, and chunks
    are remembered. A new chunk of common Latin characters is merged by tiktoken's
    core: the word end is one more byte, and since ids are in the order of merges the
    ids serve as ranks. All other chunks go to the tokenizers library itself.
    """

    END = b"\xff"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        of = byte_alphabet()
        self.core = None
        self.words = None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if suffix == "</w>" else None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        in_order = all(vocab.get(a + b) == 512 + i for i, (a, b) in enumerate(pairs))
        if split and in_order:
            special = {t["content"] for t in spec["added_tokens"]}
            ranks = {}
            for token, i in vocab.items():
                if token in special:
                    continue
                body, end = (token[: -len(suffix)], self.END) if token.endswith(suffix) else (token, b"")
                ranks[bytes(of[c] for c in body) + end] = i
            ranks.setdefault(self.END, len(vocab) + 1)
            encoding = tiktoken.Encoding("word_bpe", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
            self.core = encoding._core_bpe.encode_single_piece
            self.words = regex.compile(split)
        self.known: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        chunks, known = text.replace("\n", " ").replace("\t", " ").split(" "), self.known
        new = set(chunks).difference(known)
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set(chunks)
            rest = []
            for c in new:
                if self.core is None or UNUSUAL.search(c):
                    rest.append(c)
                else:
                    ids: list[int] = []
                    for w in [c.lower()] if c.isalpha() else self.words.findall(c.lower()):
                        ids += self.core(w.encode() + self.END)
                    known[c] = struct.pack(f"<{len(ids)}I", *ids)
            for c, e in zip(rest, self.library.encode_batch(rest, add_special_tokens=False) if rest else ()):
                known[c] = np.array(e.ids, "<u4").tobytes()
        return b"".join(map(known.__getitem__, chunks))


@lru_cache(1)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each document's ids and a closing 0, cut at ``length``."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        encode = tokenizer(path)
        for batch in (part for whole in batches for part in slices(whole)):
            out = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = encode(text or "") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(data), 4 * length)):
                    part = data[at : at + 4 * length]
                    for column, value in zip(out, (doc, k, k * length, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            if out[0]:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def best_fit(sizes: list[int], room: int) -> list[int]:
    """Bin of each item, largest first, each into the fullest bin that still takes it.

    Open bins are kept by residual room; a bit set of the rooms that occur finds the
    least sufficient one, so an item costs the same however many bins are open.
    """
    where = [0] * len(sizes)
    by_room: list[list[int]] = [[] for _ in range(room + 1)]
    present, bins = 0, 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[i]
        above = present >> size
        if above:
            left = size + (above & -above).bit_length() - 1
            b = by_room[left].pop()
            if not by_room[left]:
                present ^= 1 << left
        else:
            left, b, bins = room, bins, bins + 1
        where[i] = b
        left -= size
        if left:
            by_room[left].append(b)
            present |= 1 << left
    return where


ITEM = "size long, seed long, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"


def _pack(room: int, full: int):
    """Best-fit of one partition's items; marks bins of at least ``full`` as done."""

    def run(batches):
        sizes, members, seeds = [], [], []
        for batch in batches:
            sizes += batch.column(0).to_pylist()
            seeds += batch.column(1).to_pylist()
            members.append(batch.column(2))
        if not sizes:
            return
        members = pa.chunked_array(members)
        order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], seeds[i]))
        sizes, seeds = [sizes[i] for i in order], [seeds[i] for i in order]
        where = best_fit(sizes, room)
        by_bin: dict[int, list[int]] = {}
        for i, b in enumerate(where):
            by_bin.setdefault(b, []).append(i)
        groups = list(by_bin.values())
        for at in range(0, len(groups), 2000):
            part = groups[at : at + 2000]
            taken = members.take(pa.array([order[i] for g in part for i in g])).combine_chunks()
            inner = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(taken).to_numpy())])
            ends = np.concatenate([[0], np.cumsum([len(g) for g in part])])
            lists = pa.ListArray.from_arrays(pa.array(inner[ends], pa.int32()), taken.flatten())
            total = [sum(sizes[i] for i in g) for g in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array(total, pa.int64()), pa.array([min(seeds[i] for i in g) for g in part], pa.int64()), lists, pa.array([t >= full for t in total])],
                ["size", "seed", "members", "done"],
            )

    return run


def pack(docs: DataFrame, path: str, length: int = LENGTH, slack: int = 8, per_part: int = 20_000, least_gain: float = 0.005) -> DataFrame:
    """Place of every piece of ``docs(doc_id, text)`` in sequences of at most ``length`` tokens.

    Pieces of full length are sequences of their own. The rest is dealt over partitions
    of about ``per_part`` items, packed best-fit there, and bins with at most ``slack``
    tokens of room are emitted. Underfull bins go on as single items, dealt anew over as many
    partitions as they need, round after round, until one partition packs what is left.
    A bin that not even the least item left fits is emitted too, and a round that
    joins fewer than ``least_gain`` of its items is the last: so items that
    cannot be joined never come together in one task. A bin carries its members (at
    most ``length``), so no join is needed to place them, and partitions hold at most 20 * ``per_part`` members on average.

    Null and empty texts are one piece of one token. Every row counts, repeated rows
    and ids too; a null doc_id stays null. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.cut(pieces(docs, path, length))
    short = cut.where(F.col("length") < length)
    n = members = short.count()
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    items = short.select(F.col("length").alias("size"), F.xxhash64("doc_id", "piece", "ids_crc32").alias("seed"), F.array(member).alias("members"))
    done = cut.where(F.col("length") == length).select(F.array(member).alias("members"))
    rounds = 0
    while n:
        parts = max(1, -(-n // per_part), -(-members // (20 * per_part)))
        dealt = items.repartition(parts, F.pmod(F.xxhash64("seed", F.lit(rounds)), F.lit(parts * 64))) if parts > 1 else items.coalesce(1)
        packed = scratch.cut(dealt.mapInArrow(_pack(length, 0 if parts == 1 else length - slack), ITEM + ", done boolean"))
        left = packed.where("not done")
        bins, least = packed.agg(F.count("*"), F.min(F.when(~F.col("done"), F.col("size")))).first()
        # What the round joined: its items less the bins that came out.
        if least is None or n - bins < least_gain * n:
            done = done.unionByName(packed.select("members"))
            break
        over = F.col("size") + F.lit(least) > length
        done = done.unionByName(packed.where(F.col("done") | over).select("members"))
        items = left.where(~over).select("size", "seed", "members")
        n, members = items.agg(F.count("*"), F.coalesce(F.sum(F.size("members")), F.lit(0))).first()
        rounds += 1
    placed = done.withColumn("sequence_id", F.monotonically_increasing_id())
    ends = F.aggregate("members", F.array(F.lit(0).cast("long")), lambda acc, m: F.concat(acc, F.array(F.element_at(acc, -1) + m.length)))
    flat = placed.withColumn("ends", ends).select("sequence_id", "ends", F.posexplode("members").alias("at", "m"))
    return flat.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", F.expr("ends[at]").alias("offset"))
