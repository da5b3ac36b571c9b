"""Training-data operators against brute force on small fixtures."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm import chat_tools, common, decontam, embed_graph, entry, licenses, line_dedup, packing, passages, sharding, simhash, toxicity

DOCS = "doc_id long, text string, lang string, key long, fp long, shard int"


def docs_of(spark, rows):
    """Documents with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", 1, 2, 3) for i, t in rows], DOCS).repartition(3)


def odd_rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(r.randint(1, 80))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "   \n\t "), (None, "lost id"), (103, "One"), (103, "One"), (104, "x " * 30_000)]
    rows += [(200 + i, rows[3][1]) for i in range(12)] + [(300, rows[3][1] + " tail"), (301, rows[4][1].upper())]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, odd_rows())


def classes(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_cycles(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000 + r.randrange(400), 5000 + r.randrange(400)) for _ in range(250)] + [(7, 7), (None, 3)]
    r.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {x.node: x.component for x in common.connected_components(df, common.Scratch(spark, "test")).collect()}
    real = [e for e in edges if None not in e and e[0] != e[1]]
    want = classes(real, {n for e in real for n in e})
    assert all(got.get(n, n) == c for n, c in want.items()) and set(got) <= set(want)
    none = spark.createDataFrame([], "a long, b long")
    assert common.connected_components(none, common.Scratch(spark, "test")).count() == 0


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprints_and_classes(spark, odd):
    rows = odd_rows()
    got = simhash.near_duplicates(odd).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{slow_fingerprint(t):016x}") for i, t in rows)
    fps = {i: slow_fingerprint(t) for i, t in rows if i is not None}
    want = classes([(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3], fps)
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)


@pytest.mark.parametrize("blocks", [2, 3, 4])
def test_ball_hashing_finds_every_pair_within_three_bits(spark, blocks):
    r = random.Random(blocks)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = {b for b in base}
    for b in base:
        for _ in range(25):
            fps.add(b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 5))))
    fps = sorted(fps)
    df = spark.createDataFrame([(np.int64(np.uint64(f)).item(),) for f in fps], "fp long").repartition(3)
    met = simhash.meet(df, blocks, 5).collect()
    got = classes([(x.a % 2**64, x.b % 2**64) for x in met], fps)
    want = classes([(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin(a ^ b).count("1") <= 3], fps)
    assert got == want


def test_simhash_deduplicate_keeps_one_of_each_class(spark, odd):
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert None in ids and 3 in ids and not {200 + i for i in range(12)} & set(ids) and 100 in ids and 101 not in ids


def slow_jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * sharding.JUMP_MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(spark, odd):
    rows = sharding.shard(odd, 24).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key", slow_jump(i or 0, 24), slow_jump(i or 0, 25)) for i, t in odd_rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def slow_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c if c >= "\x80" or c.isascii() and (c.isdigit() or "a" <= c <= "z") else " " for c in text or "")
    return [w for w in low.split(" ") if w]


def slow_contamination(docs, items, n=13):
    windows = defaultdict(set)
    for name, text in items:
        w = slow_words(text)
        for i in range(max(1, len(w) - n + 1)) if w else ():
            windows[tuple(w[i : i + n])].add(name)
    out = []
    for i, text in docs:
        w, hit, found = slow_words(text), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if names := windows.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    found |= {str(x) for x in names if x is not None}
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


def test_decontamination_against_brute_force(spark):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.choice([2, 3, 5, 12, 13, 14, 20, 40]))) for i in range(25)] + [(50, None), (51, ""), (52, "!!"), (None, "w1 w2 w3 zz"), (7, text(15))]
    items.append((60, items[5][1]))
    rows = [(i, text(r.randint(0, 60))) for i in range(30)]
    rows += [(100 + i, text(10) + ", " + (t or "").upper() + ". " + text(5)) for i, (_, t) in enumerate(items)] + [(200, None), (201, ""), (None, "W1 w2 w3"), (202, "w1 w2 w3 zz"), (202, "w1 w2 w3 zz")]
    got = decontam.contamination(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).drop("spans").collect()
    assert Counter(map(tuple, got)) == slow_contamination(rows, items)
    kept = decontam.decontaminate(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter((x.doc_id,) for x in kept.collect()) == Counter((x[0],) for x in slow_contamination(rows, items).elements() if not x[-1])
    many = [(1, " ".join(f"x{i}" for i in range(300)) + " A, b c" + " y" * 5), (2, "a b c")]
    abc = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert [r.text.split()[299:] for r in decontam.decontaminate(docs_of(spark, many), abc, longest=2).collect()] == [["x299"] + ["y"] * 5]
    assert [r.text for r in decontam.decontaminate(docs_of(spark, many), abc).collect()] == [many[0][1]]
    assert decontam.contamination(docs_of(spark, rows[:3]), spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0


def slow_lines(rows, threshold):
    strip = " \t\n\x0b\x0c\r"
    keys = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in x).strip(strip) for x in (t or "").split("\n")]
    seen = defaultdict(set)
    for i, t in rows:
        for k in keys(t):
            seen[k].add(i)
    bad = {k for k, v in seen.items() if k and len(v) >= threshold}
    out = []
    for i, t in rows:
        kept = [x for x, k in zip((t or "").split("\n"), keys(t)) if k not in bad]
        n = len(keys(t))
        out.append((i, n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_line_dedup_against_brute_force(spark):
    r = random.Random(3)
    lines = [f"Line {i} é" for i in range(30)] + ["", "  ", "\t", " "]
    rows = [(i, "\n".join(r.choice(["", " ", "\t"]) + r.choice(lines) + r.choice(["", "\r", " "]) for _ in range(r.randint(1, 6)))) for i in range(60)]
    rows += [(i, "LINE 3 É\nline 3 é") for i in range(60, 64)] + [(100, None), (101, ""), (None, "line 1 é"), (5, "line 2 é\nother"), (5, "line 2 é\nother")]
    for threshold in (4, 10):
        got = line_dedup.digest(line_dedup.dedup_lines(docs_of(spark, rows), threshold)).collect()
        assert Counter(map(tuple, got)) == slow_lines(rows, threshold)
    saved, line_dedup.BROADCAST_BYTES = line_dedup.BROADCAST_BYTES, -1
    try:
        assert Counter(map(tuple, line_dedup.digest(line_dedup.dedup_lines(docs_of(spark, rows), 4)).collect())) == slow_lines(rows, 4)
    finally:
        line_dedup.BROADCAST_BYTES = saved


def test_line_filters_in_shards_and_clashing_columns(spark, odd):
    """Filters that are not broadcast, and documents with columns named like the operator's own."""
    r = random.Random(3)
    lines = [f"line {i}" for i in range(60)]
    rows = [(i, "\n".join(r.sample(lines, r.randint(0, 20)) + [f"own {i}"])) for i in range(120)] + odd_rows()
    schema = "doc_id long, text string, n_lines string, n_dropped int, _doc int, _drop string, doc int, Drop int"
    df = spark.createDataFrame([(i, t, "x", 1, 2, "y", 3, 4) for i, t in rows], schema).repartition(3)
    index = line_dedup.LineIndex.build(df)
    key = lambda d: sorted(map(repr, line_dedup.digest(d).collect()))
    plain = key(line_dedup.dedup_lines(docs_of(spark, rows)))
    for given in (None, 3, 64):
        for size in (1 << 20, 0):
            got = index.clean(df, given, size)
            assert key(got) == plain, (given, size)
    assert set(got.columns) == set(df.columns) and got.first()._drop == "y" and got.first().Drop == 4


def test_line_index_is_reversible(spark, odd):
    one, two = odd.where("doc_id < 20"), odd.where("doc_id >= 20")
    state = lambda x: Counter(map(tuple, x.counts.select("hi", "lo", "n_docs").collect()))
    start = line_dedup.LineIndex.build(one)
    both = start.insert(two)
    assert state(both) == state(line_dedup.LineIndex.build(odd.where("doc_id is not null")))
    assert state(both.delete(two)) == state(start)


def test_cuckoo_filter():
    r = random.Random(2)
    keys = np.array([r.getrandbits(64) for _ in range(5000)], np.uint64)
    f = line_dedup.CuckooFilter.from_bytes(line_dedup.CuckooFilter.of(keys).to_bytes())
    assert f.contains(keys).all()
    others = np.array([r.getrandbits(64) for _ in range(20000)], np.uint64)
    assert f.contains(others).mean() < 0.002
    for k in keys[:2500].tolist():
        assert f.delete(k)
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    path = entry.vocabulary()
    library = Tokenizer.from_file(path)
    for per_part in (20_000, 6):
        got = packing.pack(odd, path, length=64, slack=2, per_part=per_part).collect()
        want = Counter()
        for i, t in odd_rows():
            ids = library.encode(t or "", add_special_tokens=False).ids + [0]
            for k in range(0, len(ids), 64):
                part = np.array(ids[k : k + 64], "<u4")
                want[i, k // 64, k, len(part), zlib.crc32(part.tobytes())] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            at = 0
            for offset, n in sorted(b):
                assert offset == at
                at += n
            assert at <= 64
        assert len(bins) <= sum(r.length for r in got) / 64 * 1.05 + 2


@pytest.mark.parametrize(("tokens", "per_part"), [((1500, 1500), 40), ((300, 700), 25), ((30, 2047), 25)])
def test_packing_rounds_end_without_one_task_for_all(spark, monkeypatch, tokens, per_part):
    r, sizes, held = random.Random(4), [], []
    cut = common.Scratch.cut

    def spy(self, df):
        back = cut(self, df)
        if "done" in df.columns and len(held) < 20:
            held.append([x[0] for x in back.groupBy(F.input_file_name().alias("f")).agg(F.sum(F.size("members"))).select("sum(size(members))").collect()])
        return back

    monkeypatch.setattr(packing.Scratch, "cut", spy)
    word = packing.tokenizer(entry.vocabulary())
    one = len(word("the")) // 4
    rows = [(i, " ".join(["the"] * ((r.randint(*tokens) - 1) // one))) for i in range(300)]
    got = packing.pack(docs_of(spark, rows), entry.vocabulary(), per_part=per_part).collect()
    assert sorted(x.doc_id for x in got) == [i for i, _ in rows]
    bins = defaultdict(list)
    for x in got:
        bins[x.sequence_id].append((x.offset, x.length))
    for b in bins.values():
        b.sort()
        assert all(at == sum(n for _, n in b[:k]) for k, (at, _) in enumerate(b)) and sum(n for _, n in b) <= 2048
    best = len(set(packing.best_fit([x.length for x in got], 2048)))
    assert len(bins) <= 1.1 * best + 1
    if tokens[0] * 2 > 2048:  # nothing can be joined: no task ever gets all
        assert max(max(h) for h in held) <= 3 * per_part, held


def test_word_bpe_equals_the_library():
    bpe = packing.WordBpe(entry.vocabulary())
    texts = ["", " ", "a\x1cb", "ΣΑΣ", "İx é", "<|endoftext|> hi<|endoftext|>", "don't We'LL 12½² ß a_b --'s's", " x\u0085y", "日本 語", "L'été 'tis", "éa ﬁ", "퟿ ªº", "ſ K"]
    for t in texts + [t for _, t in odd_rows() if t]:
        assert bpe(t) == np.array(bpe.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_best_fit():
    assert packing.best_fit([], 10) == []
    r = random.Random(4)
    sizes = [r.randint(1, 9) for _ in range(500)]
    fill = Counter()
    for s, b in zip(sizes, packing.best_fit(sizes, 10)):
        fill[b] += s
    assert max(fill.values()) <= 10 and len(fill) <= -(-sum(sizes) // 10) + 2


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(8)
    plain = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        words = [r.choice(plain) for _ in range(r.randint(20, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "moron", "lowei" + r.choice("abcdef")]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(2000, None), (2001, ""), (None, "an idiot moron and an idiot")]
    docs, marks = docs_of(spark, rows), spark.createDataFrame(labels + [(None, 1), (5000, None)], "doc_id long, toxic int")
    crf = toxicity.fit(docs, marks)
    got = {x.doc_id: x for x in toxicity.tag(docs, crf).collect()}
    assert len(got) == len(rows) and 0 <= got[2000].score < 0.7 and got[2000].score == got[2001].score
    held = [i for i in range(900) if toxicity.fold(i) == 1]
    assert all(got[i].held_out == (toxicity.fold(i) == 1) for i in range(900))
    assert sum(got[i].predicted == dict(labels)[i] for i in held) / len(held) > 0.98
    text = dict(rows)
    assert {text[0][s.begin : s.end][:5] for s in got[0].spans} <= {"idiot", "moron", "lowei"} and got[0].spans
    assert toxicity.reject(docs, crf).where("doc_id is null").count() == 0


def test_forward_backward_equals_enumeration():
    import itertools
    import math

    crf = toxicity.Crf({"w=bad": 2.0, "w=worse": 3.0}, -1.0, -0.5, np.array([[0.1, -0.3], [-0.2, 0.9]]))
    words = ["bad", "x", "y", "worse", "bad", "z"]
    at, scores = crf.emissions(words)
    e = [crf.bias + crf.weights.get("w=" + w, 0.0) for w in words]
    total, one = 0.0, [0.0] * len(words)
    for path in itertools.product((0, 1), repeat=len(words)):
        s = crf.start * path[0] + sum(v * y for v, y in zip(e, path)) + sum(crf.move[a, b] for a, b in zip(path, path[1:]))
        total += math.exp(s)
        for i, y in enumerate(path):
            one[i] += y * math.exp(s)
    assert at == [0, 3, 4]
    assert np.allclose(crf.marginals(len(words), at, scores), [one[i] / total for i in at])
    assert toxicity.Crf({}, -1.0, -1.0, np.zeros((2, 2))).marginals(3, [], []) == []
    assert toxicity.train(["a", "b"], [0, 0]).score([]) < 0.7


@pytest.mark.parametrize("gap", [0, 1, 5, 400, 1000, 3000])
def test_gaps_of_any_length_are_exact(gap):
    """Sticky states: the power over a gap against a step for each of its words."""
    move = np.log(np.array([[0.9995, 0.0005], [0.0004, 0.9996]]))
    crf = toxicity.Crf({"w=bad": 3.0, "w=good": -2.0}, -0.0003, -0.5, move)
    words = ["x", "bad", *["x"] * gap, "good", "x"]
    at, scores = crf.emissions(words)
    emit = [dict(zip(at, scores)).get(i, crf.bias) for i in range(len(words))]
    step, f, b = np.exp(move), [], np.ones(2)
    v = np.array([1.0, math.exp(crf.start + emit[0])])
    for e in [None, *emit[1:]]:
        if e is not None:
            v = (v @ step) * [1.0, math.exp(e)]
        v = v / v.sum()
        f.append(v)
    want = {}
    for i in range(len(words) - 1, -1, -1):
        p = f[i] * b
        want[i] = p[1] / p.sum()
        b = step @ (np.array([1.0, math.exp(emit[i])]) * b)
        b = b / b.sum()
    got = crf.marginals(len(words), at, scores)
    assert at == [1, gap + 2] and np.allclose(got, [want[i] for i in at], atol=1e-9)


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 16))
    base = np.concatenate([base, base[:60] + 0.03 * rng.normal(size=(60, 16)), base[:1] + 0.05 * rng.normal(size=(90, 16)), base[5:6], base[5:6]])
    rows = [(int(i), [float(np.float32(x)) for x in v], int(i) % 2 if i < 200 else 0) for i, v in enumerate(base)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [1.0, None] * 8, 1), (904, rows[0][1], None), (905, [], 0), (906, [float("inf")] * 16, 0)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, home int, shard string").repartition(3)
    result = embed_graph.near_duplicates(df)
    got = {r.vec_id: r for r in result.collect()}
    x = np.array([r[1] for r in rows[: len(base)]], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows[: len(base)]])
    link = (x @ x.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(link, False)
    assert len(got) == len(rows)
    found, exist = sum(got[i].n_links for i in range(len(base))), int(link.sum())
    assert 0.98 * exist <= found <= exist
    want = classes([tuple(map(int, p)) for p in np.argwhere(link)], range(len(base)))
    assert all(got[i].component_id == want[i] for i in want)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 907))
    assert embed_graph.near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(RuntimeError, match="audit"):
        embed_graph.near_duplicates(df, least_recall=1.01)


def test_links_between_two_tight_groups(spark):
    r = np.random.default_rng(3)
    one = np.eye(32)[0]
    two = 0.985 * one + np.sqrt(1 - 0.985**2) * np.eye(32)[1]
    points = np.repeat([one, two], 100, axis=0) + r.normal(0, 0.003, (200, 32))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    want = (points @ points.T >= 0.98).sum(1) - 1
    assert (want == 199).mean() > 0.9
    df = spark.createDataFrame([(i, p.tolist(), 1) for i, p in enumerate(points)], "vec_id long, embedding array<double>, label int")
    got = sorted(embed_graph.near_duplicates(df).collect(), key=lambda x: x.vec_id)
    assert [(x.n_links, x.component_id) for x in got] == [(n, 0) for n in want.tolist()]


def test_a_round_of_the_search_looks_at_beams_not_at_all_points(monkeypatch):
    r, ranked, plain = np.random.default_rng(2), Counter(), np.argpartition
    monkeypatch.setattr(np, "argpartition", lambda x, *a, **k: ranked.update([n]) or ranked.update({n: x.size - 1}) or plain(x, *a, **k))
    for n in (400, 1600):
        points = r.normal(size=(n, 16))
        points[:40] = points[0] + 0.04 * r.normal(size=(40, 16))
        points /= np.linalg.norm(points, axis=1, keepdims=True)
        lists = embed_graph.local_lists(points)
        src = np.argwhere(lists >= 0)
        graph = embed_graph.FlatGraph(points, (src[:, 0], lists[src[:, 0], src[:, 1]]))
        ranked.clear()
        q, y, sims = graph.in_range(np.arange(100), 0.98, 24, 0.02)
        assert set(zip(q.tolist(), y.tolist())) == set(map(tuple, np.argwhere(points[:100] @ points.T >= 0.98 - 1e-4).tolist())) and len(q) > 200
        assert len(q) == len(set(zip(q.tolist(), y.tolist()))) and np.allclose(sims, np.einsum("id,id->i", points[q], points[y]))
        assert ranked[n] < 100 * 40 * 64, ranked


def test_audit_counts_no_copies(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0], 1) for i in range(50)] + [(50, [1.0, 0.01], 1), (51, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert {x.vec_id: x.exact for x in embed_graph.audit(embed_graph.representatives(df)).collect()} == {0: 1, 50: 1, 51: 0}


def test_compact_windows_equal_the_definition():
    r = np.random.default_rng(1)
    for n, width in ((5, 6), (6, 6), (40, 6), (97, 10)):
        s = r.integers(0, 30, n).astype(np.uint64)
        key, c, left, right = passages.compact_windows(s, width, 2)
        got = set(zip((key & np.uint64(7)).tolist(), c.tolist(), left.tolist(), right.tolist()))
        salt = np.arange(1, 3, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        want = set()
        for k in range(2):
            h = [(int(v) & ~int(passages._PLACE), i) for i, v in enumerate(passages._mix(s ^ salt[k]))]
            for i in range(n):
                lo = max((j for j in range(i) if h[j] < h[i]), default=-1) + 1
                hi = min((j for j in range(i + 1, n) if h[j] < h[i]), default=n) - 1
                if hi - lo + 1 >= width:
                    want.add((k, i, lo, hi))
        assert got == want


def test_windows_of_many_texts_at_once_equal_those_of_each():
    r = random.Random(4)
    texts = ["", None, "a b", "One two three four five", "ONE two\tthree\n four five six", "é ñ ü ö ä ß ABC", " lead a b c d e ", "w" * 2_000_000 + " a b c d e", "a b c d e f " * 100_000]
    texts += [" ".join(r.choice("abcdef") * r.randint(1, 3) for _ in range(n)) for n in (49, 50, 51, 200, 900)]
    make = passages.Shingler(5)
    found, begin = make.column(pa.array(["zz", *texts]).slice(1))
    key, *places, text = passages.text_windows(found, begin, 46)
    for i, t in enumerate(texts):
        one = make(t)
        assert np.array_equal(one, found[begin[i] : begin[i + 1]]) and len(one) == max(0, len((t or "").split()) - 4)
        mine = text == i
        got = zip(key[mine].tolist(), *((x[mine] - begin[i]).tolist() for x in places))
        assert set(got) == set(zip(*(x.tolist() for x in passages.compact_windows(one, 46))))
    assert np.array_equal(make("ONE two three four five"), make("one  TWO three\nfour five"))


def test_repeated_passages_against_brute_force(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    text = lambda n: [word() for _ in range(n)]
    shared = [text(n) for n in (50, 60, 120, 49)]
    rows = []
    for i in range(40):
        body = text(r.randint(0, 150))
        for j, part in enumerate(shared):
            if i % 7 == j:
                at = r.randint(0, len(body))
                body = body[:at] + part + body[at:]
        rows.append((i, " ".join(body)))
    near = shared[2][:60] + ["changed"] + shared[2][61:]
    rows += [(100, " ".join(text(20) + near + text(20))), (101, None), (102, ""), (None, " ".join(shared[1])), (103, " ".join(shared[0])), (103, " ".join(shared[0]))]
    got = {x.doc_id: x for x in passages.repeated_passages(docs_of(spark, rows)).collect()}
    grams = {i: {tuple(w[k : k + 50]) for w in [(t or "").lower().split()] for k in range(len(w) - 49)} for i, t in rows if i is not None}
    want = classes([(a, b) for a in grams for b in grams if a < b and grams[a] & grams[b]], grams)
    assert all(got[i].component_id == want[i] for i in grams), {i: (got[i].component_id, want[i]) for i in grams if got[i].component_id != want[i]}
    assert got[100].component_id == got[2].component_id and got[100].n_repeated >= 50
    for i in grams:
        assert (got[i].n_repeated >= 50) == (sum(1 for j in want if want[j] == want[i]) > 1), i
    assert got[3].n_repeated == 0 and passages.repeated_passages(docs_of(spark, [])).count() == 0


def test_changed_passages_in_foreign_context(spark):
    r = random.Random(21)
    text = lambda n: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    rows, want, size = [], [], {}
    for i in range(40):
        n, around = (60, 80, 90)[i % 3], (0, 20, 100)[i // 3 % 3]
        part = text(n)
        other = [*part[: n // 2], *text(i % 2), *text(1), *part[n // 2 + 1 :]]
        rows += [(2 * i, " ".join(text(around) + part + text(around))), (2 * i + 1, " ".join(text(around) + other + text(around)))]
        a, b = grams(part), grams(other)
        want.append(len(a & b) >= 0.8 * len(a | b))
        size[i] = n
    rows += [(100, " ".join(text(80) + (few := text(48)) + text(80))), (101, " ".join(text(80) + few + text(80)))]
    got = {x.doc_id: x for x in passages.repeated_passages(docs_of(spark, rows)).collect()}
    found = [i for i in range(40) if got[2 * i + 1].component_id == 2 * i]
    assert all(want) and len(found) >= 36, (want, found)
    assert all(got[2 * i].n_repeated == size[i] for i in found)
    assert got[100].n_repeated == got[101].n_repeated == 0


def test_passages_among_others_with_their_least_shingles(spark):
    """Documents between two copies hold each of the shingles that the copies' windows are dealt by."""
    r = random.Random(31)
    text = lambda n: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    rows, near, exact = [], [], []
    for trial in range(40):
        one = text(60 if trial % 2 else 50)
        two = [*one[:25], *text(1), *one[26:]] if trial % 2 else one
        base = 1000 * trial
        c = []
        for w in (one, two):
            key, at, _, _ = passages.compact_windows(passages.Shingler(5)(" ".join(w)), 46)
            c += [w[i : i + 5] for i in at.tolist()]
        rows += [(base + 400, " ".join(one)), (base + 600, " ".join(two))]
        for k, few in enumerate(c):
            rows += [(base + at + k, " ".join(text(50) + few + text(50))) for at in (0, 500, 700)]
        (near if trial % 2 else exact).append(base)
    got = {x.doc_id: x for x in passages.repeated_passages(docs_of(spark, rows)).collect()}
    found = lambda some: sum(got[b + 600].component_id == b + 400 for b in some)
    assert found(exact) == len(exact) and found(near) >= 0.9 * len(near), (found(exact), found(near))
    assert all(got[b + 400].n_repeated == got[b + 600].n_repeated == 50 for b in exact)
    assert all(got[i].n_repeated == 0 for i, _ in rows if i % 1000 not in (400, 600))


def test_changed_passages_in_keys_of_many_documents(spark):
    """Each least shingle of two passages with a changed word also lies in twenty documents between and around them."""
    r = random.Random(17)
    text = lambda n: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    rows = []
    for base in range(0, 20_000, 1000):
        one = text(60)
        two = [*one[:30], *text(1), *one[31:]]
        few = [w[i : i + 5] for w in (one, two) for i in passages.compact_windows(passages.Shingler(5)(" ".join(w)), 46)[1].tolist()]
        rows += [(base + 400, " ".join(one)), (base + 600, " ".join(two))]
        rows += [(base + at + k, " ".join(text(50) + w + text(50))) for k, w in enumerate(few) for at in range(0, 1000, 50) if at not in (400, 600)]
    got = {x.doc_id: x for x in passages.repeated_passages(docs_of(spark, rows)).collect()}
    lost = [b for b in range(0, 20_000, 1000) if got[b + 600].component_id != b + 400 or min(got[b + 400].n_repeated, got[b + 600].n_repeated) < 60]
    assert not lost, lost
    assert all(got[i].n_repeated == 0 for i, _ in rows if i % 1000 not in (400, 600))


def test_windows_of_large_keys_against_all_pairs():
    r = np.random.default_rng(3)
    for trial in range(12):
        key, doc, centre, h = [], [], [], []
        for k in range(3):
            base = r.integers(0, 1 << 30, (4, 91))
            for d in sorted(r.integers(0, 25, 40).tolist()):
                w = base[r.integers(0, 4)].copy()
                change = r.random(91) < (0.02, 0.05, 0.4)[r.integers(0, 3)]
                w[change] = r.integers(0, 1 << 30, change.sum() if r.random() < 0.8 else 1)
                c, left = 45, int(r.integers(0, 46))
                if trial % 3 == 1:  # words left out
                    at = int(r.integers(0, 85))
                    w, c = np.delete(w, slice(at, at + 3)), c - (3 if at < 43 else 0)
                if trial % 3 == 2:  # few different shingles
                    w[30:85] = w[30 + r.integers(0, 3)]
                w[c] = k
                w = w[left:]
                key, doc, centre, h = [*key, k], [*doc, d], [*centre, c - left], [*h, w]
        size = np.array([len(x) for x in h])
        ok = (size >= 46) & (np.array(centre) >= 0)
        key, doc, centre, size = (np.array(x)[ok] for x in (key, doc, centre, size))
        h = [x.astype(np.int32) for x, y in zip(h, ok) if y]
        i, j = passages.near_windows(key, doc, centre, np.concatenate(h), size, 46, 0.8)
        passage = lambda x, y: passages.matches(h[x].astype(np.int64), h[y].astype(np.int64), 46, 0.8, int(centre[y] - centre[x]))  # noqa: B023, E731
        true = [(x, y) for x in range(len(h)) for y in range(len(h)) if key[x] == key[y] and doc[x] != doc[y] and passage(x, y)]
        node = lambda x: (int(key[x]), int(doc[x]))  # noqa: B023, E731
        nodes = {node(x) for x in range(len(h))}
        got = list(zip(i.tolist(), j.tolist()))
        assert all(passage(*p) for p in got)
        assert classes([(node(x), node(y)) for x, y in got], nodes) == classes([(node(x), node(y)) for x, y in true], nodes)
        covered = [[{(x, p) for x, y in some for b, e, _, _ in passage(x, y) for p in range(b, e)}, {(y, p) for x, y in some for _, _, b, e in passage(x, y) for p in range(b, e)}] for some in (got, true)]
        shared = {(x, p) for x in range(len(h)) for p in range(len(h[x])) if any(key[y] == key[x] and doc[y] != doc[x] and h[x][p] in h[y] for y in range(len(h)))}
        assert (covered[0][0] | covered[0][1]) & shared == (covered[1][0] | covered[1][1]) & shared


def test_windows_with_spread_common_shingles_are_not_asked(monkeypatch):
    """Windows with repeats share many shingles with others, but nowhere enough of them close together."""
    r = np.random.default_rng(5)
    few, calls, matches = np.arange(1, 41), [], passages.matches
    monkeypatch.setattr(passages, "matches", lambda *x: calls.append(1) or matches(*x))
    h = [np.concatenate([few, few, few[:11]]) for _ in range(20)]
    for _ in range(100):
        w = r.integers(1000, 1 << 30, 91)
        w[np.sort(r.permutation(np.arange(1, 90, 2))[:40])] = few
        h.append(w)
    n = len(h)
    i, j = passages.near_windows(np.zeros(n, np.int64), np.arange(n), np.full(n, 45), np.concatenate(h).astype(np.int32), np.full(n, 91), 46, 0.8)
    assert classes(list(zip(i.tolist(), j.tolist())), range(n)) == {x: 0 if x < 20 else x for x in range(n)}
    assert len(calls) < 500


def test_families_of_copies_with_a_shared_head(spark):
    r = random.Random(8)
    text = lambda n: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    rows, family, spans = [], {}, {}
    for trial in range(30):
        head = text((30, 28, 40)[trial % 3])
        bodies = [head + text((60, 55, 60)[trial % 3] - len(head)) for _ in range(10)]
        for i in range(40):
            doc, k = 1000 * trial + i, i % 10
            family[doc], spans[doc] = 1000 * trial + k, len(bodies[k])
            rows.append((doc, " ".join(text(30) + bodies[k] + text(30))))
    rows += [(90_000, " ".join((twice := text(50)) + text(20) + twice)), (90_001, " ".join(text(9) + twice))]
    got = {x.doc_id: x for x in passages.repeated_passages(docs_of(spark, rows)).collect()}
    assert {i: got[i].component_id for i in family} == family
    assert all(got[i].n_repeated >= n for i, n in spans.items())
    assert (got[90_000].n_repeated, got[90_001].component_id, got[90_001].n_repeated) == (100, 90_000, 50)


def test_matches_against_brute_force():
    r = np.random.default_rng(4)
    for _ in range(60):
        a = r.integers(0, 1 << 40, 40)
        b = np.concatenate([r.integers(0, 1 << 40, r.integers(0, 6)), np.delete(np.where(r.random(40) < 0.12, -1 - np.arange(40), a), r.integers(0, 40, 2)), r.integers(0, 1 << 40, 5)])
        true = set()
        for i in range(len(a)):
            for e in range(i + 12, len(a) + 1):
                for j in range(len(b)):
                    if a[i] == b[j] and (ends := np.flatnonzero(b == a[e - 1])).size and ends[0] - j >= 11:
                        one, two = set(a[i:e].tolist()), set(b[j : ends[0] + 1].tolist())
                        if len(one & two) >= 0.8 * len(one | two):
                            true |= set(range(i, e))
        assert {k for x, y, _, _ in passages.matches(a, b, 12, 0.8) for k in range(x, y)} == true


def test_licenses(spark):
    apache = licenses.SENTENCES
    rows = [
        (1, "Licensed under the Apache License, Version 2.0.\nText."), (2, "text. all RIGHTS reserved. More"), (3, None), (4, ""),
        (5, f"{apache['mit-permission']}\n\n{apache['mit-notice']}\n{apache['as-is']}"), (6, f"{apache['mit-notice']} {apache['mit-permission']}"),
        (7, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (8, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
        (9, "Licensed under CC BY-NC 4.0 and more."), (7, "Licensed under CC BY-NC 4.0."), (10, "\n".join(["x y z."] * 20_000) + "\nReleased under the MIT License"),
    ]
    got = sorted((r.doc_id, r.licences, [m.rule for m in r.matches]) for r in licenses.scan(docs_of(spark, rows)).collect())
    names = [(i, x) for i, x, _ in got]
    assert names == [(1, "Apache-2.0"), (2, "LicenseRef-proprietary"), (3, ""), (4, ""), (5, "MIT"), (6, ""), (7, "CC-BY-NC-4.0"), (7, "CC-BY-NC-4.0,MIT"), (8, "MPL-2.0"), (9, ""), (10, "MIT")]
    assert [licenses.RULES[m][1] for m in got[4][2]] == [["mit-permission", "mit-notice", "as-is"]]


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
APACHE = """Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def test_licenses_against_a_plain_loop(spark):
    """Texts of known sentences, marks, list numbers, wrapped lines and other words, read by definition."""
    r = random.Random(17)
    known = {n: licenses.normalise(t) for n, t in licenses.SENTENCES.items()}

    def plain(text):
        lines, out = text.translate(licenses.LOWER), []
        parts, at = [], 0
        for m in [*re.finditer(r"\n|[.!?:;]+[ \t-\r]+", lines), None]:
            s = lines[at : m.start() if m else len(lines)]
            if s.strip(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2003"):
                parts.append((s, at))
            at = m.end() if m else at
        gap = [lines.count("\n", parts[k][1] + len(parts[k][0]), parts[k + 1][1]) > 1 for k in range(len(parts) - 1)] + [True]
        k = 0
        while k < len(parts):
            s = parts[k][0]
            if not re.search(r"[^\W_]", s) or (len(s) < 12 and re.fullmatch(r"[^a-z0-9]*([0-9]{1,2}|[a-z])\)?", s, re.ASCII)):
                k += 1
                continue
            s, best = re.sub(r"^[^a-z0-9]*([0-9]{1,2}|[a-z])\)\s+", "", s), None
            for n, want in known.items():
                have, used = licenses.normalise(s), 1
                while have != want and want.startswith(have + " ") and k + used < len(parts) and not gap[k + used - 1] and (more := licenses.normalise(parts[k + used][0])):
                    have, used = f"{have} {more}", used + 1
                if have == want and (best is None or len(want) > len(best[2])):
                    best = (n, used, want)
            out.append(best[0] if best else None)
            k += best[1] if best else 1
        hits, k = [], 0
        while k < len(out):
            fits = [(-len(ids), n, lic) for n, (lic, ids) in enumerate(licenses.RULES) if out[k : k + len(ids)] == ids]
            if fits:
                hits.append(min(fits)[1:])
                k -= min(fits)[0]
            else:
                k += 1
        return hits, sum(x is not None for x in out)

    names, rows = list(licenses.SENTENCES), []
    for i in range(300):
        text = ""
        rule = r.choice(licenses.RULES)[1] if r.random() < 0.7 else r.sample(names, 3)
        for n in [*rule, *r.sample(names, r.randint(0, 2))]:
            s = licenses.SENTENCES[n]
            if r.random() < 0.3:
                s = s.upper()
            if r.random() < 0.4:
                words = s.split(" ")
                s = "".join(w + r.choice([" ", " ", "\n", " \n # "]) for w in words[:-1]) + words[-1]
            s = r.choice(["", "", "“", "© ", "— ", "1. ", "a) ", "(b) ", "* ", "...", "日本 ", "other "]) + s + r.choice(["", "", "”", " ...", " more"])
            text += s + r.choice(["\n", " ", "\n\n", " \n\t", "\nBut something else. ", "\n***\n", "\n日本語。\n"])
        rows.append((i, text))
    rows += [(900, "“All rights reserved.”"), (901, "© All rights reserved."), (902, "— Released under the MIT License.")]
    got = {x.doc_id: x for x in licenses.scan(docs_of(spark, rows)).collect()}
    for i, text in rows:
        hits, n = plain(text)
        assert ([(m.rule, m.licence) for m in got[i].matches], got[i].n_known) == (hits, n), text
    assert [got[i].licences for i in (900, 901, 902)] == ["LicenseRef-proprietary", "LicenseRef-proprietary", "MIT"]
    assert licenses.scan(docs_of(spark, [])).count() == 0


def test_licenses_in_their_printed_form(spark):
    comment = lambda text: "\n".join(f" * {x}" for x in text.split("\n"))
    torn = MIT.replace("obtaining a copy\n", "obtaining a copy\n\n")
    texts = [MIT, BSD, BSD + BSD3, GPL, APACHE, comment(MIT), comment(BSD + BSD3), (BSD + BSD3).replace("1. ", "(1) ").replace("2. ", "b) "), torn, "Licensed under CC BY-NC\n4.0 and more.", GPL.replace("any later", "no later"), "foo\n\n" + BSD + "more text.\n" + BSD3]
    got = {r.doc_id: (r.licences, [licenses.RULES[m.rule][1] for m in r.matches]) for r in licenses.scan(docs_of(spark, list(enumerate(texts)))).collect()}
    assert [got[i][0] for i in range(len(texts))] == ["MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0-or-later", "Apache-2.0", "MIT", "BSD-3-Clause", "BSD-3-Clause", "", "", "", "BSD-2-Clause"]
    assert got[0][1] == got[5][1] == [["mit-permission", "mit-notice", "as-is"]] and got[3][1] == [["gpl-free", "gpl-warranty"]]


def test_chat_links(spark):
    call = json.dumps({"tool_calls": [{"id": "a", "name": "add", "arguments": {"y": 2, "x": 1}}, {"id": "b", "name": "add", "arguments": {"x": "no"}, "depends_on": ["a"]}]})
    later = json.dumps({"tool_calls": [{"id": "c", "name": "add", "arguments": {"x": 1, "y": 1.5}, "depends_on": ["a"]}, {"id": "d", "name": "none", "arguments": {}, "depends_on": ["zz"]}]})
    rows = [
        (1, 0, "user", 'hi "you"\n'), (1, 1, "assistant", call), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "3"})), (1, 3, "assistant", later),
        (1, 4, "tool", json.dumps({"tool_call_id": "lost", "content": None})), (2, 0, "tool", json.dumps({"tool_call_id": "a", "content": "x"})), (None, None, None, None), (2, 1, "assistant", ""),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "3"})),
    ]
    schemas = {"add": {"properties": {"x": {"type": "integer"}, "y": {"type": "number"}}, "required": ["x", "y"]}}
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, kind int")
    got = chat_tools.link(chat_tools.json_events(df), schemas).collect()
    assert len(got) == len(rows) + 2
    calls = {r.call_id: r for r in got if r.kind == "call"}
    assert (calls["a"].linked, calls["a"].valid, calls["a"].ordered) == (True, True, True)
    assert (calls["b"].linked, calls["b"].valid, calls["b"].ordered) == (False, False, False)
    assert (calls["c"].valid, calls["c"].ordered) == (True, True) and (calls["d"].valid, calls["d"].ordered) == (False, False)
    assert calls["a"].json == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","role":"assistant"}'
    results = {(r.conv_id, r.call_id): r.linked for r in got if r.kind == "result"}
    assert results == {(1, "a"): True, (1, "lost"): False, (2, "a"): False}
    assert [r.json for r in got if r.role == "user"] == ['{"content":"hi \\"you\\"\\n","role":"user"}']
    turns = chat_tools.format_chats(df)
    assert turns.count() == len(rows) and "Python" not in turns._jdf.queryExecution().toString()


def test_tool_calls_in_order_of_dependence(spark):
    """Random conversations with forward, missing and cyclic dependencies: every order that can be kept is."""
    r, rows, deps, places = random.Random(6), [], {}, {}
    for conv in range(40):
        for k in range(8):
            some = [f"c{x}" for x in range(8) if x != k and (r.random() < 0.25 if x < k else r.random() < 0.05 * (conv % 4))]
            some += ["gone"] * (r.random() < 0.1)
            call = {"tool_calls": [{"id": f"c{k}", "name": "f", "arguments": {}, "depends_on": some}]}
            rows.append((conv, 2 * k, "assistant", json.dumps(call)))
            deps[conv, f"c{k}"] = some
            if r.random() < 0.8:
                rows.append((conv, 2 * k + (1 if r.random() < 0.9 else -1), "tool", json.dumps({"tool_call_id": f"c{k}", "content": "x"})))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = chat_tools.format_conversations(df).collect()
    calls = {(x.conv_id, x.call_id): x for x in got if x.kind == "call"}
    order = lambda x: (x.place_turn, x.place_seq, x.place_hops)
    results = {(x.conv_id, x.call_id): x for x in got if x.kind == "result"}

    def reach(conv, a):
        seen, todo = set(), list(deps[conv, a])
        while todo:
            if (x := todo.pop()) not in seen and (conv, x) in deps:
                seen.add(x)
                todo += deps[conv, x]
        return seen

    loops = {(c, a) for c, a in deps if a in reach(c, a)}
    assert loops and loops <= {k for k, x in calls.items() if x.cyclic}
    for (conv, a), x in calls.items():
        if x.cyclic:
            assert any((conv, b) in loops for b in {a, *reach(conv, a)})
            continue
        for b in deps[conv, a]:
            if (conv, b) in calls:
                assert order(x) > order(calls[conv, b])
                assert (conv, b) not in results or order(x) > order(results[conv, b])
        if (conv, a) in results:
            assert order(results[conv, a]) > order(x)
    in_step = [x for x in calls.values() if x.ordered and not x.cyclic and (x.place_turn, x.place_hops) == (x.turn, 0)]
    assert len(in_step) > 100


def test_nested_schemas(spark):
    schema = {
        "properties": {
            "mode": {"type": "string", "enum": ["fast", "slow"]}, "at": {"type": "object", "properties": {"x": {"type": "integer"}, "tag": {"type": "null"}}, "required": ["x"]},
            "list": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "number"}}, "required": ["n"]}},
        }, "required": ["mode"],
    }
    cases = [
        ({"mode": "fast"}, True), ({"mode": "other"}, False), ({}, False), ({"mode": "slow", "at": {"x": 1}}, True), ({"mode": "slow", "at": {"x": "1"}}, False), ({"mode": "slow", "at": {}}, False),
        ({"mode": "slow", "at": {"x": 1, "y": 2}}, False), ({"mode": "slow", "at": {"x": 1, "tag": None}}, True), ({"mode": "slow", "at": None}, False), ({"mode": "fast", "list": []}, True),
        ({"mode": "fast", "list": [{"n": 1}, {"n": 1.5}]}, True), ({"mode": "fast", "list": [{"n": 1}, {"n": "x"}]}, False), ({"mode": "fast", "list": [{}]}, False), ({"mode": "fast", "list": {"n": 1}}, False), ([1], False), (None, False),
    ]
    rows = [(i, "t", json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(len(cases), "t", "no json"), (len(cases) + 1, "u", "{}"), (len(cases) + 2, "t", None)]
    df = spark.createDataFrame(rows, "i int, name string, arguments string")
    got = [x.v for x in df.select("i", chat_tools.valid_arguments({"t": schema}).alias("v")).orderBy("i").collect()]
    assert got == [w for _, w in cases] + [False] * 3


def test_queries_cover_every_row(spark, sf):
    tables = {"op4_embedding_dedup": "embeddings", "op10_chat_tools": "conversations"}
    for name, query in entry.QUERIES.items():
        if name != "op3_packing":
            assert query(spark, sf).count() == spark.read.parquet(f"{sf}/{tables.get(name, 'documents')}.parquet").count(), name
    assert all(isinstance(f.dataType, T.DataType) for f in entry.op3_packing(spark, sf).schema)


@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_oracle(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = entry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.ORACLE_SQL[name]})").fetchall()
    assert Counter(map(repr, want)) == Counter(repr(tuple(r)) for r in df.select(*columns).collect())


def test_slices_hold_all_rows_in_bounded_slices():
    from gneiss.llm import common

    texts = ["x" * (common.BYTES_AT_ONCE + 9 if i % 997 == 0 else i % 3000) for i in range(4000)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    found = list(common.slices(batch))
    assert pa.Table.from_batches(found).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows == 1 or p.num_rows <= common.ROWS_AT_ONCE and p.nbytes <= common.BYTES_AT_ONCE for p in found)
    assert list(common.slices(batch.slice(0, 0))) == []
