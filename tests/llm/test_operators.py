"""The corpus operators against brute force, on hard rows and on the smallest tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence_engine.llm import bin_completion, bitsliced_topk, license_rules, maxent_lm, oracle, piece_codec, quality_cascade, queries, sharding, simhash_tiles, toxic_lexicon, warc_chunks
from evidence_engine.llm.shared import connected_components, fresh_path, spanning_stars, table
from tests.llm.conftest import hard_texts

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def rows(df):
    return [tuple(r) for r in df.collect()]


def both(hard, spark, sf):
    """Pairs of (id, text), of the hard rows and of the documents."""
    yield hard, [(r[0], r[1]) for r in hard_texts()]
    docs = table(spark, sf, "documents")
    yield docs, rows(docs.select("doc_id", "text"))


def key(r):
    return tuple((x is None, str(x)) for x in r)


# 1


def brute_top(data, k=5):
    good = []
    for i, v in data:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(256 * float(x)) for x in v]))
    asked = {}
    for i, v in good:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, w in asked.items():
        found = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in good if i != q)
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def test_top_k_brute(spark, sf):
    df = table(spark, sf, "embeddings")
    assert sorted(rows(queries.op1_exact_topk(spark, sf))) == brute_top(rows(df.select("vec_id", "embedding")))


def test_top_k_hard(spark):
    rng = random.Random(3)
    data = [(i, [float(np.float32(rng.uniform(-1, 1))) for _ in range(5)]) for i in range(130)]
    data += [(200 + i, [0.5] * 5) for i in range(40)] + [(400, None), (401, [0.5, None, 0.0, 0.0, 0.0]), (402, [math.nan] * 5), (403, [math.inf] * 5), (None, [1.0] * 5), (50, data[50][1]), (404, []), (450, [1.0]), (451, [-3000.25, 2000.0, 0.0, 1.0, 7.0]), (500, [0.0] * 5), (501, [2.0**40] * 5), (502, [-(2.0**43), 0.0, 0.25, 1.0, 2.0**43]), (503, [2.0**44, -(2.0**44), 1e-300, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "a") for i, v in data], "vec_id long, embedding array<float>, id int, score string").repartition(5)
    for block, asked in ((16, 2), (8192, 256)):
        got = bitsliced_topk.top_k(df, df.where("vec_id % 50 = 0"), 5, 256, block_rows=block, query_rows=asked)
        assert sorted(rows(got)) == brute_top(data)
    none = df.limit(0)
    assert rows(bitsliced_topk.top_k(none, none)) == []
    few = df.where("vec_id in (0, 1, 2)")
    assert sorted(rows(bitsliced_topk.top_k(few, few.where("vec_id = 0")))) == brute_top([d for d in data if d[0] in (0, 1, 2)])


def test_top_k_repeated_ids_with_an_invalid_vector(spark):
    data = [(0, [1.0, 2.0]), (0, [None, 1.0]), (50, [-1e9, 0.0]), (50, [0.5, -1.0]), (100, [math.nan, 0.0]), (100, [-math.inf, 1.0]), *((i, [i / 7, 3.0 - i]) for i in range(1, 9))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    assert sorted(rows(bitsliced_topk.top_k(df, df.where("vec_id % 50 = 0"), 5, 256))) == brute_top(data)


def test_top_k_beyond_64_bits(spark):
    data = [(0, [1.0, 0.5, 2.0]), (50, [3.0, 1.0, 0.0]), (100, [2.0**40, 2.0**40, 1.0]), (1, [-1e30, -1e300, 0.0]), (2, [-(2.0**60), 2.0**60, 1.0]), (3, [1e18, -1e18, 2.0]), *((i, [-i / 3, -2.0, i / 7]) for i in range(4, 12))]
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame(data, schema)
    asked = df.where("vec_id in (0, 50)")
    few = [d for d in data if d[0] not in (2, 3)]
    for block in (4, 8192):
        got = bitsliced_topk.top_k(spark.createDataFrame(few, schema), asked, 5, 256, block_rows=block)
        assert sorted(rows(got)) == [x for x in brute_top(few) if x[0] != 100]
    one = [d for d in data if d[0] not in (0, 50, 100, 1)]  # large numbers that cancel out
    got = bitsliced_topk.top_k(spark.createDataFrame([d for d in one if d[0] != 2], schema), spark.createDataFrame([(0, [1.0, 1.0, 1.0])], schema), 5, 256)
    assert sorted(rows(got)) == [x for x in brute_top([(0, [1.0, 1.0, 1.0]), *(d for d in one if d[0] != 2)])]
    with pytest.raises(Exception, match="doesn't fit a long"):
        bitsliced_topk.top_k(df, spark.createDataFrame([(7, [-1.0, -1.0, 0.0])], schema), 1, 256).collect()


# 2


def test_pieces(hard, none, spark, sf):
    import sentencepiece

    model = queries.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    for df, data in both(hard, spark, sf):
        want = []
        for i, t in data:
            ids = sp.encode(t or "")
            want.append((i, len(ids), ids, sp.decode(ids)))
        assert sorted(rows(piece_codec.encode(df, model)), key=key) == sorted(want, key=key)
        digest = [(i, n, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for i, n, ids, d in want]
        assert sorted(rows(piece_codec.encode(df, model, digest=True)), key=key) == sorted(digest, key=key)
    assert rows(piece_codec.encode(none, model)) == []


def test_piece_table_bound():
    model = queries.tokenizer_path("piece_bpe_32k.model")
    small, big = piece_codec.ChunkTable(model, max_entries=7, max_key=4), piece_codec.ChunkTable(model)
    for _, t in [(0, " ".join(f"w{i} longer{i}" for i in range(50))), *((r[0], r[1]) for r in hard_texts())]:
        assert small.encode((t or "")[:5000]) == big.encode((t or "")[:5000])


# 3


def check_shards(got, data, n=8):
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r[:3] for r in got), key=key) == sorted(((i, size(t), zlib.crc32((t or "").encode())) for i, t in data), key=key)
    order = sorted(got, key=lambda r: (r[3], r[4]))
    assert [r[4] for r in order] == [k for s in range(n) for k in range(sum(r[3] == s for r in got))]
    ids = [(r[0] is not None, r[0] or 0) for r in order]
    assert ids == sorted(ids)
    total, at = sum(r[1] for r in got), 0
    for _, b, _, shard, _ in order:
        assert shard == min(n - 1, n * (2 * at + b) // (2 * total))
        at += b


def test_shards(hard, none, spark, sf, tmp_path):
    for df, data in both(hard, spark, sf):
        check_shards(rows(sharding.assign_shards(df)), data)
    assert rows(sharding.assign_shards(none)) == []
    docs = table(spark, sf, "documents")
    sharding.write_shards(docs, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4


# 4


def brute_base(t):
    t = t or ""
    w = WORD.findall(t.encode())
    lines = [x for x in t.split("\n") if WORD.search(x.encode())]
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_quality(hard, none, spark, sf):
    for df, data in both(hard, spark, sf):
        got = rows(quality_cascade.judge(df))
        want = []
        for i, t in data:
            base = brute_base(t)
            x = quality_cascade.Texts.of([t])
            failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
            kept = not failed and not any(rule(x, np.array([0]))[0] for rule in quality_cascade.RULES.values())
            want.append((i, *base, failed, kept))
        assert sorted(got, key=key) == sorted(want, key=key)
        backwards = quality_cascade.judge(df, order=list(quality_cascade.RULES)[::-1])
        assert sorted(rows(backwards), key=key) == sorted(want, key=key)
        good = quality_cascade.keep_good(df)
        assert good.columns == df.columns and good.count() == sum(w[-1] for w in want)
    assert rows(quality_cascade.judge(none)) == [] and rows(quality_cascade.keep_good(none)) == []


# 5


def brute_simhash(t, k):
    import xxhash

    w = [x.lower() for x in WORD.findall((t or "").encode())]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(data, k, radius):
    fp = [brute_simhash(t, k) for _, t in data]
    root = list(range(len(fp)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f"{fp[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(data)]


def test_simhash(hard, none, spark, sf):
    for df, data in both(hard, spark, sf):
        got = [(i, f"{fp & (2**64 - 1):016x}", c) for i, fp, c in rows(simhash_tiles.near_duplicates(df))]
        assert sorted(got, key=key) == sorted(brute_components(data, 4, 4), key=key)
    assert rows(simhash_tiles.near_duplicates(none)) == []
    assert {r["fingerprint"] for r in queries.op5_simhash_dedup(spark, sf).collect()} == {x[1] for x in brute_components(data, 4, 4)}


def test_drop_near_duplicates(hard, none, spark, sf):
    docs = table(spark, sf, "documents")
    left = simhash_tiles.drop_near_duplicates(docs)
    want = {c for _, _, c in brute_components(rows(docs.select("doc_id", "text")), 4, 4)}
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(want)
    ids = [r["doc_id"] for r in simhash_tiles.drop_near_duplicates(hard).collect()]
    assert ids.count(None) == 2 and all(ids.count(i) == 1 for i in ids if i is not None) and 2 not in ids and 3 not in [i for i in ids if i == 3][1:]
    assert rows(simhash_tiles.drop_near_duplicates(none)) == []


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(i) for i in rng.choice(63, rng.integers(1, 7), replace=False))) for b in base for _ in range(4)]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64), np.array([0, 1, 2**63, 2**64 - 1], np.uint64)]))
    links = [(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if int(a ^ b).bit_count() <= 4]
    u, v = spanning_stars(np.array([a for a, _ in links], np.uint64), np.array([b for _, b in links], np.uint64))
    want = dict(zip(u.tolist(), v.tolist()))
    df = spark.createDataFrame([(int(x.view(np.int64)),) for x in fps], "fp long")
    found = simhash_tiles.linked_fingerprints(df, 4, tile_rows=64)
    a, b = zip(*[(r[0] % 2**64, r[1] % 2**64) for r in found.collect()])
    u, v = spanning_stars(np.array(a, np.uint64), np.array(b, np.uint64))
    assert dict(zip(u.tolist(), v.tolist())) == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)] + [(7, 7), (-5, 9), (9, -5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = sorted((x, find(x)) for x in root if find(x) != x)
    assert sorted(rows(connected_components(spark.createDataFrame(edges, "u long, v long"), "t"))) == want
    assert rows(connected_components(spark.createDataFrame([], "u long, v long"), "t")) == []


# 6


def check_packing(got, data, capacity=4096):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    want = []
    for i, text in data:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(i, p, at, len(part := ids[at : at + capacity]), zlib.crc32(np.array(part, "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), capacity))]
    assert sorted((r[:5] for r in got), key=key) == sorted(want, key=key)
    used = {}
    for r in got:
        used.setdefault(r[5], []).append((r[6], r[3]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used), -(-sum(r[3] for r in got) // capacity)


def test_packing(hard, none, spark, sf):
    path = queries.tokenizer_path("word_bpe_49k.json")
    for df, data in both(hard, spark, sf):
        bins, least = check_packing(rows(bin_completion.pack(df, path)), data)
        assert bins <= least + 1
    assert rows(bin_completion.pack(none, path)) == []
    with_ids = bin_completion.pack(hard, path, capacity=64, with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in with_ids)


def brute_bins(sizes, capacity):
    """Fewest bins, by trying all."""
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= sizes[i]:
                left = list(rooms)
                left.remove(r)
                go(i + 1, [*left, r - sizes[i]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


def test_bin_completion_is_exact_on_small():
    rng = random.Random(11)
    better = 0
    for _ in range(150):
        sizes = [rng.choice((rng.randint(1, 20), rng.randint(5, 13))) for _ in range(rng.randint(1, 11))]
        plan, said = bin_completion.complete_bins(dict(Counter(sizes)), 20)
        assert Counter(s for b, p in plan for s in p for _ in range(b)) == Counter(sizes) and all(sum(p) <= 20 for _, p in plan)
        assert sum(b for b, _ in plan) == said["bins"] >= said["lower_bound"]
        assert said["bins"] == brute_bins(sizes, 20)
        better += said["bins"] < said["best_fit_bins"]
    hard_case = {s: 1 for s in ()} | dict(Counter([44, 24, 24, 22, 21, 17, 8, 8, 6, 6, 100, 50, 50, 35, 35, 30]))
    plan, said = bin_completion.complete_bins(hard_case, 100)
    assert said["bins"] == said["lower_bound"]


def test_bin_completion_beats_best_fit():
    rng = random.Random(0)
    sizes = Counter(rng.randint(1000, 2100) for _ in range(3000))
    many = {s: rng.randint(1, 1000) for s in range(1200, 2400, 3)}
    for counts, capacity, fewer in ((sizes, 4096, 1), (many, 4096, 0)):
        plan, said = bin_completion.complete_bins(dict(counts), capacity)
        used = Counter()
        for b, p in plan:
            assert sum(p) <= capacity
            for s in p:
                used[s] += b
        assert used == Counter(counts) and sum(b for b, _ in plan) == said["bins"]
        assert said["lower_bound"] <= said["bins"] <= said["best_fit_bins"] - fewer, said


def test_lower_bound():
    rng = random.Random(4)
    for _ in range(200):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        bound = bin_completion.lower_bound(dict(Counter(sizes)), 20)
        assert -(-sum(sizes) // 20) <= bound <= brute_bins(sizes, 20)


def test_fillings_are_all_undominated_ones():
    rng = random.Random(8)
    for _ in range(60):
        counts = dict(Counter(rng.randint(2, 12) for _ in range(rng.randint(1, 8))))
        got = list(bin_completion.fillings(counts, 15))
        every = {()}
        for s, n in counts.items():
            every = {tuple(sorted((*x, *(s,) * k))) for x in every for k in range(n + 1)}
        every = {x for x in every if sum(x) <= 15}
        assert len(set(got)) == len(got) and set(got) <= every and [15 - sum(x) for x in got] == sorted(15 - sum(x) for x in got)

        def covered(x, y):
            """Whether each piece of x can go into the place of a piece of y, several into one."""
            if not x:
                return True
            return any(p >= x[0] and covered(x[1:], y[:i] + (p - x[0],) + y[i + 1 :]) for i, p in enumerate(y))

        assert all(any(covered(x[::-1], y) for y in got) for x in every)


def test_words_of_any_letters():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    t, words, rng = Tokenizer.from_file(path), bin_completion.WordTable(path), random.Random(1)
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000 and chr(c) not in " \t\n\v\f\r"]
    letters, others = [c for c in points if chr(c).isalpha()], [c for c in points if not chr(c).isalnum()]
    texts = ["\u092a\u095d. \u092c\u095c, \u05d1\ufb31. \u0130.", "\u0130\u0130! <|endoftext|>. a<|startoftext|>b", "<|ENDOFTEXT|>, A. <|EndOfText|>!", "W\u030a, W\u030a! O. \u212a. don't, IT'S! a,'s x,. don't,, \u00c9t\u00e9, word!!"]
    for _ in range(2500):
        one = lambda: "".join(chr(rng.choice(rng.choice((letters, letters, points, others)))) for _ in range(rng.randint(1, 4))) + "".join(rng.choice("!.,;)]\"'s") for _ in range(rng.randint(0, 2)))
        texts.append(rng.choice((" ", "  ", "\n")).join(one() for _ in range(rng.randint(1, 8))))
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        assert words.encode(part) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in part]


def test_best_fit_uses_all():
    rng = random.Random(2)
    counts = {s: rng.randint(1, 400) for s in range(1, 300)}
    plan = bin_completion.best_fit_decreasing(counts, 512)
    used = Counter()
    for b, p in plan:
        assert sum(p) <= 512
        for s in p:
            used[s] += b
    assert used == Counter(counts)
    assert sum(b for b, _ in plan) <= 1.001 * bin_completion.lower_bound(counts, 512)


# 7


def test_warc(spark, sf):
    pages = table(spark, sf, "pages")
    data = rows(pages.select("page_id", "html"))
    check_warc(rows(queries.op7_warc(spark, sf)), data)


def check_warc(got, data):
    largest = {}
    for i, h in data:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            largest[b] = max(largest.get(b, i), i)
    want = []
    for i, h in data:
        b = (h or "").encode()
        keeper = largest.get(b)
        revisit = keeper is not None and i != keeper
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_warc_chunks_of_production_size(spark):
    long = "é" * (3 * warc_chunks.CHUNK + 5) + "\r\n\r\n" + "x" * 100
    df = spark.createDataFrame([(1, "u", long), (2, "u", long), (3, "u", "short")], "page_id long, url string, html string")
    path = fresh_path(spark, "warc-long")
    warc_chunks.write_archives(warc_chunks.plan_records(df), path)
    check_warc(rows(warc_chunks.read_records(spark, path)), [(1, long), (2, long), (3, "short")])
    chunks = warc_chunks.read_chunks(spark, path).where("page_id = 2").orderBy("chunk_number").collect()
    raw, size = long.encode(), 2 * warc_chunks.CHUNK
    assert [(r["chunk_number"], r["last"]) for r in chunks] == [(1, False), (2, False), (3, False), (4, True)]
    assert [r["digest_so_far"] for r in chunks] == [hashlib.sha1(raw[: size * k]).hexdigest() for k in (1, 2, 3, 4)] and chunks[-1]["bytes_so_far"] == len(raw)


def test_warc_of_many_chunks(spark):
    """Work is linear in a payload, and no row holds more than a chunk."""
    long = "".join(f"{k} é\r\n" for k in range(120_000))
    size = len(long) // 64 + 1
    df = spark.createDataFrame([(1, "u", long), (2, "u", "x" + long), (3, "u", long)], "page_id long, url string, html string")
    plan = warc_chunks.plan_records(df)
    found = warc_chunks.chunk_rows(plan, size).collect()
    assert sorted((r["page_id"], r["chunk_number"]) for r in found) == [(1, 1), *((p, k) for p in (2, 3) for k in range(1, 65))] and max(len(r["part"] or "") for r in found) == size
    path = fresh_path(spark, "warc-many")
    warc_chunks.write_archives(plan, path, chunk_chars=size)
    check_warc(rows(warc_chunks.read_records(spark, path)), [(1, long), (2, "x" + long), (3, long)])
    parts = warc_chunks.read_chunks(spark, path, with_payload=True).where("page_id = 2").orderBy("chunk_number").collect()
    assert len(parts) == 64 and b"".join(r["payload"] for r in parts) == ("x" + long).encode()
    whole = hashlib.sha1()
    for r in parts:
        whole.update(r["payload"])
        assert r["digest_so_far"] == whole.hexdigest()


def test_warc_hard(spark):
    big = "zeile é " * 500 + "\r\n\r\nWARC/1.0\r\n" + "漢字" * 700
    data = [(1, "http://a b\n", big), (2, None, big), (3, "http://c", "x" * 999), (4, "http://c", "x" * 999), (5, "", None), (6, "u", ""), (7, "u", "y" * 5000), (7, "u", "y" * 5000), (8, "u", "y" * 5000), (None, "u", big), (9, "u", "\n" * 3000), (10, "u", "\r\n\r\n" * 800), (11, "u", "tail\n"), (12, "u", "\n")]
    df = spark.createDataFrame([(i, u, h, "k", 5) for i, u, h in data], "page_id long, url string, html string, digest string, bytes int").repartition(2)
    for chunk in (1 << 20, 700):
        path = fresh_path(spark, "warc-test")
        warc_chunks.write_archives(warc_chunks.plan_records(df), path, chunk_chars=chunk)
        check_warc(rows(warc_chunks.read_records(spark, path)), [(i, h) for i, _, h in data])
        chunks = warc_chunks.read_chunks(spark, path, with_payload=True).where("record_type = 'response' and page_id = 9").orderBy("chunk_number").collect()
        assert b"".join(r["payload"] for r in chunks) == b"\n" * 3000 and len(chunks) == (1 if chunk > 3000 else 5)
        ids = [line.split(": ")[1] for (text,) in rows(spark.read.option("lineSep", "\r\n").text(path)) for line in [text] if line.startswith("WARC-Record-ID: ")]
        assert len(ids) == len(set(ids)) >= len(data)
    path = fresh_path(spark, "warc-none")
    warc_chunks.write_archives(warc_chunks.plan_records(df.limit(0)), path)
    assert rows(warc_chunks.read_records(spark, path)) == []


# 8


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r[0]: r[1] for r in rows(table(spark, sf, "labels").select("doc_id", "toxic"))}
    got = rows(queries.op8_toxicity(spark, sf))
    assert len(got) == table(spark, sf, "documents").count() and all(h == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= s <= 1 and p == (s >= 0.5) for i, h, s, p in got)
    pairs = [(truth[i], p) for i, h, s, p in got if h and i in truth]
    hit, miss, false = (sum(x == y for x in pairs) for y in ((1, 1), (1, 0), (0, 1)))
    assert hit >= 20 and miss <= 0.2 * (hit + miss) and false <= 0.02 * len(pairs)


def test_toxicity_folding(hard, none, spark):
    weights = {"idiot": 3.0, "loser": 2.0, "trash": 1.5, "bad": 1.0, "gi ": 1.0}
    lexicon = toxic_lexicon.Lexicon(weights, toxic_lexicon.EXCEPTIONS, (-3.0, 2.0, 1.0))
    find = lambda t: toxic_lexicon.features(t, lexicon.automaton())[0]
    for t in ("you Idiot!", "an 1d10t here", "iԁiоt", "ＩＤＩＯＴ", "id​i­ot.", "L0SER", "1oser", "l0$er$$$", "some tr@sh", "idiotic", "tr\u0430sh", "a \u0431ad one", "you gi!"):
        assert find(t) > 0, t
    for t in ("a trash can", "two TRASH CANS", "kidiot", "lose r", "", None, "1 2 3 $5", "melt rash", "gin gift", "bald"):
        assert (find(t) > 0) == (t == "two TRASH CANS"), t
    assert toxic_lexicon.score(hard, lexicon).count() == len(hard_texts()) and rows(toxic_lexicon.score(none, lexicon)) == []
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    learned = toxic_lexicon.learn(hard, empty)
    assert learned.weights == {} and {r["score"] < 1e-6 for r in toxic_lexicon.score(hard, learned).collect()} == {True}
    assert toxic_lexicon.keep_clean(hard, learned).count() == len(hard_texts())


def test_toxicity_learns_short_and_rare_words(spark):
    rng = random.Random(6)
    plain = [f"word{i}" for i in range(400)] + ["as", "at", "ox"]
    text = lambda extra: " ".join([*rng.choices(plain, k=30), *extra])
    data = [(i, text(["zx"] if i < 60 else ["quorvel"] if i < 72 else [f"common{i % 3}"]), 1) for i in range(200)] + [(i, text([]), 0) for i in range(200, 800)]
    data += [(0, text(["again"]), 1)] * 3  # an id that repeats is learned from once
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    lexicon = toxic_lexicon.learn(docs, spark.createDataFrame([(i, x) for i, _, x in data], "doc_id long, toxic int"))
    entries = set(lexicon.weights)
    assert "zx " in entries and any("quorvel".startswith(t) for t in entries) and any("common".startswith(t[:6]) for t in entries), entries
    got = {r["score"] >= 0.5 for r in toxic_lexicon.score(spark.createDataFrame([(1, "a zx here"), (2, "QU0RVEL word3")], "doc_id long, text string"), lexicon).collect()}
    clean = {r["score"] >= 0.5 for r in toxic_lexicon.score(spark.createDataFrame([(3, "as at ox word17"), (4, "zxa")], "doc_id long, text string"), lexicon).collect()}
    assert got == {True} and clean == {False}


# 9


def check_lm(got, data, held):
    words = lambda t: [*(x.lower() for x in WORD.findall((t or "").encode())), b" end"]
    count = Counter(w for i, t in data if not held(i) for w in words(t))
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in data:
        w = words(t)
        want.append((i, held(i), len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) <= 1e-9 * max(1, abs(w[5])) for g, w in zip(got, want))
    return got


def test_lm(hard, none, spark, sf):
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 1
    docs = table(spark, sf, "documents")
    got = check_lm(rows(queries.op9_lm_scoring(spark, sf)), rows(docs.select("doc_id", "text")), held)
    out = [(g[5], g[6]) for g in got if g[1]]
    assert sum(s for _, s in out) > sum(b for b, _ in out)
    shaped = lambda df: df.select(F.col("doc_id").alias("id"), F.coalesce(queries.remainder() == 1, F.lit(True)).alias("held_out"), "text")
    check_lm(rows(maxent_lm.train_and_score(spark, shaped(hard))), [(r[0], r[1]) for r in hard_texts()], held)
    check_lm(rows(maxent_lm.score(shaped(hard), maxent_lm.train(shaped(hard).where("not held_out"), head=3))), [(r[0], r[1]) for r in hard_texts()], held)
    assert rows(maxent_lm.train_and_score(spark, shaped(none))) == []
    untrained = rows(maxent_lm.score(shaped(hard), maxent_lm.train(shaped(none))))
    assert len(untrained) == len(hard_texts()) and all(r[3] == 0 and r[4] == 0 for r in untrained)


@pytest.fixture(scope="module")
def lm(spark, sf):
    return maxent_lm.train(table(spark, sf, "documents").select("text"), head=3000)


def _scalar_hash(word: bytes) -> int:
    """The hash of a token, byte by byte."""
    whole = (1 << 64) - 1
    x = sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(word)) & whole
    return _scalar_mix(x)


def _scalar_mix(x: int) -> int:
    whole = (1 << 64) - 1
    x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & whole
    return x ^ x >> 29


def brute_lm(model, text: str | None) -> float:
    """The log10 probability of a text, one token at a time, from the weights and the table of counts."""
    whole, cells, w = (1 << 64) - 1, model.cells, model.weights
    counts = dict(rows(model.counts))
    total, past = 0.0, []
    for word in [*maxent_lm.tokens(text), None]:
        h = 0x7F4A7C159E3779B9 if word is None else _scalar_hash(word)
        single = int(cells.slot_hash[h >> 50]) == h
        cell = int(cells.slot_cell[h >> 50]) if single else int(cells.group_cell[word[0] + 256 * (word[1] if len(word) > 1 else 0) + 65536 * (word[-1:] in b".,;:!?")])
        c, s = divmod(cell, 32)
        h1, h2 = past[-1] if past else 1, past[-2] if len(past) > 1 else 2
        mixed = [_scalar_mix((h1 + 1) & whole), _scalar_mix((h1 * 0x2545F4914F6CDD1D & whole) ^ h2), _scalar_mix((h2 + 3) & whole)]
        p, q = w.prior.astype(float), w.cell_prior[c].astype(float)
        for k, m in enumerate(mixed):
            n, n_cell = maxent_lm.BUCKETS[maxent_lm.KINDS[k]]
            if w.of_class[k] is None:
                continue
            p = p * w.of_class[k][m * n >> 64]
            q = q * w.of_cell[k][c * (n_cell // 32) + (_scalar_mix(m) * (n_cell // 32) >> 64)]
        token = 1.0 if single else (counts.get(word.decode(), 0) + 0.5) / (cells.n[cell] + 0.5 * (cells.size[cell] + 1))
        total += math.log10(p[c] / p.sum() * q[s] / q.sum() * token)
        past.append(h)
    return total


def test_lm_score_brute(spark, lm, hard):
    texts = [(i, t) for i, t, *_ in hard_texts() if t is None or len(t) < 3000] + [(100, "The of and THE of.\nzq zq"), (101, "\x85 \xa0x \u2003")]
    df = spark.createDataFrame([(n, False, t) for n, (_, t) in enumerate(texts)], "id long, held_out boolean, text string")
    got = {r["id"]: r["score"] for r in maxent_lm.score(df, lm).collect()}
    assert all(got[n] == pytest.approx(brute_lm(lm, t), rel=1e-5, abs=1e-4) for n, (_, t) in enumerate(texts))


def test_lm_cut():
    texts = ["", "a", " Ab  c\x0bd ", "ab\x85 \u00e9. x", "", "c ab"]
    found = maxent_lm.cut([t.encode().lower() for t in texts])
    want = [(i, w) for i, t in enumerate(texts) for w in [*maxent_lm.tokens(t), None]]
    assert found.doc.tolist() == [i for i, _ in want] and found.is_end.tolist() == [w is None for _, w in want]
    assert [h for h, w in zip(found.hash.tolist(), want) if w[1]] == [_scalar_hash(w) for _, w in want if w]
    assert [x for x, w in zip(found.mark.tolist(), want) if w[1]] == [w[-1:] in b".,;:!?" for _, w in want if w]
    assert len(maxent_lm.cut([]).doc) == 0


def test_lm_is_a_distribution(lm):
    found = maxent_lm.cut([t.encode() for t in ("the of and", "", "x")])
    cell = lm.cells.of(found)
    for_class, _ = maxent_lm.features(found, cell)
    assert np.allclose(lm.weights.classes(for_class).sum(axis=1), 1, atol=1e-5)
    for c in range(32):  # the history, were the class c
        _, for_cell = maxent_lm.features(found, np.full(len(cell), c * 32))
        assert np.allclose(lm.weights.cells(for_cell, np.full(len(cell), c)).sum(axis=1), 1, atol=1e-5)
    by_cell: Counter[int] = Counter()
    counts = [(t, n) for t, n in rows(lm.counts) if t != maxent_lm.END]
    found = maxent_lm.cut([t.encode() for t, _ in counts])
    cells = lm.cells.of(found)[~found.is_end]
    single = 0
    for (t, n), c in zip(counts, cells, strict=True):
        if lm.cells.size[c]:
            by_cell[c] += n + 0.5
        else:
            single += 1
            assert lm.cells.n[c] == n
    assert single == (lm.cells.size == 0).sum() - 1 - ((lm.cells.size == 0) & (lm.cells.n == 0)).sum()
    assert all(abs(v + 0.5 - (lm.cells.n[c] + 0.5 * (lm.cells.size[c] + 1))) < 1e-6 for c, v in by_cell.items())


def test_lm_expected_counts(spark, sf, lm):
    texts = [r["text"] for r in table(spark, sf, "documents").limit(40).collect()]
    found = maxent_lm.cut([t.encode().lower() for t in texts])
    cell = lm.cells.of(found)
    levels = maxent_lm.features(found, cell)
    got = maxent_lm.gathered(spark.createDataFrame([(t,) for t in texts], "text string"), lm.cells, 2, lm.weights)
    for level, (p, what) in enumerate(((lm.weights.classes(levels[0]), cell >> 5), (lm.weights.cells(levels[1], cell >> 5), cell & 31))):
        want, seen = np.zeros_like(got[f"expected{level}"]), np.zeros_like(got[f"observed{level}"])
        np.add.at(want, levels[level][2], p)
        np.add.at(seen, (levels[level][2], what), 1)
        assert np.allclose(got[f"expected{level}"], want, rtol=1e-3, atol=1e-3) and np.array_equal(got[f"observed{level}"], seen)


def test_lm_learns_every_round(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select(F.col("doc_id").alias("id"), (queries.remainder() == 1).alias("held_out"), "text").cache()
    held = docs.where("held_out")
    found = [maxent_lm.score(held, maxent_lm.train(docs.where("not held_out"), rounds)).agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first() for rounds in range(4)]
    per_token = [s / n for _, s, n in found]
    assert per_token[0] > found[0][0] / found[0][2] + 0.08
    assert per_token[1] > per_token[0] + 0.002 and per_token[2] > per_token[1] + 0.005 and per_token[3] > per_token[1] and per_token[3] >= per_token[2] - 1e-3, per_token


# 10


def test_licenses(hard, none, spark):
    mit = "MIT License\n\n" + license_rules.SENTENCES["mit-grant"].replace("copy, modify", "copy,\n modify") + "\n\n" + license_rules.SENTENCES["mit-notice"]
    bsd = "\n".join(f" * {license_rules.SENTENCES[i]}" for i in ("bsd-grant", "bsd-source", "bsd-binary"))
    cases = [
        (1, "Prose here.\nLicensed under the Apache License, Version 2.0.\nMore prose.", ["Apache-2.0"]), (2, mit, ["MIT"]), (3, bsd, ["BSD-2-Clause"]), (4, bsd + "\n" + license_rules.SENTENCES["bsd-name"], ["BSD-3-Clause"]),
        (5, "no licence at all", []), (6, None, []), (7, "", []), (8, "no end mark\nReleased under the MIT License\nand on", ["MIT"]), (9, license_rules.SENTENCES["mit-notice"] + "\n\n" + license_rules.SENTENCES["mit-grant"], []),
        (10, "Licensed under CC BY-NC 4.0. All Rights   Reserved.\r\n", ["CC-BY-NC-4.0", "all-rights-reserved"]), (11, "All rights reserved.\nx.\nAll rights reserved.", ["all-rights-reserved"]), (None, "Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
    ]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t, _ in cases], "doc_id long, text string, sentence_ids string, licenses string")
    assert sorted(((r["doc_id"], r["licenses"]) for r in license_rules.scan(df).collect()), key=key) == sorted(((i, x) for i, _, x in cases), key=key)
    assert license_rules.scan(hard).count() == len(hard_texts()) and rows(license_rules.scan(none)) == []


def test_licenses_in_both_forms_and_repeated(spark):
    gpl = ("gpl-free", "gpl-warranty", "gpl-see")
    wrapped = " ".join(license_rules.SENTENCES[i] for i in gpl).replace("you can ", "you can\n").replace("hope that ", "hope that\n")
    bsd3, bsd2 = ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name"), ("bsd-grant", "bsd-source", "bsd-binary")
    notice = lambda seq: "\n".join(license_rules.SENTENCES[i] for i in seq) + "\n\n"
    cases = [
        (1, "Notes\nReleased under the MIT License.\n\n" + wrapped, ["mit-line", *gpl], ["MIT", "GPL-3.0-or-later"]),
        (2, wrapped + "\n\nNotes\nAll rights reserved\nand on", [*gpl, "all-rights"], ["GPL-3.0-or-later", "all-rights-reserved"]),
        (3, "Licensed under the Apache License, Version 2.0\n(the \"License\");\nyou may not use this file except in compliance with the License.", ["apache-2-head", "apache-2-use"], ["Apache-2.0"]),
        (4, notice(bsd3) * 2, [*bsd3 * 2], ["BSD-3-Clause"]), (5, notice(bsd3) * 3 + notice(bsd2), [*bsd3 * 3, *bsd2], ["BSD-3-Clause", "BSD-2-Clause"]),
        (6, "All rights reserved.\n" * 500, ["all-rights"] * 500, ["all-rights-reserved"]),
    ]
    df = spark.createDataFrame([(i, t) for i, t, _, _ in cases], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_sentences"], r["sentence_ids"], r["licenses"]) for r in license_rules.scan(df).collect()}
    assert got == {i: (len(ids), ids, names) for i, _, ids, names in cases}


def brute_licenses(text, sentences, rules):
    """The identifiers found and the licences, by plain loops over places in the text."""
    text = (text or "").replace("\r", "")
    known = {license_rules.normalized(s): i for i, s in sentences.items()}
    solid = [0]
    for c in text:
        solid.append(solid[-1] + (c not in " \t\n\v\f"))

    def units(mark):
        at, out = 0, []
        for m in [*re.finditer(mark, text), None]:
            end = m.start() if m else len(text)
            found = known.get(license_rules.normalized(text[at:end]))
            if found:
                out.append((solid[at], solid[end], found))
            at = m.end() if m else end
        return out

    long, lines = units(license_rules.CUT), units("\n")
    meet = lambda x, y: x[0] < y[1] and y[0] < x[1]
    own = [x for x in lines if not any(meet(x, y) and y[1] - y[0] >= x[1] - x[0] for y in long)]
    ids = [x[2] for x in sorted([y for y in long if not any(meet(x, y) for x in own)] + own)]
    left, names = list(ids), []
    for name, seq in rules:
        while True:
            at, places = 0, []
            for i in seq:
                if i not in left[at:]:
                    break
                places.append(left.index(i, at))
                at = places[-1] + 1
            if len(places) < len(seq):
                break
            left = [x for k, x in enumerate(left) if k not in places]
            names += [name] * (name not in names)
    return ids, names


def test_licenses_brute(spark, sf):
    rng = random.Random(9)
    pool = list(license_rules.SENTENCES.values())
    filler = ["Prose without any mark", "Some words here.", "* ", "\n\n", "\n", " ", "Licensed under nothing.", "2.0."]
    texts = [rng.choice(("", "Intro\n")) + "".join(rng.choice((lambda: rng.choice(pool), lambda: rng.choice(filler)))().replace(" ", rng.choice((" ", " ", "\n "))) + rng.choice((" ", "\n", "\n\n", "  ")) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    notices = [[s for i, s in license_rules.SENTENCES.items() if i in seq] for _, seq in license_rules.RULES]
    texts += ["\n".join(n * rng.randint(1, 3)) for n in notices] + [" ".join(n) for n in notices]
    texts.append("word " * 200_000 + "\n" + "\n".join(notices[0]) + "\nfiller\n" + "lines and\n" * 20_000 + pool[1])
    texts += [r[0] for r in rows(table(spark, sf, "documents").select("text"))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"]) for r in license_rules.scan(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_licenses(t, license_rules.SENTENCES, license_rules.RULES), t[:500]
    own = {"x": "Use as you like.", "y": "No more than this."}
    found = license_rules.scan(spark.createDataFrame([(1, "Ah.\nUse as you like.\nNo more than this.")], "doc_id long, text string"), sentences=own, rules=(("free", ("x", "y")),)).collect()
    assert [(r["sentence_ids"], r["licenses"]) for r in found] == [(["x", "y"], ["free"])]


def test_licenses_many_notices(spark):
    """Linear in the text: one that repeats a notice thousands of times is no more than so many notices."""
    bsd, mit = (("bsd-grant", "bsd-source", "bsd-binary"), ("mit-grant", "mit-notice"))
    notice = lambda seq: "\n".join(license_rules.SENTENCES[i] for i in seq) + "\n\n"
    cases = [(1, notice(bsd) * 1000, [*bsd * 1000], ["BSD-2-Clause"]), (2, notice(bsd[:2]) * 1000, [*bsd[:2] * 1000], []), (3, (notice(bsd[:1]) * 5 + notice(bsd[1:]) * 5 + notice(mit)) * 100, [*(bsd[:1] * 5 + bsd[1:] * 5 + mit) * 100], ["MIT", "BSD-2-Clause"])]
    df = spark.createDataFrame([(i, t) for i, t, _, _ in cases], "doc_id long, text string").repartition(3)
    license_rules.scan(df.limit(0)).collect()
    began = time.perf_counter()
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"]) for r in license_rules.scan(df).collect()}
    assert time.perf_counter() - began < 30
    assert got == {i: (ids, names) for i, _, ids, names in cases}


def test_licenses_rules_with_repeats(spark):
    """Rules that ask for one identifier twice, and interleaved matches, against one match at a time."""
    rng = random.Random(12)
    own = {k: f"sentence {k} of the table." for k in "abc"}
    rules = (("aba", ("a", "b", "a")), ("aa", ("a", "a")), ("abc", ("a", "b", "c")), ("ca", ("c", "a")), ("b", ("b",)))
    texts = ["\n".join(own[rng.choice("abc")] for _ in range(rng.randint(0, 14))) for _ in range(300)]
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"]) for r in license_rules.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), sentences=own, rules=rules).collect()}
    assert got == {i: brute_licenses(t, own, rules) for i, t in enumerate(texts)}


def test_licenses_sql():
    import duckdb

    rng = random.Random(10)
    pool = list(license_rules.SENTENCES.values())
    filler = ["Prose without any mark", "Some words here.", "* ", "\n\n", "\n", " ", "2.0."]
    texts = ["".join(rng.choice((lambda: rng.choice(pool), lambda: rng.choice(filler)))().replace(" ", rng.choice((" ", " ", "\n "))) + rng.choice((" ", "\n", "\n\n")) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    texts += ["\n".join([s for i, s in license_rules.SENTENCES.items() if i in seq] * 2) for _, seq in license_rules.RULES] + [None, ""]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = {i: (n, ids, names) for i, n, ids, names in con.execute(oracle.ORACLE_SQL["op10_license_scan"]).fetchall()}
    for i, t in enumerate(texts):
        ids, names = brute_licenses(t, license_rules.SENTENCES, license_rules.RULES)
        assert got[i] == (len(ids), "|".join(ids), "|".join(names)), t


def test_license_table():
    for i, s in license_rules.SENTENCES.items():
        assert re.search(license_rules.ANCHOR, s), s
        assert len(re.split(license_rules.CUT, s)) == 1 or i.endswith("-line"), s
    assert len({license_rules.normalized(s) for s in license_rules.SENTENCES.values()}) == len(license_rules.SENTENCES)
    assert all(i in license_rules.SENTENCES for _, seq in license_rules.RULES for i in seq)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op8_toxicity", "op9_lm_scoring")])
def test_query_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_words_in_use_are_not_learned_anew():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    t, table, learned = Tokenizer.from_file(path), bin_completion.WordTable(path, max_entries=400), Counter()
    learn = table._learn
    table._learn = lambda words: (learned.update(words), learn(words))
    common = [f"{a}{b}" for a in ("été", "straße", "niño", "word", "Ünder", "x1", "a×b") for b in "bcdefgh"]
    for batch in range(12):
        fresh = [f"q{chr(97 + batch)}{chr(97 + i % 26)}{'z' * (i // 26)}" for i in range(60)]
        texts = [" ".join(common), " ".join(fresh), " ".join(f"{w}{mark}" for w in common[:28] for mark in (".", ",!!", "%%%")), None, ""]
        assert table.encode(texts) == [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
        assert len(table.ids) <= 200
    assert max(learned.values()) == 1  # a word that every batch has is learned once
    assert not any(w.startswith("été".encode()) and w.endswith(b"%") for w in learned)  # marks behind Latin letters are words of their own


def test_marks_behind_latin_letters():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    t, table, rng = Tokenizer.from_file(path), bin_completion.WordTable(path), random.Random(5)
    parts = ["é", "É", "ß", "ÿ", "Þ", "×", "÷", "a", "Z", "œ", "İ", "ª", "µ", "́", "̸", "⃗", "҃", "'s", "'", ".", "=", "<", "1", "Ã", "\xa0", "\x85", "<|endoftext|>", " ", "\n", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(20_000)]
    for i in range(0, len(texts), 64):
        assert table.encode(texts[i : i + 64]) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts[i : i + 64]]
