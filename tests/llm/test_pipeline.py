"""The corpus pipeline against brute force, stage by stage, and the SQL of the corpus queries."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from evidence_engine.llm import quality_cascade, queries, simhash_tiles, toxic_lexicon
from evidence_engine.llm.oracle import ORACLE_SQL
from evidence_engine.llm.shared import table
from tests.llm.conftest import WORDS, hard_texts
from tests.llm.test_operators import brute_base, check_packing, key, rows

STAGES = dict(corpus_pipeline.STAGES)


def brute_quality(text):
    base = brute_base(text)
    if base[0] < 20 or 100 * base[4] > 30 * base[0]:
        return False
    x = quality_cascade.Texts.of([text])
    return not any(rule(x, np.array([0]))[0] for rule in quality_cascade.RULES.values())


def brute_score(text, lexicon):
    best, words = 0.0, 1
    for reading in toxic_lexicon.readings(text):
        found = reading.split()
        benign = [p.split() for p in lexicon.exceptions]
        hidden = {j for i in range(len(found)) for p in benign if found[i : i + len(p)] == p for j in range(i, i + len(p))}
        total = sum(max((w for t, w in lexicon.weights.items() if x.startswith(t)), default=0.0) for i, x in enumerate(found) if i not in hidden)
        if total > best:
            best, words = total, max(1, len(found))
    c, a, b = lexicon.coef
    return 1 / (1 + math.exp(-(c + a * math.log1p(best) + b * math.log1p(100 * best / words))))


def brute_sketch(text, k=5):
    import xxhash

    w = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    out = []
    for lane in range(simhash_tiles.LANES):
        x = [int(simhash_tiles._lane(np.array([v], np.uint64), lane)[0]) for v in h]
        out.append(sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in x) > len(x)))
    return out, len(h)


def brute_copies(data, similarity=0.8):
    made = [brute_sketch(t or "") for _, t in data]
    sets = [shingle_set(t) if t else set() for _, t in data]
    named = {frozenset(s) for (d, _), s in zip(data, sets) if d is not None}
    first, total = simhash_tiles.radii(similarity)
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, n) in enumerate(made):
        for j, (b, m) in enumerate(made[:i]):
            if sets[i] == sets[j]:
                root[find(i)] = find(j)
            elif not {frozenset(sets[i]), frozenset(sets[j])} <= named or len(sets[i] & sets[j]) < similarity * len(sets[i] | sets[j]):
                continue
            elif min(n, m) >= similarity * max(n, m) and (a[0] ^ b[0]).bit_count() <= first and sum((x ^ y).bit_count() for x, y in zip(a, b)) <= total:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, least.get(find(i))) for i, (d, _) in enumerate(data)]


def test_pipeline_brute(spark, sf):
    docs = table(spark, sf, "documents")
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    lexicon = queries.learned_lexicon(spark, docs.where("doc_id is not null"), sf)
    good = [(i, t) for i, t in data if brute_quality(t)]
    first = STAGES["quality"](spark, docs, sf)
    assert first.columns == docs.columns and sorted(r["doc_id"] for r in first.collect()) == sorted(i for i, _ in good)
    lexicon = queries.learned_lexicon(spark, first, sf)
    clean = [(i, t) for i, t in good if brute_score(t, lexicon) < 0.5]
    second = STAGES["toxicity"](spark, first, sf)
    assert second.columns == docs.columns and sorted(r["doc_id"] for r in second.collect()) == sorted(i for i, _ in clean)
    one = {c for _, c in brute_copies(clean)}
    third = STAGES["simhash_dedup"](spark, second, sf)
    assert third.columns == docs.columns and sorted(r["doc_id"] for r in third.collect()) == sorted(one)
    left = [(i, t) for i, t in clean if i in one]
    bins, least = check_packing(rows(corpus_pipeline.run(spark, sf)), left)
    assert bins <= least + 1 and corpus_pipeline.ORACLE_SQL is None


def test_near_copies_brute_and_hard(hard, none, spark):
    data = [(r[0], r[1]) for r in hard_texts()]
    assert sorted(rows(simhash_tiles.near_copies(hard)), key=key) == sorted(brute_copies(data), key=key)
    assert rows(simhash_tiles.near_copies(none)) == []


def test_near_copies_are_caught_and_others_left(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    data, group = [], {}
    for g in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(150, 600))]
        for c in range(3 if g < 30 else 1):
            words = list(base)
            for _ in range(c * len(base) // 100):  # a change of one word in a hundred takes five shingles: similarity about 0.9
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            group[len(data)] = g
            data.append((len(data), " ".join(words)))
    got = dict(rows(simhash_tiles.near_copies(spark.createDataFrame(data, "doc_id long, text string"), tile_rows=16)))
    assert all((got[i] == got[j]) == (group[i] == group[j]) for i in got for j in got)


def shingle_set(text, k=5):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_copies_against_shingle_sets(spark, sf):
    rng = random.Random(4)
    texts = [r["text"] for r in table(spark, sf, "documents").where("n_chars between 400 and 4000").orderBy("doc_id").limit(60).collect()]
    for i in range(12):
        words = [f"v{i}x{rng.randrange(10**6)}" for _ in range(150)]
        whole = " ".join(words)
        texts += [whole, f"{whole} {whole}", whole + (" " + " ".join(words[:60])) * 3, " ".join([f"other{i}", *words[1:]] * 5)]
    sets = [shingle_set(t) for t in texts]
    like = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(sets)) for j in range(i)}
    got = dict(rows(simhash_tiles.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tile_rows=16)))
    assert sum(s >= 0.9 for s in like.values()) >= 12 * 6
    assert [p for p, s in like.items() if s >= 0.9 and got[p[0]] != got[p[1]]] == []
    partner = {i for p, s in like.items() if s >= 0.5 for i in p}
    assert [i for i, c in got.items() if i not in partner and sum(x == c for x in got.values()) > 1] == []


def test_near_copies_are_those_of_the_similarity(spark, sf):
    """On all documents of the next size: no two texts are joined but over links of 0.8 or more, and of those links nine in ten
    and more are found."""
    docs = table(spark, sf.replace("0.001", "0.01"), "documents").select("doc_id", "text")
    data = rows(docs)
    sets = {i: shingle_set(t) for i, t in data}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = Counter((a, b) for held in holders.values() for k, a in enumerate(held) for b in held[:k])
    links = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    for tile_rows, group_bytes in ((1 << 16, 1 << 22), (64, 4096)):
        got = dict(rows(simhash_tiles.near_copies(docs, tile_rows=tile_rows, group_bytes=group_bytes)))
        for i, c in got.items():
            assert find(i) == find(c) and c <= i
        found = sum(got[a] == got[b] for a, b in links if sets[a] != sets[b])
        assert found >= 0.9 * sum(sets[a] != sets[b] for a, b in links) and all(got[a] == got[b] for a, b in links if sets[a] == sets[b])


def test_verified_links_skip_nothing():
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    sets, base = [], rng.choice(pool, 200, replace=False)
    for k in range(60):
        change = rng.integers(0, 40) if k % 3 else 190
        sets.append(np.unique(np.concatenate([base[change:], rng.choice(pool, change)])))
    lanes = np.array([simhash_tiles.majorities(s, np.array([len(s)]), simhash_tiles.LANES)[0] for s in sets])
    first, total = simhash_tiles.radii(0.8)
    held = {"node": np.arange(60), "n": np.array([len(s) for s in sets])} | {f"w{k}": lanes[:, k].copy().view(np.int64) for k in range(simhash_tiles.LANES)}

    def parts(u, v):
        label = np.arange(60)
        for a, b in zip(u, v):
            label[label == label[a]] = label[b]
        return {frozenset(np.flatnonzero(label == x)) for x in label}

    def real(a, b):
        apart = np.bitwise_count(lanes[a] ^ lanes[b])
        return apart[0] <= first and apart.sum() <= total and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))

    every = [(a, b) for a in range(60) for b in range(a) if real(a, b)]
    assert len(every) > 60
    u, v = simhash_tiles.verified_links(held, sets, np.zeros(60, int), 0.8)
    assert parts(u, v) == parts(*zip(*every)) and all(real(a, b) for a, b in zip(u, v))
    tile = np.arange(60) % 2
    u, v = simhash_tiles.verified_links(held, sets, tile, 0.8)
    assert parts(u, v) == parts(*zip(*[(a, b) for a, b in every if tile[a] != tile[b]]))


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_hard_and_empty(hard, none, spark, sf, name):
    out = STAGES[name](spark, hard, sf)
    if name != "packing":
        assert out.columns == hard.columns
    n = out.count()
    assert n >= len(hard_texts()) if name == "packing" else n <= len(hard_texts())
    assert n or name == "quality"  # the prose of these rows repeats itself
    assert STAGES[name](spark, none, sf).count() == 0


def test_sketch_words():
    texts = [" ".join(WORDS), "a", "", None, " ".join(WORDS[::-1] * 3)]
    lanes, size = simhash_tiles.sketches(texts, 5, simhash_tiles.LANES)
    for i, t in enumerate(texts):
        want, n = brute_sketch(t or "")
        assert [int(x) for x in lanes[i]] == want and size[i] == n


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, rows(df.select(*names)))) == sorted(map(str, found.fetchall()))
