"""Token archives, whitening and periodic runs against brute force, on hard rows and on the smallest tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence_engine.llm import lyndon_runs, queries, token_archive, whitening
from evidence_engine.llm.shared import fresh_path, table
from tests.llm.conftest import SCHEMA, hard_texts
from tests.llm.test_operators import both, key, rows

# 11


def test_elias_fano():
    rng = random.Random(4)
    for n in (0, 1, 2, 7, 300, 70_000):
        for most in (0, 1, n, 1000 * n + 5, (1 << 62) - 1):
            values = sorted(rng.randint(0, most) for _ in range(n))
            found = token_archive.EliasFano.of(np.array(values, np.uint64))
            assert found.slice(0, n).tolist() == values
            for _ in range(20 * bool(n)):
                a, b = sorted((rng.randint(0, n), rng.randint(0, n)))
                assert found.slice(a, b).tolist() == values[a:b]
                i = rng.randrange(n)
                assert found[i] == values[i]
                assert found.rank(values[i]) == values.index(values[i])
    lengths = [rng.randrange(1, 3000) for _ in range(50_000)]
    held = token_archive.EliasFano.of(np.cumsum([0, *lengths]))
    assert 8 * sum(map(len, held.parts())) / len(lengths) < 2.2 + math.log2(np.mean(lengths))


def archived(data, tokenizer, end=(2,)):
    from tokenizers import Tokenizer

    tk, out, start = Tokenizer.from_file(tokenizer), [], 0
    for i, t in sorted(data, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, *end]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_archive(hard, none, spark, sf):
    tokenizer = queries.tokenizer_path("word_bpe_49k.json")
    for df, data in both(hard, spark, sf):
        want = archived(data, tokenizer)
        for options in ({}, {"file_tokens": 500}, {"file_docs": 3}):
            path = fresh_path(spark, "archive")
            token_archive.write_archive(df, path, tokenizer, **options)
            got = sorted(rows(token_archive.read_archive(spark, path)), key=lambda r: r[1])
            assert [r[0] for r in got] == [r[0] for r in want]
            assert sorted((r[0] is None, r[0], r[2], r[3]) for r in got if r[0] is not None) == sorted((r[0] is None, r[0], r[2], r[3]) for r in want if r[0] is not None)
            assert sorted(r[2:] for r in got) == sorted(r[2:] for r in want)
            assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:])) and got[0][1] == 0
            if options:
                assert len(token_archive.manifest(path)) > 3
    assert sorted(rows(queries.op11_token_archive(spark, sf))) == want
    path = fresh_path(spark, "archive")
    token_archive.write_archive(none, path, tokenizer)
    assert rows(token_archive.read_archive(spark, path)) == [] and token_archive.manifest(path) == []


def test_archive_ids_and_lookups(spark, sf):
    from tokenizers import Tokenizer

    tokenizer = queries.tokenizer_path("word_bpe_49k.json")
    tk = Tokenizer.from_file(tokenizer)
    data = [(-(2**63), "first of all"), (-5, "below zero"), (7, "one seven"), (7, "another seven"), (2**63 - 1, "last words"), (None, "no id"), (9, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    path = fresh_path(spark, "archive")
    token_archive.write_archive(df.coalesce(1), path, tokenizer, end_id=None)
    assert sorted((r.doc_id is None, r.doc_id, r.ids) for r in token_archive.read_archive(spark, path, with_ids=True).collect() if r.doc_id is not None) == sorted((False, i, tk.encode(t or "", add_special_tokens=False).ids) for i, t in data if i is not None)
    for asked in (-(2**63), -5, 7, 2**63 - 1, 9, 8):
        assert sorted(x.tolist() for x in token_archive.find(path, asked)) == sorted(tk.encode(t or "", add_special_tokens=False).ids for i, t in data if i == asked)
    with pytest.raises(Exception, match="holds an archive"):
        token_archive.write_archive(df, path, tokenizer)
    with pytest.raises(Exception, match="beyond the archive's max_id"):
        spark.createDataFrame([(1, bytearray(np.array([70_000], "<u4").tobytes()))], "doc_id long, ids binary").write.format("token_archive").options(max_id=100).mode("append").save(fresh_path(spark, "archive"))


def test_archive_ignores_files_of_lost_attempts(spark, tmp_path):
    tokenizer = queries.tokenizer_path("word_bpe_49k.json")
    path = f"{tmp_path}/archive"
    (tmp_path / "archive").mkdir()
    (tmp_path / "archive" / "000000-0000-lost.tokens").write_bytes(b"half a file")
    token_archive.write_archive(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), path, tokenizer)
    assert [r.doc_id for r in token_archive.read_archive(spark, path).collect()] == [1]


# 12


def brute_whitened(data, k=32):
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in data if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n = len(kept)
    sums = [sum(c) for c in zip(*(x for _, x in kept))]
    apart = [[n * a - s for a, s in zip(x, sums)] for _, x in kept]
    centred = np.array([[a / n for a in row] for row in apart])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return kept, n, [sum(a * a for a in row) for row in apart], centred, values, vectors


def check_whitened(got, data, k=32):
    kept, n, deviations, centred, values, vectors = brute_whitened(data)
    k = min(k, len(values))
    assert len(got) == len(kept) * k
    want = centred @ vectors[:, :k] / np.sqrt(values[:k])
    found = {c: {} for c in range(1, k + 1)}
    for vec_id, component, m, deviation, whitened, explained, error in got:
        assert m == n and error <= 1e-4 and abs(explained / (values[component - 1] / values.sum()) - 1) < 1e-9
        found[component].setdefault(vec_id, []).append((deviation, whitened))
    for c in range(1, k + 1):
        own = {}
        for (i, _), d, w in zip(kept, deviations, want[:, c - 1]):
            own.setdefault(i, []).append((d, w))
        sign = 1 if sum(w * sorted(own[i])[0][1] for i, ((_, w), *_) in found[c].items() if i is not None and len(own[i]) == 1) > 0 else -1
        for i, pairs in own.items():
            assert np.allclose(sorted((d, sign * w) for d, w in found[c][i]), sorted(pairs), rtol=1e-7, atol=1e-7)
            assert sorted(d for d, _ in found[c][i]) == sorted(d for d, _ in pairs)


def test_whitening(spark, sf):
    data = rows(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    check_whitened(rows(queries.op12_whitening(spark, sf)), data)


def test_whitening_hard(spark):
    rng = random.Random(5)
    data = [(i, [rng.gauss(0, 1 + j) + (j == 2) * rng.random() for j in range(5)]) for i in range(200)]
    data += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0]), (302, [math.nan] * 5), (303, [math.inf, 0.0, 0.0, 0.0, 0.0]), (None, [0.5] * 5), (7, data[7][1]), (8, [9.0, 8.0, 7.0, 6.0, 5.0])]
    schema = "vec_id long, embedding array<double>, x string, id int, n int, whitened string"
    df = spark.createDataFrame([(i, v, "a", 1, 2, "b") for i, v in data], schema).repartition(3)
    check_whitened(rows(whitening.by_component(whitening.whiten(df))), data)
    check_whitened(rows(whitening.by_component(whitening.whiten(df, 2))), data, 2)
    far = [(i, [1e10 + 1e4 * v[0], *v[1:]]) for i, v in data[:50]]  # exact although the mean is far away
    check_whitened(rows(whitening.by_component(whitening.whiten(spark.createDataFrame(far, "vec_id long, embedding array<double>")))), far)


def test_whitening_without_variance(spark):
    for data in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])], [(1, None)]):
        df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
        assert rows(whitening.by_component(whitening.whiten(df))) == []
    flat = spark.createDataFrame([(i, [float(i), 3.0, 2.0 * i]) for i in range(9)], "vec_id long, embedding array<float>")
    found = whitening.by_component(whitening.whiten(flat))
    assert {r.component for r in found.collect()} == {1} and abs(found.first().explained - 1) < 1e-12
    with pytest.raises(Exception, match="from 1 to 2 components"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"))
    with pytest.raises(Exception, match="beyond 53 bits"):
        whitening.whiten(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="doesn't fit a long"):
        whitening.whiten(spark.createDataFrame([(1, [1e12]), (2, [0.0])], "vec_id long, embedding array<double>"))


# 13


def brute_runs(x, least=24, exponent=3):
    n, out = len(x), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if x[i] != x[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and x[i] == x[i + p]:
                i += 1
            length = i - start + p
            stretch = x[start : start + length]
            if length >= max(least, exponent * p, 2 * p) and not any(stretch[q:] == stretch[:-q] for q in range(1, p)):
                out.add((start, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    n, k = rng.randrange(0, 90), rng.choice([1, 2, 2, 3, 5])
    x = [rng.randrange(k) for _ in range(n)]
    if n > 10 and rng.random() < 0.6:
        a = rng.randrange(n)
        p = rng.randrange(1, max(2, (n - a) // 2 + 1))
        x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
    if n and rng.random() < 0.4:
        x[rng.randrange(n)] = 9
    return [b"w%d" % c for c in x]


def test_runs_brute(monkeypatch):
    rng = random.Random(6)
    for _ in range(1500):
        x = lyndon_runs.codes(periodic_words(rng))
        for least, exponent in ((24, 3), (2, 2)):
            assert lyndon_runs.runs(x, least, exponent) == brute_runs(x, least, exponent)
            assert lyndon_runs.runs(x, least, exponent, hashed=False) == brute_runs(x, least, exponent)
    # Hashes that often meet: what is returned is verified word by word.
    monkeypatch.setattr(lyndon_runs, "PRIME", 7)
    monkeypatch.setattr(lyndon_runs, "_powers", [1])
    for _ in range(300):
        x = lyndon_runs.codes(periodic_words(rng))
        assert set(lyndon_runs.runs(x)) <= set(brute_runs(x))


def test_runs_of_long_texts():
    for stretch in (["of"], ["a", "b"], ["a", "b", "a", "c", "a"], [f"w{i}" for i in range(999)]):
        x = lyndon_runs.codes((stretch * (60_000 // len(stretch) + 1))[:60_000])
        assert lyndon_runs.runs(x) == [(0, 60_000, len(stretch))]


def brute_scan(data, change):
    out = []
    for i, t in data:
        words = t.encode().split() if t else []
        n = len(words)
        if change and i is not None:
            h = zlib.crc32(str(i).encode())
            g = h // 10
            if h % 10 == 0 and n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        found = brute_runs(words) if n < 400 else lyndon_runs.runs(lyndon_runs.codes(words), hashed=False)
        gone = {k for s, length, p in found for k in range(s + p, s + length)}
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else None
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        sha = lambda b: hashlib.sha256(b).hexdigest()
        out.append((i, len(found), *top, sha("".join(f"{s},{length},{p}\n" for s, length, p in found).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone))))
    return out


def test_runs_scan(hard, none, spark, sf):
    for df, data in both(hard, spark, sf):
        for change in (None, lyndon_runs.planted):
            assert sorted(rows(lyndon_runs.scan(df, change=change)), key=key) == sorted(brute_scan(data, change), key=key)
    assert sorted(rows(queries.op13_periodic_runs(spark, sf)), key=key) == sorted(brute_scan(data, True), key=key)
    planted = [(i, " ".join(f"{i}x{k}" for k in range(40))) for i in range(300)]
    df = spark.createDataFrame(planted, "doc_id long, text string")
    got = rows(lyndon_runs.scan(df, change=lyndon_runs.planted, with_runs=True))
    assert sorted(r[:-1] for r in got) == sorted(brute_scan(planted, True)) and sum(len(r[-1]) == r[1] > 0 for r in got) > 5
    assert rows(lyndon_runs.scan(none)) == [] and rows(lyndon_runs.collapse_texts(none)) == []


def test_collapsed_texts(hard):
    assert lyndon_runs.collapse([b"%d" % (k % 10) for k in range(45)], [(0, 45, 10)]) == [b"%d" % k for k in range(10)]
    got = lyndon_runs.collapse_texts(hard)
    assert got.schema.simpleString() == hard.schema.simpleString()
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[15] == "of" and texts[17].startswith("pär | #") and texts[4] is None and texts[6] == "   " and texts[1] == dict((r[0], r[1]) for r in hard_texts())[1].split(" the quick", 1)[0]


def test_archive_learns_words_in_use_once(monkeypatch):
    from collections import Counter

    import pyarrow as pa

    from evidence_engine.llm import bin_completion

    tokenizer, learned = queries.tokenizer_path("word_bpe_49k.json"), Counter()
    small = bin_completion.WordTable(tokenizer, max_entries=200)
    learn = small._learn
    small._learn = lambda words: (learned.update(words), learn(words))
    monkeypatch.setitem(bin_completion._tables, tokenizer, small)
    common = " ".join(f"año{x}, été{x}. word{x}!!" for x in "bcdefgh")
    data = [(i, f"{common} {' '.join(f'q{chr(97 + i)}{chr(97 + k)}' for k in range(26))}" if i % 5 else None) for i in range(26)]
    batches = [pa.RecordBatch.from_pylist([{"id": i, "text": t}], schema=pa.schema([("id", pa.int64()), ("text", pa.string())])) for i, t in data]
    out = [r for b in token_archive._tokens(tokenizer, 2)(batches) for r in b.to_pylist()]
    want = [(i, n, crc) for i, _, n, crc in archived(data, tokenizer)]
    assert [(r["doc_id"], len(r["ids"]) // 4, zlib.crc32(r["ids"])) for r in out] == want
    assert max(learned.values()) == 1
