"""Operators on small literal tables, with the expectations that the engine must meet."""

import hashlib
import json
import math
import random
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence_engine.operators import adapters, ask, audit, evaluate, prepare, retrieval, review, segment, validate
from evidence_engine.sources import jsonl, manifest, media


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_windows(spark):
    v = spark.createDataFrame([("a", 42.0), ("b", 5.0), ("c", 20.0), ("d", 20.001), ("e", 35.0)], "video_id string, duration double")
    got = segment.build_windows(v, 20, 5).orderBy("video_id", "ordinal")
    by = {}
    for video, s, e in rows(got, "video_id", "start_time", "end_time"):
        by.setdefault(video, []).append((s, e))
    assert by == {"a": [(0, 20), (15, 35), (30, 42)], "b": [(0, 5)], "c": [(0, 20)], "d": [(0, 20), (15, 20.001)], "e": [(0, 20), (15, 35)]}
    with pytest.raises(ValueError):
        segment.build_windows(v, 20, 20)
    with pytest.raises(Exception, match="positive"):
        segment.build_windows(spark.createDataFrame([("z", 0.0)], "video_id string, duration double")).collect()


def test_alignment(spark):
    w = segment.build_windows(spark.createDataFrame([("v", 30.0)], "video_id string, duration double"), 20, 5)
    spans = spark.createDataFrame([("v", 1, 2.0, 4.0, " one "), ("v", 2, 17.0, 22.0, "two"), ("v", 3, 1.0, 29.0, " ")], "video_id string, ord int, start double, end double, text string")
    frames = spark.createDataFrame([("v", 18.0, "f.jpg", "cap"), ("v", 30.0, "end.jpg", "x")], "video_id string, timestamp double, path string, caption string")
    got = segment.with_keyframes(segment.with_transcripts(w, spans), frames).orderBy("ordinal")
    assert rows(got, "segment_id", "transcript", "visual_caption") == [("v_0000", "one two", "cap"), ("v_0001", "two", "cap")]


def test_keyframe_suppression(spark):
    c = spark.createDataFrame([("v", 0.0, 1.0), ("v", 1.0, 3.0), ("v", 2.5, 2.0), ("v", 3.0, 3.0), ("v", 9.0, 0.1)], "video_id string, timestamp double, score double")
    d = spark.createDataFrame([("v", 60.0)], "video_id string, duration double")
    assert [t for (t,) in rows(segment.greedy_keyframes(c, d), "timestamp")] == [1.0, 3.0, 9.0]
    assert [t for (t,) in rows(segment.greedy_keyframes(c, d, per_minute=1), "timestamp")] == [1.0]


def test_fusion(spark):
    hits = [(1, "sparse", 1, "a", 1), (1, "sparse", 2, "a", 2), (1, "sparse", 3, "b", 3), (1, "dense", 1, "b", 0), (1, "dense", 2, "a", 0)]
    df = spark.createDataFrame(hits, "query_id int, route string, pos int, segment_id string, rank int")
    got = retrieval.fuse(df).orderBy("rank").collect()
    assert [(r["segment_id"], r["source"]) for r in got] == [("a", "dense+sparse"), ("b", "dense+sparse")]
    assert got[0]["score"] == pytest.approx(1 / 61 + 1 / 62) and got[1]["score"] == pytest.approx(1 / 63 + 1 / 61)
    assert retrieval.fuse(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        retrieval.fuse(df, 0)
    sets = retrieval.route_sets(df.withColumn("score", F.lit(1.0)), ("dense", "sparse"))
    assert {r["route_set"] for r in sets.collect()} == {"dense", "sparse", "dense+sparse"}


def test_lexical(spark):
    docs = spark.createDataFrame([("a", "red fox red"), ("b", "blue fox"), ("c", ""), ("d", None)], "segment_id string, text string")
    q = spark.createDataFrame([(1, "red red fox"), (2, "none"), (3, "")], "query_id int, query string")
    got = retrieval.lexical_search(docs, q, 5).collect()
    import math

    idf = lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    want = {"a": 2 * idf(1) * 2 / 3.2 + idf(2) / 2.2, "b": idf(2) / 2.2}
    assert {r["segment_id"]: r["score"] for r in got} == {k: pytest.approx(v) for k, v in want.items()} and {r["query_id"] for r in got} == {1}
    assert retrieval.lexical_search(docs, q, 0).count() == 0


def test_term_search_against_all_pairs(spark, monkeypatch):
    """Both routes in several blocks of questions, slices and parts of a batch, with copies and ties, against every pair; no pair is a row."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["检索系统"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    texts = [None, ""] + texts * 3  # copies: equal scores, told apart by id
    asked = [" ".join(rng.choice([*words, "absent"]) for _ in range(rng.randint(1, 9))) for _ in range(23)]
    docs = spark.createDataFrame(list(enumerate(texts)), "segment_id long, text string").repartition(3)
    q = spark.createDataFrame([(f"q{i:02}", t) for i, t in enumerate(asked)], "query_id string, query string")
    tokens = lambda t: [] if not t else [x for w in t.lower().split() for x in ([w, *(w[i : i + 2] for i in range(len(w) - 1))] if w[0] > "z" else [w])]
    own = [tokens(t) for t in texts]
    df = {w: sum(w in o for o in own) for o in own for w in o}
    want = {"lexical": {}, "overlap": {}}
    for i, t in enumerate(asked):
        for route in want:
            weigh = lambda w, o: math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * o.count(w) / (o.count(w) + 1.2)
            score = lambda o, route=route, mine=tokens(t): sum(weigh(w, o) for w in mine if w in o) if route == "lexical" else sum(w in o for w in set(mine)) / len(set(mine))
            ranked = sorted((-round(s, 9), k) for k, o in enumerate(own) if (s := score(o)) > 0)[:7]
            want[route] |= {(f"q{i:02}", rank): (k, -s) for rank, (s, k) in enumerate(ranked, 1)}
    for block, part, cells in ((2_048, 256, 2_000_000), (8, 3, 100)):
        for name, value in (("QUESTION_BLOCK", block), ("QUESTION_SLICE", part), ("CELLS", cells)):
            monkeypatch.setattr(retrieval, name, value)
        found = retrieval.term_search(docs, q, 7)
        got = {"lexical": {}, "overlap": {}}
        for r in found.collect():
            got[r["route"]][r["query_id"], r["rank"]] = (r["segment_id"], pytest.approx(r["score"], abs=2e-9))
        assert got == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate" not in plan


def test_containing_shuffles_no_text(spark):
    corpus = spark.createDataFrame([(1, "one two three four"), (2, "two three"), (3, None), (4, "a - b")], "segment_id long, text string")
    items = spark.createDataFrame([(1, "one two three"), (2, "two three"), (3, " - ")], "query_id long, text string")
    found = retrieval.containing(corpus, items)
    assert sorted(map(tuple, found.select("query_id", "segment_id").collect())) == [(1, 1), (2, 1), (2, 2), (3, 4)]
    exchanges = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "segment_id" in line.split("Join", 1)[1].split("(")[0]]
    assert not exchanges and "segment_id#" not in " ".join(line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line)


def test_review_flags_meet_texts_by_gram(spark):
    """A question that can't be answered is flagged if its video says four of its characters in a row, with no comparison of each gram."""
    qs = spark.createDataFrame([("a", 1, "where is the cat?", "x", "audio", False, "v", [], None), ("b", 2, "zzzzq?", "x", "audio", False, "v", [], None), ("c", 3, "the cat?", "x", "audio", False, "w", [], None), ("d", 4, "cat?", "x", "audio", False, "v", [], None)], "question_id string, ordinal long, question string, answer string, question_type string, answerable boolean, video_id string, relevant_segment_ids array<string>, source_segment_id string")
    segs = spark.createDataFrame([("s1", "v", "On THE C-A-T sat", None), ("s2", "w", None, "a dog"), ("s3", "u", "the cat", "")], "segment_id string, video_id string, transcript string, visual_caption string")
    near = spark.createDataFrame([], "question_id string, near_duplicate_ids array<string>")
    out = prepare.review_flags(qs, segs, near)
    assert {r["question_id"] for r in out.collect() if "unknown_may_be_answerable_in_video" in r["review_flags"]} == {"a"}
    assert "Contains(text" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "Contains(text#" not in plan


def test_frames(spark):
    frames = spark.createDataFrame([("f1", [1.0, 0.0]), ("f2", [0.8, 0.6]), ("f3", [0.0, 1.0])], "frame_id string, vector array<double>")
    members = spark.createDataFrame([("f1", "s1"), ("f1", "s0"), ("f2", "s2"), ("f3", "s2")], "frame_id string, segment_id string")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    assert rows(retrieval.frame_search(frames, members, q).orderBy("rank"), "segment_id", "best_frame") == [("s0", "f1"), ("s1", "f1"), ("s2", "f2")]
    top2 = dict(rows(retrieval.frame_search(frames, members, q, aggregation="top2_mean"), "segment_id", "score"))
    assert top2["s2"] == pytest.approx(0.4)
    with pytest.raises(ValueError):
        retrieval.frame_search(frames, members, q, aggregation="median")
    keyframes = spark.createDataFrame([("s0", "v", 0, 1.0, "p"), ("s1", "v", 1, 1.0, "p"), ("s1", "v", 1, 2.0, "o")], "segment_id string, video_id string, ord int, timestamp double, path string")
    assert rows(retrieval.physical_frames(keyframes).orderBy("path"), "path", "segment_ids") == [("o", ["s1"]), ("p", ["s0", "s1"])]
    with pytest.raises(Exception, match="inconsistent"):
        retrieval.physical_frames(keyframes.union(spark.createDataFrame([("s2", "v", 2, 9.0, "p")], keyframes.schema))).collect()


def test_ask(spark):
    p = ask.Pipeline([ask.Lexical()], minimum_rerank_score=0.01).build(ask.demo_segments(spark))
    p.warmup()
    good = p.ask("how is evidence ranking explained")
    assert good["evidence"][0]["segment_id"] == "demo_0001" and not good["abstained"] and "demo_0001" in good["answer"] and good["evidence"][0]["video_url"] == "/api/videos/demo"
    bad = p.ask("zzz")
    assert bad["abstained"] and bad["evidence"] == [] and bad["answer"] == ask.ABSTENTION
    assert p.video_path("demo") == "demo.mp4" and p.video_path("x") is None
    with pytest.raises(ValueError):
        p.ask("  ")
    with pytest.raises(ValueError):
        ask.Pipeline([])
    with pytest.raises(ValueError):
        ask.Pipeline([ask.Lexical()], rrf_k=0)
    with pytest.raises(RuntimeError):
        ask.Pipeline([ask.Lexical()]).ask("q")
    with pytest.raises(ValueError):
        p.build(ask.demo_segments(spark).union(ask.demo_segments(spark)))
    encode = ask.hashing_encoder(16)
    text = ask.demo_segments(spark).select("segment_id", "transcript")
    two = ask.Pipeline([ask.Lexical(), ask.Dense(encode(text), encode)], minimum_rerank_score=0.01).build(ask.demo_segments(spark))
    assert two.ask("ranking of evidence")["evidence"][0]["segment_id"] == "demo_0001"
    assert ask.predictions(two.ask_batch(spark.createDataFrame([(1, "host introduces")], "query_id long, query string"))).first()["evidence_ids"][0] == "demo_0000"


class Counted:
    """A model that leaves a line in a file for each time it is loaded, called and given up."""

    def __init__(self, path):
        import os

        self.path, self.pid = path, os.getpid()
        self.say("load")

    def say(self, what):
        with open(self.path, "a") as f:
            f.write(f"{what} {self.pid}\n")

    def encode(self, texts, prompt):
        self.say(f"call {len(texts)} {sum(map(len, texts))}")
        return [[float(len(t)), float(prompt == "query")] for t in texts]

    def logits(self, pairs):
        return [(0.0, float("yes" in p)) for p in pairs]

    def infer(self, prompt, images):
        self.say("infer")
        return f"{len(images)} {','.join(images)} | {prompt}"

    def unload(self):
        self.say("unload")


def recipe(path, **bounds):
    """A recipe whose model the workers know without this module."""
    source = Counted

    def load():
        return source(path)

    return adapters.Recipe(f"counted-{path}", load, **bounds)


def test_models_are_loaded_once_a_worker(spark, tmp_path):
    from pyspark import cloudpickle as own

    own.register_pickle_by_value(sys.modules[__name__])
    try:
        said = tmp_path / "said"
        texts = [(f"s{n:03}", "x" * (n % 37 + 1)) for n in range(200)] + [("b1", " "), ("b2", None)]
        df = spark.createDataFrame(texts, "segment_id string, text string").repartition(12)
        got = dict(rows(adapters.encode_texts(df, recipe(str(said), most_rows=5, most_characters=60)), "segment_id", "vector"))
        assert got == {i: [float(len(t)), 0.0] for i, t in texts if t and t.strip()}
        lines = [x.split() for x in said.read_text().splitlines()]
        loads, workers = [x[1] for x in lines if x[0] == "load"], {x[-1] for x in lines}
        assert len(loads) == len(set(loads)) == len(workers) < 12
        assert all(int(x[1]) <= 5 and (int(x[2]) <= 60 or x[1] == "1") for x in lines if x[0] == "call")
        assert adapters.encode_texts(df.limit(1), recipe(str(tmp_path / "p")), prompt="query").first()["vector"][1] == 1.0
        freed = tmp_path / "freed"
        adapters.encode_texts(df, recipe(str(freed), release=True)).count()
        lines = [x.split()[0] for x in freed.read_text().splitlines()]
        assert lines.count("load") == lines.count("unload") > 0

        paths = []
        for n in range(9):
            (tmp_path / f"f{n}.jpg").write_text("")
            paths.append(str(tmp_path / f"f{n}.jpg"))
        (tmp_path / "f1.jpg").unlink()
        kind = "query_id int, query string, place int, segment_id string, start_time double, end_time double, transcript string, visual_caption string, keyframes array<struct<path:string>>"
        evidence = spark.createDataFrame([(1, "who?", 2, "b", 5.0, 9.25, "second", "", [(p,) for p in paths[4:]]), (1, "who?", 1, "a", 0.0, 4.0, "first", "seen", [(p,) for p in paths[:4]]), (2, "what?", 1, "c", 0.0, 1.0, "third", None, None)], kind)
        answers = dict(rows(adapters.generate(adapters.grounded_prompts(evidence), adapters.Generation(recipe(str(tmp_path / "g"), release=True))), "query_id", "answer"))
        assert answers[1].split(" | ")[0] == "6 " + ",".join([paths[0], *paths[2:7]]) and answers[2].startswith("0 ")
        assert answers[1].index("[a] Time 0.0-4.0 seconds") < answers[1].index("[b] Time 5.0-9.2 seconds") and "Question: who?" in answers[1]
        frames = spark.createDataFrame([(p,) for p in paths[2:4]], "path string")
        assert [r["caption"][:2] for r in adapters.caption_frames(frames, adapters.Generation(recipe(str(tmp_path / "c")))).collect()] == ["1 ", "1 "]
        with pytest.raises(Exception, match="f1.jpg"):
            adapters.caption_frames(spark.createDataFrame([(paths[1],)], "path string"), adapters.Generation(recipe(str(tmp_path / "c")))).collect()
        made = ask.Pipeline([ask.Lexical()], reranker=recipe(str(tmp_path / "r")), generator=adapters.Generation(recipe(str(tmp_path / "a")))).build(ask.demo_segments(spark))
        best = made.ask("which retrieval system, yes?")
        assert not best["abstained"] and "[demo_0000]" in best["answer"] and abs(best["evidence"][0]["rerank_score"] - 1 / (1 + math.exp(-1))) < 1e-12
    finally:
        own.unregister_pickle_by_value(sys.modules[__name__])


def test_unwrap():
    from types import SimpleNamespace as N

    hidden = np.arange(12.0).reshape(2, 3, 2)
    assert adapters.unwrap(N(image_embeds=1, text_embeds=2)) == 1 and adapters.unwrap(N(image_embeds=None, text_embeds=2)) == 2 and adapters.unwrap(N(pooler_output=3)) == 3
    assert adapters.unwrap(N(pooler_output=None, last_hidden_state=hidden)).tolist() == [[0.0, 1.0], [6.0, 7.0]] and adapters.unwrap([5]) == [5]
    assert adapters.yes_probability(0.0, 0.0) == 0.5 and adapters.yes_probability(0.0, 1000.0) == 1.0 and adapters.yes_probability(1000.0, 0.0) == 0.0


def test_containing(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(("alpha", "beta", "gamma", "delta", "x1", "été", "-", "e.g.")) for _ in range(30)) for _ in range(60)] + ["", None, "alphabet soup"]
    items = [t[a : a + rng.randint(1, 25)] for t in texts[:60] for a in (rng.randrange(60),)] + ["", None, "nowhere to be found here", "alpha", "-", " beta ", "lpha be"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "segment_id long, text string").repartition(3)
    asked = spark.createDataFrame(list(enumerate(items)), "query_id long, text string")
    want = sorted((q, s) for q, i in enumerate(items) for s, t in enumerate(texts) if i is not None and t is not None and i in t)
    assert sorted(rows(retrieval.containing(corpus, asked), "query_id", "segment_id")) == want


def test_least_of_component(spark):
    rng = random.Random(1)
    links = [(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(170)] + [(f"p{k:03}", f"p{k + 1:03}") for k in range(90)] + [("hub", f"x{k}") for k in range(200)]
    least = {}
    for a, b in links:
        if a != b:
            least |= {a: a, b: b}
    while any(least[a] != least[b] for a, b in links if a != b):
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert dict(rows(prepare.least_of_component(spark.createDataFrame(links, "a string, b string")), "node", "least")) == least
    assert prepare.least_of_component(spark.createDataFrame([], "a string, b string")).count() == 0


def test_paraphrase_groups(spark):
    """Later questions take groups over, as they do when the set is walked in order."""
    rng = random.Random(6)
    q = [(f"q{n:02}", n) for n in range(60)]
    near = {n: sorted(rng.sample(range(n), min(n, rng.choice((0, 0, 0, 1, 1, 2, 3))))) for _, n in q}
    group = {}
    for name, n in q:
        before = [f"q{e:02}" for e in near[n]]
        if before:
            own = next((group[e] for e in before if e in group), f"para_{before[0]}")
            for e in [name, *before]:
                group[e] = own
    pairs = spark.createDataFrame([(f"q{n:02}", f"q{e:02}", 0.9) for n, found in near.items() for e in found], "later string, earlier string, ratio double")
    assert dict(rows(prepare.paraphrase_groups(pairs, spark.createDataFrame(q, "question_id string, ordinal int")), "question_id", "paraphrase_group_id")) == group
    assert len(set(group.values())) > 2


def test_evidence_skeleton(spark):
    segs = spark.createDataFrame([("a", "v", 9.0, "said", [(2.0,), (1.0,)]), ("b", "v", 20.0, "more ", [(2.0,)]), ("c", "w", 5.0, " ", None)], "segment_id string, video_id string, end_time double, transcript string, keyframes array<struct<timestamp:double>>")
    q = [(1, "audio", True, "v", ["b", "a"]), (2, "visual", True, "v", ["a", "b"]), (3, "multimodal", True, "v", ["a"]), (4, "ocr", True, "v", ["b"]), (5, "audio", False, "v", ["a"]), (6, "visual", True, "w", ["c", "zz"]), (7, "audio", True, "none", [])]
    got = {r["question_id"]: r for r in prepare.evidence_skeleton(spark.createDataFrame([(*x, "42") for x in q], "question_id int, question_type string, answerable boolean, video_id string, relevant_segment_ids array<string>, answer string"), segs).collect()}
    e = {n: r["modality_evidence"] for n, r in got.items()}
    assert e[1]["asr"].asDict() == {"quote": "more  said", "segment_ids": ["b", "a"], "human_verified": False} and e[1]["visual"] is None
    assert e[2]["visual"].asDict() == {"frame_timestamps": [1.0, 2.0], "human_observation": "", "human_verified": False} and e[2]["asr"] is None
    assert e[3]["asr"]["quote"] == "said" and e[3]["visual"]["frame_timestamps"] == [1.0, 2.0] and e[4]["ocr"].asDict() == {"text": "42", "frame_timestamps": [2.0], "human_verified": False}
    assert e[5].asDict() == e[6].asDict() == e[7].asDict() == {"asr": None, "visual": None, "ocr": None}
    assert (got[5]["unanswerable_reason"], got[5]["checked_time_ranges"], got[5]["video_duration"], got[1]["unanswerable_reason"]) == ("outside_video_scope", [], 20.0, None)


def test_stage_latency(spark):
    p = ask.Pipeline([ask.Lexical()]).build(ask.demo_segments(spark))
    asked = spark.createDataFrame([(1, "retrieval system"), (2, "nothing of it")], "query_id long, query string")
    answers, spans = p.timed(asked)
    assert sorted(map(str, answers)) == sorted(map(str, p.ask_batch(asked).collect()))
    assert list(spans) == ["recall", "fusion", "rerank", "generation", "total"] and abs(sum(spans.values()) - 2 * spans["total"]) < 1e-6
    samples = p.benchmark(["retrieval system"], 3)
    report = {r["stage"]: r for r in evaluate.latency_summary(samples.where("run > 0"), ("stage",)).collect()}
    assert set(report) == set(spans) and all(r["n"] == 2 and r["p50"] <= r["max"] for r in report.values())
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_metrics(spark):
    hits = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (2, "b", 1)], "query_id int, segment_id string, rank int")
    rel = spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, segment_id string")
    m = evaluate.macro_average(evaluate.retrieval_by_question(hits, rel, (1, 2))).first()
    assert (m["recall_at_1"], m["recall_at_2"], m["mrr"]) == (0.5, 1.0, 0.75)
    more = evaluate.retrieval_by_question(hits, rel.union(spark.createDataFrame([(3, "z")], rel.schema)), (1,)).where("query_id = 3").first()
    assert more["recall_at_1"] == 0.0 and more["mrr"] == 0.0 and more["ndcg_at_1"] == 0.0
    pairs = spark.createDataFrame([("CLIP 模型", "clip模型"), ("", ""), (None, "a"), ("ab", "abc")], "prediction string, reference string")
    assert rows(evaluate.answer_scores(pairs), "exact_match", "token_f1") == [(1.0, 1.0), (1.0, 1.0), (0.0, 0.0), (0.0, 0.8)]
    v = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double")
    assert v.select(evaluate.percentile_linear(F.col("v"), 0.9)).first()[0] == pytest.approx(2.8)
    assert spark.createDataFrame([(1.0,), (2.0,), (10.0,)], "v double").select(evaluate.percentile_nearest(F.col("v"), 0.95)).first()[0] == 10
    delta = evaluate.rank_delta(hits.where("query_id = 1"), hits, rel)
    assert dict(rows(delta, "query_id", "change")) == {1: "unchanged", 2: "regressed"}


SEGMENTS = "video_id string, segment_id string, start_time double, end_time double, n_frames int"


def test_audit(spark):
    df = spark.createDataFrame([("v", "b", 15.0, 35.0, 0), ("v", "a", 0.0, 20.0, 0), ("v", "c", 30.0, 50.0, 1)], SEGMENTS)
    assert rows(audit.longest_zero_run(df), "run", "span", "segment_ids") == [(2, 35.0, "a,b")]
    t = audit.plan_totals(audit.plan_supplement(df.where("segment_id <> 'c'"), 1)).first()
    assert (t["new_frames"], t["new_memberships"], t["reused_memberships"]) == (1, 2, 1)
    one = spark.createDataFrame([("v", "a", 0.0, 20.0, 1), ("v", "b", 15.0, 35.0, 0)], SEGMENTS)
    t = audit.plan_totals(audit.plan_supplement(one, 2)).first()
    assert (t["new_frames"], t["new_memberships"], t["reused_memberships"]) == (2, 3, 1)
    frames = spark.createDataFrame([("v", 4.0), ("v", 10.0)], "video_id string, timestamp double")
    videos = spark.createDataFrame([("v", 12.0), ("w", 7.0)], "video_id string, duration double")
    assert sorted(rows(audit.frame_gaps(frames, videos), "video_id", "gap")) == [("v", 2.0), ("v", 4.0), ("v", 6.0), ("w", 7.0)]
    assert rows(audit.boundary_reuse(df, spark.createDataFrame([("v", 21.0), ("v", 40.0)], "video_id string, timestamp double")), "segment_id", "distance") == [("a", 1.0)]
    with pytest.raises(ValueError):
        audit.plan_supplement(df, 0)


def naive_plan(segments, target):
    """What a plan says, with every segment looked at for every timestamp."""
    have, out = {s[0]: s[3] for s in segments}, []
    rows_ = sorted(segments, key=lambda s: (s[1], s[2], s[0]))
    while any(have[s[0]] < target for s in rows_):
        open_ = [s for s in rows_ if have[s[0]] < target]
        a, b = open_[0][1:3]
        for s in open_[1:]:
            a, b = (max(a, s[1]), min(b, s[2])) if max(a, s[1]) < min(b, s[2]) else (a, b)
        at = round((a + b) / 2, 3)
        inside = [s[0] for s in rows_ if s[1] <= at < s[2]]
        aimed = [i for i in inside if have[i] < target] or [open_[0][0]]
        have |= {i: have[i] + 1 for i in aimed}
        out.append((len(out), at, inside, aimed))
    return out


def test_supplement_plan(spark):
    rng = random.Random(8)
    videos = {}
    for v in range(60):
        spans = [(round(rng.uniform(0, 60), rng.choice((0, 1, 4))), rng.choice((0.0004, 1.0, 5.0, 20.0, 90.0))) for _ in range(rng.randint(1, 25))]
        videos[f"v{v:02}"] = [(f"s{k:02}", a, a + n, rng.choice((0, 0, 0, 1, 3))) for k, (a, n) in enumerate(spans)]
    df = spark.createDataFrame([(v, *s) for v, own in videos.items() for s in own], "video_id string, segment_id string, start_time double, end_time double, n_frames int").repartition(5)
    for target in (1, 2):
        got = {}
        for r in sorted(audit.plan_supplement(df, target).collect()):
            got.setdefault(r["video_id"], []).append(tuple(r)[1:])
        assert got == {v: p for v, own in videos.items() if (p := naive_plan(own, target))}


def test_supplement_choice(spark):
    trials = spark.createDataFrame([("v", 0, 0, 1.0, 0b0), ("v", 0, 1, 2.0, 0b1111), ("v", 1, 0, 3.0, 0b1), ("v", 1, 1, 4.0, 0b11), ("w", 0, 0, 5.0, 0b0), ("w", 0, 1, 6.0, 0b1)], "video_id string, ordinal int, attempt int, timestamp double, phash long")
    known = spark.createDataFrame([("v", 0), ("v", 0), ("x", 0b1111)], "video_id string, phash long")
    got = audit.choose_supplement_frames(trials, known, 3)
    assert sorted(rows(got, "video_id", "ordinal", "attempt", "nearest", "near_duplicate")) == [("v", 0, 1, 4, False), ("v", 1, 1, 2, True), ("w", 0, 0, 64, False)]


def test_supplement_choice_against_all_known_frames(spark):
    """Known frames without a video count for every video; in groups of 16 attempts and in one, as when all are compared."""
    rng = random.Random(3)
    hashes = [rng.getrandbits(64) - (1 << 63) for _ in range(60)]
    trials = [(f"v{i // 10}", i % 10 // 5, i % 5, float(i), rng.choice(hashes) ^ rng.getrandbits(rng.choice((1, 8, 30)))) for i in range(200)]
    trials[7] = (*trials[7][:4], None)
    known = [*hashes[:20], hashes[0], None]
    df, of = spark.createDataFrame(trials, "video_id string, ordinal int, attempt int, timestamp double, phash long"), spark.createDataFrame([(k,) for k in known], "phash long")
    far = {t: min((((t[4] ^ k) & ((1 << 64) - 1)).bit_count() for k in known if k is not None), default=64) if t[4] is not None else 64 for t in trials}
    for held in (16, 1 << 16):
        assert {tuple(r)[:5]: r["nearest"] for r in audit._nearest_of_all(df, of, held).collect()} == far
    assert {r["nearest"] for r in audit._nearest_of_all(df, of.limit(0)).collect()} == {64}
    best = {}
    for t in sorted(trials, key=lambda t: (far[t] <= 6, t[2] if far[t] > 6 else 0, -far[t], t[2])):
        best.setdefault(t[:2], (t[2], far[t], far[t] <= 6))
    got = audit.choose_supplement_frames(df, of, 6).collect()
    assert {(r["video_id"], r["ordinal"]): (r["attempt"], r["nearest"], r["near_duplicate"]) for r in got} == best


EVENTS = "line_no long, event_id string, sequence int, previous_event_id string, question_id string, action string, candidate_file_sha256 string"


def log(spark, *actions, **change):
    out, last = [], {}
    for n, (q, a) in enumerate(actions, 1):
        out.append([n, f"e{n}", n, last.get(q), q, a, "sha"])
        last[q] = f"e{n}"
    for k, v in change.items():
        out[-1][EVENTS.replace(",", "").split()[::2].index(k)] = v
    return spark.createDataFrame([tuple(r) for r in out], EVENTS)


@pytest.mark.parametrize("actions", [("accept", "reject"), ("reject", "accept"), ("accept", "accept"), ("accept", "reopen")])
def test_log_fold(spark, actions):
    events = log(spark, *(("q", a) for a in actions))
    known = spark.createDataFrame([("q",), ("r",)], "question_id string")
    assert review.log_violations(events, known, "sha").count() == 0
    latest = review.latest_decisions(events)
    assert latest.first()["action"] == actions[-1]
    p = review.progress(known, latest).first()
    assert p["pending"] == (2 if actions[-1] == "reopen" else 1) and review.export_summary(known, latest).first()["pending"] == 1


@pytest.mark.parametrize(("change", "message"), [({"event_id": "e1"}, "duplicate"), ({"event_id": ""}, "empty"), ({"sequence": 5}, "sequence"), ({"candidate_file_sha256": "x"}, "SHA"), ({"previous_event_id": "e9"}, "chain"), ({"action": "maybe"}, "action"), ({"question_id": "zz", "previous_event_id": None}, "unknown")])
def test_log_integrity(spark, change, message):
    events = log(spark, ("q", "accept"), ("q", "reject"), **change)
    with pytest.raises(ValueError, match=message):
        review.require_sound(review.log_violations(events, spark.createDataFrame([("q",)], "question_id string"), "sha"))


def test_append(spark):
    latest = review.latest_decisions(log(spark, ("q", "accept")))
    asked = spark.createDataFrame([("q", "reopen", "e1", "again", None, 1), ("q", "reject", "e1", "why", None, 2), ("r", "accept", None, "", True, 3), ("s", "accept", None, "", None, 4), ("t", "reopen", None, "x", None, 5), ("u", "reject", "e7", "why", None, 6)], "question_id string, action string, base_event_id string, reason string, playback boolean, request_no int")
    events, refused = review.append_decisions(asked, latest, 1)
    assert rows(events.orderBy("sequence"), "question_id", "sequence", "previous_event_id") == [("q", 2, "e1"), ("r", 3, None)]
    assert {n: w[:3] for n, w in rows(refused, "request_no", "refusal")} == {2: "409", 4: "400", 5: "409", 6: "409"}


def test_append_refuses(spark):
    latest = review.latest_decisions(log(spark, ("q", "accept"), ("q", "reopen")))
    fields = "question_id string, action string, base_event_id string, reason string, playback boolean, request_no int, edited_question_id string, edited_video_id string"
    cases = [
        ("q", "reject", "e2", " ", None, 1, "q", "v", "400 reject needs a reason"), ("zz", "reject", None, "x", None, 2, "zz", "v", "400 unknown question or action"), ("r", "drop", None, "x", None, 3, "r", "v", "400 unknown question or action"),
        ("r", "reject", None, "x", None, 4, "q", "v", "400 question_id and video_id must not change"), ("s", "accept", None, "", True, 5, "s", "w", "400 question_id and video_id must not change"), ("t", "accept", None, "", True, 6, "t", "v", "400 accepted annotation is invalid"),
        ("u", "accept", None, "", False, 7, "u", "v", "400 accept needs playback"), ("w", "reopen", None, "x", None, 8, "w", "v", "409 nothing to reopen"), ("x", None, None, "x", None, 9, "x", "v", "400 unknown question or action"), ("p", "reject", None, "x", None, 10, "p", "v", None),
    ]
    asked = spark.createDataFrame([c[:-1] for c in cases], fields)
    candidates = spark.createDataFrame([(i, "v") for i in "pqrstuwx"], "question_id string, video_id string")
    events, refused = review.append_decisions(asked, latest, 2, candidates, spark.createDataFrame([(6,)], "request_no int"))
    assert dict(rows(refused, "request_no", "refusal")) == {c[5]: c[-1] for c in cases if c[-1]}
    assert rows(events, "question_id", "sequence", "action") == [("p", 3, "reject")]
    again, refused = review.append_decisions(spark.createDataFrame([("q", "reopen", "e2", "x", None, 1)], fields.split(", edited")[0]), latest, 2)
    assert again.count() == 1  # a reopened question may be reopened


def test_review_log(spark, tmp_path):
    """Accept, export, reopen, a stale tab, a lost race, and the fold from a snapshot."""
    from evidence_engine.sources import review_log

    segments = spark.createDataFrame([("s1", "v", 0.0, 20.0, "He said hello there.", [(5.0,)])], "segment_id string, video_id string, start_time double, end_time double, transcript string, keyframes array<struct<timestamp: double>>")
    open_ = [question(question_id=f"q{n}", verification_status="generated_candidate", annotation_source="model", reviewer_id="drop", review_event_id="drop", reviewed_at="drop") for n in range(3)]
    lines = spark.createDataFrame([(n, json.dumps(q)) for n, q in enumerate(open_, 1)], "line long, raw string")
    held = review_log.ReviewLog(spark, str(tmp_path / "log"), lines, segments)
    accept = lambda n, base=None, **change: {"question_id": f"q{n}", "action": "accept", "base_event_id": base, "reason": "played", "edited": open_[n] | change, "playback": True}
    (one,), refused = held.decide([accept(0), accept(1, answer=" "), accept(0)], "ann")
    assert one["sequence"] == 1 and refused == {1: "400 accepted annotation is invalid", 2: "409 stale base event"}
    exported = [json.loads(r["raw"]) for r in held.export().collect()]
    assert [(q["question_id"], q["review_event_id"], q["reviewer_id"], q["verification_status"]) for q in exported] == [("q0", one["event_id"], "ann", "verified")]
    assert held.snapshot() == 1
    reopen = {"question_id": "q0", "action": "reopen", "base_event_id": one["event_id"], "reason": "again"}
    (two,), refused = held.decide([reopen], "bob")
    assert (two["sequence"], two["previous_event_id"], refused) == (2, one["event_id"], {}) and held.export().count() == 0
    assert held.decide([reopen], "tab")[1] == {0: "409 stale base event"}
    # Two writers, the second of which read the log before the first wrote: it loses the number, and is judged anew.
    other, put = review_log.ReviewLog(spark, str(tmp_path / "log"), lines, segments), review_log.ReviewLog._put
    racing = [True]

    def late(self, number, text):
        if racing.pop():
            racing.append(False)
            assert len(other.decide([accept(1)], "first")[0]) == 1
        else:
            racing.append(False)
        return put(self, number, text)

    held._put = late.__get__(held)
    made, refused = held.decide([accept(1) | {"reason": "late"}, {"question_id": "q2", "action": "reject", "reason": "vague", "edited": open_[2]}], "second")
    assert [(e["question_id"], e["sequence"]) for e in made] == [("q2", 4)] and refused == {0: "409 stale base event"}
    assert held.snapshot() == 4 and sorted(rows(held.latest(), "question_id", "action", "sequence")) == [("q0", "reopen", 2), ("q1", "accept", 3), ("q2", "reject", 4)]
    assert held.violations().count() == 0
    assert not put(held, 4, "x") and sorted(p.name for p in (tmp_path / "log" / "events").iterdir() if not p.name.startswith(".")) == [f"{n:012}.json" for n in (1, 2, 3, 4)]


def question(**change):
    q = {
        "question_id": "q1", "question": "what?", "answer": "yes", "answer_aliases": ["yes"], "question_type": "audio", "video_id": "v", "relevant_segment_ids": ["s1"], "evidence_start": 1.0, "evidence_end": 8.0,
        "answerable": True, "verification_status": "verified", "annotation_source": "human_review", "reviewer_id": "r", "reviewed_at": "2024-01-01T00:00:00Z", "review_event_id": "e",
        "modality_evidence": {"asr": {"quote": "Hello there", "segment_ids": ["s1"], "human_verified": True}},
    }
    return {k: v for k, v in (q | change).items() if v != "drop"}


FRAMED = {"frame_timestamps": [5.0], "human_verified": True}
UNKNOWN = {"answerable": False, "relevant_segment_ids": [], "evidence_start": None, "evidence_end": None, "modality_evidence": {}, "unanswerable_reason": "not_visible", "question_type": "unknown_route"}
CASES = [
    ({}, []), ({"answer": "drop"}, ["missing fields"]), ({"question_type": "x"}, ["unsupported question_type"]), ({"verification_status": "x"}, ["unsupported verification_status"]),
    ({"annotation_source": "model"}, ["human_review"]), ({"reviewer_id": " "}, ["reviewer_id"]), ({"reviewed_at": "2024-01-01T00:00:00"}, ["timezone"]), ({"reviewed_at": "2024-01-01T00:00:00+08:00"}, []),
    ({"review_event_id": "drop"}, ["review_event_id"]), ({"split": "x"}, ["invalid split"]), ({"answer": " "}, ["requires answer", "canonical"]), ({"answer_aliases": []}, ["canonical"]), ({"answer_aliases": ["yes", " yes"]}, ["duplicates"]),
    ({"answer_aliases": ["yes", " "]}, ["non-empty"]), ({"relevant_segment_ids": []}, ["requires relevant", "ASR"]), ({"relevant_segment_ids": ["s1", "zz"]}, ["unknown segment zz"]), ({"relevant_segment_ids": ["s1", "o1"]}, ["another video o1"]),
    ({"evidence_start": 9.0}, ["invalid evidence interval"]), ({"evidence_end": 20.06}, ["exceeds"]), ({"evidence_start": 18.5, "evidence_end": 20.0, "relevant_segment_ids": ["s1", "s3"]}, ["interval: s3"]), ({"modality_evidence": None}, ["modality_evidence object", "ASR"]),
    ({"modality_evidence": {"asr": {"quote": "absent words", "segment_ids": ["s1"], "human_verified": True}}}, ["ASR"]), ({"modality_evidence": {"asr": {"quote": "HELLO  there", "segment_ids": ["s1"], "human_verified": True}}}, []),
    ({"question_type": "visual"}, ["visual"]), ({"question_type": "visual", "modality_evidence": {"visual": FRAMED | {"human_observation": "x"}}}, []), ({"question_type": "visual", "modality_evidence": {"visual": FRAMED | {"human_observation": "x", "frame_timestamps": [6.0]}}}, ["visual"]),
    ({"question_type": "ocr", "modality_evidence": {"ocr": FRAMED | {"text": "x"}}}, []), ({"question_type": "multimodal"}, ["two valid"]), ({"question_type": "multimodal", "modality_evidence": question()["modality_evidence"] | {"ocr": FRAMED | {"text": "x"}}}, []),
    (UNKNOWN | {"checked_time_ranges": [[0, 20]]}, []), (UNKNOWN | {"checked_time_ranges": [[0, 12], [10, 20]]}, ["overlap"]), (UNKNOWN | {"checked_time_ranges": [[0, 12]]}, ["full video"]), (UNKNOWN, ["requires checked_time_ranges"]),
    (UNKNOWN | {"checked_time_ranges": [[0, 20]], "unanswerable_reason": "x"}, ["unanswerable_reason"]), (UNKNOWN | {"checked_time_ranges": [[0, 20]], "relevant_segment_ids": ["s1"]}, ["must not contain relevant"]), (UNKNOWN | {"checked_time_ranges": [[0, 20]], "evidence_start": 1.0}, ["must be null"]),
]


def test_validation(spark):
    segs = [("s1", "v", 0.0, 20.0, "He said hello there.", [5.0]), ("o1", "o", 0.0, 20.0, "", []), ("s3", "v", 0.0, 18.0, "", [])]
    segments = spark.createDataFrame([(*s[:5], [(t,) for t in s[5]]) for s in segs], "segment_id string, video_id string, start_time double, end_time double, transcript string, keyframes array<struct<timestamp: double>>")
    lines = spark.createDataFrame([(n, json.dumps(question(**{"question_id": f"q{n}"} | c))) for n, (c, _) in enumerate(CASES, 1)], "line long, raw string")
    found = {}
    for line, message in rows(validate.violations(validate.parse_questions(lines), segments).orderBy("line", "rule"), "line", "message"):
        found.setdefault(line, []).append(message)
    for n, (c, want) in enumerate(CASES, 1):
        got = found.get(n, [])
        assert len(got) == len(want) and all(w in g for w, g in zip(want, got)), (c, got)
    counts = dict(((k, v), n) for k, v, n in rows(validate.summary(validate.parse_questions(lines)), "kind", "value", "n"))
    assert counts["verification_status", "x"] == 1 and counts["answerable", "false"] == 7
    assert validate.warnings(validate.summary(validate.parse_questions(lines.where("line = 1")))).count() == 1


def test_leaks(spark):
    made = [question(question_id="a", split="test", paraphrase_group_id="p"), question(question_id="b", split="validation"), question(question_id="c", video_id="o", relevant_segment_ids=["o1"], split="validation", paraphrase_group_id="p"), question(question_id="a", split=None)]
    lines = spark.createDataFrame([(n, json.dumps(q)) for n, q in enumerate(made, 1)], "line long, raw string")
    segments = spark.createDataFrame([("s1", "v", 0.0, 20.0, "hello there", []), ("o1", "o", 0.0, 20.0, "hello there", [])], "segment_id string, video_id string, start_time double, end_time double, transcript string, keyframes array<struct<timestamp: double>>")
    got = rows(validate.violations(validate.parse_questions(lines), segments, require_splits=True).orderBy("line", "rule"), "line", "message")
    assert [(n, m) for n, m in got if "ASR" not in m] == [(2, "video leaks across splits"), (3, "paraphrase group leaks across splits"), (4, "duplicate or empty question_id"), (4, "verified item requires frozen split")]


def test_preparation(spark):
    q = spark.createDataFrame([("a", 1, "what colour is the car in the video?"), ("b", 2, "What colour is the car in this video?"), ("c", 3, "who speaks?"), ("d", 4, "diet"), ("e", 5, "tide"), ("f", 6, "what colour is the car in the video")], "question_id string, ordinal int, question string")
    pairs = prepare.similar_pairs(q)
    assert sorted(rows(pairs, "later", "earlier")) == [("b", "a"), ("f", "a"), ("f", "b")]
    low = prepare.similar_pairs(q, threshold=0.25).where("later = 'e' and earlier = 'd'").first()
    assert low["ratio"] == pytest.approx(0.25)
    assert dict(rows(prepare.first_near(pairs, q), "question_id", "near_duplicate_ids")) == {"b": ["a"], "f": ["a", "b"]}
    rr = prepare.round_robin(spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "g string, o int"), "g", "o").orderBy("turn", "g")
    assert rows(rr, "g", "o") == [("x", 1), ("y", 1), ("x", 2)]
    items = spark.createDataFrame([(i, float(s)) for i, s in enumerate((5, 1, 3, 9))], "id int, size double")
    assert [i for (i,) in rows(prepare.budgeted(items, "size", 9.0, 3, ("size", "id")), "id")] == [1, 2, 0]


def test_splits(spark):
    data = [(f"v{i % 60}", ("audio", "visual", "ocr")[i % 3], f"p{i % 9}" if i % 60 < 9 and i < 60 else None, "verified") for i in range(240)]
    q = spark.createDataFrame(data, "video_id string, question_type string, paraphrase_group_id string, verification_status string")
    linked = q.union(spark.createDataFrame([("v1", "audio", "z", "verified"), ("v2", "audio", "z", "verified")], q.schema))
    comp = dict(rows(prepare.group_components(linked), "video_id", "component"))
    assert comp["v1"] == comp["v2"] == "v1" and comp["v3"] == "v3"
    splits = prepare.assign_splits(linked, trials=300)
    assert sorted(rows(splits, "video_id", "split")) == sorted(rows(prepare.assign_splits(linked, trials=300), "video_id", "split"))
    by = dict(rows(splits, "video_id", "split"))
    assert by["v1"] == by["v2"] and set(by.values()) == set(prepare.SPLITS)
    assert prepare.freeze(linked, splits).count() == 242
    with pytest.raises(ValueError):
        prepare.freeze(linked.limit(50), splits)
    feasible = prepare.split_feasibility(linked, splits, ("audio", "none"))
    assert dict(rows(feasible, "question_type", "at_least_six")) == {"audio": True, "none": False}


def test_split_search(spark):
    """The trials in arrays draw and choose what one at a time do."""
    rng = random.Random(3)
    drawn = [rng.choices(prepare.SPLITS, weights=[0.7, 0.15, 0.15], k=1)[0] for _ in range(50 * 7)]
    found = np.concatenate(list(prepare.random_choices(3, 50, 7, [0.7, 0.15, 0.15], block=8)))
    assert [prepare.SPLITS[k] for k in found.ravel()] == drawn
    data = [(f"v{i}", t) for i in range(12) for t in ("audio", "visual", "ocr")[: 1 + i % 3] for _ in range(1 + i % 4)]
    q = spark.createDataFrame([(v, t, None) for v, t in data], "video_id string, question_type string, paraphrase_group_id string")
    own = {v: Counter(t for w, t in data if w == v) for v, _ in data}
    order = sorted(own, key=lambda v: (-own[v].total(), hashlib.sha256(v.encode()).hexdigest()))
    every, rng, best = Counter(t for _, t in data), random.Random(5), (math.inf, None)
    for _ in range(400):
        split = {v: rng.choices(prepare.SPLITS, weights=[0.7, 0.15, 0.15], k=1)[0] for v in order}
        cost = 0.0
        for s, ratio in prepare.RATIOS.items():
            held = sum((own[v] for v in order if split[v] == s), Counter())
            cost += 100 * ((held.total() - ratio * len(data)) / len(data)) ** 2 + sum(10 * ((held[t] - n * ratio) / n) ** 2 + 1000 * (held[t] == 0) for t, n in every.items())
        if cost < best[0] - 1e-12:
            best = (cost, split)
    assert dict(rows(prepare.assign_splits(q, 400, 5), "video_id", "split")) == best[1]
    assert rows(prepare.assign_splits(q.limit(0), 10), "video_id") == []


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "segments.jsonl")
    good = {"segment_id": "s", "video_id": "v", "source_path": "p", "start_time": 0.0, "end_time": 2.0, "transcript": "检索", "keyframes": [{"timestamp": 1.0, "path": "f"}]}
    with open(path, "w") as f:
        f.write(json.dumps(good) + "\n\n" + json.dumps(good | {"segment_id": "t"}) + "\n")
    got = jsonl.load_segments(spark, path)
    assert [r["line"] for r in jsonl.numbered_lines(spark, path).collect()] == [1, 3] and got.count() == 2 and got.first()["keyframes"][0]["selection_source"] == "scene_change_v1"
    jsonl.save_segments(got, str(tmp_path / "out"))
    kept = jsonl.load_segments(spark, str(tmp_path / "out"))
    assert sorted(kept.collect()) == sorted(got.collect())
    for line, message in (("{bad", "JSON"), (json.dumps(good | {"extra": 1}), "unknown keys extra"), (json.dumps(good | {"end_time": 0.0}), "time range"), (json.dumps(good | {"video_id": ""}), "identifier")):
        with open(path, "w") as f:
            f.write(json.dumps(good) + "\n\n" + line + "\n")
        with pytest.raises(ValueError, match=f"line 3: .*{message}"):
            jsonl.load_segments(spark, path)
    q = {"question_id": "q", "question": "x", "answer": "y", "relevant_segment_ids": ["s"], "question_type": "audio"}
    for change, message in (({}, None), ({"relevant_segment_ids": ["zz"]}, "unknown segment"), ({"relevant_segment_ids": []}, "empty"), ({"answer": None}, "answer")):
        with open(path, "w") as f:
            f.write(json.dumps(q | change) + "\n")
        if message is None:
            assert jsonl.load_questions(spark, path, kept).count() == 1
        else:
            with pytest.raises(ValueError, match=message):
                jsonl.load_questions(spark, path, kept)


def test_lines_of_a_folder_in_splits(spark, tmp_path):
    rng, want = random.Random(5), []
    for name in ("a.jsonl", "b.jsonl", "c.jsonl"):
        own = [rng.choice(("", "  ", json.dumps({"k": "x" * rng.randrange(90)}))) for _ in range(rng.randint(200, 400))]
        (tmp_path / name).write_text("".join(x + "\n" for x in own))
        want += own
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2500")
        found = jsonl.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        assert sorted(rows(found, "line", "raw")) == [(n, x) for n, x in enumerate(want, 1) if x.strip()]
        assert "map(" not in found._jdf.queryExecution().toString().lower()
        assert jsonl.lenient_rows(spark, str(tmp_path), "k string").count() == sum(bool(x.strip()) for x in want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_catalogue(spark, tmp_path):
    rows_ = [(1, 1, "新闻 <b>联播</b>", "video/webm", 2_000_000, "CC BY"), (1, 2, "新闻联播", "video/webm", 3_000_000, "CC BY"), (2, 1, "にほん新闻", "video/webm", 2_000_000, "CC BY"), (3, 1, "新闻", "image/png", 2_000_000, "CC BY"), (4, 1, "新闻", "video/mp4", 5, "CC BY"), (5, 1, "新闻", "video/mp4", 2_000_000, "secret")]
    df = spark.createDataFrame(rows_, "page_id int, fetched int, title string, mime string, size long, licence string")
    assert rows(jsonl.catalogue_filter(df, 5e6), "page_id", "title", "size") == [(1, "新闻联播", 3_000_000)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "my clip.mp4").write_bytes(b"x")
    (tmp_path / "note.txt").write_bytes(b"x")
    (found,) = jsonl.video_files(spark, str(tmp_path)).collect()
    assert found["video_id"].startswith("my") and len(found["video_id"].rsplit("_", 1)[1]) == 8
    jsonl.write_report(df.select("page_id", "size"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 6


def test_manifest(spark, tmp_path):
    segs = ask.demo_segments(spark)
    vectors = spark.createDataFrame([("demo_0000", [1.0, 0.0]), ("demo_0001", [0.0, 1.0])], "segment_id string, vector array<double>")
    made = manifest.build_manifest(segs, {"text": vectors}, {"text": "m"})
    path = str(tmp_path / "manifest")
    manifest.write_manifest(spark, made, path)
    manifest.write_manifest(spark, made, path)
    assert manifest.validate_manifest(manifest.read_manifest(spark, path), segs.repartition(3), {"text": vectors.repartition(2)}, {"text": "m"}) == made
    with pytest.raises(ValueError):
        manifest.write_manifest(spark, made | {"segment_count": 9}, path)
    for args, message in (((None, segs, {}, {}), "no manifest"), ((made | {"schema_version": 1}, segs, {"text": vectors}, {"text": "m"}), "version"), ((made, segs, {"text": vectors}, {"text": "o"}), "models"), ((made, segs, {}, {"text": "m"}), "other indexes"), ((made, segs.limit(1), {"text": vectors}, {"text": "m"}), "count"), ((made, segs.withColumn("transcript", F.lit("x")), {"text": vectors}, {"text": "m"}), "segments differ"), ((made, segs, {"text": vectors.withColumn("vector", F.reverse("vector"))}, {"text": "m"}), "index text differs")):
        with pytest.raises(ValueError, match=message):
            manifest.validate_manifest(*args)
    with pytest.raises(ValueError):
        manifest.index_spec(vectors.union(vectors))


def test_media_hash(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.random(1024).tolist()) for i in range(3)], "id int, pixels array<double>")
    got = [r["phash"] for r in media.dct_hash(df).collect()]
    assert len(set(got)) == 3 and [r["phash"] for r in media.dct_hash(df).collect()] == got


def test_percentiles_nearest(spark):
    from evidence_engine.operators import evaluate

    data = [("a", float(v)) for v in (5, 1, 1, 9, 3)] + [("b", 2.0), ("b", None), (None, 4.0), (None, 6.0), ("c", None)]
    got = {r["g"]: (r["lo"], r["mid"], r["hi"]) for r in evaluate.percentiles_nearest(spark.createDataFrame(data, "g string, v double"), "g", "v", lo=0.0, mid=0.5, hi=1.0).collect()}
    assert got == {"a": (1.0, 3.0, 9.0), "b": (2.0, 2.0, 2.0), None: (4.0, 4.0, 6.0)}


def test_percentiles_of_large_groups(spark):
    rng = random.Random(4)
    data = [(g, n % 2, v) for g, n, v in ([("a", n, float(rng.randrange(3000))) for n in range(5000)] + [("b", n, rng.choice((1.0, 1.0, 1.0, 7.5))) for n in range(900)] + [("c", n, rng.expovariate(1) * 1e6) for n in range(1200)] + [(None, 0, None), ("d", 0, -0.5)])]
    df = spark.createDataFrame(data, "g string, _v int, v double").repartition(7)
    qs = {f"q{k}": q for k, q in enumerate((0.0, 0.01, 0.333, 0.5, 0.9, 0.95, 0.99, 1.0))}
    got = evaluate.percentiles(df, ("g", "_v"), "v", qs, {f"n_{k}": q for k, q in qs.items()}).collect()
    own = {}
    for g, n, v in data:
        if v is not None:
            own.setdefault((g, n), []).append(v)
    assert {(r["g"], r["_v"]) for r in got} == set(own)
    for r in got:
        v = sorted(own[r["g"], r["_v"]])
        for name, q in qs.items():
            assert r[name] == pytest.approx(np.quantile(v, q)) and r[f"n_{name}"] == v[round((len(v) - 1) * q)]
    assert evaluate.percentiles(df.limit(0), ("g",), "v", {"p": 0.5}).collect() == []


def test_dense_search_by_blocks(spark):
    rng = random.Random(2)
    items = [(i, [rng.choice((-1.0, 0.0, 1.0, 2.0)) for _ in range(4)]) for i in range(400)]
    items = [(i, v) for i, v in items if any(v)] + [(900, None), (901, items[5][1])]
    asked = [(f"q{i}", [float(rng.choice((-1, 1, 2))) for _ in range(4)]) for i in range(30)] + [("none", None)]
    corpus = spark.createDataFrame(items, "segment_id long, vector array<float>").repartition(3)
    queries = spark.createDataFrame(asked, "query_id string, vector array<float>")
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    want = {}
    for q, w in asked:
        if w:
            best = sorted((-round(sum(a * b for a, b in zip(unit(w), unit(v))), 9), i) for i, v in items if v)
            want[q] = [i for _, i in best[:7]]
    for resident in (1 << 10, 1 << 30):
        got = {}
        for r in sorted(retrieval.dense_search(corpus, queries, 7, resident).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append(r["segment_id"])
        assert got == want
    assert retrieval.dense_search(corpus.limit(0), queries, 7).count() == retrieval.dense_search(corpus, queries.limit(0), 7).count() == retrieval.dense_search(corpus, queries, 0).count() == 0


def test_config(tmp_path):
    from evidence_engine.config import load_config

    models = "[models]\n" + "".join(f'{m} = "m"\n' for m in ("text_embedding", "reranker", "vision_language", "clip", "whisper"))
    p = tmp_path / "c.toml"
    p.write_text(models + "[retrieval]\nrrf_k = 10\nsparse_top_k = 7\n[segmentation]\nduration_seconds = 30\n[generation]\nallow_abstention = false\n")
    c = load_config(p)
    assert c["retrieval.rrf_k"] == 10 and c["segmentation.duration_seconds"] == 30.0 and c["segmentation.overlap_seconds"] == 5.0
    made = ask.Pipeline.configured(c, [ask.Lexical()], reranker=ask.overlap_reranker)
    assert made.rrf_k == 10 and made.route_top_k == {"lexical": 7} and not made.allow_abstention and made.rerank_top_k == 3
    for text, message in (("[retrieval]\n", "models.clip is needed"), (models + "[retrieval]\nrrf_k = 0\n", "positive"), (models + "[retrieval]\nrrf_k = 1.5\n", "another kind"), (models + "[retrieval]\nrrf_k = true\n", "another kind"), (models + "[other]\na = 1\n", "other.a is unknown"), (models + "[segmentation]\noverlap_seconds = 20\n", "longer"), ("models = 1\n", "unknown")):
        p.write_text(text)
        with pytest.raises(ValueError, match=message):
            load_config(p)


def test_no_abstention(spark):
    sure = ask.Pipeline([ask.Lexical()], minimum_rerank_score=2.0, allow_abstention=False).build(ask.demo_segments(spark))
    assert not sure.ask("ranking of evidence")["abstained"] and sure.ask("zzz")["abstained"]
    with pytest.raises(ValueError):
        ask.Pipeline([ask.Lexical()], route_top_k={"lexical": 0})
    with pytest.raises(ValueError, match="no segments"):
        ask.Pipeline([ask.Lexical()]).build(ask.demo_segments(spark).limit(0)).warmup()


def test_index(spark, tmp_path):
    from pyspark.errors import PySparkException

    from evidence_engine.sources import index

    segments = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "segment_id long, vector array<double>")
    calls = []

    def encode(rows):
        calls.append(1)
        return rows.select("segment_id", "vector")

    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        index.load_index(spark, path)
    first = index.build_index(segments, encode, path, "m")
    assert first.where("segment_id = 3").first()["raw_norm"] == pytest.approx(10**0.5)
    index.build_index(segments, encode, path, "m")
    assert len(calls) == 1
    more = segments.union(spark.createDataFrame([(9, [1.0, 1.0])], segments.schema))
    assert index.build_index(more, encode, path, "m").count() == 5  # a subset will do
    assert index.build_index(more, encode, path, "m", force=True).count() == 6 and len(calls) == 2
    for args, message in (((segments, "m"), "no segment has"), ((more, "other"), "index of m")):
        with pytest.raises(ValueError, match=message):
            index.load_index(spark, path, *args)
    spark.createDataFrame([(7, 1.0, [1.0, 0.0])], "segment_id long, raw_norm double, vector array<double>").write.mode("append").parquet(f"{path}/vectors")
    with pytest.raises(ValueError, match="manifest"):
        index.load_index(spark, path)
    with pytest.raises(ValueError, match="no segments"):
        index.build_index(segments.limit(0), encode, path, "m")
    for n, bad in enumerate(([0.0, 0.0], [float("nan"), 1.0], [None, 1.0], [float("inf"), 1.0], [], None)):
        with pytest.raises(PySparkException, match="not a vector"):
            index.save_index(spark.createDataFrame([(1, bad)], segments.schema), str(tmp_path / f"bad{n}"), "m")
    with pytest.raises(ValueError, match="not an index"):
        index.save_index(segments.union(segments), str(tmp_path / "twice"), "m")


def test_streams(spark, sf, tmp_path):
    from evidence_engine.streaming import events

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / "p"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in" / "p")).schema).parquet(str(tmp_path / "in" / "p"))
    assert schema

    def run(df, name, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    total = spark.read.parquet(f"{sf}/events.parquet").count()
    counts = run(events.windowed_counts(source, "1 day", "1 day"), "counts", "complete")
    assert counts.agg(F.sum("n")).first()[0] == total
    assert run(events.sessions(source), "sess", "complete").agg(F.sum("n")).first()[0] == total
    assert run(events.without_repeats(source), "dedup", "append").count() == total
    folded = run(events.latest_by_key(source.select(F.col("user_id").alias("question_id"), F.col("event_type").alias("action"), F.col("event_id").alias("sequence"))), "fold", "update")
    want = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("a"), F.max("event_id").alias("s"))
    assert {(r["question_id"], r["action"], r["sequence"]) for r in folded.collect()} == {(str(r["user_id"]), r["a"], r["s"]) for r in want.collect()}
