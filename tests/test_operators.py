import math
import random
import re

import pytest
from pyspark.sql import functions as F

from spanlens import config
from spanlens.config import Options
from spanlens.functions import models
from spanlens.functions.vectors import blocked_scores, weighted_mean
from spanlens.operators import metrics, prompts, reflection, retrieval

KEYS = "id long, name string, type string, s int, e int"
STATS = "token string, n_ent long, n_ctx long, n_oth long, n_tot long, r_ent double, r_ctx double, r_oth double"


def stat(token, e, c, o):
    n = e + c + o
    return (token, e, c, o, n, e / n, c / n, o / n)


def sents(spark, *lines):
    return spark.createDataFrame([(i, i, x.split(), x) for i, x in enumerate(lines, 1)], "id long, ord long, tokens array<string>, sentence string")


def test_scores_are_multisets(spark):
    s = sents(spark, "A B C", "D E", "F")
    gold = spark.createDataFrame([(1, "A", "T", 0, 0), (1, "B", "T", 1, 1), (2, "D", "T", 0, 0), (2, "E", "Z", 1, 1)], KEYS)
    pred = spark.createDataFrame([(1, "A", "T", 0, 0), (1, "A", "T", 0, 0), (1, "Q", "T", 2, 2), (2, "D", "Z", 0, 0)], KEYS)
    got = metrics.scores(metrics.confusion(gold, pred, s, ["T"])).first()
    assert (got["tp"], got["fp"], got["fn"]) == (1, 1, 2) and math.isclose(got["precision"], 0.5) and math.isclose(got["recall"], 1 / 3)
    only = metrics.totals(metrics.confusion(gold, pred, s.where("id = 1"), ["T"])).first()  # no row for 2: its gold doesn't count
    assert tuple(only) == (1, 1, 1)
    none = metrics.scores(metrics.confusion(gold.limit(0), pred.limit(0), s, ["T"])).first()
    assert tuple(none) == (0, 0, 0, 0.0, 0.0, 0.0)


def test_spans_regroup(spark):
    ent = "array<struct<s:int,e:int,name:string,type:string>>"
    rows = spark.createDataFrame([("3_1", [(4, 4, "b", "T")]), ("3_0", [(0, 0, "a", "T")]), ("4", [])], f"span_id string, ents {ent}")
    got = {r["id"]: [x["name"] for x in r["ents"]] for r in metrics.spans_to_sentences(rows).collect()}
    assert got == {3: ["a", "b"], 4: []}


def test_blocked_scores_and_ties(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], "id long, emb array<double>")
    all_ = blocked_scores(v, v.where("id < 4"), demo_rows=7, query_rows=2)
    assert all_.count() == 4 * 29
    top = retrieval.ranked(all_, 3).where("qid = 0").orderBy("rank").collect()
    assert [r["did"] for r in top] == [27, 24, 21] or [r["did"] for r in top][0] > [r["did"] for r in top][1]
    with pytest.raises(ValueError):
        retrieval.ranked(all_, 0)
    assert retrieval.ranked(all_, 99).where("qid = 0").count() == 29  # fewer than k: all


def test_weighted_mean_falls_back(spark):
    rows = spark.createDataFrame([(1, 2.0, 1, [1.0, 0.0]), (1, 0.0, 1, [0.0, 4.0]), (2, 0.0, 1, [1.0, 0.0]), (2, 0.0, 3, [0.0, 4.0])], "id long, w double, n long, emb array<double>")
    got = {r["id"]: r["emb"] for r in weighted_mean(rows).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.25, 3.0]}


def test_token_match_counts_distinct_known_tokens(spark):
    s = sents(spark, "x x yy the z", "yy x q", "the only")
    stats = spark.createDataFrame([stat("x", 1, 0, 0), stat("yy", 0, 0, 1), stat("the", 1, 0, 0)], STATS)
    got = {(r["qid"], r["did"]): r["score"] for r in retrieval.token_match(s, s.where("id = 1"), stats, Options()).collect()}
    assert got == {(1, 2): 1.01}


def test_random_demos(spark):
    s = sents(spark, *["a"] * 20)
    got = retrieval.random_demos(s, s.where("id <= 3"), 4, 1).collect()
    assert {r["qid"] for r in got} == {1, 2, 3} and len(got) == 12 and all(r["qid"] != r["did"] for r in got)


def test_reflection_tokens(spark):
    s = sents(spark, "Fuji rose zorb NATO 77 .", "zorb alone here")
    stats = spark.createDataFrame([stat("Fuji", 20, 0, 0), stat("rose", 0, 6, 4), stat("NATO", 1, 0, 1), stat(".", 0, 0, 9)], STATS)
    pred = spark.createDataFrame([(1, "rose", "T", 1, 1)], KEYS)
    rows = reflection.annotated_tokens(s, pred, stats)
    o = Options()
    assert [(r["id"], r["pos"]) for r in reflection.fn_tokens(rows, o).collect()] == [(1, 0)]
    assert [(r["id"], r["pos"]) for r in reflection.fp_tokens(rows, o).collect()] == [(1, 1)]
    assert [(r["id"], r["pos"]) for r in reflection.unseen_tokens(rows, o).collect()] == [(1, 2)]  # not 77, not where no evidence is near
    assert [(r["id"], r["pos"]) for r in reflection.abbreviations(rows, o).collect()] == [(1, 3)]
    routed = {r["id"]: r["needs_reflection"] for r in reflection.routed(s, reflection.fn_tokens(rows, o)).collect()}
    assert routed == {1: True, 2: False}


def test_boundary_tokens(spark):
    s = sents(spark, "of the Bank near , Rome Street")
    stats = spark.createDataFrame([stat("the", 9, 1, 0), stat("Bank", 1, 5, 0), stat("near", 1, 5, 5), stat("Rome", 9, 0, 0), stat("Street", 9, 0, 0)], STATS)
    pred = spark.createDataFrame([(1, "Bank", "T", 2, 2), (1, "Rome", "T", 5, 5)], KEYS)
    counts = spark.createDataFrame([("Rome", 3, 0)], "name string, ent_count long, non_ent_count long")
    rows = reflection.annotated_tokens(s, pred, stats)
    fp = reflection.fp_tokens(rows, Options())
    got = lambda o: sorted((r["s"], r["pos"]) for r in reflection.boundary_tokens(pred, rows, counts, fp, o).collect())
    assert got(Options()) == [(2, 1), (2, 2)]  # Rome is surely an entity; near is rather context
    assert got(Options(ignore_article=True)) == [(2, 1), (2, 2)]
    assert reflection.boundary_tokens(pred, rows, counts.limit(0), fp, Options(ignore_rare=True)).count() == 3


def test_single_token_filter(spark):
    pred = spark.createDataFrame([(1, "x", "T", 0, 0), (1, "y", "T", 1, 1), (1, "x y", "T", 0, 1)], KEYS)
    stats = spark.createDataFrame([stat("x", 9, 0, 0), stat("y", 9, 0, 0)], STATS)
    counts = spark.createDataFrame([("y", 2, 0)], "name string, ent_count long, non_ent_count long")
    assert {r["name"] for r in reflection.without_single_token_fp(pred, stats, counts).collect()} == {"y", "x y"}


def test_prompt_blocks(spark):
    ents = [{"name": "New York", "type": "LOC", "s": 1, "e": 2}]
    assert prompts.tagged("in New York é".split(), ents) == "in [ New York | LOC ] é"
    assert prompts.json_entities([{"name": "é", "type": "T"}]) == '{"named entities": [{"name": "\\u00e9", "type": "T"}]}'
    row = spark.createDataFrame([(["s"], "s", ents), (["t"], "t", None)], "tokens array<string>, sentence string, ents array<struct<name:string,type:string,s:int,e:int>>")
    lines = row.select(prompts.block("icl_code", *[row[c] for c in row.columns]).alias("b")).collect()
    assert [r["b"] for r in lines] == ['input_text = "s"\nentity_list = []\nentity_list.append({"text": "New York", "type": "LOC"})', 'input_text = "t"\nentity_list = []']
    one = {"token": "Bank", "stats": (1, 5, 0), "status": "part of the entity", "examples": [{"role": "entity", "rows": [{"ent_span": "Bank", "ent_type": "O", "cxt": "the Bank"}] * 2}]}
    text = prompts.evidence_text("boundary", [one, {"token": "rare", "stats": None, "status": "part of the context", "examples": []}])
    assert "['Bank', 'rare']" in text and "1 of 6 times" in text and text.count("Input: the Bank") == 1 and "hardly or not at all" in text


def test_templates_keep_braces_of_examples(spark):
    text = spark.range(1).select(prompts.filled("icl_json", ["A"], F.lit("s {{icl_examples}}"), F.lit("e {{input_sentence}}"))).first()[0]
    assert "e {{input_sentence}}" in text and "types A" in text


def test_models_keep_errors_apart(spark):
    class Flaky:
        def generate(self, texts):
            if "bad" in texts:
                raise RuntimeError("no answer")
            return [t.upper() for t in texts]

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "key long, text string").coalesce(1)
    got = {r["key"]: (r["out"], r["error"]) for r in models.generate(rows, Flaky, batch=1, pause=0.0).collect()}
    assert got == {1: ("A", None), 2: (None, "no answer"), 3: ("C", None)}
    again = models.missing_keys(rows, models.generate(rows, Flaky, batch=1, pause=0.0))
    assert [r["key"] for r in again.collect()] == [2]
    vectors = models.embed(rows, models.HashEmbedding).collect()
    assert len(vectors) == 3 and all(len(r["out"]) == 16 for r in vectors)
    replayed = models.replay(rows, spark.createDataFrame([(1, "x")], "key long, text string")).collect()
    assert {r["key"]: r["out"] for r in replayed} == {1: "x", 2: None, 3: None}


def test_weighted_mean_over_batches(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(9), rng.choice([0.0, 0.5, 2.0]), rng.randrange(1, 4), [rng.random() for _ in range(3)]) for _ in range(200)]
    want = {}
    for i in {r[0] for r in rows}:
        own = [(w, n, v) for j, w, n, v in rows if j == i]
        total = sum(w * n for w, n, _ in own)
        want[i] = [sum((w * n if total else n) * v[d] for w, n, v in own) / (total or sum(n for _, n, _ in own)) for d in range(3)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        got = {r["id"]: r["emb"] for r in weighted_mean(spark.createDataFrame(rows, "id long, w double, n long, emb array<double>")).collect()}
    finally:
        spark.conf.set(name, before)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_guides_go_before_the_examples(spark):
    row = spark.createDataFrame([("s", "e")], "sentence string, examples string")
    plain, guided = (row.select(prompts.filled("icl_json", ["T"], F.col("sentence"), F.col("examples"), guide=g)).first()[0] for g in ("", "About T."))
    assert guided.replace("\nAbout T.", "") == plain and guided.index("About T.") < guided.index("\n\ne\n\n")
    assert set(config.GUIDES) == set(config.TASKS)


def test_token_match_in_parts_and_batches(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PART", 1)
    rng = random.Random(4)
    lines = [" ".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(6))) for _ in range(60)]
    s = sents(spark, *lines).repartition(3)
    stats = [stat(x, i % 3, i % 2, 1) for i, x in enumerate("bcefghjk")]  # a, d and i are stop words
    weight = {r[0]: round(r[5] + r[6] + 0.01 * r[7], 12) for r in stats}
    words = {i: set(x.split()) for i, x in enumerate(lines, 1)}
    want = {(q, d): sum(weight[t] for t in words[q] & words[d] & weight.keys()) for q in range(1, 21) for d in words if q != d and words[q] & words[d] & weight.keys()}
    find = lambda keep: retrieval.token_match(s, s.where("id <= 20"), spark.createDataFrame(stats, STATS), Options(), keep)
    got = {(r["qid"], r["did"]): r["score"] for r in find(None).collect()}
    assert got.keys() == want.keys(), [(k, sorted(words[k[0]]), sorted(words[k[1]]), got.get(k), want.get(k)) for k in sorted(got.keys() ^ want.keys())[:3]]
    assert got == pytest.approx(want)
    best = {(r["qid"], r["rank"], r["did"]) for r in retrieval.ranked(find(3), 3).collect()}
    assert best == {(r["qid"], r["rank"], r["did"]) for r in retrieval.ranked(spark.createDataFrame([(*k, v) for k, v in got.items()], "qid long, did long, score double"), 3).collect()}
    text = find(None)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and not re.search(r"hashpartitioning|Join\b", text), text  # a join by token meets every demo of a frequent one


def test_marks_equal_the_plain_way(spark):
    kind = "tokens array<string>, sentence string, ents array<struct<name:string,type:string,s:int,e:int>>"
    rng, rows = random.Random(6), []
    for _ in range(40):
        tokens = [rng.choice("abc") for _ in range(rng.randrange(9))]
        spans = sorted((s, s + rng.randrange(3)) for s in rng.sample(range(9), 3))
        rows.append((tokens, " ".join(tokens), [(" ".join(tokens[s : e + 1]) if rng.random() < 0.8 else "x", "T", s, e) for s, e in spans]))
    rows.append((["a"], "a", None))
    df = spark.createDataFrame(rows, kind)
    text = df.select("tokens", "sentence", "ents", prompts.block("icl_tagging", *[df[c] for c in df.columns]).alias("b"))
    assert "Python" not in text._jdf.queryExecution().executedPlan().toString()  # whole texts of tokens in Python take its memory
    for r in text.collect():
        assert r["b"] == f"Input: {r['sentence']}\nOutput: {prompts.tagged(r['tokens'], r['ents'] or [])}"


def test_hashed_sentence_vectors_equal_the_joins(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PART", 64)
    rng = random.Random(8)
    s = sents(spark, *[" ".join(rng.choice(["Ann", "é", "of", "x", "y", "zz"]) for _ in range(rng.randrange(40))) for _ in range(300)])
    stats = spark.createDataFrame([stat("Ann", 3, 1, 0), stat("of", 0, 2, 9), stat("x", 0, 0, 4)], STATS)
    vectors = spark.createDataFrame([(i, [rng.random() for _ in range(5)]) for i in range(7)], "vec_id long, embedding array<float>")
    for o in (Options(), Options(entity_weight=0.0, context_weight=0.0, other_weight=0.0)):
        want = {r["id"]: r["emb"] for r in retrieval.sentence_vectors(s, stats, retrieval.hashed_vocabulary(retrieval.token_rows(s), vectors), o).collect()}
        found = retrieval.hashed_sentence_vectors(s, stats, vectors, o)
        got = {r["id"]: r["emb"] for r in found.collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
        assert "Join" not in re.sub("array_join", "", found._jdf.queryExecution().executedPlan().toString())  # a vector for each token of a sentence was exchanged
