"""The k nearest occurrences of wanted tokens, against the join of all pairs, and that no such join is made."""

import random
import re

import pytest

from spanlens.operators import examples, reflection, roles
from spanlens.plans import queries as core
from tests.test_lookup import SF, plan

ENTS = "array<struct<s:int,e:int,name:string,type:string,ent_ord:int>>"


def some_rows(spark, seed):
    rng = random.Random(seed)
    words = ["Ann", "An", "of", "é", "the", "Bo", ",", "x"] + [f"W{i}" for i in range(12)]
    out = []
    for i in rng.sample(range(1000), 60):
        tokens, ents, at = [rng.choice(words) for _ in range(rng.randrange(50))], [], 0
        while at < len(tokens):
            e = min(len(tokens) - 1, at + rng.choice([0, 0, 1, 2, 9]))
            if rng.random() < 0.3:
                ents.append((at, e, " ".join(tokens[at : e + 1]), rng.choice("AB"), at))
            at = e + rng.randrange(1, 5)
        out.append((i, tokens, ents))
    return spark.createDataFrame(out, f"id long, tokens array<string>, ents {ENTS}").repartition(5), out


@pytest.mark.parametrize("slab", [1 << 18, 7])
def test_best_examples_equal_the_join(spark, monkeypatch, slab):
    monkeypatch.setattr(examples, "SLAB", slab)
    rows, plain = some_rows(spark, slab)
    rng = random.Random(2)
    wanted = []
    for i, tokens, _ in plain[:25]:
        for p in range(0, len(tokens), 3):
            width = rng.choice([0, 1, 2, 2, 12])
            wanted += [((str(i), p), tokens[p], role, " ".join(tokens[max(0, p - width) : p + width + 1])) for role in ("entity", "context", "other")]
    wanted = spark.createDataFrame(wanted, "key struct<key:string,pos:int>, token string, role string, span string")
    occ = roles.occurrence_rows(rows)
    for starts in (False, True):
        want = reflection.top_examples(wanted, occ.where("role = 'entity' and pos = ent_ord") if starts else occ, 3)
        best = examples.best_examples(wanted, rows, 3, starts=starts)
        got = best if starts else examples.with_texts(best, rows)
        columns = ["key", "token", "role", "rank", "id", "pos", "shared", *([] if starts else ["ent_type", "ent_span", "cxt"])]
        got, want = (sorted(map(repr, x.select(columns).collect())) for x in (got, want))
        assert got == want and len(got) > 100


def test_no_examples(spark):
    rows, _ = some_rows(spark, 1)
    wanted = spark.createDataFrame([("k", "never", "other", "never seen")], "key string, token string, role string, span string")
    assert examples.with_texts(examples.best_examples(wanted, rows, 3), rows).count() == 0
    assert examples.best_examples(wanted.limit(0), rows.limit(0), 3).count() == 0


def test_queries_join_no_tokens_with_occurrences(spark):
    for name in ("overlap_topk_examples", "reflect_prompt_fn", "reflect_prompt_unseen", "reflect_prompt_boundary"):
        assert not re.search(r"Join(\(skew=true\))? \[token#\d+, role#\d+", plan(core.QUERIES[name](spark, SF)))
    spark.catalog.clearCache()
