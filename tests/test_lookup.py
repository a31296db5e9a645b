"""What the rows of a sentence give by themselves, without exchanges of tokens or pairs of names and sentences."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from spanlens.config import Options
from spanlens.operators import lookup, reflection, roles
from spanlens.plans import queries as core

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def marked(spark, lines, ents):
    rows = [(i, i, line.split(), line, ents.get(i, [])) for i, line in enumerate(lines)]
    return roles.covered(spark.createDataFrame(rows, "id long, ord long, tokens array<string>, sentence string, ents array<struct<s:int,e:int,name:string,type:string>>"))


def test_role_occurrences_exchanges_no_sentences(spark):
    assert "Exchange" not in plan(core.QUERIES["role_occurrences"](spark, SF))


def test_names_that_share_a_word_meet_only_sentences_that_hold_them(spark):
    names = spark.createDataFrame([(f"The N{i}",) for i in range(200)], "name string")
    lines = [f"The N{i} and The M{i} of" for i in range(50)] + ["xThe N1 The N1", "The N1", "é The N1"]
    found = lookup.free_names(marked(spark, lines, {}), lookup.names_of(names))
    want = {("The N%d" % i, i, 0, 1, 1) for i in range(50)} | {("The N1", 51, 0, 1, 1), ("The N1", 52, 1, 2, 1)}
    assert set(map(tuple, found.collect())) == want  # by the first word, 200 names would meet 53 sentences


def test_free_names_equal_the_plain_way(spark):
    rng = random.Random(5)
    words = ["Ann", "An", "Anna", "é", "of", "B"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(80)]
    ents = {i: [(s, e, " ".join(x.split()[s : e + 1]), "T")] for i, x in enumerate(lines) if len(x.split()) > 3 for s in [rng.randrange(3)] for e in [s + rng.randrange(2)]}
    rows = marked(spark, lines, ents)
    sents = rows.select("id", "ord", "tokens", "sentence")
    labelled = rows.select("id", F.explode("ents").alias("x")).select("x.name", "id", "x.s", "x.e", "x.type")
    plain = roles.unlabelled_spans(sents, labelled, roles.token_sources(roles.role_rows(rows)))
    found = lookup.free_names(rows, lookup.names_of(labelled)).join(labelled.select("name").distinct(), "name", "left_semi")
    columns = ["name", "id", "s", "e", "copies"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect())) != []


def test_missed_forms_come_from_the_sentence(spark):
    names = spark.createDataFrame([(f"The N{i}",) for i in range(100)], "name string")
    rows = marked(spark, ["The N1 by The N10 The", "xThe N2 The", "N3"], {0: [(0, 1, "The N1", "T")]})
    got = {(r["id"], r["name"]): (r["spots"], r["aligned"]) for r in lookup.named_starts(rows, lookup.names_of(names)).collect()}
    assert got == {(0, "The N1"): ([3, 5], [False, False]), (0, "The N10"): ([3, 5], [True, False]), (1, "The N2"): ([2], [False])}


def test_boundary_rows_exchange_no_sentences(spark):
    text = plan(core.QUERIES["boundary_tokens"](spark, SF))
    exchanges = [x for x in text.splitlines() if "Exchange hashpartitioning(id" in x]
    assert not exchanges and reflection.boundary_rows is not None


def test_only_wanted_edges_leave_their_sentence(spark):
    rows = marked(spark, ["by Ann Lee of Bo", "é Ann", ""], {0: [(1, 2, "Ann Lee", "T"), (4, 4, "Bo", "U")], 1: [(1, 1, "Ann", "T")]})
    bitmap = lambda *tokens: lookup.names_of(spark.createDataFrame([(x,) for x in tokens], "token string"), 2, "token", False)
    wanted = [bitmap("of", "Ann"), bitmap("Lee", "by"), bitmap("Bo")]
    got = {(r["id"], r["name"], r["type"], r["s"], r["e"], r["pos"], r["token"], r["edge"]) for r in lookup.edge_spots(rows, wanted).collect()}
    assert got == {(0, "Ann Lee", "T", 1, 2, 2, "Lee", True), (0, "Ann Lee", "T", 1, 2, 3, "of", True), (0, "Bo", "U", 4, 4, 3, "of", True), (0, "Bo", "U", 4, 4, 4, "Bo", True)}
    assert lookup.edge_spots(rows, None).count() == 8


def random_sentences(spark, seed):
    rng = random.Random(seed)
    words = ["Ann", "An", "Lee", "é", "of", "B", "the", ",", "Anna"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(14))) for _ in range(120)]

    def some(longest):
        out = {}
        for i, x in enumerate(lines):
            n, t = len(x.split()), x.split()
            spans = {(s, min(n - 1, s + rng.randrange(longest))) for s in range(n) if rng.random() < 0.3}
            out[i] = [(s, e, " ".join(t[s : e + 1]), "TU"[e % 2]) for s, e in sorted(spans)]
        return out

    return marked(spark, lines, some(2)), marked(spark, lines, some(3))


def plain_parts(labels, pred):
    """What the operators over tables take: sentences, entities, labelled names, all tokens with statistics, counts."""
    sents = labels.select("id", "ord", "tokens", "sentence")
    ents = pred.select("id", F.explode("ents").alias("x")).select("id", "x.s", "x.e", "x.name", "x.type")
    labelled = labels.select("id", F.explode("ents").alias("x")).select("x.name", "id", "x.s", "x.e", "x.type")
    stats = roles.token_stats(roles.role_rows(labels))
    free = roles.unlabelled_spans(sents, labelled, roles.token_sources(roles.role_rows(labels)))
    return sents, ents, labelled, stats, roles.span_counts(labelled, free)


def test_boundary_rows_equal_the_plain_way(spark):
    labels, pred = random_sentences(spark, 7)
    sents, ents, labelled, stats, counts = plain_parts(labels, pred)
    seen = stats.where("token <> 'é'")
    for o in (Options(), Options(ignore_article=True), Options(include_unseen_boundary=True), Options(ignore_rare=True), Options(process_abbrev="only")):
        tokens = reflection.annotated_tokens(sents, ents, seen)
        plain = reflection.boundary_tokens(ents, tokens, counts, reflection.fp_tokens(tokens, o), o)
        own = reflection.boundary_rows(pred.drop("cover"), seen, labels.drop("cover"), labelled, o)
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, plain.select(own.columns).collect())) != []


def test_boundary_spots_meet_counts_without_their_lists(spark):
    exchanges = [x for x in plan(core.QUERIES["boundary_tokens"](spark, SF)).splitlines() if "spots" in x]
    assert not exchanges


def test_what_a_full_bitmap_lets_through_is_text(spark):
    full = lookup.Names(np.full(2**lookup.BITS >> 6, 2**64 - 1, dtype=np.uint64), np.arange(1, 5))
    got = {r["name"] for r in lookup.named_starts(marked(spark, ["é ñé", "aé"], {}), full).collect()}
    assert {"é", "é ", "ñ", "ñé"} & got == {"é", "é ", "ñé"} and "aé" in got


def test_missed_forms_equal_the_plain_way(spark):
    rng = random.Random(9)
    lines = [" ".join(rng.choice(["Zed", "Zedé", "of", "the", "B"]) for _ in range(rng.randrange(14))) for _ in range(60)]
    runs = {i: [(m.start(), m.group()) for m in re.finditer(r"Zedé?( Zedé?)*", x)] for i, x in enumerate(lines)}
    gold = {i: [(x[:at].count(" "), x[: at + len(m)].count(" "), m, "TU"[len(m) % 2]) for at, m in runs[i]] for i, x in enumerate(lines)}
    labels, pred = marked(spark, lines, gold), marked(spark, lines, {i: [x for x in xs if rng.random() < 0.5] for i, xs in gold.items()})
    sents, ents, labelled, stats, counts = plain_parts(labels, pred)
    for o in (Options(), Options(process_abbrev="only")):
        plain = reflection.fn_span_candidates(reflection.annotated_tokens(sents, ents, stats), sents, labelled, counts, o)
        own = reflection.fn_span_rows(pred.drop("cover"), labels.drop("cover"), labelled, o)
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, plain.select(own.columns).collect())) != []


def test_missed_forms_are_found_in_one_pass_behind_the_cached_forms(spark):
    text = plan(core.QUERIES["fn_span_candidates"](spark, SF))
    assert "InMemoryTableScan" in text and "HashAggregate" not in text.split("InMemoryRelation")[0]
