"""Hand-made sentences for the counts whose rules are easy to get wrong."""

from pyspark.sql import functions as F

from spanlens.functions import text as T
from spanlens.operators import roles
from spanlens.sources import annotated as A

ENTS = "id long, ent_ord int, s int, e int, name string, type string"


def sents(spark, *lines):
    rows = [(i, i, line.split(), line) for i, line in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "id long, ord long, tokens array<string>, sentence string")


def test_context_between_two_entities_counts_twice(spark):
    s = sents(spark, "A x B y z")
    e = spark.createDataFrame([(1, 0, 0, 0, "A", "T"), (1, 1, 2, 2, "B", "T")], ENTS)
    stats = {r["token"]: (r["n_ent"], r["n_ctx"], r["n_oth"], r["n_tot"]) for r in roles.token_stats(roles.role_tokens(s, e)).collect()}
    assert stats == {"A": (1, 0, 0, 1), "B": (1, 0, 0, 1), "x": (0, 2, 0, 2), "y": (0, 1, 0, 1), "z": (0, 1, 0, 1)}


def test_name_unlike_its_tokens_counts_but_is_no_occurrence(spark):
    s = sents(spark, "a b c d e f")
    e = spark.createDataFrame([(1, 0, 2, 2, "other", "T")], ENTS)
    stats = {r["token"]: r["n_ent"] for r in roles.token_stats(roles.role_tokens(s, e)).collect()}
    assert stats["c"] == 1 and {r["role"] for r in roles.occurrences(s, e).collect()} == {"other"}
    assert [(r["name"], r["id"]) for r in roles.labelled_spans(s, e).collect()] == [("c", 1)]


def test_overlapping_entities_count_each(spark):
    s = sents(spark, "p q r")
    e = spark.createDataFrame([(1, 0, 0, 1, "p q", "T"), (1, 1, 1, 2, "q r", "T")], ENTS)
    got = {r["token"]: r["n_ent"] for r in roles.token_stats(roles.role_tokens(s, e)).collect()}
    assert got == {"p": 1, "q": 2, "r": 1}


def test_one_token_form_in_two_roles_gives_two_records(spark):
    s = sents(spark, "Rome fell", "Paris and Rome x y z Rome")
    e = spark.createDataFrame([(1, 0, 0, 0, "Rome", "LOC"), (2, 0, 0, 0, "Paris", "LOC")], ENTS)
    labelled = roles.labelled_spans(s, e)
    free = roles.unlabelled_spans(s, labelled, roles.token_sources(roles.role_tokens(s, e)))
    assert [(r["name"], r["id"], r["s"], r["copies"]) for r in free.collect()] == [("Rome", 2, 2, 2)]
    counts = {r["name"]: (r["ent_count"], r["non_ent_count"]) for r in roles.span_counts(labelled, free).collect()}
    assert counts == {"Rome": (1, 2), "Paris": (1, 0)}


def test_form_that_first_occurs_inside_a_word_is_dropped(spark):
    s = sents(spark, "Ann left", "Hannah met Ann", "Annie x Ann")
    e = spark.createDataFrame([(1, 0, 0, 0, "Ann", "PER")], ENTS)
    labelled = roles.labelled_spans(s, e)
    free = roles.unlabelled_spans(s, labelled, roles.token_sources(roles.role_tokens(s, e)))
    assert {(r["id"], r["s"]) for r in free.collect()} == {(2, 2)}


def test_text_functions(spark):
    rows = spark.createDataFrame([("()",), ("",), ("ß",), ("ÀB",), ("A1",), ("٣",), ("The",), ("+,",), ("a.",)], "t string")
    t = F.col("t")
    got = {r["t"]: tuple(r)[1:] for r in rows.select("t", T.is_punctuation(t), T.all_upper(t), T.all_digits(t), T.is_article(t), T.starts_punctuation(t)).collect()}
    assert got["()"][0] and got[""][0] and got["+,"][0] and not got["a."][0]
    assert not got["ß"][1] and got["ÀB"][1] and got["A1"][1] and got["٣"][2] and got["The"][3] and not got["a."][4]
    one = rows.limit(1).select(T.strip(F.lit(" \t a \n")), T.base_name(F.lit("x/y")), T.after_marker(F.lit("a|b|c"), "|"), T.ratio(F.lit(1), F.lit(0)), T.known_characters(F.lit("a-b"), F.lit("xabx")), T.squeeze(F.lit("A b")), T.one_line(F.lit("a\nb"))).first()
    assert tuple(one) == ("a", "y", "b", 0.0, "ab", "ab", "a b")


def test_sources(spark, tmp_path):
    lines = ['{"id":"1","split":"train","tokens":["Ann","left"],"ent_list":[{"name":"Ann","type":"PER","token_idx":[0,0]}]}', '{"id":"2","tokens":["x"],"ent_list":[]}', '{"id":"3","tokens":["y"],"sentence":"y","ent_list":[]}']
    (tmp_path / "train.jsonl").write_text("\n".join(lines))
    items = A.read_items(spark, A.split_path(str(tmp_path), "train"))
    assert [r["sentence"] for r in items.orderBy("id").collect()] == ["Ann left", "x", "y"]
    A.write_items(items.where("id = 3"), items.where("id < 3"), str(tmp_path / "out"))
    assert A.read_items(spark, str(tmp_path / "out")).count() == 3
    sample = A.shuffled_sample(items, 2, 7)
    import random

    order = list(range(3))
    random.Random(7).shuffle(order)
    assert [r["id"] for r in sample.orderBy("place").collect()] == [str(i + 1) for i in order[:2]]
    (tmp_path / "emb.jsonl").write_text('{"id":"1","sentence_embedding":[1.0,2.0]}')
    got = {r["id"]: r["sentence_embedding"] for r in A.read_sentence_embeddings(items, str(tmp_path / "emb.jsonl")).collect()}
    assert got == {"1": [1.0, 2.0], "2": None, "3": None}
    (tmp_path / "vocab.json").write_text('{"Ann": [0.5, 1], "x": [2, 3]}')
    assert {r["token"]: r["emb"] for r in A.read_vocabulary_embeddings(spark, str(tmp_path / "vocab.json")).collect()} == {"Ann": [0.5, 1.0], "x": [2.0, 3.0]}
