import json

import pytest

from spanlens.config import PRESETS, Options
from spanlens.plans import cli
from spanlens.plans import pipeline as P
from spanlens.sources import annotated as A
from spanlens.streaming.annotate import missed_tokens, stream_items

NAMES = ["Ann", "Bo", "Rome", "Oslo"]


class Answers:
    """Finds the known names of the prompt's last input."""

    def generate(self, prompts):
        out = []
        for p in prompts:
            sentence = p.rsplit("Input: ", 1)[1].split("\n")[0]
            out.append(json.dumps({"named entities": [{"name": w, "type": "PER"} for w in sentence.split() if w in NAMES]}))
        return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("items")

    def item(i, split):
        tokens = f"today {NAMES[i % 4]} met {NAMES[(i + 1) % 4]} in town number {i}".split()
        ents = [{"name": tokens[k], "type": "PER", "token_idx": [k, k]} for k in (1, 3)]
        return json.dumps({"id": str(i), "split": split, "tokens": tokens, "ent_list": ents})

    (path / "train.jsonl").write_text("\n".join(item(i, "train") for i in range(24)))
    (path / "test.jsonl").write_text("\n".join(item(i, "test") for i in range(100, 106)))
    return path


def test_icl_to_scores(spark, folder):
    o = Options(retrieval="random", demo_num=3)
    train, items = (A.read_items(spark, A.split_path(str(folder), s)) for s in ("train", "test"))
    side = P.Training(train, o)
    out = P.run_icl(items, side, P.retrieve(side, P.sentences_of(items), o), Answers, o)
    rows = out.collect()
    assert all(len(r["icl_example_ids"]) == 3 and [x["name"] for x in r["ent_list_pred"]] == [x["name"] for x in r["ent_list"]] for r in rows)
    score = P.evaluate(out, o).first()
    assert (score["tp"], score["fp"], score["fn"], score["f1"]) == (12, 0, 0, 1.0)


def test_reflection_finds_a_missed_entity(spark, folder):
    o = Options(retrieval="random", entity_bound_fn=0.9)
    train, items = (A.read_items(spark, A.split_path(str(folder), s)) for s in ("train", "test"))
    side = P.Training(train, o)
    from pyspark.sql import functions as F

    short = items.withColumn("ent_list_pred", F.slice("ent_list", 1, 1))
    out = P.run_token_reflection(short, side, "fn", Answers, o)
    assert all(len(r["ent_list_pred"]) == 2 and len(r["ent_list_pred_prior"]) == 1 for r in out.collect())
    same = P.run_token_reflection(items.withColumn("ent_list_pred", F.col("ent_list")), side, "unseen", Answers, o)
    assert all(len(r["ent_list_pred"]) == 2 for r in same.collect())
    spans = P.run_boundary_reflection(short, side, Answers, o).collect()
    assert len(spans) == 6 and all(len(r["ents"]) == 1 for r in spans)
    assert P.evaluate(P.filter_single_tokens(out, side), o).first()["tp"] == 12


def test_command_line(spark, folder, tmp_path):
    path = cli.main(["icl", "--data", str(folder), "--out", str(tmp_path), "--retrieval", "random", "--demo-num", "2", "--eval-num", "4"], spark, Answers)
    assert A.read_items(spark, path).count() == 4
    score = cli.main(["evaluate", "--data", str(folder), "--prior", path], spark)
    assert score.first()["f1"] == 1.0
    assert cli.options(cli.parser().parse_args(["fn", "--data", "x", "--preset", "ncbi", "--span-demo-num", "9"])).span_demo_num == 9 and set(PRESETS) == {"ncbi", "conll03", "bc2gm", "ontonotes", "tweetner7"}
    with pytest.raises(ValueError, match="vectors"):
        cli.main(["icl", "--data", str(folder), "--out", str(tmp_path)], spark, Answers)
    with pytest.raises(ValueError, match="model-type"):
        cli.main(["icl", "--data", str(folder), "--out", str(tmp_path), "--retrieval", "random"], spark)


@pytest.mark.parametrize("method", ["dense", "blended"])
def test_chain_on_stand_ins(spark, folder, tmp_path, method):
    """Vectors by the hash backend with a cache, all stages in turn, boundary rows and items scored."""
    args = ["--data", str(folder), "--out", str(tmp_path / "out"), "--cache", str(tmp_path / "cache"), "--retrieval", method, "--emb-type", "hash", "--demo-num", "2", "--filter-single-token-fp", "--exact-sample", "--train-num", "20"]
    path = cli.main(["chain", *args], spark, Answers)
    assert path.endswith("/boundary") and cli.main(["evaluate", *args, "--prior", path], spark).first()["f1"] == 1.0
    assert cli.main(["evaluate-boundary", *args, "--prior", f"{path}_spans"], spark).first()["f1"] == 1.0
    kept = sorted(p.relative_to(tmp_path).as_posix() for p in (tmp_path / "cache").rglob("_SUCCESS"))
    assert len(kept) == (3 if method == "dense" else 2)
    again = cli.main(["icl", *args, "--template", "icl_tagging"], spark, Answers)
    assert again.split("/")[-2] != path.split("/")[-2] and len([*(tmp_path / "cache").rglob("_SUCCESS")]) == len(kept)


def test_recorded_answers_and_a_chain_that_stops(spark, folder, tmp_path):
    answers = tmp_path / "answers.jsonl"
    rows = [json.loads(x) for x in (folder / "test.jsonl").read_text().splitlines()]
    text = lambda r: json.dumps({"named entities": [{"name": e["name"], "type": "PER"} for e in r["ent_list"]]})
    answers.write_text("\n".join(json.dumps({"key": r["id"], "text": text(r)}) for r in rows))
    args = ["--data", str(folder), "--retrieval", "random", "--model-type", "replay", "--responses", str(answers)]
    path = cli.main(["icl", *args, "--out", str(tmp_path / "a")], spark)
    assert cli.main(["evaluate", *args, "--prior", path], spark).first()["f1"] == 1.0
    answers.write_text("\n".join(answers.read_text().splitlines()[:3]))
    with pytest.raises(RuntimeError, match="3 of 6 rows failed"):
        cli.main(["chain", *args, "--out", str(tmp_path / "b")], spark)
    items = A.read_items(spark, A.split_path(str(folder), "test"))
    with pytest.raises(ValueError, match="exactly one"):
        P.evaluate(items.union(items).withColumn("ent_list_pred", items["ent_list"]), Options())


def test_stream(spark, folder, tmp_path):
    o = Options(entity_bound_fn=0.9)
    side = P.Training(A.read_items(spark, A.split_path(str(folder), "train")), o)
    stats = side.stats.cache()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text((folder / "test.jsonl").read_text())
    found = missed_tokens(stream_items(spark, str(tmp_path / "in")), stats, o)
    run = found.writeStream.format("memory").queryName("missed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("missed").count() == 12
