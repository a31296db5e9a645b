import random
from collections import Counter, defaultdict

import __spark_entry__
import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanlens.llm.simhash import near_groups

from .common import WORD, awkward, empty
from .test_tables import fill


def test_stages_keep_columns_and_take_awkward_rows(spark):
    for docs in (awkward(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/nowhere")
            if name != "packed":
                assert out.columns == awkward(spark).columns, name
            out.collect()


def test_language_stage_drops_only_what_has_no_language(spark):
    docs = awkward(spark)
    kept = sorted(r["doc_id"] or -1 for r in corpus_pipeline.language(spark, docs, "").collect())
    assert kept == [-1, 1, 2, 6, 7, 8, 9]


def test_repeats_stage_cuts_and_drops(spark):
    docs = awkward(spark)
    out = {r["doc_id"]: r for r in corpus_pipeline.repeats(spark, docs, "").collect()}
    before = {r["doc_id"]: r for r in docs.collect()}
    assert 6 not in out and out[1]["text"] == before[1]["text"] and out[2]["text"] == " ".join(before[2]["text"].split()[60:]) and out[2]["n_chars"] == len(out[2]["text"])


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_stage_equals_brute_force(spark):
    """Families from copies to 0.85 alike, pairs below 0.75, one key crowded with 120 texts, odd rows: all pairs compared."""
    rng = random.Random(12)
    rows = [(r["doc_id"], r["text"]) for r in awkward(spark).where("doc_id is not null and doc_id not in (9, 10)").collect()]
    crowd = [f"c{i}" for i in range(400)]
    for base in range(25):
        words = [f"v{rng.randrange(10**6)}" for _ in range(300)]
        rows.append((100 + 10 * base, " ".join(words)))
        for j, cut in enumerate((0, 8, 18, 70, 120), 1):
            rows.append((100 + 10 * base + j, " ".join(words[: 300 - cut] + [f"x{rng.randrange(10**6)}" for _ in range(cut)])))
    rows += [(1000 + j, " ".join([*crowd, f"y{j}", f"z{j}"]).upper() if j % 2 else " ".join([*crowd, f"y{j}", f"z{j}"])) for j in range(120)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            alike = len(a & b) / len(a | b) if a | b else 1.0
            assert not 0.75 < alike < 0.85  # no pair so near the line that a sketch may miss it
            if alike >= 0.8:
                one, two = sorted((find(i), find(j)))
                root[two] = one
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs.repartition(5), "").collect())
    assert kept == sorted({find(i) for i, _ in sets})


def test_mix_stage_equals_brute_force(spark):
    """Copies of each row by walking its source in the order of the hash until the source's goal is reached."""
    docs = awkward(spark).drop("n_words", "size").where("doc_id <> 9").unionByName(awkward(spark).drop("n_words", "size").where("doc_id in (1, 2)").withColumn("doc_id", F.col("doc_id") + 50))
    rows = docs.select("doc_id", "text", "source", F.xxhash64(F.lit(17), "doc_id", "text").alias("dice")).collect()
    size = lambda t: len(WORD.findall(t or ""))
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    sizes = {s: sum(size(r["text"]) for r in own) for s, own in by.items()}
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    targets = fill(sizes, {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)})
    want = Counter()
    for s, own in by.items():
        goal = round(targets[s])
        whole = goal // sizes[s] if sizes[s] else 1
        left, upto = goal - whole * sizes[s], None
        for r in sorted(own, key=lambda r: (r["dice"], r["doc_id"] is None, r["doc_id"] or 0)):
            n = size(r["text"])
            if n and 2 * min(n, left) >= n:
                upto = r["dice"]
            left = max(0, left - n)
        for r in own:
            want[r["doc_id"], r["text"], s] += whole + (upto is not None and r["dice"] <= upto)
    found = Counter((r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.mix(spark, docs.repartition(3), "").collect())
    assert found == +want


def test_packed_stage_holds_every_token(spark):
    """Pieces against the tokenizer on whole texts, sequences without gaps or overlaps, and no more than first fit makes."""
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = awkward(spark).where("doc_id is not null and doc_id <> 10")
    pieces = defaultdict(dict)
    places = defaultdict(list)
    for r in corpus_pipeline.packed(spark, docs, "").collect():
        pieces[r["doc_id"]][r["piece"]] = (r["start"], r["length"])
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    lengths = []
    for r in docs.collect():
        n = len(whole.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        own = [pieces[r["doc_id"]][i] for i in range(len(pieces[r["doc_id"]]))]
        assert own == [(at, min(4096, n - at)) for at in range(0, n, 4096)]
        lengths += [x for _, x in own]
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    rooms = []
    for n in sorted(lengths, reverse=True):
        spot = next((i for i, room in enumerate(rooms) if room >= n), None)
        rooms = [*rooms, 4096 - n] if spot is None else [room - n * (i == spot) for i, room in enumerate(rooms)]
    assert len(places) <= len(rooms)


def test_run_on_tables(spark):
    sf = "/root/testdata/sf0.001"
    out = __spark_entry__.queries()["pipeline"](spark, sf)
    rows = out.collect()
    groups = near_groups(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    alone = {r["component_id"] for r in groups}
    assert rows and {r["doc_id"] for r in rows} <= alone
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
