import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from spanlens.llm import langid, minhash, simhash
from spanlens.llm.blocks import Words, slices
from spanlens.llm.simhash import GrayIndex, near_duplicates, near_groups, simhash_groups
from spanlens.llm.substring import remove_repeats

from .common import SF, WORD, awkward, empty, prose


def test_words_of_nulls_and_slices():
    column = pa.array(["a  bb\tc", None, "", " x ", "yé\nz"]).slice(1)
    words = Words(column)
    found = [words.data[a:b].tobytes().decode() for a, b in zip(words.start, words.end, strict=True)]
    assert found == ["x", "yé", "z"] and words.row.tolist() == [2, 3, 3] and words.first.tolist() == [0, 0, 0, 1, 3]
    assert list(slices(pa.array(["abc"] * 5), 6)) == [(0, 2), (2, 4), (4, 5)]


def brute_repeats(docs):
    first = {}
    for doc, text in docs:
        words = WORD.findall(text or "")
        for i in range(len(words) - 12):
            key = tuple(words[i : i + 13])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in docs:
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - 12):
            if doc is not None and first[tuple(words[i : i + 13])] < doc:
                gone.update(range(i, i + 13))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_repeats_equal_brute_force(spark):
    rng = random.Random(4)
    passages = [prose(i, rng.randrange(10, 40)) for i in range(12)]
    rows = [(i, " ".join(rng.choice(passages) if rng.random() < 0.4 else prose(1000 + i * 50 + j, 9) for j in range(rng.randrange(1, 12)))) for i in rng.sample(range(500), 120)]
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(map(tuple, found.drop("kept_text").collect()), key=str) == brute_repeats(rows)


def test_windows_are_told_apart_by_two_hashes():
    """Rows of one key but different checks are no group; a group that goes on over batches is one."""
    from spanlens.llm.substring import _fold, _shared

    key, check = np.array([5, 5, 5, 5, 9], dtype=np.uint64), np.array([1, 1, 2, 2, 1], dtype=np.int32)
    batch = next(_fold(np.array([3, 7, 4, 4, 1]), key, check, False))
    assert sorted(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)) == [(1, 9, 1, False), (3, 5, 1, False), (4, 5, 2, False), (7, 5, 1, True)]
    rows = [(2, 5, 1, False), (3, 5, 1, False), (9, 5, 2, False), (6, 7, 1, False), (8, 7, 1, False)]
    names = ["doc", "key", "check", "known"]
    parts = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[a:b]]) for a, b in ((0, 1), (1, 4), (4, 5))]
    found = [r for b in _shared(False)(iter(parts)) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert found == [(3, 5), (8, 7)]
    words = Words(pa.array([" ".join(f"w{i % 17}" for i in range(60)), "x y"]))
    _, whole = words.windows(13)
    at = np.flatnonzero(whole)
    checks = words.checks(at, 13)
    assert len(set(checks.tolist())) == 17 and (checks[17:34] == checks[:17]).all()


def test_repeats_take_awkward_rows(spark):
    docs = awkward(spark)
    found = remove_repeats(docs, carry=("n_words", "source"))
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "n_words_in", "source"]
    rows = [(r[0], r[1]) for r in docs.collect()]
    assert sorted((tuple(r)[:4] for r in found.collect()), key=str) == brute_repeats(rows)
    assert remove_repeats(empty(spark)).count() == 0


def brute_print(text, width=4):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, prints, radius=4):
    links = defaultdict(set)
    for i in range(len(rows)):
        for j in range(len(rows)):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                links[i].add(j)
    out = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        known = [rows[j][0] for j in seen if rows[j][0] is not None]
        out[i] = min(known) if known else None
    return out


@pytest.mark.parametrize("awkward_rows", [False, True])
def test_simhash_equals_brute_force(spark, awkward_rows):
    docs = awkward(spark) if awkward_rows else spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    if not awkward_rows:  # near copies, so that some links are not of equal prints
        rng = random.Random(1)
        for doc, text in rows[:25]:
            words = text.split()
            words[rng.randrange(len(words))] = "changed"
            rows.append((10_000 + doc, " ".join(words)))
    prints = [brute_print(t) for _, t in rows]
    groups = brute_groups(rows, prints)
    found = simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    want = sorted((r[0], f"{p:016x}", groups[i]) for i, (r, p) in enumerate(zip(rows, prints, strict=True)) if r[0] is not None)
    assert sorted(tuple(r) for r in found.collect() if r[0] is not None) == want
    assert found.count() == len(rows) and simhash_groups(empty(spark)).count() == 0


def test_gray_index_equals_brute_force():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(60)]))
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    prints = prints[np.argsort(rank)]
    queries = prints[::7]
    want = {(i, j) for i, q in enumerate(queries) for j in np.flatnonzero(np.bitwise_count(prints ^ q) <= 4).tolist()}
    got = {pair for q, p in GrayIndex(prints).search(queries, 4) for pair in zip(q.tolist(), p.tolist(), strict=True)}
    assert got == want


def test_large_groups_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rows = [(i, (0xABC << 50) | (1 << (i % 45)) | (1 << (i // 45))) for i in range(300)]
    prints = spark.createDataFrame([(v,) for v in {v for _, v in rows}], "print long")
    edges = simhash.link_prints(prints, prints.count(), 4)
    values = sorted({v for _, v in rows})
    linked = {frozenset((a, b)) for a in values for b in values if a < b and bin(a ^ b).count("1") <= 4}
    found = {frozenset((r["a"], r["b"])) for r in edges.collect()}
    assert linked and {x for pair in found for x in pair} == {x for pair in linked for x in pair}
    at = {v: i for i, v in enumerate(values)}

    def groups(pairs):
        a, b = (np.array([at[x] for x in side]) for side in zip(*map(sorted, pairs), strict=True))
        return simhash.roots(len(values), a, b).tolist()

    assert groups(found) == groups(linked)


@pytest.mark.parametrize(("words", "radius"), [(1, 4), (4, 47)])
def test_gray_index_finds_all_pairs(words, radius):
    rng = np.random.default_rng(6)
    prints = rng.integers(0, 2**63, (700, words)).astype(np.uint64)
    for i in range(350):  # near copies at distances about the radius
        flips = rng.choice(64 * words, rng.integers(0, 2 * radius), replace=False)
        prints[350 + i] = prints[i]
        for bit in flips.tolist():
            prints[350 + i, bit // 64] ^= np.uint64(1 << bit % 64)
    want = {(i, j) for i in range(700) for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints).sum(axis=1) <= radius).tolist()}
    order = simhash.gray_order(prints)
    rows = prints[order] if words > 1 else prints[order, 0]
    found = {(order[q], order[p]) for qs, ps in simhash.GrayIndex(rows).search(rows, radius) for q, p in zip(qs, ps, strict=True)}
    assert found == want
    six = np.arange(64, dtype=np.uint64)[:, None]
    assert all(bin(int(a) ^ int(b)).count("1") == 1 for a, b in zip(simhash.gray_order(six), simhash.gray_order(six)[1:], strict=False))  # one bit apart


def test_near_duplicates(spark):
    rng = random.Random(8)
    base = [prose(500 + i, 300, 5000) for i in range(40)]
    rows, i = [], 0
    for text in base:
        rows.append((i, text))
        i += 1
    for text in base[:20]:  # about 0.9 similar by five-word shingles
        words = text.split()
        for at in rng.sample(range(len(words)), 3):
            words[at] = "edited"
        rows.append((i, " ".join(words)))
        i += 1
    rows += [(i + j, base[0]) for j in range(30)]
    groups = {r[0]: r[1] for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = sum(groups[40 + j] == j for j in range(20))
    assert caught >= 19 and all(groups[i + j] == 0 for j in range(30)) and all(groups[j] == j for j in range(40))
    kept = near_duplicates(awkward(spark))
    assert kept.columns == awkward(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted(set(x for x in ids if x is not None)) and None in ids and 6 not in ids and 8 not in ids
    assert near_duplicates(empty(spark)).count() == 0


def test_last_row_of_a_cut_key_is_kept(monkeypatch):
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    monkeypatch.setattr(simhash, "BLOCK", 4)
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([0] * len(rows), pa.int32()), pa.array([k for k, _ in rows]), pa.array([p for _, p in rows])], ["part", "key", "print"])
    rows = [[(1, p) for p in range(9)], [(2, 20), (2, 21), (3, 30), (4, 40), (4, 41)]]  # two whole blocks and one row, then other keys
    found = defaultdict(list)
    for out in simhash._blocks(iter(map(batch, rows))):
        for r in out.to_pylist():
            found[r["key"]] += np.frombuffer(r["prints"], dtype=np.int64).tolist()
    assert found == {1: list(range(9)), 2: [20, 21], 4: [40, 41]}  # the lone print of key 3 goes


@pytest.mark.parametrize("size", [5000, 2049, 40])
def test_every_pair_of_a_large_key_is_compared(spark, size):
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 2**63, (size, 4))
    half = size // 2
    prints[half : 2 * half] = prints[:half] ^ rng.permuted(np.tile([1 << 61, 3, 5, 0], (half, 1)), axis=1)  # 5 bits apart, all else about 128
    rows = [(0, key, int(i) + size * (key == 9), *map(int, p)) for key in (7, 9) for i, p in enumerate(prints)]
    rows += [(1, key, -key, 0, 0, 0, 0) for key in range(1, 20)]
    dealt = spark.createDataFrame(rows, "band int, key long, low long, f0 long, f1 long, f2 long, f3 long").coalesce(1)
    links = {(r["b"], r["a"]) for r in simhash.near_links(dealt, 47).collect()}
    assert links == {(i + at, i + half + at) for i in range(half) for at in (0, size)}


@pytest.mark.parametrize("set_bytes", [1 << 22, 20_000])
def test_near_groups_by_real_similarity(spark, monkeypatch, set_bytes):
    """Pairs a little above 0.8 are linked and pairs below are not, at sizes and repeats that SimHash gets wrong."""
    monkeypatch.setattr(simhash, "SET_BYTES", set_bytes, raising=False)
    rng = random.Random(3)
    rows, i = [], 0
    wanted = {}
    for base, (cut, low) in enumerate([(cut, low) for cut, low in ((0.105, 0.8), (0.17, 0.6), (0.2, 0.6)) for _ in range(150)]):
        words = [f"v{rng.randrange(10**6)}" for _ in range(200)]
        other = words[: int(len(words) * (1 - cut))] + [f"v{rng.randrange(10**6)}" for _ in range(int(len(words) * cut))]
        sets = [set(simhash.shingle_hashes(" ".join(w).encode(), 5)) for w in (words, other)]
        wanted[i] = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        assert wanted[i] >= low
        rows += [(i, " ".join(words)), (i + 1, " ".join(other))]
        i += 2
    line = "the same line again and again in all of these texts "
    rows += [(i + j, line * 40 + " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))) for j in range(30)]
    family = [f"t{j}" for j in range(100)]
    rows += [(i + 30 + j, " ".join([*family, f"x{j}", f"y{j}"])) for j in range(60)]
    groups = {r[0]: r[1] for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    high = [groups[j + 1] == j for j, s in wanted.items() if s >= 0.8]
    low = [groups[j + 1] == j for j, s in wanted.items() if s < 0.8]
    print(f"linked: {sum(high)} of {len(high)} at 0.8 or more (from {min(s for s in wanted.values() if s >= 0.8):.3f}), {sum(low)} of {len(low)} from {min(wanted.values()):.3f} to below 0.8; {30 - len({groups[i + j] for j in range(30)})} of 30 by a line")
    assert len(groups) == len(rows) and sum(high) >= 0.95 * len(high) and not any(low)
    assert all(groups[i + j] == i + j for j in range(30)) and all(groups[i + 30 + j] == i + 30 for j in range(60))


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out()))
    out = langid.identify(docs.where(langid.held_out()), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.98 * len(out) and all(0 <= r["score"] <= 1 for r in out)
    odd = langid.identify(awkward(spark), model).collect()
    by = defaultdict(set)
    for r in odd:
        by[r["doc_id"]].add((r["lang_pred"], r["score"]))
    assert all(by[i] == {("und", 0.0)} for i in (3, 4, 5, 10)) and len(odd) == 12
    none = langid.train(empty(spark))
    assert {r["lang_pred"] for r in langid.identify(awkward(spark), none).collect()} == {"und"} and langid.identify(empty(spark), model).count() == 0


def test_language_counts_equal_plain_counts():
    code, row = langid.features(["Ab!c", None, "é"])
    assert len(code) == len(row) and np.bincount(row, minlength=3).tolist() == [3 + 2 * 5, 0, 1 + 2 * 2]  # letters, and pairs and triples that end at each letter or gap
    again, _ = langid.features(["aB c"])
    assert sorted(code[row == 0]) == sorted(again)


def slot(gram):
    """Slot of an n-gram, letters as code points and gaps as 0, the last place first."""
    h = 0
    for order, point in enumerate(gram):
        h = (h * 0x9E3779B1 + point + order + 1) % 2**32
    h = (h ^ h >> 15) * 0x85EBCA6B % 2**32
    h = (h ^ h >> 13) * 0xC2B2AE35 % 2**32
    return h >> 16


def plain_grams(text):
    places = []
    for c in (text or "").lower():
        if c.isalpha():
            places.append(ord(c))
        elif places and places[-1]:
            places.append(0)
    if places and places[-1]:
        places.append(0)
    out = []
    for i in range(len(places)):
        back = [places[i - k] if i >= k else 0 for k in range(3)]
        out += [slot(back[:1])] * bool(places[i]) + [slot(back[:2]), slot(back)]
    return out


@pytest.mark.parametrize("most", [256, 2])
def test_language_equals_plain_naive_bayes(spark, monkeypatch, most):
    """Counts, priors and posteriors of a dictionary-based naive Bayes, on real texts and odd ones, in one part or more."""
    monkeypatch.setattr(langid, "PART_LANGUAGES", most)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(120).union(awkward(spark).select("doc_id", "text", "lang").where("doc_id <> 9"))
    rows = docs.collect()
    counts, texts = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for r in rows:
        if r["lang"] is not None:
            texts[r["lang"]] += 1
            for g in plain_grams(r["text"]):
                counts[r["lang"]][g] += 1
    langs = sorted(texts)
    whole = {x: sum(counts[x].values()) + langid.SMOOTHING * langid.FEATURES for x in langs}
    want = []
    for r in rows:
        grams = plain_grams(r["text"])
        score = [math.log(texts[x] / sum(texts.values())) + sum(math.log((counts[x].get(g, 0) + langid.SMOOTHING) / whole[x]) for g in grams) for x in langs]
        top = max(range(len(langs)), key=lambda i: (score[i], -i))
        want.append((r["doc_id"], langs[top], round(1 / sum(math.exp(s - score[top]) for s in score), 6)) if grams else (r["doc_id"], "und", 0.0))
    out = langid.identify(docs.select("doc_id", "text", F.lit("kept").alias("Score")), langid.train(docs))
    assert out.columns == ["doc_id", "text", "Score_in", "lang_pred", "score"]
    found = out.collect()
    assert sorted(((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in found), key=str) == sorted(want, key=str)


def jaccard(a, b):
    def shingles(t):
        w = WORD.findall(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("awkward_rows", [False, True])
def test_edited_fingerprints(spark, awkward_rows):
    docs = awkward(spark) if awkward_rows else spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    found = minhash.edited_fingerprints(docs.repartition(3)).collect()
    assert len(found) == len(rows)
    want = []
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found), key=str) == sorted(want, key=str)
    prints = defaultdict(set)
    texts = defaultdict(list)
    for doc, text in rows:
        texts[doc].append(text)
    for r in found:
        if len(texts[r["doc_id"]]) == 1:
            prints[texts[r["doc_id"]][0]].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    if not awkward_rows:
        errors = []
        by = dict(rows)
        order = [d for d, _ in rows]
        for r in found:
            text, after = by[r["doc_id"]], by[order[(order.index(r["doc_id"]) + 1) % len(order)]]
            cut = len(text) // 3
            errors.append(abs(r["near_edited"] - jaccard(text, text[: len(text) - cut] + after[:cut])))
            errors.append(abs(r["near_next"] - jaccard(text, after)))
        assert np.mean(errors) < 0.03 and max(errors) < 0.2
    assert minhash.edited_fingerprints(empty(spark)).count() == 0


def test_densified_bins_stay_alike():
    prints, some = minhash.fingerprints(pa.array(["one two", "one two", "", None, "one two three four five six"]))
    assert (prints[0] == prints[1]).all() and some.tolist() == [True, True, False, False, True]
    assert minhash.likeness(prints[2:3], some[2:3], prints[3:4], some[3:4])[0] == 1.0
    assert minhash.likeness(prints[:1], some[:1], prints[2:3], some[2:3])[0] == 0.0
