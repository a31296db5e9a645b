import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanlens.llm import rangecoder
from spanlens.llm.blocks import slices
from spanlens.llm.packing import Plan, pack, plan
from spanlens.llm.tokens import WordTokenizer, load

from .common import SF, awkward, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def ids_of(whole, text):
    return whole.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="aB é'’.,!<|endoftext>1İß \t\n\x0b\x1c ́Σς", max_size=60)), max_size=5))
def test_ids_equal_whole_text_encoding(texts):
    tokenizer, whole_ = load(PATH), Tokenizer.from_file(PATH)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    flat, bounds = tokenizer.encode(pa.array([*texts, None], pa.string()), 1)
    assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [ids_of(whole_, t) for t in [*texts, ""]]


def test_cache_may_overflow(monkeypatch, whole):
    monkeypatch.setattr("spanlens.llm.tokens.CACHE_WORDS", 50)
    monkeypatch.setattr("spanlens.llm.tokens.CACHE_PARTS", 10)
    tokenizer = WordTokenizer(PATH)
    for i in range(5):
        texts = [f"word{i} Some{'abc'[j % 3]}thing, else{j}! the The" for j in range(40)]
        flat, bounds = tokenizer.encode(pa.array(texts), 1)
        assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [ids_of(whole, t) for t in texts]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 49407), max_size=400), st.integers(1, 6))
def test_frames_round_trip(ids, repeat):
    ids = np.array(ids * repeat, dtype="<u4")
    sizes = np.array([len(ids) // 2, len(ids) - len(ids) // 2])
    docs, back, flat = rangecoder.unpack_frame(rangecoder.pack_frame([None, 5], sizes, ids))
    assert docs == [None, 5] and back.tolist() == sizes.tolist() and flat.tolist() == ids.tolist()


def test_long_frames_shrink_and_damage_shows():
    rng = np.random.default_rng(3)
    ids = (rng.zipf(1.3, 30_000) % 49408).astype("<u4")
    ids[5000:9000] = 7
    frame = rangecoder.pack_frame([1], np.array([len(ids)]), ids)
    assert (rangecoder.unpack_frame(frame)[2] == ids).all()
    for at in (10, len(frame) // 2, len(frame) - 1):
        bad = bytearray(frame)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            rangecoder.unpack_frame(bytes(bad))


def test_buckets_of_rare_ids_round_trip():
    rng = np.random.default_rng(4)
    ids = np.concatenate([rng.permutation(49408), rng.zipf(1.2, 30_000) % 49408]).astype("<u4")
    assert rangecoder._extra(49408) > 0
    assert (rangecoder.unpack_frame(rangecoder.pack_frame([1], np.array([len(ids)]), ids))[2] == ids).all()


@pytest.mark.parametrize(("scale", "most"), [("0.01", 6.9), ("0.1", 6.6)])
def test_fewer_bits_than_order_0(scale, most):
    column = pq.read_table(f"{SF[:-5]}{scale}/documents.parquet", columns=["text"])["text"].combine_chunks()
    tokenizer = load(PATH)
    ids = np.concatenate([tokenizer.encode(column.slice(a, b - a), 1)[0] for a, b in slices(column, 1 << 20)])
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    static = float(-(share * np.log2(share)).sum())
    bits = 8 * len(rangecoder.pack_frame([1], np.array([len(ids)]), ids)) / len(ids)
    assert bits < static - 1 and bits < most, (bits, static)


def test_blocks_do_not_depend_on_each_other():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 3000, (6, rangecoder.BLOCK)).astype("<u4")
    tables, ranks = rangecoder._Tables.fit(ids.reshape(-1))
    ranks = ranks.reshape(ids.shape)
    used, words = rangecoder.encode_blocks(ranks, tables)
    for i in range(6):
        own, alone = rangecoder.encode_blocks(ranks[i : i + 1], tables)
        start = int(used[:i].sum())
        assert own[0] == used[i] and (alone == words[start : start + used[i]]).all()


@pytest.mark.parametrize("awkward_rows", [False, True])
def test_token_files(spark, whole, tmp_path, awkward_rows):
    docs = awkward(spark) if awkward_rows else spark.read.parquet(f"{SF}/documents.parquet")
    rangecoder.write_tokens(docs, f"file://{tmp_path}/t", PATH)
    found = rangecoder.read_tokens(spark, f"file://{tmp_path}/t").collect()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at, want = 0, []
    for doc, text in rows:
        ids = ids_of(whole, text)
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == want
    rangecoder.write_tokens(empty(spark), f"file://{tmp_path}/e", PATH)
    assert rangecoder.read_tokens(spark, f"file://{tmp_path}/e", ids=False).count() == 0


@pytest.mark.parametrize("awkward_rows", [False, True])
def test_packing(spark, whole, awkward_rows):
    docs = awkward(spark) if awkward_rows else spark.read.parquet(f"{SF}/documents.parquet")
    out = pack(docs, PATH).collect()
    want = []
    for r in docs.collect():
        ids = ids_of(whole, r["text"])
        want += [(r["doc_id"], n, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for n, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((tuple(r)[:5] for r in out), key=str) == sorted(want, key=str)
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= math.ceil(sum(w[3] for w in want) / 4096) * 1.02 + 1
    assert pack(empty(spark), PATH).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
def test_plans_are_whole_and_tight(histogram):
    p = plan(histogram, 64)
    used = [[] for _ in range(p.sequences)]
    ranks = {k: [] for k in histogram}
    for length, rank, count, per, sequence, offset in zip(*p.arrays(), strict=True):
        for i in range(count):
            used[sequence + i // per].append((offset + i % per * length, length))
            ranks[length].append(rank + i)
    assert all(sorted(r) == list(range(histogram[k])) for k, r in ranks.items())
    for parts in used:
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= 64
    first_fit = []
    for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        spot = next((i for i, room in enumerate(first_fit) if room >= length), None)
        if spot is None:
            first_fit.append(64 - length)
        else:
            first_fit[spot] -= length
    assert p.sequences <= len(first_fit) + 1


@pytest.fixture(scope="module")
def real_lengths():
    column = pq.read_table(f"{SF[:-5]}0.1/documents.parquet", columns=["text"])["text"].combine_chunks()
    tokenizer = load(PATH)
    sizes = np.concatenate([np.diff(tokenizer.encode(column.slice(a, b - a), 1)[1]) for a, b in slices(column, 1 << 20)])
    pieces = np.concatenate([np.full(int((sizes // 4096).sum()), 4096), sizes[sizes % 4096 > 0] % 4096])
    return dict(zip(*(x.tolist() for x in np.unique(pieces, return_counts=True)), strict=True))


def test_the_program_is_kept_on_real_lengths(real_lengths):
    plain = Plan(real_lengths, 4096)
    plain.best_fit()
    own = plan(real_lengths, 4096)
    assert own.configured > 0 and own.sequences <= plain.sequences


@pytest.mark.parametrize(("lengths", "gain"), [([1366, 1365, 820, 1640, 2050, 1025], 0.03), ([*range(1300, 1420, 3), *range(1100, 1360, 2)], 0)])
def test_the_program_beats_best_fit_where_lengths_fit_together(lengths, gain):
    histogram = {x: 40 + x % 7 for x in lengths}
    if gain:
        histogram = {x: 2000 + x % 7 for x in lengths}
    plain = Plan(histogram, 4096)
    plain.best_fit()
    own = plan(histogram, 4096)
    print(plain.sequences, own.sequences, own.configured)
    assert own.configured > 0 and own.sequences <= plain.sequences * (1 - gain)
