"""The parts of the text operators that need no session, against brute force."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrain.llm import common, decontaminate, langid, line_dedup, near_dedup, packing, ppm, quality, records, suffixes, topk
from lexigrain.llm.tokens import Encoder

ENCODERS = {n: Encoder(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}
TEXT = st.text(st.sampled_from("ab A.!'|<>0 \n\t\x1cé́ ß日　sSt"), max_size=40)


@pytest.mark.parametrize("name", ENCODERS)
@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_encoder_gives_the_tokenizers_ids(name, text):
    e = ENCODERS[name]
    assert e.encode([text, text + " x"]) == e._plain([text, text + " x"])


def test_shingles_take_whole_short_texts():
    assert len(common.shingles([], 4)) == 0
    assert len(common.shingles([b"a", b"b"], 4)) == 1
    assert len(np.unique(common.shingles([b"a"] * 9, 4))) == 1
    assert common.words("A\x0bb C\x1cd") == ["a".encode(), "b c\x1cd".encode()]


def test_circulant_signature_estimates_jaccard():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    same = np.mean(near_dedup.signature(a, 512) == near_dedup.signature(b, 512))
    assert abs(same - 800 / 1200) < 0.1


@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
@settings(max_examples=100, deadline=None)
def test_packing_plan_uses_every_piece_once_and_few_bins(sizes):
    counts = np.bincount(sizes, minlength=65)
    plan = packing.plan(counts, 64)
    used = np.zeros(65, int)
    for p in plan:
        assert sum(p.sizes) <= 64
        for n in p.sizes:
            used[n] += p.times
    assert (used == counts).all()
    bins, first_fit = sum(p.times for p in plan), []
    for n in sorted(sizes, reverse=True):
        i = next((i for i, f in enumerate(first_fit) if f >= n), None)
        first_fit.append(64 - n) if i is None else first_fit.__setitem__(i, first_fit[i] - n)
    assert bins <= len(first_fit) + 1


def test_records_round_trip_and_damage(tmp_path):
    data = [(5, b"\1\0\0\0"), (None, b""), (7, np.arange(9, dtype="<u4").tobytes())]
    path = str(tmp_path / "x.rec")
    raw = b"".join(records.frame(records.payload(d, i, 2)) for d, i in data)
    open(path, "wb").write(raw)
    assert list(records.read_file(path)) == data
    open(path, "wb").write(raw[:-9] + bytes([raw[-9] ^ 1]) + raw[-8:])
    with pytest.raises(ValueError):
        list(records.read_file(path))


def test_maximal_repeats_against_brute_force():
    rnd = random.Random(1)
    for _ in range(60):
        texts = [bytes(rnd.choice([0, 97, 98, 255]) for _ in range(rnd.randint(0, 20))) for _ in range(rnd.randint(1, 4))]
        where: dict[bytes, list] = {}
        for t, x in enumerate(texts):
            for i in range(len(x)):
                for j in range(i + 2, len(x) + 1):
                    where.setdefault(x[i:j], []).append((t, i))
        want = []
        for s, at in where.items():
            left = {texts[t][i - 1] if i else (t, -1) for t, i in at}
            right = {texts[t][i + len(s)] if i + len(s) < len(texts[t]) else (t, -1) for t, i in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want.append((len(s), sorted(at)))
        assert sorted(want) == suffixes.maximal_repeats(texts, 2)


def test_branch_and_bound_search_is_exact():
    rng = np.random.default_rng(3)
    x = rng.integers(-9, 9, (24, 300))
    got = topk.search_block(np.arange(300), x, np.array([0, 5]), x[:, [0, 5]], 7, 8, {})
    for q in (0, 5):
        s = x[:, q] @ x
        want = sorted(((-int(s[i]), i) for i in range(300) if i != q))[:7]
        assert [(-s, i) for a, i, s in got if a == q] == want


def test_tiles_cover_reordered_passages():
    item = decontaminate.tokens("a b c d e f g h i j k l")
    assert decontaminate.coverage(decontaminate.tokens("x g h i j k l y a b c d e f z"), item, 5) == 1.0
    assert decontaminate.coverage(decontaminate.tokens("a b c d x e f g h y i j k l"), item, 5) == 0.0
    assert decontaminate.coverage(decontaminate.tokens(""), item, 5) == 0.0


def test_ppm_probabilities_sum_to_one():
    counts = {}
    data = np.frombuffer(ppm.stream("abracadabra") + ppm.stream("abra"), np.uint8).astype(int)
    levels = []
    for k in range(ppm.ORDER + 1):
        counts = {}
        for i in range(ppm.ORDER, len(data)):
            if data[i] != 0xFE:
                key = int("0" + "".join(f"{b:02x}" for b in data[i - k : i]), 16)
                counts.setdefault(key, np.zeros(256))[data[i]] += 1
        keys = np.array(sorted(counts))
        levels.append((keys, np.array([counts[x] for x in keys])))
    model = ppm.table(levels)
    assert np.allclose((10.0 ** model["rows"].astype(float))[:, np.arange(256) != 0xFE].sum(axis=1), 1, atol=1e-5)
    lp = ppm.log_probabilities(model, ["abra", "zzzz", ""])
    assert lp[0] > lp[1] and lp[2] < 0


def test_quality_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.boost(x, y)
    assert ((quality.score(m, x) > 0.5) == y).mean() > 0.9
    assert all(np.isfinite(quality.features(t)).all() for t in (None, "", " \n", "x", "a b. C!"))


def test_codewords_are_distinct():
    for n in (1, 2, 3, 4, 9, 20):
        assert len({tuple(r) for r in langid.codewords(n)}) == n


def test_line_signatures_of_similar_lines_agree():
    a = "the quick brown fox jumps over the lazy dog near the old river bank"
    sig = line_dedup.signatures([a, a[:-1] + "x", "nothing alike at all here, friend", "x"], 8, 48)
    assert (sig[0] == sig[1]).mean() > 0.7 > 0.1 > (sig[0] == sig[2]).mean()


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 3000), max_size=300), st.sets(st.integers(0, 3000), max_size=300))
def test_parities_differ_in_no_more_slots_than_items_are_in_one_set_only(a, b):
    x, y = (near_dedup.parities(np.array(sorted(s), np.uint64)) for s in (a, b))
    differ = sum(bin(int(v) & (1 << 64) - 1).count("1") for v in x ^ y)
    assert differ <= len(a ^ b) and (differ - len(a ^ b)) % 2 == 0
