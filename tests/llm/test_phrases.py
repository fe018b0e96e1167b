"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import phrases
from tidemark.llm.phrases import _stretches, collocations, cut_score, ngram_intervals, suffix_array
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, phrase string, words int, a int, shard int, n int"


def plain(rows, most, least, percent, top):
    """rows: (lang, text)"""
    count, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, most + 1):
                count.update((lang, tuple(w[k : k + m])) for k in range(len(w) - m + 1))
    candidates = {x: a for x, a in count.items() if len(x[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in candidates.items():
        if any(len(v) > len(w) and x == lang and 100 * b >= percent * a and any(v[k : k + len(w)] == w for k in range(len(v))) for (x, v), b in candidates.items()):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = count[lang, w[:k]], count[lang, w[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for k, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [*"abcdefgh", "né", "ÉA", "X", "x\x00y", " "]
    out = [(None, None), ("en", ""), ("en", " .\t,,\n"), ("en", "a b " * 3000), ("dé", "A.b"), ("en", "z" * 5000 + " a")]
    for _ in range(n):
        text = "".join(rng.choice(words[: rng.randint(2, len(words))]) + rng.choice([" ", " ", " ", "\t", ". ", "\r\n", "!", " \x0b"]) for _ in range(rng.randint(0, 120)))
        out += [(rng.choice(["en", "en", "dé", None, "und"]), text)] * rng.choice([1, 1, 3])
    return out


def built(spark, rows, **how):
    table = spark.createDataFrame([(k, t, lang, "x", 1, 2, 3, 4) for k, (lang, t) in enumerate(rows)], DOCS).repartition(3)
    return sorted(tuple(r) for r in collocations(table, **how).collect())


@pytest.mark.parametrize("shard, least, percent, top", [(1 << 21, 5, 100, 2000), (40, 5, 100, 2000), (7, 12, 80, 9), (300, 3, 100, 5)])
def test_matches_plain_counting(spark, monkeypatch, shard, least, percent, top):
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard)
    monkeypatch.setattr(phrases, "BUCKET_WORDS", 900 if shard < 100 else 1 << 21)
    rows = corpus(shard)
    want = plain(rows, 5, least, percent, top)
    assert want
    assert built(spark, rows, most=5, min_count=least, inside_percent=percent, top=top) == want


def test_other_lengths_and_nothing(spark):
    rows = corpus(5)
    for most in (2, 3, 7):
        assert built(spark, rows, most=most, min_count=6, top=50) == plain(rows, most, 6, 100, 50)
    assert built(spark, rows[:3]) == []
    assert built(spark, []) == []


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array_and_intervals(seed):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 2 + seed, size=int(rng.integers(0, 200)))
    order = suffix_array(codes, 5).tolist()
    assert sorted(order) == list(range(len(codes)))
    heads = [tuple(codes[k : k + 5]) for k in order]
    assert heads == sorted(heads)
    own = len(codes) * 2 // 3
    for n, at, counts in ngram_intervals(codes, np.arange(len(codes)) < own, 1, 5):
        every = [tuple(codes[k : k + n]) for k in range(len(codes) - n + 1) if 0 not in codes[k : k + n]]
        some = Counter(tuple(codes[k : k + n]) for k in range(min(own, len(codes) - n + 1)) if 0 not in codes[k : k + n])
        found = [tuple(codes[k : k + n]) for k in at]
        assert sorted(found) == sorted(set(every))
        assert dict(zip(found, counts.tolist(), strict=True)) == {x: some[x] for x in found}


def test_slices_are_the_whole(monkeypatch):
    text = next(t for _, t in corpus(1) if t and len(t) > 200 and "." in t)
    whole = [w for words in phrases._slices(text) for w in words]
    monkeypatch.setattr(phrases, "SLICE", 3)
    parts = list(phrases._slices(text))
    assert len(parts) > 5 and [w for words in parts for w in words] == whole


def test_keys_survive_packing():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 63, size=500, dtype=np.int64).astype(np.uint64)
    keys = np.unique(phrases._ngram_keys(words, 3, 4))
    assert len(keys) == 498 and len(phrases._ngram_keys(words[:2], 3, 4)) == 0
    for b in range(4):
        mine = keys[keys >> np.uint64(phrases.KEY_BITS) == b]
        assert len(mine) > 50 and (phrases._unpack_keys(phrases._pack_keys(mine), b) == mine).all()


def test_stretches_keep_what_is_joined():
    codes = np.array([1, 2, 0, 3, 4, 5, 6, 7, 0, 8])
    joined = np.array([1, 0, 0, 1, 0, 1, 1, 0, 0], dtype=bool)
    assert [_stretches(codes, own, joined)[0].tolist() for own in (3,)] == [[1, 2, 0, 3, 4, 0, 5, 6, 7]]
    assert [_stretches(codes, own, joined)[1] for own in (0, 2, 5, 6, 10)] == [0, 3, 6, 7, 9]
    assert _stretches(np.zeros(0, dtype=np.int64), 0, np.zeros(0, dtype=bool))[0].tolist() == []


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(10**12 + 7, 3 * 10**12 + 1, 5 * 10**12 + 3, 2 * 10**13 + 9), (100, 100, 100, 10**14), (123456789012, 123456789013, 123456789014, 98765432109876)]
    rows = spark.createDataFrame(cases, "a long, l long, r long, n long").select("*", cut_score(F.col("a"), F.col("l"), F.col("r"), F.col("n")).alias("s")).collect()
    assert {r.s for r in rows} == {1000 * a * n // (left * right) for a, left, right, n in cases}
