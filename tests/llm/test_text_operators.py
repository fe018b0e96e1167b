import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality_rules, simhash, suffix_dedup
from tidemark.llm.bpe import Encoder, decode_ids, default_tokenizer_path, encode_documents
from tidemark.llm.graph import connected_components
from tidemark.llm.lm_scoring import score_documents
from tidemark.llm.suffix_array import suffix_array

DOCS = "doc_id long, text string, fp string, words int"


def small_texts(seed: int, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    words = ["ab", "cde", "f", "ghij", "Kl", "mnö", "#x", "12"]
    shared = " ".join(rng.choice(words) for _ in range(60))
    out: list[str | None] = [None, "", " \n\t ", "one", "word " * 4000, shared, shared]
    while len(out) < n:
        own = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        at = rng.randint(0, len(own))
        middle = [shared[rng.randint(0, 40) : rng.randint(100, len(shared))]] if rng.random() < 0.5 else []
        out.append(rng.choice([" ", "\n", "  "]).join(own[:at] + middle + own[at:]))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns have names that operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(small_texts(3))], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_statistics(text):
    words, windows, covered, lines, dups = re.findall(r"[^\x20\x09-\x0D]+", text or ""), {}, set(), set(), 0
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    for starts in windows.values():
        if len(starts) > 1:
            covered.update(k for i in starts for k in range(i, i + 8))
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(covered)


def test_quality_statistics_match_brute_force(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, bad boolean")
    rows = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    for i, text in enumerate(small_texts(3)):
        r = rows[i]
        want = brute_statistics(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed)
    assert quality_rules.judge(empty, labels).count() == 0


def test_quality_rules_learn_junk(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        text = " ".join(rng.choice(words) + ("&&" if bad else "") for _ in range(60))
        rows.append((i, text))
        labels.append((i, None if i % 20 == 1 else bad))
    labels += labels[:5]
    out = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, bad boolean"), keep_rows=True)
    for r in out.collect():
        assert r.kept == (r.doc_id % 3 != 0)
        assert r.row.doc_id == r.doc_id


def test_simhash_components_match_brute_force(spark, docs, empty):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: int(r.fingerprint, 16) for i, r in got.items()}
    for i, t in enumerate(small_texts(3)):
        assert prints[i] == simhash.fingerprint(t, 3)[0]
    assert prints[0] == prints[1] == prints[2] == 0
    component = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and component[a] != component[b]:
                    component[a] = component[b] = min(component[a], component[b])
                    changed = True
    assert {i: r.component_id for i, r in got.items()} == component
    assert simhash.near_duplicates(empty).count() == 0


def test_links_find_dense_and_chained_fingerprints(spark):
    rng = random.Random(1)
    chain = [rng.getrandbits(64)]
    for _ in range(30):
        chain.append(chain[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    centre = rng.getrandbits(64)
    ball = [centre ^ (1 << a) for a in range(64)]
    values = list(dict.fromkeys([*chain, *ball, *(rng.getrandbits(64) for _ in range(50))]))
    fps = spark.createDataFrame([(0, simhash._signed(x)) for x in values], "seed int, fp long")
    parts = {r.node: r.component for r in connected_components(simhash.link(fps).select("u", "v")).collect()}
    assert len({parts[simhash._signed(x)] for x in chain}) == 1
    assert len({parts[simhash._signed(x)] for x in ball}) == 1
    assert len(parts) == len(set(chain)) + len(set(ball))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks, rng = simhash.covering_masks(radius), random.Random(2)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(2000):
        gone = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(m & gone == 0 for m in masks)


def test_one_of_each_keeps_one_row_of_each_group(spark):
    text = "some words that are long enough to count as text of their own"
    rows = [(1, text), (2, text), (2, text), (3, "quite another thing altogether, and longer than the rest of them"), (3, "quite another thing altogether, and longer than the rest of them"), (None, text)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 3), (True, 0)]


def test_verified_groups_hold_close_copies_and_no_others(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    texts = []
    for _ in range(12):
        base = rng.sample(words, 300)
        near, far = list(base), list(base)
        near[rng.randrange(300)] = "changed"
        for at in rng.sample(range(300), 60):
            far[at] = "other" + str(at)
        texts += [" ".join(base), " ".join(near), " ".join(far)]
    frame = spark.createDataFrame([*enumerate(texts), (98, None), (99, " ")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.verified_groups(frame).collect()}
    assert got == {i: i - 1 if i % 3 == 1 else i for i in range(len(texts))} | {98: 98, 99: 98}
    assert simhash.verified_groups(frame.limit(0)).count() == 0


def test_fingerprints_propose_links_that_shingles_confirm(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    base = rng.sample(words, 400)
    texts = [" ".join(base), " ".join([*base[:200], "changed", *base[201:]]), " ".join(reversed(base)), " ".join(rng.sample(words, 400))]
    rows = [(i, [simhash._signed(x) for x in simhash.fingerprint(t, 1, 1, True)], np.unique(simhash.shingle_hashes(t, 5)).view(np.int64).tolist()) for i, t in enumerate(texts)]
    nodes = spark.createDataFrame(rows, "node long, prints array<long>, shingles array<long>")
    # the same words in another order have the same fingerprint, but no shingle in common
    assert [tuple(r) for r in simhash.printed_links(nodes.select("node", "prints"), nodes.select("node", "shingles"), 0.8).collect()] == [(0, 1)]
    asked, real = [], simhash.printed_links
    monkeypatch.setattr(simhash, "printed_links", lambda *x: asked.append(real(*x)) or asked[-1])
    kept = simhash.one_of_each(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {0, 2, 3} and len(asked) == 1 and asked[0].count() == 1


def test_suffix_array_matches_sorting():
    rng = random.Random(7)
    for _ in range(500):
        s = [rng.randint(0, rng.choice([1, 2, 6])) for _ in range(rng.randint(0, 50))]
        assert suffix_array(np.array(s, dtype=np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def brute_removal(texts, length):
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(data[i : i + length])
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((len(data), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("many", [1, 512])
def test_removed_bytes_match_brute_force(spark, docs, empty, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    for i, want in enumerate(brute_removal(small_texts(3), 100)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_texts_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    rng = random.Random(9)
    long = "".join(rng.choices("abcdef \n", k=5000))
    texts = [long, long[1000:3000] + "x" + long[:700], "".join(rng.choices("abcdef \n", k=900))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame).collect()}
    for i, want in enumerate(brute_removal(texts, 100)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want
    kept = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(frame, keep_columns=True).collect()}
    assert kept[0] == long and "x" in kept[1] and len(kept[1]) < 100


def test_encoding_is_that_of_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_tokenizer_path())
    texts = [*small_texts(3), "x" * 3000, "ab" * 2500 + " don't stop", "ΑΣ ﬁ\x85 İ 中文 <|endoftext|> \x1c½ it's", "a" * 700 + "é" * 600]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = encode_documents(frame, default_tokenizer_path(), with_ids=True)
    rows = {r.doc_id: r for r in encoded.collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert rows[i].decoded == library.decode(ids, skip_special_tokens=False)
    again = {r.doc_id: r.decoded for r in decode_ids(encoded, default_tokenizer_path()).collect()}
    assert again == {i: r.decoded for i, r in rows.items()}
    assert encode_documents(empty, default_tokenizer_path()).count() == 0


def test_tree_joins_agree_with_one_encoding():
    coder, rng = Encoder(default_tokenizer_path(), leaf_chars=8, memory_words=40), random.Random(4)
    whole = Encoder(default_tokenizer_path(), leaf_chars=1 << 30)
    for _ in range(200):
        word = "".join(rng.choices("abcdeing", k=rng.randint(1, 200)))
        assert coder.tree(word) == whole.tree(word)


def test_backoff_scores_match_brute_force(spark, docs, empty):
    from collections import Counter
    from math import log10

    words = {i: (t or "").encode().lower().split() for i, t in enumerate(small_texts(3))}
    grams = {i: [Counter(tuple(w[k - n : k + 1]) for k in range(n, len(w))) for n in range(2)] for i, w in words.items()}
    total = [sum((g[n] for g in grams.values()), Counter()) for n in range(2)]
    count = sum(map(len, words.values()))
    got = {r.doc_id: r for r in score_documents(docs).collect()}
    for i, w in words.items():
        score = 0.0
        for k, x in enumerate(w):
            one = max(total[0][(x,)] - grams[i][0][(x,)], 0.5) / max(count - len(w), 1)
            if k:
                pair = (w[k - 1], x)
                both = total[1][pair] - grams[i][1][pair]
                one = both / max(total[0][pair[:1]] - grams[i][0][pair[:1]], 1) if both > 0 else 0.4 * one
            score += log10(one)
        assert got[i].n_words == len(w)
        assert got[i].log10_score == (pytest.approx(score) if w else None)
    assert score_documents(empty).count() == 0


def test_repeated_rows_and_null_ids_have_results(spark):
    text = "a text with quite a few words in it " * 8
    frame = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, True)], "doc_id long, bad boolean")
    assert quality_rules.judge(frame, labels).count() == 4
    assert simhash.near_duplicates(frame).where(F.col("doc_id").isNotNull()).count() == 3
    assert suffix_dedup.remove_repeats(frame).count() == 4
    assert encode_documents(frame, default_tokenizer_path()).count() == 4
    assert score_documents(frame).count() == 4


def shingle_set(text: str) -> frozenset:
    words = text.lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_groups(texts: list[str]) -> dict[int, int]:
    """The smallest number each text reaches over pairs of Jaccard similarity 0.8 or more."""
    sets, group = [shingle_set(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if 5 * common >= 4 * (len(a) + len(sets[j]) - common):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return dict(enumerate(group))


def edited_texts(seed: int) -> list[str]:
    """Texts and copies of them around a similarity of 0.8: with a passage appended, cut off, put before, and with single
    words changed; all have a passage in common."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    texts = []
    for _ in range(30):
        size = rng.randrange(100, 500)
        base, more = [*words[:20], *rng.choices(words, k=size)], rng.choices(words, k=size)
        share = rng.uniform(0.12, 0.27)
        scattered = list(base)
        for at in rng.sample(range(20, 20 + size), int(size * share / 9)):
            scattered[at] = "other" + str(at)
        texts += [base, base + more[: int(size * share)], base[: int(size * (1 - share))], more[: int(size * share)] + base, scattered]
    return [" ".join(t) for t in texts]


def test_verified_groups_lose_no_pair_at_the_threshold(spark):
    texts = edited_texts(5)
    want = brute_groups(texts)
    assert 20 < sum(i != g for i, g in want.items()) < 110
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.verified_groups(frame).collect()} == want


def test_verified_groups_keep_links_among_what_the_smallest_rejects(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    one = list(words)
    near = [*one[1:], one[0]]  # the same words, nearly in the same order
    other = sorted(words)
    texts = [" ".join(t) for t in (other, one, near)]
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    want = {0: 0, 1: 1, 2: 1}
    assert brute_groups(texts) == want
    assert {r.doc_id: r.component_id for r in simhash.verified_groups(frame).collect()} == want
    # rounds of heads, then the pairs left
    members = [(1, [1, 2, 3, 4, 5]), (2, [6, 7, 8, 9, 1]), (3, [6, 7, 8, 9, 1]), (4, [1, 2, 3, 4, 5]), (5, [1, 6, 20, 21, 22])]
    sets = spark.createDataFrame(members, "node long, shingles array<long>")
    points = spark.createDataFrame([(node, 5, 0, 1) for node, _ in members], "node long, n int, at int, h long")
    found = simhash._all_links(points, sets, 0.8, listed=0)
    assert {(r.u, r.v) for r in found.collect()} == {(1, 4), (2, 3)}


def test_all_links_ask_about_few_pairs_that_share_no_more_than_a_passage(spark, monkeypatch):
    rng = random.Random(21)
    number = lambda: rng.randrange(-(2**63), 2**63)
    passage = [number() for _ in range(20)]
    sets = [passage + [number() for _ in range(10)] for _ in range(150)]
    near = [[*s[:-1], number()] for s in sets[:30]]  # each is similar to one of the others alone
    sets += near
    frame = spark.createDataFrame([*enumerate(sets)], "node long, shingles array<long>")
    points = spark.createDataFrame([(node, 30, at, h) for node in range(len(sets)) for at, h in enumerate(passage[:2])], "node long, n int, at int, h long")
    asked, real = [], simhash._confirmed
    monkeypatch.setattr(simhash, "_confirmed", lambda pairs, *x: asked.append(pairs.count()) or real(pairs, *x))
    found = {tuple(sorted((r.u, r.v))) for r in simhash._all_links(points, frame, 0.8).collect()}
    assert found == {(i, 150 + i) for i in range(30)}
    # all pairs are 16,110
    assert sum(asked) < 200
