"""Benchmark decontamination against plain scans."""

import hashlib
import random
import re

import pytest

from tidemark.llm import decontaminate
from tidemark.llm.decontaminate import Automaton, find_overlaps, remove_overlaps, report, words_of

DOCS = "doc_id long, text string, digest string, spans int, items string, copies int, _row int, id long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=10):
    """For each text: (words, hit places, ids)."""
    windows = {}
    for i, text in items:
        w = plain_words(text)
        m = min(len(w), window)
        for k in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(i)
    out = []
    for text in docs:
        w, hit, ids = plain_words(text), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    ids |= windows[tuple(w[k : k + m])]
        out.append((len(w), hit, sorted(str(i) for i in ids if i is not None)))
    return out


def sample(seed, words="a b c dé e1 ff".split()):
    rng = random.Random(seed)
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.randint(1, 40))) for k in range(12)] + [(50, None), (51, ""), (52, "!!"), (53, "A b, C d"), (None, "zz yy xx"), (7, "ff ff ff ff ff ff ff ff ff ff ff ff")]
    items.append((60, items[0][1]))
    docs = [None, "", " .. ", "ZZ yy XX", "A", text(3000)]
    for _ in range(40):
        a, (_, b) = text(rng.randint(0, 60)), rng.choice(items)
        docs.append(f"{a} {b or ''} {text(rng.randint(0, 20))}")
    return docs, items


@pytest.mark.parametrize("seed", range(6))
def test_automaton_finds_what_a_plain_scan_finds(seed):
    docs, items = sample(seed, [f"w{k}" for k in range(2 + seed * 3)])
    if seed % 2:
        items = [x for x in items if len(plain_words(x[1])) >= 6]
    automaton = Automaton([(i, words_of(t)) for i, t in items], 10)
    for text, (n, hit, ids) in zip(docs, plain(docs, items), strict=True):
        spans, found = automaton.match(words_of(text))
        assert len(words_of(text)) == n
        assert [k for s, e in spans for k in range(s, e)] == sorted(hit)
        assert sorted({str(automaton.ids[k]) for k in found if automaton.ids[k] is not None}) == ids


@pytest.mark.parametrize("shard_bytes, part_words", [(2 << 20, 20_000), (150, 20_000), (400, 14)])
def test_report_and_removal(spark, monkeypatch, shard_bytes, part_words):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(decontaminate, "PART_WORDS", part_words)
    texts, items = sample(99, [f"w{k}" for k in range(30)])
    docs = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (4, "other text"), (None, texts[5]), (None, None)]
    table = spark.createDataFrame([(i, t, "x", 1, "y", 2, 3, 4) for i, t in docs], DOCS)
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    overlaps = find_overlaps(table, benchmark, window=10)
    want = sorted(
        ((i, n, len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)) for (i, _), (n, hit, ids) in zip(docs, plain([t for _, t in docs], items), strict=True)),
        key=repr,
    )
    assert sorted((tuple(r) for r in report(overlaps).collect()), key=repr) == want
    cleaned = remove_overlaps(table, overlaps, max_span=10, max_coverage=0.6)
    assert cleaned.columns == table.columns
    left = sorted(((r.doc_id, r.text) for r in cleaned.collect()), key=repr)
    expected = []
    for (i, text), (n, hit, _) in zip(docs, plain([t for _, t in docs], items), strict=True):
        if len(hit) > 0.6 * n:
            continue
        at, k = [m.span() for m in WORD.finditer((text or "").lower())], n
        while k > 0:
            e = k
            while k - 1 in hit:
                k -= 1
            if e - k > 10:
                text = text[: at[k][0]] + text[at[e - 1][1] :]
            k -= e == k
        expected.append((i, text))
    assert left == sorted(expected, key=repr)


def test_no_items_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert {(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in report(find_overlaps(docs, none)).collect()} == {(1, 3, 0, False), (2, 0, 0, False)}
    assert report(find_overlaps(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string"))).count() == 0
