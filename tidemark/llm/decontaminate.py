"""Benchmark decontamination: the words of documents are streamed along a generalised suffix automaton of test items."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_text

#: Words of one part of a test item; a longer item is cut into parts that overlap by a window less a word.
PART_WORDS = 20_000
#: UTF-8 bytes of test items in one automaton; more items make more automata, and documents are streamed along each.
SHARD_BYTES = 2 << 20
#: ASCII letters and digits, lower-cased, and all bytes above stay; the rest parts words.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text: runs of ASCII letters, digits and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class Automaton:
    """A generalised suffix automaton of sequences of words: each state is a set of substrings that end at the same places."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        """items: (id, words). Substrings of `window` words, and whole items of fewer, are what a document may not hold."""
        self.window, self.ids = window, [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.link, self.length, self.after = [-1], [0], [{}]
        known = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words] for _, words in items]
        for words in known:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self._mark(known)
        pairs = {a * (len(self.vocabulary) + 1) + b for words in known for a, b in zip(words, words[1:], strict=False)}
        self.pairs = np.array(sorted(pairs) or [-1], dtype=np.int64)
        self.least = min((min(len(w), window) for w in known if w), default=window)

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.after.append(after)
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The state for the suffixes of q's substrings that p's ones and w make; what led from p's suffixes to q leads there."""
        made = self._state(self.length[p] + 1, self.link[q], dict(self.after[q]))
        self.link[q] = made
        while p >= 0 and self.after[p].get(w) == q:
            self.after[p][w] = made
            p = self.link[p]
        return made

    def _extend(self, last: int, w: int) -> int:
        """The state of all that has been read of a sequence, with w added."""
        q = self.after[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        now, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.after[p]:
            self.after[p][w] = now
            p = self.link[p]
        if p >= 0:
            q = self.after[p][w]
            self.link[now] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return now

    def _holder(self, state: int, length: int) -> int:
        """The state of the suffix of this length of a state's longest substring."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _mark(self, known: list[list[int]]) -> None:
        """Which items hold a window, by the window's state, and which short items end at a state, by length."""
        self.holders: dict[int, set[int]] = {}
        ends: dict[int, dict[int, set[int]]] = {}
        for item, words in enumerate(known):
            state = 0
            for k, w in enumerate(words):
                state = self.after[state][w]
                if k + 1 >= self.window:
                    state = self._holder(state, self.window)
                    self.holders.setdefault(state, set()).add(item)
            if 0 < len(words) < self.window:
                ends.setdefault(self._holder(state, len(words)), {}).setdefault(len(words), set()).add(item)
        self.shorts: dict[int, list[tuple[int, set[int]]]] = {}
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__) if ends else ():
            here = self.shorts.get(self.link[state], []) + sorted(ends.get(state, {}).items())
            if here:
                self.shorts[state] = here

    def runs(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(place, words as numbers) of the stretches whose words and pairs of neighbours some item has: a match is within one."""
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        if not ids.any():
            return
        pair = ids[:-1] * (len(self.vocabulary) + 1) + ids[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        breaks = np.flatnonzero(self.pairs[at] != pair) + 1
        starts = np.concatenate(([0], breaks))
        ends = np.concatenate((breaks, [len(ids)]))
        for a, b in zip(starts[ends - starts >= self.least], ends[ends - starts >= self.least], strict=True):
            if ids[a]:  # a word that no item has stands alone
                yield int(a), ids[a:b].tolist()

    def match(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """(stretches of words inside occurrences of windows or short items, as [start, end), in order and apart; the items)."""
        spans: list[list[int]] = []
        found: set[int] = set()
        for place, run in self.runs(words):
            state = length = 0
            for k, w in enumerate(run, place + 1):
                while state and w not in self.after[state]:
                    state = self.link[state]
                    length = self.length[state]
                if w in self.after[state]:
                    state = self.after[state][w]
                    length += 1
                hit = 0
                if length >= self.window:
                    found |= self.holders[self._holder(state, self.window)]
                    hit = length
                for n, items in self.shorts.get(state, ()):
                    if n <= length:
                        found |= items
                        hit = max(hit, n)
                if hit:
                    start = k - hit
                    while spans and spans[-1][1] >= start:  # a short item may begin before what has been found
                        start = min(start, spans.pop()[0])
                    spans.append([start, k])
        return spans, found


def _item_parts(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(id, text): items in parts of bounded length that between them hold every window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                words = words_of(text)
                step = PART_WORDS - window + 1
                rows += [(i, b" ".join(words[a : a + PART_WORDS]).decode("utf-8", "surrogatepass")) for a in range(0, max(len(words) - window + 1, min(len(words), 1)), step)]
            yield pd.DataFrame(rows, columns=["id", "text"])

    return items.select(id_text(id_col), F.col(text_col).alias("text")).mapInPandas(run, "id string, text string")


def _shards(parts: DataFrame) -> Iterator[list[tuple[str | None, str]]]:
    """Parts in lists of at most SHARD_BYTES and a part; they pass the driver one partition at a time."""
    held, size = [], 0
    for r in parts.toLocalIterator():
        held.append((r["id"], r["text"]))
        size += len(r["text"].encode()) + 64
        if size >= SHARD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


_RESULT = "id string, digest long, n_words long, spans array<struct<s: long, e: long>>, items array<string>"


def _match_shard(docs: DataFrame, shard: list[tuple[str | None, str]], window: int) -> DataFrame:
    given = docs.sparkSession.sparkContext.broadcast(shard)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton([(i, text.encode("utf-8", "surrogatepass").split(b" ")) for i, text in given.value], window)
        for pdf in batches:
            rows = []
            for i, digest, text in zip(pdf["id"], pdf["digest"], pdf["text"], strict=True):
                words = words_of(text)
                spans, found = automaton.match(words)
                names = sorted({x for x in (automaton.ids[k] for k in found) if x is not None})
                rows.append((i, digest, len(words), [{"s": s, "e": e} for s, e in spans], names))
            yield pd.DataFrame(rows, columns=["id", "digest", "n_words", "spans", "items"])

    return docs.mapInPandas(run, _RESULT)


def _count_words(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "digest": pdf["digest"], "n_words": [len(words_of(t)) for t in pdf["text"]], "spans": [[]] * len(pdf), "items": [[]] * len(pdf)})

    return docs.mapInPandas(run, _RESULT)


def _joined(spans: str) -> F.Column:
    """Spans of several automata as spans that are apart, in order."""
    start = F.expr("named_struct('done', cast(array() as array<struct<s: bigint, e: bigint>>), 's', -1L, 'e', -1L)")
    walked = F.aggregate(
        F.array_sort(spans),
        start,
        lambda a, x: F.when(a["e"] >= x["s"], F.struct(a["done"].alias("done"), a["s"].alias("s"), F.greatest(a["e"], x["e"]).alias("e")))
        .otherwise(F.struct(F.concat(a["done"], F.when(a["e"] < 0, start["done"]).otherwise(F.array(F.struct(a["s"].alias("s"), a["e"].alias("e"))))).alias("done"), x["s"].alias("s"), x["e"].alias("e"))),
        lambda a: F.concat(a["done"], F.when(a["e"] < 0, start["done"]).otherwise(F.array(F.struct(a["s"].alias("s"), a["e"].alias("e"))))),
    )
    return walked


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_text(id_col), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))


def find_overlaps(
    docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Per document (id, digest, n_words, spans: array of (s, e), items: array of ids as text, sorted).

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A window is `window` consecutive
    words of an item; an item of fewer words, but not none, is one window. Spans are the stretches of a document's words,
    counted from 0, end left out, within occurrences of windows; items are those with an occurring window. digest is
    xxhash64 of the text. Null and empty texts have no words; no items, or none with words, give no spans. Repeated items
    count as one; an item with a null id marks words but isn't listed. Rows with a null or repeated id are documents of
    their own. Other columns are ignored; an empty table gives no rows.

    Texts and items are read whole. Items are dealt into automata of at most SHARD_BYTES, broadcast one by one, so neither
    the driver nor a task holds more of them at once; each is a pass over the documents, whose spans are joined by id and
    text. Nothing else is shuffled."""
    keyed, passes = _keyed(docs, id_col, text_col), []
    for shard in _shards(_item_parts(items, item_id_col, item_text_col, window)):
        passes.append(_match_shard(keyed, shard, window).withColumn("pass", F.lit(len(passes))))
    passes = passes or [_count_words(keyed).withColumn("pass", F.lit(0))]
    # of rows that are equal in id and text, one stands for all within a pass; their number comes from the first one
    first = reduce(DataFrame.unionByName, passes).groupBy("id", "digest", "pass").agg(
        F.count("*").alias("copies"), F.any_value("n_words").alias("n_words"), F.any_value("spans").alias("spans"), F.any_value("items").alias("items")
    )
    whole = first.groupBy("id", "digest").agg(
        F.max("copies").alias("copies"),
        F.max("n_words").alias("n_words"),
        _joined(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    each = whole.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return each.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "digest", "n_words", "spans", "items")


def report(overlaps: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256: of the ids, comma-joined, contaminated) of what find_overlaps returns."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return overlaps.select(
        id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def remove_overlaps(
    docs: DataFrame, overlaps: DataFrame, max_span: int = 0, max_coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs without the spans of more than `max_span` words, and without documents of which spans cover more than
    `max_coverage` of the words.

    overlaps: of find_overlaps over the same rows. What lies between the first and the last character of a span goes; the
    rest stays as it is. All columns keep their names and types; nulls and texts without spans stay."""
    spans = (
        overlaps.where(F.size("spans") > 0)
        .select(F.col(id_col).alias("_id"), F.col("digest").alias("_digest"), F.col("spans").alias("_spans"), F.col("n_words").alias("_n"))
        .dropDuplicates(["_id", "_digest"])
    )
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_key"), F.xxhash64(text_col).alias("_hash"))
    joined = rows.join(spans, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_digest")), "left")
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    kept = joined.where(F.col("_spans").isNull() | (hit <= F.lit(max_coverage) * F.col("_n")))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, cuts, strict=True):
            if spans is not None and len(spans):
                data = text.encode("utf-8", "surrogatepass")
                at = [m.span() for m in re.finditer(_WORDS, data.lower())]
                for x in reversed(list(spans)):
                    if x["e"] - x["s"] > max_span:
                        data = data[: at[x["s"]][0]] + data[at[x["e"] - 1][1] :]
                text = data.decode("utf-8", "surrogatepass")
            out.append(text)
        return pd.Series(out, dtype=object)

    cleaned = F.when(F.col("_spans").isNull(), F.col(f"_row.{text_col}")).otherwise(cut(F.col(f"_row.{text_col}"), F.col("_spans")))
    return kept.select(*[cleaned.alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns])
