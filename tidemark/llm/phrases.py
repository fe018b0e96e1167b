"""Phrase collocations: n-grams counted in suffix arrays of word ids, merged by key, scored by their weakest cut."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

#: Words and breaks in one shard.
SHARD_WORDS = 1 << 21
#: Words of text whose n-grams one bucket merges.
BUCKET_WORDS = 1 << 21
#: Bits of a hash that tell n-grams of one bucket apart; a multiple of 8.
KEY_BITS = 40
#: UTF-8 bytes of a text that are split into words at a time.
SLICE = 1 << 20
#: What ends a piece becomes a full stop, which no word has; tabs become spaces.
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"..........\x20")


def _slices(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, with b'.' where pieces end, some at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_BREAKS).lower()
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].replace(b".", b" . ").split()
        at = end


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """The starts of the suffixes in ascending order of their first `depth` codes at least, by prefix doubling.

    Ranks by the first w codes and ranks of the suffix w further on make ranks by the first 2 w."""
    order = np.argsort(codes, kind="stable")
    width, sorted_keys = 1, codes[order]
    while width < depth:
        rank = np.empty(len(codes), dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], sorted_keys[1:] != sorted_keys[:-1]))) if len(codes) else 0
        further = np.zeros(len(codes), dtype=np.int64)
        further[: max(len(codes) - width, 0)] = rank[width:]
        keys = rank * (len(codes) + 1) + further
        order = np.argsort(keys, kind="stable")
        width, sorted_keys = 2 * width, keys[order]
    return order


def ngram_intervals(codes: np.ndarray, mine: np.ndarray, least: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For n from least to most: (n, where each distinct n-gram occurs once, how often it starts where `mine` is true).

    Code 0 breaks n-grams. Suffixes that share n codes are neighbours in the suffix array: an interval over which the
    longest common prefix of neighbours stays at n or more."""
    order = suffix_array(codes, most)
    order = order[codes[order] > 0]
    padded = np.concatenate((codes, np.zeros(most, dtype=codes.dtype)))
    common = np.zeros(len(order), dtype=np.int64)
    room = np.zeros(len(order), dtype=np.int64)
    same, open_ = np.ones(len(order), dtype=bool), np.ones(len(order), dtype=bool)
    same[:1] = False
    for k in range(most):
        here = padded[order + k]
        open_ &= here > 0
        same[1:] &= (here[1:] == here[:-1]) & open_[1:]
        common += same
        room += open_
    counted = mine[order].astype(np.int64)
    for n in range(least, most + 1):
        starts = np.flatnonzero(common < n)
        counts = np.add.reduceat(counted, starts) if len(starts) else np.zeros(0, dtype=np.int64)
        there = room[starts] >= n
        yield n, order[starts[there]], counts[there]


def _pack(codes: np.ndarray) -> bytes:
    """Codes as compressed planes of bytes; the high ones are almost empty."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel().astype(np.int64)


def _pack_lines(texts: Iterable[bytes]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"\n".join(texts))


def _unpack_lines(data: bytes) -> list[bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data).split(b"\n")


#: own: n-grams that start at a later code belong to the next shard, which has these codes too. words: those of codes from 1
#: on; of_lang: each one's place in langs; counts: how often each occurs; n_words: how many words each language has.
_COLUMNS = ["shard", "own", "codes", "words", "of_lang", "counts", "langs", "n_words"]
_SHARD = "shard long, own int, codes binary, words binary, of_lang binary, counts binary, langs array<string>, n_words array<long>"


class _Ids(dict):
    """Ids of words as they come up, from a counter; the break has 0."""

    def __init__(self, counter: Iterator[int]):
        super().__init__({b".": 0})
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        self[word] = made = next(self.counter)
        return made


def _shards(texts: DataFrame, most: int) -> DataFrame:
    """Texts (lang, text) as sequences of word ids. Shards follow each other within a partition; each has its own ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        langs: dict[str, _Ids] = {}
        held: list[np.ndarray] = []
        size, counter = 0, itertools.count(1)

        def add(lang: str, words: list[bytes]) -> None:
            nonlocal size
            if lang not in langs:
                langs[lang] = _Ids(counter)
            held.append(np.fromiter(map(langs[lang].__getitem__, words), np.int64, len(words)))
            size += len(words)

        def shard(own: int, codes: np.ndarray) -> pd.DataFrame:
            nonlocal made
            known = sum(len(ids) - 1 for ids in langs.values())
            words, of_lang = [b""] * known, np.zeros(known, dtype=np.int64)
            for k, ids in enumerate(langs.values()):
                for w, i in ids.items():
                    if i:
                        words[i - 1] = w
                        of_lang[i - 1] = k
            counts = np.bincount(codes[:own], minlength=known + 1)[1:]
            made += 1
            n_words = np.bincount(of_lang, weights=counts, minlength=len(langs)).astype(np.int64)
            return pd.DataFrame([(part << 32 | made, own, _pack(codes), _pack_lines(words), _pack(of_lang), _pack(counts), list(langs), n_words.tolist())], columns=_COLUMNS)

        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                for words in _slices(text):
                    add(lang, words)
                    if size >= SHARD_WORDS:
                        codes, tail = np.concatenate(held), words[-(most - 1) :]
                        yield shard(size - len(tail), codes)
                        langs, held, size, counter = {}, [], 0, itertools.count(1)
                        add(lang, tail)
                add(lang, [b"."])
        if size:
            yield shard(size, np.concatenate(held))

    return texts.mapInPandas(run, _SHARD)


def _stretches(codes: np.ndarray, own: int, joined: np.ndarray) -> tuple[np.ndarray, int]:
    """(codes in stretches of two or more, breaks between; how many of these come from before `own`).

    joined: whether each code but the last belongs together with the next one."""
    kept = np.zeros(len(codes), dtype=bool)
    kept[:-1] |= joined
    kept[1:] |= joined
    places = np.flatnonzero(kept)
    gaps = np.flatnonzero(~joined[places[1:] - 1]) + 1 if len(places) else places
    before = int(np.searchsorted(places, own))
    return np.insert(codes[places], gaps, 0), before + int(np.searchsorted(gaps, before, side="right"))


def _word_keys(r) -> np.ndarray:
    """A 64-bit hash of the language and word of each code; that of code 0 is no word's."""
    import xxhash

    langs = [x.encode() + b"\x00" for x in r.langs]
    words = zip(_unpack_lines(r.words), _unpack(r.of_lang).tolist(), strict=False)
    return np.array([0, *(xxhash.xxh3_64_intdigest(langs[k] + w) for w, k in words)], dtype=np.uint64)


def _ngram_keys(keys: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """For each place, the bucket of the hash of the n words from there on, and above KEY_BITS of the hash itself.

    keys: the words' hashes; the last n - 1 places have none."""
    h = keys[: max(len(keys) - n + 1, 0)]
    for k in range(1, n):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (keys[k : k + len(h)] + (h >> np.uint64(29)))
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return ((h >> np.uint64(KEY_BITS)) % np.uint64(buckets) << np.uint64(KEY_BITS)) | (h & np.uint64((1 << KEY_BITS) - 1))


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys of one bucket as compressed planes of their differences."""
    import zstandard

    low = keys & np.uint64((1 << KEY_BITS) - 1)
    steps = np.diff(low, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]
    return zstandard.ZstdCompressor(level=1).compress(steps.T.tobytes())


def _unpack_keys(data: bytes, bucket: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(KEY_BITS // 8, -1)
    steps = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    steps[:, : KEY_BITS // 8] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) | (np.uint64(bucket) << np.uint64(KEY_BITS))


def _frequent_keys(shards: DataFrame, n: int, min_count: int, buckets: int) -> DataFrame:
    """(shard, bucket, keys): of the n-grams of each shard, those that occur min_count times or more in all shards.

    A shard sends each bucket the hashes that fall into it, with its counts; a bucket adds up and tells each shard which of
    its hashes stay. Hashes that clash can let a rare n-gram pass, and never lose one."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                if n == 1:
                    found = [(_ngram_keys(_word_keys(r)[1:], 1, buckets), _unpack(r.counts))]
                else:
                    codes = _unpack(r.codes)
                    keys = _ngram_keys(_word_keys(r)[codes], n, buckets)
                    found = [(keys[at], counts) for _, at, counts in ngram_intervals(codes, np.arange(len(codes)) < r.own, n, n)]
                for sent, counts in found:
                    order = np.argsort(sent)
                    sent, counts = sent[order], counts[order]
                    bucket = (sent >> np.uint64(KEY_BITS)).astype(np.int64)
                    bounds = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])) if len(bucket) else [0]
                    rows = [(int(bucket[a]), r.shard, _pack_keys(sent[a:b]), _pack(counts[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    yield pd.DataFrame(rows, columns=["bucket", "shard", "keys", "counts"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [_unpack_keys(k, b) for k, b in zip(pdf["keys"], pdf["bucket"], strict=True)]
        _, inverse = np.unique(np.concatenate(held), return_inverse=True)
        stays = (np.bincount(inverse, weights=np.concatenate([_unpack(c) for c in pdf["counts"]])) >= min_count)[inverse]
        told = [k[some] for k, some in zip(held, np.split(stays, np.cumsum([len(k) for k in held])[:-1]), strict=True)]
        rows = [(s, b, _pack_keys(k)) for s, b, k in zip(pdf["shard"], pdf["bucket"], told, strict=True) if len(k)]
        return pd.DataFrame(rows, columns=["shard", "bucket", "keys"])

    asked = shards.mapInPandas(ask, "bucket int, shard long, keys binary, counts binary")
    return asked.groupBy("bucket").applyInPandas(answer, "shard long, bucket int, keys binary")


def _known(rows: pd.DataFrame, keys: np.ndarray) -> np.ndarray:
    """Whether each key is among those of rows (bucket, keys)."""
    return np.isin(keys, np.concatenate([_unpack_keys(k, b) for k, b in zip(rows["keys"], rows["bucket"], strict=True)])) if len(rows) else np.zeros(len(keys), dtype=bool)


def _frequent_words_only(shards: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """Shards with the words that are in `words`, numbered anew, and stretches of two or more of them."""

    def run(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples():
            codes, text = _unpack(r.codes), _unpack_lines(r.words)
            kept = np.flatnonzero(_known(known, _ngram_keys(_word_keys(r)[1:], 1, buckets)))
            renamed = np.zeros(len(text) + 1, dtype=np.int64)
            renamed[kept + 1] = np.arange(1, len(kept) + 1)
            codes = renamed[codes]
            codes, own = _stretches(codes, r.own, (codes[:-1] > 0) & (codes[1:] > 0))
            out.append((r.shard, own, _pack(codes), _pack_lines([text[k] for k in kept]), _pack(_unpack(r.of_lang)[kept]), _pack(_unpack(r.counts)[kept]), list(r.langs), None))
        return pd.DataFrame(out, columns=_COLUMNS)

    return shards.groupBy("shard").cogroup(words.groupBy("shard")).applyInPandas(run, _SHARD)


def _frequent_pairs_only(shards: DataFrame, pairs: DataFrame, buckets: int) -> DataFrame:
    """Shards with nothing but stretches whose neighbours are all in `pairs`."""

    def run(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples():
            codes = _unpack(r.codes)
            joined = (codes[:-1] > 0) & (codes[1:] > 0) & _known(known, _ngram_keys(_word_keys(r)[codes], 2, buckets))
            codes, own = _stretches(codes, r.own, joined)
            out.append((r.shard, own, _pack(codes), r.words, r.of_lang, r.counts, list(r.langs), None))
        return pd.DataFrame(out, columns=_COLUMNS)

    return shards.groupBy("shard").cogroup(pairs.groupBy("shard")).applyInPandas(run, _SHARD)


def _runs(codes: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes in runs in which every three in a row are `whole`, breaks between; the place of each, that of a break at the end).

    Words in which two runs overlap come twice, but each three in a row once."""
    starts = np.flatnonzero(whole & ~np.concatenate(([False], whole[:-1])))
    ends = np.flatnonzero(whole & ~np.concatenate((whole[1:], [False]))) + 3
    places = [np.append(np.arange(a, b), -1) for a, b in zip(starts, ends, strict=True)]
    flat = np.concatenate(places) if places else np.zeros(0, dtype=np.int64)
    return np.where(flat >= 0, codes[flat], 0), np.where(flat >= 0, flat, len(codes))


def _by_bucket(found: Iterable[tuple[bytes, int, int]], langs: list[str], buckets: int) -> Iterator[tuple]:
    """Rows of _NAMED from (text, place of its language, count)."""
    import xxhash

    dealt: dict[int, list[tuple[bytes, int, int]]] = {}
    for x in found:
        dealt.setdefault(xxhash.xxh3_64_intdigest(x[0]) % buckets, []).append(x)
    for bucket, some in dealt.items():
        text, lang, counts = zip(*some, strict=True)
        yield bucket, langs, _pack_lines(text), _pack(np.array(lang)), _pack(np.array(counts))


_NAMED = "bucket int, langs array<string>, text binary, of_lang binary, counts binary"


def _words(shards: DataFrame, buckets: int) -> DataFrame:
    """The words of shards by bucket, as _NAMED."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                found = (x for x in zip(_unpack_lines(r.words), _unpack(r.of_lang).tolist(), _unpack(r.counts).tolist(), strict=False) if x[2])
                yield pd.DataFrame(list(_by_bucket(found, list(r.langs), buckets)), columns=["bucket", "langs", "text", "of_lang", "counts"])

    return shards.mapInPandas(run, _NAMED)


def _phrases(shards: DataFrame, triples: DataFrame, most: int, buckets: int) -> DataFrame:
    """n-grams of two words, and of more all of whose three in a row are in `triples`, by bucket, as _NAMED."""

    def run(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples():
            codes, words, of_lang = _unpack(r.codes), _unpack_lines(r.words), _unpack(r.of_lang)
            three = (codes[:-2] > 0) & (codes[1:-1] > 0) & (codes[2:] > 0) & _known(known, _ngram_keys(_word_keys(r)[codes], 3, buckets))
            longer, places = _runs(codes, three)
            found: list[tuple[bytes, int, int]] = []
            for kept, mine, low, high in ((codes, np.arange(len(codes)) < r.own, 2, 2), (longer, places < r.own, 3, most)):
                for n, at, counts in ngram_intervals(kept, mine, low, high) if low <= min(high, most) else ():
                    at, counts = at[counts > 0], counts[counts > 0]
                    for run, a in zip(kept[at[:, None] + np.arange(n)].tolist(), counts.tolist(), strict=True):
                        found.append((b" ".join([words[c - 1] for c in run]), int(of_lang[run[0] - 1]), a))
            out += _by_bucket(found, list(r.langs), buckets)
        return pd.DataFrame(out, columns=["bucket", "langs", "text", "of_lang", "counts"])

    return shards.groupBy("shard").cogroup(triples.groupBy("shard")).applyInPandas(run, _NAMED)


def _added(named: DataFrame, min_count: int) -> DataFrame:
    """(lang, phrase, words, a): what occurs min_count times or more, added up by its text: what hashes let pass in error goes."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total: dict[tuple[str, bytes], int] = {}
        for r in pdf.itertuples():
            langs = list(r.langs)
            for text, k, a in zip(_unpack_lines(r.text), _unpack(r.of_lang).tolist(), _unpack(r.counts).tolist(), strict=True):
                total[langs[k], text] = total.get((langs[k], text), 0) + a
        rows = [(lang, text.decode("utf-8", "surrogatepass"), text.count(b" ") + 1, a) for (lang, text), a in total.items() if a >= min_count]
        return pd.DataFrame(rows, columns=["lang", "phrase", "words", "a"])

    return named.groupBy("bucket").applyInPandas(add, "lang string, phrase string, words int, a long")


def cut_score(a: Column, left: Column, right: Column, n: Column) -> Column:
    """floor(1000 a n / (l r)), exact beyond 64 bits."""
    wide = "decimal(38,0)"
    return F.call_function("div", a.cast(wide) * F.lit(1000) * n, left.cast(wide) * right)


def phrase_counts(docs: DataFrame, most: int, min_count: int, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, a): every word and every phrase of up to `most` words that occurs min_count times or more;
    (lang, n): the words of each language).

    An n-gram that occurs so often has no rarer word, pair or three in a row. So words are counted first, over all shards; pairs
    of frequent words next, then three frequent pairs in a row, by hashes; last the n-grams made of what is left, by their
    text. Each round merges the shards' counts by key and tells every shard what stays. Hashes and texts travel packed, one row
    for each shard and bucket that has some; buckets follow the number of words."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    shards = materialise(_shards(texts, most), "shards")
    per_lang = materialise(shards.select(F.explode(F.arrays_zip("langs", "n_words")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.n_words").alias("n")), "per_lang")
    buckets = 1 + (per_lang.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS
    slim = materialise(_frequent_words_only(shards, _frequent_keys(shards, 1, min_count, buckets), buckets), "stretches")
    pairs = materialise(_frequent_pairs_only(slim, _frequent_keys(slim, 2, min_count, buckets), buckets), "pairs")
    phrases = _phrases(pairs, _frequent_keys(pairs, 3, min_count, buckets), most, buckets)
    return materialise(_added(_words(slim, buckets).unionByName(phrases), min_count), "phrases"), per_lang


def collocations(
    docs: DataFrame, most: int = 5, min_count: int = 100, inside_percent: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """Per language the `top` phrases (lang, rank, phrase, a, l, r, n, score) by score, then a, both descending, then phrase.

    Texts, A-Z lower-cased, are split at .,;:!? and line ends (0A to 0D) into pieces, these at spaces and tabs into words.
    a counts all occurrences of a phrase of 2 to `most` words within pieces, n all words of the language. A phrase with
    a >= min_count is a candidate; cut after its first k words, the parts occur l and r times, and the cut scores
    floor(1000 a n / (l r)); the lowest score counts, ties to the smallest k. Candidates within a longer one that occurs
    inside_percent of their times or more are dropped. Counts cover the whole of all texts.

    A null language is 'und'; null and empty texts have no words; repeated rows count each; other columns are ignored; an
    empty table gives no rows."""
    counts, per_lang = phrase_counts(docs, most, min_count, lang_col, text_col)
    candidates = counts.where("words > 1").withColumn("part", F.split("phrase", " "))

    def joined(first: Column | int, count: Column | int) -> Column:
        return F.array_join(F.slice("part", first, count), " ")

    k = F.col("k")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", joined(1, k).alias("first"), joined(k + 1, F.col("words") - k).alias("rest")
    )
    scored = (
        cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
        .join(counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
        .join(per_lang, "lang")
        .withColumn("score", cut_score(F.col("a"), F.col("l"), F.col("r"), F.col("n")))
    )
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # what is within a longer candidate is within one that is a word longer and occurs at least as often
    longer = candidates.where("words > 2").select("lang", F.explode(F.array(joined(1, F.col("words") - 1), joined(2, F.col("words") - 1))).alias("phrase"), "a")
    inside = longer.groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    kept = weakest.join(inside, ["lang", "phrase"], "left").where(F.col("inside").isNull() | (100 * F.col("inside") < inside_percent * F.col("a")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
