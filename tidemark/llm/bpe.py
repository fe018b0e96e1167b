"""Byte-pair encoding of whole texts with a tokenizer file, and decoding of its ids.

The tokenizer file is the tokenizers library's word-level BPE: NFC, white space, lower case, a word pattern, bytes as
characters, an end-of-word mark, no decoder (decode joins tokens with spaces)."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, filterfalse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_text, typed_ids

#: Characters of a run without a break beyond which it is cut in halves that are encoded apart.
LEAF_CHARS = 512
#: Words whose ids a task remembers; beyond it the later half is forgotten.
MEMORY_WORDS = 500_000

# The letters and digits of Latin-1, as the tokenizer's pattern takes them (fixed values of Unicode).
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t-\r \x85\xa0"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACE}{_LETTERS}{_DIGITS}]+")


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def join_encodings(left: list, right: list, ends: bool, encode) -> list:
    """The encoding of two texts put together, from those of each; ends: the second one ends its word.

    A window around the join is encoded anew and grows until its first token is the old left one at that place and its
    last token the old right one. A sequence of tokens is the encoding of its text exactly if each neighbouring pair
    encodes to itself; beyond the window pairs are those of the old encodings, so the result is exact."""
    size = 1
    while True:
        a, b = min(size, len(left)), min(size, len(right))
        window = encode(left[len(left) - a :] + right[:b], ends and b == len(right))
        if (a == len(left) or window[0] == left[-a]) and (b == len(right) or window[-1] == right[b - 1]):
            return left[: len(left) - a] + window + right[b:]
        size *= 2


class Encoder:
    """Encodes and decodes whole texts exactly as the tokenizers library does with this file, with special tokens
    recognised in the text and none added."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, memory_words: int = MEMORY_WORDS):
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = spec["model"]
        self.mark = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ending = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.mark, cache_capacity=0)
        # Before the end of a word no character carries the mark; merges with it can't apply.
        self.inner = models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0)
        self.vocab = self.library.get_vocab(with_added_tokens=True)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.byte_chars = _byte_characters()
        self.leaf_chars, self.memory_words = leaf_chars, memory_words
        self.ids: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}

    def _tokens(self, word: str, ends: bool) -> list[str]:
        return [t.value for t in (self.ending if ends else self.inner).tokenize(word)]

    def _again(self, tokens: list[str], ends: bool) -> list[str]:
        text = "".join(tokens)
        return self._tokens(text.removesuffix(self.mark) if ends and self.mark else text, ends)

    def tree(self, word: str, ends: bool = True) -> list[str]:
        """Tokens of one unbroken run, given as byte characters; halves are encoded apart and put together."""
        if len(word) <= self.leaf_chars:
            return self._tokens(word, ends)
        half = len(word) // 2
        return join_encodings(self.tree(word[:half], False), self.tree(word[half:], ends), ends, self._again)

    def _learn(self, words: list[str], decode: bool, make_room: bool = True) -> None:
        """Remember the ids of words, and with decode their tokens as shown text."""
        if make_room and len(self.ids) + len(words) > self.memory_words:
            # words met early tend to be the frequent ones
            for store in (self.ids, self.shown):
                for w in list(store)[self.memory_words // 2 :]:
                    del store[w]
        short = [w for w in words if len(w) <= self.leaf_chars]
        for at in range(0, len(short), 10_000):
            part = short[at : at + 10_000]
            # between spaces each word is again one run
            found = self.library.encode(" ".join(part), add_special_tokens=False)
            ids, owners = np.array(found.ids, dtype="<u4"), np.array(found.word_ids)
            ends = np.flatnonzero(np.diff(owners, append=-1)) + 1
            tokens = found.tokens if decode else []
            begin = 0
            for w, end in zip(part, ends.tolist(), strict=True):
                self.ids[w] = ids[begin:end].tobytes()
                if decode:
                    self.shown[w] = " ".join(tokens[begin:end])
                begin = end
        for w in words:
            if len(w) > self.leaf_chars:
                tokens = self.tree("".join(map(self.byte_chars.__getitem__, w.encode())))
                self.ids[w] = np.array([self.vocab[t] for t in tokens], dtype="<u4").tobytes()
                if decode:
                    self.shown[w] = " ".join(tokens)

    def _words(self, text: str) -> list[str] | None:
        """The runs that are encoded apart; None where only the library is sure to cut the text alike."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return None
        if any(s in text for s in self.special):
            return None
        return _WORDS.findall(text.lower())

    def encode(self, text: str | None, decode: bool = False) -> tuple[bytes, str | None]:
        """(ids as little-endian unsigned 32-bit integers, decoded text or None)."""
        words = self._words(text or "")
        if words is None:
            return self._general(text, decode)
        known = self.shown if decode else self.ids
        try:
            return self._look_up(words, decode)
        except KeyError:
            self._learn([w for w in set(words) if w not in known], decode)
        if gone := [w for w in set(words) if w not in known]:  # forgotten to make room
            self._learn(gone, decode, make_room=False)
        return self._look_up(words, decode)

    def encode_all(self, texts: Iterable[str | None], chars: int = 1 << 20) -> Iterator[bytes]:
        """The ids of each text, as encode gives them; texts of about `chars` characters together learn their new words at once."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= chars:
                yield from self._encode_held(held)
                held, size = [], 0
        yield from self._encode_held(held)

    def _encode_held(self, texts: list[str]) -> Iterator[bytes]:
        words = [self._words(t) for t in texts]
        fresh = set(filterfalse(self.ids.__contains__, chain.from_iterable(w for w in words if w is not None)))
        if fresh:
            self._learn(list(fresh), False)
        for text, run in zip(texts, words, strict=True):
            try:
                yield self._look_up(run, False)[0] if run is not None else self._general(text, False)[0]
            except KeyError:  # forgotten to make room
                yield self.encode(text)[0]

    def _look_up(self, words: list[str], decode: bool) -> tuple[bytes, str | None]:
        return b"".join(map(self.ids.__getitem__, words)), " ".join(map(self.shown.__getitem__, words)) if decode else None

    def _general(self, text: str, decode: bool) -> tuple[bytes, str | None]:
        """Any text: the library normalises it and cuts it into runs; long runs go through the tree."""
        parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]
        ids: list[int] = []
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(self.vocab[part])
            elif part:
                runs = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                for run, _ in runs:
                    ids += [self.vocab[t] for t in self.tree(run)]
        shown = self.library.decode(ids, skip_special_tokens=False) if decode else None
        return np.array(ids, dtype="<u4").tobytes(), shown

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids, skip_special_tokens=False)


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if it is printable Latin-1, else the next from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    return Encoder(path)


def encode_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids array, decoded]) of each row's whole text; null counts as empty.

    Rows are independent: repeated ids stay, other columns are ignored, an empty table gives no rows. Long texts
    without a break are encoded as a tree of halves, so their cost stays linear. with_ids adds the ids and the decoded
    text themselves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(tokenizer_path)
        for pdf in batches:
            found = [coder.encode(t, True) for t in pdf["text"]]
            out = {
                "id": pdf["id"],
                "n_tokens": [len(b) // 4 for b, _ in found],
                "ids_sha256": [hashlib.sha256(b).hexdigest() for b, _ in found],
                "decoded_sha256": [hashlib.sha256(t.encode("utf-8")).hexdigest() for _, t in found],
            }
            if with_ids:
                out |= {"ids": [np.frombuffer(b, dtype="<u4").astype(np.int64) for b, _ in found], "decoded": [t for _, t in found]}
            yield pd.DataFrame(out)

    more = ", ids array<long>, decoded string" if with_ids else ""
    texts = docs.select(id_text(id_col), F.col(text_col).alias("text"))
    return typed_ids(texts.mapInPandas(run, f"id string, n_tokens long, ids_sha256 string, decoded_sha256 string{more}"), docs, id_col)


def decode_ids(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) from arrays of ids; a null array decodes to an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(tokenizer_path)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "decoded": [coder.decode([] if x is None else [int(i) for i in x]) for x in pdf["ids"]]})

    rows = encoded.select(id_text(id_col), F.col(ids_col).alias("ids"))
    return typed_ids(rows.mapInPandas(run, "id string, decoded string"), encoded, id_col)
