"""Texts encoded together give what each gives alone."""

import random

import pytest

from tidemark.llm.bpe import Encoder, default_tokenizer_path


@pytest.mark.parametrize("memory, chars", [(500_000, 1 << 20), (40, 300), (3, 1)])
def test_together_as_alone(memory, chars):
    rng = random.Random(memory)
    words = ["".join(rng.choices("abcdéü✓0.,", k=rng.randint(1, 9))) for _ in range(300)]
    texts = [None, "", "x" * 2000, *(" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(60))]
    texts += [t.encode("latin-1", "ignore").decode("latin-1") for t in texts if t]
    alone, together = Encoder(default_tokenizer_path()), Encoder(default_tokenizer_path(), memory_words=memory)
    assert list(together.encode_all(texts, chars)) == [alone.encode(t)[0] for t in texts]
