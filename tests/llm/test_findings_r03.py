"""Cases of the third round's findings about the pipeline operators."""
import random

from chronotext.llm import packing


def test_the_word_cache_is_one_and_bounded(monkeypatch):
    """Words and their parts share one bounded cache, and ids equal the tokenizer's with and without what it forgot."""
    monkeypatch.setattr(packing, "CACHED", 50)
    with open(packing.default_tokenizer(), encoding="utf-8") as file:
        cache = packing.WordCache(file.read())
    r = random.Random(4)
    words = ["".join(r.choice("abcdeXYé'1.,") for _ in range(r.randrange(1, 9))) for _ in range(400)] + ["hello", "Hello", "hello,", "HELLO...", "s", "'s"]
    for _ in range(3):
        text = " ".join(r.choice(words) for _ in range(500))
        assert cache.encode(text.encode()) == packing.np.array(cache.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert len(cache) <= 50 and len(cache.old) <= 50 and not hasattr(cache, "parts")
