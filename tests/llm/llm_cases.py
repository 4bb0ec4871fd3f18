"""Texts that the tests of this folder share."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocab=400):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(2 + k % 5)) if rng.random() < 0.5 else f"w{rng.randrange(vocab)}" for k in range(n))


def odd_rows():
    """Nulls, empties, blanks, ties, repeats, near copies, shared passages and a very long text."""
    rng = random.Random(5)
    base = [prose(rng, 60) for _ in range(8)]
    passage = prose(rng, 40)
    near = base[0].split()
    near[30] = "changed"
    texts = [
        None, "", "   \n\t", "one", "one", "two words", base[0], base[0], " ".join(near), base[1] + " " + passage, passage + " " + base[2], base[3].upper(), base[3],
        "é" * 70 + " " + passage[:80], "a" * 500, "ab" * 300, prose(rng, 9000), base[4] + "\n" + base[5], "İ ǅ ﬁ 漢字 😀 <|endoftext|> don't", base[6], base[6] + " x",
    ]
    return [(k, t, "en" if k % 2 else "de", "s", len(t or "")) for k, t in enumerate(texts)]
