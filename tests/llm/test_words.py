import random
import re

import pyarrow as pa
import pytest

from tidemark.llm import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_words_are_those_of_the_regex(monkeypatch, chunk):
    monkeypatch.setattr(words, "CHUNK", chunk)
    rng = random.Random(1)
    texts = ["", None, "Hello World", "ÀB c d  x1", "ab", "cd", "  ", "z" * 50] + ["".join(rng.choice("aB1 é.\n漢") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    seen = 0
    for g in words.word_groups(pa.array(texts)):
        for r in range(g.last - g.first):
            want = WORD.findall(fold(texts[g.first + r]))
            assert [g.word(i).decode() for i in range(g.at[r], g.at[r + 1])] == want
            assert (words.hash_words([x.encode() for x in want]) == g.hashes[g.at[r] : g.at[r + 1]]).all()
            assert g.text(r).decode() == " ".join(want)
            assert words.split_words(texts[g.first + r]) == [x.encode() for x in want]
            seen += 1
    assert seen == len(texts)


def test_shingles():
    h = words.hash_words([b"a", b"b", b"c", b"a", b"b", b"c"])
    s = words.shingle_hashes(h, 3)
    assert len(s) == 4 and s[0] == s[3] and len(set(s.tolist())) == 3
    assert len(words.shingle_hashes(h, 7)) == 0
