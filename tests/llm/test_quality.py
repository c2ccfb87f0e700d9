"""Quality rules against plain loops: counts, bands, odd rows."""

import random
from collections import Counter

import pytest
import zstandard

from paramloom.llm import quality

SPACES = " \t\n\x0b\x0c\r"


def plain_words(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACES:
            out, word = out + [word] * bool(word), ""
        else:
            word += c
    return out + [word] * bool(word)


def plain(text):
    words = plain_words(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if often[w] >= 2 for k in range(5)}
    earlier, twice = [], 0
    for line in (text or "").split("\n"):
        if plain_words(line):
            twice += line in earlier
            earlier.append(line)
    failed = len(words) < 10 or 100 * len(marked) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), twice, len(marked), failed


def plain_kept(text):
    data = (text or "").encode()

    def side(piece):
        r = len(piece) / len(zstandard.compress(piece, 3))
        low, high = [(b[1], b[2]) for b in quality.BANDS if b[0] <= len(piece)][-1]
        return not low <= r <= high

    if plain(text)[5]:
        return False
    out = sum(len(data[k : k + 4096]) for k in range(0, len(data), 4096) if side(data[k : k + 4096]))
    return not side(data) and out <= 0.25 * len(data)


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgéñß漢") for _ in range(rng.randint(1, 4)))
    out = [None, "", " ", "\n\n", "a b c d e", "a b c d e a b c d e", "a b c d", "x " * 300, "# * | <b>\n# * | <b>\n\n\r\n\r\n", "# * | <b>\r\n# * | <b>\n"]
    out += [" ".join(word() for _ in range(rng.randint(1, 400))) + rng.choice(["", "\n"]) for _ in range(60)]
    out += ["\n".join(rng.choice(["a b", "a b ", "c", "", "\t"]) for _ in range(20)) for _ in range(20)]
    out += [t + " " + " ".join(plain_words(t)[:12]) for t in out[10:30]]
    out.append(" ".join(str(rng.random()) for _ in range(60_000)))
    return out


def test_equals_plain_loops(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(3, "again", "y", 2), (None, "z " * 9, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int").repartition(3)
    got = quality.judge(docs)
    assert got.columns.count("kept") == 1 and got.columns.count("n_words") == 1
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "", r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in got.collect())
    assert found == sorted((i if i is not None else -1, t or "", *plain(t), plain_kept(t)) for i, t, *_ in rows)


def test_windows_of_many_words_are_numbered_exactly():
    rng = random.Random(1)
    words = [str(rng.randint(0, 40_000)).encode() for _ in range(60_000)]
    words += words[100:150]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    assert quality.repeated_words(words) == len(marked) >= 100


@pytest.mark.parametrize("kind", ["base64", "repetition", "mixed", "prose"])
def test_bands_decide(kind):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    code = lambda n: " ".join("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60)) for _ in range(n))
    text, kept = {
        "base64": (code(100), False),
        "repetition": ("".join(f"item-{i}-of-the-list-of-all-items-is-this-one-here\n" for i in range(900)), False),
        "mixed": (prose(2000) + " " + code(200), False),
        "prose": (prose(3000), True),
    }[kind]
    got = quality.measure(text, quality.Bands(), zstandard.ZstdCompressor(level=3))
    assert not plain(text)[5] and got[-1] == kept


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).collect() == []
