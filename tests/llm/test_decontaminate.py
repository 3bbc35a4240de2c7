"""Operator 3: stretches against a search over all of them, words of any script, repetitive texts, and the whole join against plain Python."""

import itertools
import random
import re
import time
import unicodedata

import numpy as np
import pytest

from crosspanel.llm import decontaminate


def plain_words(text):
    """Runs of letters, marks and digits in lower case; each Chinese, Japanese or Korean sign by itself."""
    out, run = [], ""
    for c in (text or "").lower():
        sign = re.match("[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]", c)
        if c.isalnum() and not sign or unicodedata.category(c)[0] == "M":
            run += c
            continue
        if run:
            out.append(run)
        run = ""
        if sign:
            out.append(c)
    return out + [run] * bool(run)


def plain_best(words, item):
    """(length, equal words, -start) of the longest stretch, over all ways to lie, all starts and all ends."""
    least, best = min(decontaminate.LEAST, len(item)), (0, 0, 0)
    for d in range(1 - len(item), len(words)):
        lo, hi = max(0, -d), min(len(item), len(words) - d)
        same = [words[d + k] == item[k] for k in range(lo, hi)]
        for i, j in itertools.combinations(range(len(same) + 1), 2):
            if j - i >= least and 5 * sum(same[i:j]) >= 4 * (j - i):
                best = max(best, (j - i, sum(same[i:j]), -(i + lo + d)))
    return best


@pytest.mark.parametrize("vocabulary", [1, 2, 3, 30])
def test_longest_stretches(vocabulary):
    rng = np.random.default_rng(vocabulary)
    for _ in range(25):
        n, m = int(rng.integers(1, 45)), int(rng.integers(1, 26))
        v, item = (rng.integers(1, vocabulary + 1, k).astype(np.uint64) for k in (n, m))
        if n > m and rng.random() < 0.6:
            at, copy = int(rng.integers(n - m)), item.copy()
            copy[rng.random(m) < 0.15] = 99
            v[at : at + m] = copy
        assert decontaminate.best_overlap(v, item, np.arange(1 - m, n)) == plain_best(v.tolist(), item.tolist())


def test_words_of_any_script():
    for text, n in (("नमस्ते दुनिया", 2), ("สวัสดี ครับ", 2), ("a_b c", 3), ("日本語 text", 4), ("été été", 2), ("Ünï ß_x", 3), ("x1 2y, z-z", 4), (None, 0), ("", 0), ("_", 0)):
        assert len(decontaminate.words_of(text)) == len(plain_words(text)) == n
    assert decontaminate.words_of("ABC déf")[0] == decontaminate.words_of("abc")[0]


def test_repetitive_texts_take_bounded_time():
    rng = np.random.default_rng(1)
    for n, m, seconds in ((8_000, 30, 3), (8_000, 300, 8), (3_000, 100_000, 30)):
        v, item = (rng.integers(1, 3, k).astype(np.uint64) for k in (n, m))
        began = time.process_time()
        found = decontaminate.best_overlap(v, item, np.arange(1 - min(m, 50), n))
        assert found[0] >= 13 and time.process_time() - began < seconds
    assert decontaminate.best_overlap(np.ones(50_000, np.uint64), np.ones(500, np.uint64), np.arange(49_000)) == (500, 500, 0)


def test_leaks_against_plain_python(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    items = [(k, say(rng.choice([3, 6, 12, 14, 20, 40]))) for k in range(12)] + [(20, None), (21, ""), (22, "नमस्ते दुनिया कैसे हो तुम सब"), (23, "a b a b a b a b a b a b a b a b")]
    docs = [(k, say(80)) for k in range(10)]
    for k, (_, t) in enumerate(items[:12]):  # passages with a word in ten replaced
        docs.append((100 + k, f"{say(15)} {' '.join('x' if rng.random() < 0.1 else w for w in t.split())} {say(10)}"))
    docs += [(200, None), (201, ""), (202, f"{say(5)} नमस्ते, दुनिया! कैसे हो तुम सब? {say(5)}"), (203, "a b " * 300), (204, "b a " * 40), (100, docs[10][1])]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string"))
    want = set()
    for i, t in docs:
        for item, text in items:
            words = plain_words(text)
            n, same, start = plain_best(plain_words(t), words) if words and len(set(words) & set(plain_words(t))) else (0, 0, 0)
            if n and (len(words) >= 5 or same == len(words)):
                want.add((i, item, -start, n, same))
    found = {(r["doc_id"], r["item_id"], r["start"], r["length"], r["equal"]) for r in got.collect()}
    assert {x[:2] for x in found} == {x[:2] for x in want} and len(want) > 10
    assert all(x[3] >= min(13, len(plain_words(dict(items)[x[1]]))) and 5 * x[4] >= 4 * x[3] for x in found)
