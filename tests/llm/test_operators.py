"""Operators against brute-force versions, on small tables with nulls, empty and repeated rows and clashing columns."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from crosspanel.llm import bpe, decontaminate, html, lm, neighbours, quality, repeats, simhash, substring, suffix, toxicity
from crosspanel.llm.components import components

SCHEMA = "doc_id long, text string, row string, block long, word long, key string, score double, n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}é" if rng.random() < 0.1 else f"W{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    passage, far = sentence(rng, 60), sentence(rng, 400)
    texts = [sentence(rng, rng.choice([3, 30, 80, 300])) for _ in range(40)]
    texts += [f"{sentence(rng, 10)}  {passage}\n{sentence(rng, 12)}" for _ in range(9)]  # a passage that many share
    texts += [far, far.replace("W2 ", "x ", 3), far, far + " tail"]  # copies and near copies
    texts += [None, "", "", " \t\n", "one", "a b", "x " * 90, "日本語のテキスト " * 40, "   odd spaces\x0b\x0c \r\n here"]
    found = [(k, t) for k, t in enumerate(texts)]
    return found + [found[3], found[3], (None, "no id " + passage), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = spark.createDataFrame([(i, t, "r", 1, 2, "k", 0.5, 3) for i, t in rows], SCHEMA)
    return made.repartition(3, "text").cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def raw(text):
    return (text or "").encode()


def ascii_lower(text):
    return raw(text).lower().decode()


# ---- 1


def fingerprint(text):
    words = WORD.findall(ascii_lower(text))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(rows, docs, nothing):
    fps = [(i, fingerprint(t)) for i, t in rows]
    ids = {i for i, _ in rows if i is not None}
    component = {i: i for i in ids}
    for _ in range(len(ids)):
        before = dict(component)
        for i, a in fps:
            for j, b in fps:
                if i is not None and j is not None and bin(a ^ b).count("1") <= 3:
                    component[i] = component[j] = min(component[i], component[j])
        if before == component:
            break
    got = simhash.groups(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component"] == component[r["doc_id"]]
            assert r["fp"] % 2**64 == dict(fps)[r["doc_id"]]
    assert simhash.groups(nothing).count() == 0


@pytest.mark.parametrize("radius,part", [(3, 4096), (8, 4096), (3, 4), (8, 16)])
def test_links_find_all_pairs(spark, monkeypatch, radius, part):
    rng, n = np.random.default_rng(1), 300
    fp = rng.integers(0, 2**64, n, np.uint64)
    fp[: n // 2] &= np.uint64(0xFFFFFFFF0000FFFF)  # half of them agree in 16 bits
    for k in range(n // 3):
        fp[3 * k + 1] = fp[3 * k] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, radius, replace=False)))
    monkeypatch.setattr(simhash, "PART", part)
    frame = spark.createDataFrame([(int(i), int(f.astype(np.int64))) for i, f in enumerate(fp)], "id long, fp long")
    want = {k: min(j for j in range(n) if bin(int(fp[k]) ^ int(fp[j])).count("1") <= radius) for k in range(n)}
    got = {r["node"]: r["component"] for r in components(simhash.links(frame, radius)).collect()}
    assert {k: got.get(k, k) for k in range(n)} == want


@pytest.mark.parametrize("n", [1, 10, 10_000, 10**7, 10**10])
def test_plans_have_partitions(n):
    for radius in (1, 3, 8, 16):
        plan = simhash.make_plan(n, np.where(np.eye(64, dtype=bool), n // 2, n // 4), radius)
        assert len(plan.bits) > 1 and sorted(b for g in plan.bits for b in g) == list(range(64))
        assert sum(plan.thresholds) == radius - len(plan.bits) + 1


def test_near_duplicates(rows, docs):
    kept = [r["doc_id"] for r in simhash.near_duplicates_dropped(docs).select("doc_id").collect()]
    copies = [i for i, t in rows if t and t.startswith(rows[49][1][:200])]
    assert sum(i in kept for i in copies) == 1 and set(range(40)) <= set(kept)


def test_near_duplicates_keep_one_row(spark):
    rng = random.Random(8)
    copied, lone, nameless = (sentence(rng, 80) for _ in range(3))
    rows = [(7, copied), (7, copied), (3, copied), (7, lone), (None, nameless), (None, nameless)]
    got = simhash.near_duplicates_dropped(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([(3, copied), (7, lone), (None, nameless)])
    same = spark.createDataFrame([(7, copied), (7, copied)], "doc_id long, text string")
    assert simhash.near_duplicates_dropped(same).count() == 1


def test_near_duplicates_at_the_boundary(spark):
    def words(tag, n):
        return [f"{tag}{k}" for k in range(n)]

    rows, want = [], set()
    for k, n in enumerate((8, 12, 20, 24)):  # 4, 8, 16 and 20 shingles of five, and a quarter more in the other text
        a = words(f"a{k}x", n)
        more = (n - 4) // 4
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(a + words(f"b{k}x", more)))]
        want.add(2 * k)
    rng = random.Random(4)
    for k in range(10, 30, 2):  # the same set of shingles, nearly: a line of ten shingles comes ten times more
        a, line = words(f"c{k}x", 104), words(f"l{k}x", 14)
        rng.shuffle(a)
        rows += [(k, " ".join(a + line)), (k + 1, " ".join(a + line * 11))]
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    alike = {i for i in range(0, 8, 2) if len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) >= 0.8}
    assert alike == want
    got = {r["doc_id"] for r in simhash.near_duplicates_dropped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    every = {i: i for i in sets}
    for i, x in sets.items():
        for j, y in sets.items():
            if j < i and len(x & y) >= 0.8 * len(x | y):
                every[i] = min(every[i], every[j])
    assert got == {i for i in sets if every[i] == i} and not got & {1, 3, 5, 7} and len(got) == 14


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 3), (9, 8), (8, 9), (7, 1), (1, 2)], "src long, dst long")
    assert {tuple(r) for r in components(edges).collect()} == {(5, 3), (4, 3), (3, 3), (9, 8), (8, 8), (7, 1), (2, 1), (1, 1)}
    assert components(edges.where("false")).count() == 0


# ---- 2 and 7


def uncovered(symbols, width):
    """For each sequence the flags of what windows that start anywhere else don't cover."""
    starts = Counter(tuple(s[k : k + width]) for s in symbols for k in range(len(s) - width + 1))
    out = []
    for s in symbols:
        keep = [True] * len(s)
        for k in range(len(s) - width + 1):
            if starts[tuple(s[k : k + width])] > 1:
                keep[k : k + width] = [False] * width
        out.append(keep)
    return out


def digest(data):
    return hashlib.sha256(data).hexdigest()


def test_suffix(rows, docs, nothing):
    for width, k in ((200, 50), (40, 12)):
        data = [raw(t) for _, t in rows]
        want = Counter()
        for (i, _), s, keep in zip(rows, data, uncovered(data, width), strict=True):
            runs = sum(not b and (a is None or a) for a, b in zip([None, *keep], keep, strict=False))
            want[i, len(s), keep.count(False), runs, digest(bytes(c for c, x in zip(s, keep, strict=True) if x))] += 1
        got = Counter((r["i"], r["n_bytes"], r["n_removed"], r["n_spans"], digest(bytes(r["kept"]))) for r in suffix.repeats_removed(docs, width, k).select(F.col("row.doc_id").alias("i"), "n_bytes", "n_removed", "n_spans", "kept").collect())
        assert got == want and sum(r[2] for r in want) > 0
    assert suffix.repeats_removed(nothing).count() == 0


def test_suffix_array():
    rng = random.Random(1)
    for n in (0, 1, 2, 50, 300):
        for letters in (1, 2, 5, 250):
            s = bytes(rng.randrange(letters) for _ in range(n))
            assert suffix.suffix_array(s) == sorted(range(n), key=lambda i: s[i:])


def test_substring(rows, docs, nothing):
    for width, k in ((35, 8), (9, 3)):
        words = [WORD.findall(t or "") for _, t in rows]
        want = Counter()
        for (i, _), w, keep in zip(rows, words, uncovered(words, width), strict=True):
            want[i, len(w), keep.count(False), " ".join(x for x, y in zip(w, keep, strict=True) if y)] += 1
        got = Counter((r["i"], r["n_words"], r["n_removed"], r["kept"]) for r in substring.repeats_removed(docs, width, k).select(F.col("row.doc_id").alias("i"), "n_words", "n_removed", "kept").collect())
        assert got == want and sum(r[2] for r in want) > 0
    assert substring.repeats_removed(nothing).count() == 0


def test_crowded_anchors(rows, docs, monkeypatch):
    whole = Counter(map(str, substring.repeats_removed(docs).drop("row").collect()))
    monkeypatch.setattr(substring, "CROWD", 2)
    assert Counter(map(str, substring.repeats_removed(docs).drop("row").collect())) == whole


def test_crowded_anchors_make_no_row_for_each_window(spark, monkeypatch):
    """A passage that many texts have, between others: windows reach over its ends, some texts share those too."""
    rng = random.Random(8)
    made, cut = Counter(), repeats.cut

    def spy(df, name):
        out = cut(df, name)
        made[name] += out.count()
        if name == "extended" and not made["windows"]:
            made["windows"] = out.where("kinds > 20").agg(F.sum("m")).first()[0]
        return out

    monkeypatch.setattr(repeats, "cut", spy)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for module, join, part, width, tail in ((suffix, "", letters, suffix.WIDTH, ("n_bytes", raw)), (substring, " ", lambda n: " ".join(letters(9).replace(" ", "x") for _ in range(n)), substring.WIDTH, ("n_words", lambda t: WORD.findall(t)))):
        passage = part(width + 20)
        ends = [part(width) for _ in range(6)]
        texts = [join.join([part(width), passage, part(width)]) for _ in range(60)]
        texts += [join.join([part(width), passage, rng.choice(ends)]) for _ in range(20)] + [join.join([rng.choice(ends), passage, part(width)]) for _ in range(20)]
        texts += [texts[0], texts[60]]  # repeated wholes
        monkeypatch.setattr(module, "CROWD", 20)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        made.clear()
        got = {r["i"]: (r[tail[0]], r["n_removed"]) for r in module.repeats_removed(docs).select(F.col("row.doc_id").alias("i"), tail[0], "n_removed").collect()}
        symbols = [tail[1](t) for t in texts]
        assert got == {i: (len(x), keep.count(False)) for i, (x, keep) in enumerate(zip(symbols, uncovered(symbols, width), strict=True))}
        assert 0 < made["halves"] < made["windows"] / 2, made


# ---- 3


def test_decontaminate(spark, nothing):
    rng = random.Random(2)
    items = [sentence(rng, 30) for _ in range(20)] + ["just eight quite unusual words make this item", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def substituted(text, every):
        w = text.split()
        return " ".join(f"sub{k}" if k % every == every - 1 else x for k, x in enumerate(w))

    texts = [f"{sentence(rng, 50)} {items[0]} {sentence(rng, 50)}", f"{sentence(rng, 9)} {substituted(items[1], 7)}", "clean " + sentence(rng, 300), None, "", items[2].upper(), f"so {items[20]} it is", " ".join(items[3].split()[5:22])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, item_id string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert {(0, 0), (1, 1), (5, 2), (6, 20), (7, 3)} <= got and not any(i in (2, 3, 4) for i, _ in got)
    assert decontaminate.leaks(docs, bench.where("false")).count() == 0
    assert decontaminate.leaks(nothing, bench).count() == 0


def hit(mask, patterns, length):
    """Which of ``patterns`` (bits of equal words) have all words of ``mask`` equal somewhere."""
    m = sum(1 << i for i, c in enumerate(mask) if c == "1")
    return np.any([(patterns >> o) & m == m for o in range(length - len(mask) + 1)], axis=0)


def test_decontaminate_masks_lose_nothing():
    for n in range(1, 26):  # longer stretches have a part of 13 to 25 words that agrees enough
        wrong = itertools.combinations(range(n), n // 5)
        patterns = np.array([((1 << n) - 1) ^ sum(1 << i for i in c) for c in wrong])
        masks = decontaminate.MASKS if n >= decontaminate.LEAST else decontaminate.whole_masks(n)
        assert np.any([hit(m, patterns, n) for m in masks], axis=0).all(), n


def test_decontaminate_substituted(spark):
    def words(tag, n):
        return [f"{tag}{k}" for k in range(n)]

    lengths = [1, 2, 3, 4, 5, 7, 9, 10, 12, 13, 15, 20, 40]
    items = [words(f"i{n}x", n) for n in lengths]
    rows = []
    for k, item in enumerate(items):
        for start in range(5):  # every fifth word is another; in short items not more than may be
            changed = {i for i in range(start, len(item), 5)}
            changed = set(sorted(changed)[: len(item) // 5])
            text = words("before", 8) + [f"sub{i}" if i in changed else w for i, w in enumerate(item)] + words("after", 8)
            rows.append((10 * k + start, " ".join(text)))
    rows += [(1000 + k, " ".join([*item[:-1], "other"])) for k, item in enumerate(items) if len(item) < 5]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(10 * k + start, k) for k in range(len(items)) for start in range(5)}


def test_decontaminate_scripts_and_long_texts(spark):
    items = [("a", "今日は天気がとても良いので散歩に行きました"), ("b", "the old — and rather grey — mill stood by the river for two hundred years"), ("c", "go " * 20 + "stop")]
    texts = [(1, "彼は言った今日は天気がとても良いので散歩に行きました。"), (2, "See: the old and rather grey mill stood by the river for two hundred years!"), (3, "go " * 20_000), (4, "今日は雨")]
    bench, docs = spark.createDataFrame(items, "item_id string, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} == {(1, "a"), (2, "b"), (3, "c")}


def test_decontaminate_recall(spark):
    """Items laid into texts with up to a fifth of their words replaced, against a comparison at every place."""
    rng = random.Random(12)
    items = [[f"v{rng.randrange(3000)}" for _ in range(rng.randrange(13, 31))] for _ in range(24)]
    rows = []
    for k, item in enumerate(items):
        gone = set(rng.sample(range(len(item)), rng.randrange(len(item) // 5 + 1)))
        rows.append((k, " ".join([f"v{rng.randrange(3000)}" for _ in range(30)] + [f"s{i}" if i in gone else w for i, w in enumerate(item)] + [f"v{rng.randrange(3000)}" for _ in range(30)])))
    want = set()
    for i, text in rows:
        v = decontaminate.words_of(text)
        for k, item in enumerate(items):
            b = decontaminate.words_of(" ".join(item))
            if max(decontaminate.overlap(v, b, d)[0] for d in range(-len(b), len(v))) >= min(decontaminate.LEAST, len(b)):
                want.add((i, k))
    bench, docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} == want and len(want) >= 24


# ---- 4 and 9


def labelled_docs(spark, rng, good, bad, n):
    rows, labels = [], []
    for i in range(n):
        y = i % 3 == 0
        rows.append((i, (bad if y else good)(rng)))
        labels.append((i, int(y)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int")


def test_toxicity(spark, docs, nothing):
    rng = random.Random(3)
    train, labels = labelled_docs(spark, rng, lambda r: sentence(r, 40) + " women and muslims live here.", lambda r: sentence(r, 40) + r.choice([" stupid women are awful idiots.", " you worthless idiots"]), 300)
    rows = train.join(labels, "doc_id").withColumn("label", F.col("label").cast("double"))
    model = toxicity.fit(rows)
    held, truth = labelled_docs(spark, rng, lambda r: sentence(r, 40) + " black and gay men met.", lambda r: sentence(r, 40) + " worthless idiots, all of them.", 60)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(held, model).collect()}
    y = {r["doc_id"]: r["label"] for r in truth.collect()}
    assert np.mean([(got[i] >= 0.5) == y[i] for i in got]) > 0.95
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.scored(spark.createDataFrame([(0, f"{who} went home")], "doc_id long, text string"), model).collect()}[0] for who in ("women", "men"))
    assert abs(a - b) < 0.1
    assert all(len(toxicity.swapped(t)) == 1 for t in ("plain words here.", "Two. Sentences")) and not toxicity.swapped("123. !")
    free, tied = (toxicity.fit(rows, p) for p in (0.0, 5.0))

    def change(m):
        return sum(abs(np.subtract(*m.scores([a, b], {}))) for a, b in zip(toxicity._TERMS, map(toxicity._SWAP.get, toxicity._TERMS), strict=True))

    assert change(tied) < change(free)  # the penalty does something
    assert toxicity.scored(docs, model).where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.scored(docs, model).count() == docs.count() and toxicity.scored(nothing, model).count() == 0
    assert toxicity.fit(rows.where("false")).scores(["x"], {}) == [0.5]


def test_quality(spark, docs, nothing):
    rng = random.Random(4)
    train, labels = labelled_docs(spark, rng, lambda r: (sentence(r, 40) + ".\n") * 2, lambda r: " ".join("$$$ BUY!!! | 99" for _ in range(30)) + "\n" + sentence(r, 10), 300)
    rows = train.join(labels, "doc_id").select(F.col("doc_id").alias("id"), "text", (1 - F.col("label")).cast("double").alias("label"))
    model = quality.fit(rows, epochs=10)
    got = quality.scored(train, model).select("row.doc_id", "score").join(labels, "doc_id").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["label"] == 0) for r in got]) > 0.97
    assert quality.scored(docs, model).where("score is null or score < 0 or score > 1").count() == 0
    assert quality.scored(docs, model).count() == docs.count() and quality.scored(nothing, model).count() == 0
    assert quality.fit(rows.where("false")).scores([np.zeros((1, quality.WIDTH), np.float32)]).tolist() == [0.5]


# ---- 5


def page(host, k, inner):
    return (k, f"https://{host}/p{k}", f"<html><head><title>t</title></head><body><nav>Home</nav>{inner}<footer>end</footer><script>x</script></body></html>")


def test_html_with_markup(spark):
    inner = "<header>Site</header><article><h1>A &amp; B</h1><p>One  two\nthree<p>Four <b>five</b>&nbsp;six</article><aside>ad</aside><div class='comments'><p>first!</p></div>"
    pages = spark.createDataFrame([page("a.org", 1, inner), (2, None, None), (3, "x", ""), page("a.org", 1, inner)], "page_id long, url string, html string")
    got = [(r["page_id"], r["text"]) for r in html.main_text(pages).orderBy("page_id").collect()]
    one = "A & B\n\nOne two three\n\nFour five six"
    assert got == [(1, one), (1, one), (2, ""), (3, "")]
    assert html.main_text(pages.where("false")).count() == 0


def test_html_inside_articles(spark):
    inner = "<article><section class='related-work'><p>Others</p></section><div class='share-price'><p>12 euros</p></div><p>x <math><mi>y</mi></math></p><div class='comment-list'><p>nice</p></div></article>"
    comment = "<main><p>Body</p></main><section id='comments'><article class='comment'><p>first</p></article></section><article class='comment'><p>second</p></article>"
    pages = spark.createDataFrame([page("a.org", 1, inner), page("a.org", 2, comment), (3, "u", "<article><p>open " + "long text " * 200_000)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.main_text(pages).collect()}
    assert got[1] == "Others\n\n12 euros\n\nx y" and got[2] == "Body" and len(got[3]) == 5 + 10 * 200_000 - 1


def test_html_by_host(spark):
    rng = random.Random(6)
    notice = "<div>" + sentence(rng, 30) + "</div>"
    texts = [sentence(rng, 50) for _ in range(6)]
    pages = spark.createDataFrame([page("b.org", k, f"{notice}<div>{t}</div>") for k, t in enumerate(texts)] + [page("c.org", 9, notice)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.main_text(pages).collect()}
    assert [got[k] for k in range(6)] == [" ".join(t.split()) for t in texts]
    assert got[9]  # the same text on another host isn't boilerplate there


def test_html_keeps_what_one_page_repeats(spark):
    rng = random.Random(9)
    notice, line = sentence(rng, 30), sentence(rng, 25)
    own = [sentence(rng, 12) for _ in range(2)]
    other, copied = sentence(rng, 50), sentence(rng, 50)
    made = [page("b.org", 1, "".join(f"<div>{line} {x}</div>" for x in own) + f"<div>{notice}</div>"), page("b.org", 2, f"<div>{notice}</div><div>{other}</div>")]
    made += [page("b.org", k, f"<script>{k}</script><div>{copied}</div>") for k in (3, 4)]  # one page under two ids
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert got == {1: "\n\n".join(f"{line} {x}" for x in own), 2: other, 3: copied, 4: copied}


def test_html_repeats_decide_what_names_leave_in_doubt(spark):
    rng = random.Random(12)
    teaser, part = sentence(rng, 30), sentence(rng, 30)
    texts = [sentence(rng, 40) for _ in range(4)]
    inner = [f"<article><p>{t}</p><p>{part}</p><div class='related'><p>{teaser}</p></div><div class='notice'><p>{k} {t[::-1]}</p></div></article>" for k, t in enumerate(texts)]
    made = [(*page("b.org", k, x), "clash", "clash") for k, x in enumerate(inner)] + [(*page("c.org", 9, inner[0]), "clash", "clash")]
    pages = spark.createDataFrame(made, "page_id long, url string, html string, row_key string, text string")
    got = {r["page_id"]: r["text"] for r in html.main_text(pages).collect()}
    for k, t in enumerate(texts):  # the same paragraph outside doubt stays, though all have it
        assert got[k] == f"{t}\n\n{part}\n\n{k} {t[::-1]}"
    assert got[9] == f"{texts[0]}\n\n{part}\n\n{teaser}\n\n0 {texts[0][::-1]}"  # one page of its host
    found = html.repeated_windows(spark.createDataFrame([(bytes([k]) * 16, html._stream("b.org", [teaser, x], [True, True])) for k, x in enumerate(texts)], "row_key binary, text string"), html.kind())
    streams = [f"b.org\0{teaser}\n{x}".encode() for x in texts]
    windows = Counter(w for raw_ in streams for w in (raw_[i : i + html.LONG] for i in range(len(raw_) - html.LONG + 1)))
    for r in found.collect():  # the host's array against a count of all windows
        s = streams[r["row_key"][0]]
        starts = {lo + j for x in r["spans"] for lo in x["lo"] for j in range(x["n"])}
        assert starts == {i for i in range(len(s) - html.LONG + 1) if windows[s[i : i + html.LONG]] > 1}


def test_html_head_without_end():
    for start in ("<head>", "<head><meta charset=utf-8><script>'<div>'</script>", "<head><title>t</title>"):
        assert html.blocks_of(f"<html>{start}<body><article><p>One two</p></article></body></html>") == (["One two"], [False])
        assert html.blocks_of(f"{start}<article><p>One two</p></article>") == (["One two"], [False])
    assert html.blocks_of("<head><meta name=x>loose</head><body><p>One</p></body>") == (["One"], [True])


# ---- 6


def test_bpe(rows, docs, nothing):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    one = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((i, tuple(one.encode_ordinary(t or ""))) for i, t in rows)
    tokens = bpe.encode(docs)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in tokens.collect()) == want
    back = Counter((r["doc_id"], bytes(r["decoded"])) for r in bpe.decode(tokens).collect())
    assert back == Counter((i, raw(t)) for i, t in rows)
    assert bpe.encode(nothing).count() == 0


def test_row_keys(spark):
    made = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (None, "a"), (None, None), (1, ""), (2, "a")], "id long, text string")
    keys = [r["row_key"] for r in repeats.keyed(made, "id", "text").collect()]
    assert {len(k) for k in keys} == {16} and keys[0] == keys[1] and len(set(keys)) == 6
    assert len({k[:8] for k in keys}) == len({k[8:] for k in keys}) == 6


# ---- 8


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 1000, 70_000):
        for top in (3, 10**6, 2**63):
            x = np.sort(rng.integers(0, top, n, np.uint64))
            e = lm.EliasFano(lm.EliasFano.build(x))
            assert (e.get(np.arange(n)) == x).all()
            q = np.concatenate([x[:: max(1, n // 50)], rng.integers(0, top, 50, np.uint64)])
            at = e.find(q)
            assert ((at >= 0) == np.isin(q, x)).all() and (x[at[at >= 0]] == q[at >= 0]).all()
            a, b = n // 3, n - n // 4
            at = e.find(q, np.full(len(q), a), np.full(len(q), b))
            assert ((at >= 0) == np.isin(q, x[a:b])).all() and (x[at[at >= 0]] == q[at >= 0]).all()


@pytest.mark.parametrize(("shards", "size"), [("1", lm.SHARD_BYTES), ("4", lm.SHARD_BYTES), ("40", lm.SHARD_BYTES), ("1", 4000)])
def test_lm(spark, rows, docs, nothing, shards, size, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_BYTES", size)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        got = lm.scored(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).collect()
        assert lm.scored(nothing, F.lit(False)).count() == 0
        untrained = lm.scored(docs, F.lit(True)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    d, c, pairs, kinds = lm.DISCOUNT, Counter(), Counter(), Counter()
    tokens = [(i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, WORD.findall(ascii_lower(t))) for i, t in rows]
    for _, held, w in tokens:
        if not held:
            c.update([*w, None])
            pairs.update(zip(w, [*w[1:], None], strict=False))
    for v, _ in pairs:
        kinds[v] += 1
    n, known = sum(c.values()), len(c)

    def p(w):
        return (c[w] - d) / n if c[w] else d * known / n

    want = Counter()
    for i, held, w in tokens:
        score = np.log10(p(w[0] if w else None))
        for v, x in zip(w, [*w[1:], None], strict=False):
            score += np.log10((max(pairs[v, x] - d, 0) + d * kinds[v] * p(x)) / c[v] if c[v] else p(x))
        base = sum(np.log10((c[x] + 1) / (n + known + 1)) for x in [*w, None])
        want[i, held, len(w) + 1, sum(c[x] > 0 for x in [*w, None]), round(base, 6)] += 1
        close = [r for r in got if (r["doc_id"], r["n_tokens"]) == (i, len(w) + 1)]
        assert any(abs(r["score"] - score) < 0.02 * (len(w) + 1) for r in close)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == r["base_score"] for r in untrained)


# ---- 10


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 16))
    x[7] = x[8]
    data = [(i, [float(a) for a in v], 1) for i, v in enumerate(x)]
    odd = [(2000, None, 1), (2100, [0.0] * 16, 1), (2200, [None] * 16, 1), (2300, [float("nan")] * 16, 1), (2400, [], 1), (None, [1.0] * 16, 1)]
    frame = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, score int")
    got = neighbours.nearest(frame, frame.where("vec_id % 100 = 0")).collect()
    assert {r["query_id"] for r in got} == set(range(0, 1500, 100)) and len(got) == 150
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert np.allclose([r["score"] for r in mine], [d[r["vec_id"]] for r in mine], rtol=1e-12)
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 135
    assert neighbours.nearest(frame.where("false"), frame.where("false")).count() == 0
    assert neighbours.nearest(frame.where("vec_id < 4"), frame.where("vec_id = 0")).count() == 3
    twice = neighbours.nearest(frame.union(frame), frame.where("vec_id % 100 = 0").union(frame.where("vec_id = 0"))).collect()
    assert sorted(map(tuple, twice)) == sorted(map(tuple, got))


def test_neighbour_probes_lose_no_row():
    rng = np.random.default_rng(5)
    c = rng.integers(0, 2**64, 400, np.uint64)
    c[200:] = c[:200] ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 30), replace=False)) for _ in range(200)], np.uint64)
    index = neighbours.Index(np.arange(400), np.zeros((400, 1)), c, 64)
    for radius in (0, 2, 3, 9, 20, 33):
        assert sum(t + 1 for t in neighbours.thresholds(radius, neighbours.PARTS)) == radius + 1
        for q in c[:40]:
            assert index.within(q, radius).tolist() == np.flatnonzero(np.bitwise_count(c ^ q) <= radius).tolist()
