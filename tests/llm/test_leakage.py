import random
import time

import numpy as np
import pytest

from seine.llm.glyphs import look_alikes
from seine.llm.leakage import _filter_of, _Letters, _passing, hash_words, leaks, longest_overlaps, mask_for, normalised


def edit_within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def brute(item, doc, n):
    return any(edit_within_one(item[i : i + n], doc[j : j + k]) for i in range(len(item) - n + 1) for k in (n - 1, n, n + 1) for j in range(len(doc) - k + 1))


def found(items, docs, n):
    """Pairs of the comparison alone, over all items and documents."""
    pairs = [(i, d) for i in range(len(items)) for d in range(len(docs)) if len(items[i]) >= n]
    sizes = longest_overlaps([hashed(items[i]) for i, _ in pairs], [hashed(docs[d]) for _, d in pairs])
    return {p for p, k in zip(pairs, sizes) if k >= n}


def hashed(words):
    return hash_words([" ".join(words).encode()])[0]


@pytest.mark.parametrize("seed", range(8))
def test_random_against_brute_force(seed, spark):
    rng, n = random.Random(seed), 10
    vocabulary = [f"w{i}" for i in range(rng.choice([4, 12, 200]))]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(6, 30))] for _ in range(6)]
    docs = []
    for _ in range(60):
        item = rng.choice(items)
        i = rng.randrange(len(item))
        part = item[i : i + rng.randint(6, 14)]
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(part) + 1)
            part = rng.choice([part[:k] + part[k + 1 :], part[:k] + ["zz"] + part[k:], part[:k] + ["zz"] + part[k + 1 :]])
        docs.append([rng.choice(vocabulary) for _ in range(rng.randint(0, 6))] + part + [rng.choice(vocabulary) for _ in range(rng.randint(0, 6))])
    expected = {(a, b) for a, i in enumerate(items) for b, d in enumerate(docs) if brute(i, d, n)}
    assert found(items, docs, n) == expected
    if seed < 3:
        frames = [spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(xs)], "id bigint, text string") for xs in (docs, items)]
        for hot in (3, 1 << 30):
            rows = leaks(frames[0], "id", "text", frames[1], "id", "text", min_words=n, hot=hot, salts=3).collect()
            assert {(r["item_id"], r["doc_id"]) for r in rows} == expected and len(rows) == len(expected)


def test_each_place_of_the_edit():
    item = [f"a{i}" for i in range(18)]
    for k in range(18):
        for part in (item[:k] + item[k + 1 :], item[:k] + ["x"] + item[k + 1 :], item[:k] + ["x"] + item[k:]):
            assert found([item], [["b", "c", *part, "d"]], 18) == {(0, 0)}
    assert found([item], [item[:8] + ["x"] + item[9:13] + ["y"] + item[14:]], 18) == set()


def test_words(spark):
    letters = _Letters(look_alikes(spark))

    def words_of(text):
        return normalised(text, letters).split()

    plain = words_of("The Naïve re-read of v2/Get")
    for other in ("> the  NAÏVE\n> **re-read** (of) <b>v2</b>/Get.", "T\u200bhe nаïve re‑read of `v2/Get`", "// the naïve re－read of -- v2/get", "the naïve re\u00adread of v2/Get,"):
        assert words_of(other) == plain
    assert words_of("the naive reread of v2/Get") != plain
    assert words_of("--- *** ...") == [] and words_of("") == []
    for tag in ("<a href='" + "x" * 100 + "'>", '<a href="' + "x y/" * 10_000 + '" title=\'<\'>', "<p\n class=big\n hidden>", "<br/>", "</b >", "<x:y a.b='1'/>", "<img src=a/b?c=d&e>"):
        assert words_of(f"The Naïve re-{tag}read of v2/Get") == plain, tag
    # no tags: comparisons and unfinished ones
    assert words_of("if a <b, c and d> e") == [b"if", b"a", b"b", b"c", b"and", b"d", b"e"]
    assert words_of("<a href='" + "word " * 50) == [b"a", b"href" + b"word", *[b"word"] * 49]
    began = time.perf_counter()
    words_of("<a b=" * 200_000 + "<a " + "b " * 500_000)
    assert time.perf_counter() - began < 10


def test_hashes_of_words():
    h, owner = hash_words([b"a  bc\nd", b"", b" bc ", b"x" * 5_000])
    assert owner.tolist() == [0, 0, 0, 2, 3] and len(set(h.tolist())) == 4 and h[1] == h[3]
    assert len(hash_words([])[0]) == 0 and len(hash_words([b" ", b""])[0]) == 0


def test_repeated_words_are_no_burden():
    item, text = np.zeros(2_000, np.int64), np.zeros(8_000, np.int64)
    began = time.perf_counter()
    assert longest_overlaps([item], [text]).tolist() == [2_000]
    assert time.perf_counter() - began < 2


def test_operator_and_dirty_rows(spark):
    words = [f"word{i}" for i in range(60)]
    items = spark.createDataFrame([(1, "s", " ".join(words[:30])), (2, "s", " ".join(words[30:])), (3, "s", "too short"), (4, "s", None), (5, "s", "")], "item_id bigint, suite string, text string")
    docs = spark.createDataFrame(
        [(10, " ".join(words[5:23])), (11, " ".join(words)), (12, None), (13, ""), (14, "x " * 100_000 + " ".join(words[40:60]) + " y" * 10), (14, "x " * 100_000 + " ".join(words[40:60])), (15, " ".join(words[5:21]))],
        "doc_id bigint, item_id string",
    ).withColumnRenamed("item_id", "text")
    rows = leaks(docs, "doc_id", "text", items, "item_id", "text").collect()
    assert {tuple(r) for r in rows} == {(10, 1, 19), (11, 1, 30), (11, 2, 30), (14, 2, 21)} and len(rows) == 4


def test_filter_holds_every_seed(spark):
    seeds = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 3_000, dtype=np.int64)
    bloom = _filter_of(spark.createDataFrame([(int(s),) for s in seeds[:1_500]], "seed bigint"))
    held = _passing(seeds, bloom)
    assert set(range(1_500)) <= set(held.tolist()) and len(held) < 1_550


def test_markup_inside_a_passage(spark):
    words = [f"word{i}" for i in range(18)]
    items = spark.createDataFrame([(1, " ".join(words))], "id string, text string")
    tags = {"long": f'<a href="https://x.example/{"y" * 100}">', "longest": f"<a title='{'y ' * 5_000}'>", "lines": '<div\n  class="a"\n  id="b">'}
    docs = spark.createDataFrame([(k, " ".join(words[:9]) + f" {t} " + " ".join(words[9:])) for k, t in tags.items()], "id string, text string")
    assert {r["doc_id"] for r in leaks(docs, "id", "text", items, "id", "text").collect()} == set(tags)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id bigint, text string")
    some = spark.createDataFrame([(1, "a " * 30)], "id bigint, text string")
    assert leaks(none, "id", "text", some, "id", "text").count() == 0
    assert leaks(some, "id", "text", none, "id", "text").count() == 0


def test_mask():
    assert mask_for(18) == "111101111"
    with pytest.raises(ValueError):
        mask_for(5)
