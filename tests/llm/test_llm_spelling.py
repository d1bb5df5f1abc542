"""Spelling variants against all pairs."""

import collections
import random
import re
import zlib

import pytest

from marketday.llm import spelling
from marketday.llm.common import Scratch


def apart_by_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, factor=5):
    near = {w: [v for v in counts if apart_by_one(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        v = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = v if v is not None and counts[v] >= factor * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return collections.Counter((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())


def corpus(rows, least=5):
    seen = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda c: c[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= least}


def spelled(rng, n):
    return "".join(rng.choice("abeilnorst") for _ in range(n))


def family(rng, k):
    """Words and their variants: edits of edits, anagrams, one accented, one very long."""
    words = []
    for _ in range(k):
        w = spelled(rng, rng.randint(6, 11))
        words.append(w)
        for _ in range(3):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abeéz") + w[i:], w[:i] + rng.choice("abeßz") + w[i + 1 :]])
            words.append(w)
    words += ["".join(rng.sample("stainer", 7)) for _ in range(40)] + ["strainer", "ab" * 600, "ab" * 600 + "x", "x" * 70, "x" * 69 + "y", "y" * 70]
    return sorted({w for w in words if len(w) >= 6})


@pytest.mark.parametrize("seed", range(5))
def test_near_pairs(seed):
    words = family(random.Random(seed), 60)
    for length in sorted({len(w) for w in words}):
        stored = [w for w in words if len(w) == length]
        asking = [w for w in words if len(w) in (length, length - 1)]
        got = sorted(spelling.near_pairs(asking, stored))
        assert got == sorted((w, v) for w in asking for v in stored if apart_by_one(w, v))


def test_letters_unknown_to_the_cell():
    stored, asking = ["aaaaaa", "aaabaa"], ["aaazaa", "zaaaa", "aaaaa", "aazzaa", "aa漢aaa"]
    assert sorted(spelling.near_pairs(asking, stored)) == sorted((w, v) for w in asking for v in stored if apart_by_one(w, v))


@pytest.mark.parametrize("radius", [1, 2])
def test_boxes_lose_nothing(radius):
    rng = random.Random(radius)
    words = family(rng, 150)
    letters = spelling.alphabet_of(words)
    points = spelling.letter_counts(words, letters)
    tree = spelling.KdTree(points, 4)
    met = collections.Counter((int(p), int(q)) for leaf, rows in tree.near(points, radius) for p in tree.rows[leaf] for q in rows)
    assert max(met.values()) == 1
    assert {(p, q) for p in range(len(words)) for q in range(len(words)) if abs(points[p].astype(int) - points[q]).sum() <= radius} <= set(met)
    assert len(met) < len(words) ** 2 / 2
    assert [int(h) for h in tree.home(points[:20])] == [next(k for k, r in enumerate(tree.rows) if i in r) for i in range(20)]


@pytest.mark.parametrize("small", [False, True])
def test_variants(spark, monkeypatch, small):
    if small:  # many cells, cut from few words, and several blocks a cell
        for name, value in {"CELL": 6, "SAMPLE": 100, "CELLS_LEAST": 4, "BLOCK": 5, "ASKING": 7}.items():
            monkeypatch.setattr(spelling, name, value)
    rng = random.Random(5)
    counts = {w: 5 ** rng.randint(1, 6) + rng.randint(0, 3) for w in family(rng, 60)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    got = spelling.group_variants(words).collect()
    assert collections.Counter(map(tuple, got)) == brute(counts)
    assert any(r["root"] != r["form"] and r["form"] for r in got)


def test_cells_cut_from_few_words_hold_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SAMPLE", 40)
    monkeypatch.setattr(spelling, "CELL", 8)
    words = family(random.Random(8), 50)
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = collections.Counter((r["word"], r["near"]) for r in spelling.links(df, Scratch(spark, "links")).collect())
    assert got == collections.Counter((w, v) for w in words for v in words if apart_by_one(w, v))


def test_digest(spark):
    rng = random.Random(2)
    pool = family(rng, 25)
    rows = [(i, " ".join(rng.choices(pool, weights=range(1, len(pool) + 1), k=80)).title() + ", É\nÉcole ÉCOLE9écoles") for i in range(60)]
    rows += [(None, "without number " * 8), (1, None), (2, ""), (3, "a" * 300_000 + " " + "short " * 3)] + [(7, "Repeated repeatet repeated")] * 6
    docs = spark.createDataFrame([(i, t, "w", 1, "r") for i, t in rows], "doc_id bigint, text string, word string, n int, root string").repartition(3)
    assert collections.Counter(map(tuple, spelling.digest(docs).collect())) == brute(corpus(rows))
    assert spelling.digest(docs.limit(0)).collect() == []
