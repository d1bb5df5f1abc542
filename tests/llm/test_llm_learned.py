"""Operators that learn or search approximately: parts against brute force, results by held-out accuracy or recall."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from marketday.llm import neighbours, quality, toxicity

BIG = "/root/testdata/sf0.01"


def held_out(df, labels, column):
    truth = {r["doc_id"]: r[column] for r in labels.collect()}
    rows = df.collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    return [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]


# ---- the byte network --------------------------------------------------------------------------------


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(32, 120, n, dtype=np.uint8)) for n in (0, 3, 40, 700, 1500)]
    labels, weights = np.array([0, 1, 1, 0, 1], dtype=np.float32), np.array([1, 2, 1, 1, 0.5], dtype=np.float32)
    net = quality.fresh()
    net = quality.Net(*[a.astype(np.float64) for a in net.arrays()])

    def loss():
        blocks, chunk_at, text_at = quality.layout(texts)
        _, act = quality.activations(net, blocks, chunk_at, text_at)
        pool = np.maximum.reduceat(act, chunk_at, axis=0)
        n = np.diff(np.append(text_at, len(pool)))[:, None]
        z = np.hstack([np.add.reduceat(pool, text_at, axis=0) / n, np.maximum.reduceat(pool, text_at, axis=0), np.ones_like(n)]) @ net.out
        return float((weights * (np.log1p(np.exp(z)) - labels * z)).mean())

    for a, g in zip(net.arrays(), quality.gradients(net, texts, labels, weights)):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in a.shape)
            old, step = a[at], 1e-6
            a[at] = old + step
            up = loss()
            a[at] = old - step
            slope = (up - loss()) / (2 * step)
            a[at] = old
            assert g[at] == pytest.approx(slope, abs=2e-5, rel=2e-2)


def test_long_texts_score_like_whole_ones(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(32, 120, n, dtype=np.uint8)) for n in (0, 1, 511, 512, 513, 520, 521, 5000, 1024, 1032, 1033)]
    net = quality.fresh()
    whole = quality.logits(net, texts)
    monkeypatch.setattr(quality, "PIECE", 512)
    assert quality.logits(net, texts) == pytest.approx(whole, abs=1e-4)


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{n}.parquet") for n in ("documents", "labels"))
    pairs = held_out(quality.digest(docs, labels), labels, "quality")
    assert len(pairs) > 50 and np.mean([p == t for p, t in pairs]) > 0.85
    assert np.mean([p for p, t in pairs if t == 1]) > 0.95  # clean documents stay


def test_quality_of_odd_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(None, 1, 1), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == docs.count()
    by = collections.defaultdict(set)
    for r in out:
        by[r["text"] or ""].add(r["score"])
    assert all(max(v) - min(v) < 1e-6 for v in by.values())
    assert quality.digest(nothing, labels).collect() == []
    none = labels.limit(0)
    assert {r["score"] for r in quality.digest(docs, none).collect()} == {0.5}


# ---- disguised words ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def letters(spark):
    return toxicity.learn_letters(spark.read.parquet(f"{BIG}/documents.parquet"))


def test_letters_count_every_text(spark):
    texts = ["Ab  c", None, "", "é1!"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    rows = df.mapInArrow(toxicity._counted, "code bigint, n bigint").groupBy("code").sum("n").collect()
    want = collections.Counter()
    for t in texts:
        k = [0, 0, *[int(toxicity._TABLE[min(ord(c), 0x24F)]) for c in (t or "")], 0, 0]
        k = [c for i, c in enumerate(k) if i < 1 or (c, k[i - 1]) != (0, 0)]
        if any(k):
            want.update((a * 30 + b) * 30 + c for a, b, c in zip(k, k[1:], k[2:]))
    assert {r[0]: r[1] for r in rows} == dict(want)


@pytest.mark.parametrize("hidden,plain", [
    ("w0rthl3ss", "worthless"), ("i d i o t", "idiot"), ("loooooser", "loser"), ("m.o.r.o.n", "moron"), ("p@thet1c", "pathetic"), ("tr4sh", "trash"),
])
def test_restored(letters, hidden, plain):
    assert toxicity.restore(f"you are {hidden}, all", letters).startswith(f"you are {plain}")


@pytest.mark.parametrize("text", ["", "An ordinary text, with 12 numbers and 3.5 more!", "See you & me\nat 10:30", "el ó la y de"])
def test_plain_texts_stay(letters, text):
    assert toxicity.restored([text], letters) == [text]


@pytest.mark.parametrize("hidden,plain", [
    ("hat3", "hate"), ("di3", "die"), ("idio7", "idiot"), ("d i e", "die"), ("(i d i o t)", "(idiot)"), ('"i-d-i-o-t"', '"idiot"'),
])
def test_restored_at_the_ends_and_in_brackets(letters, hidden, plain):
    assert toxicity.restored(["x", f"so {hidden}, all", hidden], letters) == ["x", f"so {plain}, all", plain]


def test_signs_at_the_end_are_decoded_where_the_texts_know_the_word():
    counts = np.zeros(toxicity.CLASSES**3)
    for batch in toxicity._counted([pa.RecordBatch.from_arrays([pa.array(["an ass, a dumbass, a pass"] * 50)], names=["text"])]):
        counts[batch.column(0).to_numpy()] += batch.column(1).to_numpy()
    known = toxicity.Letters.of(counts)
    assert toxicity.restored(["a$$", "you dumba$$, all"], known) == ["ass", "you dumbass, all"]


@pytest.mark.parametrize("text", ["in 2023", "cost 5$", "It is 1 2 3 or 20$!", "Stop!! See 4.5"])
def test_plain_numbers_and_prices_stay(letters, text):
    assert toxicity.restore(text, letters) == toxicity.restored([text], letters)[0] == text


def test_suspects_miss_nothing_wider(letters):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab13$!. -\"(²“漢") for _ in range(rng.randrange(0, 12))) for _ in range(3000)]
    for plain, got in zip(texts, toxicity.restored(texts, letters)):
        assert got == toxicity.restore(plain, letters)


def brute_decode(piece, letters, spaced):
    """Every path of the lattice."""
    paths = [("", 0.0)]
    for options in toxicity.lattice(piece, spaced):
        paths = [(a + b, s - c) for a, s in paths for b, c in options]

    def score(text, s):
        k = [0, 0, *[toxicity._class(c) for c in text], 0]
        return s + sum(letters.logp[a, b, c] for a, b, c in zip(k, k[1:], k[2:]))

    return max(score(t, s) for t, s in paths), {t: score(t, s) for t, s in paths}


@pytest.mark.parametrize("piece,spaced", [("1d10t", False), ("a$$3ts", False), ("l o s e r", True), ("nooo1oo", False)])
def test_viterbi_finds_the_best_path(letters, piece, spaced):
    best, each = brute_decode(piece, letters, spaced)
    assert each[toxicity.decode(piece, letters, spaced)] == pytest.approx(best)


def test_suspects_miss_nothing(letters):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc10@$! .é") for _ in range(rng.randrange(0, 30))) for _ in range(400)]
    for plain, got in zip(texts, toxicity.restored(texts, letters)):
        assert got == toxicity.restore(plain, letters)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{n}.parquet") for n in ("documents", "labels"))
    pairs = held_out(toxicity.digest(docs, labels), labels, "toxic")
    assert len(pairs) > 50 and np.mean([p == t for p, t in pairs]) > 0.92
    assert not [1 for p, t in pairs if p and not t]


def test_toxicity_of_odd_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(None, 1, 1), (3, 0, None)], "doc_id bigint, quality int, toxic int")
    out = toxicity.score(docs, labels)
    assert {"restored", "lang", "n"} <= set(out.columns) and out.count() == docs.count()
    assert toxicity.digest(nothing, labels).collect() == []
    assert len({r["score"] for r in toxicity.digest(docs, labels.limit(0)).collect()}) == 1


# ---- neighbours --------------------------------------------------------------------------------------


def brute_search(rows, every, k):
    out = {}
    for q, a in rows.items():
        if q % every == 0:
            score = lambda v: float((np.array(v) * np.array(a)).sum() / (math.sqrt((np.array(v) ** 2).sum()) * math.sqrt((np.array(a) ** 2).sum())))
            out[q] = sorted(((-score(v), i) for i, v in rows.items() if i != q and len(v) == len(a)))[:k]
    return out


def test_recall(spark):
    df = spark.read.parquet(f"{BIG}/embeddings.parquet")
    rows = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in df.collect()}
    want = brute_search(rows, 50, 5)
    got = collections.defaultdict(list)
    for r in sorted(neighbours.digest(df).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    found = [len({i for i, _ in got[q]} & {i for _, i in w}) / 5 for q, w in want.items()]
    assert np.mean(found) >= 0.9
    for q, each in got.items():
        assert [s for _, s in each] == sorted((s for _, s in each), reverse=True)
        assert all(neighbours.cosines(np.array(rows[q]), np.array([rows[i]]))[0] == s for i, s in each)


def test_equal_zero_and_broken_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = random.Random(2)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(60)]  # one very common vector
    rows += [(100 + i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(40)]
    odd = [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 2.0]), (203, [float("nan"), 1.0, 1.0]), (204, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (205, []), (206, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in [*rows, rows[0], rows[0], *odd]], "vec_id bigint, embedding array<float>, label int, score string")
    plain = {i: [float(np.float32(x)) for x in v] for i, v in rows}
    got = collections.defaultdict(list)
    for r in sorted(neighbours.search(df, 10).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r["vec_id"])
    assert set(got) <= {q for q in plain if q % 10 == 0}
    assert got[0] == [1, 2, 3, 4, 5] and got[10] == [0, 1, 2, 3, 4]
    want = brute_search(plain, 10, 5)
    assert np.mean([len(set(got[q]) & {i for _, i in w}) / 5 for q, w in want.items()]) >= 0.9
    assert neighbours.search(df.limit(0), 10).collect() == []


def test_isolated_vectors_among_tight_groups(spark):
    rng = np.random.default_rng(8)
    vectors = np.vstack([np.repeat(rng.normal(size=(20, 48)), 140, axis=0) + 1e-4 * rng.normal(size=(2800, 48)), rng.normal(size=(200, 48))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    got = collections.defaultdict(set)
    for r in neighbours.search(df, 10).collect():
        got[r["query_id"]].add(r["score"])
    recall = []
    for q in range(2800, 3000, 10):
        best = np.sort(np.delete(neighbours.cosines(vectors[q], vectors), q))[-5]
        recall.append(sum(s >= best - 1e-12 for s in got[q]) / 5)
    assert np.mean(recall) >= 0.85


def test_probes_come_in_falling_order():
    place = np.array([0.1, 0.5, 0.9, 0.3])
    steps = neighbours.probes(place, 1.0)
    edges = (np.array([-1.0, 0.0, 1.0, 2.0])[None] - place[:, None]) * neighbours.WIDTH
    chance = np.diff(neighbours._normal(edges), axis=1)
    value = [math.prod(chance[i, s + 1] for i, s in enumerate(step)) for step in steps]
    assert value == sorted(value, reverse=True) and len(set(steps)) == len(steps) and sum(value) >= neighbours.REACH
