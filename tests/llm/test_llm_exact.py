"""Operators with one right answer, against brute force."""

import collections
import hashlib
import random
import re
import string
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketday.llm import decontamination, jaccard, line_dedup, packing, repeats, sharding, token_files, tokens

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def as_rows(df):
    return collections.Counter(map(tuple, df.collect()))


# ---- repeated passages -------------------------------------------------------------------------------


def brute_repeats(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + window] for t in raw for i in range(len(t) - window + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("window,group", [(400, repeats.GROUP), (64, repeats.GROUP), (64, 2)])
def test_repeats(docs, rows, window, group):
    out = repeats.remove_repeats(docs, window, group)
    assert out.columns[:2] == ["doc_id", "lang"] and {"r1", "n", "label"} <= set(out.columns)
    got = as_rows(out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
    assert got == collections.Counter((i, *b) for (i, _), b in zip(rows, brute_repeats([t for _, t in rows], window)))
    one = out.where("n_spans > 0").first()
    assert hashlib.sha256(bytes(one["kept"])).hexdigest() == one["kept_sha256"]
    assert sum(s["stop"] - s["start"] for s in one["spans"]) == one["n_removed"]


def test_repeats_of_nothing(nothing):
    assert repeats.digest(nothing).collect() == []


def test_a_context_of_many_texts_is_marked_where_it_was_read(spark):
    """One context is found in half of all places; none of them may be brought to one task."""
    rng = random.Random(4)
    hot = [(i, 0, 7, 400, 1, 5, 5) for i in range(4000)]
    pairs = [(i, 1, 9, 410, 2, 6 + i // 2, 6) for i in range(3000)]
    alone = [(i, 2, 0, 400, 3, -1 - i, 8) for i in range(1000)]
    rows = rng.sample(hot + pairs + alone, 8000)
    df = spark.createDataFrame(rows, repeats.FOUND).repartition(8)
    counted = df.groupBy("a", "d").agg(F.count("*").alias("c"))
    found = repeats._alike(df, counted)
    assert as_rows(found) == collections.Counter((r1, r2, lo, lo + n) for r1, r2, lo, n, *_ in hot + pairs)
    sizes = found.where("r2 = 0").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(s["count"] for s in sizes) < 1000
    assert repeats._alike(df.limit(0), counted.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(12))
def test_run_index(seed):
    rng = random.Random(seed)
    letters = b"ab" if seed % 2 else b"abcdefgh\0\xff"
    entries = [bytes(rng.choice(letters) for _ in range(rng.randrange(1, 120))) for _ in range(rng.randrange(1, 12))]
    entries.append(entries[0][:40] + b"zz" + entries[-1][5:60])
    for window in (3, 8, 15, 30):
        seen = collections.Counter(e[i : i + window] for e in entries for i in range(len(e) - window + 1))
        want = {(k, i) for k, e in enumerate(entries) for i in range(len(e) - window + 1) if seen[e[i : i + window]] > 1}
        assert {(k, i) for k, a, b in repeats.repeated(entries, window) for i in range(a, b + 1)} == want


def test_run_index_is_compressed():
    index = repeats.RunIndex(np.frombuffer(b"abracadabra" * 50, dtype=np.uint8).astype(np.int64) + 1)
    assert index.lengths.sum() == 550 and len(index.letters) < 40


def test_long_texts_are_taken_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 300)
    rng = random.Random(1)
    t = bytes(rng.choice(b"abcd") for _ in range(2000))
    parts = [p for g in repeats._parts([t, b"x", t[:500]], 64) for p in g]
    windows = [(i, k + j) for i, k, p in parts for j in range(len(p) - 63)]
    assert sorted(windows) == [(0, j) for j in range(1937)] + [(2, j) for j in range(437)]


# ---- lines -------------------------------------------------------------------------------------------


def test_line_dedup(docs, rows):
    out = line_dedup.line_dedup(docs, min_docs=10)
    assert {"lang", "score", "n"} <= set(out.columns)
    held = collections.defaultdict(set)
    strip = " \t\n\x0b\x0c\r"
    for n, (i, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            held[line.strip(strip).translate(FOLD)].add(i if i is not None else ("own", t or ""))
    want = collections.Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (x.strip(strip) and len(held[x.strip(strip).translate(FOLD)]) >= 10)]
        want[i, len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    assert as_rows(out.select("doc_id", "n_lines", "n_dropped", "kept")) == want
    assert any(k[2] for k in want)


def test_line_dedup_of_nothing(nothing):
    assert line_dedup.digest(nothing).collect() == []


def test_line_dedup_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    df = line_dedup.digest(docs)
    assert as_rows(df) == collections.Counter(con.execute(line_dedup.SQL).fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# ---- shards ------------------------------------------------------------------------------------------


def test_sharding(docs, rows):
    out = sharding.shard(docs, 4).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in out) == collections.Counter(rows)
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in out)
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
    largest = max(r["size"] for r in out)
    total = sum(r["size"] for r in out)
    assert all(abs(sum(r["size"] for r in v) - total / 4) <= 0.002 * total + largest for v in by.values())
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())


def test_a_hot_group_is_split_and_the_rest_lies_together(spark):
    rows = [(i, "hot") for i in range(3000)] + [(3000 + i, f"t{i % 500}") for i in range(1500)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), 8).collect()
    sizes = collections.Counter()
    shards = collections.defaultdict(set)
    for r in out:
        sizes[r["shard"]] += r["size"]
        shards[r["text"]].add(r["shard"])
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 10
    assert len(shards["hot"]) >= 5 and sum(len(s) > 1 for t, s in shards.items() if t != "hot") <= 7


def test_a_row_that_repeats_is_dealt_over_shards(spark):
    """One row makes a third of the table: its copies differ in nothing but where they stand."""
    rows = [(i, f"text {i}") for i in range(4000)] + [(1, "one row again and again")] * 2000
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    out = sharding.shard(df, 16).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in out) == collections.Counter(rows)
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in out:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    share = sum(sizes.values()) / 16
    assert len(sizes) == 16 and all(abs(n - share) <= 30 for n in sizes.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    short = sharding.digest(df).collect()
    assert collections.Counter(r["shard"] for r in short).keys() == sizes.keys() and len(short) == 6000


def test_sharding_of_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "long " * 600_000), (2, "a"), (3, None)], "doc_id bigint, text string")
    out = {r["doc_id"]: r["size"] for r in sharding.digest(df).collect()}
    assert out == {1: 3_000_001, 2: 2, 3: 1}


def test_sharding_nothing_and_one_row(spark, nothing):
    assert sharding.digest(nothing).collect() == []
    one = sharding.digest(spark.createDataFrame([(None, None)], "doc_id bigint, text string")).first()
    assert (one["size"], one["slot"], one["law"], one["grown_shard"]) == (1, 0, "bytes", None)


# ---- tokens ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def test_encoder_is_the_tokenizer(tokenizer):
    rng = random.Random(3)
    letters = list("abzAZ09'’stREvelmd .,!?%-_\t\n\r\x0b\x85\xa0éÉñßÿÀ×÷ªµºİıΣςσ́̈e 　漢字🙂\x00\x7f​﻿ſK")
    enc = tokens.Encoder(tokens.default_path())
    for _ in range(60):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(20)]
        ids, bounds = enc.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_known_pieces_cost_less_than_scalars_of_them():
    import time

    def taken(run):
        start = time.process_time()
        run()
        return time.process_time() - start

    enc = tokens.Encoder(tokens.default_path())
    pieces = [f"w{i}" for i in range(150_000)]
    texts, distinct = pa.array([" ".join(pieces)]), pa.array(pieces)
    enc.encode(texts)
    scalars = min(taken(distinct.to_pylist) for _ in range(3))
    assert min(taken(lambda: enc.encode(texts)) for _ in range(3)) < scalars


def test_added_tokens_inside_texts(spark, tokenizer):
    texts = ["x<|startoftext|>y", "<|endoftext|>", "<|ENDOFTEXT|>", "don't<|endoftext|>'s", "a <|endoftext|> b\n<|startoftext|>é", "<|endoftext|", "<|endoftext|>漢<|endoftext|>"]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    ids, bounds = tokens.Encoder(tokens.default_path()).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want and want[1] == [49407]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_files.digest(df).collect()}
    assert got == {i: (len(x) + 1, zlib.crc32(np.array([*x, 2], dtype="<u4").tobytes())) for i, x in enumerate(want)}


@pytest.mark.parametrize("n", [0, 1, 3, 4, 1000])
def test_code_round_trip(n):
    rng = np.random.default_rng(n)
    ranks = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
    control, data = token_files.encode(ranks)
    assert len(control) == -(-n // 4) and (token_files.decode(control, data, n) == ranks).all()


def test_token_files(spark, docs, rows, tokenizer, tmp_path):
    token_files.write(docs, str(tmp_path / "t"))
    got = sorted(token_files.read(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    ids = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows]
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in got) == collections.Counter((i, tuple(x)) for i, x in ids)
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert order == sorted(order)
    start = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (start, len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        start += r["n_tokens"]
    counts = collections.Counter(x for _, each in ids for x in each)
    ranked = [r["id"] for r in spark.read.parquet(str(tmp_path / "t/ids")).orderBy("rank").collect()]
    assert ranked == sorted(counts, key=lambda x: (-counts[x], x))


def test_token_files_of_nothing(nothing):
    assert token_files.digest(nothing).collect() == []


# ---- packing -----------------------------------------------------------------------------------------


def checked(placed, capacity):
    """How many sequences; places are gapless."""
    by = collections.defaultdict(list)
    for seq, offset, length in placed:
        by[seq].append((offset, length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = 128
    draw = [
        lambda: rng.randint(1, 128), lambda: rng.choice([43, 64, 65, 86]), lambda: rng.randint(40, 70), lambda: 128,
        lambda: min(128, int(rng.expovariate(1 / 30)) + 1), lambda: rng.randint(1, 15),
    ][seed]
    lengths = [draw() for _ in range(2000)]
    counts = collections.Counter(lengths)
    steps = packing.plan(counts, capacity, 64)
    used = collections.Counter()
    placed = []
    for length, first, n, seq, offset in sorted(steps):
        assert first == used[length]
        used[length] += n
        placed += [(seq + k, offset, length) for k in range(n)]
    assert used == counts
    bins = []  # first fit decreasing
    for x in sorted(lengths, reverse=True):
        for k, free in enumerate(bins):
            if free >= x:
                bins[k] -= x
                break
        else:
            bins.append(capacity - x)
    assert checked(placed, capacity) <= 1.01 * len(bins) + 2


def test_packing(docs, rows, tokenizer):
    out = packing.pack(docs, 256).collect()
    pieces = collections.Counter()
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        pieces.update((i, k, s, tuple(ids[s : s + 256])) for k, s in enumerate(range(0, len(ids), 256)))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in out) == pieces
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) and r["length"] == len(r["ids"]) for r in out)
    n = checked([(r["sequence_id"], r["offset"], r["length"]) for r in out], 256)
    assert n <= 1.05 * sum(r["length"] for r in out) / 256 + 2


def test_packing_nothing(nothing):
    assert packing.digest(nothing).collect() == []


# ---- near copies -------------------------------------------------------------------------------------


def brute_join(rows, k, percent):
    """[(doc_id, n_shingles, component_id)], rows as documents."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return collections.Counter((i, len(sets[a]), least.get(find(a)) if sets[a] else i) for a, (i, _) in enumerate(rows))


@pytest.mark.parametrize("k,percent,region", [(3, 90, 4096), (5, 80, 4096), (5, 80, 4), (1, 50, 4)])
def test_jaccard_join(docs, rows, monkeypatch, k, percent, region):
    monkeypatch.setattr(jaccard, "REGION", region)
    monkeypatch.setattr(jaccard, "PIVOTS", 16 if region > 4 else 2)
    monkeypatch.setattr(jaccard, "SMALL", 8 if region > 4 else 2)
    got = as_rows(jaccard.join(docs, k, percent).select("doc_id", "n_shingles", "component_id"))
    assert got == brute_join(rows, k, percent)


def test_only_members_with_a_partner_of_fitting_size_go_on(spark):
    rng = random.Random(8)
    rows = [(r, i, rng.choice([1, 9, 10, rng.randint(1, 400)])) for i, r in enumerate(rng.choices(range(40), k=160))]
    got = {r["c"] for r in jaccard._with_partner(spark.createDataFrame(rows, "region long, c long, n long"), 90).collect()}
    assert got == {i for r, i, n in rows if any(r == s and i != j and 100 * min(n, m) >= 90 * max(n, m) for s, j, m in rows)}
    assert len(got) < len(rows)


@pytest.mark.parametrize("part", [7, 1_000_000])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_word_hashes(monkeypatch, part, kind):
    monkeypatch.setattr(jaccard, "PART", part)
    texts = ["left out", "", " a  b\tA\n", "x", "Éa éA b \u2003", "  ", "ab" * 300 + " BA", "\x0bb\x0cc\rd a\x00b", "a", ""]
    hashes, bounds = jaccard.word_hashes(pa.array(texts, kind)[1:])
    words = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(FOLD)) for t in texts[1:]]
    assert np.diff(bounds).tolist() == [len(w) for w in words]
    met = dict(zip([w for of in words for w in of], hashes.tolist(), strict=True))
    assert [met[w] for of in words for w in of] == hashes.tolist() and len(set(met.values())) == len(met)
    assert [len(x) for x in jaccard.word_hashes(pa.array([], kind))] == [0, 1]


def test_rare_words_lead_the_order_where_counters_are_full(monkeypatch):
    monkeypatch.setattr(jaccard, "SLOTS", 10)  # over ten shingles a slot
    monkeypatch.setattr(jaccard, "WORDS", 12)
    monkeypatch.setattr(jaccard, "CHUNK", 1 << 9)
    rng = random.Random(3)
    texts = [" ".join([*rng.choices("the of and to in is it as at on".split(), k=15), f"name{i}", *rng.choices("the of and to in is it as at on".split(), k=15)]) for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    (levels,) = jaccard._levels([*jaccard._counted(3)([batch]), *jaccard._counted(3)([batch])])
    by_chunk = dict(zip(*(c.to_pylist() for c in levels.columns), strict=True))
    level = np.frombuffer(b"".join(by_chunk[c] for c in sorted(by_chunk)), dtype=np.uint8)
    assert len(level) == (1 << 10) + (1 << 12)
    out = [b.to_pydict() for b in jaccard._prefixes(3, 90, level[: 1 << 10], level[1 << 10 :])([batch])]
    posted = [s for b in out for p in b["prefix"] for s in p]
    assert len(posted) == len(set(posted)) >= 1200  # no two documents share what they are looked up by


def test_jaccard_join_of_nothing(nothing):
    assert jaccard.digest(nothing).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_sets_in_one_place(seed):
    rng = random.Random(seed)
    base = [rng.sample(range(200), 40) for _ in range(4)]
    sets = []
    for _ in range(60):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randint(0, 400))
        sets.append(np.array(sorted(s), dtype=np.int64))
    apart = [np.setxor1d(s, sets[seed]) for s in sets]
    found = jaccard.Linked(apart, [len(s) for s in sets], list(range(60)), 80).links()
    want = brute_join([(i, " ".join(map(str, s))) for i, s in enumerate(sets)], 1, 80)
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        inter = len(set(sets[a]) & set(sets[b]))
        assert 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter)
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert collections.Counter((i, len(s), find(i)) for i, s in enumerate(sets)) == want


@pytest.mark.parametrize("n", [40, 512, 513, 600, 1025, 1200, 5000])
@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_meet_at_a_sketch_level(n, percent):
    rng = np.random.default_rng(n + percent)
    for _ in range(20):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        keep = int(np.ceil(percent * n / 100))
        y = x[:keep] if rng.random() < 0.5 else np.concatenate([x, rng.integers(0, 1 << 63, n * 100 // percent - n, dtype=np.uint64)])
        a, b = ({s["level"]: np.frombuffer(s["sketch"], dtype=np.uint8).astype(int) for s in jaccard._sketches(v, percent)} for v in (x, y))
        assert a.keys() & b.keys()
        for level in a.keys() & b.keys():
            assert np.abs(a[level] - b[level]).sum() <= len(x) + len(y) - 2 * min(len(x), len(y))
            assert len(x) + len(y) - 2 * min(len(x), len(y)) <= jaccard._allowed(percent, len(x), len(y))


# ---- benchmark passages ------------------------------------------------------------------------------


def plain_words(t):
    out = []
    spaced = re.sub("([\u0e00-\u0eff\u3040-\u30ff\u4e00-\u9fff])", r" \1 ", (t or "").lower())
    for w in re.findall(r"[^ \t\n\x0b\x0c\r]+", spaced):
        while w and not w[0].isalnum():
            w = w[1:]
        while w and not w[-1].isalnum():
            w = w[:-1]
        if w:
            out.append(w)
    return out


def overlaps(text, item):
    t, b = plain_words(text), plain_words(item)
    need = min(20, len(b))
    if not b:
        return False
    at = collections.defaultdict(list)
    for i, w in enumerate(b):
        at[w].append(i)
    shifts = collections.Counter(j - i for j, w in enumerate(t) for i in at.get(w, ()))
    for shift in [s for s, n in shifts.items() if n >= 0.8 * need]:
        same = [0 <= i + shift < len(t) and t[i + shift] == b[i] for i in range(len(b))]
        inside = [0 <= i + shift < len(t) for i in range(len(b))]
        for i in range(len(b) - need + 1):
            if all(inside[i : i + need]) and sum(same[i : i + need]) >= 0.8 * need:
                return True
    return False


def test_decontamination(spark, docs, rows):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    items = [fresh(n) for n in (40, 25, 12, 8, 6, 3, 60)]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(7, " ".join(items[0])), (8, None), (9, ""), (None, "no id at all in this item")]
    marked = list(rows)
    for n, w in enumerate(items):
        marked.append((500 + n, " ".join([*fresh(30), *w, *fresh(9)])))
        noisy = [("x" if i % 9 == 4 else v) for i, v in enumerate(w)]
        marked.append((600 + n, " ".join([*fresh(4), *noisy, *fresh(50)])))
        marked.append((700 + n, (" ".join([*fresh(3), *w[: len(w) // 2]])).upper()))
    extra = [(i, t, "en", "s", 1, "a", "b", "c", 2, "d", 7) for i, t in marked]
    df = spark.createDataFrame(extra, docs.schema)
    benchmark = spark.createDataFrame(bench, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.digest(df, benchmark).collect()}
    want = {(i, b) for i, t in marked for b, item in bench if b is not None and b != 7 and overlaps(t, item)}
    assert got == want and {500, 501, 502, 600} <= {i for i, _ in got}
    kept = decontamination.decontaminate(df, benchmark)
    assert kept.columns == docs.columns
    bad = {i for i, _ in want}
    assert as_rows(kept.select("doc_id", "text")) == collections.Counter((i, t) for i, t in marked if i not in bad)


def test_short_items_and_scripts_without_spaces(spark):
    """Against brute force: one to four words, characters of Thai, Japanese and Chinese, mixed pieces, a frequent word, a very long text."""
    rng = random.Random(8)
    han = "".join(chr(0x4E00 + rng.randint(0, 900)) for _ in range(60))
    thai = "ภาษาไทยไม่มีการเว้นวรรคระหว่างคำในประโยคเดียวกันเสมอไป"
    kana = "ひらがなとカタカナで書かれた短い文です"
    items = ["rare", "two words", "a b c", "four of them here", "漢字", han, thai, kana, "GPT漢字test 12", "the", "!!", "…", han[:30]]
    bench = list(enumerate(items))
    noisy = "".join("猫" if i % 7 == 3 else c for i, c in enumerate(han))
    wrong = "".join("猫" if i % 3 == 1 else c for i, c in enumerate(han))
    docs = [
        "a rare thing", "RARE!", "rarely", "two  words", "two other words", "words two", "x a b c", "a b x c", "four of\nthem, here.", "four of them",
        f"前{han}後", noisy, wrong, han[10:32], han[10:28], f"x {thai} y", thai[:20], kana, "字漢", "漢 字", "gpt漢字test 12 x", "gpt漢字 12",
        "the " * 3000, "one the two the", "", None, "...", " ".join(f"w{i}" for i in range(200_000)) + " rare",
    ]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(3)
    rows = decontamination.digest(df, spark.createDataFrame(bench, "item_id bigint, text string")).collect()
    want = {(i, b) for i, t in enumerate(docs) for b, item in bench if overlaps(t, item)}
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want)
    assert {(0, 0), (1, 0), (3, 1), (8, 3), (10, 5), (11, 5), (13, 5), (15, 6), (17, 7), (19, 4), (27, 0)} <= want and (14, 5) not in want and (12, 5) not in want
    whole = {(r["doc_id"], r["item_id"]): (r["doc_word"], r["item_word"], r["n_words"], r["n_equal"]) for r in rows}
    assert whole[22, 9] == (0, 0, 1, 1) and whole[23, 9] == (1, 0, 1, 1) and whole[6, 2] == (1, 0, 3, 3) and whole[27, 0] == (200_000, 0, 1, 1)


def test_decontamination_of_nothing(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.digest(docs, none).collect() == []
    assert decontamination.digest(nothing, none).collect() == []
    assert decontamination.decontaminate(docs, none).count() == docs.count()
