"""Spelling variants: words one edit apart, found by k-d trees over letter counts, and the common form each one stands for.

One insertion or deletion changes one letter count by one, one replacement changes two: words one edit apart are at L1
distance one or two.  A tree for each word length cuts the words into cells; a word looks into the cells within two of it
in the tree of its own length and within one in that of the next, and its letters are compared only with words whose
counts fit exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketday.llm import sqlparts
from marketday.llm.common import LOWER, UPPER, Scratch

LETTERS = "A-Za-zÀ-ÿ"
SAMPLE = 65_536  # words, by smallest hash, from which the cells are cut; every word is indexed
CUT_LENGTH = 64  # longer words are one cell for each length, dealt in blocks
CELL = 8_192  # words meant for a cell
CELLS_LEAST = 8  # sampled words of a cell, at least: so there are at most SAMPLE / 8 cells
BLOCK = 16_384  # words of a cell in one task
ASKING = 65_536  # words that look into a cell in one task
LEAF = 16  # words of a local leaf


def corpus_words(docs: DataFrame, min_chars: int = 6, min_count: int = 5, altered=None) -> DataFrame:
    """(word, n): letter runs of the whole texts, A-Z in lower case, with at least that many code points and occurrences.

    ``altered`` (run) -> Column may change a run before it is counted, never making it longer.  A null text has no runs.
    Counting combines on the map side, so a frequent word is not sent row by row.
    """
    fold = F.translate("text", UPPER, LOWER)
    runs = docs.where("text IS NOT NULL").select("doc_id", F.explode(F.split(fold, f"[^{LETTERS}]+")).alias("run")).where(F.length("run") >= min_chars)
    word = altered(F.col("run")) if altered else F.col("run")
    return runs.select(word.alias("word")).where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def letter_counts(words, alphabet: np.ndarray) -> np.ndarray:
    """How often each word holds each code point of the sorted ``alphabet``; the last column counts all others."""
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.searchsorted(alphabet, codes)
    at[(at == len(alphabet)) | (alphabet[np.minimum(at, len(alphabet) - 1)] != codes)] = len(alphabet)
    flat = np.repeat(np.arange(len(words)), lens) * (len(alphabet) + 1) + at
    out = np.bincount(flat, minlength=len(words) * (len(alphabet) + 1))
    return np.minimum(out, 30_000).astype(np.int16).reshape(len(words), -1)


def alphabet_of(words) -> np.ndarray:
    return np.unique(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32))


class KdTree:
    """Nested splits (column, at, low side, high side); a leaf is ("leaf", its number).  ``rows[leaf]``: the points there."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.rows: list[np.ndarray] = []
        self.root = self._cut(points, np.arange(len(points)), max(1, leaf))

    def _cut(self, points, rows, leaf):
        best = None
        if len(rows) > leaf:
            mine = points[rows]
            half = len(rows) / 2
            low, high = mine.min(0), mine.max(0)
            for col in np.flatnonzero(high > low):
                tally = np.bincount(mine[:, col]).cumsum()
                at = int(np.argmin(np.abs(tally[:-1] - half))) + 1  # points below ``at`` go to the low side
                if 0 < tally[at - 1] < len(rows) and (best is None or abs(tally[at - 1] - half) < best[0]):
                    best = (abs(tally[at - 1] - half), int(col), at)
        if best is None:
            self.rows.append(rows)
            return ("leaf", len(self.rows) - 1)
        _, col, at = best
        low = points[rows, col] < at
        return (col, at, self._cut(points, rows[low], leaf), self._cut(points, rows[~low], leaf))

    def home(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), dtype=np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node[0] == "leaf":
                out[rows] = node[1]
            else:
                low = points[rows, node[0]] < node[1]
                todo += [(node[2], rows[low]), (node[3], rows[~low])]
        return out

    def near(self, points: np.ndarray, radius: int):
        """(leaf, rows of ``points`` whose L1 distance to the leaf's box is at most ``radius``), boxes pruned on the way."""
        todo = [(self.root, np.arange(len(points)), np.zeros(len(points), dtype=np.int32), {})]
        while todo:
            node, rows, gone, box = todo.pop()
            if node[0] == "leaf":
                yield node[1], rows
                continue
            col, at, *sides = node
            value = points[rows, col].astype(np.int32)
            low, high = box.get(col, (0, 1 << 20))
            before = np.maximum(0, np.maximum(low - value, value - high))
            for side, (a, b) in zip(sides, ((low, at - 1), (at, high)), strict=True):
                gap = gone - before + np.maximum(0, np.maximum(a - value, value - b))
                keep = gap <= radius
                if keep.any():
                    todo.append((side, rows[keep], gap[keep], {**box, col: (a, b)}))


def _edits(asking: list[str], longer: bool, extra: str, missing: str, there: set[str]):
    """(word, near word in ``there``): ``missing`` of the word is replaced by ``extra``, or ``extra`` is inserted."""
    for w in asking:
        if longer:
            for v in {w[:i] + extra + w[i:] for i in range(len(w) + 1)}:
                if v in there:
                    yield w, v
        else:
            i = w.find(missing)
            while i >= 0:
                v = w[:i] + extra + w[i + 1 :]
                if v in there:
                    yield w, v
                i = w.find(missing, i + 1)


def near_pairs(asking: list[str], stored: list[str]):
    """All (word, near word) with a word of ``asking`` and one of ``stored`` that is of its length or one letter longer.

    All of ``stored`` have one length.  Anagrams share one point.  Two points one edit apart tell which letters change, so
    the words are found by making the edit and looking it up: linear in the anagrams, whatever their number.
    """
    if not asking or not stored:
        return
    alphabet = alphabet_of(stored)
    points, place = np.unique(letter_counts(stored, alphabet), axis=0, return_inverse=True)
    place = place.ravel()
    by_point = np.split(np.argsort(place, kind="stable"), np.cumsum(np.bincount(place))[:-1])
    tree = KdTree(points, LEAF)
    there = set(stored)
    for longer in (False, True):
        some = [w for w in asking if len(w) + longer == len(stored[0])]
        if not some:
            continue
        radius = 1 if longer else 2
        spots, where = np.unique(letter_counts(some, alphabet), axis=0, return_inverse=True)
        where = where.ravel()
        by_spot = np.split(np.argsort(where, kind="stable"), np.cumsum(np.bincount(where))[:-1])
        for leaf, rows in tree.near(spots, radius):
            cell = tree.rows[leaf]
            for part in np.array_split(rows, -(-len(rows) // 2048)):
                apart = np.abs(spots[part][:, None, :] - points[cell][None, :, :]).sum(2, dtype=np.int32)
                for q, p in np.argwhere(apart <= radius):
                    spot, point = part[q], cell[p]
                    change = points[point].astype(np.int32) - spots[spot]
                    more = np.flatnonzero(change > 0)
                    less = np.flatnonzero(change < 0)
                    words = [some[i] for i in by_spot[spot]]
                    if int(change.clip(0).sum()) == 1 and int(-change.clip(None, 0).sum()) == 1 - longer and less.max(initial=-1) < len(alphabet):
                        yield from _edits(words, longer, chr(alphabet[more[0]]), chr(alphabet[less[0]]) if len(less) else "", there)
                    elif len(stored[0]) > 30_000 or (len(less) and less[0] == len(alphabet)):
                        yield from _compared(words, [stored[i] for i in by_point[point]], longer)


def _compared(words, others, longer: bool):
    """Where counts were cut off, or the letter that goes is not in the cell's alphabet: position by position."""
    for w in words:
        for v in others:
            i = next((i for i, (a, b) in enumerate(zip(w, v)) if a != b), len(w))
            if w != v and w[i + (not longer) :] == v[i + 1 :]:
                yield w, v


class Cells:
    """The cells of every length, cut from the sample."""

    def __init__(self, sample: list[str], total: int):
        self.alphabet = alphabet_of(sample) if sample else np.zeros(1, dtype=np.uint32)
        most = max(CELLS_LEAST, CELL * len(sample) // max(1, total))
        self.trees = {}
        for length in sorted({len(w) for w in sample}):
            self.trees[length] = KdTree(letter_counts([w for w in sample if len(w) == length], self.alphabet), most)

    def deal(self, words: list[str]):
        """(length, cell, asks, row of ``words``): each word once where it is stored, and wherever it looks."""
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for length in np.unique(lens):
            rows = np.flatnonzero(lens == length)
            points = letter_counts([words[i] for i in rows], self.alphabet)
            for other, radius in ((length, None), (length, 2), (length + 1, 1)):
                tree = self.trees.get(int(other))
                if tree is None:
                    yield int(other), np.zeros(len(rows), dtype=np.int64), radius is not None, rows
                elif radius is None:
                    yield int(other), tree.home(points), False, rows
                else:
                    for leaf, some in tree.near(points, radius):
                        yield int(other), np.full(len(some), leaf, dtype=np.int64), True, rows[some]


def links(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, near, near_n): every ordered pair of words (word, n) one edit apart."""
    short = words.where(F.length("word") <= CUT_LENGTH)
    sample = [r[0] for r in short.orderBy(F.xxhash64("word"), "word").limit(SAMPLE).select("word").collect()]
    cells = Cells(sample, short.count())

    def dealt(batches):
        for batch in batches:
            texts = batch["word"].tolist()
            for length, cell, asks, rows in cells.deal(texts):
                part = batch.iloc[rows]
                yield pd.DataFrame({"length": length, "cell": cell, "asks": asks, "word": part["word"].values, "n": part["n"].values})

    spread = scratch.put(words.mapInPandas(dealt, "length int, cell long, asks boolean, word string, n long"), "dealt")
    # a cell that is larger than meant (anagrams cannot be parted by counts) is dealt in blocks against blocks
    sizes = spread.groupBy("length", "cell").agg(F.count(F.when(~F.col("asks"), 1)).alias("stored"), F.count(F.when(F.col("asks"), 1)).alias("asked"))
    sizes = sizes.where("stored > 0 AND asked > 0").select("length", "cell", F.ceil(F.col("stored") / BLOCK).alias("sb"), F.ceil(F.col("asked") / ASKING).alias("ab"))
    own = F.pmod(F.xxhash64("word"), F.when(F.col("asks"), F.col("ab")).otherwise(F.col("sb")))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("asks"), F.col("sb")).otherwise(F.col("ab")) - 1)
    blocks = spread.join(sizes, ["length", "cell"]).withColumns({"own": own, "other": F.explode(others)})
    blocks = blocks.withColumns({"s": F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")), "a": F.when(F.col("asks"), F.col("own")).otherwise(F.col("other"))})

    def search(group: pd.DataFrame) -> pd.DataFrame:
        n = dict(zip(group["word"], group["n"], strict=True))
        asks = group["asks"].to_numpy(dtype=bool)
        pairs = list(near_pairs(group["word"][asks].tolist(), group["word"][~asks].tolist()))
        pairs += [(v, w) for w, v in pairs if len(v) > len(w)]  # the longer word does not look at shorter ones itself
        out = pd.DataFrame(pairs, columns=["word", "near"])
        return out.assign(near_n=[n[v] for v in out["near"]])

    return blocks.groupBy("length", "cell", "s", "a").applyInPandas(search, "word string, near string, near_n long")


def group_variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """For (word, n), each word once: form, root, n_near, form_n.

    ``form`` is the near word of largest n (ties: the smallest in code-point order) where that is at least ``factor`` (2 or more) times
    the word's own, else null; ``root`` is where following forms ends.  Ends are found by doubling: a step looks up the form's
    own end so far.  An empty table gives an empty result.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.put(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    found = links(words, scratch).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    close = F.col("best").isNotNull() & (-F.col("best.minus") >= factor * F.col("n"))
    judged = words.join(found, "word", "left").select(
        "word", "n", F.when(close, F.col("best.near")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(close, -F.col("best.minus")).alias("form_n"),
    )
    judged = scratch.put(judged, "judged")
    ends = scratch.put(judged.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "ends-0")
    step = 0
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step += 1
        moved = scratch.put(moved, f"ends-{step}")
        ends = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            break
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def slipped(run: Column, doc_id: str = "doc_id", every: int = 199) -> Column:
    """One run in ``every``, by the crc32 of id and run, loses the code point its crc32 points at; a null id is spelled empty."""
    h = F.crc32(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def digest(docs: DataFrame) -> DataFrame:
    return group_variants(corpus_words(docs.select("doc_id", "text"), altered=slipped))


SQL = f"""
WITH {sqlparts.CRC_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[{LETTERS}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
marked AS (SELECT run, times, {sqlparts.crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc_table),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(times)::BIGINT AS n
  FROM marked GROUP BY 1 HAVING length(word) >= 6 AND n >= 5),
shorter AS (SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN shorter b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM words a JOIN shorter b ON a.word = b.rest),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
judged AS (
  SELECT w.word, w.n, CASE WHEN near_n >= 5 * w.n THEN near END AS form, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
{', '.join(f'r{k + 1} AS (SELECT r.word, coalesce(j.form, r.root) AS root FROM {f"r{k}" if k else "(SELECT word, word AS root FROM judged)"} r JOIN judged j ON j.word = r.root)' for k in range(16))}
SELECT j.word, form, root, n, n_near, form_n FROM judged j JOIN r16 ON r16.word = j.word
"""
