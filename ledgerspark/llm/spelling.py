"""Spelling variants: words one letter apart, found by range searches in k-d trees over letter counts.

Words of one length are points, their coordinates the counts of each letter. A replaced letter moves a point by an L1 distance of two,
an inserted one by one into the next length. For each pair of lengths a tree splits the points into boxes; a word asks every box
that comes that near, and inside a box a second tree prunes further. What remains is verified letter by letter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import ascii_lower, discard, stored

#: Words in the sample that places the boxes. It decides how evenly words are dealt, never which words are near.
SAMPLE = 1 << 16
#: Longer words are not in the sample; each of their lengths is one box.
SAMPLE_CHARS = 64
#: Words of a box that are aimed at, and number above which a box that cannot be split is dealt out by hash.
BOX, DEALT = 4096, 16384
#: Different letter counts in a leaf of the tree inside a box, and those that are held against a leaf at a time.
LEAF, ASKED = 24, 4096

LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
COLUMN = np.zeros(0x100, np.int64)
COLUMN[LETTERS] = np.arange(len(LETTERS))


def runs_of(docs: DataFrame) -> DataFrame:
    """Every run of letters, A-Z lower-cased; in one of 199, chosen by crc32 of doc_id and run, a letter is left out."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    lower = runs.where(F.char_length("run") >= 6).select("doc_id", ascii_lower(F.col("run")).alias("run"))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    marked = lower.select("run", F.crc32(name).alias("h"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return marked.select(F.when(F.pmod("h", F.lit(199)) == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, min_chars: int = 6, min_count: int = 5) -> DataFrame:
    """``(word, n)``: words of ``min_chars`` code points and ``min_count`` occurrences or more, counted before they are shuffled."""
    if min_chars < 6:
        raise ValueError("runs under six letters are not read")
    return runs_of(docs).where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def letter_counts(words: list[str]) -> np.ndarray:
    """A row of counts for each word."""
    sizes = np.array([len(w) for w in words], np.int64)
    letters = COLUMN[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    flat = np.bincount(np.repeat(np.arange(len(words)), sizes) * len(LETTERS) + letters, minlength=len(words) * len(LETTERS))
    return flat.reshape(len(words), len(LETTERS)).astype(np.int32)


@dataclass
class Node:
    """A box of the tree: the bounds that splits gave it, and either two halves or the number of its leaf."""

    low: dict[int, int] = field(default_factory=dict)
    high: dict[int, int] = field(default_factory=dict)
    halves: tuple[Node, Node] | None = None
    leaf: int = 0

    def distance(self, points: np.ndarray) -> np.ndarray:
        """L1 distance of points to the box."""
        total = np.zeros(len(points), np.int64)
        for letter, least in self.low.items():
            total += np.maximum(least - points[:, letter], 0)
        for letter, most in self.high.items():
            total += np.maximum(points[:, letter] - most, 0)
        return total


class KdTree:
    """Splits at the letter and count that part the points most evenly, while a box holds over ``size`` of them."""

    def __init__(self, points: np.ndarray, size: float):
        self.leaves: list[np.ndarray] = []
        self.root = self._grow(points, np.arange(len(points)), size, {}, {})

    def _grow(self, points: np.ndarray, own: np.ndarray, size: float, low: dict, high: dict) -> Node:
        node = Node(low, high)
        split = self._split(points[own]) if len(own) > size else None
        if split is None:
            node.leaf = len(self.leaves)
            self.leaves.append(own)
            return node
        letter, most = split
        left = points[own, letter] <= most
        node.halves = (
            self._grow(points, own[left], size, low, high | {letter: most}),
            self._grow(points, own[~left], size, low | {letter: most + 1}, high),
        )
        return node

    @staticmethod
    def _split(points: np.ndarray) -> tuple[int, int] | None:
        best, found = 0, None
        middle = np.partition(points, len(points) // 2, axis=0)[len(points) // 2]
        for letter in np.flatnonzero(points.max(axis=0) > points.min(axis=0)).tolist():
            for most in (int(middle[letter]) - 1, int(middle[letter])):
                n = int((points[:, letter] <= most).sum())
                if min(n, len(points) - n) > best:
                    best, found = min(n, len(points) - n), (letter, most)
        return found

    def within(self, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """``(leaf, numbers of the points)`` for each leaf whose box is within ``radius`` of any."""
        open_boxes = [(self.root, np.arange(len(points)))]
        while open_boxes:
            node, own = open_boxes.pop()
            own = own[node.distance(points[own]) <= radius]
            if not len(own):
                continue
            if node.halves is None:
                yield node.leaf, own
            else:
                open_boxes += [(half, own) for half in node.halves]


def by_length(words: list[str]) -> dict[int, np.ndarray]:
    found = defaultdict(list)
    for k, word in enumerate(words):
        found[len(word)].append(k)
    return {size: np.array(own) for size, own in found.items()}


def plan_boxes(words: DataFrame, sample: int = SAMPLE, box: int = BOX) -> dict[int, KdTree]:
    """A tree for each length in a sample of about ``sample`` words, chosen by their hashes."""
    short = words.where(F.char_length("word") <= SAMPLE_CHARS)
    n = short.count()
    share = min(1.0, sample / max(n, 1))
    low = F.shiftrightunsigned(F.xxhash64("word"), 32) < int(share * 2.0**32)
    drawn = sorted(r.word for r in short.where(low).select("word").collect())
    size = max(1.0, box * len(drawn) / max(n, 1))
    return {length: KdTree(letter_counts([drawn[k] for k in own]), size) for length, own in by_length(drawn).items()}


def _asked(trees: dict[int, KdTree], words: list[str], radius: int, to: int) -> Iterator[tuple[int, np.ndarray]]:
    tree = trees.get(to)
    if tree is None:  # a length that is not in the sample is one box
        yield 0, np.arange(len(words))
    else:
        yield from tree.within(letter_counts(words), radius)


def _part(words: pd.Series, count: int) -> np.ndarray:
    if count == 1:
        return np.zeros(len(words), np.int64)
    return (pd.util.hash_array(words.to_numpy(dtype=object), categorize=False) % count).astype(np.int64)


def deal(words: DataFrame, trees: dict[int, KdTree], parts: dict[tuple[int, int], int], ask: bool = True) -> DataFrame:
    """Words at home in their own box (``home`` true), and with ``ask`` in each box of both lengths that may hold near ones.

    ``parts`` has the boxes that are dealt out by hash, with their number of parts: a word is at home in one and asks all.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            every = frame["word"].tolist()
            sent = []
            for length, own in by_length(every).items():
                some = [every[k] for k in own]
                wanted = [(length, 0, True)] + ([(length, 2, False), (length + 1, 1, False)] if ask else [])
                for to, radius, home in wanted:
                    for leaf, got in _asked(trees, some, radius, to):
                        count = parts.get((to, leaf), 1)
                        rows = own[got]
                        if home:
                            sent.append((rows, to, leaf, _part(frame["word"].iloc[rows], count), True))
                        else:
                            sent += [(rows, to, leaf, np.full(len(rows), part), False) for part in range(count)]
            if sent:
                each = [len(x[0]) for x in sent]
                made = frame.iloc[np.concatenate([x[0] for x in sent])]
                columns = {name: np.repeat([x[k] for x in sent], each) for name, k in (("length", 1), ("box", 2), ("home", 4))}
                yield made.assign(part=np.concatenate([x[3] for x in sent]), **columns)[["length", "box", "part", "home", "word", "n"]]

    return words.select("word", "n").mapInPandas(run, "length int, box int, part int, home boolean, word string, n long")


def variants(word: str, gone: str, come: str) -> Iterator[str]:
    """``word`` with ``come`` in place of ``gone``, at each place in turn; no result twice."""
    at = word.find(gone)
    while at >= 0:
        if come or word[at - 1 : at] != gone:
            yield word[:at] + come + word[at + 1 :]
        at = word.find(gone, at + 1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances. Counts whose sums differ by 0 or 1 have an L1 distance of 2 or 1 exactly if this is 2 or 1."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T


def search_box(frame: pd.DataFrame) -> pd.DataFrame:
    """What the words of one box and those that ask it know of each other: the number of near words, and the best of them."""
    found: dict[str, list] = {}

    def tell(word: str, near: str, n: int) -> None:
        known = found.setdefault(word, [0, 0, ""])
        known[0] += 1
        if n > known[1] or (n == known[1] and near < known[2]):
            known[1:] = [n, near]

    def points(rows: pd.DataFrame) -> tuple[np.ndarray, list[dict[str, int]]]:
        """Different letter counts, and the words with each."""
        words = rows["word"].tolist()
        if not words:
            return np.zeros((0, len(LETTERS)), np.int32), []
        counts, of = np.unique(letter_counts(words), axis=0, return_inverse=True)
        groups: list[dict[str, int]] = [{} for _ in counts]
        for word, n, k in zip(words, rows["n"].tolist(), of.ravel().tolist(), strict=True):
            groups[k][word] = n
        return counts, groups

    def match(ours: dict[str, int], theirs: dict[str, int], step: np.ndarray, radius: int) -> None:
        come = chr(LETTERS[int(step.argmax())])
        if radius == 2:
            gone = chr(LETTERS[int(step.argmin())])
            for word in ours:
                for other in variants(word, gone, come):
                    if other in theirs:
                        tell(word, other, theirs[other])
        else:
            for other, n in theirs.items():
                for word in variants(other, come, ""):
                    if word in ours:
                        tell(word, other, n)
                        tell(other, word, ours[word])

    length = int(frame["length"].iloc[0])
    at, homes = points(frame[frame["home"]])
    asking = frame[~frame["home"]]
    sizes = asking["word"].str.len()
    tree = KdTree(at, LEAF) if homes else None
    for radius in (1, 2) if tree else ():
        asked, askers = points(asking[sizes == length - (radius == 1)])
        for leaf, own in tree.within(asked, radius) if askers else ():
            inside = tree.leaves[leaf]
            for first in range(0, len(own), ASKED):
                some = own[first : first + ASKED]
                for q, p in zip(*np.nonzero(_squares(asked[some], at[inside]) == radius), strict=True):
                    step = at[inside[p]] - asked[some[q]]
                    match(askers[some[q]], homes[inside[p]], step, radius)
    return pd.DataFrame([(w, *x) for w, x in found.items()], columns=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, best, best_n)`` of the words that have others one edit away; the best has the largest n, then the least code points."""
    trees = plan_boxes(words)
    homes = deal(words, trees, {}, ask=False).groupBy("length", "box").count().where(F.col("count") > DEALT)
    # At most one row for each DEALT words, and one for each box of the trees.
    parts = {(r.length, r.box): -(-r["count"] // DEALT) for r in homes.collect()}
    told = deal(words, trees, parts).groupBy("length", "box", "part").applyInPandas(search_box, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    out = told.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return out.select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: the end of each chain of ``(word, form)``. Forms are at least five times as frequent, so chains are short and end."""
    known = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = known.join(ahead, "root", "left")
        longer = stored(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        done = longer.where("moved").isEmpty()
        discard(known)
        known = longer.select("word", "root")
        if done:
            return known


def group_variants(docs: DataFrame, ratio: int = 5) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``: every word of six or more letters found five or more times.

    Two words are near if one letter inserted, left out or replaced makes one the other. A word's form is its most frequent near word (of
    equally frequent ones the least in code points) if that is at least ``ratio`` times as frequent, else null; the root is the end of the chain
    of forms. Null and empty texts have no words, a null doc_id counts as an empty one where letters are left out, rows repeated
    whole count as often as they stand there, and an empty table gives no rows. Runs of any length are whole words. Columns other than doc_id
    and text are not read.
    """
    words = stored(vocabulary(docs), "words")
    near = stored(near_words(words), "near-words")
    known = words.join(near, "word", "left")
    takes = F.col("best_n") >= ratio * F.col("n")
    known = known.select(
        "word",
        F.when(takes, F.col("best")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("best_n")).alias("form_n"),
    )
    known = stored(known, "forms")
    ends = roots(known.where(F.col("form").isNotNull()))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
