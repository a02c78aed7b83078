"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints that differ in at most ``radius`` bits differ in few bits of at
least one segment, so each fingerprint asks that segment's table for every value in a small Hamming ball, and whole
distances are checked on what comes back. Equal fingerprints are one entry throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import UPPER, discard, stored, text_hash
from ledgerspark.llm.graph import components

_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())

#: Rows of one table key that a task compares by itself; a key with more is dealt out in blocks.
KEY_ROWS = 100_000
#: Pairs that are compared in one array operation.
CHUNK = 1 << 20


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle in order; no words: none; fewer words than asked: one shingle."""
    parts = text.translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    size = min(words, len(parts))
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(parts) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(line[s:e], seed) for s, e in spans), np.uint64)


def simhash(text: bytes, words: int = 4, seed: int = 42, lanes: int = 1) -> list[int]:
    """SimHash of the word shingles in lanes of 64 bits, repeats counted; no words: 0; fewer words than asked: one shingle.

    The first lane is of XXH64 itself, each further one of the same hashes mixed with another odd factor.
    """
    return _bits(shingle_hashes(text, words, seed), lanes)


def _bits(hashes: np.ndarray, lanes: int) -> list[int]:
    if not len(hashes):
        return [0] * lanes
    out = []
    for lane in range(lanes):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), CHUNK):
            own = hashes[at : at + CHUNK]
            if lane:
                own = (own ^ (own >> np.uint64(29 + lane % 8))) * np.uint64(0x9E3779B97F4A7C15 + 2 * lane)
                own = (own ^ (own >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
                own ^= own >> np.uint64(31)
            bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]))
    return out


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, lanes: int = 1) -> DataFrame:
    """``(doc_id, w0, w1, ...)``, one row per row of ``docs``; lanes as signed longs. Null text: no words."""
    names = [f"w{i}" for i in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            made = np.array([simhash(t.as_py() or b"", words, seed, lanes) for t in texts], np.uint64).reshape(-1, lanes)
            columns = [pa.array(np.ascontiguousarray(made[:, i]).view(np.int64)) for i in range(lanes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    schema = ", ".join([f"doc_id {dict(docs.dtypes)['doc_id']}", *[f"{n} long" for n in names]])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan_segments(entries: int, radius: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """``(first bit, width, ball radius)`` of each segment, cheapest for so many fingerprints.

    Ball radii add up so that missing every ball takes more than ``radius`` bits: sum(radius_i + 1) > radius.
    """

    def layout(parts: int) -> list[tuple[int, int, int]]:
        edges = [round(bits * i / parts) for i in range(parts + 1)]
        extra = radius + 1 - parts
        own = [extra // parts + (i < extra % parts) for i in range(parts)]
        return [(edges[i], edges[i + 1] - edges[i], own[i]) for i in range(parts)]

    def cost(plan: list[tuple[int, int, int]]) -> float:
        return sum(
            sum(math.comb(width, k) for k in range(r + 1)) * (1 + entries / 2.0**width) for _, width, r in plan
        )

    return min((layout(parts) for parts in range(1, radius + 2) if parts > radius / 3), key=cost)


def estimated_radius(similarity: float, bits: int) -> int:
    """Differing bits up to which shingles may have the given Jaccard similarity: the expected number and 3 deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * share + 3 * math.sqrt(bits * share * (1 - share)))


def _apart(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(many ^ one).sum(1, dtype=np.int64)


def _span(rows: np.ndarray, n_own: int, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest, as row numbers, of the links between the first ``n_own`` rows of a key and all its rows.

    Breadth first over what is not yet reached, so a dense group costs about one comparison per member.
    """
    found = []
    own, ask = np.arange(n_own), np.arange(n_own, len(rows))
    while len(own):
        queue, own = [(own[0], True)], own[1:]
        while queue and (len(own) or len(ask)):
            at, is_own = queue.pop()
            near = _apart(rows[own], rows[at]) <= radius
            if near.any():
                found.append((np.full(near.sum(), at), own[near]))
                queue += [(x, True) for x in own[near]]
                own = own[~near]
            if is_own and len(ask):
                near = _apart(rows[ask], rows[at]) <= radius
                if near.any():
                    found.append((np.full(near.sum(), at), ask[near]))
                    queue += [(x, False) for x in ask[near]]
                    ask = ask[~near]
    return found


def _pairs(keys: np.ndarray, owned: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of links between the owned and all rows of each key; rows are sorted by key, owned ones first."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if not len(keys):
        return found
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    n_own = np.add.reduceat(owned.astype(np.int64), starts)
    todo = n_own * (sizes - 1)
    small = np.flatnonzero((todo > 0) & (todo <= 256))
    for at in range(0, len(small), 4096):
        some = small[at : at + 4096]
        count = n_own[some] * sizes[some]
        ends = np.cumsum(count)
        first, width = np.repeat(starts[some], count), np.repeat(sizes[some], count)
        step = np.arange(ends[-1]) - np.repeat(ends - count, count)
        a, b = first + step // width, first + step % width
        hit = (a != b) & (_apart(fps[a], fps[b]) <= radius)
        found.append((a[hit], b[hit]))
    for g in np.flatnonzero(todo > 256).tolist():
        part = _span(fps[starts[g] : starts[g] + sizes[g]], int(n_own[g]), radius)
        found += [(starts[g] + a, starts[g] + b) for a, b in part]
    return found


def _entries(part: int, low: int, width: int, own: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(key, owned, row)`` of one segment of all fingerprints: their own values, then what they ask for."""
    lane, off = divmod(low, 64)
    value = fps[:, lane] >> np.uint64(off)
    if off + width > 64:
        value = value | (fps[:, lane + 1] << np.uint64(64 - off))
    if width < 64:
        value = (value & np.uint64((1 << width) - 1)) | np.uint64(part % 64 << 58)
    rows = np.arange(len(fps))
    keys, at = [value], [rows]
    for size in range(1, own + 1):
        for flips in combinations(range(width), size):
            mask = np.uint64(sum(1 << i for i in flips))
            asks = (value & mask != 0) if own == 1 else np.ones(len(fps), bool)
            keys.append(value[asks] ^ mask)
            at.append(rows[asks])
    row = np.concatenate(at)
    return np.concatenate(keys), np.arange(len(row)) < len(fps), row


def _entered(prints: DataFrame, lanes: list[str], plan: list[tuple[int, int, int]]) -> DataFrame:
    """``(key, owned, node, lanes)``: each fingerprint under the keys of all segments."""
    fields = ["key", "owned", "node", *lanes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = [c.to_numpy(zero_copy_only=False) for c in batch.slice(at, 1000).columns]
                fps = np.stack(some[1:], axis=1).view(np.uint64)
                made = [_entries(part, *of, fps) for part, of in enumerate(plan)]
                key, owned, row = (np.concatenate(x) for x in zip(*made, strict=True))
                columns = [key.view(np.int64), owned, *(c[row] for c in some)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], fields)

    kinds = ", ".join(["key long", "owned boolean", "node long", *[f"{c} long" for c in lanes]])
    return prints.select("node", *lanes).mapInArrow(run, kinds)


def links(prints: DataFrame, radius: int, plan: list[tuple[int, int, int]], key_rows: int = KEY_ROWS) -> DataFrame:
    """``(a, b)`` between nodes whose fingerprints differ in at most ``radius`` bits, enough of them to connect every pair found.

    ``prints`` holds ``node`` (long) and the lanes, each fingerprint once. For every segment of ``plan`` a fingerprint is entered under
    its own value and asks under the values of its ball; in balls of one bit, set bits are cleared and never the reverse, so that of two
    values one bit apart just one asks. Of a group that is alike throughout, a spanning set of links is given, not all pairs. A key with
    more than ``key_rows`` rows is dealt out in pairs of blocks, so nothing is skipped.
    """
    lanes = [c for c in prints.columns if c != "node"]
    rows = _entered(prints, lanes, plan)
    own_plan = [(low, width, 0) for low, width, _ in plan]
    full = _entered(prints, lanes, own_plan).groupBy("key").count().where(F.col("count") > key_rows // 16)
    hot = stored(full.select("key"), "hot-keys")
    rows = rows.withColumn("cell", F.lit(0)) if hot.isEmpty() else _in_blocks(rows, hot, key_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            key, own, node = columns[0], columns[1].astype(bool), columns[2]
            fps = np.stack(columns[3:], axis=1).view(np.uint64)
            cut = int(np.searchsorted(key, key[-1]))
            kept.append((key[:cut], own[:cut], node[:cut], fps[:cut]))
            if cut:
                yield from _out(kept, radius)
                kept = []
            kept.append((key[cut:], own[cut:], node[cut:], fps[cut:]))
        yield from _out(kept, radius)

    return (
        rows.select(F.xxhash64("key", "cell").alias("key"), "owned", "node", *lanes)
        .repartition("key")
        .sortWithinPartitions("key", F.desc("owned"))
        .mapInArrow(run, "a long, b long")
    )


def _out(kept: list[tuple[np.ndarray, ...]], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of whole keys."""
    if kept:
        key, own, node, fps = (np.concatenate(x) for x in zip(*kept, strict=True))
        if found := _pairs(key, own, fps, radius):
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])


def _in_blocks(rows: DataFrame, hot: DataFrame, key_rows: int) -> DataFrame:
    """Rows of full keys copied into every pair of blocks they belong to; any two rows meet in one cell."""
    counts = rows.join(hot, "key").groupBy("key").count()
    blocks = stored(counts.select("key", F.ceil(F.col("count") / key_rows).cast("int").alias("blocks")), "key-blocks")
    mine = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    dealt = rows.join(blocks, "key", "left").select("*", mine.alias("mine"), other.alias("other"))
    cell = F.least("mine", "other") * F.coalesce("blocks", F.lit(1)) + F.greatest("mine", "other")
    return dealt.select(*rows.columns, cell.alias("cell"))


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``; every pair within ``radius`` bits of 64 is linked.

    Texts are read whole, however long, and an empty table gives no rows.
    component_id is the smallest doc_id that links reach, the document itself included. Null, empty and blank texts have
    fingerprint zero and are linked like any other. A null doc_id keeps its row; it names a component only if no other
    id is in it. Other columns of ``docs`` are not read.
    """
    prints = stored(fingerprints(docs, words, seed), "simhash")
    distinct = stored(prints.groupBy("w0").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    plan = plan_segments(distinct.count(), radius)
    found = links(distinct.select(F.col("w0").alias("node"), "w0"), radius, plan)
    named = _named(distinct.withColumn("node", F.col("w0")), ["w0"], found)
    discard(distinct)
    return prints.join(named, "w0").select("doc_id", F.lpad(F.lower(F.hex("w0")), 16, "0").alias("fingerprint"), "component_id")


#: Least bits in a segment of a wide fingerprint; any segment within one bit makes a pair that is looked at.
WIDE_SEGMENT = 16
#: Share of the pairs just as similar as asked that no segment may bring together.
MISSED = 0.006
#: Bytes of shingle sets in a block.
SET_BYTES = 8 << 20


def wide_plan(entries: int, similarity: float, missed: float = MISSED) -> tuple[int, list[tuple[int, int, int]]]:
    """``(lanes, segments)`` for so many fingerprints: segments get a bit longer each time the number doubles, and so many more.

    Chance meets then stay about the same for each fingerprint, however many there are, and the recall of similar ones too.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    width = min(56, max(WIDE_SEGMENT, math.ceil(math.log2(max(entries, 2))) - 2))
    meet = (1 - share) ** width + width * share * (1 - share) ** (width - 1)
    parts = math.ceil(math.log(missed) / math.log1p(-meet))
    return math.ceil(parts * width / 64), [(k * width, width, 1) for k in range(parts)]


def similar_documents(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """``(doc_id, component_id)``, one row per row of ``docs``, linked where sets of word shingles are alike by ``similarity`` (Jaccard).

    See :func:`similar_texts`. Nulls, empty texts and repeated rows are as in :func:`near_duplicates`.
    """
    return similar_texts(docs, similarity, words).select("doc_id", "component_id")


def similar_texts(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """``(doc_id, text_key, root, component_id)``: rows of one component share a root, whatever their ids.

    Different sets of shingles are the nodes. Wide fingerprints, with 3 standard deviations in favour of a link, only choose groups to
    look at. A pair is looked at if a segment differs in at most one bit (:func:`wide_plan`): of pairs at 0.8 that misses about 5 in 1,000.
    Links are then decided on the sets themselves.
    """
    lanes, plan = wide_plan(docs.count(), similarity)
    names = [f"w{i}" for i in range(lanes)]
    prints = stored(_sketches(docs, words, lanes, False), "simhash")
    nodes = stored(prints.groupBy("node", *names).agg(F.min("doc_id").alias("first_id"), F.min("text_key").alias("text_key")), "simhash-distinct")
    groups = components(links(nodes.select("node", *names), estimated_radius(similarity, 64 * lanes), plan))
    some = docs.select("doc_id", "text").withColumn("text_key", text_hash())
    some = some.join(nodes.join(groups, "node", "left_semi").select("text_key"), "text_key", "left_semi").drop("text_key")
    sets = _sketches(some, words, 0, True).groupBy("node").agg(F.first("shingles").alias("shingles"))
    members = stored(groups.join(sets, "node"), "shingle-sets")
    roots = components(_alike(members, similarity))
    joined = nodes.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stored(joined.join(least, "root").select("node", "root", "component_id"), "simhash-components")
    discard(nodes, groups, members, roots)
    return prints.join(named, "node").select("doc_id", "text_key", "root", "component_id")


def _sketches(docs: DataFrame, words: int, lanes: int, sets: bool) -> DataFrame:
    """``(doc_id, text_key, node, w0, ...)``, or ``(node, shingles)``: the different hashes of a text's shingles, sorted; node names the set."""
    names = [f"w{i}" for i in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.large_binary())]
            shingles = [np.unique(shingle_hashes(t, words)) for t in texts]
            node = pa.array(np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in shingles], np.uint64).view(np.int64))
            if sets:
                yield pa.RecordBatch.from_arrays([node, pa.array([x.tobytes() for x in shingles], pa.binary())], ["node", "shingles"])
                continue
            made = np.array([_bits(x, lanes) for x in shingles], np.uint64).reshape(-1, lanes)
            columns = [pa.array(np.ascontiguousarray(made[:, i]).view(np.int64)) for i in range(lanes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), node, *columns], ["doc_id", "text_key", "node", *names])

    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, text_key long, node long"
    schema = "node long, shingles binary" if sets else ", ".join([kind, *[f"{n} long" for n in names]])
    return docs.select("doc_id", "text", text_hash().alias("text_key")).mapInArrow(run, schema)


def _alike(members: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: enough links between sets of one group (``root, node, shingles``) to connect every pair that is alike.

    Each set is held against its group's first. Sets unlike that one then meet all others of the group in blocks of ``SET_BYTES``.
    """
    first = members.where("node = root").select("root", F.col("shingles").alias("lead"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(near, pa.bool_())], ["root", "node", "near"])

    held = stored(
        members.join(first, "root").select("root", "node", "shingles", "lead").mapInArrow(judge, "root long, node long, near boolean"), "judged"
    )
    star = held.where("near AND node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    rows = members.join(held.select("node", "near"), "node")
    size = lambda near: F.ceil(F.coalesce(F.sum(F.when(F.col("near") == near, F.length("shingles"))), F.lit(0)) / SET_BYTES).cast("int")
    blocks = rows.groupBy("root").agg(size(False).alias("others"), size(True).alias("ours")).where("others > 0")
    mine = F.when(F.col("near"), F.col("others") + F.pmod(F.xxhash64("node"), F.col("ours"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others")))
    ends = F.when(F.col("near"), F.col("others")).otherwise(F.col("others") + F.col("ours")) - 1
    dealt = rows.join(blocks, "root").select("root", "node", "near", "shingles", mine.alias("mine"), F.explode(F.sequence(F.lit(0), ends)).alias("other"))
    cell = F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kept and kept[0][0] != row[0]:
                    yield _set_links(kept, similarity)
                    kept = []
                kept.append(row)
        if kept:
            yield _set_links(kept, similarity)

    met = dealt.select(cell, "node", "near", "shingles").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")
    return star.unionByName(met)


def _set_links(rows: list[tuple], similarity: float) -> pa.RecordBatch:
    """Links of one cell (``cell, node, near, shingles``), breadth first from the sets that are not near the group's first one."""
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    near = np.array([r[2] for r in rows])
    sizes = np.array([len(x) for x in sets])
    order = np.argsort(flat := np.concatenate(sets), kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(sets)), sizes)[order]
    seen = near.copy()
    a, b = [], []
    for start in np.flatnonzero(~near).tolist():
        queue = [] if seen[start] else [start]
        seen[start] = True
        while queue:
            at = queue.pop()
            low, high = np.searchsorted(flat, sets[at]), np.searchsorted(flat, sets[at], "right")
            both = np.zeros(len(sets), np.int64)
            for i in range(0, len(low), 1024):
                spans = [owner[x:y] for x, y in zip(low[i : i + 1024], high[i : i + 1024], strict=True)]
                both += np.bincount(np.concatenate(spans), minlength=len(sets))
            like = both >= similarity * (sizes + sizes[at] - both)
            reached = [*np.flatnonzero(like & near)[:1].tolist(), *(new := np.flatnonzero(like & ~seen).tolist())]
            a += [rows[at][1]] * len(reached)
            b += [rows[x][1] for x in reached]
            seen[new] = True
            queue += new
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _named(nodes: DataFrame, names: list[str], found: DataFrame) -> DataFrame:
    """``names`` and the smallest document of the component; written, so that a join on a frequent fingerprint can be split."""
    roots = components(found)
    joined = nodes.join(roots, "node", "left").select(*names, "first_id", F.coalesce("root", "node").alias("root"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stored(joined.join(least, "root").select(*names, "component_id"), "simhash-components")
    discard(roots)
    return named
