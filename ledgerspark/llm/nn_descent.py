"""Near-duplicate vectors through NN-descent.

A graph of near neighbours starts from vectors that sort next to each other by random hyperplane signs. Each round every vector's
neighbours, both ways, are compared with one another, and lists keep the nearest; lists that are full of links grow. When lists
settle, groups larger than a list are compared with one another, as links between them may have been pushed out. Recall is audited
against brute force on a bounded sample, with more rounds if it falls short and an exact comparison at last. Edges over the threshold are
checked in double precision, and every linked group is then counted out in blocks, so links missing in lists still count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import discard, stored
from ledgerspark.llm.graph import components

#: Neighbours in a list, and in one that links have filled.
NEAREST, GROWN = 8, 32
#: Sort orders of the first graph, and rows behind each vector that it is compared with in them.
ORDERS, AHEAD = 8, 3
ROUNDS = 8
#: Vectors whose links are looked for among all vectors to audit recall.
AUDIT = 400
#: Rows of a group that are compared at once.
BLOCK = 2048
#: Bytes of vectors in a part when groups are compared with one another; a task holds two parts.
PART_BYTES = 16 << 20
#: Parts at least, so that several tasks share a small comparison.
LEAST_PARTS = 6


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of raw numbers as a matrix; all rows have the same length."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _classes(vectors: DataFrame) -> DataFrame:
    """``(h1, h2, id, copies, raw)`` of each different vector that can link; raw: its doubles as bytes."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", "h1", "h2", "embedding").where(F.coalesce(usable, F.lit(False)))
    groups = rows.groupBy("h1", "h2").agg(
        F.min("vec_id").cast("long").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(v, np.float64).tobytes() for v in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(raw, pa.binary())], ["h1", "h2", "id", "copies", "raw"])

    return groups.mapInArrow(run, "h1 long, h2 long, id long, copies long, raw binary")


def _unit(raw: bytes) -> np.ndarray:
    """Unit vector in single precision; scaled first, so that no square overflows."""
    v = np.frombuffer(raw, np.float64)
    v = v / np.abs(v).max()
    return (v / np.linalg.norm(v)).astype(np.float32)


def _cosine(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length in double precision: their products are cosines."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _signs(nodes: DataFrame, orders: int) -> DataFrame:
    """``(turn, sign, id, unit)``: the signs on 63 random hyperplanes, a different set each turn; length leads the sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            units = [_unit(raw) for raw in batch.column(1).to_pylist()]
            for turn in range(orders):
                signs = []
                for u in units:
                    at = (turn, len(u))
                    if at not in planes:
                        planes[at] = np.random.default_rng(at).standard_normal((len(u), 63)).astype(np.float32)
                    signs.append(int(np.packbits(np.append(u @ planes[at] > 0, False), bitorder="little").view("<u8")[0]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([turn] * len(units), pa.int32()),
                        pa.array([len(u) for u in units], pa.int32()),
                        pa.array(signs, pa.int64()),
                        batch.column(0),
                        pa.array([u.tobytes() for u in units], pa.binary()),
                    ],
                    ["turn", "dims", "sign", "id", "unit"],
                )

    return nodes.select("id", "raw").mapInArrow(run, "turn int, dims int, sign long, id long, unit binary")


def _first_graph(nodes: DataFrame, orders: int, ahead: int) -> DataFrame:
    """``(u, v, sim)`` of vectors that lie next to each other in some order of signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[tuple] = []
        for batch in batches:
            rows = tail + list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            u, v, sim = [], [], []
            units = [np.frombuffer(r[4], np.float32) for r in rows]
            for i in range(len(tail), len(rows)):
                for j in range(max(0, i - ahead), i):
                    if rows[i][:2] == rows[j][:2]:
                        u.append(rows[j][3])
                        v.append(rows[i][3])
                        sim.append(float(units[i] @ units[j]))
            tail = rows[-ahead:]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sim, pa.float64())], ["u", "v", "sim"])

    order = ["turn", "dims", "sign", "id"]
    dealt = _signs(nodes, orders).repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "u long, v long, sim double")


def _nearest(edges: DataFrame, threshold: float, near: int, grown: int) -> DataFrame:
    """Lists of the ``near`` most similar of each u; links fill a list up to ``grown``."""
    best = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    ranked = edges.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= grown)
    return ranked.where((F.col("rank") <= near) | (F.col("sim") >= threshold)).drop("rank")


def _both_ways(edges: DataFrame) -> DataFrame:
    other = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *[c for c in edges.columns if c not in "uv"])
    return edges.unionByName(other)


def _local_join(lists: DataFrame, units: DataFrame, threshold: float, near: int, grown: int) -> DataFrame:
    """``(u, v, sim)`` of neighbours of one vector that would enter a list, each pair both ways and once."""
    back = lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim", "fresh")
    around = lists.unionByName(_nearest(back, threshold, near, grown)).groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
    bars = lists.groupBy("u").agg(
        F.when(F.count("*") < near, F.lit(-2.0)).otherwise(F.least(F.min("sim"), F.lit(threshold))).alias("bar")
    )
    known = units.join(bars, units["id"] == bars["u"], "left").select("id", "unit", F.coalesce("bar", F.lit(-2.0)).alias("bar"))
    rows = around.join(known, around["v"] == known["id"]).select("u", "v", "fresh", "bar", "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            tail.append(batch.slice(0, cut))
            if cut:
                yield from compare(tail)
                tail = []
            tail.append(batch.slice(cut))
        yield from compare(tail)

    def compare(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [p for p in parts if p.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts).combine_chunks()
        u, v, bar = (rows.column(i).to_numpy() for i in (0, 1, 3))
        fresh = rows.column(2).to_numpy().astype(bool)
        raw = rows.column(4).to_pylist()
        edges = [0, *(np.flatnonzero(u[1:] != u[:-1]) + 1).tolist(), len(u)]
        got = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            new = fresh[a:b]
            if b - a < 2 or not new.any():
                continue
            x = np.frombuffer(b"".join(raw[a:b]), np.float32).reshape(b - a, -1)
            sim = x @ x.T
            wanted = (sim > bar[a:b][None, :]) & (new[:, None] | new[None, :])  # column's list takes the row
            np.fill_diagonal(wanted, False)
            i, j = np.nonzero(wanted)
            got.append((v[a:b][j], v[a:b][i], sim[i, j].astype(np.float64)))
        if got:
            columns = [pa.array(np.concatenate(c)) for c in zip(*got, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["u", "v", "sim"])

    found = rows.repartition("u").sortWithinPartitions("u").mapInArrow(run, "u long, v long, sim double")
    return found.where("u <> v").groupBy("u", "v").agg(F.max("sim").alias("sim"))


def _exact(edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Edges whose cosine in double precision reaches the threshold."""
    raw = nodes.select("id", "raw")
    left = raw.select(F.col("id").alias("u"), F.col("raw").alias("x"))
    right = raw.select(F.col("id").alias("v"), F.col("raw").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                keep = []
                for x, y in zip(some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True):
                    pair = _cosine(np.stack([np.frombuffer(x, np.float64), np.frombuffer(y, np.float64)]))
                    keep.append(bool(pair[0] @ pair[1] >= threshold))
                yield some.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return edges.join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """``(id, others)``: copies of other vectors of the same group that a vector links with.

    ``members`` holds ``root, id, copies, raw``. A group is dealt into blocks, and each pair of blocks is compared by itself; counts
    are what leaves a task, never pairs.
    """
    sizes = members.groupBy("root").count().select("root", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "root")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell")
    cells = dealt.select(cell, (F.col("mine") <= F.col("other")).alias("low"), (F.col("mine") == F.col("other")).alias("same"), "id", "copies", "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            tail.append(batch.slice(0, cut))
            if cut:
                yield from compare(tail)
                tail = []
            tail.append(batch.slice(cut))
        yield from compare(tail)

    def compare(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [p for p in parts if p.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts).combine_chunks()
        key, ids, copies = (rows.column(i).to_numpy() for i in (0, 3, 4))
        low, same = (rows.column(i).to_numpy().astype(bool) for i in (1, 2))
        raw = rows.column(5).to_pylist()
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        out_ids, out_counts = [], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            x = _cosine(np.frombuffer(b"".join(raw[a:b]), np.float64).reshape(b - a, -1))
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            if not same[a]:  # pairs within a block belong to its own cell
                near &= low[a:b][:, None] != low[a:b][None, :]
            out_ids.append(ids[a:b])
            out_counts.append(near @ copies[a:b])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(out_ids)), pa.array(np.concatenate(out_counts).astype(np.int64))], ["id", "others"]
        )

    counted = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "id long, others long")
    return counted.groupBy("id").agg(F.sum("others").alias("others"))


def _blocks_of(root: np.ndarray) -> list[int]:
    """Edges of blocks of at most ``BLOCK`` rows of one root; rows are sorted by root."""
    starts = [0, *(np.flatnonzero(root[1:] != root[:-1]) + 1).tolist(), len(root)]
    return [at for a, b in zip(starts[:-1], starts[1:], strict=True) for at in range(a, b, BLOCK)] + [len(root)]


def _bounds(x: np.ndarray, edges: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A direction for each block of unit rows, and the largest angle of its rows to that."""
    centre = x[edges[:-1]]
    sizes = np.diff(edges)
    cosine = np.einsum("ij,ij->i", x, np.repeat(centre, sizes, axis=0))
    angle = np.where(np.repeat(sizes, sizes) == 1, 0.0, np.arccos(np.clip(cosine, -1, 1)))
    return centre, np.maximum.reduceat(angle, edges[:-1])


def _across(members: DataFrame, threshold: float, total: int) -> DataFrame:
    """``(u, v)``: roots of all different groups of ``members`` (``root, id, raw``) that a link joins, by exact comparison.

    Rows are dealt into parts of about ``PART_BYTES``, and each pair of parts is one cell: a task holds two parts, whatever the number of
    rows or the size of a group, and nothing goes through the driver. Each row is shuffled once for every part, so the cost grows with the
    square of what is in large groups. Inside a cell blocks of a group are compared if their directions and angles leave room for a link.
    """
    if not total:
        return members.select(F.col("root").alias("u"), F.col("root").alias("v")).where("false")
    size = members.agg(F.sum(F.length("raw"))).first()[0]
    parts = max(LEAST_PARTS, -(-size // PART_BYTES))
    mine = F.pmod(F.xxhash64("id"), F.lit(parts)).alias("mine")
    dealt = members.select("root", "raw", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    cell = (F.least("mine", "other") * parts + F.greatest("mine", "other")).alias("cell")
    cells = dealt.select(cell, (F.col("mine") <= F.col("other")).alias("low"), (F.col("mine") == F.col("other")).alias("same"), "root", "raw")
    reach = float(np.arccos(threshold)) + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and held[-1].column(0)[0].as_py() != key[a]:
                    yield compare(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield compare(held)

    def blocks(root: np.ndarray, raw: list[bytes]) -> tuple:
        x = _cosine(np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1))
        edges = _blocks_of(root)
        return root, x, edges, *_bounds(x, edges)

    def compare(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(rows)
        low, same, root = (whole.column(i).to_numpy() for i in (1, 2, 3))
        raw = whole.column(4).to_pylist()
        sizes = np.array([len(r) for r in raw])
        joined: set[tuple[int, int]] = set()
        for dims in np.unique(sizes).tolist():
            sides = [np.flatnonzero((sizes == dims) & side) for side in ([low] if same[0] else [low, ~low])]
            if all(len(at) for at in sides):
                made = [blocks(root[at], [raw[i] for i in at]) for at in sides]
                meet(made[0], made[-1], joined)
        u, v = zip(*joined, strict=True) if joined else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def meet(one: tuple, two: tuple, joined: set[tuple[int, int]]) -> None:
        root_a, x, edges_a, centre_a, angle_a = one
        root_b, y, edges_b, centre_b, angle_b = two
        for a in range(0, len(angle_a), BLOCK):
            for b in range(0, len(angle_b), BLOCK):
                apart = np.arccos(np.clip(centre_a[a : a + BLOCK] @ centre_b[b : b + BLOCK].T, -1, 1))
                room = apart <= angle_a[a : a + BLOCK, None] + angle_b[None, b : b + BLOCK] + reach
                for i, j in zip(*(k.tolist() for k in np.nonzero(room)), strict=True):
                    (i0, i1), (j0, j1) = edges_a[a + i : a + i + 2], edges_b[b + j : b + j + 2]
                    pair = int(root_a[i0]), int(root_b[j0])
                    if pair[0] != pair[1] and pair not in joined and (x[i0:i1] @ y[j0:j1].T >= threshold).any():
                        joined.add(pair)

    met = cells.repartition("cell").sortWithinPartitions("cell", "root").mapInArrow(run, "u long, v long")
    return stored(met.distinct(), "across-links")


def _audit(nodes: DataFrame, roots: DataFrame, threshold: float, sample: int, turn: int, many: int) -> tuple[float, int, DataFrame]:
    """Recall of the links of ``sample`` vectors, found by brute force: met if both ends lie in one group. With links missed; and all links.

    Each turn takes other vectors, so none that an earlier turn repaired. The share of links met is averaged over vectors, apart for those
    with at most ``many`` links and those with more; the lower average counts, so that a large group does not hide small ones.
    """
    order = nodes.select("id", "raw").orderBy(F.xxhash64("id"), "id")
    picked = order.offset(turn * sample).limit(sample).collect()
    by_dims: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dims in {len(r["raw"]) for r in picked}:
        own = [r for r in picked if len(r["raw"]) == dims]
        rows = np.frombuffer(b"".join(bytes(r["raw"]) for r in own), np.float64).reshape(len(own), -1)
        by_dims[dims] = np.array([r["id"] for r in own]), _cosine(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = np.array([len(r) for r in raw])
            for dims in np.unique(sizes).tolist():
                if dims not in by_dims:
                    continue
                asked, queries = by_dims[dims]
                at = np.flatnonzero(sizes == dims)
                x = _cosine(np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), -1))
                q, r = np.nonzero(queries @ x.T >= threshold)
                pairs = np.stack([asked[q], ids[at][r]])
                pairs = pairs[:, pairs[0] != pairs[1]]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

    true = stored(nodes.select("id", "raw").mapInArrow(run, "u long, v long"), "audit")
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    joined = true.join(of("u"), "u", "left").join(of("v"), "v", "left")
    met = F.coalesce(F.col("root_u") == F.col("root_v"), F.lit(False))
    of_each = joined.groupBy("u").agg(F.count("*").alias("all"), F.count_if(met).alias("met"))
    rows = of_each.groupBy(F.col("all") > many).agg(F.avg(F.col("met") / F.col("all")).alias("share"), F.sum(F.col("all") - F.col("met")).alias("missed")).collect()
    return min((r["share"] for r in rows), default=1.0), sum(r["missed"] for r in rows), true


def _roots(links: DataFrame) -> DataFrame:
    return stored(components(links.select(F.col("u").alias("a"), F.col("v").alias("b"))), "vector-roots")


def _joined(links: DataFrame, roots: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links with what else was found, and the roots of both; ``roots`` as it is if nothing was."""
    if found.isEmpty():
        return links, roots
    links = links.unionByName(found)
    return links, _roots(links)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.98, rounds: int = ROUNDS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``, by cosine in double precision.

    Equal vectors are one node with its number of copies. Null and zero vectors, vectors with null or non-finite numbers and rows without
    vec_id link with nothing; vectors of different lengths never link. component_id is the smallest vec_id that links reach, itself
    included; kept: whether that is the row's own. Other columns are not read. Groups larger than a list are compared with one another
    exactly. If the audit finds a recall below ``recall``, lists start wider and the search is done again with what it found, twice at
    most; each try is audited on other vectors. If the last one falls short too, all groups are compared exactly.
    """
    kind = dict(vectors.dtypes)["vec_id"]
    hashes = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit("vec"), "embedding").alias("h2")]
    rows = vectors.select("vec_id", "embedding", *hashes)
    nodes = stored(_classes(rows), "vectors")
    near, grown = NEAREST, GROWN
    edges = _first_graph(nodes, ORDERS, AHEAD)
    units = stored(_signs(nodes, 1).select("id", "unit"), "units")
    total = nodes.count()
    more = None
    for turn in range(3):
        pairs = _both_ways(edges.where("u <> v")).groupBy("u", "v").agg(F.max("sim").alias("sim"))
        lists = stored(_nearest(pairs, threshold, near, grown).withColumn("fresh", F.lit(True)), "lists")
        for _ in range(rounds):
            found = _local_join(lists, units, threshold, near, grown)
            old = lists.withColumn("fresh", F.lit(False))
            both = old.unionByName(found.withColumn("fresh", F.lit(True)))
            merged = both.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
            last, lists = lists, stored(_nearest(merged, threshold, near, grown), "lists")
            discard(last)
            if lists.where("fresh").count() <= total * near // 500:
                break
        close = lists.where(F.col("sim") >= threshold - 1e-4).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        links = _exact(close, nodes, threshold)
        links = stored(links if more is None else links.unionByName(more), "vector-links")
        roots = _roots(links)
        # A link leaves both its lists only if both are full of links, so both ends are in groups larger than a list.
        large = roots.groupBy("root").count().where(F.col("count") > grown)
        full = roots.join(large.select("root"), "root").join(nodes.withColumnRenamed("id", "node"), "node").select("root", F.col("node").alias("id"), "raw")
        links, roots = _joined(links, roots, _across(full, threshold, large.count()))
        share, missed, true = _audit(nodes, roots, threshold, AUDIT, turn, grown)
        if missed:
            links, roots = _joined(links, roots, true)
        if share >= recall:
            break
        near, grown = 2 * near, 2 * grown
        more = true if more is None else more.unionByName(true)
        edges = lists.select("u", "v", "sim").unionByName(true.withColumn("sim", F.lit(1.0))).unionByName(_first_graph(nodes, 2 * ORDERS, AHEAD))
    else:
        named = nodes.join(roots.withColumnRenamed("node", "id"), "id", "left").select(F.coalesce("root", "id").alias("root"), "id", "raw")
        links, roots = _joined(links, roots, _across(named, threshold, total))
    members = stored(roots.withColumnRenamed("node", "id").join(nodes, "id").select("root", "id", "copies", "raw"), "members")
    counts = _link_counts(members, threshold)
    least = members.groupBy("root").agg(F.min("id").alias("component_id"))
    grouped = members.select("root", "id").join(least, "root").join(counts, "id").select("id", "component_id", "others")
    named = nodes.select("h1", "h2", "id", "copies").join(grouped, "id", "left")
    named = stored(
        named.select(
            "h1",
            "h2",
            (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"),
            F.coalesce("component_id", "id").cast(kind).alias("component_id"),
        ),
        "vector-classes",
    )
    e = F.col("embedding")
    joins = F.col("vec_id").isNotNull() & e.isNotNull()
    out = rows.withColumn("_joins", joins).select("vec_id", "h1", "h2", "_joins")
    same = (out["h1"] == named["h1"]) & (out["h2"] == named["h2"]) & out["_joins"]
    component = F.coalesce("component_id", "vec_id")
    return out.join(named, same, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
