"""Near-duplicate embeddings by NN-descent.

A neighbour graph starts from cells of random hyperplanes and is refined by joins of neighbours of neighbours: every vector
brings its neighbours, forward and backward, together, and each of them keeps the best it has met. Wherever vectors meet,
those that reach the threshold are also noted as connected, by a star to the least of them, so that links beyond the ends
of the lists aren't lost. A vector whose list is full of links is saturated: its list is enlarged to its whole connected
group, which is compared in blocks, all pairs, and counted where it is compared. Two samples of the vectors of every
label that cells divide, one of all and one of those with a near neighbour, are compared with all rows of the label to audit recall; while
links are missed, further cells are drawn and lists that are full of links are let grow. After SEARCHES such rounds those labels are compared
all pairs, in blocks.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.operators.graph import components

from .common import written

THRESHOLD = 0.98
#: Neighbours in a list, hyperplane trees drawn at first and in each further round, rounds of descent at most.
K, TREES, MORE, ROUNDS = 10, 6, 4, 4
#: Vectors of a cell aimed at, and at most; of a block of a group; audited at once; brought together in a task's group.
CELL, LARGEST, BLOCK, AUDITED, TOGETHER = 128, 512, 512, 256, 2000
#: Audits that may miss links before all pairs are compared; how near a neighbour makes a vector one to audit; rows that meet audited ones at once, and of these.
SEARCHES, NEAR, SLICE, ABREAST = 6, 0.03, 20_000, 1024

log = logging.getLogger(__name__)


def _matrix(column) -> np.ndarray:
    """Unit vectors in double precision, from a list column of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _stars(linked: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id that it is connected with) for the rows of a link matrix that have links."""
    root = ids.copy()
    some = np.flatnonzero(linked.any(1))
    if not len(some):
        return ids[:0], ids[:0]
    sub = linked[np.ix_(some, some)]
    r = root[some]
    while True:
        new = np.minimum(r, np.where(sub, r[None, :], r[:, None]).min(1))
        if (new == r).all():
            return ids[some], r
        r = new


def _met(ids: np.ndarray, x: np.ndarray, worst: np.ndarray | None, k: int, threshold: float) -> list[np.ndarray]:
    """What vectors that meet give: columns a, b, sim of list entries, then of stars, for which sim is null (NaN)."""
    sim = np.clip(x @ x.T, -1, 1)
    np.fill_diagonal(sim, -2)
    n = min(k, len(ids) - 1)
    if n < 1:
        return []
    top = np.argpartition(-sim, n - 1, axis=1)[:, :n]
    a, b, s = np.repeat(np.arange(len(ids)), n), top.ravel(), np.take_along_axis(sim, top, 1).ravel()
    if worst is not None:
        better = s > worst[a]
        a, b, s = a[better], b[better], s[better]
    u, r = _stars(sim >= threshold, ids)
    other = u != r
    return [np.concatenate([ids[a], u[other]]), np.concatenate([ids[b], r[other]]), np.concatenate([s, np.full(other.sum(), np.nan)])]


ENTRIES = "a long, b long, sim double"


def _buckets(rows: int) -> int:
    """Groups to deal rows into, so that small cells don't make small batches and no group grows with the table."""
    return max(512, rows // TOGETHER)


def _table(parts: list[list[np.ndarray]]) -> pa.Table:
    parts = [p for p in parts if p]
    cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    return pa.table([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2], pa.float64(), from_pandas=True)], ["a", "b", "sim"])


def _from_cells(nodes: DataFrame, size: int, trees: range, k: int, threshold: float) -> DataFrame:
    """Entries and stars from the cells of random hyperplanes, ``bits`` of them for a vector, as its label needs; a cell of more than LARGEST is dealt out at random."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                x, some = _matrix(own.column("vec")), own.column("bits").to_numpy()
                bits = int(some.max())
                for tree in trees:
                    planes = np.random.default_rng((int(dim), tree)).standard_normal((max(1, bits), int(dim))).T
                    # A label of fewer vectors takes the first planes only.
                    codes = ((x @ planes > 0) * (1 << np.arange(max(1, bits)))).sum(1) if bits else np.zeros(len(x), np.int64)
                    codes &= (1 << some.astype(np.int64)) - 1
                    yield pa.RecordBatch.from_arrays([own.column("label"), own.column("dim"), pa.array([tree] * len(x), pa.int32()), pa.array(codes.astype(np.int64)), own.column("id"), own.column("vec")], ["label", "dim", "tree", "code", "id", "vec"])

    kind = nodes.schema
    schema = f"label {kind['label'].dataType.simpleString()}, dim int, tree int, code long, id long, vec {kind['vec'].dataType.simpleString()}"
    coded = nodes.select("label", "dim", "bits", "id", "vec").mapInArrow(code, schema)
    cell = ["label", "dim", "tree", "code"]
    sized = nodes.select("label", "dim", "bits", "id", "vec").mapInArrow(code, schema).groupBy(*cell).count()
    part = F.when(F.col("count") > LARGEST, F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("count") / LARGEST))).otherwise(F.lit(0))
    coded = coded.join(sized, cell).withColumn("part", part)
    coded = coded.withColumn("group", F.xxhash64(*cell, "part")).withColumn("bucket", F.pmod("group", F.lit(_buckets(size * len(trees)))))

    def meet(t: pa.Table) -> pa.Table:
        groups = t.column("group").to_numpy()
        order = np.argsort(groups, kind="stable")
        t, groups = t.take(pa.array(order)), groups[order]
        cuts = np.append(np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))), len(groups))
        ids, out = t.column("id").to_numpy(), []
        for i, j in zip(cuts[:-1], cuts[1:]):
            if j - i > 1:
                out.append(_met(ids[i:j], _matrix(t.column("vec").slice(i, j - i)), None, k, threshold))
        return _table(out)

    return coded.select("bucket", "group", "id", "vec").groupBy("bucket").applyInArrow(meet, ENTRIES)


def _descend(lists: DataFrame, nodes: DataFrame, size: int, k: int, full: int, threshold: float) -> DataFrame:
    """Entries and stars from one join of neighbours of neighbours."""
    from pyspark.sql import Window

    # Backward neighbours, as many as a list holds and the nearest of them; forward lists are never cut.
    back = lists.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("sim"), "a"))).where(F.col("r") <= full)
    members = lists.select(F.col("a").alias("center"), F.col("b").alias("id")).unionAll(back.select(F.col("b").alias("center"), F.col("a").alias("id"))).unionAll(nodes.select(F.col("id").alias("center"), "id")).distinct()
    worst = lists.groupBy("a").agg(F.when((F.count("*") >= k) & (F.count("*") < full) & (F.min("sim") >= threshold), F.lit(threshold - 1e-9)).when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0)).alias("worst"))
    members = members.join(nodes.join(worst.withColumnRenamed("a", "id"), "id", "left").select("id", "vec", F.coalesce("worst", F.lit(-2.0)).alias("worst")), "id")
    members = members.withColumn("bucket", F.pmod(F.xxhash64("center"), F.lit(_buckets(size * 2 * full))))

    def meet(t: pa.Table) -> pa.Table:
        center = t.column("center").to_numpy()
        order = np.argsort(center, kind="stable")
        center, ids, worst = center[order], t.column("id").to_numpy()[order], t.column("worst").to_numpy()[order]
        x = _matrix(t.column("vec"))[order]
        cuts = np.append(np.flatnonzero(np.concatenate(([True], center[1:] != center[:-1]))), len(center))
        return _table([_met(ids[i:j], x[i:j], worst[i:j], full, threshold) for i, j in zip(cuts[:-1], cuts[1:]) if j - i > 1])

    return members.select("bucket", "center", "id", "worst", "vec").groupBy("bucket").applyInArrow(meet, ENTRIES)


def _best(entries: DataFrame, k: int, full: int, threshold: float) -> DataFrame:
    """The nearest k of each vector, and up to ``full`` that are links."""
    from pyspark.sql import Window

    once = entries.where("sim is not null").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    return once.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).where((F.col("r") <= k) | ((F.col("r") <= full) & (F.col("sim") >= threshold))).drop("r")


def _asked(nodes: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """Ids of the vectors to audit, of every label that cells divide: of all its vectors as many as their root, AUDITED at least; and
    AUDITED of those with a neighbour near the threshold or above it, so that links are seen however rare they are. Smaller labels are one cell, compared all pairs."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("label", "dim").orderBy("h", "id"))

    def drawn(of: DataFrame, n: Column, want: Column, salt: int) -> DataFrame:
        # From somewhat more than are needed, so that no window holds a label's whole table.
        some = of.withColumn("h", F.xxhash64("id", F.lit(salt))).where(F.shiftrightunsigned("h", 11) / float(1 << 53) * n <= 2 * want + 50)
        return some.withColumn("r", rank).where(F.col("r") <= want).select("id")

    large = nodes.where("bits > 0").select("id", "label", "dim", "n")
    beside = large.join(lists.where(F.col("sim") >= threshold - NEAR).select(F.col("a").alias("id")).distinct(), "id")
    beside = written(beside, "near-beside")
    near = beside.join(beside.groupBy("label", "dim").agg(F.count("*").alias("m")), ["label", "dim"])
    every = drawn(large, F.col("n"), F.greatest(F.lit(float(AUDITED)), F.sqrt("n")), 5)
    return written(every.unionAll(drawn(near, F.col("m"), F.lit(float(AUDITED)), 7)).distinct(), "near-asked")


def _audit(nodes: DataFrame, roots: DataFrame, threshold: float, asked: DataFrame) -> tuple[int, int]:
    """(links of the audited vectors with all rows of their label, those of them within one group). A label's rows are dealt into parts
    that each meet the label's audited vectors."""
    audited = nodes.join(asked, "id", "left_semi")
    parts = nodes.join(audited.select("label", "dim").distinct(), ["label", "dim"], "left_semi").groupBy("label", "dim").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("parts"))
    placed = nodes.select("id", "label", "dim", "vec").join(parts, ["label", "dim"]).join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rows = placed.withColumn("part", F.pmod(F.xxhash64("id", F.lit(6)), F.col("parts")).cast("int")).select("label", "dim", "part", "id", "root", "vec")
    queries = placed.join(asked, "id", "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    queries = queries.select(*(F.col(c).alias(c) for c in rows.columns))  # columns of their own, as both sides come from one table

    def meet(own: pa.Table, asking: pa.Table) -> pa.Table:
        true = found = 0
        if own.num_rows and asking.num_rows:
            x, ids, groups = _matrix(own.column("vec")), own.column("id").to_numpy(), own.column("root").to_numpy()
            for i in range(0, asking.num_rows, ABREAST):
                q = asking.slice(i, ABREAST)
                link = (x @ _matrix(q.column("vec")).T >= threshold) & (ids[:, None] != q.column("id").to_numpy()[None, :])
                true += int(link.sum())
                found += int((link & (groups[:, None] == q.column("root").to_numpy()[None, :])).sum())
        return pa.table([pa.array([true], pa.int64()), pa.array([found], pa.int64())], ["links", "found"])

    keys = ["label", "dim", "part"]
    met = rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(meet, "links long, found long")
    r = met.agg(F.coalesce(F.sum("links"), F.lit(0)), F.coalesce(F.sum("found"), F.lit(0))).first()
    return r[0], r[1]


def _all_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) that connect what links connect: all pairs of each label, block by block, each pair of blocks a star or several."""
    blocks = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = nodes.select("label", "dim", "id", "vec").join(blocks, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("id", F.lit(9)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("label", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "vec")

    def run(t: pa.Table) -> pa.Table:
        x, ids, first = _matrix(t.column("vec")), t.column("id").to_numpy(), t.column("own").to_numpy() == t.column("i").to_numpy()
        link = x @ x.T >= threshold
        if not first.all():  # two blocks: those of one have met elsewhere
            link &= first[:, None] != first[None, :]
        np.fill_diagonal(link, False)
        a, b = _stars(link, ids)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.groupBy("label", "dim", "i", "j").applyInArrow(run, "a long, b long").where("a <> b")


def _counts(nodes: DataFrame, size: int, roots: DataFrame, threshold: float) -> DataFrame:
    """(id, links): rows that link with a vector of a connected group, itself left out; all pairs in blocks."""
    grouped = nodes.join(roots.withColumnRenamed("node", "id"), "id")
    blocks = grouped.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = grouped.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "copies", "vec", "blocks")
    # Groups of one block share tasks; each pair of blocks of a larger one has its own.
    rows = rows.withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(_buckets(size)))).otherwise(F.xxhash64("root", "i", "j")))

    def run(t: pa.Table) -> pa.Table:
        roots, i, j, own, ids, copies = (t.column(c).to_numpy() for c in ("root", "i", "j", "own", "id", "copies"))
        out = []
        order = np.lexsort((j, i, roots))
        key = np.stack([roots[order], i[order], j[order]])
        cuts = np.append(np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0)))), len(order))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            at = order[lo:hi]
            x = _matrix(t.column("vec").take(pa.array(at)))
            left = own[at] == i[at]
            if i[at[0]] == j[at[0]]:
                link = x @ x.T >= threshold
                np.fill_diagonal(link, False)
                out.append((ids[at], link @ copies[at]))
            else:
                link = x[left] @ x[~left].T >= threshold
                out.append((ids[at][left], link @ copies[at][~left]))
                out.append((ids[at][~left], link.T @ copies[at][left]))
        return pa.table([pa.array(np.concatenate([o[k] for o in out]).astype(np.int64)) for k in (0, 1)], ["id", "links"])

    return rows.select("task", "root", "i", "j", "own", "id", "copies", "vec").groupBy("task").applyInArrow(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label", threshold: float = THRESHOLD, k: int = K, history: list | None = None) -> DataFrame:
    """Per row of ``vectors``: key, n_links, component_id and kept (the key is its component's).

    Only rows of equal, non-null labels and equal lengths are compared. Null keys, vectors that are null, empty or zero or
    hold null or non-finite components link with nothing and are their own component. Equal vectors of a label are one
    node with a count; rows with one key and one vector are rows of their own. An empty table gives no rows; other columns
    are ignored. history: gets (links of the audited rows, of these found) of each audit.
    """
    number = F.transform(F.col(vec), lambda v: v.cast("double"))
    norm = F.aggregate(number, F.lit(0.0), lambda s, v: s + v * v)
    fine = F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce((F.size(vec) > 0) & F.forall(number, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    fine = F.when(fine, (norm > 0) & (norm < float("inf"))).otherwise(F.lit(False))
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vec).alias("vec"), fine.alias("fine"))
    good = rows.where("fine").drop("fine")
    nodes = good.groupBy("label", "vec").agg(F.min("key").cast("long").alias("key"), F.count("*").alias("copies"))
    # Keys may repeat, so nodes have numbers of their own, fixed by writing them.
    nodes = written(nodes.withColumn("dim", F.size("vec")).withColumn("id", F.monotonically_increasing_id()), "vectors")
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    size = sizes.agg(F.sum("n")).first()[0] or 0
    celled = nodes.join(sizes.withColumn("bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / CELL))).cast("int")), ["label", "dim"])
    full, asked, searches = k, None, 0
    met = written(_from_cells(celled, size, range(TREES), k, threshold), "near-met")
    stars, lists, trees = met.where("sim is null").select("a", "b"), written(_best(met, k, full, threshold), "near-lists"), TREES
    while True:
        links = lists.where(F.col("sim") >= threshold).count()
        for _ in range(ROUNDS):
            met = written(_descend(lists, nodes, size, k, full, threshold), "near-met")
            stars = stars.unionAll(met.where("sim is null").select("a", "b"))
            lists = written(_best(lists.unionByName(met), k, full, threshold), "near-lists")
            before, links = links, lists.where(F.col("sim") >= threshold).count()
            if links == before:
                break
        edges = written(stars.unionAll(lists.where(F.col("sim") >= threshold).select("a", "b")).distinct(), "near-edges")
        roots = components(edges, contract=True)
        asked = _asked(celled, lists, threshold) if asked is None else asked
        true, found = _audit(nodes, roots, threshold, asked)
        log.info("audit: %d links of the audited vectors, %d of them found", true, found)
        if history is not None:
            history.append((true, found))
        if found == true:
            break
        searches += 1
        if searches == SEARCHES:
            edges = written(edges.unionAll(_all_links(celled.where("bits > 0"), threshold)).distinct(), "near-edges")
            roots = components(edges, contract=True)
            break
        full *= 2
        met = written(_from_cells(celled, size, range(trees, trees + MORE), full, threshold), "near-met")
        trees += MORE
        stars, lists = edges.unionAll(met.where("sim is null").select("a", "b")), written(_best(lists.unionByName(met), k, full, threshold), "near-lists")
    counted = _counts(nodes, size, roots, threshold)
    placed = nodes.join(roots.withColumnRenamed("node", "id"), "id", "left").join(counted, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = placed.groupBy("root").agg(F.min("key").alias("component_id"))
    placed = placed.join(least, "root").select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = good.join(placed, ["label", "vec"]).select(F.col("key").alias(key), "n_links", "component_id")
    alone = rows.where(~F.col("fine")).select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").cast("long").alias("component_id"))
    return out.unionAll(alone).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
