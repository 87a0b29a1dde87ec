"""The most similar vectors of every vector, by low-dimensional stable projections in kd-trees.

Method: Gaussian (2-stable) projections keep distances: of two vectors at distance d, each projected coordinate
differs by a normal variate of deviation d, so that the squared difference over d squared is chi-square
distributed. Each of several trees halves the space at medians of other projected coordinates, fitted on a
bounded sample. First each vector is compared with all others of its home cell, which verifies its nearest ones.
Then the distance of the k-th verified one (that of `least` where there are fewer) drives the stopping test: the
vector visits further cells and trees while the probability that a partner at that distance was missed (by one
chi-square test of one degree of freedom for each plane between them) is `miss` or more. What is left open after
all trees is closed in the first one, cell by cell. All vectors of a cell are compared. Equal vectors are one class
from the start, so copies never meet in a cell.

A test on the ball around a vector, of all coordinates at once, holds far later than the product of the tests on
the planes of the cells visited, so the latter is the one that stops.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lavra.session import materialize

#: Vectors sampled to fit the planes: so many for each cell, within these bounds; and those a cell should hold.
PER_CELL, SAMPLE_LEAST, SAMPLE_MOST, CELL = 32, 5_000, 200_000, 4096
#: Trees at most, probability of missing a partner at the least similarity, the same (as a part of it) at the distance of
#: the k-th verified one, where it costs less, and the least probability of a visited cell.
TREES, MISS, CLOSER, FAINT = 24, 0.03, 0.05, 0.12
#: Distinct (modelo, dimension) indexes whose planes the driver holds at once; more take further turns.
INDEXES = 2000
#: Candidates of one visit, as a multiple of k, from which half floats are too coarse to cut them.
VAGUE = 4


def _phi(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to about 1e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(z) / math.sqrt(2))
    erf = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z / 2)
    return np.where(z >= 0, (1 + erf) / 2, (1 - erf) / 2)


class Tree:
    """Planes of a complete binary tree over projected coordinates, level by level."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.axes = rng.standard_normal((sample.shape[1], max(depth, 1))).astype(np.float32)
        self.depth = depth
        self.cuts = []
        x = sample @ self.axes
        node = np.zeros(len(sample), np.int64)
        for level in range(depth):
            cut = np.zeros(1 << level, np.float32)
            order = np.argsort(node, kind="stable")
            for k, part in enumerate(np.split(order, np.searchsorted(node[order], np.arange(1, 1 << level)))):
                cut[k] = np.median(x[part, level]) if len(part) else 0.0
            self.cuts.append(cut)
            node = node * 2 + (x[:, level] > cut[node])

    def home(self, vectors: np.ndarray) -> np.ndarray:
        """The cell that each vector lies in."""
        x, cell = vectors @ self.axes, np.zeros(len(vectors), np.int64)
        for level in range(self.depth):
            cell = cell * 2 + (x[:, level] > self.cuts[level][cell])
        return cell

    def visits(self, vectors: np.ndarray, distance: np.ndarray, faint: float = FAINT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, cells, probabilities that a partner at the row's `distance` lies there, and whether it is the row's
        own; cells less probable than `faint` are left out, but for the own one."""
        row = np.arange(len(vectors))
        cell, mass, home = np.zeros(len(row), np.int64), np.ones(len(row), np.float32), np.ones(len(row), bool)
        x = vectors @ self.axes
        distance = np.broadcast_to(np.asarray(distance, np.float32), len(row))
        for level in range(self.depth):
            far = x[row, level] - self.cuts[level][cell]
            right = far > 0
            stay = _phi(np.abs(far) / distance[row]).astype(np.float32)
            row, cell = np.concatenate([row, row]), np.concatenate([cell * 2 + right, cell * 2 + ~right])
            mass, home = np.concatenate([mass * stay, mass * (1 - stay)]), np.concatenate([home, np.zeros(len(home), bool)])
            keep = home | (mass >= faint)
            row, cell, mass, home = row[keep], cell[keep], mass[keep], home[keep]
        return row, cell, mass, home

    def all_visits(self, vectors: np.ndarray, distance: np.ndarray, miss: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and cells in falling order of probability until only `miss` is left, however many cells that takes."""
        step = max(1, 1_000_000 >> self.depth)
        for at in range(0, len(vectors), step):
            row, cell, mass, _ = self.visits(vectors[at : at + step], distance[at : at + step], miss / (2 << self.depth))
            order = np.lexsort((-mass, row))
            row, cell, mass = row[order], cell[order], mass[order].astype(np.float64)
            total = np.cumsum(mass) - mass
            before = total - total[np.searchsorted(row, row, "left")]
            keep = before < 1 - miss
            yield at + row[keep], cell[keep]


def _class_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, modelo, vetor): usable vectors with their dimension, their unit vector as half floats, and a key
    that equal directions share."""
    for batch in batches:
        ids, models = batch.column(0), batch.column(1).to_pylist()
        keep, dims, keys, packed = [], [], [], []
        for i, v in enumerate(batch.column(2).to_pylist()):
            if not v or any(x is None for x in v):
                continue
            a = np.asarray(v, np.float64)
            norm = np.sqrt((a * a).sum())
            if not np.isfinite(norm) or norm == 0:
                continue
            a /= norm
            keep.append(i)
            dims.append(len(a))
            keys.append(xxhash.xxh3_128_digest(f"{models[i]}\x00{len(a)}\x00".encode() + np.round(a * 1e6).astype(np.int32).tobytes()))
            packed.append(a.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(keep, pa.int64())), pa.array([models[i] for i in keep], pa.string()), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())],
            names=["id", "modelo", "dim", "classe", "v"],
        )


class Forest:
    """The trees of one index, and the parts that the vectors at home in a cell are dealt to."""

    def __init__(self, sample: np.ndarray, count: int, cell: int, trees: int) -> None:
        depth = max(0, math.ceil(math.log2(max(1, count / cell))))
        depth = min(depth, max(0, int(math.log2(max(1, len(sample) / 8)))))
        self.trees = [Tree(sample, depth, t) for t in range(trees if depth else 1)]
        self.parts = max(1, math.ceil(count / (1 << depth) / (2 * cell)))


_VISITS = "celula string, rep long, casa boolean, visita boolean, v binary, erro double"


def _deal(forests: dict[tuple[str, int], Forest], distance: float, miss: float, first: bool, whole: bool):
    """Of (rep, modelo, dim, v, alcance): the cells where each vector is at home or visits.

    The `first` time every vector visits its home cell of the first tree. Then `alcance`, the distance of its k-th
    verified partner where it has so many, tells how far it goes on: visits end when the probability that a partner
    at that distance was missed is below `miss`. A vector that all trees leave open visits the cells of the first
    tree until that holds. `whole` vectors go as single floats, others as half floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple[str, int], list[int]] = {}
            for i, k in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                groups.setdefault(k, []).append(i)
            reps = np.asarray(batch.column(0).to_pylist(), np.int64)
            blobs = batch.column(3).to_pylist()
            reach = np.asarray([distance if x is None else min(x, distance) for x in batch.column(4).to_pylist()])
            for (model, dim), at in groups.items():
                at, forest = np.asarray(at), forests[(model, dim)]
                m = np.stack([np.frombuffer(blobs[i], np.float32) for i in at])
                half = m.astype(np.float16)
                lost = np.zeros(len(m)) if whole else np.linalg.norm(m.astype(np.float64) - half, axis=1)
                packed = [(x if whole else y).tobytes() for x, y in zip(m, half)]
                part = reps[at] % forest.parts

                def rows(t: int, who: np.ndarray, cell: np.ndarray, home: np.ndarray, visit: np.ndarray) -> Iterator[pa.RecordBatch]:
                    # a vector is at home in one part of its cell; visitors go to all of them
                    for p in range(forest.parts):
                        own = home & (part[who] == p)
                        go = own | visit
                        if go.any():
                            w, c = who[go], cell[go]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([f"{model}\x00{dim}\x00{t}\x00{x}\x00{p}" for x in c.tolist()], pa.string()), pa.array(reps[at[w]]), pa.array(own[go]), pa.array(visit[go]), pa.array([packed[i] for i in w.tolist()], pa.binary()), pa.array(lost[w])],
                                names=["celula", "rep", "casa", "visita", "v", "erro"],
                            )

                everyone, yes = np.arange(len(at)), np.ones(len(at), bool)
                if first:
                    yield from rows(0, everyone, forest.trees[0].home(m), yes, yes)
                    continue
                if forest.trees[0].depth == 0:
                    continue
                limit = reach[at]
                near = limit < distance
                bound = np.where(near, miss * CLOSER, miss)
                # `wide`: as much as is left at the least similarity; so long a vector stays at home in further trees
                wide, left = np.ones(len(at)), np.ones(len(at))
                for t, tree in enumerate(forest.trees):
                    open_ = np.flatnonzero((wide > miss) | (left > bound) if t else yes)
                    if not len(open_):
                        break
                    row, cell, mass, home = tree.visits(m[open_], distance)
                    wide[open_] *= np.clip(1 - np.bincount(row, mass, len(open_)), 0, 1)
                    who = open_[row]
                    far = ~near[who] & (left[who] > miss)  # rows without k partners go as far as the least similarity
                    visit = far & (~home if t == 0 else True)
                    keep = home | visit
                    yield from rows(t, who[keep], cell[keep], home[keep], visit[keep])
                    left[~near] = wide[~near]
                    close = np.flatnonzero(near & (left > bound))
                    if len(close):
                        row, cell, mass, home = tree.visits(m[close], limit[close])
                        visit = ~home if t == 0 else np.ones(len(row), bool)
                        yield from rows(t, close[row][visit], cell[visit], np.zeros(visit.sum(), bool), np.ones(visit.sum(), bool))
                        left[close] *= np.clip(1 - np.bincount(row, mass, len(close)), 0, 1)
                rest = np.flatnonzero(left > bound)
                for row, cell in forest.trees[0].all_visits(m[rest], limit[rest], miss * CLOSER):
                    yield from rows(0, rest[row], cell, np.zeros(len(row), bool), np.ones(len(row), bool))

    return run


_FOUND = "a long, b long, alcance double, celula string"


def _found(a: list, b: list, reach: tuple = ((), ()), vague: tuple = ((), ())) -> pa.Table:
    """Pairs; then the distance at place k of each visitor that has one; then visits whose cut is vague."""
    pair_a, pair_b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
    n, r, w = len(pair_a), len(reach[0]), len(vague[0])
    columns = {
        "a": [pa.array(np.minimum(pair_a, pair_b), pa.int64()), pa.array(reach[0], pa.int64()), pa.array(vague[0], pa.int64())],
        "b": [pa.array(np.maximum(pair_a, pair_b), pa.int64()), pa.nulls(r + w, pa.int64())],
        "alcance": [pa.nulls(n, pa.float64()), pa.array(reach[1], pa.float64()), pa.nulls(w, pa.float64())],
        "celula": [pa.nulls(n + r, pa.string()), pa.array(vague[1], pa.string())],
    }
    return pa.table({name: pa.chunked_array(parts) for name, parts in columns.items()})


def _search(most: int, least: float):
    """The pairs of one cell: of each visitor, those at home there that can be among its `most` most similar, whose
    half-float cosine is within the error of both of the one at place `most`. Where these are more than `VAGUE` times
    `most`, as in a family of nearly equal vectors, the visit is named instead, to be made with single floats."""
    slack = 0.002  # of half floats

    def run(table: pa.Table) -> pa.Table:
        rep, home, visit = (np.asarray(table.column(c)) for c in ("rep", "casa", "visita"))
        if not home.any() or not visit.any():
            return _found([], [])
        cell = table.column("celula")[0].as_py()
        m = np.stack([np.frombuffer(b, np.float16) for b in table.column("v").to_pylist()]).astype(np.float32)
        data, data_rep = m[home], rep[home]
        lost = np.asarray(table.column("erro"))
        far = lost[home].max(initial=0.0)
        noise = lost + (1 + lost) * far + m.shape[1] * 2.0**-23  # of a cosine: both vectors' rounding, and the sum's
        guests = np.flatnonzero(visit)
        out_a, out_b, near, reach, vague = [], [], [], [], []
        step = max(64, 8_000_000 // max(1, len(data)))  # bounds the block of similarities
        for q in range(0, len(guests), step):
            block = guests[q : q + step]
            s = m[block] @ data.T
            i, j = np.nonzero(s >= least - slack)
            other = rep[block[i]] != data_rep[j]
            i, j = i[other], j[other]
            if not len(i):
                continue
            value = s[i, j]
            order = np.lexsort((data_rep[j], -value, i))
            i, j, value = i[order], j[order], value[order]
            first = np.searchsorted(i, i, "left")
            last = np.minimum(first + most - 1, len(i) - 1)
            full = i[last] == i
            floor = np.where(full, value[last] - 2 * noise[block[i]], -1.0)
            top = (np.arange(len(i)) - first < most) | (value >= floor)
            many = np.bincount(i[top], minlength=len(block)) > VAGUE * most
            top &= ~many[i]
            out_a.append(rep[block[i[top]]]), out_b.append(data_rep[j[top]])
            vague += rep[block[many]].tolist()
            at = np.flatnonzero(full & (np.arange(len(i)) == first))
            near += rep[block[i[at]]].tolist()
            reach += np.sqrt(np.maximum(2 - 2 * (value[last[at]] - noise[block[i[at]]]), 0)).tolist()
        return _found(out_a, out_b, (near, reach), (vague, [cell] * len(vague)))

    return run


def _search_whole(most: int, least: float):
    """The same from single floats, compared in double precision and cut at place `most`."""

    def run(table: pa.Table) -> pa.Table:
        rep, home, visit = (np.asarray(table.column(c)) for c in ("rep", "casa", "visita"))
        m = np.stack([np.frombuffer(b, np.float32) for b in table.column("v").to_pylist()]).astype(np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        data, data_rep = m[home], rep[home]
        order = np.argsort(data_rep)
        data, data_rep = data[order], data_rep[order]
        guests = np.flatnonzero(visit)
        out_a, out_b = [], []
        step = max(16, 2_000_000 // max(1, len(data)))
        for q in range(0, len(guests), step):
            block = guests[q : q + step]
            s = np.round(m[block] @ data.T, 12)
            s[rep[block][:, None] == data_rep] = -2
            best = np.argsort(-s, axis=1, kind="stable")[:, :most]
            value = np.take_along_axis(s, best, 1)
            i, j = np.nonzero(value >= least - 1e-9)
            out_a.append(rep[block[i]]), out_b.append(data_rep[best[i, j]])
        return _found(out_a, out_b)

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cos = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.float32).astype(np.float64), np.frombuffer(y, np.float32).astype(np.float64)
            cos.append(float(np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y))))  # single floats aren't quite of length 1
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cos, pa.float64())], names=["a", "b", "cosseno"])


def _forests(classes: DataFrame, cell: int, trees: int) -> dict[tuple[str, int], Forest]:
    sizes = classes.groupBy("modelo", "dim").count().collect()
    total = sum(r["count"] for r in sizes)
    sample = min(SAMPLE_MOST, max(SAMPLE_LEAST, PER_CELL * total // cell))
    share = min(1.0, sample / max(1, total))
    drawn = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_003)) < math.ceil(1_000_003 * share)).select("modelo", "dim", "v").limit(2 * sample)
    picked: dict[tuple[str, int], list[bytes]] = {}
    if any(r["count"] > cell for r in sizes):  # others have a single cell
        for r in drawn.collect():
            picked.setdefault((r["modelo"], r["dim"]), []).append(r["v"])
    forests = {}
    for r in sizes:
        key = (r["modelo"], r["dim"])
        m = np.stack([np.frombuffer(x, np.float32) for x in picked[key]]) if picked.get(key) else np.zeros((0, r["dim"]), np.float32)
        forests[key] = Forest(m, r["count"], cell, trees)
    return forests


def class_pairs(classes: DataFrame, k: int, least: float, cell: int = CELL, miss: float = MISS, trees: int = TREES, indexes: int = INDEXES) -> DataFrame:
    """Pairs (a, b, cosseno; a < b) of distinct vectors (rep, modelo, dim, v) at or above `least`, holding the
    `k` most similar of each but for a share of about `miss` at the least similarity, fewer above it."""
    distance = math.sqrt(2 - 2 * least)
    turns = max(1, math.ceil(classes.select("modelo", "dim").distinct().count() / indexes))
    parts = []
    for turn in range(turns):  # the driver holds the planes of so many indexes at once
        mine = classes.where(F.pmod(F.xxhash64("modelo", "dim"), F.lit(turns)) == turn) if turns > 1 else classes
        forests = _forests(mine, cell, trees)
        rows = mine.select("rep", "modelo", "dim", "v")
        start = rows.withColumn("alcance", F.lit(None).cast("double"))
        deal = lambda of, first, whole: of.mapInArrow(_deal(forests, distance, miss, first, whole), _VISITS)  # noqa: B023, E731
        home = materialize(deal(start, True, False).groupBy("celula").applyInArrow(_search(k, least), _FOUND), "em_casa")
        found = home
        going = start
        if any(f.trees[0].depth or f.parts > 1 for f in forests.values()):
            # of several parts of a home cell, the one with the nearest k-th partner tells most
            reach = home.where("alcance is not null").groupBy(F.col("a").alias("rep")).agg(F.min("alcance").alias("alcance"))
            going = rows.join(reach, "rep", "left").select("rep", "modelo", "dim", "v", "alcance")
            found = home.unionByName(materialize(deal(going, False, False).groupBy("celula").applyInArrow(_search(k, least), _FOUND), "vizinhos"))
        pairs = found.where("b is not null").select("a", "b")
        vague = found.where("celula is not null").select("celula", F.col("a").alias("rep")).distinct()
        if not vague.isEmpty():
            again = deal(start, True, True).unionByName(deal(going, False, True))
            guests = again.join(vague.withColumn("vaga", F.lit(True)), ["celula", "rep"], "left").withColumn("visita", F.coalesce("vaga", F.lit(False))).drop("vaga")
            asked = guests.where("casa or visita").join(vague.select("celula").distinct(), "celula", "left_semi")
            once = asked.groupBy("celula", "rep").agg(F.max("casa").alias("casa"), F.max("visita").alias("visita"), F.first("v").alias("v"), F.first("erro").alias("erro"))
            pairs = pairs.unionByName(once.groupBy("celula").applyInArrow(_search_whole(k, least), _FOUND).select("a", "b"))
        parts.append(pairs)
    found = reduce(DataFrame.unionByName, parts).distinct()
    vector = classes.select("rep", "v")
    both = found.join(vector.withColumnsRenamed({"rep": "a", "v": "va"}), "a").join(vector.withColumnsRenamed({"rep": "b", "v": "vb"}), "b")
    return both.select("a", "b", "va", "vb").mapInArrow(_exact, "a long, b long, cosseno double").where(F.col("cosseno") >= least - 1e-9)


def nearest(passagens: DataFrame, k: int = 10, least: float = 0.90, **limits: float) -> DataFrame:
    """For each usable vector its up to `k` most similar passages of the same modelo with a cosine of at least
    `least`: passagem_id, vizinha, posicao (from 1), cosseno. Ties go to the lower passagem_id.

    Unusable are null, empty, zero and infinite vectors, such with null elements, and null modelos; vectors of
    another dimension are another index. A passage delivered twice counts once. Copies of a vector are one
    class: each takes the lowest ids of its own class, then those of the classes around it."""
    rows = passagens.where("passagem_id is not null and modelo is not null and size(vetor) > 0").select(F.col("passagem_id").cast("long").alias("id"), "modelo", "vetor").dropDuplicates(["id"])
    keyed = materialize(rows.mapInArrow(_class_key, "id long, modelo string, dim int, classe binary, v binary"), "vetores")
    lowest = F.slice(F.array_sort(F.collect_list("id")), 1, k + 1)
    # the k + 1 lowest ids of each class, by partial groups first: a class may hold a third of all rows
    part = keyed.groupBy("classe", F.pmod(F.xxhash64("id"), F.lit(64)).alias("parte")).agg(F.first("modelo").alias("modelo"), F.first("dim").alias("dim"), F.first("v").alias("v"), lowest.alias("ids"))
    classes = materialize(
        part.groupBy("classe").agg(F.first("modelo").alias("modelo"), F.first("dim").alias("dim"), F.first("v").alias("v"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")).withColumn("rep", F.element_at("ids", 1)),
        "classes",
    )
    pairs = class_pairs(classes, k, least, **limits)
    directed = pairs.select("a", "b", "cosseno").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosseno"))
    # the k nearest classes hold the k nearest passages; ranks are cut within partitions before they are shuffled
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosseno"), "b"))
    closest = directed.withColumn("lugar", rank).where(F.col("lugar") <= k).drop("lugar")
    ids = classes.select(F.col("rep").alias("b"), F.slice("ids", 1, k).alias("ids_b"))
    around = closest.join(ids, "b").groupBy("a").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("ids_b", lambda i: F.struct((-F.col("cosseno")).alias("c"), i.alias("i")))))), 1, k).alias("outras"))
    members = keyed.select("id", "classe").join(classes.select("classe", "rep", "ids"), "classe").join(around.withColumnRenamed("a", "rep"), "rep", "left")
    own = F.transform(F.filter("ids", lambda i: i != F.col("id")), lambda i: F.struct(F.lit(-1.0).alias("c"), i.alias("i")))
    all_ = F.slice(F.concat(own, F.coalesce("outras", F.array().cast("array<struct<c:double,i:bigint>>"))), 1, k)
    out = members.where("size(ids) > 1 or outras is not null").select(F.col("id").alias("passagem_id"), F.posexplode(all_).alias("p", "x"))
    return out.select("passagem_id", F.col("x.i").alias("vizinha"), (F.col("p") + 1).alias("posicao"), F.least(-F.col("x.c"), F.lit(1.0)).alias("cosseno"))


def similar_pairs(passagens: DataFrame, k: int = 10, least: float = 0.90, **limits: float) -> DataFrame:
    """Pairs passagem_a < passagem_b at or above `least`, one of which is among the other's `k` most similar."""
    near = nearest(passagens, k, least, **limits)
    return near.select(F.least("passagem_id", "vizinha").alias("passagem_a"), F.greatest("passagem_id", "vizinha").alias("passagem_b")).distinct()
