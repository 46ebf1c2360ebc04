"""Most similar vectors for every vector (problem 5), by stable projections and a kd-tree.

Vectors are brought to length 1 and projected by a few Gaussian (2-stable) directions: if
two vectors are r apart, their projections are apart by r times a chi-distributed factor.
The projections are indexed by a kd-tree. It is grown in rounds: every cell with more than
``cell`` vectors is split by a sample of its own (``sample`` rows at most a cell and round),
in a task of its own, until no cell is too large; so its depth follows from the data and
not from the sample, and every vector is put into a cell.

Within a cell, leaves are taken in the order of their projected distance from the asking
vectors. Of a leaf those vectors are verified by their true distance that the chi-square
test lets through, given the k-th distance so far; as that shrinks, the test stops more and
at last all. Other cells are visited if the probability that they hold a neighbour within
the radius is above a threshold. Where a radius is given from the start, visitors bring
their projections alone, a fifth of the bytes; what the test lets through for that radius
meets the full vectors by a join. Vectors that ask in a cell are divided among tasks by
their number, so a cell that many visit is no hot spot.

Exact copies are searched once: one representative with its least ``k + 1`` ids stands
for them, which is all that any list of k neighbours can use. Each copy has a list itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.session import cut_lineage

PROJECTIONS, CELL, SAMPLE, MISS, LEAF, MOST_ASKING = 12, 4000, 20_000, 0.004, 512, 20_000


def chi_square_quantile(p: float, m: int) -> float:
    """Wilson and Hilferty's approximation."""
    low, high = -8.0, 8.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < p else (low, mid)
    return m * max(0.0, 1 - 2 / (9 * m) + low * math.sqrt(2 / (9 * m))) ** 3


def directions(dims: int, m: int = PROJECTIONS, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, m)).astype(np.float32)


class Cells:
    """A kd-tree over the projections. A child is a node, or ``~cell`` for a cell."""

    def __init__(self) -> None:
        self.dim, self.at, self.child = np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros((0, 2), np.int64)
        self.root, self.n = -1, 1  # a single cell

    def split(self, cell: int, dims: list[int], ats: list[float], left: list[int], right: list[int]) -> None:
        """Puts a subtree (children from 0 are its nodes, -1 are cells) in the place of a cell, which becomes its first one."""
        base, free = len(self.dim), iter([cell, *range(self.n, self.n + len(dims))])
        own = [[c + base if c >= 0 else ~next(free) for c in pair] for pair in zip(left, right, strict=True)]
        if self.root == ~cell:
            self.root = base
        self.child[self.child == ~cell] = base
        self.dim, self.at = np.append(self.dim, np.array(dims, np.int32)), np.append(self.at, np.array(ats, np.float32))
        self.child = np.concatenate([self.child, np.array(own, np.int64)])
        self.n += len(dims)

    def home(self, p: np.ndarray) -> np.ndarray:
        node = np.full(len(p), self.root)
        while len(rows := np.flatnonzero(node >= 0)):
            at = node[rows]
            node[rows] = self.child[at, (p[rows, self.dim[at]] > self.at[at]).astype(int)]
        return ~node

    def visits(self, p: np.ndarray, radius: np.ndarray, miss: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for every other cell that holds a point ``radius`` away with probability ``miss`` at least."""
        rows, node, home, chance = np.arange(len(p)), np.full(len(p), self.root), np.ones(len(p), bool), np.ones(len(p))
        out_rows, out_cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(rows):
            leaf = node < 0
            out_rows.append(rows[leaf & ~home])
            out_cells.append(~node[leaf & ~home])
            rows, node, home, chance = rows[~leaf], node[~leaf], home[~leaf], chance[~leaf]
            gap = p[rows, self.dim[node]] - self.at[node]
            own = (gap > 0).astype(int)
            cross = chance * _tail(np.abs(gap) / np.maximum(radius[rows], 1e-6))
            go = cross >= miss
            rows, home = np.concatenate([rows, rows[go]]), np.concatenate([home, np.zeros(go.sum(), bool)])
            node = np.concatenate([self.child[node, own], self.child[node[go], 1 - own[go]]])
            chance = np.concatenate([chance, cross[go]])
        return np.concatenate(out_rows), np.concatenate(out_cells)


def subtree(points: np.ndarray, levels: int, least: int = 32) -> tuple[list[int], list[float], list[int], list[int]]:
    """Median splits of the widest direction, ``levels`` deep at most; a node with fewer than ``2 * least`` points isn't split."""
    dims, ats, left, right = [], [], [], []

    def grow(p: np.ndarray, level: int) -> int:
        if level == levels or len(p) < 2 * least:
            return -1
        d = int(np.argmax(p.var(axis=0)))
        at = float(np.median(p[:, d]))
        side = p[:, d] > at
        if side.all() or not side.any():
            return -1
        me = len(dims)
        dims.append(d)
        ats.append(at)
        left.append(-1)
        right.append(-1)
        left[me], right[me] = grow(p[~side], level + 1), grow(p[side], level + 1)
        return me

    grow(points, 0)
    return dims, ats, left, right


_GRID = np.linspace(0, 6, 601)
_TAIL = np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in _GRID])


def _tail(x: np.ndarray) -> np.ndarray:
    """P(N > x) for a standard normal N."""
    return np.interp(x, _GRID, _TAIL)


def _leaves(p: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows of the projections in the leaves of a kd-tree, at most ``size`` in each."""
    out, todo = [], [np.arange(len(p))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
        else:
            order = np.argsort(p[rows, int(np.argmax(p[rows].var(axis=0)))], kind="stable")
            todo += [rows[order[len(rows) // 2 :]], rows[order[: len(rows) // 2]]]
    return out


def search(queries: np.ndarray, base: np.ndarray, w: np.ndarray, k: int, radius: np.ndarray | float | None, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, base row, cosine distance to nine digits) of the k nearest of ``base``, of equal ones the first rows, none beyond ``radius`` (a cosine distance, one for all or one each)."""
    if not len(queries) or not len(base):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    factor = chi_square_quantile(stop, w.shape[1])
    pq, pb = (queries @ w).astype(np.float32), (base @ w).astype(np.float32)
    nq, nb = (pq * pq).sum(axis=1), (pb * pb).sum(axis=1)
    fine_q, fine_b = _fine(queries), _fine(base)
    most = np.full(len(queries), np.inf if radius is None else radius, np.float64)
    leaves = _leaves(pb, LEAF)
    centres = np.stack([pb[x].mean(axis=0) for x in leaves])
    out = []
    for asking in _leaves(pq, LEAF):
        best = np.full((len(asking), k), np.inf)
        who = np.full((len(asking), k), len(base), np.int64)
        limit = most[asking].copy()
        for leaf in (leaves[i] for i in np.argsort(((centres - pq[asking].mean(axis=0)) ** 2).sum(axis=1), kind="stable")):
            # The stopping test: what is projected beyond this is not likely to be closer than the k-th so far.
            able = nb[leaf] - 2 * (pq[asking] @ pb[leaf].T) + nq[asking, None] <= (2 * factor * np.maximum(limit, 5e-7))[:, None]
            rows = np.flatnonzero(able.any(axis=1))
            if not len(rows):
                continue
            able = able[rows]
            cols = np.flatnonzero(able.any(axis=0))
            d = np.where(able[:, cols], 1 - fine_q[asking[rows]] @ fine_b[leaf[cols]].T, np.inf)
            # All that may be as near as the k-th take part, so that equal distances are told apart by row.
            kth = np.minimum(limit[rows], np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.inf)
            i, j = np.nonzero((d <= kth[:, None] + 1e-9) & able[:, cols])
            near = np.maximum(np.round(d[i, j], 9), 0)
            ok = near <= most[asking[rows[i]]]
            i, j, near = rows[i[ok]], cols[j[ok]], near[ok]
            if not len(i):
                continue
            old = np.unique(i)
            row = np.concatenate([np.repeat(old, k), i])
            near, name = np.concatenate([best[old].ravel(), near]), np.concatenate([who[old].ravel(), leaf[j]])
            order = np.lexsort((name, near, row))
            row, near, name = row[order], near[order], name[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            first = place < k
            best[row[first], place[first]], who[row[first], place[first]] = near[first], name[first]
            limit[old] = np.minimum(most[asking[old]], best[old].max(axis=1))
        i, j = np.nonzero(np.isfinite(best))
        out.append((asking[i], who[i, j], best[i, j]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _fine(x: np.ndarray) -> np.ndarray:
    """Unit vectors with the length that 64 bits can give them."""
    x = x.astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _unit(raw: pd.Series) -> np.ndarray:
    x = np.stack([np.frombuffer(v, np.float32) for v in raw]) if len(raw) else np.zeros((0, 1), np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def unit_vectors(vectors: DataFrame, dims: int, key: str = "id", column: str = "embedding") -> DataFrame:
    """(id, v): every id with its unit vector.

    Rows with a null id or vector, with a null, infinite or missing element, or without
    length take no part; of an id's differing vectors the greatest counts.
    """
    fit = vectors.where(F.col(key).isNotNull() & (F.size(column) == dims)).select(F.col(key).cast("string").alias("id"), F.col(column).cast("array<float>").alias("e"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([np.asarray(v, np.float32) for v in b["e"]], np.float32).reshape(len(b), dims)
            norm = np.linalg.norm(x.astype(np.float64), axis=1)
            ok = np.isfinite(norm) & (norm > 0)
            unit = (x[ok] / norm[ok, None]).astype(np.float32)
            yield pd.DataFrame({"id": b["id"][ok], "v": [u.tobytes() for u in unit]})

    return fit.mapInPandas(run, "id string, v binary").groupBy("id").agg(F.max("v").alias("v"))


def distinct_vectors(vectors: DataFrame, dims: int, keep: int, key: str = "id", column: str = "embedding") -> DataFrame:
    """(rep, ids, v): the vectors of ``unit_vectors`` without copies; ``ids`` are the least ``keep`` ids that have it, ``rep`` the least."""
    return _copies(unit_vectors(vectors, dims, key, column), keep)


def _copies(rows: DataFrame, keep: int) -> DataFrame:
    rows = rows.withColumn("h", F.xxhash64("v")).withColumn("n", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("n") <= keep)
    return rows.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("rep"), "ids", "v")


def _per_cell(rows: DataFrame, cells) -> dict[int, int]:
    """How many rows fall into each cell; ``cells`` gives the cells of a batch of vectors. As many rows reach the driver as there are cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell, n = np.unique(cells(b), return_counts=True)
            yield pd.DataFrame({"cell": cell, "n": n})

    found = rows.mapInPandas(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    return dict(zip(found["cell"].tolist(), found["n"].tolist(), strict=True))


def grown(reps: DataFrame, w: np.ndarray, cell: int, sample: int) -> Cells:
    """A tree in which no cell has more than ``cell`` vectors, unless their projections can't be told apart."""
    tree, fixed = Cells(), set()
    counts = {0: reps.count()}
    while big := {c: n for c, n in counts.items() if n > cell and c not in fixed}:

        def placed(batches: Iterator[pd.DataFrame], tree=tree, big=big) -> Iterator[pd.DataFrame]:
            shares = np.zeros(tree.n)
            shares[list(big)] = [sample / n for n in big.values()]
            for b in batches:
                p = _unit(b["v"]) @ w if len(b) else np.zeros((0, w.shape[1]), np.float32)
                home = tree.home(p)
                ok = b["u"].to_numpy() < shares[home]
                yield pd.DataFrame({"cell": home[ok], "p": [x.tobytes() for x in p[ok].astype(np.float32)]}).astype({"p": "object"})

        def split(b: pd.DataFrame) -> pd.DataFrame:  # noqa: B023 - run within this round
            own = int(b["cell"].iloc[0])
            points = np.stack([np.frombuffer(x, np.float32) for x in b["p"]])
            dims, ats, left, right = subtree(points, math.ceil(math.log2(big[own] / cell)), max(1, min(32, cell // 2)))
            return pd.DataFrame({"cell": [own], "dims": [dims], "ats": [ats], "left": [left], "right": [right]})

        u = F.pmod(F.xxhash64("rep", F.lit(len(tree.dim))), F.lit(1 << 30)) / F.lit(float(1 << 30))
        found = reps.select("v", u.alias("u")).mapInPandas(placed, "cell bigint, p binary").groupBy("cell").applyInPandas(split, "cell bigint, dims array<int>, ats array<double>, left array<int>, right array<int>").collect()
        done = [r for r in found if len(r["dims"])]
        for r in sorted(done, key=lambda r: r["cell"]):
            tree.split(r["cell"], r["dims"], r["ats"], r["left"], r["right"])
        fixed |= set(big) - {r["cell"] for r in done}
        counts = _per_cell(reps.select("v"), lambda b, tree=tree: tree.home(_unit(b["v"]) @ w) if len(b) else np.zeros(0, np.int64))
    return tree


def nearest(reps: DataFrame, dims: int, k: int, radius: float | None = None, queries: DataFrame | None = None, stop: float = 0.98, miss: float = MISS, cell: int = CELL, sample: int = SAMPLE, most_asking: int = MOST_ASKING) -> DataFrame:
    """(q, rep, distance): for each representative, or each of ``queries``, the k nearest other representatives.

    With a radius, cells are visited once for it. Without one, a search in the home cell
    gives the distance of the k-th neighbour so far, and cells are visited for that.
    """
    w = directions(dims)
    tree = grown(reps, w, cell, sample)

    def cells_of(b: pd.DataFrame, home: bool, away: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) where the rows of a batch ask: at home, and in the cells that they visit."""
        p = _unit(b["v"]) @ w if len(b) else np.zeros((0, w.shape[1]), np.float32)
        at = (np.arange(len(b)), tree.home(p)) if home else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        far = tree.visits(p, np.sqrt(2 * b["r"].to_numpy(np.float32)), miss) if away else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return np.concatenate([at[0], far[0]]), np.concatenate([at[1], far[1]])

    def asked(rows: DataFrame, home: bool, away: bool, most: bool) -> DataFrame:
        """Those of ``rows`` (id, v, r) that ask meet the representatives of their cells, in as many groups a cell as their number asks for."""
        parts = np.ones(tree.n, np.int64)
        for c, n in _per_cell(rows, lambda b: cells_of(b, home, away)[1]).items():
            parts[c] = -(-n // most_asking)

        def base(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                row, cell = cells_of(b, True, False)
                n = parts[cell]
                row, cell = np.repeat(row, n), np.repeat(cell, n)
                part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                yield pd.DataFrame({"cell": cell, "part": part, "base": True, "id": b["id"].to_numpy(object)[row], "v": b["v"].to_numpy(object)[row], "r": 0.0})

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                row, cell = cells_of(b, home, away)
                yield pd.DataFrame({"cell": cell, "part": b["h"].to_numpy()[row] % parts[cell], "base": False, "id": b["id"].to_numpy(object)[row], "v": b["v"].to_numpy(object)[row], "r": b["r"].to_numpy()[row]})

        def scan(b: pd.DataFrame) -> pd.DataFrame:
            own, ask = b[b["base"]].sort_values("id"), b[~b["base"]]
            i, j, d = search(_unit(ask["v"]), _unit(own["v"]), w, k + 1, ask["r"].to_numpy(np.float32) if most else None, stop)
            q, rep = ask["id"].to_numpy(object)[i], own["id"].to_numpy(object)[j]
            other = q != rep
            return pd.DataFrame({"q": q[other], "rep": rep[other], "distance": d[other].astype(np.float64)}).astype({"q": "object", "rep": "object"})

        kind = "cell bigint, part bigint, base boolean, id string, v binary, r double"
        both = everyone.mapInPandas(base, kind).unionByName(rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("id"), 1)).mapInPandas(ask, kind))
        return both.groupBy("cell", "part").applyInPandas(scan, "q string, rep string, distance double")

    def within(r: float) -> DataFrame:
        """All pairs of representatives at most ``r`` apart that the test lets through, each vector asking at home and in the cells that it visits."""
        rows = everyone.withColumn("r", F.lit(r)).withColumn("h", F.shiftrightunsigned(F.xxhash64("id"), 1))
        parts = np.ones(tree.n, np.int64)
        for c, n in _per_cell(rows, lambda b: cells_of(b, False, True)[1]).items():
            parts[c] = -(-n // most_asking)
        limit = 2 * r * chi_square_quantile(stop, w.shape[1])

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                ids, v, h = b["id"].to_numpy(object), b["v"].to_numpy(object), b["h"].to_numpy()
                p = np.array([x.tobytes() for x in (_unit(b["v"]) @ w).astype(np.float32)], object) if len(b) else v
                row, cell = cells_of(b, True, False)
                n = parts[cell]
                row, cell = np.repeat(row, n), np.repeat(cell, n)
                part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                # A vector asks at home in one of the parts, and lies in all of them.
                yield pd.DataFrame({"cell": cell, "part": part, "role": np.where(h[row] % parts[cell] == part, 1, 0), "id": ids[row], "v": v[row]})
                row, cell = cells_of(b, False, True)
                yield pd.DataFrame({"cell": cell, "part": h[row] % parts[cell], "role": 2, "id": ids[row], "v": p[row]})

        def scan(b: pd.DataFrame) -> pd.DataFrame:
            own, ask, far = b[b["role"] < 2].sort_values("id"), b[b["role"] == 1], b[b["role"] == 2]
            x, names = _unit(own["v"]), own["id"].to_numpy(object)
            i, j, d = search(_unit(ask["v"]), x, w, k + 1, r, stop)
            out = [pd.DataFrame({"q": ask["id"].to_numpy(object)[i], "rep": names[j], "distance": d.astype(np.float64), "v": None})]
            if len(own) and len(far):
                pb, pq = x @ w, np.stack([np.frombuffer(y, np.float32) for y in far["v"]])
                nb, nq = (pb * pb).sum(axis=1), (pq * pq).sum(axis=1)
                vectors, asking = own["v"].to_numpy(object), far["id"].to_numpy(object)
                for a in range(0, len(pq), LEAF):
                    i, j = np.nonzero(nb - 2 * (pq[a : a + LEAF] @ pb.T) + nq[a : a + LEAF, None] <= limit)
                    out.append(pd.DataFrame({"q": asking[a + i], "rep": names[j], "distance": np.nan, "v": vectors[j]}))
            found = pd.concat(out).astype({"q": "object", "rep": "object", "distance": "float64", "v": "object"})
            return found[found["q"] != found["rep"]]

        def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                d = np.maximum(np.round(1 - np.einsum("ij,ij->i", _fine(_unit(b["mine"])), _fine(_unit(b["v"]))), 9), 0) if len(b) else np.zeros(0)
                ok = d <= r
                yield pd.DataFrame({"q": b["q"][ok], "rep": b["rep"][ok], "distance": d[ok].astype(np.float64)})

        found = rows.mapInPandas(place, "cell bigint, part bigint, role int, id string, v binary").groupBy("cell", "part").applyInPandas(scan, "q string, rep string, distance double, v binary")
        found = cut_lineage(found)
        let = found.where("v is not null").join(everyone.select(F.col("id").alias("q"), F.col("v").alias("mine")), "q")
        return found.where("v is null").drop("v").unionByName(let.select("q", "rep", "v", "mine").mapInPandas(verify, "q string, rep string, distance double"))

    everyone = reps.select(F.col("rep").alias("id"), "v", F.lit(0.0).alias("r"))
    best = Window.partitionBy("q").orderBy("distance", "rep")
    ask = everyone if queries is None else queries.select(F.col("rep").alias("id"), "v", F.lit(0.0).alias("r"))
    if radius is not None and queries is None:
        hits = within(float(radius))
    elif radius is not None:
        hits = asked(ask.withColumn("r", F.lit(float(radius))), True, True, True)
    else:
        first = cut_lineage(asked(ask, True, False, False))
        far = first.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).groupBy("q").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(2.0).alias("r"))
        guests = cut_lineage(ask.drop("r").join(far, ask["id"] == far["q"], "left").select("id", "v", F.coalesce(F.col("r"), F.lit(2.0)).alias("r")))
        hits = first.unionByName(asked(guests, False, True, True))
    return hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")


def _expand(reps: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """(rep, near, distance): for each representative the ids that any of its members may list, itself among them."""
    own = reps.select("rep", F.posexplode("ids").alias("place", "near"), F.lit(0.0).alias("distance")).drop("place")
    theirs = links.join(reps.select("rep", "ids"), "rep").select(F.col("q").alias("rep"), F.explode("ids").alias("near"), "distance")
    best = Window.partitionBy("rep").orderBy("distance", "near")
    return own.unionByName(theirs).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")


def mutual_pairs(vectors: DataFrame, dims: int = 64, k: int = 5, radius: float = 0.03, **options) -> DataFrame:
    """(id_a, id_b, distance), id_a < id_b: each among the other's k nearest, at most ``radius`` apart.

    Equal distances are ordered by id. Of many copies of one vector only the least k + 1
    ids can be among each other's nearest.
    """
    reps = cut_lineage(distinct_vectors(vectors, dims, k + 1))
    links = nearest(reps, dims, k, radius, **options)
    lists = cut_lineage(_expand(reps, links, k))
    # An id's own list is its representative's without itself, cut at k.
    members = reps.select("rep", F.explode("ids").alias("id"))
    mine = members.join(lists, "rep").where("id <> near")
    mine = mine.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("distance", "near"))).where(F.col("n") <= k)
    pairs = mine.select(F.least("id", "near").alias("id_a"), F.greatest("id", "near").alias("id_b"), "distance")
    return pairs.groupBy("id_a", "id_b").agg(F.count("*").alias("n"), F.min("distance").alias("distance")).where("n = 2").drop("n")


def neighbour_lists(vectors: DataFrame, dims: int = 64, k: int = 10, one_in: int = 20, stop: float = 0.97, miss: float = 0.001, **options) -> DataFrame:
    """(id, rank, near, distance) for the stated query set, every id whose hash is divisible by ``one_in``, against all vectors.

    Every id of the query set has a list, whatever the number of its copies; equal distances,
    to nine digits, are ordered by id. ``stop`` and ``miss`` are the accepted loss: how sure the stopping test must be, and how
    likely a neighbour in a cell that isn't visited may be.
    """
    rows = cut_lineage(unit_vectors(vectors, dims))
    reps = cut_lineage(_copies(rows, k + 1))
    # Copies beyond those that lists can hold ask as well; their rows meet their representative.
    asked = rows.where(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0).withColumn("h", F.xxhash64("v"))
    asked = cut_lineage(asked.join(reps.select("rep", F.xxhash64("v").alias("h"), "v"), ["h", "v"]).select("rep", "v", "id"))
    links = nearest(reps, dims, k, None, asked.select("rep", "v").distinct(), stop, miss, **options)
    own = asked.select("rep", "id")
    lists = _expand(reps, links, k)
    rows = own.join(lists, "rep").where("id <> near")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "near"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "near", "distance")
