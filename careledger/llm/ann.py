"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The upper levels of the tree are fitted on a bounded sample; every vector is put in the upper leaf that its path of nearest centres leads to, and a leaf is cut
into blocks of bounded size. The lower levels are fitted in each block on all its rows, down to bins of a few rows, so the number of bins grows with the table. A
query walks from the root to bins through a priority queue, which goes on in the blocks of the upper leaves that it reaches. Scores of upper nodes, lower nodes and bins differ in scale, so a node's priority is
its score less a bound of its kind, or that of a node above it, if lower, and the queue ends at zero. The bounds are widened, so that more leaves are visited, until queries other than those that set them reach
the recall against their exact answers; a query that has found too few candidates goes on through all of them. Equal vectors are searched once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careledger.llm.storage import bounded_batches, discard, materialize, tidy

#: Most vectors, and bytes of them, that the upper levels are fitted on.
SAMPLE, SAMPLE_BYTES = 16_000, 16 << 20
BRANCH = 16
#: Vectors of the sample in an upper leaf at least; queries compared with a block at once.
LEAST_SAMPLE, _TOGETHER = 8, 256
#: Rows in an upper leaf, a block and a bin, about.
LEAF_ROWS, BLOCK_ROWS, BIN_ROWS = 256, 4096, 4
#: Groups of blocks, each of which gives one list of candidates for a query; bytes of the queries that a group meets at once.
UNITS, GROUP_BYTES = 32, 16 << 20
#: Recall to be measured on a quarter of CALIBRATION queries; the others set the bounds.
RECALL, CALIBRATION = 0.93, 256
#: Share of the neighbours to be lost that upper and lower nodes may lose.
UPPER_LOSS, INNER_LOSS = 0.2, 0.1

INDEX = "leaf long, unit int, vecs binary, centers binary, parents binary, bins binary, ids array<{id}>, n array<int>, starts binary"
FOUND = "qid {id}, vec_id {id}, n int, score double, upper double, inner double, bin double, compared long, centres long"


@dataclass
class Tree:
    """Nodes in arrays; a node without children is a leaf. rows: of all vectors in each leaf."""

    centers: np.ndarray
    children: list[list[int]]
    leaf_of: dict[int, int]
    rows: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each unit vector, going to the nearest child from the root on."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf_of[node]
                continue
            near = np.argmax(x[rows] @ self.centers[self.children[node]].T, axis=1)
            todo += [(child, rows[near == k]) for k, child in enumerate(self.children[node]) if (near == k).any()]
        return out

    def leaves(self, q: np.ndarray, bound: float, least: int) -> tuple[list[int], list[float], int]:
        """Leaves of a best-bin-first traversal for the unit vector ``q``, down to the priority ``bound`` and on until they hold ``least`` rows, with the
        priority of each, which is the least score on its path; and the number of centres scored."""
        found, lows, held, scored, heap = [], [], 0, 0, [(-np.inf, 0)]
        while heap and (-heap[0][0] >= bound or held < least):
            low, node = heapq.heappop(heap)
            if not self.children[node]:
                found.append(self.leaf_of[node])
                lows.append(min(1.0, -low))
                held += int(self.rows[self.leaf_of[node]])
                continue
            score = self.centers[self.children[node]] @ q
            scored += len(score)
            for child, s in zip(self.children[node], score, strict=True):
                heapq.heappush(heap, (max(low, -float(s)), child))
        return found, lows, scored

    def reach(self, q: np.ndarray, inner: float, bin_: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for many queries within a block: score of each bin, -inf for those not reached, the least score on the way to it, and centres scored.

        Nodes go on from the score ``inner``, bins from ``bin_``.
        """
        out, lows, scored = np.full((len(q), len(self.leaf_of)), -np.inf), np.full((len(q), len(self.leaf_of)), 1.0), np.zeros(len(q), np.int64)
        if not self.children[0]:
            out[:] = 1.0
            return out, lows, scored
        todo = [(0, np.arange(len(q)), np.ones(len(q)))]
        while todo:
            node, rows, low = todo.pop()
            score = q[rows] @ self.centers[self.children[node]].T
            scored[rows] += score.shape[1]
            for k, child in enumerate(self.children[node]):
                on = score[:, k] >= (inner if self.children[child] else bin_)
                if on.any() and self.children[child]:
                    todo.append((child, rows[on], np.minimum(low[on], score[on, k])))
                elif on.any():
                    out[rows[on], self.leaf_of[child]], lows[rows[on], self.leaf_of[child]] = score[on, k], low[on]
        return out, lows, scored

    @property
    def parents(self) -> np.ndarray:
        up = np.full(len(self.children), -1)
        for node, below in enumerate(self.children):
            up[below] = node
        return up

    @staticmethod
    def of(centers: np.ndarray, parents: np.ndarray) -> Tree:
        children: list[list[int]] = [[] for _ in parents]
        for node, up in enumerate(parents.tolist()):
            if up >= 0:
                children[up].append(node)
        leaf_of = {n: i for i, n in enumerate(i for i, c in enumerate(children) if not c)}
        return Tree(centers, children, leaf_of, np.zeros(len(leaf_of), np.int64))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ centers.T, axis=1)
        sums = (near[None, :] == np.arange(k)[:, None]).astype(x.dtype) @ x
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centers)
    return centers, np.argmax(x @ centers.T, axis=1)


def fit_tree(x: np.ndarray, most: float, branch: int = BRANCH) -> Tree:
    """A tree over the unit vectors ``x`` whose leaves hold up to about ``most`` of them, if they can be told apart."""
    rng = np.random.default_rng(11)
    centers, children = [np.zeros(x.shape[1], x.dtype)], [[]]
    todo, rows_of = [(0, np.arange(len(x)))], {}
    while todo:
        node, rows = todo.pop()
        k = int(min(branch, np.ceil(len(rows) / max(most, 1)), len(rows)))
        found, near = _kmeans(x[rows], k, rng) if k > 1 else (None, np.zeros(len(rows), int))
        if len(np.unique(near)) < 2:
            rows_of[node] = rows
            continue
        for i in np.unique(near):
            children[node].append(len(centers))
            centers.append(found[i])
            children.append([])
            todo.append((len(centers) - 1, rows[near == i]))
    leaf_of = {n: i for i, n in enumerate(i for i, c in enumerate(children) if not c)}
    return Tree(np.array(centers), children, leaf_of, np.array([len(rows_of[n]) for n in leaf_of]))


def _matrix(column) -> np.ndarray:
    """Rows as doubles, each scaled by the power of two that brings its largest component near 1: exact, and norms can't over- or underflow."""
    x = np.array([np.asarray(v, np.float64) for v in column])
    _, power = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    return np.ldexp(x, -power)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, summed in one fixed order, so that equal vectors score equal anywhere."""
    return (q * x).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


def usable(df: DataFrame, id_col: str, vec_col: str, is_query: Column) -> DataFrame:
    """vec_id, vec (array<double>), ask of the rows that take part: an id, and a vector of finite components, not all zero, of the most common length."""
    vec = F.col(vec_col).cast("array<double>")
    ok = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0)
    rows = df.select(F.col(id_col).alias("vec_id"), vec.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("ask"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))
    length = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("vec") == (length["d"] if length else 0))


def _unit(leaf: Column, blk: Column) -> Column:
    """The group of a block: leaves in turn, and the blocks of a leaf in different ones."""
    return F.pmod(leaf + blk, F.lit(UNITS)).cast("int")


def _index(members: DataFrame, id_type: str) -> DataFrame:
    """The blocks of members (leaf, blk, vec, ids): their vectors in bins by a tree of the block's own."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for leaf, unit, rows in zip(batch["leaf"], batch["unit"], batch["m"], strict=True):
                x = _matrix([r["vec"] for r in rows])
                tree = fit_tree(_units(x), BIN_ROWS)
                place = tree.leaf(_units(x))
                order = np.argsort(place, kind="stable")
                ids = [rows[i]["ids"] for i in order]
                raw = lambda a, kind: np.ascontiguousarray(a, kind).tobytes()
                yield pd.DataFrame(
                    {"leaf": [leaf], "unit": [unit], "vecs": [raw(x[order], "f8")], "centers": [raw(tree.centers, "f8")], "parents": [raw(tree.parents, "i8")], "bins": [raw(np.searchsorted(place[order], np.arange(len(tree.leaf_of) + 1)), "i8")],
                     "ids": [[i["id"] for own in ids for i in own]], "n": [[i["n"] for own in ids for i in own]], "starts": [raw(np.cumsum([0, *map(len, ids)]), "i8")]}
                )

    grouped = members.groupBy("leaf", "blk").agg(F.collect_list(F.struct("vec", "ids")).alias("m")).select("leaf", _unit(F.col("leaf"), F.col("blk")).alias("unit"), "m")
    return grouped.mapInPandas(tidy(build), INDEX.format(id=id_type))


def _best(rows: list[tuple], k: int) -> tuple[list[tuple], float]:
    """Of candidates (score, vec_id, ...) those down to the one that completes k + 1 different ids, up to k of an id; and its score, -inf if there are fewer."""
    kept, of = [], {}
    for row in sorted(rows, key=lambda c: (-c[0], c[1])):
        of[row[1]] = of.get(row[1], 0) + 1
        if of[row[1]] <= k:
            kept.append(row)
        if len(of) > k:
            return kept, row[0]
    return kept, -np.inf


class _Asked:
    """Queries of one group and part (each with qid, vec, leaves, lows), with the best candidates of each among the blocks met so far."""

    def __init__(self, rows: list[tuple], k: int):
        self.k, self.qids, self.q = k, [r[0] for r in rows], _matrix([r[1] for r in rows])
        self.unit_q = _units(self.q)
        n, leaves = len(rows), np.concatenate([np.asarray(r[2], np.int64) for r in rows])
        of, lows = np.repeat(np.arange(n), [len(r[2]) for r in rows]), np.concatenate([np.asarray(r[3], np.float64) for r in rows])
        order = np.argsort(leaves, kind="stable")
        starts = np.flatnonzero(np.diff(leaves[order], prepend=-1))
        self.at = {int(leaves[order[i]]): (of[order[i:j]], lows[order[i:j]]) for i, j in zip(starts, [*starts[1:], len(order)], strict=True)}
        self.held, self.floor = [[] for _ in rows], np.full(n, -np.inf)
        self.compared, self.centres = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def meet(self, b: pd.Series, inner: float, bin_: float) -> None:
        """Compare the queries that reach a block's leaf with the bins that they reach in it."""
        if b["leaf"] not in self.at:
            return
        every, above = self.at[b["leaf"]]
        d = self.q.shape[1]
        x, bins, starts = np.frombuffer(b["vecs"]).reshape(-1, d), np.frombuffer(b["bins"], "i8"), np.frombuffer(b["starts"], "i8")
        tree = Tree.of(np.frombuffer(b["centers"]).reshape(-1, d), np.frombuffer(b["parents"], "i8"))
        unit_x, bin_of = _units(x), np.repeat(np.arange(len(bins) - 1), np.diff(bins))
        spread = [b["ids"][starts[i] : starts[i + 1]].tolist() for i in range(len(x))]
        for part in range(0, len(every), _TOGETHER):
            asked, upper = every[part : part + _TOGETHER], above[part : part + _TOGETHER]
            near, lows, scored = tree.reach(self.unit_q[asked], inner, bin_)
            rough = np.full((len(asked), len(x)), -np.inf)
            for j in np.flatnonzero((near > -np.inf).any(axis=0)):
                ask = np.flatnonzero(near[:, j] > -np.inf)
                rough[ask, bins[j] : bins[j + 1]] = self.unit_q[asked[ask]] @ unit_x[bins[j] : bins[j + 1]].T
            self.compared[asked] += (rough > -np.inf).sum(axis=1)
            self.centres[asked] += scored
            # Rows within rounding of a query's last candidate stay, so that the exact scores decide ties.
            rough[rough < self.floor[asked, None] - 1e-12] = -np.inf
            for r in np.flatnonzero((rough > -np.inf).any(axis=1)):
                query, hit = asked[r], self._hits(rough[r], spread)
                scores = _cosines(np.repeat(self.q[query : query + 1], len(hit), axis=0), x[hit])
                new = [(float(s), b["ids"][t], b["n"][t], float(upper[r]), float(lows[r, bin_of[i]]), float(near[r, bin_of[i]])) for i, s in zip(hit, scores, strict=True) for t in range(starts[i], starts[i + 1])]
                self.held[query], self.floor[query] = _best(self.held[query] + new, self.k)

    def _hits(self, row: np.ndarray, spread: list[list]) -> list[int]:
        """Rows of a block by falling score, down to the one that completes k + 1 different ids and those within rounding of it."""
        out, seen, last, some = [], set(), -np.inf, np.flatnonzero(row > -np.inf)
        for i in some[np.argsort(-row[some], kind="stable")].tolist():
            if row[i] < last - 1e-12:
                break
            out.append(i)
            seen.update(spread[i])
            if len(seen) > self.k and last == -np.inf:
                last = row[i]
        return out

    def found(self) -> pd.DataFrame:
        """The candidates; what a query was compared with is told with its first one, or with none."""
        out = []
        for qid, held, compared, centres in zip(self.qids, self.held, self.compared.tolist(), self.centres.tolist(), strict=True):
            for score, *rest in held:
                out.append((qid, rest[0], rest[1], score, *rest[2:], compared, centres))
                compared = centres = 0
            if centres:
                out.append((qid, None, 0, -2.0, 0.0, 0.0, 0.0, compared, centres))
        return pd.DataFrame(out, columns=["qid", "vec_id", "n", "score", "upper", "inner", "bin", "compared", "centres"])


def _search(walked: DataFrame, index: DataFrame, parts: int, inner: float, bin_: float, k: int, id_type: str) -> DataFrame:
    """The nearest of each query in each group of blocks: candidates in the bins that it reaches, down to the one that completes k + 1 different ids.

    A query's vector goes to a group once, and a query has k + 1 ids from a group, however many blocks it reaches there. A row without a vec_id only tells what a query was
    compared with in vain.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, waiting, asked = None, [], None
        for batch in batches:
            for at in range(len(batch)):
                b = batch.iloc[at]
                if (b["unit"], b["part"]) != key:
                    if asked:
                        yield asked.found()
                    key, waiting, asked = (b["unit"], b["part"]), [], None
                if b["vecs"] is None:
                    waiting.append((b["qid"], b["vec"], b["leaves"], b["lows"]))
                elif waiting or asked:
                    if waiting:
                        waiting, asked = [], _Asked(waiting, k)
                    asked.meet(b, inner, bin_)
        if asked:
            yield asked.found()

    each = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    both = walked.drop("centres").unionByName(each, allowMissingColumns=True)
    # Queries, which have no leaf, come before the blocks of their group.
    both = both.repartition("unit", "part").sortWithinPartitions("unit", "part", "leaf")
    return both.mapInPandas(tidy(search), FOUND.format(id=id_type))


def _top(found: DataFrame, k: int) -> DataFrame:
    """Of each query the rows of its k + 1 nearest ids, up to k each and none below the last id's best: enough for the k nearest whatever the query's own id is."""
    per_id = Window.partitionBy("qid", "vec_id")
    few = found.filter("vec_id is not null").withColumn("r", F.row_number().over(per_id.orderBy(F.desc("score")))).filter(F.col("r") <= k).withColumn("best", F.max("score").over(per_id))
    order = Window.partitionBy("qid").orderBy(F.desc("best"), "vec_id")
    few = few.withColumn("r", F.dense_rank().over(order)).filter(F.col("r") <= k + 1)
    return few.withColumn("least", F.min("best").over(Window.partitionBy("qid"))).filter("score >= least").drop("r", "best", "least")


def _fit_upper(distinct: DataFrame, n: int, sample: int) -> Tree:
    first = distinct.select("vec").first()[0]
    most = max(1, min(sample, SAMPLE_BYTES // (8 * len(first))))
    share = min(1.0, 1.1 * most / n)
    picked = distinct.filter(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec").limit(most).toPandas()["vec"]
    x = _units(_matrix(picked if len(picked) else [first]))
    # A leaf is fitted on LEAST_SAMPLE vectors at least; beyond that the lower levels get deeper.
    tree = fit_tree(x, max(LEAF_ROWS * len(x) / n, min(LEAST_SAMPLE, LEAF_ROWS)))
    tree.rows = np.zeros(len(tree.leaf_of), np.int64)
    return tree


def _bounds(exact: pd.DataFrame, loss: float) -> tuple[float, float, float]:
    """Bounds of upper nodes, lower nodes and bins at which about the share ``loss`` of these neighbours isn't reached, most of it for its bin."""
    low = lambda values, share: float(np.sort(values)[int(share * len(values))]) - 1e-9
    upper, inner = low(exact["upper"].to_numpy(), UPPER_LOSS * loss), low(exact["inner"].to_numpy(), INNER_LOSS * loss)
    within = np.where((exact["upper"] >= upper) & (exact["inner"] >= inner), exact["bin"], -np.inf)
    return upper, inner, low(within, loss)


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, sample: int = SAMPLE, recall: float = RECALL, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of every row for which the column ``is_query`` holds.

    Candidates are all rows but those with the query's own id. Ties go to the smaller id. Vectors that are null, zero, or hold null or non-finite
    components take no part, nor do rows without an id and vectors that are not of the table's most common length. Repeated rows are separate candidates.
    A query has k ranks, or as many as it has candidates. An empty table gives no rows; other columns are ignored. ``report`` is given the recall that was measured on
    a sample of the queries against their exact answers, other ones than those that set the bound, and the shares of all distinct vectors that were compared, and centres scored, for a query.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    id_type = df.schema[id_col].dataType.simpleString()
    rows = usable(df, id_col, vec_col, is_query)

    # Of equal vectors only the k + 1 smallest ids, up to k rows each, can be among the nearest of any query.
    order = Window.partitionBy("vec").orderBy("vec_id")
    least = rows.groupBy("vec", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    least = least.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    distinct = least.groupBy("vec").agg(F.sort_array(F.collect_list(F.struct(F.col("vec_id").alias("id"), "n"))).alias("ids")).withColumn("uid", F.monotonically_increasing_id())
    distinct = materialize(distinct, "ann-vectors")
    asked = materialize(rows.filter("ask").groupBy("vec").agg(F.min("vec_id").alias("qid")), "ann-queries")
    n, n_asked = distinct.count(), asked.count()
    if not n or not n_asked:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    tree = _fit_upper(distinct, n, sample)
    placing = spark.sparkContext.broadcast(tree)  # as many nodes as the bounded sample allows

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=placing.value.leaf(_units(_matrix(batch["vec"]))))

    members = materialize(distinct.mapInPandas(tidy(place), f"vec array<double>, ids array<struct<id:{id_type},n:int>>, uid long, leaf long"), "ann-leaves")
    sizes = members.groupBy("leaf").agg(F.count(F.lit(1)).alias("size"))
    for r in sizes.collect():  # one row per leaf of the bounded tree
        tree.rows[r["leaf"]] = r["size"]
    cut = members.join(F.broadcast(sizes), "leaf").withColumn("blk", F.pmod(F.xxhash64("uid"), F.ceil(F.col("size") / BLOCK_ROWS)))
    index = materialize(_index(cut, id_type), "ann-index")
    sized = spark.sparkContext.broadcast(tree)

    units: list[set[int]] = [set() for _ in tree.rows]
    for r in index.select("leaf", "unit").distinct().collect():  # up to UNITS rows per leaf of the bounded tree
        units[r["leaf"]].add(r["unit"])
    groups = spark.sparkContext.broadcast(units)
    group = max(1, GROUP_BYTES // (8 * len(distinct.select("vec").first()[0])))

    def walk(queries: DataFrame, parts: int, bound: float) -> DataFrame:
        """Queries with the leaves that they reach, a row for each group of blocks; centres: scored on the way, told in the first of them."""
        columns = ["unit", "part", "qid", "vec", "leaves", "lows", "centres"]

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), _TOGETHER):
                    some, out = batch.iloc[at : at + _TOGETHER], []
                    for qid, part, vec, q in zip(some["qid"], some["part"], some["vec"], _units(_matrix(some["vec"])), strict=True):
                        leaves, lows, centres = sized.value.leaves(q, bound, k + 1)
                        reached: dict[int, tuple[list, list]] = {}
                        for leaf, low in zip(leaves, lows, strict=True):
                            for unit in groups.value[leaf]:
                                own = reached.setdefault(unit, ([], []))
                                own[0].append(leaf)
                                own[1].append(low)
                        for unit, own in reached.items():
                            out.append((unit, part, qid, vec, *own, centres))
                            centres = 0
                    yield pd.DataFrame(out, columns=columns)

        dealt = queries.select("qid", "vec", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int").alias("part"))
        return dealt.mapInPandas(tidy(visit), f"unit int, part int, qid {id_type}, vec array<double>, leaves array<bigint>, lows array<double>, centres long")

    def search(queries: DataFrame, bounds: tuple[float, float, float]) -> DataFrame:
        """What these queries, a written table, find."""
        parts = max(1, -(-queries.count() // group))
        return _search(walk(queries, parts, bounds[0]), index, parts, *bounds[1:], k, id_type)

    # Exact answers of some queries: most of them set the bounds, the others tell the recall at these.
    trial = materialize(asked.orderBy(F.xxhash64("vec")).limit(CALIBRATION).withColumn("setter", F.row_number().over(Window.orderBy(F.xxhash64("vec"))) % 4 != 0), "ann-trial")
    exact = _top(search(trial, (-np.inf,) * 3), k).filter("qid <> vec_id").join(trial.select("qid", "setter"), "qid").toPandas()
    setters, held_out = exact[exact["setter"]], exact[~exact["setter"]]
    held_out = held_out if len(held_out) else exact
    others = materialize(trial.join(spark.createDataFrame([(q,) for q in held_out["qid"].unique().tolist()] or [], f"qid {id_type}"), "qid", "left_semi").select("vec", "qid"), "ann-others")
    goal = recall if len(exact) else 1.0
    while True:
        bounds = _bounds(setters, 1 - goal) if goal < 1 else (-np.inf,) * 3
        tried = materialize(search(others, bounds), "ann-trial")
        got = _top(tried, k).select("qid", "vec_id", "score").distinct().toPandas()
        measured = len(held_out.merge(got, on=["qid", "vec_id", "score"])) / len(held_out) if len(held_out) else 1.0
        if report is not None:
            compared, lower = tried.agg(F.sum("compared"), F.sum("centres")).first()
            outer, walkers = walk(others, 1, bounds[0]).agg(F.sum("centres"), F.count_distinct("qid")).first()
            report.update(recall=measured, compared=(compared or 0) / (n * max(walkers, 1)), centres=((lower or 0) + (outer or 0)) / (n * max(walkers, 1)), rows=n, leaves=len(tree.leaf_of))
        discard(tried)
        if measured >= recall - 0.005 or goal >= 1:
            break
        goal = min(1.0, goal + (1 - goal) / 3 + 0.005)

    found = materialize(_top(search(asked, bounds), k).select("qid", "vec_id", "n", "score"), "ann-found")
    # Queries whose bins held too few candidates go through all of them.
    enough = found.groupBy("qid").agg(F.count_distinct("vec_id").alias("ids")).filter(F.col("ids") > k)
    short = materialize(asked.join(enough, "qid", "left_anti"), "ann-short")
    again = _top(search(short, (-np.inf,) * 3), k).select("qid", "vec_id", "n", "score")
    found = found.join(short.select("qid"), "qid", "left_anti").unionByName(again)
    owners = rows.filter("ask").select("vec", F.col("vec_id").alias("query_id")).distinct().join(asked, "vec").select("query_id", "qid", "vec")
    ranked = owners.join(found, "qid").filter("query_id <> vec_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    last = Window.partitionBy("query_id", "vec").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
