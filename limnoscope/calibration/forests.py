"""Regression forests of every calibration at once, grown level by level with one split search for all trees.

Rows are counted and summed by (tree, node, predictor, bin), running sums along the bins give the gain of every cut, and
the best cut of each node sends its rows one level down. Nodes of more than `NODE_ROWS` rows go down by a job per level that
serves all trees of all reservoirs, variables, folds and leaf sizes, so a calibration of very many rows is spread like any
other. Smaller nodes, most often whole trees, are dealt over the tasks by one shuffle and grown there to their leaves by the
same sums, many at a time. Nothing is fitted on the driver.

What a grid asks for is shared where it can be. A tree of limited depth is the top of the unlimited one, and a small
forest is the beginning of a large one, so trees are grown once per leaf size and their values are noted on the way down.
Rows that a tree does not learn from go down with weight 0 and are predicted by the same jobs.

Bins are the distinct values of a predictor in its calibration, or quantiles beyond `bins` values. A row's weight in a tree
is drawn from the Poisson distribution by a hash of the row and the tree, so any run gives the same forest. Ties of a
gain fall to the first predictor, then to the lowest cut; those of grid points fall to the first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from limnoscope.calibration.linear import score_aggregates
from limnoscope.calibration.splits import GROUP, HELD_OUT
from limnoscope.calibration.trees import MIN_ROWS
from limnoscope.operators.sizing import lookup_join
from limnoscope.session import cut_lineage

#: Cumulative Poisson(1) probabilities: a row is in a tree as often as the draw passes.
_POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)
#: Step in which gains are compared.
_STEP = Decimal("1e-9")
#: Fold number of the fit on all train rows.
FINAL = -1
#: Rows up to which a node is grown to its leaves inside one task.
NODE_ROWS = 4096
#: Rows that such a task has on average, and rows that it holds at once besides one node.
TASK_ROWS = 50_000


@dataclass(frozen=True)
class ForestGrid:
    """The parameter grid of the forest; None grows until leaves are pure or small."""

    trees: tuple[int, ...] = (100, 300)
    depths: tuple[int | None, ...] = (None, 3, 5, 8)
    leaf_rows: tuple[int, ...] = (1, 2, 4)
    bins: int = 128
    seed: int = 42

    def candidates(self) -> list[tuple[int, int, int | None, int]]:
        """(candidate, trees, depth, leaf rows) in the order of the grid."""
        listed = [(t, d, n) for t in self.trees for d in self.depths for n in self.leaf_rows]
        return [(k, *c) for k, c in enumerate(listed)]


def binned(rows: DataFrame, predictors: Sequence[str], group: Sequence[str], bins: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the bin of each predictor as `bins` (array), and (group, edges): the values that bins end at."""
    at = [k / bins for k in range(1, bins + 1)]
    ends = [F.array_sort(F.array_distinct(F.percentile_approx(p, F.array(*map(F.lit, at)), F.lit(10 * bins)))).alias(f"e{k}") for k, p in enumerate(predictors)]
    edges = rows.groupBy(*group).agg(*ends)
    edges = edges.select(*group, F.array(*[f"e{k}" for k in range(len(predictors))]).alias("edges"))
    joined = lookup_join(rows, edges, list(group), [*group, "date"])
    number = lambda k, p: F.size(F.filter(F.col("edges")[k], lambda e: e < F.col(p)))
    return joined.withColumn("bins", F.array(*[number(k, p) for k, p in enumerate(predictors)])).drop("edges"), edges


def _draws(seed: int, tree: Column, row: Sequence[str]) -> Column:
    """How often a row is in a tree: a Poisson draw by hash."""
    part = F.pmod(F.xxhash64(*row, tree, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return sum(((part > p).cast("int") for p in _POISSON), F.lit(0))


def _seats(parts: DataFrame, scheme: str, group: Sequence[str]) -> DataFrame:
    """Rows once per fit they have a part in: `fit` is the fold left out or FINAL, `learns` tells train from tested rows."""
    folds = parts.where(F.col("part") >= 0).select(*group, F.col("part").alias("fit")).distinct()
    if scheme == "timeseries":
        folds = folds.where("fit > 0")  # the first block has no past
    fits = folds.unionByName(folds.select(*group).distinct().withColumn("fit", F.lit(FINAL)))
    own = F.array_sort(F.collect_set("fit")).alias("fits")
    spread = lookup_join(parts, fits.groupBy(*group).agg(own), list(group), [*group, "date"]).withColumn("fit", F.explode("fits")).drop("fits")
    past = F.col("part") < F.col("fit") if scheme == "timeseries" else F.col("part") != F.col("fit")
    learns = (F.col("part") >= 0) & ((F.col("fit") == FINAL) | past)
    tested = F.when(F.col("fit") == FINAL, F.col("part") == HELD_OUT).otherwise(F.col("part") == F.col("fit"))
    return spread.withColumn("learns", learns).where(learns | tested)


def _best_cuts(live: DataFrame, n_predictors: int) -> DataFrame:
    """(tree, node, value, predictor, cut) of every node with learning rows; no predictor where no cut gains."""
    bins = F.posexplode("bins").alias("predictor", "bin")
    long = live.where("weight > 0").select("tree", "node", "leaf_rows", "weight", "y_true", bins)
    summed = long.groupBy("tree", "node", "leaf_rows", "predictor", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("y_true")).alias("s")
    )
    along = Window.partitionBy("tree", "node", "predictor")
    upto = along.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cuts = summed.select(
        "tree", "node", "leaf_rows", "predictor", "bin",
        *[F.sum(c).over(upto).alias(f"{c}_left") for c in "nws"], *[F.sum(c).over(along).alias(f"{c}_all") for c in "nws"],
    )
    left, right = F.col("s_left") * F.col("s_left") / F.col("w_left"), F.col("s_all") - F.col("s_left")
    gain = left + F.try_divide(right * right, F.col("w_all") - F.col("w_left")) - F.col("s_all") * F.col("s_all") / F.col("w_all")
    allowed = (F.col("n_left") >= F.col("leaf_rows")) & (F.col("n_all") - F.col("n_left") >= F.col("leaf_rows"))
    # Gains are compared in steps, so rounding does not choose between cuts that part the rows alike.
    scored = cuts.withColumn("gain", F.when(allowed, F.round(gain, 9))).withColumn("gain", F.when(F.col("gain") > 1e-9, F.col("gain")))
    chosen = F.max(F.when(F.col("gain").isNotNull(), F.struct("gain", (-F.col("predictor")).alias("p"), (-F.col("bin")).alias("b"))))
    found = scored.groupBy("tree", "node").agg(chosen.alias("c"), F.max("s_all").alias("s"), F.max("w_all").alias("w"))
    return found.select("tree", "node", (F.col("s") / F.col("w")).alias("value"), (-F.col("c.p")).alias("predictor"), (-F.col("c.b")).alias("cut"))


def _running(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums along each segment, one value after the other, so that no segment rounds by what stands before it."""
    longest = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[longest], sizes[longest]
    sums = values.copy()
    for k in range(1, sizes[0]):
        at = starts[: np.searchsorted(-sizes, -k)] + k
        sums[at] += sums[at - 1]
    return sums


def _rounded(gain: np.ndarray) -> np.ndarray:
    """Nine places with halves up, by the digits a number is written with, as `F.round` has it."""
    scaled = gain * 1e9
    below = np.floor(scaled)
    # From 1e8 on a double has no more places.
    out = np.where(gain < 1e8, np.floor(scaled + 0.5) / 1e9, gain)
    halves = np.flatnonzero((gain > 0) & (gain < 1e8) & (np.abs(scaled - below - 0.5) <= scaled * 2.0**-51))
    out[halves] = [float(Decimal(repr(g)).quantize(_STEP, ROUND_HALF_UP)) for g in gain[halves].tolist()]
    return out


def _small_cuts(node: np.ndarray, bins: np.ndarray, y: np.ndarray, weight: np.ndarray, leaf_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, predictor, cut) of nodes 0, 1, ..., each with learning rows; predictor -1 where no cut gains."""
    n_nodes = int(node.max()) + 1
    n_all, w_all = np.bincount(node), np.bincount(node, weight)
    total, most = np.full(n_nodes, -np.inf), np.full(n_nodes, 1e-9)
    predictor, cut = np.full(n_nodes, -1), np.full(n_nodes, -1)
    width = int(bins.max()) + 1
    for p in range(bins.shape[1]):
        key = node * width + bins[:, p]
        order = np.argsort(key, kind="stable")
        key, w = key[order], weight[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends, of = np.r_[starts[1:], len(key)], key[starts] // width
        first = np.searchsorted(of, np.arange(n_nodes))
        sizes = np.diff(np.r_[first, len(of)])
        s_left = _running(np.add.reduceat(w * y[order], starts), first, sizes)
        n_left = ends - (np.cumsum(n_all) - n_all)[of]
        w_left = np.cumsum(w)[ends - 1] - (np.cumsum(w_all) - w_all)[of]
        s_all = s_left[first + sizes - 1]
        total = np.maximum(total, s_all)
        right, s, n, w = s_all[of] - s_left, s_all[of], n_all[of], w_all[of]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = s_left * s_left / w_left + right * right / (w - w_left) - s * s / w
            gain = _rounded(gain)
            gain = np.where((n_left >= leaf_rows) & (n - n_left >= leaf_rows) & (w > w_left) & (gain > 1e-9), gain, 0.0)
        best = np.maximum.reduceat(gain, first)
        hits = np.flatnonzero(gain == best[of])
        hits = hits[np.searchsorted(of[hits], np.arange(n_nodes))]
        better = best > most
        most, predictor = np.where(better, best, most), np.where(better, p, predictor)
        cut = np.where(better, key[starts][hits] % width, cut)
    return total / w_all, predictor, cut


def _small_levels(root: np.ndarray, bins: np.ndarray, y: np.ndarray, weight: np.ndarray, leaf_rows: int) -> Iterator[tuple]:
    """Level by level the rows that came down, the node of each, and (value, predictor, cut) of those nodes.

    Nodes are numbered anew on each level; those that split leave two numbers, in their order.
    """
    learned = np.bincount(root, weight) > 0
    rows = np.flatnonzero(learned[root])
    node = (np.cumsum(learned) - 1)[root[rows]]
    while len(rows):
        seen = rows[weight[rows] > 0]
        value, predictor, cut = _small_cuts(node[weight[rows] > 0], bins[seen], y[seen], weight[seen], leaf_rows)
        yield rows, node, value, predictor, cut
        split = predictor >= 0
        below = split[node]
        rows, node = rows[below], node[below]
        side = bins[rows, predictor[node]] > cut[node]
        node = 2 * (np.cumsum(split) - 1)[node] + side


def _whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Some `TASK_ROWS` rows at a time of batches in the order of (tree, node), with the number of each row's node."""
    held, n = [], 0

    def numbered(table):
        tree, node = table["tree"].to_numpy(), table["node"].to_numpy()
        return np.cumsum(np.r_[False, (tree[1:] != tree[:-1]) | (node[1:] != node[:-1])])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= TASK_ROWS:
            table = pa.Table.from_batches(held)
            root = numbered(table)
            whole = int(np.searchsorted(root, root[-1]))  # the last node may go on
            if whole:
                yield table.slice(0, whole), root[:whole]
            held, n = table.slice(whole).to_batches(), n - whole
    if n:
        table = pa.Table.from_batches(held)
        yield table, numbered(table)


def _small_nodes(live: DataFrame, n_rows: int, n_predictors: int, depths: Sequence[int], leaf_rows: Sequence[int], level: int, name: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(predictions, nodes) as `grow` gives them for nodes of at most `NODE_ROWS` rows, grown once per leaf size.

    The rows of a node meet in one task, in the order of their seats, which fixes the order of sums.
    """
    later = [d for d in depths if d >= level]
    named = [c for c in name if c != "leaf_rows"]
    carried = [c for c in live.columns if c not in ("tree", "node", "seat", "bins", "weight", "leaf_rows")]
    dealt = live.drop("leaf_rows").repartition(max(1, -(-n_rows // TASK_ROWS)), "tree", "node")
    ordered = dealt.sortWithinPartitions("tree", "node", "seat")
    extra = lambda *fields: [T.StructField(c, t()) for c, t in (("leaf_rows", T.IntegerType), *fields)]
    values = extra(*[(f"d{d}", T.DoubleType) for d in later], ("deepest", T.DoubleType))
    cuts = extra(("node", T.LongType), ("value", T.DoubleType), ("predictor", T.IntegerType), ("cut", T.IntegerType), ("level", T.IntegerType))

    def numbers(table):
        bins = table["bins"].combine_chunks().flatten().to_numpy().astype(np.int64).reshape(-1, n_predictors)
        return bins, table["y_true"].cast(pa.float64()).to_numpy(), table["weight"].to_numpy()

    def predict(batches):
        for table, root in _whole_nodes(batches):
            for least in leaf_rows:
                noted = np.full((len(root), len(later) + 1), np.nan)
                grown = np.zeros(len(root), bool)
                for k, (rows, node, value, predictor, _) in enumerate(_small_levels(root, *numbers(table), least)):
                    grown[rows] = True
                    # A leaf above a depth of the grid counts for it.
                    leaf = predictor[node] < 0
                    for i, d in enumerate([*later, None]):
                        at = (leaf | (d == level + k)) if d is None or d >= level + k else np.zeros(len(rows), bool)
                        noted[rows[at], i] = value[node[at]]
                wanted = grown & (~table["learns"].to_numpy() | (table["fit"].to_numpy() == FINAL))
                kept = table.select(carried).filter(pa.array(wanted))
                arrays = [pa.array(np.full(int(wanted.sum()), least, np.int32)), *[pa.array(c) for c in noted[wanted].T]]
                yield from _appended(kept, values, arrays)

    def describe(batches):
        for table, root in _whole_nodes(batches):
            for least in leaf_rows:
                number = None
                for k, (rows, node, value, predictor, cut) in enumerate(_small_levels(root, *numbers(table), least)):
                    one = np.empty(len(value), np.int64)
                    one[node] = rows
                    number = table["node"].to_numpy()[one] if number is None else number
                    if number.min() <= 0:
                        raise OverflowError("nodes too deep to be numbered")
                    none = predictor < 0
                    arrays = [
                        pa.array(np.full(len(value), least, np.int32)), pa.array(number), pa.array(value),
                        pa.array(predictor.astype(np.int32), mask=none), pa.array(cut.astype(np.int32), mask=none), pa.array(np.full(len(value), level + k, np.int32)),
                    ]
                    yield from _appended(table.select(named).take(pa.array(one)), cuts, arrays)
                    number = np.column_stack([2 * number[~none], 2 * number[~none] + 1]).ravel()

    predictions = ordered.mapInArrow(predict, T.StructType([*live.select(*carried).schema, *values]))
    nodes = ordered.mapInArrow(describe, T.StructType([*live.select(*named).schema, *cuts]))
    return predictions, nodes.select(F.xxhash64(*name).alias("tree"), "node", "value", "predictor", "cut", "level")


def _appended(table: pa.Table, fields: Sequence[T.StructField], arrays: Sequence[pa.Array]) -> list[pa.RecordBatch]:
    for field, array in zip(fields, arrays, strict=True):
        table = table.append_column(field.name, array)
    return table.combine_chunks().to_batches()


def grow(seats: DataFrame, n_predictors: int, grid: ForestGrid = ForestGrid(), keep: Sequence[str] = (), row: Sequence[str] = ("date",)) -> tuple[DataFrame, DataFrame]:
    """(predictions per row, tree and depth; nodes) for seats with `bins`, `y_true`, `learns` and the columns of a tree's name.

    A tree is named by (`keep` columns of its calibration, fit, leaf rows, number); its hash is the key of all jobs. The
    predictions hold one column per depth of the grid, for tested rows and all rows of the final fit.
    """
    depths = [d for d in grid.depths if d is not None]
    names = [f"d{d}" for d in depths]
    name = [*keep, "fit", "leaf_rows", "number"]
    wanted = f"not learns or fit = {FINAL}"

    def placed(seats: DataFrame, *own: str) -> DataFrame:
        # Trees of all leaf sizes see the same draws.
        weight = F.when(F.col("learns"), _draws(grid.seed, F.struct(*keep, "fit", "number"), row)).otherwise(F.lit(0)).cast("double")
        numbered = seats.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(max(grid.trees) - 1))))
        live = numbered.select(
            F.xxhash64(*own).alias("tree"), *own, *[c for c in row if c not in own], "part", "y_true", "learns", "seat", "bins", weight.alias("weight"), F.lit(1).cast("long").alias("node"),
        )
        # Rows that a tree neither learns from nor is tested on have no seat in it.
        return live.where(f"weight > 0 or {wanted}")

    fit = [*keep, "fit"]
    sized = lookup_join(seats, seats.groupBy(*fit).agg(F.count(F.lit(1)).alias("n_rows")), fit, row)
    # The order that the sums of a node take its rows in.
    sized = cut_lineage(sized.withColumn("seat", F.monotonically_increasing_id()))
    few, many = sized.where(F.col("n_rows") <= NODE_ROWS), sized.where(F.col("n_rows") > NODE_ROWS)
    small = _small_nodes(placed(few, *[c for c in name if c != "leaf_rows"]), few.count() * max(grid.trees), n_predictors, depths, grid.leaf_rows, 0, name)
    done, nodes, level = [small[0]], [small[1]], 0
    if many.isEmpty():
        return done[0], nodes[0]
    leaves = F.explode(F.array(*map(F.lit, grid.leaf_rows)))
    live = cut_lineage(placed(many.withColumn("leaf_rows", leaves), *name))
    while not live.isEmpty():
        cuts = cut_lineage(_best_cuts(live, n_predictors))
        nodes.append(cuts.withColumn("level", F.lit(level)))
        told = live.join(cuts.hint("merge"), ["tree", "node"])
        noted = {f"d{d}": F.col("value") for d in depths if d == level}
        told = told.withColumns(noted)
        over = told.where("predictor is null").where(wanted).drop("predictor", "cut", "bins", "node", "weight", "tree", "seat")
        # A leaf above a depth of the grid counts for it.
        over = over.withColumns({n: F.col("value") for n in names if n not in over.columns})
        done.append(cut_lineage(over.withColumnRenamed("value", "deepest")))
        below = F.col("node") * 2 + F.when(F.element_at("bins", F.col("predictor") + 1) > F.col("cut"), 1).otherwise(0)
        lower = told.where("predictor is not null").withColumn("node", below).drop("value", "predictor", "cut")
        rows = lower.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n_rows"))
        lower = cut_lineage(lower.join(rows.hint("merge"), ["tree", "node"]))
        level += 1
        for least in grid.leaf_rows:
            few = lower.where((F.col("n_rows") <= NODE_ROWS) & (F.col("leaf_rows") == least)).drop("n_rows")
            n_few = few.count()
            if n_few:
                small = _small_nodes(few, n_few, n_predictors, depths, [least], level, name)
                done.append(small[0])
                nodes.append(small[1])
        live = lower.where(F.col("n_rows") > NODE_ROWS).drop("n_rows")
    grown = done[0]
    for d in done[1:]:
        grown = grown.unionByName(d)
    all_nodes = nodes[0]
    for n in nodes[1:]:
        all_nodes = all_nodes.unionByName(n)
    return grown, all_nodes


def forest_predictions(grown: DataFrame, grid: ForestGrid, keep: Sequence[str], row: Sequence[str]) -> DataFrame:
    """One row per (row, fit, candidate) with the mean over the candidate's trees."""
    column = lambda depth: "deepest" if depth is None else f"d{depth}"
    sums = [F.avg(F.when(F.col("number") < t, F.col(column(d)))).alias(f"t{t}_{column(d)}") for t in grid.trees for d in grid.depths]
    rows = [*keep, *[c for c in row if c not in keep]]
    means = grown.groupBy(*rows, "fit", "leaf_rows", "part", "y_true").agg(*sums)
    listed = [
        F.struct(F.lit(k).alias("candidate"), F.lit(t).alias("trees"), F.lit(d).cast("int").alias("depth"), F.lit(n).alias("leaf"), F.col(f"t{t}_{column(d)}").alias("y_pred"))
        for k, t, d, n in grid.candidates()
    ]
    return means.select(*rows, "fit", "leaf_rows", "part", "y_true", F.inline(F.array(*listed))).where("leaf = leaf_rows").drop("leaf_rows")


@dataclass(frozen=True)
class Forests:
    scores: DataFrame
    metrics: DataFrame
    predictions: DataFrame
    nodes: DataFrame


def fit_forests(
    parts: DataFrame, predictors: Sequence[str], grid: ForestGrid = ForestGrid(), scheme: str = "kfold", group: Sequence[str] = GROUP,
    key: Sequence[str] = (*GROUP, "date"), min_rows: int = MIN_ROWS,
) -> Forests:
    """Forests over the whole grid for every calibration with `min_rows` rows.

    `parts` carries `part` as `splits.assign_parts` gives it. The grid point with the best mean fold R2 is chosen per
    calibration, the first on a tie; its train and test predictions come from the fit on all train rows.
    """
    enough = parts.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows).select(*group)
    usable = lookup_join(parts, enough, list(group), [*group, "date"]).na.drop(subset=["y_true", *predictors])
    rows, _ = binned(cut_lineage(usable), predictors, group, grid.bins)
    own = [c for c in key if c not in group]
    seats = _seats(rows.select(*group, *own, "part", "y_true", "bins"), scheme, group)
    grown, nodes = grow(seats, len(predictors), grid, list(group), list(key))
    predicted = cut_lineage(forest_predictions(grown, grid, list(group), own))
    tested = predicted.where((F.col("fit") >= 0) & (F.col("part") == F.col("fit")))
    scores = cut_lineage(tested.groupBy(*group, "candidate", "trees", "depth", "leaf", "part").agg(*score_aggregates()))
    summary = [f(m).alias(f"cv_{m}_{label}") for m in ("r2", "rmse", "mae") for label, f in (("mean", F.avg), ("std", F.stddev_pop))]
    # Scores are compared in steps, as gains are, so the order of sums does not choose between equal grid points.
    whole = F.when(F.count("r2") == F.count(F.lit(1)), F.round(F.avg("r2"), 9)).alias("grid_r2")
    per = scores.groupBy(*group, "candidate", "trees", "depth", "leaf").agg(whole, *summary)
    names = [f"cv_{m}_{s}" for m in ("r2", "rmse", "mae") for s in ("mean", "std")]
    first = F.min(F.struct(F.col("grid_r2").isNull().alias("no"), (-F.col("grid_r2")).alias("neg"), "candidate", "trees", "depth", "leaf", *names))
    picked = cut_lineage(per.groupBy(*group).agg(first.alias("b")).select(*group, *[F.col(f"b.{c}").alias(c) for c in ("candidate", "trees", "depth", "leaf", *names)]))
    final = predicted.where(F.col("fit") == FINAL).join(picked.select(*group, "candidate"), [*group, "candidate"])
    predictions = final.select(
        *group, *own, F.when(F.col("part") == HELD_OUT, "test").otherwise("train").alias("set"), "y_true", "y_pred", (F.col("y_true") - F.col("y_pred")).alias("residual")
    )
    pick = lambda s, m: F.max(F.when(F.col("set") == s, F.col(m))).alias(f"{s}_{m}")
    sets = predictions.groupBy(*group, "set").agg(*score_aggregates()).groupBy(*group).agg(*[pick(s, m) for s in ("train", "test") for m in ("r2", "rmse", "mae")])
    metrics = picked.join(sets, list(group)).withColumn("model_name", F.lit("random_forest"))
    return Forests(scores, metrics, predictions, nodes)
