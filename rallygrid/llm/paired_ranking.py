"""One global ranking from pairwise comparisons: probit strengths with a ridge prior.

``P(i beats j) = Phi(s_i - s_j)``, ``s ~ N(0, 1/ridge)``. Comparisons are first counted per pair
of items and scope, so repeated ones cost nothing further on. Iteratively reweighted least
squares gives in every round a sparse system ``A d = g`` - ``ridge`` plus a weighted graph
Laplacian, and the gradient - which conjugate gradients solve. All vectors are columns of a
distributed table keyed by (scope, item); a product with ``A`` is one join of the edges with the
vector and one aggregation, and only a step's scalars reach the driver. The scopes (say,
surfaces) are blocks of one system and are solved together, each with steps of its own.

Scopes of up to ``WHOLE`` pairs, 24 bytes each and 40 as they arrive, are solved whole by one task each: every step is a pass
over arrays there, and none waits for a job. What follows is for larger ones.

The preconditioner is made of diagonal blocks: the items of a scope fall, by hash, into blocks of
about ``block`` items, and each task solves the system of its block's own edges. The same blocks
give the start (each fitted alone) and the larger part of the standard errors. A scope of one
block is thereby solved by the start, up to the check of the gradient over all edges, which
always decides; with more blocks the rounds and steps do the rest.

Standard errors are roots of the diagonal of ``A^-1``: that of the blocks' inverse exactly, plus the
diagonal of the difference to ``A^-1``, estimated from solves with random signs on the right-hand side.
With one block the difference is nothing and the errors are exact; with more, they carry noise. A scope
solved whole has exact errors for its connected parts of up to ``block`` items and estimated ones for larger parts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallygrid.session import StepTables, cut_lineage

RIDGE = 1.0
PROBES = 16
#: Items of a block: its dense matrix takes 8 bytes times the square of this, three times over.
BLOCK = 2_560
#: Pairs of a scope that one task solves.
WHOLE = 12_000_000
#: Pairs of a pass over the arrays, so that what lies between stays in the cache.
CHUNK = 1 << 17
#: Largest gradient, over the diagonal of ``A``, at which the reweighting stops.
TOLERANCE = 1e-6
#: More rounds or steps than these raise an error; they never end a run in silence.
MAX_ROUNDS = 60
MAX_STEPS = 500

#: Chebyshev coefficients of the complementary error function (relative error under 1.2e-7).
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_cdf(x: Column) -> Column:
    z = F.abs(x) / F.lit(math.sqrt(2))
    t = 1 / (1 + 0.5 * z)
    poly = F.lit(0.0)
    for c in reversed(_ERFC):
        poly = poly * t + F.lit(c)
    tail = 0.5 * t * F.exp(-z * z + poly)
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def _cdf(x: np.ndarray) -> np.ndarray:
    """The same in arrays."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.5 * z)
    tail = 0.5 * t * np.exp(-z * z + np.polyval(_ERFC[::-1], t))
    return np.where(x >= 0, 1 - tail, tail)


def count_pairs(comparisons: DataFrame) -> DataFrame:
    """Every compared pair once: ``scope, a, b, n, won`` (comparisons, and how many of them ``a`` won)."""
    clean = comparisons.filter("scope is not null and winner is not null and loser is not null and winner <> loser")
    won = F.col("winner") < F.col("loser")
    return clean.groupBy("scope", F.least("winner", "loser").alias("a"), F.greatest("winner", "loser").alias("b")).agg(
        F.count("*").alias("n"), F.sum(won.cast("long")).alias("won")
    )


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Both directions of every compared pair: ``scope, src, dst, n, y`` (share won by src)."""
    n, y = F.col("n").cast("double").alias("n"), F.col("won") / F.col("n")
    return pairs.select(
        "scope",
        F.explode(
            F.array(
                F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), n, y.alias("y")),
                F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), n, (1 - y).alias("y")),
            )
        ).alias("e"),
    ).select("scope", "e.*")


class _Whole:
    """The system of a whole scope: pairs ``a, b`` of numbered items."""

    def __init__(self, a: np.ndarray, b: np.ndarray, size: int) -> None:
        self.a, self.b, self.size, self.w = a, b, size, np.empty(len(a))
        self.chunks = [slice(k, k + CHUNK) for k in range(0, len(a), CHUNK)]

    def weigh(self, n: np.ndarray, won: np.ndarray, s: np.ndarray, ridge: float) -> np.ndarray:
        """Sets the weights at the strengths ``s``; the gradient."""
        diag, g = np.full(self.size, ridge), -ridge * s
        for c in self.chunks:
            a, b = self.a[c], self.b[c]
            eta = np.clip(s[a] - s[b], -8, 8)
            p = np.clip(_cdf(eta), 1e-12, 1 - 1e-12)
            phi = np.exp(-0.5 * eta * eta) / math.sqrt(2 * math.pi)
            w, u = n[c] * phi * phi / (p * (1 - p)), phi * (won[c] - n[c] * p) / (p * (1 - p))
            self.w[c] = w
            diag += np.bincount(a, w, self.size) + np.bincount(b, w, self.size)
            g += np.bincount(a, u, self.size) - np.bincount(b, u, self.size)
        self.diag = diag
        return g

    def times(self, v: np.ndarray) -> np.ndarray:
        out = self.diag * v
        for c in self.chunks:
            a, b, w = self.a[c], self.b[c], self.w[c]
            out -= np.bincount(a, w * v[b], self.size) + np.bincount(b, w * v[a], self.size)
        return out

    def solve(self, b: np.ndarray, forcing: float) -> np.ndarray:
        """Conjugate gradients, until the residual is down by ``forcing``."""
        x = np.zeros_like(b)
        r, z = b, b / self.diag
        p, rz = z, float(b @ z)
        goal = max(rz * forcing**2, 1e-300)
        for _ in range(20 * self.size + 100):
            if rz <= goal:
                return x
            ap = self.times(p)
            step = rz / float(p @ ap)
            x, r = x + step * p, r - step * ap
            z = r / self.diag
            after = float(r @ z)
            p, rz = z + after / rz * p, after
        raise RuntimeError("conjugate gradients did not converge in a scope solved whole")

    def parts(self) -> np.ndarray:
        """The number of its connected part for each item."""
        label = np.arange(self.size)
        while True:
            low = np.minimum(label[self.a], label[self.b])
            new = label.copy()
            np.minimum.at(new, self.a, low)
            np.minimum.at(new, self.b, low)
            new = new[new]
            if (new == label).all():
                return np.unique(label, return_inverse=True)[1]
            label = new

    def variances(self, ridge: float, probes: int, block: int) -> np.ndarray:
        """The diagonal of the inverse: by part, with the dense inverse up to ``block`` items, else estimated
        with random signs, the part's constant vector (eigenvalue ``ridge``) taken out and added exactly."""
        part = self.parts()
        sizes = np.bincount(part)
        out = np.zeros(self.size)
        if (large := sizes[part] > block).any():
            rng = np.random.default_rng(7)
            for _ in range(probes):
                signs = np.where(large, rng.choice((-1.0, 1.0), self.size), 0.0)
                out += signs * self.solve(signs - (np.bincount(part, signs) / sizes)[part], 0.001)
            out = np.clip(out / probes + 1 / (ridge * sizes[part]), 1 / self.diag, 1 / ridge)
        order = np.argsort(part, kind="stable")
        ends, place = np.cumsum(sizes), np.empty(self.size, np.int64)
        place[order] = np.arange(self.size) - np.repeat(ends - sizes, sizes)
        of_pair = part[self.a]
        by_part = np.argsort(of_pair, kind="stable")
        pair_ends = np.cumsum(np.bincount(of_pair, minlength=len(sizes)))
        for k in np.flatnonzero(sizes <= block):
            own = order[ends[k] - sizes[k] : ends[k]]
            at = by_part[(pair_ends[k - 1] if k else 0) : pair_ends[k]]
            m = np.diag(self.diag[own])
            i, j = place[self.a[at]], place[self.b[at]]
            m[i, j], m[j, i] = -self.w[at], -self.w[at]  # a pair has one row
            out[own] = np.diag(np.linalg.inv(m))
        return out


def _fit_whole(ridge: float, probes: int, block: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, scope = {c: [] for c in ("a", "b", "n", "won")}, None
        for x in batches:
            scope = x["scope"][0].as_py() if x.num_rows else scope
            for c, own in kept.items():
                v = x[c].to_numpy()
                own.append(v.astype(np.int32) if c in ("n", "won") and v.max(initial=0) < 1 << 31 else v)
        a, b, n, won = (np.concatenate(kept.pop(c)) for c in ("a", "b", "n", "won"))
        ids = np.union1d(np.unique(a), np.unique(b))
        a = np.searchsorted(ids, a).astype(np.int32)
        b = np.searchsorted(ids, b).astype(np.int32)
        system = _Whole(a, b, len(ids))
        s = np.zeros(len(ids))
        for _ in range(MAX_ROUNDS):
            g = system.weigh(n, won, s, ridge)
            off = np.abs(g / system.diag).max()
            if off < 0.01 * TOLERANCE:
                break
            s = s + system.solve(g, 0.1 if off > 0.1 else 0.01)
        else:
            raise RuntimeError(f"strengths did not converge in {MAX_ROUNDS} rounds")
        count = lambda i, v: np.bincount(i, v, len(ids))
        out = {
            "scope": pa.array([scope] * len(ids), pa.string()), "id": ids, "strength": s, "std_error": np.sqrt(system.variances(ridge, probes, block)),
            "n_comparisons": (count(system.a, n) + count(system.b, n)).astype(np.int64), "n_won": (count(system.a, won) + count(system.b, n - won)).astype(np.int64),
        }
        yield pa.RecordBatch.from_pydict(out)

    return run


def _weigh(edges: DataFrame, strengths: DataFrame) -> DataFrame:
    """Edges with the weight ``w`` and the pull ``u`` on ``src`` at the given strengths."""
    at = strengths.select("scope", "item", "s")
    p, phi = F.col("p"), F.col("phi")
    return (
        edges.join(at.withColumnsRenamed({"item": "src", "s": "s_src"}), ["scope", "src"])
        .join(at.withColumnsRenamed({"item": "dst", "s": "s_dst"}), ["scope", "dst"])
        .withColumn("eta", F.least(F.lit(8.0), F.greatest(F.lit(-8.0), F.col("s_src") - F.col("s_dst"))))
        .withColumn("p", F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), normal_cdf(F.col("eta")))))
        .withColumn("phi", F.exp(-0.5 * F.col("eta") * F.col("eta")) / F.lit(math.sqrt(2 * math.pi)))
        .select(
            "scope", "src", "dst", "src_block", "dst_block",
            (F.col("n") * phi * phi / (p * (1 - p))).alias("w"), (F.col("n") * phi * (F.col("y") - p) / (p * (1 - p))).alias("u"),
        )
    )


class _Block:
    """The system of one block: its items and the edges inside it."""

    def __init__(self, edges: pd.DataFrame, items: pd.Series) -> None:
        index = pd.Index(items)
        self.size = len(index)
        self.src, self.dst = index.get_indexer(edges["src"]), index.get_indexer(edges["dst"])

    def total(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.src, values, self.size)

    def solve(self, w: np.ndarray, diag: np.ndarray, b: np.ndarray, forcing: float = 1e-8) -> np.ndarray:
        """Conjugate gradients for the columns of ``b``, until the residual is down by ``forcing``."""
        times = lambda v: diag * v - self.total(w * v[self.dst])
        out = np.empty_like(b)
        for j in range(b.shape[1]):
            x = b[:, j] / diag
            r = b[:, j] - times(x)
            z = r / diag
            p, rz = z, float(r @ z)
            goal = max(float(b[:, j] @ (b[:, j] / diag)) * forcing**2, 1e-300)
            for _ in range(20 * self.size + 100):
                if rz <= goal:
                    break
                ap = times(p)
                a = rz / float(p @ ap)
                x, r = x + a * p, r - a * ap
                z = r / diag
                after = float(r @ z)
                p, rz = z + after / rz * p, after
            out[:, j] = x
        return out


def _fit_block(ridge: float) -> Callable:
    def run(edges: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        block, s = _Block(edges, items["item"]), np.zeros(len(items))
        n, y = edges["n"].to_numpy(), edges["y"].to_numpy()
        for _ in range(MAX_ROUNDS if len(edges) else 0):
            eta = np.clip(s[block.src] - s[block.dst], -8, 8)
            p = np.clip(_cdf(eta), 1e-12, 1 - 1e-12)
            phi = np.exp(-0.5 * eta * eta) / math.sqrt(2 * math.pi)
            w = n * phi * phi / (p * (1 - p))
            diag = block.total(w) + ridge
            g = block.total(n * phi * (y - p) / (p * (1 - p))) - ridge * s
            if np.abs(g / diag).max() < 0.01 * TOLERANCE:
                break
            s = s + block.solve(w, diag, g[:, None], 0.01)[:, 0]
        return pd.DataFrame({"scope": items["scope"], "item": items["item"], "block": items["block"], "s": s})

    return run


def _solve_block(ridge: float, inputs: Sequence[str], outputs: Sequence[str]) -> Callable:
    def run(edges: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        block = _Block(edges, rows["item"])
        diag = rows["deg"].to_numpy() + ridge
        x = block.solve(edges["w"].to_numpy(), diag, rows[list(inputs)].to_numpy())
        return pd.concat([rows.reset_index(drop=True), pd.DataFrame(x, columns=list(outputs))], axis=1)

    return run


def _invert_block(ridge: float, sides: Sequence[str], outputs: Sequence[str]) -> Callable:
    def run(edges: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        block = _Block(edges, rows["item"])
        a = np.diag(rows["deg"].to_numpy() + ridge)
        np.subtract.at(a, (block.src, block.dst), edges["w"].to_numpy())
        inverse = np.linalg.inv(a)
        out = rows[["scope", "item", "block", "deg"]].reset_index(drop=True).assign(own=np.diag(inverse), row_sum=inverse.sum(axis=1))
        r = rows[list(sides)].to_numpy()
        return pd.concat([out, pd.DataFrame(r, columns=list(sides)), pd.DataFrame(inverse @ r, columns=list(outputs))], axis=1)

    return run


def _in_blocks(edges: DataFrame, rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Rows of each block together with the edges inside the block."""
    inner = edges.filter("src_block = dst_block").withColumn("block", F.col("src_block"))
    return inner.groupBy("scope", "block").cogroup(rows.groupBy("scope", "block")).applyInPandas(run, schema)


class _Solver:
    """Preconditioned conjugate gradients for ``k`` right-hand sides of every scope at once."""

    def __init__(self, spark: SparkSession, weights: DataFrame, ridge: float, k: int, steps: StepTables) -> None:
        self.spark, self.weights, self.ridge, self.k, self.steps = spark, weights, ridge, k, steps

    def names(self, letter: str) -> list[str]:
        return [f"{letter}{j}" for j in range(self.k)]

    def times_a(self, state: DataFrame, letter: str) -> DataFrame:
        """``state`` with ``ap0.. = A vector``."""
        vector = state.select("scope", F.col("item").alias("dst"), *self.names(letter))
        moved = self.weights.join(vector, ["scope", "dst"]).groupBy("scope", F.col("src").alias("item")).agg(
            *[F.sum(F.col("w") * F.col(f"{letter}{j}")).alias(f"m{j}") for j in range(self.k)]
        )
        diag = F.col("deg") + F.lit(self.ridge)
        own = [(diag * F.col(f"{letter}{j}") - F.coalesce(f"m{j}", F.lit(0.0))).alias(f"ap{j}") for j in range(self.k)]
        return state.join(moved, ["scope", "item"], "left").select(*state.columns, *own)

    def preconditioned(self, state: DataFrame) -> DataFrame:
        """``state`` with ``z0.. = B^-1 r``, B being the blocks."""
        rows = state.select(*state.columns)
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + [f"{z} double" for z in self.names("z")])
        return _in_blocks(self.weights, rows, _solve_block(self.ridge, self.names("r"), self.names("z")), schema)

    def dots(self, state: DataFrame, a: str, b: str) -> dict[tuple[str, int], float]:
        sums = state.groupBy("scope").agg(*[F.sum(F.col(f"{a}{j}") * F.col(f"{b}{j}")).alias(f"d{j}") for j in range(self.k)]).collect()  # a row per scope
        return {(r["scope"], j): r[f"d{j}"] for r in sums for j in range(self.k)}

    def with_scalars(self, state: DataFrame, values: dict[tuple[str, int], float]) -> DataFrame:
        """Scalars as columns ``c0..`` and not as literals, so that all steps share their compiled code."""
        scopes = sorted({s for s, _ in values})
        rows = [(s, *[float(values[s, j]) for j in range(self.k)]) for s in scopes]
        table = self.spark.createDataFrame(rows, "scope string, " + ", ".join(f"c{j} double" for j in range(self.k)))
        return state.join(F.broadcast(table), "scope")  # a row per scope

    def solve(self, start: DataFrame, forcing: float) -> DataFrame:
        """Adds the solution in ``x0..``; ``start``: ``scope, item, block, deg``, ``x0..``, ``b0..``."""
        span, keep = range(self.k), ["scope", "item", "block", "deg"]
        state = self.times_a(start, "x")
        r = [(F.col(f"b{j}") - F.col(f"ap{j}")).alias(f"r{j}") for j in span]
        size = F.col("deg") + F.lit(self.ridge)
        state = self.steps.cut(state.select(*keep, *self.names("x"), *r, *[(F.col(f"b{j}") / size).alias(f"q{j}") for j in span], *self.names("b")))
        whole = self.dots(state, "b", "q")
        left = self.dots(state.select("scope", *self.names("r"), *[(F.col(f"r{j}") / size).alias(f"q{j}") for j in span]), "r", "q")
        state = state.select(*keep, *self.names("x"), *self.names("r"))
        done = lambda left: all(v <= max(whole[k] * forcing**2, 1e-24) for k, v in left.items())
        if done(left):
            return state
        state = self.steps.cut(self.preconditioned(state))
        rz = self.dots(state, "r", "z")
        state = state.select(*keep, *self.names("x"), *self.names("r"), *[F.col(f"z{j}").alias(f"p{j}") for j in span])
        for _ in range(MAX_STEPS):
            state = self.steps.cut(self.times_a(state, "p"))
            pap = self.dots(state, "p", "ap")
            alpha = {k: rz[k] / v if v > 0 and rz[k] > 1e-24 else 0.0 for k, v in pap.items()}
            state = self.with_scalars(state, alpha).select(
                *keep,
                *[(F.col(f"x{j}") + F.col(f"c{j}") * F.col(f"p{j}")).alias(f"x{j}") for j in span],
                *[(F.col(f"r{j}") - F.col(f"c{j}") * F.col(f"ap{j}")).alias(f"r{j}") for j in span],
                *self.names("p"),
            )
            state = self.steps.cut(self.preconditioned(state))
            after = self.dots(state, "r", "z")
            if done(after):
                return state.select(*keep, *self.names("x"))
            beta = {k: v / rz[k] if rz[k] > 1e-24 else 0.0 for k, v in after.items()}
            state = self.with_scalars(state, beta).select(
                *keep, *self.names("x"), *self.names("r"), *[(F.col(f"z{j}") + F.col(f"c{j}") * F.col(f"p{j}")).alias(f"p{j}") for j in span]
            )
            rz = after
        raise RuntimeError(f"conjugate gradients did not converge in {MAX_STEPS} steps")


def probit_ranking(comparisons: DataFrame, ridge: float = RIDGE, probes: int = PROBES, block: int = BLOCK, whole: int = WHOLE) -> DataFrame:
    """``scope, item, strength, std_error, n_comparisons long, n_won long, place int``.

    ``comparisons``: ``scope, winner, loser``, one row per comparison (a comparison that counts
    in several scopes has a row in each); the scopes must be few, as their scalars are handled
    by the driver. Rows with a null, and of an item with itself, take no part. ``place`` ranks
    the items of a scope by strength, ties by item. An empty table gives an empty result;
    items that only ever won or lost get finite strengths through the prior. The gradient, over
    the diagonal, is below ``TOLERANCE`` everywhere, or an error is raised. Errors of scopes of
    several blocks carry the noise of ``probes`` random solves.
    """
    spark = comparisons.sparkSession
    kept = StepTables(spark)
    pairs = kept.cut(count_pairs(comparisons), keep=True)
    sides = pairs.select("scope", F.explode(F.array("a", "b")).alias("item")).distinct()
    items = kept.cut(sides.withColumn("id", F.xxhash64("item")), keep=True)
    few = {r["scope"] for r in pairs.groupBy("scope").count().collect() if r["count"] <= whole}  # a row per scope
    # Items travel as hashes; a scope in which two have the same one is left to the blocks.
    few -= {r["scope"] for r in items.groupBy("scope", "id").count().filter("count > 1").select("scope").distinct().collect()}
    own = F.col("scope").isin(*sorted(few))
    out = None
    if few:
        hashed = pairs.filter(own).select("scope", F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"), "n", "won")
        schema = "scope string, id long, strength double, std_error double, n_comparisons long, n_won long"
        fitted = kept.cut(hashed.groupBy("scope").applyInArrow(_fit_whole(ridge, probes, block), schema), keep=True)
        out = items.join(fitted, ["scope", "id"]).drop("id")
    rest = pairs.filter(~own)
    if not few or not rest.isEmpty():
        blocks = _in_steps(kept, _both_ways(rest), ridge, probes, block)
        out = blocks if out is None else out.unionByName(blocks)
    out = _placed(out)
    kept.close()
    return out


def _in_steps(kept: StepTables, pairs: DataFrame, ridge: float, probes: int, block: int) -> DataFrame:
    """Strengths and errors of scopes of any size, in rounds and steps over distributed vectors; ``pairs``: see ``_both_ways``."""
    spark = pairs.sparkSession
    rounds, pairs = StepTables(spark), kept.cut(pairs, keep=True)
    items = pairs.groupBy("scope", F.col("src").alias("item")).agg(
        F.sum("n").cast("long").alias("n_comparisons"), F.round(F.sum(F.col("n") * F.col("y"))).cast("long").alias("n_won")
    )
    items = kept.cut(items, keep=True)
    sizes = items.groupBy("scope").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / block))
    sizes = F.broadcast(kept.cut(sizes, keep=True))  # a row per scope
    in_block = lambda c: F.pmod(F.xxhash64("scope", c), F.col("blocks")).cast("int")
    edges = pairs.join(sizes, "scope").select("scope", "src", "dst", in_block("src").alias("src_block"), in_block("dst").alias("dst_block"), "n", "y")
    edges = kept.cut(edges, keep=True)
    placed = items.join(sizes, "scope").select("scope", "item", in_block("item").alias("block"))
    state = rounds.cut(_in_blocks(edges, placed, _fit_block(ridge), "scope string, item string, block int, s double"))

    for _ in range(MAX_ROUNDS):
        steps = StepTables(spark)
        weights = steps.cut(_weigh(edges, state), keep=True)
        pulls = weights.groupBy("scope", F.col("src").alias("item")).agg(F.sum("w").alias("deg"), F.sum("u").alias("u"))
        at = steps.cut(state.join(pulls, ["scope", "item"]).withColumn("b0", F.col("u") - F.lit(ridge) * F.col("s")).drop("u"), keep=True)
        off = at.agg(F.max(F.abs(F.col("b0")) / (F.col("deg") + ridge))).first()[0]
        if off is None or off < TOLERANCE:
            break
        start = at.withColumn("x0", F.lit(0.0))
        # Far from the solution a rough solve does.
        solved = _Solver(spark, weights, ridge, 1, steps).solve(start, 0.1 if off > 0.1 else 0.01)
        state = rounds.cut(state.join(solved.select("scope", "item", "x0"), ["scope", "item"]).select("scope", "item", "block", (F.col("s") + F.col("x0")).alias("s")))
        steps.close()
    else:
        raise RuntimeError(f"strengths did not converge in {MAX_ROUNDS} rounds")

    # The blocks' part of the errors, and solves with random signs for the rest. The constant
    # vector of a scope is an eigenvector of ``A`` with eigenvalue ``ridge``: its share of the diagonal,
    # 1 / (ridge size), is taken out of the estimate and added exactly.
    signs = [F.when(F.pmod(F.xxhash64("scope", "item", F.lit(j)), F.lit(2)) == 0, 1.0).otherwise(-1.0) for j in range(probes)]
    centre = kept.cut(items.groupBy("scope").agg(*[F.avg(x).alias(f"c{j}") for j, x in enumerate(signs)]), keep=True)
    solver = _Solver(spark, weights, ridge, probes, steps)
    sides = at.join(F.broadcast(centre), "scope").select("scope", "item", "block", "deg", *[(x - F.col(f"c{j}")).alias(f"r{j}") for j, x in enumerate(signs)])  # a row per scope
    numbers = ", ".join(f"{c} double" for c in ("deg", "own", "row_sum", *solver.names("r"), *solver.names("z")))
    known = _in_blocks(weights, sides, _invert_block(ridge, solver.names("r"), solver.names("z")), f"scope string, item string, block int, {numbers}")
    known = steps.cut(known, keep=True)
    start = known.select("scope", "item", "block", "deg", *[F.col(f"z{j}").alias(f"x{j}") for j in range(probes)], *[F.col(f"r{j}").alias(f"b{j}") for j in range(probes)])
    solved = solver.solve(start, 0.01).select("scope", "item", *solver.names("x"))
    both = known.select("scope", "item", "deg", "own", "row_sum", *solver.names("z")).join(solved, ["scope", "item"]).join(sizes, "scope")
    rest = sum((x * (F.col(f"x{j}") - F.col(f"z{j}")) for j, x in enumerate(signs)), F.lit(0.0)) / probes
    exact = F.col("own") + (F.lit(1.0 / ridge) - F.col("row_sum")) / F.col("size")
    variance = F.least(F.lit(1.0 / ridge), F.greatest(1 / (F.col("deg") + ridge), exact + rest))
    out = (
        items.join(state.select("scope", "item", "s"), ["scope", "item"])
        .join(both.select("scope", "item", F.sqrt(variance).alias("std_error")), ["scope", "item"])
        .select("scope", "item", F.col("s").alias("strength"), "std_error", "n_comparisons", "n_won")
    )
    out = kept.cut(out, keep=True)
    for tables in (steps, rounds):
        tables.close()
    return out


def _placed(df: DataFrame) -> DataFrame:
    """Ranks within the scopes without one task per scope: a global sort in ranges, and the
    number of rows of the scope in the ranges before."""
    ranged = cut_lineage(
        df.repartitionByRange("scope", F.col("strength").desc(), "item").withColumn("part", F.spark_partition_id())
    )
    sizes = ranged.groupBy("scope", "part").agg(F.count("*").alias("size"))
    before = sizes.withColumn(
        "before",
        F.coalesce(F.sum("size").over(Window.partitionBy("scope").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("size")
    inside = Window.partitionBy("scope", "part").orderBy(F.col("strength").desc(), "item")
    return (
        ranged.withColumn("k", F.row_number().over(inside))
        .join(before, ["scope", "part"])
        .select("scope", "item", "strength", "std_error", "n_comparisons", "n_won", (F.col("k") + F.col("before")).cast("int").alias("place"))
    )
