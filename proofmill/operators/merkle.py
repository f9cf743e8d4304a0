"""Merkle trees of packages with any number of files: roots, inclusion proofs, and their check.

Leaves are numbered in path order and folded in rounds. A round cuts a package's nodes into runs of RUN and folds each run
in a row of its own, log2(RUN) levels at once: runs begin at multiples of a power of two, so a run's root is the whole
tree's node there, and an odd last node moves up in its run as it does in the whole. Three rounds take 2**30 leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import leaf

#: Nodes that are folded in one row, a power of two; so many rounds.
RUN, ROUNDS = 1 << 10, 3
#: Paths are numbered among those with the same first characters.
_PREFIX = 24
_SIBLINGS = "array<struct<left:boolean,hash:string>>"


def parent(left: Column, right: Column) -> Column:
    """A node over two, from the bytes of their hex."""
    return F.sha2(F.concat(F.unhex(left), F.unhex(right)), 256)


def numbered(hashes: DataFrame) -> DataFrame:
    """(package_id, path, i, h): leaves of (package_id, path, sha256), numbered from 0 by path. Of equal paths the least
    hash comes first. Paths are numbered by their first characters, and counts of the prefixes before are added, so a
    package isn't sorted in one task unless all of its paths begin alike."""
    rows = hashes.select("package_id", "path", leaf(F.col("path"), F.col("sha256")).alias("h"), F.substring("path", 1, _PREFIX).alias("prefix"))
    before = Window.partitionBy("package_id").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("package_id", "prefix").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("package_id", "prefix").orderBy("path", "h")
    placed = rows.withColumn("k", F.row_number().over(within)).join(counts, ["package_id", "prefix"])
    return placed.select("package_id", "path", (F.col("k") + F.col("before") - 1).alias("i"), "h")


def _above(nodes: Column) -> Column:
    pairs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: F.when(2 * i + 1 < F.size(nodes), parent(F.get(nodes, 2 * i), F.get(nodes, 2 * i + 1))).otherwise(F.get(nodes, 2 * i)))


def _runs(nodes: DataFrame, run: int) -> DataFrame:
    """(package_id, run, levels): the levels of each run of nodes (package_id, i, h), from the nodes to the one that is left."""
    rows = nodes.groupBy("package_id", F.expr(f"i div {run}").alias("run")).agg(F.array_sort(F.collect_list(F.struct("i", "h")))["h"].alias("nodes"))
    steps = F.sequence(F.lit(1), F.lit(run.bit_length() - 1))
    levels = F.aggregate(steps, F.array("nodes"), lambda levels, _: F.concat(levels, F.array(_above(F.element_at(levels, -1)))))
    return rows.select("package_id", "run", levels.alias("levels"))


def _root_of(run: Column) -> Column:
    return F.get(F.element_at(run, -1), F.lit(0))


def merkle_roots(hashes: DataFrame, run: int = RUN) -> DataFrame:
    """(package_id, n_leaves, root) of (package_id, path, sha256); a package without files has no row."""
    nodes = numbered(hashes).select("package_id", "i", "h")
    sizes = nodes.groupBy("package_id").agg(F.count("*").alias("n_leaves"))
    for _ in range(ROUNDS):
        nodes = _runs(nodes, run).select("package_id", F.col("run").alias("i"), _root_of(F.col("levels")).alias("h"))
    return nodes.join(sizes, "package_id").select("package_id", "n_leaves", F.col("h").alias("root"))


def merkle_proofs(hashes: DataFrame, run: int = RUN) -> DataFrame:
    """(package_id, path, i, leaf, proof): for each file the siblings on the way to the root, the lowest first. left: it
    stands to the left. A node that moves up as it is has no sibling there."""
    leaves = numbered(hashes)
    nodes, found = leaves.select("package_id", "i", "h"), None
    for r in range(ROUNDS):
        runs = _runs(nodes, run)

        def sibling(level: Column, n: Column) -> Column:
            other = F.when(n % 2 == 0, n + 1).otherwise(n - 1).cast("int")
            return F.struct((n % 2 == 1).alias("left"), F.get(level, other).alias("hash"))

        ways = F.transform(F.get("levels", F.lit(0)), lambda _, j: F.filter(F.transform("levels", lambda level, k: sibling(level, F.call_function("shiftright", j, k))), lambda s: s["hash"].isNotNull()))
        ways = runs.select("package_id", "run", F.posexplode(ways).alias("j", "siblings")).select("package_id", (F.col("run") * run + F.col("j")).alias(f"n{r}"), F.col("siblings").cast(_SIBLINGS).alias(f"s{r}"))
        step = leaves.select("package_id", "path", "i", F.col("h").alias("leaf"), F.expr(f"i div {run**r}").alias(f"n{r}")) if found is None else found.withColumn(f"n{r}", F.expr(f"i div {run**r}"))
        found = step.join(ways, ["package_id", f"n{r}"]).drop(f"n{r}")
        nodes = runs.select("package_id", F.col("run").alias("i"), _root_of(F.col("levels")).alias("h"))
    return found.select("package_id", "path", "i", "leaf", F.concat(*[f"s{r}" for r in range(ROUNDS)]).alias("proof"))


def proven_root(leaf_hash: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf_hash, lambda h, s: F.when(s["left"], parent(s["hash"], h)).otherwise(parent(h, s["hash"])))


def unproven(proofs: DataFrame, roots: DataFrame) -> DataFrame:
    """Proofs (package_id, path, sha256, proof) of files that don't lead to their package's root (package_id, root)."""
    both = proofs.join(roots.select("package_id", "root"), "package_id", "left")
    return both.where(~F.coalesce(proven_root(leaf(F.col("path"), F.col("sha256")), F.col("proof")) == F.col("root"), F.lit(False))).select("package_id", "path")

