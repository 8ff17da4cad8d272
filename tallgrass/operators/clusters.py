"""Clusters by links: connected components, density clusters of vectors, near-duplicate texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.staging import ROW_BITS, settle

SHINGLE_WORDS = 5
SIMILARITY = 0.8
EPS_GRID = [float(e) for e in np.linspace(0.1, 0.5, 20)]
ROUNDS = 200
BLOCK = 5000  # texts of one shingle that meet all others of it in one task
FOREST_BLOCK = 70_000  # vectors of a side that are compared in one task
PART_ROWS, PART_COLUMNS = 1024, 1024  # of a matrix product that stays in the cache; multiples of eight
HELD = 1_000_000  # links that wait until they are joined


def _print_of(edges: DataFrame) -> tuple:
    """Number of links and two sums of their hashes, in one pass: equal for equal sets of distinct links."""
    total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), total("a", "b"), total("b", "a", F.lit(1))).first())


def components(links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b); a component is called by its least node.

    Large and small stars by turns: every round halves the depth of the trees, each round is checkpointed, and no
    component is ever collected. A graph that isn't done after ``rounds`` rounds is an error, never a partial result.
    """
    edges = settle(links.select("a", "b").where("a <> b").distinct())
    print_ = _print_of(edges)
    for _ in range(rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_b")).select("a", F.least("a", "_b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = settle(small)
        before, print_, edges = print_, _print_of(new), new
        if print_ == before:
            break
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    roots = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct()).distinct()


def shingle_sets(texts: DataFrame, ident: str, text: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """(ident, shingles): hashes of all word sequences of the given length; shorter texts are one shingle."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = texts.select(ident, tokens.alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - words + 1, F.lit(1)))
    return rows.select(ident, F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("_w", i, words), " ")))).alias("shingles"))


def near_duplicates(texts: DataFrame, ident: str, text: str, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per text: ident, class_id (least ident of its class) and links (similar different texts).

    Exact: texts with equal shingle sets collapse first; a set's rarest shingles, as many as two sets of the wanted
    Jaccard similarity can't all differ in, are the join keys, so that common shingles never meet. Null and blank texts
    are left out.
    """
    sets = shingle_sets(texts, ident, text, words).withColumn("key", F.xxhash64(F.array_sort("shingles")))
    distinct = settle(sets.groupBy("key").agg(F.min(ident).alias("rep"), F.first("shingles").alias("shingles")))
    flat = distinct.select("rep", F.size("shingles").alias("size"), F.explode("shingles").alias("s"))
    seen = flat.groupBy("s").agg(F.count("*").alias("df"))
    ranked = flat.join(seen, "s").withColumn("_r", F.row_number().over(Window.partitionBy("rep").orderBy("df", "s")))
    prefix = ranked.where((F.col("_r") <= F.col("size") - F.ceil(F.col("size") * similarity) + 1) & (F.col("df") > 1)).select("s", "rep", "size")
    # a shingle that many texts share is cut in blocks on one side, so that no list of texts meets itself in one task
    prefix = settle(prefix.join(prefix.groupBy("s").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks")), "s"))
    left = prefix.select("s", "rep", "size", F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int").alias("_salt"))
    other = prefix.select("s", F.col("rep").alias("rep2"), F.col("size").alias("size2"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_salt"))
    pairs = left.join(other, ["s", "_salt"]).where((F.col("rep") < F.col("rep2")) & (F.least("size", "size2") >= similarity * F.greatest("size", "size2"))).select("rep", "rep2").distinct()
    shared = pairs.join(distinct.select("rep", "shingles"), "rep").join(distinct.select(F.col("rep").alias("rep2"), F.col("shingles").alias("shingles2")), "rep2")
    common = F.size(F.array_intersect("shingles", "shingles2"))
    links = settle(shared.where(common >= similarity * (F.size("shingles") + F.size("shingles2") - common)).select(F.col("rep").alias("a"), F.col("rep2").alias("b")))
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    named = sets.select(ident, "key").join(distinct.select("key", "rep"), "key")
    named = named.join(components(links).withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    return named.select(ident, F.coalesce("component", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def unit_vectors(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """(ident, v): vectors without null or NaN entries, of length 1; zero vectors are left out."""
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return rows.where(F.col(vector).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))).withColumn("_n", norm).where("_n > 0").select(ident, F.transform(v, lambda x: x / F.col("_n")).alias("v"))


def close_pairs(units: DataFrame, ident: str, eps: float, block: int = 2000) -> DataFrame:
    """All pairs of unit vectors within cosine distance ``eps``: exact, in blocks.

    Vectors are cut in blocks that meet pairwise as matrices; the work is the square of the rows, which is what an
    exact answer without an index costs, and is spread evenly over (blocks squared / 2) tasks.
    """
    n = max(1, -(-units.count() // block))
    placed = units.withColumn("g", F.pmod(F.xxhash64(ident), F.lit(n)).cast("int"))
    left = placed.withColumn("cell", F.explode(F.sequence(F.col("g"), F.lit(n - 1)))).select(F.concat_ws("-", "g", "cell").alias("cell"), ident, "v")
    right = placed.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("g")))).select(F.concat_ws("-", "cell", "g").alias("cell"), ident, "v")
    kind = units.schema[ident].dataType.simpleString()

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            none = (b if a.empty else a)[ident].iloc[:0]  # keeps the type of the ids
            return pd.DataFrame({"a": none, "b": none})
        near = np.array(a["v"].tolist()) @ np.array(b["v"].tolist()).T >= 1 - eps
        i, j = np.nonzero(near)
        x, y = a[ident].to_numpy()[i], b[ident].to_numpy()[j]
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})[x != y].drop_duplicates()

    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInPandas(meet, f"a {kind}, b {kind}").distinct()


def density_clusters(rows: DataFrame, ident: str, vector: str, eps: float) -> DataFrame:
    """(ident, cluster) by density with two points to a neighbourhood, which makes clusters the components of the links;
    vectors without a neighbour are clusters of their own, named by themselves."""
    units = settle(unit_vectors(rows, ident, vector))
    groups = components(close_pairs(units, ident, eps))
    return units.select(ident).join(groups, F.col(ident) == F.col("node"), "left").select(ident, F.coalesce("component", ident).alias("cluster"))


def author_clusters(assigned: DataFrame, account: str, video: str, cluster: str, share: float = 0.5, least: int = 2) -> DataFrame:
    """(account, cluster, videos): clusters heard in more than ``share`` of an account's more than ``least`` videos."""
    total = assigned.groupBy(account).agg(F.countDistinct(video).alias("_all"))
    per = assigned.groupBy(account, cluster).agg(F.countDistinct(video).alias("videos"))
    return per.join(total, account).where((F.col("videos") > F.col("_all") * share) & (F.col("_all") > least)).drop("_all")


class _Forest:
    """Components of the links seen so far at each of several levels, from few links to many: a label per level and place."""

    def __init__(self, places: int, levels: int):
        self.labels = np.tile(np.arange(places, dtype=np.int32), (levels, 1))
        self.waiting: list[tuple] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray, level: np.ndarray) -> None:
        """Links between places, each from its level on; those within one component already are passed over."""
        news = self.labels[level, a] != self.labels[level, b]
        self.waiting.append((a[news], b[news], level[news]))
        self.held += int(news.sum())
        if self.held > HELD:
            self.join()

    def join(self) -> None:
        a, b, level = (np.concatenate(x) for x in zip(*self.waiting)) if self.waiting else (np.zeros(0, int),) * 3
        self.waiting, self.held = [], 0
        at = np.arange(self.labels.shape[1])
        for i, labels in enumerate(self.labels):
            own = level == i
            x, y = a[own], b[own]
            if i:  # what is together at one level is at the next
                x, y = np.concatenate([x, at]), np.concatenate([y, self.labels[i - 1]])
            while True:
                p, q = labels[x], labels[y]
                apart = p != q
                if not apart.any():
                    break
                x, y, p, q = x[apart], y[apart], p[apart], q[apart]
                np.minimum.at(labels, np.maximum(p, q), np.minimum(p, q))
                while (labels != labels[labels]).any():
                    labels[:] = labels[labels]

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, level): at most one a place; those up to a level connect what is connected at it."""
        self.join()
        at = np.arange(self.labels.shape[1])
        before = np.vstack([at, self.labels[:-1]])
        level, a = np.nonzero((before == at) & (self.labels != at))
        return a, self.labels[level, a], level


def _close(left: np.ndarray, right: np.ndarray, low: float, within: bool) -> Iterator[tuple]:
    """(places in left, places in right, cosines) of pairs of unit vectors with a cosine of ``low`` or more, part by part;
    ``within`` one set each pair once. Single precision finds them with room to spare, double precision decides."""
    width = left.shape[1]
    rough = [np.vstack([x, np.zeros((-len(x) % 8, width))]).astype(np.float32) for x in (left, right)]
    bound = np.float32(low - (width + 4) * 1.2e-7)
    product, mask = np.empty(PART_ROWS * PART_COLUMNS, np.float32), np.empty(PART_ROWS * PART_COLUMNS, bool)
    for i in range(0, len(left), PART_ROWS):
        for j in range(i // PART_COLUMNS * PART_COLUMNS if within else 0, len(right), PART_COLUMNS):
            x, y = rough[0][i : i + PART_ROWS], rough[1][j : j + PART_COLUMNS]
            size = len(x) * len(y)
            np.matmul(x, y.T, out=product[:size].reshape(len(x), len(y)))
            near = np.greater_equal(product[:size], bound, out=mask[:size])
            words = np.flatnonzero(near.view(np.uint64) != 0)  # eight at a time, as few are near
            word, bit = np.nonzero(near.reshape(-1, 8)[words])
            a, b = np.divmod(words[word] * 8 + bit, len(y))
            a, b = a + i, b + j
            real = (a < b) & (b < len(right)) if within else (a < len(left)) & (b < len(right))
            a, b = a[real], b[real]
            if len(a) * 8 > size:
                cosine = (left[i : i + PART_ROWS] @ right[j : j + PART_COLUMNS].T)[a - i, b - j]
            else:
                cosine = np.einsum("ij,ij->i", left[a], right[b])
            sure = cosine >= low
            if sure.any():
                yield a[sure], b[sure], cosine[sure]


def link_forest(units: DataFrame, ident: str, eps: float, block: int = FOREST_BLOCK, grid: Sequence[float] = EPS_GRID, known: str | None = None) -> DataFrame:
    """(a, b, cosine, known): links that connect, at ``eps`` and every smaller value of the grid, just what all close
    pairs connect; ``cosine`` is that of the least value at which they hold. Vectors needn't have length 1.

    All pairs are compared, each two blocks of vectors as matrices in one task, which gives a row for a vector instead of
    one for a pair. Where ``known`` names a flag, the rows of which it is true have a forest of their own besides.
    """
    n = max(1, -(-units.count() // block))
    placed = units.withColumn("g", F.pmod(F.xxhash64(ident), F.lit(n)).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda h: F.least("g", h) * n + F.greatest("g", h))
    kind = units.schema[ident].dataType.simpleString()
    values = sorted({float(e) for e in grid if e < eps} | {float(eps)})
    rising = np.array([1 - e for e in values][::-1])

    def span(rows: pd.DataFrame) -> pd.DataFrame:
        v, names, cell = np.array(rows["v"].tolist(), float), rows[ident].to_numpy(), int(rows["cell"].iloc[0])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        ours, theirs = (np.flatnonzero(rows["g"].to_numpy() == g) for g in divmod(cell, n))
        flags = rows[known].to_numpy(bool) if known else None
        forests = [_Forest(len(v), len(values)) for _ in range(2 if known else 1)]
        for a, b, cosine in _close(v[ours], v[theirs], rising[0], cell // n == cell % n):
            a, b, level = ours[a], theirs[b], len(values) - np.searchsorted(rising, cosine, side="right")
            forests[0].add(a, b, level)
            if known:
                both = flags[a] & flags[b]
                forests[1].add(a[both], b[both], level[both])
        out = []
        for k, forest in enumerate(forests):
            a, b, level = forest.edges()
            out.append(pd.DataFrame({"a": names[a], "b": names[b], "cosine": rising[::-1][level], "known": k == 1}))
        return pd.concat(out)

    # three ranges a cell: each cell has a task of its own
    sent = placed.withColumn("cell", F.explode(cells)).select("cell", "g", ident, "v", *([known] if known else []))
    return sent.repartitionByRange(3 * n * (n + 1) // 2, "cell").groupBy("cell").applyInPandas(span, f"a {kind}, b {kind}, cosine double, known boolean")


def cluster_levels(rows: DataFrame, ident: str, vector: str, grid: Sequence[float], known: str | None = None, block: int = FOREST_BLOCK) -> DataFrame:
    """``rows`` with sound vectors, with ``clusters`` in the vectors' place: the number of the density cluster at each value of
    the rising grid.

    Where ``known`` names a flag, ``known_clusters`` are those of the flagged rows alone. Equal vectors are compared once. The
    links of all blocks, a row a vector and block, are joined in one task, which holds a number per vector and value.
    """
    v = F.col(vector)
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
    named = rows.where(sound).withColumns({"_k": F.xxhash64(vector), "_l": F.xxhash64(vector, F.lit(1))})
    flag = [F.max(known).alias("known")] if known else []
    units = settle(named.groupBy("_k", "_l").agg(F.first(vector).alias("v"), *flag)).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33).cast("int")
    starts, total = [F.lit(0), F.lit(0)], 0  # dense numbers: where a partition begins, and the place in it
    for r in units.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        starts, total = [*starts, F.lit(r["part"] + 1), F.lit(total)], total + r["n"]
    units = units.withColumn("id", (F.element_at(F.create_map(*starts), part + 1) + F.col("_at").bitwiseAND(F.lit(ROW_BITS))).cast("int"))
    places, levels = total, len(grid)
    cosines = np.array([1 - float(e) for e in grid][::-1])

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forests = [_Forest(places, levels) for _ in range(2)]
        for batch in batches:
            level = levels - np.searchsorted(cosines, batch["cosine"].to_numpy(), side="right")
            which = batch["known"].to_numpy(bool)
            for forest, own in zip(forests, (~which, which)):
                forest.add(batch["a"].to_numpy()[own], batch["b"].to_numpy()[own], level[own])
        for forest in forests:
            forest.join()
        for i in range(0, places, 10000):
            every, flagged = (list(f.labels[:, i : i + 10000].T) for f in forests)
            yield pd.DataFrame({"id": range(i, i + len(every)), "clusters": every, "known_clusters": flagged})

    links = link_forest(units, "id", float(max(grid)), block, grid, "known" if known else None)
    found = links.repartition(1).mapInPandas(join, "id int, clusters array<int>, known_clusters array<int>")
    found = units.select("_k", "_l", "id").join(found if known else found.drop("known_clusters"), "id").drop("id")
    return named.drop(vector).join(found, ["_k", "_l"]).drop("_k", "_l")


def clusterings(rows: DataFrame, ident: str, vector: str, grid: Sequence[float]) -> Iterator[tuple[float, DataFrame]]:
    """Per value of the rising grid (eps, density clusters by number); the vectors are compared once, at the largest value."""
    found = settle(cluster_levels(rows.select(ident, vector), ident, vector, grid).select(ident, "clusters"))
    for i, eps in enumerate(grid):
        yield eps, found.select(ident, F.col("clusters")[i].alias("cluster"))


def choose_eps(rows: DataFrame, ident: str, vector: str, pairs: DataFrame, grid: list[float]) -> DataFrame:
    """(eps, accuracy) over labelled pairs (a, b, same): a pair is called the same if both lie in one cluster of two or more.

    The grid is short; each value is one clustering.
    """
    out = None
    for eps, found in clusterings(rows, ident, vector, grid):
        sized = found.withColumn("_n", F.count("*").over(Window.partitionBy("cluster"))).select(F.col(ident).alias("_id"), F.when(F.col("_n") > 1, F.col("cluster")).alias("c"))
        j = pairs.join(sized.withColumnsRenamed({"_id": "a", "c": "_ca"}), "a", "left").join(sized.withColumnsRenamed({"_id": "b", "c": "_cb"}), "b", "left")
        one = j.agg(F.avg((F.coalesce(F.col("_ca") == F.col("_cb"), F.lit(False)) == F.col("same")).cast("double")).alias("accuracy")).select(F.lit(float(eps)).alias("eps"), "accuracy")
        out = one if out is None else out.unionByName(one)
    return out


def label_scores(found: DataFrame, clusters: str, label: str, grid: Sequence[float]) -> DataFrame:
    """(eps, accuracy) of clusters at each value of the grid, over all pairs of rows of which at least one has a label: the
    same if the labels are equal, else different; two rows without a label are not judged. The pairs are counted per
    cluster and label, not made."""
    two = lambda n: n * (n - 1) / 2
    known = F.col(label).isNotNull()
    n = found.select(label, F.posexplode(clusters).alias("level", "cluster")).groupBy("level", "cluster", label).agg(F.count("*").cast("double").alias("n"))
    own = F.sum(F.when(known, F.col("n")).otherwise(0.0))
    counts = n.groupBy("level", "cluster").agg(own.alias("own"), F.sum(F.when(known, 0.0).otherwise(F.col("n"))).alias("other"), F.sum(F.when(known, two(F.col("n"))).otherwise(0.0)).alias("right"))
    wrong = two(F.col("own")) - F.col("right") + F.col("own") * F.col("other")
    sums = counts.groupBy("level").agg(F.sum("right").alias("right"), F.sum(wrong).alias("wrong"), F.sum("own").alias("own"), F.sum("other").alias("other")).collect()
    same = found.where(known).groupBy(label).agg(F.count("*").cast("double").alias("n")).agg(F.sum(two(F.col("n")))).first()[0]
    scores = {}
    for c in sums:
        pairs = two(c["own"]) + c["own"] * c["other"] if c["own"] else 0.0
        scores[c["level"]] = (c["right"] + pairs - same - c["wrong"]) / pairs if pairs else None
    return found.sparkSession.createDataFrame([(float(eps), scores.get(i)) for i, eps in enumerate(grid)], "eps double, accuracy double")


def eps_by_labels(rows: DataFrame, ident: str, vector: str, label: str, grid: Sequence[float]) -> DataFrame:
    """(eps, accuracy) over labelled pairs, see ``label_scores``, of density clusters at each value of the rising grid."""
    found = settle(cluster_levels(rows.select(ident, vector, label).dropDuplicates([ident]), ident, vector, grid).select(label, "clusters"))
    return label_scores(found, "clusters", label, grid)


def best_eps(scores: DataFrame) -> float:
    """The least value of the highest accuracy."""
    return scores.where("accuracy is not null").orderBy(F.desc("accuracy"), "eps").first()["eps"]
