"""Rankers over first events: popularity, recent popularity, item neighbours, random walks, factors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillrank.operators import snapshot
from quillrank.runtime import bounded, partitions, written

MS_PER_DAY = 86_400_000
#: Likes of one user that meet all the user's likes in one task.
CHUNK_LIKES = 500
#: Bytes of edges (9 each) that a Python worker may hold for the methods that need the whole graph.
WORKER_BYTES = 180_000_000
#: Bytes of cosines that a task holds at a time.
HELD_BYTES = 128 << 20
#: Edges that one block of factor training holds.
BLOCK_EDGES = 5_000_000
#: Times a drawn item that its user has met is drawn again before it is drawn from the unmet ones only.
REDRAWS = 20
#: Users and items of one block of scoring by factors.
BLOCK_USERS, BLOCK_ITEMS = 20_000, 50_000
#: Scores that a task holds at a time.
HELD_SCORES = 2_000_000
#: Paths that a task follows at a time.
HELD_PATHS = 1_000_000
#: Users and items, of each at most so many, whose paths are a matrix product instead of being followed one by one.
DENSE = 32


def edges(clean: DataFrame, cutoff: int, threshold: float = 4.0) -> DataFrame:
    """``user_id, item_id, timestamp, positive``: first events before the cutoff. A NULL rating is history, not liked."""
    first = snapshot.first_events(snapshot.before(clean, cutoff))
    return first.select("user_id", "item_id", "timestamp", F.coalesce(F.col("rating") >= threshold, F.lit(False)).alias("positive"))


def popularity(edge: DataFrame, cutoff: int, window_days: float | None = None) -> DataFrame:
    """``item_id, popularity, recent``: liked first events of each known item, in all and in the last days."""
    since = cutoff - (window_days or 0) * MS_PER_DAY
    return edge.groupBy("item_id").agg(F.count_if("positive").alias("popularity"), F.count_if(F.col("positive") & (F.col("timestamp") >= since)).alias("recent"))


def placed(catalog: DataFrame, order: list[Column]) -> DataFrame:
    """The catalogue with ``place``, counted from 1 in the given total order, without one task sorting it all.

    Ranges of the order are sorted side by side; the sizes of the ranges before give each its offset.
    """
    ranged = written(catalog.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("piece", F.spark_partition_id()), "placed")
    sizes = ranged.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    offset = sizes.withColumn("offset", F.sum("n").over(W.orderBy("piece").rowsBetween(W.unboundedPreceding, -1))).select("piece", F.coalesce("offset", F.lit(0)).alias("offset"))  # a row per piece
    inside = F.row_number().over(W.partitionBy("piece").orderBy(*order))
    return ranged.withColumn("inside", inside).join(F.broadcast(offset), "piece").withColumn("place", F.col("inside") + F.col("offset")).drop("piece", "inside", "offset")


def best_unseen(users: DataFrame, edge: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """``user_id, rank, item_id``: each user's first ``k`` items of a common ranking that are not in their history.

    ``ranked`` has ``item_id, place``. The j-th unseen place is j plus the number of seen places that lie, less
    their own number among the user's seen ones, below j; so only counts per user are made, never users times items.
    """
    seen = edge.join(users, "user_id", "left_semi").join(ranked.select("item_id", "place"), "item_id").select("user_id", "place")
    gap = seen.withColumn("gap", F.col("place") - F.row_number().over(W.partitionBy("user_id").orderBy("place"))).where(F.col("gap") < k)
    passed = gap.groupBy("user_id").agg(*[F.count_if(F.col("gap") < j).alias(f"p{j}") for j in range(1, k + 1)])
    every = users.select("user_id").distinct().join(passed, "user_id", "left")
    places = F.array(*[F.struct(F.lit(j).alias("rank"), (j + F.coalesce(F.col(f"p{j}"), F.lit(0))).alias("place")) for j in range(1, k + 1)])
    wanted = every.select("user_id", F.inline(places))
    return wanted.join(ranked.select("item_id", "place"), "place").select("user_id", "rank", "item_id")


def popular(users: DataFrame, edge: DataFrame, cutoff: int, k: int, window_days: float | None = None) -> DataFrame:
    """Top ``k`` unseen items by likes, or by likes of the last days with all-time likes breaking ties; then by item."""
    counted = popularity(edge, cutoff, window_days)
    order = [F.col("popularity").desc(), F.col("item_id").asc()]
    if window_days is not None:
        order = [F.col("recent").desc(), *order]
    ranked = placed(counted, order)
    score = "recent" if window_days is not None else "popularity"
    return best_unseen(users, edge, ranked, k).join(ranked.select("item_id", score), "item_id").select("user_id", "rank", "item_id", F.col(score).cast("double").alias("score"))


def item_similarity(edge: DataFrame) -> DataFrame:
    """``item_a, item_b, common, similarity``: cosine of the sets of users who liked both, each ordered pair once."""
    liked = edge.where("positive").select("user_id", "item_id")
    degree = liked.groupBy("item_id").agg(F.count(F.lit(1)).alias("degree"))
    # A user's likes are cut into chunks, each of which meets all of them in a task of its own.
    cut = liked.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / CHUNK_LIKES).cast("int").alias("chunks"))
    sized = liked.join(cut, "user_id")
    left = sized.select("user_id", F.col("item_id").alias("item_a"), F.pmod(F.hash("item_id"), F.col("chunks")).alias("chunk"))
    right = sized.select("user_id", F.col("item_id").alias("item_b"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    pairs = left.join(right, ["user_id", "chunk"]).where("item_a < item_b")
    common = pairs.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("common"))
    a, b = degree.select(F.col("item_id").alias("item_a"), F.col("degree").alias("da")), degree.select(F.col("item_id").alias("item_b"), F.col("degree").alias("db"))
    return common.join(a, "item_a").join(b, "item_b").select("item_a", "item_b", "common", (F.col("common") / F.sqrt(F.col("da") * F.col("db"))).alias("similarity"))


def neighbour_scores(users: DataFrame, edge: DataFrame, neighbours: int | None = None) -> DataFrame:
    """``user_id, item_id, score``: for each unseen item the sum of its cosines (the strongest ``neighbours``) with
    the items the user likes. Sums are rounded to 12 digits, so that near-equal ones are equal."""
    one = item_similarity(edge)
    both = one.select("item_a", "item_b", "similarity").unionByName(one.select(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b"), "similarity"))
    liked = edge.where("positive").join(users, "user_id", "left_semi").select("user_id", F.col("item_id").alias("item_a"))
    rows = liked.join(both, "item_a").select("user_id", F.col("item_b").alias("item_id"), "item_a", "similarity")
    if neighbours:
        at = F.row_number().over(W.partitionBy("user_id", "item_id").orderBy(F.col("similarity").desc(), F.col("item_a").asc()))
        rows = rows.withColumn("at", at).where(F.col("at") <= neighbours)
    sums = rows.groupBy("user_id", "item_id").agg(F.round(F.sum("similarity"), 12).alias("score"))
    return sums.join(edge.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")  # fewer rows than before the sums


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """``user_id, rank, item_id, score``: each user's best ``k`` by score, then item."""
    at = F.row_number().over(W.partitionBy("user_id").orderBy(F.col("score").desc(), F.col("item_id").asc()))
    return scores.withColumn("rank", at).where(F.col("rank") <= k).select("user_id", "rank", "item_id", "score")


def with_fallback(own: DataFrame, users: DataFrame, edge: DataFrame, cutoff: int, k: int, zero_reason: str | None) -> DataFrame:
    """A ranker's top ``k`` where the user likes something and a score is above 0, else popularity, with the reason."""
    own = written(own, "own")
    liking = edge.where("positive").select("user_id").distinct()
    scored = own.groupBy("user_id").agg(F.max("score").alias("most")).where("most > 0").select("user_id") if zero_reason else own.select("user_id").distinct()
    good = own.join(scored, "user_id", "left_semi").withColumn("fallback_reason", F.lit(None).cast("string"))
    rest = users.select("user_id").distinct().join(scored, "user_id", "left_anti")
    marked = rest.join(liking.withColumn("likes", F.lit(True)), "user_id", "left")
    reason = F.when(F.col("likes"), F.lit(zero_reason)).otherwise(F.lit("no_positive_history"))
    other = popular(rest, edge, cutoff, k).join(marked.select("user_id", reason.alias("fallback_reason")), "user_id")
    return good.select("user_id", "rank", "item_id", "score", "fallback_reason").unionByName(other.select("user_id", "rank", "item_id", "score", "fallback_reason"))


def numbered(ids: DataFrame, name: str, number: str) -> DataFrame:
    """Distinct values of a column with a number from 0 in their order, as a written table."""
    rows = placed(ids.select(name).where(F.col(name).isNotNull()).distinct(), [F.col(name).asc()])
    return written(rows.select(name, (F.col("place") - 1).cast("int").alias(number)), "numbers")


class Graph:
    """Edges as arrays of whole numbers, by user and by item: what users have met, and what of it they like."""

    def __init__(self, u: np.ndarray, i: np.ndarray, liked: np.ndarray, users: int, items: int) -> None:
        self.users, self.items = users, items
        self.met, self.met_cut = self._rows(u, i, users)
        self.likes, self.likes_cut = self._rows(u[liked], i[liked], users)
        self.fans, self.fans_cut = self._rows(i[liked], u[liked], items)
        self.degree = np.diff(self.fans_cut)

    @staticmethod
    def _rows(of: np.ndarray, what: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((what, of))
        return what[order], np.searchsorted(of[order], np.arange(n + 1))

    def liked(self, user: int) -> np.ndarray:
        return self.likes[self.likes_cut[user] : self.likes_cut[user + 1]]

    def seen(self, user: int) -> np.ndarray:
        return self.met[self.met_cut[user] : self.met_cut[user + 1]]

    def cosines(self, item: int) -> np.ndarray:
        """An item's cosine with every item, itself left out."""
        fans = self.fans[self.fans_cut[item] : self.fans_cut[item + 1]]
        common = np.zeros(self.items)
        for part in np.array_split(fans, len(fans) // 4096 + 1):
            places = [np.arange(self.likes_cut[u], self.likes_cut[u + 1]) for u in part]
            if places:
                common += np.bincount(self.likes[np.concatenate(places)], minlength=self.items)
        common[item] = 0.0
        return common / np.sqrt(np.maximum(self.degree[item] * self.degree, 1))


def _ranges(cut: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of some rows of a cut array, and the places of their values one row after the other."""
    n = cut[of + 1] - cut[of]
    return n, np.arange(n.sum()) + np.repeat(cut[of] - (np.cumsum(n) - n), n)


class Held:
    """The arrays of a graph as they are sent; a worker makes the graph from them once."""

    def __init__(self, *arrays: np.ndarray | int) -> None:
        self.arrays = arrays
        self.made: dict[str, object] = {}

    @cached_property
    def graph(self) -> Graph:
        return Graph(*self.arrays)

    def once(self, name: str, make: Callable[[Graph], object]) -> object:
        """What ``make`` makes of the graph, kept by the worker."""
        if name not in self.made:
            self.made[name] = make(self.graph)
        return self.made[name]


class Hops:
    """Scores of items over two steps: the sum of ``a[j] g[v] b[c]`` over the liked items j, their fans v and v's liked items c.

    Paths through the largest users and from the items with most paths (``DENSE``) lead nearly everywhere; they are a
    product with a dense row for each. All others are followed.
    """

    def __init__(self, graph: Graph, a: np.ndarray, g: np.ndarray, b: np.ndarray) -> None:
        self.graph, self.a, self.g, self.b = graph, a, g, b
        likes = np.diff(graph.likes_cut)
        large = np.argsort(-likes, kind="stable")[:DENSE]
        self.large = large[likes[large] > graph.items // 64]
        self.member = np.zeros((len(self.large), graph.items))
        for row, u in zip(self.member, self.large, strict=True):
            row[graph.liked(u)] = 1.0
        light = np.ones(graph.users, bool)
        light[self.large] = False
        kept = light[graph.fans]
        self.fans, self.fans_cut = graph.fans[kept], np.r_[0, np.cumsum(kept)][graph.fans_cut]
        self.paths = np.diff(np.r_[0, np.cumsum(likes[self.fans])][self.fans_cut])  # of each item, without those through large users
        hot = np.argsort(-self.paths, kind="stable")[:DENSE]
        self.hot = hot[self.paths[hot] > graph.items // 64]
        self.place = np.full(graph.items, -1)
        self.place[self.hot] = np.arange(len(self.hot)) + len(self.large)
        self.around = np.zeros((len(self.hot), graph.items))
        for row, j in zip(self.around, self.hot, strict=True):
            fans = self.fans[self.fans_cut[j] : self.fans_cut[j + 1]]
            for part in np.array_split(fans, len(fans) // 4096 + 1):
                n, at = _ranges(graph.likes_cut, part)
                row += np.bincount(graph.likes[at], np.repeat(g[part], n), graph.items)
        self.rows = np.concatenate([self.member * g[self.large][:, None], self.around]) * b

    def scores(self, row: np.ndarray, j: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """For each row (``row`` ascending, from 0) the scores of all items from its liked items ``j``, times its scale."""
        graph, weight = self.graph, self.a[j] * scale[row]
        by = np.zeros((len(scale), len(self.rows)))
        for n, member in enumerate(self.member):
            by[:, n] = np.bincount(row, weight * member[j], len(scale))
        hot = self.place[j] >= 0
        by[row[hot], self.place[j[hot]]] = weight[hot]
        out = by @ self.rows
        flat = out.reshape(-1)
        for at, end, c in self._paths(j):
            np.add.at(flat, row[at] * graph.items + c, weight[at] * self.g[end] * self.b[c])
        return out

    def _paths(self, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The paths from the items ``j`` that are followed, in parts: the place in ``j`` where each begins, its user and its last item."""
        follow = np.flatnonzero(self.place[j] < 0)
        for part in np.split(follow, np.flatnonzero(np.diff(np.cumsum(self.paths[j[follow]]) // HELD_PATHS)) + 1):
            n, at = _ranges(self.fans_cut, j[part])
            v = self.fans[at]
            more, to = _ranges(self.graph.likes_cut, v)
            yield np.repeat(np.repeat(part, n), more), np.repeat(v, more), self.graph.likes[to]

    def cosines(self, row: np.ndarray, j: np.ndarray, found: np.ndarray, c: np.ndarray) -> np.ndarray:
        """For pairs of a row (``found``, ascending) and an item the sum of cosines with the row's liked items, each from its whole number of common users."""
        graph, cut = self.graph, np.searchsorted(row, np.arange(row.max(initial=0) + 2))
        n, at = _ranges(cut, found)
        to, own = np.repeat(c, n), j[at]
        common = np.zeros(len(at))
        for member in self.member:
            common += member[own] * member[to]
        hot = np.flatnonzero(self.place[own] >= 0)
        common[hot] += self.around[self.place[own[hot]] - len(self.large), to[hot]]
        code = found * graph.items + c
        order = np.argsort(code)
        begin = (np.cumsum(n) - n)[order]
        for start, _, end in self._paths(j):
            key = row[start] * graph.items + end
            place = np.minimum(np.searchsorted(code[order], key), max(len(code) - 1, 0))
            hit = np.flatnonzero(code[order][place] == key) if len(code) else place[:0]
            np.add.at(common, begin[place[hit]] + start[hit] - cut[row[start[hit]]], 1.0)
        degree = graph.degree.astype(np.int64)
        return np.bincount(np.repeat(np.arange(len(c)), n), common / np.sqrt(np.maximum(degree[own] * degree[to], 1)), len(c))


def _near_best(score: np.ndarray, k: int, slack: float, least: float = np.nextafter(0, 1)) -> tuple[np.ndarray, np.ndarray]:
    """``row, column`` of the scores from ``least`` on, usually above 0, that are among each row's ``k`` largest, or less than ``slack`` below; without sorting the rows."""
    most = score
    while most.shape[1] > 16 * k + 16:
        half = (most.shape[1] + 1) // 2
        left, right = most[:, :half].copy(), most[:, half:]
        np.maximum(left[:, : right.shape[1]], right, out=left[:, : right.shape[1]])
        most = left
    least = np.full(len(score), least)
    if most.shape[1] > k:  # at least k columns are as large
        least = np.maximum(least, np.partition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k] - slack)
    row, column = np.divmod(np.flatnonzero(score >= least[:, None]), max(score.shape[1], 1))
    # A fold keeps one of several large ones; so the k-th is now taken from all that are left.
    order = np.lexsort((-score[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, row)
    kth = np.minimum(first + k, np.searchsorted(row, row, "right")) - 1
    near = score[row, column] >= score[row, column][kth] - slack
    return row[near], column[near]


def _first(row: np.ndarray, column: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``row, rank, column, score``: each row's best ``k`` by rounded score, then column."""
    score = np.round(score, 12)
    order = np.lexsort((column, -score, row))
    row, column, score = row[order], column[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
    top = rank <= k
    return row[top], rank[top], column[top], score[top]


def _near_best_first(score: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, column, score`` of as many of each row's largest scores as are wanted, as :func:`_first` orders them."""
    most = int(wanted.max())
    row, rank, column, score = _first(*(near := _near_best(score, most, 1e-11, -np.inf)), score[near], most)
    kept = rank <= wanted[row]
    return row[kept], column[kept], score[kept]


def hops_top(held: Held, name: str, make: Callable[[Graph], Hops], asked: np.ndarray, k: int, scale: Callable[[Graph], np.ndarray] | None = None, summed: bool = False) -> Iterator[pa.RecordBatch]:
    """The best ``k`` unseen items of the asked users; or of items, as if of users who have met and like just that item, if ``scale`` is None.

    ``summed`` gives sums of cosines in their usual form, so that the last digit is not one of another order of sums."""
    graph, hops = held.graph, held.once(name, make)
    scales = scale(graph) if scale else None
    size = max(1, HELD_SCORES // max(graph.items, 1))
    for at in range(0, len(asked), size):
        part = asked[at : at + size]
        if scales is None:
            row, j = np.arange(len(part)), part
            seen, met = row, part
            own = np.ones(len(part))
        else:
            n, places = _ranges(graph.likes_cut, part)
            row, j = np.repeat(np.arange(len(part)), n), graph.likes[places]
            n, places = _ranges(graph.met_cut, part)
            seen, met = np.repeat(np.arange(len(part)), n), graph.met[places]
            own = scales[part]
        score = hops.scores(row, j, own)
        score[seen, met] = 0.0
        found, i = _near_best(score, k, 1e-11)
        best = hops.cosines(row, j, found, i) if summed else score[found, i]
        row, rank, i, best = _first(found, i, best, k)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part[row].astype(np.int32), rank.astype(np.int32), i.astype(np.int32), best)], names=["u", "rank", "i", "score"])


def _cosine_hops(graph: Graph) -> Hops:
    root = 1.0 / np.sqrt(np.maximum(graph.degree, 1))
    return Hops(graph, root, np.ones(graph.users), root)


def _walk_hops(graph: Graph) -> Hops:
    return Hops(graph, 1.0 / np.maximum(graph.degree, 1), 1.0 / np.maximum(np.diff(graph.likes_cut), 1), np.ones(graph.items))


def _asked(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    return np.concatenate([b["u"].to_numpy() for b in batches] + [np.zeros(0, np.int32)]).astype(np.int64)


class Sent:
    """The edges of a graph as whole numbers, sent to every worker, and the names of the numbers."""

    def __init__(self, edge: DataFrame) -> None:
        self.names, self.items = numbered(edge, "user_id", "u"), numbered(edge, "item_id", "i")
        rows = edge.join(bounded(self.items), "item_id").join(bounded(self.names), "user_id").select("u", "i", "positive")
        held = written(rows, "numbered-edges").toArrow()  # bounded by WORKER_BYTES, see sent_graph
        arrays = [held[c].to_numpy() for c in ("u", "i", "positive")]
        self.graph = edge.sparkSession.sparkContext.broadcast(Held(*arrays, self.names.count(), self.items.count()))

    def wanted(self, users: DataFrame) -> DataFrame:
        """The numbers of the users, spread over at least as many tasks as there are cores."""
        return users.select("user_id").distinct().join(self.names, "user_id").select("u").repartition(partitions(users.sparkSession))

    def named(self, rows: DataFrame) -> DataFrame:
        return rows.join(bounded(self.names), "u").join(bounded(self.items), "i").drop("u", "i")


def sent_graph(edge: DataFrame) -> Sent | None:
    """The graph for every worker, if its edges are counted to take at most ``WORKER_BYTES``; else None."""
    most = WORKER_BYTES // 9
    return Sent(edge) if edge.limit(most + 1).count() <= most else None


def _best_unseen(graph: Graph, user: int, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The user's ``k`` best items above 0 that they haven't met, and their scores; items are numbered in the order of their names."""
    score = np.round(score, 12)
    score[graph.seen(user)] = 0.0
    above = np.flatnonzero(score > 0)
    if len(above) > k:
        above = above[score[above] >= -np.partition(-score[above], k - 1)[k - 1]]
    top = above[np.lexsort((above, -score[above]))[:k]]
    return top, score[top]


_TOP = "u int, rank int, i int, score double"


def _top_batch(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    sizes = [len(items) for _, items, _ in rows]
    u = np.repeat(np.array([u for u, _, _ in rows], np.int32), sizes)
    rank = np.concatenate([np.arange(1, n + 1, dtype=np.int32) for n in sizes]) if rows else np.zeros(0, np.int32)
    i = np.concatenate([x.astype(np.int32) for _, x, _ in rows]) if rows else np.zeros(0, np.int32)
    score = np.concatenate([x for _, _, x in rows]) if rows else np.zeros(0)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (u, rank, i, score)], names=["u", "rank", "i", "score"])


def neighbours_top(users: DataFrame, edge: DataFrame, cutoff: int, k: int, neighbours: int | None = None) -> DataFrame:
    """Top ``k`` unseen items by the summed cosines of :func:`neighbour_scores`, else popularity with the reason.

    Where the edges fit a worker (``WORKER_BYTES``), each worker makes the cosines of the items its users like
    from them; a larger graph is joined. Both ways give the same rows.
    """
    sent = sent_graph(edge)
    if sent is None:
        return with_fallback(top_k(neighbour_scores(users, edge, neighbours), k), users, edge, cutoff, k, "no_similar_items")
    held = sent.graph

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not neighbours:
            yield from hops_top(held.value, "cosines", _cosine_hops, _asked(batches), k, lambda graph: np.ones(graph.users), summed=True)
            return
        graph = held.value.graph
        rows: dict[int, np.ndarray] = {}
        most = max(1, HELD_BYTES // (8 * max(graph.items, 1)))

        def row(item: int) -> np.ndarray:
            if item not in rows:
                if len(rows) >= most:
                    rows.clear()
                rows[item] = graph.cosines(item)
            return rows[item]

        def total(user: int) -> np.ndarray:
            own = graph.liked(user)
            out = np.zeros((min(neighbours or 1, max(len(own), 1)), graph.items))
            for j in own:
                if not neighbours or neighbours >= len(own):
                    out[0] += row(j)
                else:  # the strongest so far of each item, weakest first
                    out[0] = np.maximum(out[0], row(j))
                    out.sort(axis=0)
            return out.sum(axis=0)

        for batch in batches:
            yield _top_batch([(u, *_best_unseen(graph, u, total(u), k)) for u in batch["u"].to_pylist()])

    own = sent.named(sent.wanted(users).mapInArrow(run, _TOP))
    return with_fallback(own, users, edge, cutoff, k, "no_similar_items")


def walk_steps(users: DataFrame, edge: DataFrame, damping: float = 0.85, steps: int = 2) -> DataFrame:
    """``user_id, item_id, score``: item mass of a restarting walk after ``steps`` double steps, by joins alone.

    p(1) = d v and p(t + 2) = d^2 M p(t) + d (1 - d) v, where v spreads a user's mass over their liked items and M goes
    from item to users and back. Scores are rounded to 12 digits. Each step is written, so plans stay short.
    """
    liked = written(edge.where("positive").select("user_id", "item_id"), "liked")
    to_item = liked.join(liked.groupBy("user_id").agg((F.lit(1.0) / F.count(F.lit(1))).alias("u")), "user_id")
    to_user = liked.join(liked.groupBy("item_id").agg((F.lit(1.0) / F.count(F.lit(1))).alias("w")), "item_id")
    start = written(to_item.join(users, "user_id", "left_semi").select("user_id", "item_id", F.col("u").alias("v")), "start")
    mass = start.select("user_id", "item_id", (damping * F.col("v")).alias("p"))
    for _ in range(steps):
        at_users = mass.join(to_user.select(F.col("user_id").alias("via"), "item_id", "w"), "item_id").groupBy("user_id", "via").agg(F.sum(F.col("p") * F.col("w")).alias("p"))
        moved = at_users.join(to_item.select(F.col("user_id").alias("via"), "item_id", "u"), "via").select("user_id", "item_id", (damping * damping * F.col("p") * F.col("u")).alias("p"))
        back = start.select("user_id", "item_id", (damping * (1 - damping) * F.col("v")).alias("p"))
        mass = written(moved.unionByName(back).groupBy("user_id", "item_id").agg(F.sum("p").alias("p")), "mass")
    return mass.join(edge.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti").select("user_id", "item_id", F.round("p", 12).alias("score"))


def steps_top(users: DataFrame, edge: DataFrame, k: int, damping: float = 0.85) -> DataFrame:
    """``user_id, rank, item_id, score``: top ``k`` unseen items after the first double step of :func:`walk_steps`.

    Each worker follows the two steps over the edges where they fit (``WORKER_BYTES``); a larger graph is joined.
    """
    sent = sent_graph(edge)
    if sent is None:
        return top_k(walk_steps(users, edge, damping, 1), k)
    held = sent.graph

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from hops_top(held.value, "walk", _walk_hops, _asked(batches), k, lambda graph: damping * damping * damping / np.maximum(np.diff(graph.likes_cut), 1))

    return sent.named(sent.wanted(users).mapInArrow(run, _TOP)).select("user_id", "rank", "item_id", "score")


def nearest_items(edge: DataFrame, k: int) -> DataFrame:
    """``item_id, rank, near_item, score``: the ``k`` items of largest cosine with each item, rounded to 12 digits; then by item.

    Made by each worker from the edges where they fit (``WORKER_BYTES``); the pairs of a larger graph are joined.
    """
    sent = sent_graph(edge)
    if sent is None:
        one = item_similarity(edge).withColumn("similarity", F.round("similarity", 12))
        both = one.select("item_a", "item_b", "similarity").unionByName(one.select(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b"), "similarity"))
        rows = both.select(F.col("item_a").alias("user_id"), F.col("item_b").alias("item_id"), F.col("similarity").alias("score"))
        return top_k(rows, k).selectExpr("user_id AS item_id", "rank", "item_id AS near_item", "score")
    held = sent.graph

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from hops_top(held.value, "cosines", _cosine_hops, _asked(batches), k)

    asked = sent.items.select(F.col("i").alias("u")).repartition(partitions(edge.sparkSession))
    items = bounded(sent.items)
    near = asked.mapInArrow(run, _TOP).join(items, "i").withColumnRenamed("item_id", "near_item").drop("i")
    return near.join(items.withColumnRenamed("i", "u"), "u").select("item_id", "rank", "near_item", "score")


class Sums:
    """For rows of numbers in a cut array, the sums of those rows of a matrix."""

    def __init__(self, cut: np.ndarray, of: np.ndarray, long: int = 64, block: int = 1024) -> None:
        n = np.diff(cut)
        order = np.argsort(-n, kind="stable")
        self.long = [(r, of[cut[r] : cut[r + 1]]) for r in order[n[order] > long]]
        short = order[(n[order] > 0) & (n[order] <= long)]
        # Rows of about one length stand together and are added position by position, so a block stays in the cache.
        self.blocks = []
        for at in range(0, len(short), block):
            rows = short[at : at + block]
            self.blocks.append((rows, [of[cut[rows[n[rows] > p]] + p] for p in range(n[rows[0]])]))
        self.block = block

    def add(self, matrix: np.ndarray, out: np.ndarray) -> None:
        total, one = np.empty((self.block, matrix.shape[1])), np.empty((self.block, matrix.shape[1]))
        for rows, places in self.blocks:
            np.take(matrix, places[0], axis=0, out=total[: len(rows)], mode="clip")
            for at in places[1:]:
                total[: len(at)] += np.take(matrix, at, axis=0, out=one[: len(at)], mode="clip")
            out[rows] += total[: len(rows)]
        for row, at in self.long:
            out[row] += matrix[at].sum(axis=0)


class Walk:
    """The restarting walk from given starts, over users and items as arrays."""

    def __init__(self, graph: Graph, damping: float, limit: int, tolerance: float) -> None:
        self.graph, self.damping, self.limit, self.tolerance = graph, damping, limit, tolerance
        likes = np.diff(graph.likes_cut)
        several = np.flatnonzero(likes > 1)
        # Who likes one item only sends its mass straight back, a factor of the item; the others are edges.
        single = graph.likes[graph.likes_cut[np.flatnonzero(likes == 1)]]
        self.back = np.bincount(single, minlength=graph.items) / np.maximum(graph.degree, 1)
        self.per_item, self.per_user = 1.0 / np.maximum(graph.degree, 1), 1.0 / likes[several]
        n, at = _ranges(graph.likes_cut, several)
        u, i = np.repeat(np.arange(len(several)), n), graph.likes[at].astype(np.int64)
        # The few largest items and users are rows of a matrix, the edges of all others are lists.
        fans = np.bincount(i, minlength=graph.items)
        self.hot, self.large = (np.argsort(-x, kind="stable")[:DENSE] for x in (fans, n))
        self.hot, self.large = self.hot[fans[self.hot] > len(several) // 16], self.large[n[self.large] > graph.items // 16]
        self.of_hot, self.of_large = np.zeros((len(self.hot), len(several))), np.zeros((len(self.large), graph.items))
        for row, item in zip(self.of_hot, self.hot, strict=True):
            row[u[i == item]] = 1.0
        rest = ~np.isin(i, self.hot)
        for row, user in zip(self.of_large, self.large, strict=True):
            row[i[rest & (u == user)]] = 1.0
        rest &= ~np.isin(u, self.large)
        u, i = u[rest], i[rest]
        self.users, self.several = Sums(np.searchsorted(u, np.arange(len(several) + 1)), i), len(several)
        order = np.argsort(i, kind="stable")
        self.items = Sums(np.searchsorted(i[order], np.arange(graph.items + 1)), u[order])

    def twice(self, mass: np.ndarray, change: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Item mass after a step to the users and one back, without damping; and, if asked, the most that a user held."""
        out, mass = self.back[:, None] * mass, self.per_item[:, None] * mass
        users = self.of_hot.T @ mass[self.hot]
        users[self.large] += self.of_large @ mass
        self.users.add(mass, users)
        most = np.maximum(np.abs(mass).max(axis=0, initial=0.0), np.abs(users).max(axis=0, initial=0.0)) if change else None
        users *= self.per_user[:, None]
        out[self.hot] += self.of_hot @ users
        out += self.of_large.T @ users[self.large]
        self.items.add(users, out)
        return out, most

    def run(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For columns of start mass over the items, the columns of item mass and the largest change of their last step, items and users alike.

        Mass is followed from double step to double step: what a column gains in one is its change, which shrinks and
        goes on to the next. Columns end when it is at most the tolerance, or with the limit of steps.
        """
        d, last = self.damping, self.limit // 2 - 1
        now = d * start
        final, change, active = now.copy(), np.zeros(start.shape[1]), np.arange(start.shape[1])
        # p(1) = d v, p(3) - p(1) = d d M p(1) + (d (1 - d) - d) v, and each later change is d d M of the one before.
        # M keeps the sum of a column; so a change spread over all items is at least this, and need not be looked at while that is more than the tolerance.
        least = 0.99 * d * d * (1 - d) / max(np.count_nonzero(self.graph.degree), 1)
        look = last <= 1 or least <= self.tolerance
        gain, users = self.twice(now, look)
        gain = d * d * gain - d * d * start
        for step in range(1, last + 1):
            final[:, active] += gain
            if look:
                change[active] = np.maximum(np.abs(gain).max(axis=0), d * users)
                on = change[active] > self.tolerance
                if step == last or not on.any():
                    break
                if not on.all():
                    active, gain = active[on], gain[:, on]
            look = step + 1 == last or least * d ** (2 * step) <= self.tolerance
            gain, users = self.twice(gain, look)
            gain *= d * d
        return final, change


def walks(users: DataFrame, edge: DataFrame, k: int, damping: float = 0.85, limit: int = 100, tolerance: float = 1e-12, batch: int = 64) -> DataFrame:
    """``user_id, rank, item_id, score, settled``: top ``k`` unseen items by the restarting walk.

    A walk takes up to ``limit`` steps (two make a double step) and ends before if no item's and no user's mass changes by more than
    ``tolerance``; ``settled`` says whether it did. Damping alone shrinks a change by ``damping ** 2`` each double step, so a walk that
    reaches the limit of 100 is within about 1e-7 of the settled one. The edges go to every worker as arrays where they fit
    (``WORKER_BYTES``); beyond that the same double steps are made by joins (:func:`walk_steps`), and ``settled`` is NULL. Users who like nothing have no rows.
    """
    sent = sent_graph(edge)
    if sent is None:
        return top_k(walk_steps(users, edge, damping, limit // 2 - 1), k).withColumn("settled", F.lit(None).cast("boolean"))
    held = sent.graph

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = held.value.graph
        walk = held.value.once(f"walk {damping} {limit} {tolerance}", lambda graph: Walk(graph, damping, limit, tolerance))
        for b in batches:
            wanted = [u for u in b["u"].to_pylist() if len(graph.liked(u))]
            for at in range(0, len(wanted), batch):
                part = wanted[at : at + batch]
                start = np.zeros((graph.items, len(part)))
                for column, u in enumerate(part):
                    start[graph.liked(u), column] = 1.0 / len(graph.liked(u))
                mass, change = walk.run(start)
                rows = [(u, *_best_unseen(graph, u, mass[:, column].copy(), k)) for column, u in enumerate(part)]
                out = _top_batch(rows)
                ended = np.repeat(change <= tolerance, [len(items) for _, items, _ in rows])
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(ended, pa.bool_())], names=[*out.schema.names, "settled"])

    return sent.named(sent.wanted(users).mapInArrow(run, f"{_TOP}, settled boolean")).select("user_id", "rank", "item_id", "score", "settled")


class Factors:
    """Pairwise ranking by factors over the edges of some users: vectors of those who like something and of items, and a bias of each item."""

    def __init__(self, u: np.ndarray, i: np.ndarray, liked: np.ndarray, users: int, items: int, rate: float, shrink: float, rng: np.random.Generator) -> None:
        order = np.lexsort((i, u))
        self.u, self.i, self.items, self.rate, self.shrink, self.rng = u[order], i[order], items, rate, shrink, rng
        self.cut = np.searchsorted(self.u, np.arange(users + 1))
        self.met = self.u * items + self.i
        # The r-th item a user hasn't met is r and as many more as they have met items with fewer than r + 1 unmet ones before.
        self.unmet_before = self.u * (items + 1) + self.i - (np.arange(len(self.u)) - self.cut[self.u])
        self.free = items - np.diff(self.cut)
        good = liked[order] & (self.free[self.u] > 0)
        self.pairs = np.stack([self.u[good], self.i[good]])

    def others(self, users: np.ndarray) -> np.ndarray:
        """One item for each user that they haven't met. Items met are drawn again, ``REDRAWS`` times at most, and then from the unmet ones only."""
        drawn, open_ = self.rng.integers(0, self.items, len(users)), np.arange(len(users))
        for _ in range(REDRAWS):
            code = users[open_] * self.items + drawn[open_]
            at = np.searchsorted(self.met, code)
            open_ = open_[self.met[np.minimum(at, len(self.met) - 1)] == code]
            if not len(open_):
                return drawn
            drawn[open_] = self.rng.integers(0, self.items, len(open_))
        r = np.array([self.rng.integers(n) for n in self.free[users[open_]]], np.int64)
        met = np.searchsorted(self.unmet_before, users[open_] * (self.items + 1) + r, "right") - self.cut[users[open_]]
        drawn[open_] = r + met
        return drawn

    def passes(self, row: np.ndarray, users_f: np.ndarray, items_f: np.ndarray, bias: np.ndarray, n: int, batch: int) -> None:
        """``n`` times through all likes in a new order; the updates of a batch are made from its values before, and summed. ``row`` is each user's vector."""
        place = np.zeros(max(len(users_f), len(items_f)), np.int64)
        for _ in range(n):
            shuffled = self.pairs[:, self.rng.permutation(self.pairs.shape[1])]
            for at in range(0, shuffled.shape[1], batch):
                users, liked = shuffled[:, at : at + batch]
                other = self.others(users)
                own = row[users]
                x, y, z = np.take(users_f, own, axis=0), np.take(items_f, liked, axis=0), np.take(items_f, other, axis=0)
                less = y - z
                margin = bias[liked] - bias[other] + np.einsum("ij,ij->i", less, x)
                pull = 1.0 / (1.0 + np.exp(np.clip(margin, -50, 50)))
                less *= pull[:, None]
                moved = np.concatenate([y, z])
                moved *= -self.shrink
                pulled = pull[:, None] * x
                moved[: len(x)] += pulled
                moved[len(x) :] -= pulled
                x *= self.shrink
                less -= x
                self._add(users_f, own, less, place)
                self._add(items_f, np.concatenate([liked, other]), moved, place)
                for of, sign in ((liked, 1.0), (other, -1.0)):
                    np.add.at(bias, of, self.rate * (sign * pull - self.shrink * bias[of]))

    def _add(self, to: np.ndarray, rows: np.ndarray, values: np.ndarray, place: np.ndarray) -> None:
        """Adds the values to the rows; those of equal rows are summed first, by a small product. ``place`` is room for a number of each row; values are changed."""
        every = np.arange(len(rows))
        place[rows] = every
        at = place[rows]
        first = at == every
        again = np.flatnonzero(~first)
        for part in np.array_split(again, len(again) // 1024 + 1):
            of, which = np.unique(at[part], return_inverse=True)
            same = np.zeros((len(of), len(part)))
            same[which, np.arange(len(part))] = 1.0
            values[of] += same @ np.take(values, part, axis=0)
        values *= self.rate
        if len(again):
            rows, values = rows[first], values[first]
        to[rows] += values


def _training(turn: int, passes: int, alone: bool, n_items: int, dimensions: int, rate: float, shrink: float, batch: int, seed: int):
    """Trains a block of users on from the factors held, or from drawn ones in the first round."""

    def train(key: tuple, frame: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        u, names = pd.factorize(frame["user_id"], sort=True)
        liked = frame["positive"].to_numpy(bool)
        liking = np.unique(u[liked])
        row = np.zeros(len(names), np.int64)
        row[liking] = np.arange(len(liking))
        rng = np.random.default_rng(seed) if alone else np.random.default_rng([seed, int(key[0]), turn])
        if len(held):
            told = held[held["side"] == "item"].sort_values("i")
            own = held[held["side"] == "user"].set_index("id").loc[names[liking]]
            users_f, items_f, bias = np.array(own["vector"].tolist()).reshape(-1, dimensions), np.array(told["vector"].tolist()), told["bias"].to_numpy(float).copy()
        else:
            users_f = rng.normal(0, 0.01, (len(liking), dimensions))
            items_f, bias = (rng if alone else np.random.default_rng(seed)).normal(0, 0.01, (n_items, dimensions)), np.zeros(n_items)  # all blocks begin with the same items
        model = Factors(u.astype(np.int64), frame["i"].to_numpy(np.int64), liked, len(names), n_items, rate, shrink, rng)
        model.passes(row, users_f, items_f, bias, passes, batch)
        both = [pd.DataFrame({"side": "user", "id": names[liking], "i": -1, "bias": 0.0, "vector": list(users_f)}), pd.DataFrame({"side": "item", "id": "", "i": np.arange(n_items), "bias": bias, "vector": list(items_f)})]
        return pd.concat(both).assign(block=int(key[0]))[["block", "side", "id", "i", "bias", "vector"]]

    return train


def factors(edge: DataFrame, dimensions: int = 64, rate: float = 0.001, regularization: float = 1e-4, epochs: int = 50, batch: int = 1024, seed: int = 7, block_edges: int = BLOCK_EDGES, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """User and item factors of pairwise ranking: ``user_id, vector`` and ``item_id, bias, vector``.

    Each pass draws, for every liked edge, one item outside the user's history and moves both by the gradient of
    the logistic of their difference; updates of a batch are summed. Users who like nothing have no factors.

    Users are spread over blocks of about ``block_edges`` edges. One block is trained in one go; several are trained side by side
    in ``rounds``, each of a part of the ``epochs``, after which the blocks' item factors are averaged (a block's user factors are its own).
    Each block holds the factors of all items. Results depend on the seed and the number of blocks, not on scheduling.
    """
    count = edge.count()
    blocks = max(1, -(-count // block_edges))
    rounds = min(rounds, epochs) if blocks > 1 else 1
    items = numbered(edge, "item_id", "i")
    n_items = items.count()
    rows = written(edge.join(bounded(items), "item_id").select(F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int").alias("block"), "user_id", "i", "positive"), "blocks")
    schema = "block int, side string, id string, i int, bias double, vector array<double>"
    state: DataFrame | None = None
    done = 0
    for turn in range(rounds):
        passes = epochs * (turn + 1) // rounds - done
        done += passes

        held = state if state is not None else rows.sparkSession.createDataFrame([], schema)
        made = written(rows.groupBy("block").cogroup(held.groupBy("block")).applyInPandas(_training(turn, passes, blocks == 1, n_items, dimensions, rate, regularization, batch, seed), schema), "factors")
        if blocks > 1:
            own = made.where("side = 'item'")
            vector = F.array(*[F.avg(F.get("vector", F.lit(j))) for j in range(dimensions)])
            mean = own.groupBy("i").agg(F.avg("bias").alias("bias"), vector.alias("vector"))
            every = mean.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit("item").alias("side"), F.lit("").alias("id"), "i", "bias", "vector")
            made = written(made.where("side = 'user'").unionByName(every), "averaged")
        state = made
    user_f = state.where("side = 'user'").select(F.col("id").alias("user_id"), "vector")
    return user_f, state.where("side = 'item' and block = 0").join(bounded(items), "i").select("item_id", "bias", "vector")


def factor_top(users: DataFrame, edge: DataFrame, model: tuple[DataFrame, DataFrame], k: int) -> DataFrame:
    """``user_id, rank, item_id, score``: each user's best unseen items by factors.

    Users and items are cut into blocks, and each pair of blocks is scored by a task of its own. Of a block of items a user's best
    ``k`` and as many more as the user has met go on, so the unseen ones among them are the best; what was met goes after that.
    """
    user_f, item_f = model
    met = edge.join(users, "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("met"))
    queries = written(user_f.join(users.select("user_id").distinct(), "user_id", "left_semi").join(met, "user_id"), "queries")
    n_u, n_i = max(1, -(-queries.count() // BLOCK_USERS)), max(1, -(-item_f.count() // BLOCK_ITEMS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.pmod(F.xxhash64("user_id"), F.lit(n_u)).cast("int").alias("ub"), each(n_i).alias("ib"), "user_id", "vector", "met")
    right = item_f.select(each(n_u).alias("ub"), F.pmod(F.xxhash64("item_id"), F.lit(n_i)).cast("int").alias("ib"), "item_id", "bias", "vector")

    def score(asked: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if not len(told) or not len(asked):
            return pd.DataFrame({"user_id": [], "item_id": [], "score": []}, dtype=object)
        told, asked = told.sort_values("item_id"), asked.sort_values(["met", "user_id"])  # so that users of a batch want about as many
        ids, bias, matrix = told["item_id"].to_numpy(object), told["bias"].to_numpy(float), np.array(told["vector"].tolist())
        size = max(1, HELD_SCORES // len(ids))
        for at in range(0, len(asked), size):
            part = asked[at : at + size]
            users, wanted = part["user_id"].to_numpy(object), k + part["met"].to_numpy(np.int64)
            row, column, value = _near_best_first(np.array(part["vector"].tolist()) @ matrix.T + bias, wanted)
            out.append(pd.DataFrame({"user_id": users[row], "item_id": ids[column], "score": value}))
        return pd.concat(out)

    scored = left.groupBy("ub", "ib").cogroup(right.groupBy("ub", "ib")).applyInPandas(score, "user_id string, item_id string, score double")
    return top_k(scored.join(edge.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti"), k)
