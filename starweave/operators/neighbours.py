"""Rating prediction from the most similar items a user has rated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from starweave import settings as S
from starweave.functions import rating_rules as rules
from starweave.operators import ratings as base
from starweave.operators.histories import Answer, nearest, number_items, of_blank_items
from starweave.operators.skew import HotKeys, grid_join, lookup_join, measure_hot, pair_lookup_join
from starweave.session import Stage, no_stage
from starweave.settings import DEFAULT_TUNING, Tuning

PAIR = ["user_id", "business_id"]


def candidates(
    targets: DataFrame,
    history: DataFrame,
    *,
    target_users: HotKeys,
    history_users: HotKeys,
    tuning: Tuning = DEFAULT_TUNING,
) -> DataFrame:
    """Each (user, target) with every item of the user's history.

    ``targets`` has user_id and target, ``history`` user_id, item and stars;
    further columns come along.
    """
    return grid_join(
        targets,
        history,
        "user_id",
        left_hot=target_users,
        right_hot=history_users,
        left_spread=["target"],
        right_spread=["item"],
        tuning=tuning,
    )


def drop_hopeless(history: DataFrame, k: int, rare: int, alike: list[str]) -> DataFrame:
    """Drop rated items that cannot be among the k neighbours of any target.

    Items with at most ``rare`` ratings, of one user and equal in ``alike``,
    are equally similar to whatever target, so only the first of them by id
    can be neighbours; one more is kept in case a target itself is left out.
    Each task cuts its rows to that number before they are shuffled.
    """
    is_rare = F.col("n_ratings") <= rare
    order = Window.partitionBy("user_id", *alike).orderBy("item")
    first = (
        history.where(is_rare)
        .withColumn("_nth", F.row_number().over(order))
        .where(F.col("_nth") <= k + 1)
        .drop("_nth")
    )
    return history.where(~is_rare).unionByName(first)


def top_neighbours(scored: DataFrame, k: int) -> DataFrame:
    """The k rows of highest (signed) similarity per (user, target).

    Adds ``rank``, from 1.  The filter on the row number lets Spark cut each
    task's rows to k per group before they are shuffled.
    """
    order = Window.partitionBy("user_id", "target").orderBy(
        F.col("_key").desc(), F.col("item").asc()
    )
    return (
        scored.withColumn("_key", rules.rank_key(F.col("similarity")))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .drop("_key")
    )


def weighted_means(neighbours: DataFrame) -> DataFrame:
    """Similarity-weighted mean of the stars per (user, target), or the one that is there as ``weighted``."""
    mean = F.try_divide(F.sum(F.col("similarity") * F.col("stars")), F.sum(F.abs("similarity")))
    if "weighted" in neighbours.columns:
        mean = F.coalesce(F.max("weighted"), mean)
    return neighbours.groupBy("user_id", "target").agg(mean.alias("weighted"))


class _Request:
    """What both prediction rules need to know about ratings and pairs."""

    def __init__(self, ratings: DataFrame, pairs: DataFrame, tuning: Tuning, stage: Stage, distinct: bool = False, once: bool = False):
        self.tuning, self.stage, self.distinct = tuning, stage, distinct or once
        if not once:
            pairs = stage(pairs, "asked-pairs")  # read several times, and often the result of a join
        self.ratings, self.pairs = ratings, pairs
        self.users, self.items = measure_hot(ratings, ["user_id"], ["business_id"], tuning=tuning)
        self.pair_users, self.pair_items = (
            (self.users, self.items) if pairs is ratings else measure_hot(pairs, ["user_id"], ["business_id"], tuning=tuning)
        )
        wanted = pairs if distinct else pairs.select("user_id", "business_id")
        if once and not self._cut(self.pair_items):
            wanted = wanted.repartition("business_id")      # once, to be made distinct and for the join that follows
        wanted = wanted if distinct else wanted.distinct()
        means = stage(base.business_means(ratings), "business-means")
        self.numbers = stage(number_items(means), "item-numbers")
        means = means.join(self.numbers, "business_id", "left")
        # slots that an item needs as a target: by its ratings, and by its requests where more items have many than are listed
        most = F.col("n_ratings")
        if self.pair_items.other_splits(tuning.rows_per_slot) > 1:
            means = means.join(wanted.groupBy("business_id").agg(F.count("*").alias("_asked")), "business_id", "left")
            most = F.greatest(most, F.col("_asked"))
        own = F.ceil(most / tuning.rows_per_slot).cast("int")
        self.means = stage(means.withColumn("own", own).select("business_id", "business_mean", "n_ratings", "item_no", "own"), "means")
        self.wanted = stage(self.with_means(wanted), "wanted")

    def _cut(self, items: HotKeys) -> bool:
        """Has any of the items more rows than a slot of a lookup join holds?"""
        per_slot = self.tuning.rows_per_slot
        return bool(items.splits(per_slot)) or items.other_splits(per_slot) > 1

    def with_means(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the means of their user and their business, NULL where unknown, and the business's number ``_no``."""
        rows = lookup_join(
            rows, self.means.select("business_id", "business_mean", F.col("item_no").alias("_no"), "own"), ["business_id"],
            hot=self.pair_items, spread=["user_id"], tuning=self.tuning,
        )
        return lookup_join(
            rows, base.user_means(self.ratings).drop("n_ratings"), ["user_id"],
            hot=self.pair_users, spread=["business_id"], tuning=self.tuning,
        )

    def known(self, named: bool = True, with_mean: bool = True) -> DataFrame:
        """Requested pairs of rated businesses; an unknown one has similarity 0 to everything.

        Rows that travel with a history carry no more than they need:
        ``target`` is the business's number if it is not ``named``, ``mean`` is NULL where similarities do without.
        """
        known = self.wanted.where(F.col("business_mean").isNotNull() & F.col("_no").isNotNull())
        target, mean = F.col("business_id" if named else "_no"), F.col("business_mean") if with_mean else F.lit(None).cast("double")
        return known.select("user_id", target.alias("target"), F.col("_no").alias("t"), mean.alias("mean"), "own")

    def numbered(self, all_items: bool) -> DataFrame:
        """The latest ratings by item number, with the item's mean and whether it is a target.

        Where no item is hot, ratings are dealt by item once, both for their
        latest and for the join.  The few pairs whose ratings differ are
        looked up again with their order.
        """
        means = self.means.where(F.col("item_no").isNotNull())
        flag = F.lit(True)
        if not all_items:
            targets = self.wanted.select("business_id").distinct().withColumn("_t", F.lit(True))
            means, flag = means.join(targets, "business_id", "left"), F.coalesce("_t", F.lit(False))
        means = means.withColumn("is_target", flag)
        rated = self.ratings.where(F.col("user_id").isNotNull() & F.col("business_id").isNotNull())
        settled = base.settled_ratings(rated, dealt_by=None if self._cut(self.items) else "business_id")
        joined = lookup_join(settled, means, ["business_id"], "inner", hot=self.items, spread=["user_id"], tuning=self.tuning)
        rows = self.stage(joined.select(
            "user_id", F.when(~F.col("settled"), F.col("business_id")).alias("_open"),
            "item_no", "stars", F.col("business_mean").alias("item_mean"), "n_ratings", "is_target", "own",
        ), "numbered")
        still = self.stage(rows.where(F.col("_open").isNotNull()), "open")
        rows = rows.where(F.col("_open").isNull()).drop("_open")
        if still.isEmpty():
            return rows
        asked = still.select("user_id", F.col("_open").alias("business_id"))
        last = base.latest_ratings(rated.join(asked, PAIR, "left_semi")).withColumnRenamed("business_id", "_open")
        return rows.unionByName(self.stage(still.drop("stars").join(last, ["user_id", "_open"]).drop("_open"), "numbered-again"))

    def history(self, numbered: DataFrame, measure: str, k: int) -> DataFrame:
        """Ratings that can be neighbours; ``item`` is the item's number, numbers being in the order of ids."""
        history = numbered.withColumnRenamed("item_no", "item").drop("is_target")
        if measure == "pearson":
            # too few ratings for co-raters to count: the mean decides
            return drop_hopeless(history, k, S.FEW_CO_RATERS, ["item_mean"]).select("user_id", "item", "stars", "item_mean", "n_ratings")
        # one rating: the only possible co-rater is the user, with cosine 1
        history = drop_hopeless(history.withColumn("_sign", F.signum("stars")), k, 1, ["_sign"])
        return history.select("user_id", "item", "stars")

    def opened(self, history: DataFrame, exclude_target: bool, targets: DataFrame | None = None) -> DataFrame:
        """Requests (of ``targets`` only) beside every item that can be a neighbour, by numbers."""
        known = self.known().select("user_id", F.col("t").alias("target"))
        if targets is not None:
            known = known.join(targets.select(F.col("t").alias("target")), "target", "left_semi")
        opened = candidates(
            known, history, target_users=self.pair_users, history_users=self.users, tuning=self.tuning
        )
        return opened.where(F.col("item") != F.col("target")) if exclude_target else opened

    def candidates(self, measure: str, k: int, exclude_target: bool) -> DataFrame:
        return self.opened(self.history(self.numbered(True), measure, k), exclude_target)

    def nearest(self, answer: Answer, all_items: bool) -> DataFrame:
        """What the neighbours of each known request answer, by packed histories."""
        numbered = self.numbered(all_items)
        history = self.history(numbered, answer.measure, answer.k)

        def partners(targets: DataFrame) -> DataFrame:
            pairs = self.opened(history.select("user_id", "item"), answer.exclude_target, targets)
            return pairs.select(F.col("target").alias("t"), F.col("item").alias("item_no")).distinct()

        def merged(found: DataFrame) -> DataFrame:
            best = top_neighbours(found.drop("rank").withColumnRenamed("item_no", "item"), answer.k)
            return weighted_means(best) if answer.kind == "weighted" else best.withColumnRenamed("item", "item_no")

        rated = numbered.select("user_id", "item_no", "stars", "is_target", "own")
        blank = None if all_items else of_blank_items(base.latest_ratings(self.ratings), rated, self.users, self.tuning)
        found = nearest(
            self.known(answer.kind != "weighted", answer.measure == "pearson"), rated,
            history.withColumnRenamed("item", "item_no"), answer, merged,
            hot_users=self.users, asked_users=self.pair_users, partners=partners, blank=blank,
            tuning=self.tuning, stage=self.stage,
        )
        if answer.kind == "weighted":
            return found
        names = self.numbers.withColumnRenamed("business_id", "item")
        return found.join(names, "item_no").select("user_id", "target", "item", "stars", "similarity", "rank")

    def answer(self, weighted: DataFrame, prediction) -> DataFrame:
        """One prediction for each input row, duplicates included."""
        keyed = weighted.withColumnRenamed("target", "_no")
        scored = self.wanted.join(keyed, ["user_id", "_no"], "left").select(
            "user_id", "business_id", prediction.alias("prediction")
        )
        if self.distinct:
            return scored
        blank = F.col("user_id").isNull() | F.col("business_id").isNull()
        whole = pair_lookup_join(
            self.pairs.where(~blank), scored, [self.pair_users, self.pair_items], tuning=self.tuning
        )
        # A blank id is an unknown user or business: the means decide.
        rest = self.with_means(self.pairs.where(blank)).withColumn("weighted", F.lit(None).cast("double"))
        return whole.unionByName(rest.select(*self.pairs.columns, prediction.alias("prediction")))


def pearson_neighbours(
    ratings: DataFrame,
    pairs: DataFrame,
    k: int = S.PEARSON_NEIGHBOURS,
    *,
    tuning: Tuning = DEFAULT_TUNING,
    stage: Stage = no_stage,
) -> DataFrame:
    """The k nearest rated items per pair, by Pearson similarity."""
    return _Request(ratings, pairs, tuning, stage).nearest(Answer("neighbours", "pearson", k), False)


def cosine_neighbours(
    ratings: DataFrame,
    pairs: DataFrame,
    k: int = S.COSINE_NEIGHBOURS,
    *,
    shrinkage: float = S.SHRINKAGE,
    tuning: Tuning = DEFAULT_TUNING,
    stage: Stage = no_stage,
) -> DataFrame:
    """The k nearest rated items per pair, by shrunk cosine similarity."""
    return _Request(ratings, pairs, tuning, stage).nearest(Answer("neighbours", "cosine", k, shrinkage), False)


def predict_pearson(
    ratings: DataFrame,
    pairs: DataFrame,
    k: int = S.PEARSON_NEIGHBOURS,
    *,
    all_items: bool = False,
    exclude_target: bool = False,
    distinct: bool = False,
    tuning: Tuning = DEFAULT_TUNING,
    stage: Stage = no_stage,
) -> DataFrame:
    """``pairs`` with a prediction: half the user's mean, half the neighbours'.

    Without neighbours it is the user's mean, and for an unknown user the
    neutral rating.  ``distinct`` says that ``pairs`` has these two columns
    only and no row twice.
    """
    request = _Request(ratings, pairs, tuning, stage, distinct)
    weighted = request.nearest(Answer("weighted", "pearson", k, exclude_target=exclude_target), all_items)
    mean = F.col("user_mean")
    prediction = F.when(F.col("weighted").isNotNull(), (mean + F.col("weighted")) / 2)
    return request.answer(weighted, prediction.otherwise(rules.or_neutral(mean)))


def predict_cosine(
    ratings: DataFrame,
    pairs: DataFrame,
    k: int = S.COSINE_NEIGHBOURS,
    *,
    shrinkage: float = S.SHRINKAGE,
    all_items: bool = False,
    exclude_target: bool = False,
    distinct: bool = False,
    once: bool = False,
    tuning: Tuning = DEFAULT_TUNING,
    stage: Stage = no_stage,
) -> DataFrame:
    """``pairs`` with a prediction from the neighbours, within 1..5 stars.

    Without neighbours it is the middle between the user's and the business's
    mean.  ``exclude_target`` leaves the rating of the target itself out of
    the neighbours, for pairs that are part of the ratings; for ``distinct``
    see :func:`predict_pearson`.  ``once`` answers each different (user_id,
    business_id) once; ``pairs`` are then read where they are, not staged.
    """
    request = _Request(ratings, pairs, tuning, stage, distinct, once)
    weighted = request.nearest(Answer("weighted", "cosine", k, shrinkage, exclude_target), all_items)
    middle = (rules.or_neutral(F.col("user_mean")) + rules.or_neutral(F.col("business_mean"))) / 2
    prediction = F.when(F.col("weighted").isNotNull(), rules.clip_stars(F.col("weighted")))
    return request.answer(weighted, prediction.otherwise(middle))


def predict_training_pairs(
    ratings: DataFrame,
    *,
    exclude_target: bool = False,
    tuning: Tuning = DEFAULT_TUNING,
    stage: Stage = no_stage,
) -> DataFrame:
    """Cosine prediction of each distinct rated pair, from the same ratings.

    By default a pair's own rating is one of its neighbours, so the result
    says something about its label; ``exclude_target`` avoids that.
    """
    return predict_cosine(
        ratings, ratings, all_items=True, exclude_target=exclude_target, once=True, tuning=tuning, stage=stage
    )
