"""CSV and JSON-lines readers, and the prediction writer.

What is malformed is decided once, over the raw fields, in a filter that is
part of every read.  So which rows there are, and whether a read fails, does
not depend on the columns that a plan happens to use.  :class:`Accounts` tells
how many there were, from the read itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from starweave.sources import schemas

_BAD = "_bad_record"
MODES = ("FAILFAST", "DROPMALFORMED", "PERMISSIVE")


#: Files with malformed records that are told apart (the others only by their sum), and counted one by one.
FILES_SHOWN, FILES_TRACKED = 1_000, 10_000


class Accounts:
    """What one read found, gathered while it ran: no second pass over the files.

    Give it to a reader, run one action over all rows of the result, then
    look at it.  An action that stops early (``take``, ``limit``) counts the
    rows it saw.  In mode FAILFAST a malformed record ends the action, and the
    error shows it; accounts are then of no meaning.  One object serves one read.
    """

    def __init__(self) -> None:
        self._seen = Observation(f"read-{uuid.uuid4().hex}")
        self._used = False

    def _attach(self, frame: DataFrame, bad: Column, shown: Column) -> DataFrame:
        if self._used:
            raise ValueError("these accounts belong to another read")
        self._used = True
        # ids of rows are not allowed in what is observed, so they become columns first
        told = frame.select(
            "*", bad.alias("_is_bad"), F.when(bad, F.struct(_position().alias("at"), shown.alias("line"))).alias("_told")
        )
        file = F.expr(f"approx_top_k(_told.at.file, {FILES_SHOWN + 1}, {FILES_TRACKED})")
        return told.observe(
            self._seen, F.count(F.lit(1)).alias("records"), F.count_if("_is_bad").alias("malformed"),
            F.min("_told").alias("first"), file.alias("files"),
        )

    @property
    def records(self) -> int:
        """Records looked at, malformed ones included; ``null`` lines are none."""
        return self._seen.get["records"]

    @property
    def malformed(self) -> int:
        return self._seen.get["malformed"]

    @property
    def first(self) -> tuple[str, str | None] | None:
        """File and text of the first malformed record in the order of files, None if there is none."""
        found = self._seen.get["first"]
        return (found["at"]["file"], found["line"]) if found else None

    @property
    def by_file(self) -> dict[str, int]:
        """Malformed records of each file that has some, the most first; exact if at most FILES_TRACKED * 3 / 4 files do."""
        return {r["item"]: r["count"] for r in self._seen.get["files"] or [] if r["item"] is not None}


def _checked(
    frame: DataFrame, bad: Column, shown: Column, what: str, mode: str, accounts: Accounts | None = None
) -> DataFrame:
    """Fail at, drop or keep the rows that are ``bad``."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if accounts is not None:
        frame, bad = accounts._attach(frame, bad, shown), F.col("_is_bad")
    if mode == "PERMISSIVE":
        return frame
    if mode == "DROPMALFORMED":
        return frame.where(~bad)
    raised = F.raise_error(F.concat(F.lit(f"malformed {what}: "), F.coalesce(shown, F.lit("NULL"))))
    return frame.where(F.when(bad, raised.cast("boolean")).otherwise(F.lit(True)))


def read_ratings(
    spark: SparkSession, path, mode: str = "FAILFAST", with_order: bool = True, accounts: Accounts | None = None
) -> DataFrame:
    """Ratings CSV with a header in each file: the first three columns, whatever follows them.

    A row whose third field is no number is malformed: an error, dropped, or
    kept with NULL, by ``mode``.

    ``with_order`` adds ``rated_at``, the position of the row in its input
    (file, block, row within the block), so that "the last duplicate wins" is
    a property of the data and not of how tasks were scheduled.
    """
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    if len(raw.columns) < 3:
        raise ValueError(f"a ratings file has three columns at least, not {raw.columns}")
    user, business, stars = (F.col(f"`{c}`") for c in raw.columns[:3])
    number = stars.try_cast("double")
    shown = F.concat_ws(",", user, business, stars)
    frame = _checked(raw, number.isNull(), shown, "rating", mode, accounts)
    columns = [user.alias("user_id"), business.alias("business_id"), number.alias("stars")]
    return frame.select(*columns, *([_position().alias("rated_at")] if with_order else []))


def _position() -> Column:
    """Where a row stands in its input; orders rows as the files do."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_pairs(spark: SparkSession, path) -> DataFrame:
    """Pairs to predict: the first two columns of a CSV with a header; a blank id is NULL."""
    frame = spark.read.option("header", True).csv(path)
    first, second = frame.columns[:2]
    return frame.select(F.col(f"`{first}`").alias("user_id"), F.col(f"`{second}`").alias("business_id"))


def _read_json(spark: SparkSession, path, schema: T.StructType, key: str, mode: str, accounts: Accounts | None) -> DataFrame:
    """JSON lines; a ``null`` line is legal and dropped, a broken one is not.

    Every line is parsed with all fields, so that a bad field counts whether
    it is used or not.  ``read_at`` is the position of the record, to tell
    which duplicate is last.
    """
    wide = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    lines = spark.read.text(path).where(~F.trim("value").isin("null", ""))
    parsed = lines.select("value", F.from_json("value", wide, options).alias("record"), _position().alias("read_at"))
    frame = _checked(parsed, F.col(f"record.{_BAD}").isNotNull(), F.col("value"), "JSON record", mode, accounts)
    fields = [F.col(f"record.{f.name}").alias(f.name) for f in schema.fields]
    return frame.select(*fields, "read_at").where(F.col(key).isNotNull())


def read_businesses(spark: SparkSession, path, mode: str = "FAILFAST", accounts: Accounts | None = None) -> DataFrame:
    return _read_json(spark, path, schemas.BUSINESS, "business_id", mode, accounts)


def read_users(spark: SparkSession, path, mode: str = "FAILFAST", accounts: Accounts | None = None) -> DataFrame:
    return _read_json(spark, path, schemas.USER, "user_id", mode, accounts)


def read_checkins(spark: SparkSession, path, mode: str = "FAILFAST", accounts: Accounts | None = None) -> DataFrame:
    return _read_json(spark, path, schemas.CHECKIN, "business_id", mode, accounts)


def write_predictions(predictions: DataFrame, path: str, mode: str = "error") -> None:
    """Predictions as a folder of CSV files with a header, one per task."""
    out = predictions.select(*schemas.PREDICTION.names)
    out.write.mode(mode).option("header", True).csv(path)
