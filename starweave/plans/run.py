"""Command line: ``spark-submit starweave/plans/run.py <job> ...``.

Jobs: ``cf``, ``features``, ``hybrid``, ``selected`` write predictions;
``evaluate`` compares written predictions (``--predictions``) with the stars
of ``--pairs`` and writes RMSE and the histogram of errors.
"""

from __future__ import annotations

import argparse
import dataclasses
import uuid

from starweave import settings as S
from starweave.operators import evaluation as V
from starweave.operators.features import one_per_key
from starweave.plans import jobs
from starweave.session import build_session, parquet_stage, remove_folder, shared_folder
from starweave.sources import files


def _arguments(argv=None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=("cf", "features", "hybrid", "selected", "evaluate"))
    parser.add_argument("--train", help="ratings CSV")
    parser.add_argument("--pairs", required=True, help="CSV of the pairs to predict")
    parser.add_argument("--out", required=True, help="folder for the predictions")
    parser.add_argument("--users", help="user JSON lines")
    parser.add_argument("--businesses", help="business JSON lines")
    parser.add_argument("--checkins", help="check-in JSON lines")
    parser.add_argument("--mode", default="FAILFAST", choices=("FAILFAST", "PERMISSIVE", "DROPMALFORMED"))
    parser.add_argument("--cf-source", default="validation", choices=("validation", "train"))
    parser.add_argument("--exclude-target", action="store_true")
    parser.add_argument("--predictions", help="folder of predictions to evaluate")
    parser.add_argument("--neighbours", type=int, help="neighbours of an item-based prediction (cf)")
    parser.add_argument("--features", type=int, help="number of chosen features (features)")
    parser.add_argument("--shuffle-tasks", type=int, help="tasks a shuffle starts with; see build_session")
    for name, kind in _PROFILE:
        parser.add_argument(f"--{name.replace('_', '-')}", type=kind, help="of the boosted regression trees")
    args = parser.parse_args(argv)
    needed = {"evaluate": ["predictions"], "cf": ["train"], "features": ["train", "users", "businesses"]}
    for name in needed.get(args.job, ["train", "users", "businesses", "checkins"]):
        if getattr(args, name) is None:
            parser.error(f"{args.job} needs --{name}")
    return args


_PROFILE = [(f.name, type(getattr(S.FEATURE_MODEL, f.name))) for f in dataclasses.fields(S.BoostingProfile)]


def _options(args: argparse.Namespace) -> dict:
    """Parameters of the job that were given on the command line."""
    if args.job == "cf":
        return {"k": args.neighbours} if args.neighbours else {}
    given = {n: getattr(args, n) for n, _ in _PROFILE if getattr(args, n) is not None}
    base = S.FEATURE_MODEL if args.job == "features" else S.HYBRID_MODEL
    options = {"profile": dataclasses.replace(base, **given)} if given else {}
    if args.job == "features" and args.features:
        options["n_features"] = args.features
    if args.job == "hybrid":
        options |= {"cf_source": args.cf_source, "exclude_target": args.exclude_target}
    return options


def _evaluate(spark, args) -> None:
    """``rmse`` and ``errors`` below ``--out``, as CSV."""
    predicted = files.read_ratings(spark, args.predictions, with_order=False).withColumnRenamed("stars", "prediction")
    scored = V.with_actuals(predicted, files.read_ratings(spark, args.pairs, args.mode, with_order=False))
    for name, frame in (("rmse", V.rmse(scored)), ("errors", V.error_distribution(scored))):
        frame.write.option("header", True).csv(f"{args.out.rstrip('/')}/{name}")


def main(argv=None, spark=None, **options) -> None:
    """Run one job; ``options`` go to the job, e.g. a model profile.

    Everything that is read more than once is written as parquet first; that
    folder is removed when the predictions are there.
    """
    args = _arguments(argv)
    spark = spark or build_session(f"starweave-{args.job}", shuffle_tasks=args.shuffle_tasks)
    if args.job == "evaluate":
        return _evaluate(spark, args)
    folder = f"{shared_folder(spark).rstrip('/')}/job-{uuid.uuid4().hex}"
    stage = parquet_stage(spark, folder)
    options = _options(args) | options
    ratings = stage(files.read_ratings(spark, args.train, args.mode), "ratings")
    pairs = stage(files.read_pairs(spark, args.pairs), "pairs")
    if args.job == "cf":
        out = jobs.item_cf(ratings, pairs, stage=stage, **options)
    else:
        users = stage(one_per_key(files.read_users(spark, args.users, args.mode), "user_id"), "users")
        businesses = stage(
            one_per_key(files.read_businesses(spark, args.businesses, args.mode), "business_id"), "businesses"
        )
        if args.job == "features":
            out = jobs.feature_regression(ratings, pairs, users, businesses, stage=stage, **options)
        else:
            checkins = stage(
                one_per_key(files.read_checkins(spark, args.checkins, args.mode), "business_id"), "checkins"
            )
            job = jobs.hybrid if args.job == "hybrid" else jobs.selected
            out = job(ratings, pairs, users, businesses, checkins, stage=stage, **options)
    files.write_predictions(out, args.out)
    remove_folder(spark, folder)


if __name__ == "__main__":
    main()
