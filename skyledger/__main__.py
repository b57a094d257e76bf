"""Command line: ``spark-submit`` or ``python -m skyledger <job> ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.scoring import score
from .plans.dashboard import current_baselines, live_dashboard
from .plans.loads import add_load, loaded_dashboard, remove_load
from .plans.preprocess import preprocess
from .plans.training import train_and_evaluate
from .session import tune
from .sources.csv_files import read_csv_glob
from .sources.models import load_model, publish_version
from .sources.requests import read_requests, stream_requests, text_fields
from .streaming.scoring import start_scoring, start_versioned_scoring


def _arguments(words: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="skyledger", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)

    prepare = jobs.add_parser("preprocess", help="raw CSV folders to clean and feature tables")
    prepare.add_argument("--train", required=True)
    prepare.add_argument("--test", required=True)
    prepare.add_argument("--output", required=True)
    prepare.add_argument("--header", help="comma-joined columns of all files, which are then not looked up")
    prepare.add_argument("--city-of-file", action="store_true", help="rows without a city take that of their piece")
    prepare.add_argument("--strict", action="store_true", help="fail at rows with more or fewer fields than the header")
    prepare.add_argument("--multi-line", action="store_true", help="quoted fields may hold line breaks")
    prepare.add_argument("--line-breaks", choices=["escape", "refuse"], default="escape", help="in texts that are written")
    prepare.add_argument("--counted", action="store_true", help="training vectors once each, with their number of rows")
    prepare.add_argument("--handle-invalid", choices=["skip", "keep", "error"], default="skip")

    load = jobs.add_parser("load", help="add a raw CSV folder to a table that grows by loads")
    load.add_argument("--raw", help="folder with CSV files")
    load.add_argument("--table", required=True)
    load.add_argument("--name", required=True, help="of the load; one that is there already changes nothing")
    load.add_argument("--remove", action="store_true", help="take the load of this name back instead")

    train = jobs.add_parser("train", help="fit, measure and save the forest")
    train.add_argument("--train-features", required=True)
    train.add_argument("--test-features", required=True)
    train.add_argument("--model", required=True)
    train.add_argument("--repeatable-partitions", type=int, help="a fit that does not depend on the layout of rows")

    board = jobs.add_parser("dashboard", help="timeline and overall index of clean readings")
    shown = board.add_mutually_exclusive_group(required=True)
    shown.add_argument("--readings")
    shown.add_argument("--loads", help="a table that grows by loads; only its sums are read")
    board.add_argument("--output", required=True, help="folder for one JSON line")

    publish = jobs.add_parser("publish", help="make a model and the present means what streams score by")
    publish.add_argument("--versions", required=True)
    publish.add_argument("--readings", required=True, help="table the baselines are taken from")
    publish.add_argument("--model", help="without one the rule answers")
    publish.add_argument("--model-accuracy", type=float)

    for name, text in (("score", "score request files once"), ("stream", "score arriving request files")):
        job = jobs.add_parser(name, help=text)
        job.add_argument("--requests", required=True)
        job.add_argument("--readings", required=name == "score", help="table the baselines are taken from")
        job.add_argument("--model", required=name == "score", help="absent model: the rule answers")
        job.add_argument("--model-accuracy", type=float)
        job.add_argument("--output", required=True)
        job.add_argument("--id", action="append", default=[], help="request field to carry into the answer")
        job.add_argument("--on-error", choices=["error", "fallback"], default="error")
        if name == "stream":
            job.add_argument("--versions", help="folder of published models and means, instead of --readings and --model")
            job.add_argument("--checkpoint", required=True)
            job.add_argument("--files-per-batch", type=int, help="most files of a batch; default: all that wait")
            job.add_argument("--interval", help="keep running, e.g. '10 seconds'")
    return parser.parse_args(words)


def main(words: list[str] | None = None) -> None:
    options = _arguments(words)
    spark = tune(SparkSession.builder.appName(f"skyledger-{options.job}").getOrCreate())
    if options.job == "preprocess":
        header = options.header.split(",") if options.header else None
        prepared = preprocess(
            spark, options.train, options.test, options.output, header, options.handle_invalid, options.city_of_file,
            options.strict, options.multi_line, options.line_breaks, options.counted,
        )
        prepared.train_report.show()
        prepared.test_report.show()
        prepared.train_incomplete.show()
        prepared.test_incomplete.show()
    elif options.job == "train":
        trained = train_and_evaluate(
            spark,
            options.train_features,
            options.test_features,
            options.model,
            options.repeatable_partitions,
        )
        print(f"accuracy {trained.accuracy:.4f}, weighted F1 {trained.weighted_f1:.4f}")
    elif options.job == "load":
        if options.remove:
            print("removed" if remove_load(spark, options.table, options.name) else "not there")
        else:
            raw = read_csv_glob(spark, f"{options.raw}/*.csv", trace=True)
            print("added" if add_load(spark, options.table, options.name, raw) else "there already")
    elif options.job == "dashboard":
        board = loaded_dashboard(spark, options.loads) if options.loads else live_dashboard(spark, options.readings)
        board.write.mode("overwrite").json(options.output)
    elif options.job == "publish":
        model = load_model(spark, options.model) if options.model else None
        means = current_baselines(spark, options.readings, options.model_accuracy).first().asDict()
        print(f"version {publish_version(spark, options.versions, means, model)}")
    elif options.job == "stream" and options.versions:
        arriving = stream_requests(spark, options.requests, text_fields(options.id), options.files_per_batch)
        start_versioned_scoring(
            arriving, options.versions, options.output, options.checkpoint, options.id, options.interval, options.on_error
        ).awaitTermination()
    else:
        if not (options.readings and options.model):
            raise SystemExit("stream takes --versions, or --readings and --model")
        model = load_model(spark, options.model)
        means = current_baselines(spark, options.readings, options.model_accuracy)
        carried = text_fields(options.id)
        if options.job == "score":
            requests = read_requests(spark, options.requests, carried)
            answers = score(requests, means, model, options.id, options.on_error)
            answers.write.mode("overwrite").parquet(options.output)
        else:
            start_scoring(
                stream_requests(spark, options.requests, carried, options.files_per_batch),
                means.first().asDict(),
                options.output,
                options.checkpoint,
                model,
                options.id,
                options.interval,
                options.on_error,
            ).awaitTermination()


if __name__ == "__main__":
    main()
