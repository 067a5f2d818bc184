"""Command line for the three flows (I13), for ``spark-submit`` or local runs.

    spark-submit renewlens/cli.py train   --input data.csv --output out/ [--trees 600]
    spark-submit renewlens/cli.py predict --model out/model --input test.csv --output pred/
    spark-submit renewlens/cli.py tune    --input data.csv --output tune/ [--method random --n-iter 50 --cv 5]

Input is CSV (header, declared schema, missing-value tokens) or parquet,
chosen by the path's extension (``--format`` overrides). The session is the
one ``spark-submit`` provides; ``--local`` starts a local one (tests, laptops).
"""

from __future__ import annotations

import argparse
import json
import os
import sys

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from renewlens import config  # noqa: E402


def _session(local: bool) -> SparkSession:
    if local:
        from renewlens.session import local_session

        return local_session()
    spark = SparkSession.builder.appName("renewlens").getOrCreate()
    from renewlens.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return spark


def _read(spark: SparkSession, path: str, fmt: str | None) -> DataFrame:
    from renewlens.sources.files import read_csv

    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if fmt == "csv":
        return read_csv(spark, path)
    return spark.read.format(fmt).load(path)


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="renewlens")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("train", "predict", "tune"):
        s = sub.add_parser(name)
        s.add_argument("--input", required=True)
        s.add_argument("--output", required=True)
        s.add_argument("--format", default=None)
        s.add_argument("--local", action="store_true")
        if name == "predict":
            s.add_argument("--model", required=True)
            s.add_argument("--partition-by-term", action="store_true")
        else:
            s.add_argument("--trees", type=int, default=None, help="override n_estimators / maxIter")
            s.add_argument("--validation-fraction", type=float, default=None)
        if name == "tune":
            s.add_argument("--method", default=config.HYPERPARAMETER_TUNING_CONFIG["search_method"])
            s.add_argument("--n-iter", type=int, default=config.HYPERPARAMETER_TUNING_CONFIG["n_iter"])
            s.add_argument("--cv", type=int, default=config.HYPERPARAMETER_TUNING_CONFIG["cv"])
            s.add_argument("--resume", default=None, help="shared folder of fold scores; a stopped search goes on there")
    args = p.parse_args(argv)

    from renewlens.plans.jobs import predict_job, train_job, tune_job

    spark = _session(args.local)
    data = _read(spark, args.input, args.format)
    if args.cmd == "train":
        over = {"maxIter": args.trees} if args.trees else None
        res = train_job(spark, data, args.output, overrides=over, validation_fraction=args.validation_fraction)
    elif args.cmd == "predict":
        part = [config.TERM_COLUMN] if args.partition_by_term and config.TERM_COLUMN in data.columns else None
        res = predict_job(spark, args.model, data, args.output, partition_by=part)
    else:
        over = {"maxIter": args.trees} if args.trees else None
        res = tune_job(spark, data, args.output, tuning={"search_method": args.method, "n_iter": args.n_iter,
                                                        "cv": args.cv}, overrides=over,
                       resume_dir=args.resume)
    print(json.dumps({"command": args.cmd, "outputs": res.paths}, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
