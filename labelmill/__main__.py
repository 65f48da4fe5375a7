"""Command line: ``python -m labelmill <job> --data <paths> --out <folder>``.

Every result table is written as JSON below the output folder.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from labelmill import config as G
from labelmill.operators import logodds
from labelmill.operators.corpus import nest
from labelmill.operators.scale import clear_run
from labelmill.plans import jobs
from labelmill.sources import files

CORPUS_JOBS = ("report", "audit", "improve", "train", "train-vectors", "predict", "evaluate", "routing", "errors", "compare")
LOG_JOBS = ("feedback", "failures", "reviews")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="labelmill", description=__doc__)
    parser.add_argument("job", choices=("validate", "expectations", *CORPUS_JOBS, *LOG_JOBS))
    parser.add_argument("--data", nargs="+", required=True, help="split files, the log folder, or the file of cases for expectations")
    parser.add_argument("--out", required=True, help="folder for the result tables (train: the model)")
    parser.add_argument("--model", help="stored token model")
    parser.add_argument("--embeddings", help="Parquet table (id, embedding) for train-vectors; the model goes to the folder model of --out")
    parser.add_argument("--before", nargs="+", help="split files of the older corpus for audit")
    parser.add_argument("--entries", help="reviewer entries for reviews")
    parser.add_argument("--phrases", help="JSON lines (order_key, phrase) for improve")
    parser.add_argument("--candidates", help="JSON lines of new rows for improve")
    parser.add_argument("--rewrites", type=int, default=160, help="vague rows that improve rewords")
    parser.add_argument("--quotas", nargs="*", type=_counted, default=[], metavar="CATEGORY=N", help="rows that improve adds")
    parser.add_argument("--splits", nargs="*", type=_counted, default=[], metavar="SPLIT=N", help="where improve puts them")
    parser.add_argument("--schema", help="JSON schema file for validate")
    parser.add_argument("--flags", type=int, choices=(4, 5), default=4, help="label vintage of the corpus")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("labelmill").getOrCreate()
    spec = G.AGRONOMY_SPEC if args.flags == 4 else G.AGRONOMY_SPEC_5
    combos = G.EDGE_COMBOS if args.flags == 5 else G.AUDIT_COMBOS

    try:
        tables = _tables(spark, args, spec, combos)
        if args.job == "improve":
            files.write_corpus(nest(tables.pop("corpus").drop("split_pos", "line_no"), spec), f"{args.out}/corpus")
        for name, table in tables.items():
            table.write.mode("overwrite").json(f"{args.out}/{name}")
        if args.job == "validate":
            jobs.gate(tables)
        if args.job == "expectations":
            jobs.gate_expectations(tables)
    finally:  # also where a job or a write failed
        clear_run(spark)


def _counted(text: str) -> tuple[str, int]:
    name, _, n = text.rpartition("=")
    return name, int(n)


def _needed(args: argparse.Namespace, *names: str) -> None:
    for name in names:
        if not getattr(args, name):
            raise SystemExit(f"{args.job} needs --{name}")


def _tables(spark: SparkSession, args: argparse.Namespace, spec: G.LabelSpec, combos) -> jobs.Tables:
    if args.job == "validate":
        schema = json.loads(Path(args.schema).read_text(encoding="utf-8")) if args.schema else None
        return jobs.validate(spark, args.data, spec, schema, combos=combos)
    if args.job == "expectations":
        _needed(args, "model")
        return jobs.expect(jobs.read_cases(spark, args.data), logodds.load_model(spark, args.model))
    if args.job in LOG_JOBS:
        events = files.read_log(spark, args.data, spec)
        if args.job == "reviews":
            _needed(args, "entries")
            return jobs.review(events, jobs.read_entries(spark, args.entries, spec), spec)
        return jobs.fold_log(events) if args.job == "feedback" else jobs.mine_failures(events, spec)
    corpus = files.read_splits(spark, args.data, spec)
    if args.job == "train":
        jobs.train(corpus, args.out, spec)
        return {}
    if args.job == "train-vectors":
        _needed(args, "embeddings")
        return jobs.train_vectors(corpus, spark.read.parquet(args.embeddings), f"{args.out}/model", spec)
    if args.job == "audit":
        _needed(args, "before")
        return jobs.audit(files.read_splits(spark, args.before, spec), corpus, spec)
    if args.job == "improve":
        _needed(args, "phrases", "candidates", "quotas", "splits")
        phrases = files.read_jsonl(spark, args.phrases, "order_key bigint, phrase string")
        return jobs.improve(corpus, phrases, jobs.read_candidates(spark, args.candidates, spec), args.rewrites, args.quotas, args.splits, spec)
    return _corpus_tables(args, corpus, spec, combos)


def _corpus_tables(args: argparse.Namespace, corpus, spec: G.LabelSpec, combos) -> jobs.Tables:
    if args.job == "report":
        return jobs.report(corpus, spec, combos)
    _needed(args, "model")
    pred = jobs.predict(corpus, logodds.load_model(corpus.sparkSession, args.model))
    if args.job == "predict":
        return {"predictions": pred, "rejected": jobs.rejected(corpus)}
    if args.job == "compare":
        return jobs.compare_with_rules(corpus, pred)
    frame = jobs.frame_of(corpus, pred, G.AGRONOMY_SPEC)
    job = {"evaluate": jobs.evaluate, "routing": jobs.analyse_routing, "errors": jobs.analyse_errors}[args.job]
    return job(frame, G.AGRONOMY_SPEC)


if __name__ == "__main__":
    main()
