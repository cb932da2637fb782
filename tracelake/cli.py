"""Command line for spark-submit: analyze a signal file, or its noise spectrum."""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracelake.config import DetectionConfig


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tracelake", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("analyze", "spectrum"):
        p = sub.add_parser(name)
        p.add_argument("path")
        p.add_argument("--output-dir", default=".")
        p.add_argument("--sampling-rate", type=float)
        p.add_argument("--dtype", default="int16")
        p.add_argument("--channel", type=int, default=0)
        p.add_argument("--scale-factor", type=float, default=1.0)
    sub.choices["spectrum"].add_argument("--segment-sec", type=float, default=1.0)
    for f in fields(DetectionConfig):
        sub.choices["analyze"].add_argument("--" + f.name.replace("_", "-"), dest=f"set_{f.name}")
    sub.choices["analyze"].add_argument("--range", nargs=2, type=float)
    sub.choices["analyze"].add_argument("--exclude", nargs=2, type=float, action="append")
    sub.choices["analyze"].add_argument("--statistics", action="store_true")
    return out


def settings(args: argparse.Namespace) -> DetectionConfig:
    """Only options that were given; the rest keep their defaults."""
    given = {k.removeprefix("set_"): v for k, v in vars(args).items() if k.startswith("set_") and v is not None}
    for f in fields(DetectionConfig):
        if f.type == "bool" and f.name in given:
            given[f.name] = str(given[f.name]).lower() in ("1", "true", "yes")
    return DetectionConfig.from_settings(given)


def main(argv: list[str] | None = None) -> dict:
    from tracelake.operators import inference, spectrum
    from tracelake.operators.layout import clean
    from tracelake.plans.pipeline import run_file
    from tracelake.sources import raw, sinks

    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tracelake").getOrCreate()
    file = {"channel": args.channel, "dtype": args.dtype, "scale_factor": args.scale_factor}
    out = os.path.join(args.output_dir, "")
    if args.command == "spectrum":
        samples, rate = raw.read_signal(spark, args.path, args.sampling_rate, **file)
        samples = samples.select("recording_id", "sample_idx", F.col("value").cast("double").alias("value"))
        n = samples.count()
        psd = spectrum.welch(samples, rate, spectrum.segment_length(rate, n, args.segment_sec))
        sinks.write_csv(psd, out + "spectrum.csv")
        summary = spectrum.noise_summary(psd)
        clean(spark)
        return summary
    result = run_file(spark, args.path, args.sampling_rate, settings(args), tuple(args.range) if args.range else None, [tuple(r) for r in args.exclude] if args.exclude else None, **file)
    sinks.write_csv(sinks.event_table(result.events), out + "events.csv")
    sinks.write_csv(sinks.sublevel_table(result.events.where("sublevels IS NOT NULL"), result.rate), out + "sublevels.csv")
    summary = result.summary()
    if args.statistics:
        summary["statistics"] = inference.statistics_summary(result.events, result.seconds())
    print(result.summary_text())
    print(json.dumps(summary, indent=2, default=float))
    clean(spark)
    return summary


if __name__ == "__main__":
    main()
