"""Command line: check a configuration, print its stages, run all of them or one; exit code 2 for a broken configuration."""

from __future__ import annotations

import argparse
import json
import shlex
import sys


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="parcelspark", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)
    for name, more in (("check-config", []), ("print-plan", []), ("render", ["changes"]), ("run-full", ["out"]), ("run-stage", ["out"])):
        p = sub.add_parser(name)
        if name == "run-stage":
            p.add_argument("stage")
        p.add_argument("config")
        for arg in more:
            p.add_argument(arg, help="JSON of dotted paths and values" if arg == "changes" else "folder of the run")
        if name.startswith("run"):
            p.add_argument("--reward-profile")
        if name == "run-full":
            p.add_argument("--dry-run", action="store_true")
    p = sub.add_parser("fuse", help="four sources, or parcels and elevation, into one layer")
    for name in ("parcels", "dem"):
        p.add_argument(name)
    p.add_argument("out", help="GeoPackage to write")
    p.add_argument("--epsg", type=int, required=True)
    for name in ("pdt", "eco", "pbf"):
        p.add_argument(f"--{name}")
    for name in ("parcels", "pdt", "eco", "pbf"):
        p.add_argument(f"--{name}-layer")
    p.add_argument("--source", help="one container for all roles that have none of their own")
    p.add_argument("--metric-crs")
    p = sub.add_parser("render-runtime", help="a configuration with absolute paths below a data folder")
    p.add_argument("config")
    p.add_argument("out")
    p.add_argument("data_root")
    p.add_argument("--run-name", default="zhongning")
    p = sub.add_parser("list-layers")
    p.add_argument("path")
    return out


def _sources(args: argparse.Namespace) -> int:
    """The commands on source files."""
    from pyspark.sql import SparkSession

    from parcelspark import fuse
    from parcelspark.sources import files

    spark = SparkSession.builder.getOrCreate()
    if args.command == "list-layers":
        for r in files.list_layers(spark, args.path).collect():
            print(json.dumps(r.asDict(), ensure_ascii=False))
        return 0
    given = {k: getattr(args, k) for k in ("parcels", "dem", "source", *fuse.ZONES) if getattr(args, k)}
    chosen = {k: name for k in ("parcels", *fuse.ZONES) if (name := getattr(args, f"{k}_layer"))}
    counts: dict = {}
    fuse.write_fused(fuse.fuse_files(spark, given, chosen, metric=args.metric_crs, counts=counts), args.out, args.epsg)
    print(json.dumps({role: seen.get for role, seen in counts.items()}, ensure_ascii=False))
    return 0


def main(argv: list[str] | None = None) -> int:
    from parcelspark import config as C

    args = parser().parse_args(argv)
    if args.command in ("fuse", "list-layers"):
        try:
            return _sources(args)
        except (ValueError, OSError) as e:  # sources that are missing, ambiguous or do not fit; faults of the program are not hidden
            print(f"error: {e}", file=sys.stderr)
            return 2
    try:
        config = C.validate(C.load(args.config))
        if args.command == "render-runtime":
            import yaml

            with open(args.out, "w", encoding="utf-8") as f:
                yaml.safe_dump(C.runtime_config(config, args.data_root, args.run_name), f, allow_unicode=True, sort_keys=False)
            return 0
        if args.command == "render":
            print(json.dumps(C.rendered(config, json.loads(args.changes)), ensure_ascii=False, indent=2))
    except C.ConfigError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    if args.command == "print-plan":
        for stage, command in C.stage_commands(args.config, "OUT").items():
            print(f"{stage}: {shlex.join(command)}")
    elif args.command.startswith("run"):
        from pyspark.sql import SparkSession

        from parcelspark.pipeline import Run

        run = Run(SparkSession.builder.getOrCreate(), config, args.out, profile=args.reward_profile)
        print(json.dumps(run.stage(args.stage) if args.command == "run-stage" else run.full(args.dry_run), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
