"""python -m lacuna find CONFIG.json | inspect FILE [--check] | template box"""

from __future__ import annotations

import argparse
import difflib
import json
import math

# The keys of a configuration and their defaults; None must be given.
TEMPLATE = {
    "input": {"path": None, "format": "parquet", "columns": "x y z", "box": None},
    "grid": {"n": 0, "scheme": "cic"},
    "finder": {"radii": None, "threshold": -0.7, "variant": "excursion-set"},
    "prior": "",
    "checkpoint": "",
    "output": None,
}


def merged(config: dict, template: dict = TEMPLATE, at: str = "") -> dict:
    """config with defaults; keys that are unknown or missing are errors that name a likely one."""
    out = {}
    for key in config:
        if key not in template:
            near = difflib.get_close_matches(key, template, 1)
            raise SystemExit(f"unknown key {at}{key}" + (f"; did you mean {near[0]}?" if near else ""))
    for key, default in template.items():
        value = config.get(key, {} if isinstance(default, dict) else default)
        if isinstance(default, dict):
            value = merged(value, default, f"{at}{key}.")
        elif value is None:
            raise SystemExit(f"{at}{key} is missing")
        out[key] = value
    return out


def even_smooth(n: float) -> int:
    """The next even number from n on with no prime factor above 5; 16 at least."""
    k = max(16, math.ceil(n))
    while True:
        m = k
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1 and k % 2 == 0:
            return k
        k += 1


def find(spark, config: dict) -> None:
    """All checks come before the work; the checkpoint goes only after the output is written."""
    from .core import GridSpec
    from .operators import assignment, rows
    from .plans import finders
    from .sources import files

    c = merged(config)
    ladder = finders.check_ladder(c["finder"]["radii"], c["finder"]["threshold"])
    finders.variant(c["finder"]["variant"], c["finder"]["threshold"]).check()
    source, box = c["input"], float(c["input"]["box"])
    readers = {
        "parquet": lambda: spark.read.parquet(source["path"]),
        "ascii": lambda: files.read_ascii(spark, source["path"], source["columns"]),
        "field": lambda: files.read_field(spark, source["path"]),
        "gadget": lambda: files.read_gadget(spark, source["path"]),
    }
    if source["format"] not in readers:
        raise SystemExit(f"unknown format {source['format']}")
    df = readers[source["format"]]()
    df = df if "idx" in df.columns else files.numbered(df, [x for x in ("x", "y", "z")])
    df = rows.accept_box(df, box, "idx")
    n = df.count()
    spec = GridSpec(int(c["grid"]["n"]) or even_smooth(n ** (1 / 3)), box)
    grid = rows.contrast(assignment.dense(assignment.deposit(df, spec, c["grid"]["scheme"]), spec))
    prior = spark.read.parquet(c["prior"]) if c["prior"] else None
    found = finders.tracer_finder(grid, df, spec, ladder, c["finder"]["threshold"], c["finder"]["variant"], prior=prior, checkpoint=c["checkpoint"] or None, keep_checkpoint=True)
    files.set_metadata(found, {"threshold": float(c["finder"]["threshold"]), "variant": c["finder"]["variant"], "n_tracers": n, "n_cells": spec.n, "box": box}).write.mode("overwrite").parquet(c["output"])
    finders.Checkpoint(c["checkpoint"] or None).remove(spark)


def main(args=None) -> None:
    parser = argparse.ArgumentParser(prog="lacuna")
    sub = parser.add_subparsers(dest="what", required=True)
    run = sub.add_parser("find")
    run.add_argument("config")
    run.add_argument("-D", action="append", default=[], metavar="KEY=JSON", help="replaces a key such as finder.threshold=-0.8")
    run.add_argument("--check", action="store_true", help="only checks the configuration")
    look = sub.add_parser("inspect")
    look.add_argument("file")
    look.add_argument("--check", action="store_true")
    sub.add_parser("template")
    a = parser.parse_args(args)
    if a.what == "template":
        print(json.dumps(TEMPLATE, indent=2))
        return
    if a.what == "inspect" and not a.check:
        from .sources.files import describe

        print(json.dumps(describe(a.file), default=str, indent=2))
        return
    config = {}
    if a.what == "find":
        with open(a.config) as f:
            config = json.load(f)
        for change in a.D:
            key, _, value = change.partition("=")
            *path, last = key.split(".")
            at = config
            for p in path:
                at = at.setdefault(p, {})
            at[last] = json.loads(value)
        merged(config)
        if a.check:
            print("the configuration is sound")
            return
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    if a.what == "find":
        find(spark, config)
    else:
        from .sources.files import check

        stats, problems = check(spark, a.file)
        stats.show()
        print("\n".join(problems) or "no problems")


if __name__ == "__main__":
    main()
