"""Command line: ``python -m tessera list``, ``run NAME DATA OUT``, ``explain NAME DATA``, ``report DATA OUT``."""

from __future__ import annotations

import argparse
import importlib
import importlib.util

from pyspark.sql import SparkSession

#: Pooled results that ``report`` puts together.
REPORTS = ("pooled_error_rate", "error_reduction", "macro_mean_rates", "taxonomy_report", "entity_agreement_pooled", "review_effort", "answer_slices", "retrieval_report", "kg_links", "kg_usage")


def queries() -> dict:
    out = dict(importlib.import_module("tessera.plans.queries").QUERIES)
    if importlib.util.find_spec("__spark_entry__"):
        out = importlib.import_module("__spark_entry__").queries()
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list", help="names of all queries")
    for name, more in (("run", ("name", "data", "out")), ("explain", ("name", "data")), ("report", ("data", "out"))):
        one = sub.add_parser(name)
        for m in more:
            one.add_argument(m)
    a = p.parse_args(argv)
    known = queries()
    if a.what == "list":
        print("\n".join(f"{n}: {(f.__doc__ or '').strip().splitlines()[0] if f.__doc__ else ''}" for n, f in sorted(known.items())))
        return 0
    if a.what in ("run", "explain") and a.name not in known:
        p.error(f"no query is named {a.name}")
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if a.what == "run":
        known[a.name](spark, a.data).write.mode("overwrite").parquet(a.out)
    elif a.what == "explain":
        known[a.name](spark, a.data).explain("formatted")
    else:
        from tessera.sources.files import write_report

        print("\n".join(write_report(known[n](spark, a.data), f"{a.out}/{n}", n) for n in REPORTS))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
