"""Commands: ``python -m kinfold build|folds|train|predict|compare|profile|stress|validate``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from kinfold.plans import linkage
from kinfold.sources.tables import read_tsv, validate


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kinfold", description=__doc__)
    p.add_argument("command", choices=["build", "folds", "train", "predict", "compare", "profile", "stress", "validate"])
    p.add_argument("--data", default="data/dataset")
    p.add_argument("--out", default="artifacts/run")
    p.add_argument("--other", help="compare: the second run")
    p.add_argument("--split", default="train")
    p.add_argument("--name", default="submission")
    p.add_argument("--kind", default="gbt", choices=sorted(linkage.FAMILIES))
    p.add_argument("--matching", help="validate: the matching file")
    p.add_argument("--candidates", help="validate: the candidate file")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("kinfold").getOrCreate()
    if a.command == "build":
        print(linkage.build(spark, a.data, a.out, a.split)[0].count())
    elif a.command == "folds":
        linkage.folds_report(spark, a.data, a.out).show()
    elif a.command == "profile":
        linkage.profile(spark, a.out).show()
    elif a.command == "validate":
        entities = read_tsv(spark, f"{a.data}/test/test_source1.tsv").selectExpr("entity_id as s1")
        errors, warnings = validate(spark, a.matching, a.candidates, entities)
        print("\n".join([*errors, *warnings]) or "valid")
        return bool(errors)
    else:
        out = {
            "train": lambda: linkage.train(spark, a.data, a.out, kind=a.kind),
            "predict": lambda: linkage.predict(spark, a.data, a.out, a.name, a.split if a.split != "train" else "test"),
            "compare": lambda: linkage.compare(spark, a.out, a.other),
            "stress": lambda: linkage.stress(spark, a.out),
        }[a.command]()
        print(json.dumps(out, indent=2, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
