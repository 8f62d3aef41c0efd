"""Sources and sinks: tab-separated tables, id lists, submissions and their validation."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

REQUIRED = ("entity_id", "business_name", "business_address", "country")
TRUTH = ("source1_entity_id", "matched_entity_ids")
KINDS = {"matching": "matched_entity_ids", "candidates": "candidate_entity_ids"}


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...] = REQUIRED, quoted: bool = True) -> DataFrame:
    """All columns as text, nothing read as null: "null" and "NA" stay. Without ``quoted`` quotes are literal."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    quote = {"quote": '"', "escape": '"'} if quoted else {"quote": ""}
    df = spark.read.csv(path, sep="\t", header=True, schema=schema, nullValue="\x00", emptyValue="", enforceSchema=False, **quote)
    return df.fillna("")


def load_source(spark: SparkSession, path: str) -> DataFrame:
    """A source table; missing columns raise before anything is read."""
    head = spark.read.text(path).limit(1).first()
    names = tuple((head.value if head else "").rstrip("\r").split("\t"))
    if missing := [c for c in REQUIRED if c not in names]:
        raise ValueError(f"{path} lacks {missing}")
    return read_tsv(spark, path, names).select(*REQUIRED)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """A table that is made once: an unfinished write has no success marker and is made anew."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def countries(df: DataFrame) -> DataFrame:
    return df.select("country").distinct().orderBy("country")


def limited(df: DataFrame, n: int, by: tuple[str, ...], order: str) -> DataFrame:
    """At most ``n`` rows of each group, least ids first."""
    from pyspark.sql import Window as W

    return df.withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy(order))).where(F.col("rn") <= n).drop("rn")


def truth_pairs(lists: DataFrame, s1: str = TRUTH[0], ids: str = TRUTH[1]) -> DataFrame:
    """(s1, rid) of comma lists; entities without matches have no row."""
    return lists.select(F.col(s1).alias("s1"), F.explode(F.split(ids, ",")).alias("rid")).withColumn("rid", F.trim("rid")).where("rid <> ''")


def id_lists(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(s1, ids): each entity once, its distinct record ids sorted and comma-joined."""
    lists = pairs.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_set("rid")), ",").alias("ids"))
    return entities.select("s1").distinct().join(lists, "s1", "left").fillna("", ["ids"])


def both_lists(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(s1, matches, candidates) in one aggregation; matches are candidates by construction."""

    def joined(x):
        return F.array_join(F.array_sort(F.collect_set(x)), ",")

    out = pairs.groupBy("s1").agg(joined(F.when(F.col("keep"), F.col("rid"))).alias("matches"), joined(F.col("rid")).alias("candidates"))
    return entities.select("s1").distinct().join(out, "s1", "left").fillna("", ["matches", "candidates"])


def write_id_lists(pairs: DataFrame, entities: DataFrame, path: str, kind: str = "matching") -> int:
    """Write id lists as TSV with literal quotes and check the rows written. Unknown entities and ids of
    other sources raise."""
    bad = pairs.where(~F.rlike("rid", F.lit("^S[23]-"))).select("rid").union(pairs.join(entities, "s1", "left_anti").select("s1")).limit(5).collect()
    if bad:
        raise ValueError(f"not allowed: {[r[0] for r in bad]}")
    lists = id_lists(pairs, entities)
    lists.select(F.col("s1").alias(TRUTH[0]), F.col("ids").alias(KINDS[kind])).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")
    spark, n = pairs.sparkSession, entities.select("s1").distinct().count()
    written = read_tsv(spark, path, (TRUTH[0], KINDS[kind]), quoted=False).count()
    if written != n:
        raise OSError(f"{path} has {written} rows, not {n}")
    return n


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an id-list file: (line, s1, ids, has_tab), the header line marked."""
    df = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"))
    parts = F.split("line", "\t", 2)
    return df.select("line", F.trim(parts[0]).alias("s1"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("ids"), (F.size(parts) == 2).alias("has_tab"))


def _rule(name: str, rows: DataFrame, what: str) -> DataFrame:
    return rows.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("n"), F.min(F.col(what).cast("string")).alias("example"))


def check_lists(lines: DataFrame, column: str, required: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """(rule, n, example) of an id-list file; ``required`` (s1) are the entities it must have, ``valid``
    (rid) the record ids that exist, if they are to be checked."""
    header = f"{TRUTH[0]}\t{column}"
    heads = lines.where(F.col("line") == header)
    rows = lines.where((F.col("line") != header) & (F.col("line") != ""))
    well = rows.where("has_tab")
    ids = well.select("s1", F.explode(F.filter(F.transform(F.split("ids", ","), lambda x: F.trim(x)), lambda x: x != "")).alias("rid"))
    repeated = well.groupBy("s1").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    twice = ids.groupBy("s1", "rid").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    out = [
        _rule("bad_header", lines.agg(F.sum((F.col("line") == header).cast("int")).alias("h")).where("coalesce(h, 0) <> 1").withColumn("x", F.lit(column)), "x"),
        _rule("missing_tab", rows.where("not has_tab"), "line"),
        _rule("duplicate_row", repeated, "s1"),
        _rule("duplicate_id", twice, "rid"),
        _rule("self_match", ids.where(F.rlike("rid", F.lit("^S1-"))), "rid"),
        _rule("wrong_prefix", ids.where(~F.rlike("rid", F.lit("^S[123]-"))), "rid"),
        _rule("missing_entity", required.select("s1").join(well, "s1", "left_anti"), "s1"),
        _rule("extra_entity", well.select("s1").join(required, "s1", "left_anti"), "s1"),
    ]
    if valid is not None:
        out.append(_rule("unknown_id", ids.where(F.rlike("rid", F.lit("^S[23]-"))).join(valid, "rid", "left_anti"), "rid"))
    del heads
    report = out[0]
    for x in out[1:]:
        report = report.unionByName(x)
    return report.where("n > 0")


def validate(spark: SparkSession, matching: str, candidates: str, required: DataFrame, valid: DataFrame | None = None) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a submission; matches that are no candidates are a warning only."""
    errors, lines = [], {}
    for kind, path in (("matching", matching), ("candidates", candidates)):
        lines[kind] = read_lists(spark, path)
        errors += [f"{kind}: {r.rule} {r.n} ({r.example})" for r in check_lists(lines[kind], KINDS[kind], required, valid).orderBy("rule").collect()]
    m, c = (truth_pairs(lines[k].where("has_tab"), "s1", "ids") for k in ("matching", "candidates"))
    outside = m.where(F.col("s1") != TRUTH[0]).join(c, ["s1", "rid"], "left_anti").count()
    return errors, [f"{outside} matches are no candidates"] if outside else []


def snapshot(spark: SparkSession, folder: str, pairs: DataFrame, entities: DataFrame, metrics: dict | None = None, notes: str = "") -> dict:
    """Write both lists of ``pairs`` (s1, rid, keep), validate them and write what is known of the run."""
    for kind, rows in (("matching", pairs.where("keep")), ("candidates", pairs)):
        write_id_lists(rows.select("s1", "rid"), entities, f"{folder}/{kind}", kind)
    errors, warnings = validate(spark, f"{folder}/matching", f"{folder}/candidates", entities)
    if errors:
        raise ValueError("; ".join(errors))
    meta = {"metrics": metrics or {}, "notes": notes, "match_pairs": pairs.where("keep").count(), "candidate_pairs": pairs.count(), "warnings": warnings}
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")
    return meta


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(k, s) of appended JSON lines; torn lines are dropped and an answer beats none for one key."""
    df = spark.read.schema("k string, s double").json(path, mode="DROPMALFORMED")
    return df.where("k is not null").groupBy("k").agg(F.max("s").alias("s"))


def load_config(path: str, **over) -> dict:
    """A YAML or JSON tree with top-level values replaced."""
    text = Path(path).read_text()
    try:
        import yaml

        tree = yaml.safe_load(text)
    except ImportError:
        tree = json.loads(text)
    return {**tree, **over}


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
