import pytest
from pyspark.sql import functions as F

from kinfold.sources import tables as tb


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_tsv_keeps_literal_values(spark, tmp_path):
    p = write(tmp_path / "a.tsv", 'entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tnull\tNA\tUS\nS1-2\t"A ""b"""\t\tIN\n')
    assert [tuple(r) for r in tb.load_source(spark, p).orderBy("entity_id").collect()] == [("S1-1", "null", "NA", "US"), ("S1-2", 'A "b"', "", "IN")]
    assert tb.read_tsv(spark, p, quoted=False).where("entity_id = 'S1-2'").first().business_name == '"A ""b"""'
    with pytest.raises(ValueError, match="country"):
        tb.load_source(spark, write(tmp_path / "b.tsv", "entity_id\tbusiness_name\tbusiness_address\n"))


def test_truth_and_lists(spark, tmp_path):
    t = spark.createDataFrame([("a", "S2-1,S3-2"), ("b", "")], "source1_entity_id string, matched_entity_ids string")
    pairs = tb.truth_pairs(t)
    assert sorted(map(tuple, pairs.collect())) == [("a", "S2-1"), ("a", "S3-2")]
    e = spark.createDataFrame([("a",), ("b",)], "s1 string")
    assert tb.write_id_lists(pairs.union(pairs), e, str(tmp_path / "m")) == 2
    back = tb.read_tsv(spark, str(tmp_path / "m"), tb.TRUTH, quoted=False)
    assert sorted(map(tuple, back.collect())) == [("a", "S2-1,S3-2"), ("b", "")]
    for bad in ([("x", "S2-1")], [("a", "S1-9")]):
        with pytest.raises(ValueError):
            tb.write_id_lists(spark.createDataFrame(bad, "s1 string, rid string"), e, str(tmp_path / "n"))


def test_both_lists(spark):
    t = spark.createDataFrame([("c", "S2-1", True), ("a", "S3-1", False), ("c", "S2-2", False)], "s1 string, rid string, keep boolean")
    got = {r.s1: (r.matches, r.candidates) for r in tb.both_lists(t, spark.createDataFrame([("a",), ("b",), ("c",)], "s1 string")).collect()}
    assert got == {"a": ("", "S3-1"), "b": ("", ""), "c": ("S2-1", "S2-1,S2-2")}


HEAD = "source1_entity_id\tmatched_entity_ids"


@pytest.mark.parametrize(("text", "rule"), [
    (f"{HEAD}\na\tS2-1\nb\t\n", None), ("source1_entity_id,matched_entity_ids\na\tS2-1\nb\t\n", "bad_header"), (f"{HEAD}\na\tS2-1\nb\n", "missing_tab"), (f"{HEAD}\na\tS2-1\na\t\nb\t\n", "duplicate_row"),
    (f"{HEAD}\na\tS2-1,S2-1\nb\t\n", "duplicate_id"), (f"{HEAD}\na\tS1-1\nb\t\n", "self_match"), (f"{HEAD}\na\tX-1\nb\t\n", "wrong_prefix"), (f"{HEAD}\na\tS2-9\nb\t\n", "unknown_id"),
    (f"{HEAD}\na\tS2-1\n", "missing_entity"), (f"{HEAD}\na\tS2-1\nb\t\nz\t\n", "extra_entity"),
])
def test_rules(spark, tmp_path, text, rule):
    e, ids = spark.createDataFrame([("a",), ("b",)], "s1 string"), spark.createDataFrame([("S2-1",)], "rid string")
    found = {r.rule for r in tb.check_lists(tb.read_lists(spark, write(tmp_path / "x.tsv", text)), "matched_entity_ids", e, ids).collect()}
    assert (rule in found) if rule else not found


def test_snapshot_and_warning(spark, tmp_path):
    e = spark.createDataFrame([("a",), ("b",)], "s1 string")
    t = spark.createDataFrame([("a", "S2-1", True), ("a", "S3-1", False)], "s1 string, rid string, keep boolean")
    meta = tb.snapshot(spark, str(tmp_path / "run"), t, e, {"f05": 1.0})
    assert meta["match_pairs"] == 1 and meta["candidate_pairs"] == 2 and not meta["warnings"]
    m, c = write(tmp_path / "m.tsv", f"{HEAD}\na\tS2-7\nb\t\n"), write(tmp_path / "c.tsv", "source1_entity_id\tcandidate_entity_ids\na\tS2-1\nb\t\n")
    assert tb.validate(spark, m, c, e) == ([], ["1 matches are no candidates"])


def test_answers_config_cache_limit(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", '{"k": "0-2-1-1", "s": null}\n{"k": "0-2-1-1", "s": 0.5}\n{"k": "0-2-')
    assert [tuple(r) for r in tb.read_answers(spark, p).collect()] == [("0-2-1-1", 0.5)]
    assert tb.load_config(write(tmp_path / "c.yaml", '{"seed": 1, "x": 2}'), seed=3) == {"seed": 3, "x": 2}
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert tb.cached(spark, str(tmp_path / "t"), make).count() == tb.cached(spark, str(tmp_path / "t"), make).count() == 3 and len(made) == 1
    df = spark.range(10).select((F.col("id") % 2).alias("country"), "id")
    assert tb.limited(df, 2, ("country",), "id").count() == 4 and [r.country for r in tb.countries(df).collect()] == [0, 1]


def test_stream(spark, tmp_path):
    from kinfold.operators.retrieval import postings, weighted, word_grams
    from kinfold.operators.retrieval import record_side
    from kinfold.streaming.blocking import arriving_matches, entity_index, windowed_arrivals

    e = spark.createDataFrame([("x", 1, "red fox red"), ("x", 2, "blue whale"), ("x", 3, "red whale of the sea")], "part string, id long, text string")
    records = [("x", 9, "the red fox"), ("x", 8, "a blue whale"), ("x", 7, "the sea of red red foxes and a whale"), ("x", 6, "nothing known")]
    r = spark.createDataFrame(records, "part string, id long, text string")
    r.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("part string, id long, text string").parquet(str(tmp_path / "in"))
    got = []
    body = arriving_matches(stream, entity_index(e, r, max_df=0.9))
    q = stream.writeStream.foreachBatch(body(lambda df: got.extend(df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = record_side(r, e, k=3, max_df=0.9).collect()
    assert want and {(x.q, x.d, x["rank"]): x.score for x in got} == pytest.approx({(x.q, x.d, x["rank"]): x.score for x in want}, abs=1e-8)
    ev = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 05:00:00")], "user_id long, event_type string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert windowed_arrivals(ev).first().n == 2
