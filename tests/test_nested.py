import json

import pytest
from pyspark.sql import functions as F

from seine.operators.nested import Node, flatten_records, long_form
from seine.queries.data import LEAVES, RECEIPT

LEVELS = {"profile_pos": "profiles", "build_pos": "builds"}


def found(spark, payloads):
    df = spark.createDataFrame(list(enumerate(payloads)), "receipt_id bigint, payload string")
    return {tuple(r) for r in long_form(df, "payload", ["receipt_id"], LEAVES, LEVELS).collect()}


def record(**parts):
    return json.dumps(parts)


def test_positions_and_null_elements(spark):
    builds = [None, {"artifacts": [{"sha256": "a"}, None, {"sha256": None}, {"sha256": ""}], "revisions": [{"commit": "c"}]}]
    rows = found(spark, [record(reproducibility={"profiles": [None, {"builds": builds}]})])
    assert rows == {(0, 1, 1, "artifact", 0, "a"), (0, 1, 1, "artifact", 3, ""), (0, 1, 1, "revision", 0, "c")}


def test_bare_objects_and_direct_builds(spark):
    rows = found(spark, [record(reproducibility={"builds": {"artifacts": {"sha256": "x"}}}), record(reproducibility={"profiles": {"builds": {"revisions": {"commit": "y"}}}})])
    assert rows == {(0, -1, 0, "artifact", 0, "x"), (1, 0, 0, "revision", 0, "y")}


def test_parts_written_as_text(spark):
    inner = {"profiles": [json.dumps({"builds": json.dumps([{"artifacts": json.dumps({"sha256": "q\"ü"})}])})]}
    rows = found(spark, [record(reproducibility=json.dumps(inner)), record(bootstrap=json.dumps({"source_t111_path": "/p"})), json.dumps(record(derived_root={"facts_root": "/f"}))])
    assert rows == {(0, 0, 0, "artifact", 0, 'q"ü'), (1, -1, -1, "bootstrap", -1, "/p"), (2, -1, -1, "derived_root", -1, "/f")}


def test_parts_quoted_many_times(spark):
    part = {"builds": [{"artifacts": [{"sha256": "s"}]}]}
    payloads = []
    for times in range(1, 9):
        text = part
        for _ in range(times):
            text = json.dumps(text)
        payloads.append(record(reproducibility=text))
        payloads.append(json.dumps(payloads[-1]))
    assert found(spark, payloads) == {(i, -1, 0, "artifact", 0, "s") for i in range(len(payloads))}


@pytest.mark.parametrize("tail", ["", "x", "]", "}", ",1", ',"a":1', '{"b":1}', ",{}", "]]", "}}", ',"v":{}', ',"x"]', "],[1", ',"x"'])
def test_only_one_complete_value_counts(spark, tail):
    good = record(bootstrap={"source_t111_path": "/p"})
    assert len(found(spark, [good + tail])) == (tail == "")
    assert len(found(spark, [f"\n\t {good} \r\n"])) == 1


def test_damaged_payloads_give_nothing(spark):
    good = record(bootstrap={"source_t111_path": "/p"})
    broken = [None, "", " ", "null", "[]", "1", '"x"', good[:-1], good[:20], "{'bootstrap':{'source_t111_path':'/p'}}", record(bootstrap=None), record(bootstrap=[1]), record(bootstrap=7), record(reproducibility='{"builds":[')]
    assert found(spark, broken) == set()


def test_values_as_written(spark):
    rows = found(spark, ['{"bootstrap":{"source_t111_path":1.25},"derived_root":{"facts_root":"  a\\n"}}', '{"bootstrap":{"source_t111_path":true}}'])
    assert rows == {(0, -1, -1, "bootstrap", -1, "1.25"), (0, -1, -1, "derived_root", -1, "  a\n"), (1, -1, -1, "bootstrap", -1, "true")}


def test_repeated_records_stand_alone_and_clashing_columns_are_ignored(spark):
    p = record(bootstrap={"source_t111_path": "/p"})
    df = spark.createDataFrame([(1, p, "z", 5), (1, p, "z", 5)], "receipt_id bigint, payload string, child_value string, profile_pos int")
    assert long_form(df, "payload", ["receipt_id"], LEAVES, LEVELS).count() == 2


def test_long_record(spark):
    many = [{"sha256": f"h{i}" * 20} for i in range(5_000)]
    rows = found(spark, [record(reproducibility={"builds": [{"artifacts": many}]})])
    assert len(rows) == 5_000 and (0, -1, 0, "artifact", 4_999, "h4999" * 20) in rows


def test_empty_table(spark):
    assert long_form(spark.createDataFrame([], "receipt_id bigint, payload string"), "payload", ["receipt_id"], LEAVES, LEVELS).count() == 0


def test_tables_keep_links(spark):
    p = record(reproducibility={"profiles": [{"profile": "p0", "builds": [{"ordinal": 1, "artifacts": [{"name": "n", "sha256": "s"}]}, {}]}]})
    df = spark.createDataFrame([(9, p)], "receipt_id bigint, payload string")
    tables = flatten_records(df, "payload", ["receipt_id"], RECEIPT)
    assert tables["reproducibility.profiles"].select("profile", "profiles_pos").collect() == [("p0", 0)]
    builds = tables["reproducibility.profiles.builds"]
    assert sorted(map(tuple, builds.collect())) == [(9, 0, 0, "1"), (9, 0, 1, None)]
    joined = tables["reproducibility.profiles.builds.artifacts"].join(builds, ["receipt_id", "profiles_pos", "builds_pos"])
    assert joined.select("sha256", "ordinal").collect() == [("s", "1")]


def test_clashing_key_is_refused(spark):
    df = spark.range(1).select(F.lit("{}").alias("payload"), F.lit(1).alias("sha256"))
    with pytest.raises(ValueError):
        flatten_records(df, "payload", ["sha256"], (Node("a", True, {"sha256": "sha256"}),))
