"""Label cleaning operators."""


from textlab.operators import labels as lb
from textlab.operators.select import strip_spans
from textlab.plans.prepare_cases import prepare_cases


def test_code_number_golden(spark):
    df = spark.createDataFrame([("CC-289(3)-00",), ("CC-80-00",), ("CC-9(1)-00",)], "code string")
    assert [r["code"] for r in lb.filter_codes(df, "code").collect()] == ["CC-289(3)-00"]


def test_multi_hot_substring_trap(spark):
    df = spark.createDataFrame([(1, "PCC-288-00")], "id int, lawids string")
    labels = spark.createDataFrame([("CC-288-00",)], "label string")
    assert lb.multi_hot(df, labels, match="exact").count() == 0
    assert lb.multi_hot(df, labels, match="substring").first()["multi_hot"] == [1]


def test_strip_spans_newline_rules(spark):
    df = spark.createDataFrame([("a<discr>x\ny</discr>b",), ("a<discr>x\ry</discr>b",)], "fact string")
    got = [r["filtered_fact"] for r in strip_spans(df).collect()]
    assert got == ["a<discr>x\ny</discr>b", "ab"]


def test_latest_per_key_skips_nulls_and_breaks_ties(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 3, 11), (1, 3, 9), (2, None, 1), (None, 5, 2)], "k int, issue int, id int")
    got = lb.latest_per_key(df, "k", "issue", "id").collect()
    assert [(r["k"], r["issue"], r["id"]) for r in got] == [(1, 3, 9)]


def test_label_rank_and_primary(spark):
    long = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "c"), (3, "b"), (4, "c")], "id int, label string")
    rank = {r["label"]: r["rank"] for r in lb.label_rank(long).collect()}
    assert rank == {"b": 0, "c": 1, "a": 2}
    prim = {r["id"]: r["label"] for r in lb.primary_label(long, "id", lb.label_rank(long)).collect()}
    assert prim == {1: "b", 2: "b", 3: "b", 4: "c"}


def test_prepare_cases_isguilty_encodes_any_values(spark):
    df = spark.createDataFrame([(1, 1, "x <discr>y</discr>", "yes"), (2, 1, "z", "no"), (3, 1, "w", "yes")],
                               "dekaid int, issueno int, fact string, verdict string")
    out = prepare_cases(df, label="verdict")
    assert sorted((r["label"], r["filtered_fact"]) for r in out.collect()) == [(0, "z"), (1, "w"), (1, "x ")]


def test_dense_labels(spark):
    df = spark.createDataFrame([(1, 10), (2, 30), (3, 10)], "id int, label int")
    assert sorted((r["id"], r["label"]) for r in lb.dense_labels(df).collect()) == [(1, 0), (2, 1), (3, 0)]
