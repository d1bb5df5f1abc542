from pyspark.sql import functions as F

from marketday.functions import scalar, text


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def n(value):
    return F.lit(value).cast("double")


def test_guarded_arithmetic(spark):
    got = one(
        spark,
        scalar.safe_divide(n(1), n(0)), scalar.safe_divide(n(1), n(None)), scalar.safe_divide(n(3), n(2)),
        scalar.zscore(n(5), n(3), n(0)), scalar.zscore(n(5), n(3), n(None)), scalar.zscore(n(5), n(3), n(4)),
        scalar.robust_zscore(n(5), n(3), n(0)), scalar.robust_zscore(n(4.4826), n(3), n(0.5)),
        scalar.coalesce_zero(n(None)), scalar.coalesce_zero(n(7)),
    )
    assert got[:7] == (None, None, 1.5, None, None, 0.5, None)
    assert abs(got[7] - 2.0) < 1e-12
    assert got[8:] == (0.0, 7.0)


def test_sql_functions_agree(spark):
    scalar.register(spark)
    got = spark.sql(
        "SELECT safe_divide(1, 0), safe_divide(3, 2), zscore(5, 3, 4), zscore(5, 3, 0), robust_zscore(5, 3, 0), "
        "robust_zscore(4.4826, 3, 0.5), coalesce_zero(NULL), coalesce_zero(7)"
    ).first()
    assert tuple(got)[:5] == (None, 1.5, 0.5, None, None)
    assert abs(got[5] - 2.0) < 1e-12 and tuple(got)[6:] == (0.0, 7.0)


def test_sql_functions_are_inlined(spark):
    scalar.register(spark)
    plan = spark.range(3).selectExpr("safe_divide(id, 2) AS r")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "safe_divide" not in plan


def test_first_filled(spark):
    assert one(
        spark,
        text.first_filled(F.lit(""), F.lit("b")), text.first_filled(F.lit(None).cast("string"), F.lit("")),
        text.first_filled(F.lit("a"), F.lit("b")),
    ) == ("b", "", "a")


def test_language_label(spark):
    names = ["x.sql", "X.PY", "a.b.Java", "q.scala", "readme.md", "sql"]
    got = one(spark, *[text.language_label(F.lit(x)) for x in names])
    assert got == ("SQL", "Python", "Java", "Scala", "", "")


def test_without_fences(spark):
    assert one(
        spark,
        text.without_fences(F.lit("```dot\ndigraph {}\n```\n")), text.without_fences(F.lit("  digraph {}  ")),
        text.without_fences(F.lit("```\na\n```\nb\n```")),
    ) == ("digraph {}", "digraph {}", "a\n```\nb")


def test_truncated_keeps_short_text(spark):
    assert one(spark, text.truncated(F.lit("abc"), 2), text.truncated(F.lit("abc"), 180)) == ("ab", "abc")
