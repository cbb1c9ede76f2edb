import statistics

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogmeter.functions.ratings import median_rating, parse_ratings, ratings_as_text
from dialogmeter.operators.annotations import long_form, median_table, quality_columns

CELLS = ["[1, 0, 1]", "[2, 1]", "[]", "['N/A (no, sorry)', 3, 5]", "[N/A]", "[-1, 2.5, 4]", None, "[10]"]


def test_parse(values):
    assert values(CELLS, parse_ratings) == [[1, 0, 1], [2, 1], [], [3, 5], [], [4], None, [10]]


def test_median_of_list_cells(values):
    assert values(CELLS, lambda c: median_rating(c, T.StringType())) == [1.0, 1.5, None, 4.0, None, 4.0, None, 10.0]


def test_numbers_are_their_own_median(values):
    assert values([3, None], lambda c: median_rating(c, T.LongType()), "bigint") == [3.0, None]
    assert values(["2.5", "x"], lambda c: median_rating(c, T.StringType())) == [2.5, None]


def test_median_of_array_columns(values):
    lists = [[3, 1, 2], [4, 1], [], None, [5, None]]
    want = [2.0, 2.5, None, None, 5.0]
    assert values(lists, lambda c: median_rating(c, T.ArrayType(T.LongType())), "array<bigint>") == want
    words = [["3", "N/A", "1"], ["x"]]
    assert values(words, lambda c: median_rating(c, T.ArrayType(T.StringType())), "array<string>") == [2.0, None]


def test_median_agrees_with_python(values):
    lists = [[(i * 7 + j * 3) % 11 for j in range(n)] for i, n in enumerate(range(1, 30))]
    cells = [str(v) for v in lists]
    assert values(cells, lambda c: median_rating(c, T.StringType())) == [float(statistics.median(v)) for v in lists]


def test_text_form(values):
    assert values([[1, 0], [], None], ratings_as_text, "array<bigint>") == ["[1, 0]", "[]", None]


def test_quality_columns_by_position():
    columns = ["context", "model", "natural", "overall", "ref_score", "empty_score", "score"]
    assert quality_columns(columns) == ["natural", "overall"]
    assert quality_columns(columns, include_components=True) == ["natural", "overall", "ref_score", "empty_score"]


def test_long_form(spark):
    df = spark.createDataFrame([(1, "[1, 2]", 4.0)], "id int, a string, b double")
    rows = long_form(median_table(df, ["a", "b"], keep=["id"]), ["a", "b"], keep=["id"]).orderBy("quality").collect()
    assert [tuple(r) for r in rows] == [(1, "a", 1.5), (1, "b", 4.0)]


def test_numbers_of_any_length(values):
    cells = ["[1, 99999999999999999999]", "[" + "9" * 400 + "]", "[007]"]
    assert values(cells, parse_ratings) == [[1.0, 1e20], [float("inf")], [7.0]]
    assert values(cells, lambda c: median_rating(c, T.StringType())) == [5e19, float("inf"), 7.0]
