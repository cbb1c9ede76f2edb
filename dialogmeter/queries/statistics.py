"""Regression, correlation and ridge reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialogmeter.functions.ratings import parse_ratings
from dialogmeter.operators import regression, ridge
from dialogmeter.operators.annotations import grouped_median, long_form, median_table
from dialogmeter.operators.correlation import correlation_matrix, wide_matrix
from dialogmeter.operators.pairwise import win_ratio
from dialogmeter.operators.scoring import score
from dialogmeter.plans.workflows import compare_components, correlate, explain_overall, rating_correlation, rating_lines
from dialogmeter.queries import overlap, sqltext
from dialogmeter.queries.registry import query
from dialogmeter.queries.scores import COUNTS_SQL, MEAN3, WORDS_SQL, _BP_CTX
from dialogmeter.queries.views import KEY, MEDIANS_SQL, QUALITIES, last_examples, table, votes
from dialogmeter.session import landed

ALL = sqltext.rounded(sqltext.FIT_COLUMNS)


def _line_items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")


@query(
    "q_linregress",
    f"with {sqltext.fits('lineitem', 'l_quantity', 'l_extendedprice', ['l_returnflag'])} select l_returnflag, {ALL}, n from fit",
)
def linregress(spark, sf_dir):
    fits = regression.linear_regression(_line_items(spark, sf_dir), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return regression.rounded(fits)


_DOCS = "docs as (select lang, n_chars, quality from documents join labels using (doc_id))"


@query(
    "q_linregress_documents",
    f"with {_DOCS}, {sqltext.fits('docs', 'n_chars', 'quality', ['lang'])} select lang, round(slope, 12) as slope, {sqltext.rounded(['intercept', 'r', 'r2', 'p', 'stderr'])}, n from fit",
)
def linregress_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(
        table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id"
    )
    fits = regression.linear_regression(docs, "n_chars", "quality", ["lang"]).withColumn("slope", F.round("slope", 12))
    return regression.rounded(fits, measures=["intercept", "r", "r2", "p", "stderr"])


# Context-last brevity penalty against the median of every rating.
_LONG = MEDIANS_SQL + ", " + COUNTS_SQL.split("from plain)\n", 1)[1].lstrip().lstrip(",") + f""",
sc as (select conv_id, turn, {_BP_CTX} as score from cnt),
long as ({" union all ".join(f"select '{q}' as quality, score, {q} as rating from med join sc using (conv_id, turn)" for q in QUALITIES)})
"""


def _scored(spark, sf_dir):
    return score(last_examples(spark, sf_dir), "bleu", "context_last")


@query(
    "q_linregress_by_quality",
    f"with {_LONG}, {sqltext.fits('long', 'score', 'rating', ['quality'])} select quality, {ALL}, n from fit",
)
def linregress_by_quality(spark, sf_dir):
    return regression.rounded(correlate(_scored(spark, sf_dir), QUALITIES))


@query(
    "q_linregress_propagate_nulls",
    f"""with {_LONG}, {sqltext.fits('long', 'score', 'rating', ['quality'])},
    gaps as (select quality, count(*) - count(rating) as missing from long group by 1)
    select quality, case when missing = 0 then round(r, 6) end as r, case when missing = 0 then round(p, 6) end as p, n
    from fit join gaps using (quality)""",
)
def linregress_propagate_nulls(spark, sf_dir):
    return regression.rounded(correlate(_scored(spark, sf_dir), QUALITIES, nulls="propagate")).select("quality", "r", "p", "n")


@query(
    "q_correlation_report",
    f"""with {_LONG}, {sqltext.fits('long', 'score', 'rating', ['quality'])}
    select quality, round(r, 6) as r, round(p, 6) as p, n,
      concat(quality, ': $R=$', {sqltext.short_decimal('r')}, chr(10), ' p=', {sqltext.short_decimal('p')}) as label from fit""",
)
def correlation_report(spark, sf_dir):
    return regression.correlation_report(correlate(_scored(spark, sf_dir), QUALITIES), "quality")


@query(
    "q_report_label",
    f"""with {sqltext.fits('lineitem', 'l_quantity', 'l_extendedprice', ['l_returnflag'])}
    select l_returnflag, concat(l_returnflag, ': $R=$', round(r, 4), chr(10), ' p=', round(p, 4)) as label from fit""",
)
def report_label(spark, sf_dir):
    fits = regression.linear_regression(_line_items(spark, sf_dir), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return regression.correlation_report(fits, "l_returnflag", digits=4).select("l_returnflag", "label")


@query(
    "q_p_value",
    f"""with pts as (select event_id % 97 as grp, event_id % 13 as x, value as y from events),
    {sqltext.fits('pts', 'x', 'y', ['grp'])} select grp, round(r, 6) as r, round(p, 6) as p, n from fit""",
)
def p_value(spark, sf_dir):
    e = F.col("event_id")
    points = table(spark, sf_dir, "events").select((e % 97).alias("grp"), (e % 13).alias("x"), F.col("value").alias("y"))
    return regression.rounded(regression.linear_regression(points, "x", "y", ["grp"])).select("grp", "r", "p", "n")


@query(
    "q_r_squared",
    """select round(regr_r2(l_extendedprice, l_quantity), 4) as r2, round(corr(l_extendedprice, l_quantity), 4) as r,
       count(*) as n from lineitem""",
)
def r_squared(spark, sf_dir):
    fits = regression.linear_regression(_line_items(spark, sf_dir), "l_quantity", "l_extendedprice")
    return regression.rounded(fits, digits=4).select("r2", "r", "n")


@query(
    "q_fitted_line",
    """with f as (select l_returnflag, regr_slope(l_extendedprice, l_quantity) as s, regr_intercept(l_extendedprice, l_quantity) as i
      from lineitem group by 1)
    select l_returnflag, l_quantity as x, l_extendedprice as y, round(i + s * l_quantity, 4) as y_hat
    from lineitem join f using (l_returnflag)""",
)
def fitted_line(spark, sf_dir):
    points = regression.fitted_line(_line_items(spark, sf_dir), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return points.withColumn("y_hat", F.round("y_hat", 4))


@query(
    "q_rating_lines",
    f"""with {_LONG}, f as (select quality, regr_slope(rating, score) as s, regr_intercept(rating, score) as i from long group by 1)
    select quality, round(score, 6) as x, rating as y, round(i + s * score, 6) as y_hat from long join f using (quality)""",
)
def rating_line_points(spark, sf_dir):
    points = rating_lines(_scored(spark, sf_dir), QUALITIES)
    return points.withColumns({"x": F.round("x", 6), "y_hat": F.round("y_hat", 6)})


_MATRIX = " union all ".join(
    f"select '{a}' as col_a, '{b}' as col_b, round(corr({b}, {a}), 6) as r, regr_count({b}, {a}) as n from med"
    for a in QUALITIES for b in QUALITIES
)


@query("q_corr_matrix", f"with {MEDIANS_SQL} {_MATRIX}")
def corr_matrix(spark, sf_dir):
    return rating_correlation(last_examples(spark, sf_dir), QUALITIES).withColumn("r", F.round("r", 6))


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "q_corr_matrix_volume",
    " union all ".join(
        "select '{0}' as col_a, {1} from lineitem".format(
            a, ", ".join(f"round(corr({b}, {a}), 6) as {b}" for b in _MEASURES)
        )
        for a in _MEASURES
    ),
)
def corr_matrix_volume(spark, sf_dir):
    long = correlation_matrix(table(spark, sf_dir, "lineitem").select(*_MEASURES), _MEASURES)
    return wide_matrix(long, _MEASURES).withColumns({c: F.round(c, 6) for c in _MEASURES})


@query(
    "q_component_regress",
    f"""with {WORDS_SQL}, sc as (select *, {MEAN3} as score from f1), shown as (
      select event_id % 500 as prompt_id, user_id % 10 as a, (user_id + 1 + event_id % 4) % 10 as b,
        case when event_type = 'error' then null else event_id % 3 end as value, event_id from events),
    seen as (select distinct prompt_id, model, a, b, value, event_id from (
      select prompt_id, a as model, a, b, value, event_id from shown union all select prompt_id, b, a, b, value, event_id from shown)),
    sides as (select prompt_id, model, count(*) filter ((a = model and value = 0) or (b = model and value = 1)) as wins from seen group by 1, 2),
    pts as (select sc.* from sc join sides on sides.prompt_id = sc.conv_id where wins > 0),
    long as (select 'ref_score' as component, score, ref_score as part from pts
      union all select 'context_score', score, context_score from pts
      union all select 'empty_score', score, empty_score from pts),
    {sqltext.fits('long', 'score', 'part', ['component'])} select component, {ALL}, n from fit""",
)
def component_regress(spark, sf_dir):
    # Each model's votes on a dialogue give its replies a win ratio.
    ratios = win_ratio(votes(spark, sf_dir)).select(F.col("prompt_id").alias("conv_id"), "win_ratio")
    table = last_examples(spark, sf_dir).join(ratios, "conv_id")
    scored = score(table, overlap.NAME, "multi_avg")
    return regression.rounded(compare_components(scored, ["ref_score", "context_score", "empty_score"]))


def _ridge_rows(spark, sf_dir):
    return median_table(last_examples(spark, sf_dir), QUALITIES, keep=KEY)


_FEATURES = ["understandable", "engaging"]
_SPLIT = "cast('0x' || substr(md5(concat(conv_id, '|', turn)), 1, 8) as bigint) % 4 = 0"


@query("q_split", f"with {MEDIANS_SQL} select conv_id, turn, {_SPLIT} as is_test from med")
def split(spark, sf_dir):
    return last_examples(spark, sf_dir).select(*KEY, ridge.is_test_row(KEY).alias("is_test"))


_COMPLETE = MEDIANS_SQL + f""",
rows as (select {_SPLIT} as is_test, understandable as a, engaging as b, overall as y from med
  where understandable is not null and engaging is not null and overall is not null)
"""


@query(
    "q_ridge_gram",
    f"""with {_COMPLETE}
    select is_test, count(*) as n, round(avg(a), 6) as mean_understandable, round(avg(b), 6) as mean_engaging, round(avg(y), 6) as mean_overall,
      round(regr_sxx(a, a), 4) as s_understandable_understandable, round(regr_sxy(a, b), 4) as s_understandable_engaging,
      round(regr_sxy(a, y), 4) as s_understandable_overall, round(regr_sxx(b, b), 4) as s_engaging_engaging,
      round(regr_sxy(b, y), 4) as s_engaging_overall, round(regr_sxx(y, y), 4) as s_overall_overall
    from rows group by 1""",
)
def ridge_gram(spark, sf_dir):
    rows = ridge.split_rows(_ridge_rows(spark, sf_dir), _FEATURES, "overall", KEY)
    moments = ridge.split_moments(rows, _FEATURES, "overall")
    return moments.select(
        "is_test", "n",
        *[F.round(c, 6 if c.startswith("mean") else 4).alias(c) for c in moments.columns if c not in ("is_test", "n")],
    )


# Two features: the penalised system is solved by Cramer's rule.
_RIDGE = _COMPLETE + """,
mo as (select avg(a) as ma, avg(b) as mb, avg(y) as my, regr_sxx(a, a) as saa, regr_sxy(a, b) as sab, regr_sxx(b, b) as sbb,
  regr_sxy(a, y) as say, regr_sxy(b, y) as sby, count(*) as n from rows where not is_test),
grid as (select unnest([0.1, 1.0, 10.0])::double as alpha),
sol as (select *, (saa + alpha) * (sbb + alpha) - sab * sab as det from mo cross join grid),
plain_w as (select *, ((sbb + alpha) * say - sab * sby) / det as wa, ((saa + alpha) * sby - sab * say) / det as wb from sol),
resid as (select alpha, y - my - wa * (a - ma) - wb * (b - mb) as e,
  1.0 / n + ((sbb + alpha) * (a - ma) * (a - ma) - 2 * sab * (a - ma) * (b - mb) + (saa + alpha) * (b - mb) * (b - mb)) / det as h
  from rows cross join plain_w where not is_test),
loo as (select alpha, avg(pow(e / (1 - h), 2)) as loo_mse from resid group by 1),
unit as (select *, sqrt(saa) as la, sqrt(sbb) as lb, sab / sqrt(saa * sbb) as c from mo cross join grid),
unit_w as (select *, ((1 + alpha) * say / la - c * sby / lb) / ((1 + alpha) * (1 + alpha) - c * c) / la as wa,
  ((1 + alpha) * sby / lb - c * say / la) / ((1 + alpha) * (1 + alpha) - c * c) / lb as wb from unit),
test as (select alpha, avg(pow(y - my - wa * (a - ma) - wb * (b - mb), 2)) as test_mse from rows cross join unit_w where is_test group by 1),
errors as (select alpha, loo_mse, test_mse from loo join test using (alpha)),
best as (select alpha, test_mse from errors order by loo_mse, alpha limit 1),
total as (select avg(a) as ma, avg(b) as mb, avg(y) as my, regr_sxx(a, a) as saa, regr_sxy(a, b) as sab, regr_sxx(b, b) as sbb,
  regr_sxy(a, y) as say, regr_sxy(b, y) as sby from rows),
fin as (select *, sqrt(saa) as la, sqrt(sbb) as lb, sab / sqrt(saa * sbb) as c from total cross join best),
fin_w as (select *, ((1 + alpha) * say / la - c * sby / lb) / ((1 + alpha) * (1 + alpha) - c * c) / la as wa,
  ((1 + alpha) * sby / lb - c * say / la) / ((1 + alpha) * (1 + alpha) - c * c) / lb as wb from fin)
"""


@query("q_ridge_errors", f"with {_RIDGE} select alpha, round(loo_mse, 6) as loo_mse, round(test_mse, 6) as test_mse from errors")
def ridge_errors(spark, sf_dir):
    errors = ridge.ridge_errors(_ridge_rows(spark, sf_dir), _FEATURES, "overall", KEY)
    return errors.select("alpha", F.round("loo_mse", 6).alias("loo_mse"), F.round("test_mse", 6).alias("test_mse"))


@query(
    "q_ridge_parameters",
    f"""with {_RIDGE} select 'alpha' as param, alpha as value from best union all select 'mse', round(test_mse, 6) from best
    union all select 'coef_understandable', round(wa, 6) from fin_w union all select 'coef_engaging', round(wb, 6) from fin_w
    union all select 'intercept', round(my - wa * ma - wb * mb, 6) from fin_w""",
)
def ridge_report(spark, sf_dir):
    return explain_overall(_ridge_rows(spark, sf_dir), KEY).withColumn("value", F.round("value", 6))


# Exactly a quarter of the rows, rounded up: those with the smallest digests of their keys.
_DIGEST = "cast('0x' || substr(md5(concat(conv_id, '|', turn)), 1, 15) as bigint)"
_EXACT = f"row_number() over (order by {_DIGEST}, concat(conv_id, '|', turn)) <= ceil(count(*) over () / 4.0)"


@query("q_split_exact", f"with {MEDIANS_SQL} select conv_id, turn, {_EXACT} as is_test from med")
def split_exact(spark, sf_dir):
    rows = landed(last_examples(spark, sf_dir).select(*KEY), "split-keys")
    return rows.withColumn("is_test", ridge.exact_test_rows(rows, KEY))


_RIDGE_EXACT = _RIDGE.replace(f"{_SPLIT} as is_test", f"{_EXACT} as is_test")


@query("q_ridge_exact", f"with {_RIDGE_EXACT} select alpha, round(loo_mse, 6) as loo_mse, round(test_mse, 6) as test_mse from errors")
def ridge_exact(spark, sf_dir):
    errors = ridge.ridge_errors(_ridge_rows(spark, sf_dir), _FEATURES, "overall", KEY, exact=True)
    return errors.select("alpha", F.round("loo_mse", 6).alias("loo_mse"), F.round("test_mse", 6).alias("test_mse"))


@query(
    "q_point_cells",
    """with b as (select min(l_quantity) as xl, max(l_quantity) as xh, min(l_extendedprice) as yl, max(l_extendedprice) as yh from lineitem),
    placed as (select l_returnflag, least(floor((l_quantity - xl) / (xh - xl) * 25), 24)::int as x_cell,
      least(floor((l_extendedprice - yl) / (yh - yl) * 25), 24)::int as y_cell, xl, xh, yl, yh from lineitem, b)
    select l_returnflag, x_cell, y_cell, round(xl + (xh - xl) * x_cell / 25, 4) as x_from, round(yl + (yh - yl) * (y_cell + 1) / 25, 4) as y_to,
      count(*) as n from placed group by all""",
)
def point_cells(spark, sf_dir):
    cells = regression.point_cells(_line_items(spark, sf_dir), "l_quantity", "l_extendedprice", ["l_returnflag"], cells=25)
    return cells.select("l_returnflag", "x_cell", "y_cell", F.round("x_from", 4).alias("x_from"), F.round("y_to", 4).alias("y_to"), "n")


_WIDE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey", "gap"]


@query(
    "q_corr_matrix_gaps",
    "with w as (select *, case when l_orderkey % 3 = 0 then null else l_discount * l_quantity end as gap from lineitem) "
    + " union all ".join(
        f"select '{a}' as col_a, '{b}' as col_b, round(corr({b}, {a}), 6) as r, regr_count({b}, {a}) as n from w" for a in _WIDE for b in _WIDE),
)
def corr_matrix_gaps(spark, sf_dir):
    gap = F.when(F.col("l_orderkey") % 3 != 0, F.col("l_discount") * F.col("l_quantity"))
    rows = table(spark, sf_dir, "lineitem").withColumn("gap", gap)
    return correlation_matrix(rows, _WIDE).withColumn("r", F.round("r", 6))


@query("q_median_volume", "select l_returnflag, l_linestatus, median(l_extendedprice) as median from lineitem group by all")
def median_volume(spark, sf_dir):
    return grouped_median(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query(
    "q_median_votes",
    f"""with {MEDIANS_SQL}, long as ({" union all ".join(f"select conv_id, turn, '{q}' as quality, {q} as median from med" for q in QUALITIES)})
    select * from long where median is not null""",
)
def median_votes(spark, sf_dir):
    # Every annotator's answer is a row of its own.
    cells = long_form(last_examples(spark, sf_dir), QUALITIES, keep=KEY, value="cell")
    answers = cells.select(*KEY, "quality", F.explode(parse_ratings(F.col("cell"))).alias("rating"))
    return grouped_median(answers, [*KEY, "quality"], "rating")
