"""Metrics side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmeter.operators import compare
from dialogmeter.operators.regression import pair_lines, pair_regressions, report_label, rounded
from dialogmeter.operators.scoring import score
from dialogmeter.queries import overlap, sqltext
from dialogmeter.queries.registry import query
from dialogmeter.queries.scores import COUNTS_SQL, WORDS_SQL, _BP_CTX, _BP_REF
from dialogmeter.queries.views import KEY, examples, last_examples
from dialogmeter.session import landed

NAMES = ["length", "length_context", "overlap"]


def score_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    # The metrics score one landed copy, so the dialogues are put together once.
    table = landed(examples(spark, sf_dir), "examples")
    return {
        "length": score(table, "bleu", "ref"),
        "length_context": score(table, "bleu", "context_last"),
        "overlap": score(table, overlap.NAME, "context_last"),
    }


_TAIL = "from plain)\n"
SIDE_SQL = COUNTS_SQL + "," + WORDS_SQL.split(_TAIL, 1)[1].lstrip().lstrip(",") + f""",
side as (select cnt.conv_id, cnt.turn, cnt.model, {_BP_REF} as length_score, {_BP_CTX} as length_context_score,
  f1.context_score as overlap_score from cnt join f1 using (conv_id, turn))
"""


@query(
    "q_metric_wide",
    f"with {SIDE_SQL} select conv_id, turn, model, {sqltext.rounded([f'{n}_score' for n in NAMES])} from side",
)
def metric_wide(spark, sf_dir):
    wide = compare.metrics_side_by_side(score_tables(spark, sf_dir), key=[*KEY, "context", "model"])
    return wide.select(*KEY, "model", *[F.round(f"{n}_score", 6).alias(f"{n}_score") for n in NAMES])


@query(
    "q_metric_wide_by_index",
    f"""with {SIDE_SQL} select row_number() over (order by conv_id, turn) - 1 as row_id, round(length_score, 6) as length_score,
    round(length_context_score, 6) as length_context_score from side""",
)
def metric_wide_by_index(spark, sf_dir):
    tables = score_tables(spark, sf_dir)
    indexed = {
        name: compare.with_row_index(tables[name].select(*KEY, "score"), KEY) for name in ("length", "length_context")
    }
    wide = compare.metrics_side_by_side(indexed, key=["row_id"], text_key=())
    return wide.withColumns({c: F.round(c, 6) for c in ("length_score", "length_context_score")})


_PAIRS = [("length_score", "overlap_score"), ("length_context_score", "overlap_score"), ("length_score", "length_context_score")]
_POINTS = " union all ".join(
    f"select '{scope}' as scope, '{x}' as x_name, '{y}' as y_name, {x} as x, {y} as y from side{where}"
    for x, y in _PAIRS
    for scope, where in (("all", ""), ("excl_human", f" where model is distinct from '{compare.HUMAN_MODEL}'"))
)


@query(
    "q_metric_pairs",
    f"""with {SIDE_SQL}, pts as ({_POINTS}), {sqltext.fits('pts', 'x', 'y', ['scope', 'x_name', 'y_name'])}
    select scope, x_name, y_name, {sqltext.rounded(sqltext.FIT_COLUMNS)}, n from fit""",
)
def metric_pairs(spark, sf_dir):
    wide = compare.metrics_side_by_side(score_tables(spark, sf_dir), key=[*KEY, "context", "model"])
    return rounded(pair_regressions(wide, _PAIRS, {"all": None, "excl_human": compare.not_human()}))


_MODEL_POINTS = " union all ".join(
    f"select model, '{scope}' as scope, '{x}' as x_name, '{y}' as y_name, {x} as x, {y} as y from side{where}"
    for x, y in _PAIRS
    for scope, where in (("all", ""), ("excl_human", f" where model is distinct from '{compare.HUMAN_MODEL}'"))
)


@query(
    "q_metric_pair_lines",
    f"""with {SIDE_SQL}, pts as (select * from ({_MODEL_POINTS}) where x is not null and y is not null),
    line as (select scope, x_name, y_name, regr_slope(y, x) as s, regr_intercept(y, x) as i, corr(y, x) as r from pts group by 1, 2, 3)
    select model, scope, x_name, y_name, round(x, 6) as x, round(y, 6) as y, round(i + s * x, 6) as y_hat
    from pts join line using (scope, x_name, y_name)""",
)
def metric_pair_points(spark, sf_dir):
    wide = compare.metrics_side_by_side(score_tables(spark, sf_dir), key=[*KEY, "context", "model"])
    points = pair_lines(wide, _PAIRS, {"all": None, "excl_human": compare.not_human()}, keep=["model"])
    return points.withColumns({c: F.round(c, 6) for c in ("x", "y", "y_hat")})


@query(
    "q_metric_pair_labels",
    f"""with {SIDE_SQL}, pts as ({_POINTS}), {sqltext.fits('pts', 'x', 'y', ['scope', 'x_name', 'y_name'])}
    select scope, x_name, y_name, concat('$R=$', {sqltext.short_decimal('r', 4)}, ', $R^2=$', {sqltext.short_decimal('r2', 4)},
      chr(10), ' p=', {sqltext.short_decimal('p', 4)}) as label from fit""",
)
def metric_pair_labels(spark, sf_dir):
    wide = compare.metrics_side_by_side(score_tables(spark, sf_dir), key=[*KEY, "context", "model"])
    fits = pair_regressions(wide, _PAIRS, {"all": None, "excl_human": compare.not_human()})
    return fits.select("scope", "x_name", "y_name", report_label(digits=4, r2=True).alias("label"))


@query(
    "q_excl_human",
    f"with {COUNTS_SQL} select conv_id, turn, model from cnt where model is distinct from '{compare.HUMAN_MODEL}'",
)
def excl_human(spark, sf_dir):
    return last_examples(spark, sf_dir).where(compare.not_human()).select(*KEY, "model")


@query(
    "q_stacked_metrics",
    f"""with {SIDE_SQL} select conv_id, turn, 'length' as metric, round(length_score, 6) as score from side
    union all select conv_id, turn, 'length_context', round(length_context_score, 6) from side
    union all select conv_id, turn, 'overlap', round(overlap_score, 6) from side""",
)
def stacked_metrics(spark, sf_dir):
    stacked = compare.stack_metrics(score_tables(spark, sf_dir), keep=KEY)
    return stacked.withColumn("score", F.round("score", 6))


@query(
    "q_shape_audit",
    f"""with {SIDE_SQL} select 'length' as table_name, count(*) as n_rows, 10::bigint as n_cols from side
    union all select 'length_context', count(*), 10 from side union all select 'overlap', count(*), 10 from side
    union all select 'merged', count(*), 7 from side""",
)
def shape_audit(spark, sf_dir):
    tables = score_tables(spark, sf_dir)
    merged = compare.metrics_side_by_side(tables, key=[*KEY, "context", "model"])
    return compare.shape_audit({**tables, "merged": merged})


@query(
    "q_merge_audit",
    f"""with {SIDE_SQL} select 'length' as table_name, count(*) as n_rows, 10::bigint as n_cols from side
    union all select 'length_context', count(*), 10 from side union all select 'overlap', count(*), 10 from side
    union all select 'merged', count(*), 7 from side""",
)
def merge_audit(spark, sf_dir):
    return compare.merge_audited(score_tables(spark, sf_dir), key=[*KEY, "context", "model"])[1]


@query(
    "q_preview",
    f"with {COUNTS_SQL} select conv_id, turn, model, overall from cnt order by conv_id, turn limit 5",
)
def preview(spark, sf_dir):
    return compare.preview(last_examples(spark, sf_dir).select(*KEY, "model", "overall"), KEY)
