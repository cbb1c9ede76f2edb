"""Dialogue, vote and catalogue tables derived from the shared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmeter.operators.compare import HUMAN_MODEL
from dialogmeter.operators.dialogs import reply_examples
from dialogmeter.operators.pairwise import Catalog

QUALITIES = ["understandable", "engaging", "overall"]
KEY = ["conv_id", "turn"]
EVALSET = "ASIA"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cell(*values: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", *[v.cast("string") for v in values]), F.lit("]"))


def rated(examples: DataFrame) -> DataFrame:
    """Add a model name and three list ratings, some of them without an answer."""
    k = F.col("conv_id") * 7 + F.col("turn") * 3
    size = F.length("cand")
    model = F.when(k % 5 == 0, F.lit(HUMAN_MODEL)).otherwise(F.concat(F.lit("m"), (F.col("conv_id") % 4).cast("string")))
    overall = (
        F.when(k % 13 == 0, F.lit("[N/A]"))
        .when(k % 11 == 0, _cell(F.lit("'N/A (cannot tell, sorry)'"), 1 + size % 5, F.lit(4)))
        .otherwise(_cell(1 + size % 5, 1 + k % 5, 1 + (k * k) % 5))
    )
    return examples.select(
        *KEY, "context", "ref", "cand", model.alias("model"),
        _cell(k % 2, (k + 1) % 2, size % 2).alias("understandable"),
        _cell(1 + k % 3, 1 + size % 3, 1 + (k * 5 + 2) % 3).alias("engaging"),
        overall.alias("overall"),
    )


def examples(spark: SparkSession, sf_dir: str, context: str = "whole") -> DataFrame:
    return rated(reply_examples(table(spark, sf_dir, "conversations"), context=context))


def last_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples whose context is the last turn, for queries that look at no more of it than its last line."""
    return examples(spark, sf_dir, context="last")


EXAMPLES_SQL = f"""
history as (
  select c.conv_id, c.turn, string_agg(p.text, chr(10) order by p.turn) as context
  from conversations c join conversations p
    on p.conv_id = c.conv_id and p.turn < c.turn
  where c.role = 'assistant' group by c.conv_id, c.turn),
plain as (
  select h.conv_id, h.turn, h.context, n.text as ref, c.text as cand, h.conv_id*7 + h.turn*3 as k
  from history h
  join conversations c on c.conv_id = h.conv_id and c.turn = h.turn
  left join conversations n on n.conv_id = h.conv_id and n.turn = h.turn + 1),
ex as (
  select conv_id, turn, context, ref, cand,
    case when k % 5 = 0 then '{HUMAN_MODEL}' else concat('m', conv_id % 4) end as model,
    concat('[', k%2, ', ', (k+1)%2, ', ', length(cand)%2, ']') as understandable,
    concat('[', 1+k%3, ', ', 1+length(cand)%3, ', ', 1+(k*5+2)%3, ']') as engaging,
    case when k % 13 = 0 then '[N/A]'
         when k % 11 = 0 then concat('[''N/A (cannot tell, sorry)'', ', 1+length(cand)%5, ', 4]')
         else concat('[', 1+length(cand)%5, ', ', 1+k%5, ', ', 1+(k*k)%5, ']') end as overall
  from plain)
"""


def sql_median(cell: str) -> str:
    """Median of a bracketed list cell."""
    parts = f"list_filter(string_split(substr({cell}, 2, length({cell}) - 2), ', '), lambda t: regexp_full_match(t, '[0-9]+'))"
    return f"list_aggregate(list_transform({parts}, lambda t: cast(t as bigint)), 'median')"


MEDIANS_SQL = EXAMPLES_SQL + f""",
med as (select conv_id, turn, model, context, ref, cand,
  {", ".join(f"{sql_median(q)} as {q}" for q in QUALITIES)} from ex)
"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A/B votes: 0 = first model, 1 = second, 2 = tie, null = no answer."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        (e % 500).alias("prompt_id"),
        (F.col("user_id") % 10).alias("model_1"),
        ((F.col("user_id") + 1 + e % 4) % 10).alias("model_2"),
        F.when(F.col("event_type") != "error", e % 3).alias("value"),
        (e % 7).alias("mturk_run_id_id"),
    )


VOTES_SQL = """
ab_comparison as (
  select event_id % 500 as prompt_id, user_id % 10 as model_1, (user_id + 1 + event_id % 4) % 10 as model_2,
    case when event_type = 'error' then null else event_id % 3 end as value, event_id % 7 as mturk_run_id_id
  from events)
"""


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    def read(name: str) -> DataFrame:
        return table(spark, sf_dir, name)

    def number(name: str) -> Column:
        return F.col(name).cast("bigint")

    return Catalog(
        evaluation_dataset=read("region").select(number("r_regionkey").alias("evalset_id"), F.col("r_name").alias("name")),
        dataset_text=read("customer").select(
            F.col("c_custkey").alias("prompt_id"),
            F.concat(F.col("c_mktsegment"), F.lit("\nA:"), F.col("c_name")).alias("prompt_text"),
            (F.col("c_custkey") % 5).alias("evaluationdataset_id"),
        ),
        model=read("nation").select(
            number("n_nationkey").alias("model_id"), F.col("n_name").alias("name"),
            (number("n_nationkey") % 5).alias("is_baseline"),
        ),
        baselines=read("nation").select(
            number("n_nationkey").alias("model_id"), number("n_regionkey").alias("evaluationdataset_id")
        ),
        model_response=read("orders").select(
            F.col("o_custkey").alias("prompt_id"), (F.col("o_orderkey") % 25).alias("model_id"),
            (F.col("o_custkey") % 5).alias("evaluationdataset_id"), F.col("o_orderpriority").alias("response_text"),
        ),
        ab_comparison=votes(spark, sf_dir),
        evaluation_run=votes(spark, sf_dir).select(F.col("mturk_run_id_id").alias("mturk_run_id")).distinct(),
    )


CATALOG_SQL = VOTES_SQL + """,
evaluation_run as (select distinct mturk_run_id_id as mturk_run_id from ab_comparison),
evaluation_dataset as (select cast(r_regionkey as bigint) as evalset_id, r_name as name from region),
dataset_text as (
  select c_custkey as prompt_id, concat(c_mktsegment, chr(10), 'A:', c_name) as prompt_text,
    c_custkey % 5 as evaluationdataset_id from customer),
model as (
  select cast(n_nationkey as bigint) as model_id, n_name as name, cast(n_nationkey as bigint) % 5 as is_baseline from nation),
baselines as (
  select cast(n_nationkey as bigint) as model_id, cast(n_regionkey as bigint) as evaluationdataset_id from nation),
model_response as (
  select o_custkey as prompt_id, o_orderkey % 25 as model_id, o_custkey % 5 as evaluationdataset_id,
    o_orderpriority as response_text from orders)
"""
