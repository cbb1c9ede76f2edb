"""Annotated dialogues: nested records, text cleaning, ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmeter import schemas
from dialogmeter.functions import text
from dialogmeter.functions.ratings import parse_ratings
from dialogmeter.operators.annotations import long_form, median_table, quality_columns
from dialogmeter.operators.flatten import GROUND_TRUTH, explode_responses
from dialogmeter.plans.workflows import preprocess
from dialogmeter.queries import sqltext
from dialogmeter.queries.registry import query
from dialogmeter.queries.views import EXAMPLES_SQL, MEDIANS_SQL, QUALITIES, examples, last_examples
from dialogmeter.session import landed, new_scratch_path
from dialogmeter.sinks.tables import lists_as_text
from dialogmeter.sources.open_records import open_ratings, read_open_records


def _numbers(df_k: Column, size: Column, i: int) -> list[Column]:
    return [(df_k + i) % 3, (size + i) % 3, (df_k * 5 + i) % 3]


def _sql_numbers(i: int) -> str:
    return f"concat('[', (k+{i})%3, ', ', (length(cand)+{i})%3, ', ', (k*5+{i})%3, ']')"


def _k() -> Column:
    return F.col("conv_id") * 7 + F.col("turn") * 3


def usr_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per example: a reply, the ground truth if there is one, and a short reply."""
    size = F.length("cand")
    ratings = [
        F.array(*_numbers(_k(), size, i)).alias(q) for i, q in enumerate(schemas.USR_QUALITIES)
    ]

    def response(words: Column, model: Column) -> Column:
        return F.struct(words.alias("response"), model.alias("model"), *ratings)

    truth = F.when(F.col("ref").isNotNull(), response(F.concat(F.lit(' "'), F.col("ref"), F.lit('"\n')), F.lit(GROUND_TRUTH)))
    return examples(spark, sf_dir).select(
        F.concat(F.lit('\t"'), F.col("context"), F.lit('" \n')).alias("context"),
        F.concat(F.lit(' "persona" '), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit("\n")).alias("fact"),
        F.array_compact(
            F.array(
                response(F.col("cand"), F.col("model")),
                truth,
                response(text.last_line(F.col("cand")), F.lit("short")),
            )
        ).alias("responses"),
    )


def _through_json(records: DataFrame, dataset: str) -> DataFrame:
    """Write records as JSON lines into the shared folder and read them back as a source."""
    spark = records.sparkSession
    path = new_scratch_path(spark, dataset)
    records.write.json(path)
    return preprocess(spark, dataset, path)


_USR_SELECT = f"""
  select {sqltext.clean("chr(9) || chr(34) || context || chr(34) || ' ' || chr(10)")} as context,
    concat('persona ', conv_id, '-', turn) as fact,
    {{ref}} as ref, {{cand}} as cand, {{model}} as model,
    {", ".join(f"{_sql_numbers(i)} as {schemas.column_name(q)}" for i, q in enumerate(schemas.USR_QUALITIES))}
  from exk
"""
_REF = sqltext.clean("' ' || chr(34) || ref || chr(34) || chr(10)")
_NULL_SAFE = EXAMPLES_SQL + """,
exk as (select *, conv_id*7 + turn*3 as k from ex)
"""


def _usr_rows(ref: str, cand: str, model: str) -> str:
    return _USR_SELECT.format(ref=ref, cand=cand, model=model)


@query(
    "q_flatten_responses",
    f"with {_NULL_SAFE} {_usr_rows(_REF, 'cand', 'model')} union all {_usr_rows(_REF, sqltext.last_line('cand'), repr('short'))}",
)
def flatten_responses(spark, sf_dir):
    return lists_as_text(_through_json(usr_records(spark, sf_dir), "usr"))


@query(
    "q_ref_carry_forward",
    f"""with {EXAMPLES_SQL}
    select concat('persona ', conv_id, '-', turn) as fact, 0::bigint as position, null as ref, cand from ex
    union all
    select concat('persona ', conv_id, '-', turn), case when ref is null then 1 else 2 end,
      {_REF}, {sqltext.last_line('cand')} from ex""",
)
def ref_carry_forward(spark, sf_dir):
    rows = explode_responses(usr_records(spark, sf_dir), reference="preceding")
    return rows.select(
        text.clean_text(F.col("fact")).alias("fact"), F.col("position").cast("bigint").alias("position"),
        text.clean_text(F.col("ref")).alias("ref"), F.col("r.response").alias("cand"),
    )


@query(
    "q_flatten_static",
    f"""with {_NULL_SAFE}
    select {sqltext.clean("context")} as context, cand, {sqltext.clean("chr(34) || model || chr(34)")} as model,
      {", ".join(f"{_sql_numbers(i)} as {schemas.column_name(q)}" for i, q in enumerate(schemas.STATIC_QUALITIES))}
    from exk""",
)
def flatten_static(spark, sf_dir):
    size = F.length("cand")
    records = examples(spark, sf_dir).select(
        F.col("context").alias("dialog_history"), F.col("cand").alias("dialog_response"),
        F.concat(F.lit('"'), F.col("model"), F.lit('"')).alias("system"),
        *[F.array(*_numbers(_k(), size, i)).alias(q) for i, q in enumerate(schemas.STATIC_QUALITIES)],
    )
    return lists_as_text(_through_json(records, "static_data"))


def fed_records(spark: SparkSession, sf_dir: str, labels: list[str]) -> DataFrame:
    """Records whose ``response`` key is missing where the dialogue ends; lists hold text."""
    size = F.length("cand")
    answers = [
        F.array(*[v.cast("string") for v in _numbers(_k(), size, i)], F.lit("N/A (no, sorry)")).alias(q)
        for i, q in enumerate(labels)
    ]
    reply = F.concat(F.col("model"), F.lit(": "), F.col("cand"))
    return examples(spark, sf_dir).select(
        F.col("context"), F.when(F.col("ref").isNotNull(), reply).alias("response"), F.col("model").alias("system"),
        F.struct(*answers).alias("annotations"),
    )


def _sql_answers(labels: list[str]) -> str:
    return ", ".join(
        f"concat('[', (k+{i})%3, ', ', (length(cand)+{i})%3, ', ', (k*5+{i})%3, ', N/A (no, sorry)]') as {schemas.column_name(q)}"
        for i, q in enumerate(labels)
    )


@query(
    "q_has_response",
    f"""with {_NULL_SAFE}
    select {sqltext.clean("context")} as context, string_split(model || ': ' || cand, ':')[-1] as cand, model,
      {_sql_answers(schemas.FED_TURN_QUALITIES)} from exk where ref is not null""",
)
def has_response(spark, sf_dir):
    return lists_as_text(_through_json(fed_records(spark, sf_dir, schemas.FED_TURN_QUALITIES), "fed_referenced"))


@query(
    "q_no_response",
    f"""with {_NULL_SAFE}
    select {sqltext.clean("context")} as context, model,
      {_sql_answers(schemas.FED_DIALOG_QUALITIES)} from exk where ref is null""",
)
def no_response(spark, sf_dir):
    return lists_as_text(_through_json(fed_records(spark, sf_dir, schemas.FED_DIALOG_QUALITIES), "fed_unreferenced"))


@query(
    "q_clean_text",
    f"""select doc_id, {sqltext.clean("concat(' ', chr(160), chr(34), text, chr(34), chr(10), chr(9))")} as cleaned from documents""",
)
def clean_text(spark, sf_dir):
    padded = F.concat(F.lit(' \xa0"'), F.col("text"), F.lit('"\n\t'))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.clean_text(padded).alias("cleaned"))


@query("q_last_colon", "select page_id, string_split(url, ':')[-1] as tail, string_split(html, ':')[-1] as body_tail from pages")
def last_colon(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", text.after_last_colon(F.col("url")).alias("tail"), text.after_last_colon(F.col("html")).alias("body_tail")
    )


@query("q_context_last", f"with {EXAMPLES_SQL} select conv_id, turn, {sqltext.last_line('context')} as ctx_last from ex")
def context_last(spark, sf_dir):
    return last_examples(spark, sf_dir).select("conv_id", "turn", text.last_line(F.col("context")).alias("ctx_last"))


@query(
    "q_esl_trim",
    f"select doc_id, substr({sqltext.last_line('text')}, 3) as trimmed, text as untouched from documents",
)
def esl_trim(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        text.trim_prompt(F.col("text"), text.SPEAKER_TAGGED_SET).alias("trimmed"),
        text.trim_prompt(F.col("text"), "NCM").alias("untouched"),
    )


@query("q_null_as_text", f"with {EXAMPLES_SQL} select conv_id, turn, coalesce(ref, 'nan') as ref_text from ex")
def null_as_text(spark, sf_dir):
    return last_examples(spark, sf_dir).select("conv_id", "turn", text.missing_as_text(F.col("ref")).alias("ref_text"))


@query(
    "q_na_tokens",
    f"""with cells as (select event_id, case when event_type = 'error' then 'NA' when event_type = 'view' then ''
        when event_type = 'click' then 'NaN' else event_type end as cell, value / nullif(event_id % 4, 0) as number from events)
    select event_id, case when cell in ({", ".join(sqltext.literal(t) for t in text.NA_TOKENS)}) then null else cell end as cell,
      round(number, 6) as number from cells""",
)
def na_tokens(spark, sf_dir):
    from dialogmeter.sources.tsv import clean_missing

    e = F.col("event_type")
    cell = F.when(e == "error", "NA").when(e == "view", "").when(e == "click", "NaN").otherwise(e)
    number = F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value") / (F.col("event_id") % 4))
    cells = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", cell.alias("cell"), number.alias("number"))
    return clean_missing(cells).withColumn("number", F.round("number", 6))


@query(
    "q_parse_ratings",
    f"""with {EXAMPLES_SQL}
    select conv_id, turn, array_to_string(list_filter(
      string_split(substr(overall, 2, length(overall) - 2), ', '), lambda t: regexp_full_match(t, '[0-9]+')), ';') as parsed
    from ex""",
)
def parsed_ratings(spark, sf_dir):
    return last_examples(spark, sf_dir).select(
        "conv_id", "turn", F.array_join(parse_ratings(F.col("overall")).cast("array<bigint>").cast("array<string>"), ";").alias("parsed")
    )


@query("q_median_ratings", f"with {MEDIANS_SQL} select conv_id, turn, {', '.join(QUALITIES)} from med")
def median_ratings(spark, sf_dir):
    return median_table(last_examples(spark, sf_dir), QUALITIES, keep=["conv_id", "turn"])


@query(
    "q_scalar_ratings",
    """select doc_id, cast(quality as double) as quality, cast(toxic as double) as toxic,
      cast(quality + toxic as double) as text_cell from labels""",
)
def scalar_ratings(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    cells = labels.withColumn("text_cell", (F.col("quality") + F.col("toxic")).cast("string"))
    return median_table(cells, ["quality", "toxic", "text_cell"], keep=["doc_id"])


@query(
    "q_quality_long",
    f"""with {MEDIANS_SQL}
    {" union all ".join(f"select conv_id, turn, '{q}' as quality, {q} as rating from med" for q in QUALITIES)}""",
)
def quality_long(spark, sf_dir):
    # The last column plays the score, so the qualities are found by position.
    rows = last_examples(spark, sf_dir).withColumn("score", F.lit(1.0))
    qualities = quality_columns(rows.columns)
    medians = median_table(rows, qualities, keep=["conv_id", "turn"])
    return long_form(medians, qualities, keep=["conv_id", "turn"])


# Which labels an answer has depends on its dialogue; no schema names them.
_OPEN = [f"label {i}" for i in range(4)]


@query(
    "q_open_ratings",
    f"""with {EXAMPLES_SQL}, exk as (select *, conv_id*7 + turn*3 as k from ex), long as (
      {" union all ".join(f"select conv_id, turn, {i}::int as i, [(k+{i})%3, (length(cand)+{i})%3, (k*5+{i})%3] as v from exk" for i in range(len(_OPEN)))})
    select concat(conv_id, '-', turn) as example, answer::bigint as answer, concat('label ', i) as quality, list_aggregate(v, 'median')::double as median
    from long, (select unnest([0, 1]) as answer) where (conv_id + answer + i) % 3 <> 0""",
)
def open_labels(spark, sf_dir):
    size = F.length("cand")
    rows = landed(last_examples(spark, sf_dir), "examples")
    answers = []
    for answer in (0, 1):
        cells = [
            F.when((F.col("conv_id") + answer + i) % 3 != 0, F.to_json(F.array(*_numbers(_k(), size, i)))).alias(q)
            for i, q in enumerate(_OPEN)
        ]
        fields = [F.concat(F.lit(f'"{q}": '), c) for q, c in zip(_OPEN, cells, strict=True)]
        answers.append(F.concat(F.lit('{"response": "x", "score": 1, '), F.concat_ws(", ", *fields), F.lit("}")))
    record = F.concat(F.lit('{"id": "'), F.concat_ws("-", "conv_id", "turn"), F.lit('", "answers": ['), F.concat_ws(", ", *answers), F.lit("]}"))
    path = new_scratch_path(spark, "open")
    rows.select(record.alias("value")).write.text(path)
    rated = open_ratings(read_open_records(spark, path), "$.answers", {"example": "$.id"})
    return rated.select("example", "answer", "quality", "median")
