"""Round trips through text files."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialogmeter import schemas
from dialogmeter.operators.compare import with_row_index
from dialogmeter.operators.scoring import score
from dialogmeter.plans.workflows import preprocess, vote_table
from dialogmeter.queries import sqltext
from dialogmeter.queries.annotated import _NULL_SAFE, _REF, _usr_rows, usr_records
from dialogmeter.queries.registry import query
from dialogmeter.queries.scores import COUNTS_SQL, _BP_CTX
from dialogmeter.queries.views import EVALSET, KEY, catalog, examples
from dialogmeter.queries.votes import PARTS_SQL
from dialogmeter.session import new_scratch_path
from dialogmeter.sinks.tables import write_tsv
from dialogmeter.sources.tsv import CELL_TYPES, misfits, read_score_files, read_tsv, type_report, with_found_types
from pyspark.sql import types as T


@query(
    "q_tsv_roundtrip",
    f"with {_NULL_SAFE} {_usr_rows(_REF, 'cand', 'model')} union all {_usr_rows(_REF, sqltext.last_line('cand'), repr('short'))}",
)
def tsv_roundtrip(spark, sf_dir):
    source, target = new_scratch_path(spark, "usr"), new_scratch_path(spark, "usr-tsv")
    usr_records(spark, sf_dir).write.json(source)
    preprocess(spark, "usr", source, out=target)
    return read_tsv(spark, target, schemas.usr_table(), missing_words=False)


@query(
    "q_scored_tsv_roundtrip",
    f"""with {COUNTS_SQL} select row_number() over (order by conv_id, turn) - 1 as row_id, context, cand, model, overall,
    round({_BP_CTX}, 6) as score from cnt""",
)
def scored_tsv_roundtrip(spark, sf_dir):
    path = new_scratch_path(spark, "scored")
    scored = score(examples(spark, sf_dir), "bleu", "context_last")
    indexed = with_row_index(scored.select(*KEY, "context", "cand", "model", "overall", "score"), KEY)
    write_tsv(indexed.select("row_id", "context", "cand", "model", "overall", "score"), path)
    schema = T.StructType(
        [T.StructField("row_id", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("context", "cand", "model", "overall")]
        + [T.StructField("score", T.DoubleType())]
    )
    return read_tsv(spark, path, schema).withColumn("score", F.round("score", 6))


@query("q_win_table_roundtrip", f"with {PARTS_SQL} select * replace (round(win_ratio, 6) as win_ratio) from tab")
def win_table_roundtrip(spark, sf_dir):
    path = new_scratch_path(spark, "votes")
    vote_table(catalog(spark, sf_dir), EVALSET, out=path)
    return read_tsv(spark, path, schemas.votes_table()).withColumn("win_ratio", F.round("win_ratio", 6))


@query(
    "q_score_files",
    f"""with {COUNTS_SQL}
    select conv_id, turn, 'plain' as metric, round({_BP_CTX}, 6) as score from cnt
    union all select conv_id, turn, 'empty', round({sqltext.penalty('c', '0')}, 6) from cnt""",
)
def score_files(spark, sf_dir):
    table = examples(spark, sf_dir)
    paths = {"plain": new_scratch_path(spark, "plain"), "empty": new_scratch_path(spark, "empty")}
    for mode, name in (("context_last", "plain"), ("empty", "empty")):
        write_tsv(score(table, "bleu", mode, score_col="bp").select(*KEY, "bp"), paths[name])
    schema = T.StructType(
        [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("bp", T.DoubleType())]
    )
    tables = read_score_files(spark, paths, schema, score_col="bp")
    return tables["plain"].unionByName(tables["empty"]).withColumn("score", F.round("score", 6))


_CELLS = {
    "key": "cast(event_id as varchar)", "gap": "case when event_id % 5 = 0 then 'NA' else cast(user_id as varchar) end",
    "flag": "case when event_id % 2 = 0 then 'True' else 'False' end", "score": "concat(cast(event_id % 7 as varchar), '.5')",
    "mixed": "case when event_id % 1000 = 7 then 'n/k' else cast(event_id % 10 as varchar) end", "words": "event_type",
}


def _all_text(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(*[F.expr(sql.replace("varchar", "string")).alias(name) for name, sql in _CELLS.items()])


_COUNTS = " union all ".join(
    f"""select '{name}' as column_name, count(*) as n, count_if(c is null) as n_missing, {", ".join(
        f"count_if(c is not null and regexp_matches(c, {sqltext.literal(p)})) as n_{kind}" for kind, p in CELL_TYPES.items())}
    from (select case when {sql} = 'NA' then null else {sql} end as c from events)"""
    for name, sql in _CELLS.items()
)


@query(
    "q_type_report",
    f"""select *, case when n_missing = 0 and n_boolean = n then 'boolean' when n_missing = 0 and n_bigint = n then 'bigint'
      when n_double = n - n_missing then 'double' else 'string' end as type from ({_COUNTS})""",
)
def found_types(spark, sf_dir):
    return type_report(_all_text(spark, sf_dir))


@query(
    "q_type_misfits",
    f"""select 'mixed' as column_name, 'n/k' as cell, count(*) as n from events where event_id % 1000 = 7 having count(*) > 0
    union all select 'words', event_type, count(*) from events group by event_type""",
)
def cells_that_do_not_fit(spark, sf_dir):
    return misfits(_all_text(spark, sf_dir), {"key": "bigint", "gap": "double", "mixed": "double", "words": "double"})


@query(
    "q_found_types",
    f"""select {_CELLS['key']}::bigint as key, case when event_id % 5 = 0 then null else user_id::double end as gap, event_id % 2 = 0 as flag,
      (event_id % 7 + 0.5)::double as score, {_CELLS['mixed']} as mixed, event_type as words from events""",
)
def typed_columns(spark, sf_dir):
    path = new_scratch_path(spark, "typed")
    write_tsv(_all_text(spark, sf_dir), path)
    return with_found_types(read_tsv(spark, path, missing_words=False))
