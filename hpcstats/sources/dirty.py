"""Dirty variants of the two shared views: NULLs, infinities, bad ids, numbers as text, lists of several items.

The shared tables are clean, so the rules and the NULL paths would pass
unseen.  Each column is spoiled by an expression on the row's own id; the
expressions are SQL that Spark and DuckDB both read, so both engines check the
same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hpcstats.sources.shared_tables import host_view, job_view, with_views

HOST_DIRTY = {
    "event_id": "event_id",
    "time": "time",
    "host": "case when event_id % 7 = 0 then null when event_id % 11 = 0 then 'NODE' when event_id % 12 = 1 then host || ', node7 ,NODE8' "
            "when event_id % 13 = 2 then host || ',rack1' else host end",
    "jid": "case when event_id % 17 = 0 then 'JOB' || jid when event_id % 5 = 1 then ' ' || lower(jid) || ' , JOB12' else jid end",
    "event": "case when event_id % 19 = 0 then upper(event) when event_id % 23 = 0 then null else event end",
    "unit": "case when event_id % 29 = 0 then unit || ' ' else unit end",
    "value": "case when event_id % 31 = 0 then 'n/a' when event_id % 37 = 0 then '1_0' when event_id % 41 = 0 then '1__0' "
             "when event_id % 43 = 0 then ' -.5e3 ' when event_id % 47 = 0 then 'Infinity' when event_id % 53 = 0 then null "
             "when event_id % 59 = 0 then '5.' else '12.5' end",
}

JOB_DIRTY = {
    "jid": "case when nhosts % 16 = 3 then replace(jid, 'JOB', 'JOb') || ',JOB 5' when ngpus > 0 then jid || ' ,job77' else jid end",
    "ncores": "case when nhosts = 5 then cast(ncores as string) || 'x' when nhosts = 6 then '1_000' when nhosts = 7 then '1_000_' else cast(ncores as string) end",
    "ngpus": "case when nhosts = 8 then '' when nhosts = 9 then ' 4 ' else cast(ngpus as string) end",
    "nhosts": "case when nhosts = 10 then 'one' when nhosts = 11 then null when nhosts = 12 then '1e2' else cast(nhosts as string) end",
    "timelimit": "case when nhosts = 13 then '1.2.3' when nhosts = 14 then 'nan' else '345600.0' end",
    "account": "case when account = 'GROUP3' then 'GROUP' when account = 'GROUP4' then 'group4,GROUP5' when account = 'GROUP6' then null else account end",
    "username": "case when account = 'GROUP7' then username || ',' when account = 'GROUP8' then username || ', ' || username else username end",
    "host_list": "case when nhosts = 2 then host_list || ' , NODE2,node3' when nhosts = 4 then host_list || ',NODE4;NODE5' "
                 "when nhosts = 15 then '' else host_list end",
    "jobname": "case when jobname = 'JOBNAME13' then 'NAME13' when jobname = 'JOBNAME14' then 'jobname14 , JOBNAME15' else jobname end",
    "queue": "case when nhosts = 1 then upper(queue) else queue end",
    "exitcode": "case when nhosts = 16 then 'DONE' when account = 'GROUP9' then null else exitcode end",
}


def host_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_view(spark, sf_dir).select(*[F.expr(e).alias(c) for c, e in HOST_DIRTY.items()])


def job_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_view(spark, sf_dir).select(*[F.expr(e).alias(c) for c, e in JOB_DIRTY.items()])


# samples whose values, hosts and a long column of more than 53 bits are sometimes missing, and values infinite
SAMPLES_DIRTY = {
    "event_id": "event_id",
    "time": "time",
    "event": "event",
    "host": "case when event_id % 7 = 0 then null else host end",
    "value": "case when event_id % 5 = 0 then null when event_id % 13 = 0 then cast('Infinity' as double) "
             "when event_id % 17 = 0 then cast('-Infinity' as double) else value end",
    "big": "case when event_id % 9 = 0 then null else event_id + 9007199254740992 end",  # a long in the frames
}


def samples_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_view(spark, sf_dir).select(*[F.expr(e).alias(c) for c, e in SAMPLES_DIRTY.items()])


def with_dirty_views(body: str) -> str:
    """Prefix a query on host_dirty/job_dirty/samples_dirty with the derivations."""
    views = {"host_dirty": ("host_data", HOST_DIRTY), "job_dirty": ("job_data", JOB_DIRTY), "samples_dirty": ("host_data", SAMPLES_DIRTY)}
    parts = [f"{name} as (select {', '.join(f'{e} as {c}' for c, e in columns.items())} from {table})" for name, (table, columns) in views.items()]
    return with_views(", " + ",\n".join(parts) + "\n" + body)
