"""Column rules and text functions, with the value lists of the original tests."""

import pytest
from pyspark.sql import functions as F

from hpcstats.functions.rules import MESSAGES, host_rules, job_rules
from hpcstats.functions.text import clean_text, split_trim
from hpcstats.operators.quality import audit, passing, quarantine

CASES = {
    "jid": (["JOB123", "JOB1", "JOB45678", "JOB123, JOB456, JOB789"],
            ["JOB", "JOBABC", "123JOB", "JOB1234A", "JOB123, ABC, JOB789"]),
    "account": (["GROUP123", "GROUP1", "group7"], ["GROUP", "GROUPABC", "123GROUP", "GROUP1234A"]),
    "username": (["USER123", "USER1"], ["USER", "USERABC", "123USER", "USER1234A"]),
    "host_list": (["NODE123", "NODE1, node2"], ["NODE", "NODEABC", "123NODE", "NODE1234A"]),
    "jobname": (["JOBNAME123"], ["JOBNAME", "JOBNAMEABC", "123JOBNAME", "JOBNAME1234A"]),
    "ncores": (["123", "0.456", "78.90", "-123.45", " 5 ", "1e5", "1_000", "nan", "inf", "-Infinity", ".5", "5."],
               ["ABC", "123ABC", "78.90.123", "1__0", "_1", "1_", "", "."]),
}


@pytest.mark.parametrize("column", list(CASES))
def test_job_rule_values(spark, column):
    good, bad = CASES[column]
    rule = [r for r in job_rules() if r.column == column][0]
    df = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad], f"{column} string, ok boolean")
    got = df.select("ok", rule.check.alias("pass")).collect()
    assert all(r["ok"] == r["pass"] for r in got), [(r["ok"], r["pass"]) for r in got]


HOST_CASES = {
    "event": (["cpuuser", "block", "memused", "memused_minus_diskcache", "gpu_usage", "nfs"],
              ["cpu", "memory", "gpu", "network", "CPUUSER", " nfs"]),
    "unit": (["CPU %", "GPU %", "GB:memused", "GB:memused_minus_diskcache", "GB/s", "MB/s"],
             ["CPU", "GPU", "GB", "MB", "GB:mem", "MB/speed"]),
    "value": (["123", "1.23", "-123", "-1.23", "0.0", "0"], ["abc", "123a", "1..23", "--123", "1/2", "2*3"]),
    "host": (["NODE123", "NODE1"], ["NODE", "NODEABC", "123NODE", "NODE1234A", "NODE١"]),
}


@pytest.mark.parametrize("column", list(HOST_CASES))
def test_host_rule_values(spark, column):
    good, bad = HOST_CASES[column]
    rule = [r for r in host_rules() if r.column == column][0]
    df = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad], f"{column} string, ok boolean")
    got = df.select("ok", rule.check.alias("pass")).collect()
    assert all(r["ok"] == r["pass"] for r in got)


def test_null_passes_and_messages(spark):
    df = spark.createDataFrame([(None,)], "jid string")
    rule = job_rules(columns=["jid"])[0]
    assert df.select(rule.check).first()[0] is True
    assert rule.message == MESSAGES["jid"]


def test_audit_quarantine(spark):
    df = spark.createDataFrame([("JOB1", "GROUP1"), ("JOBX", "GROUP2"), ("JOB3", "G3")], "jid string, account string")
    rules = job_rules()
    a = {r["rule"]: r["n_failed"] for r in audit(df, rules).collect()}
    assert a == {"jid_format": 1, "account_format": 1}
    q = {r["jid"]: r["failed_rules"] for r in quarantine(df, rules).collect()}
    assert q == {"JOBX": ["jid_format"], "JOB3": ["account_format"]}
    assert [r["jid"] for r in passing(df, rules).collect()] == ["JOB1"]


def test_clean_text_and_split(spark):
    df = spark.createDataFrame([("This is a test, 123.",), ("",), ("!@#$%^&*()",)], "s string")
    assert [r[0] for r in df.select(clean_text("s")).collect()] == ["Thisisatest,123", "", ""]
    got = spark.createDataFrame([(" a, b ,c\t",)], "s string").select(split_trim("s")).first()[0]
    assert got == ["a", "b", "c"]


def test_prefix_rule_ascii_digits_only(spark):
    rule = [r for r in host_rules() if r.column == "host"][0]
    df = spark.createDataFrame([("NODE٣",)], "host string")
    assert df.select(rule.check).first()[0] is False


def test_queue_exitcode_choices(spark):
    rules = job_rules(with_choices=True, columns=["queue", "exitcode"])
    df = spark.createDataFrame([("gpu-debug", "NODE_FAIL"), ("fast", "OK")], "queue string, exitcode string")
    got = {r["rule"]: r["n_failed"] for r in audit(df, rules).collect()}
    assert got == {"queue_choice": 1, "exitcode_choice": 1}


def test_python_whitespace_and_case_rules(spark):
    """str.strip()/float() remove Unicode whitespace; upper() maps the long s to S."""
    jid = [r for r in job_rules() if r.column == "jid"][0]
    user = [r for r in job_rules() if r.column == "username"][0]
    num = [r for r in job_rules() if r.column == "ncores"][0]
    df = spark.createDataFrame([("\u00a0JOB1\u2003, job2", "u\u017fer5", "\u30001.5\u00a0")],
                               "jid string, username string, ncores string")
    r = df.select(jid.check.alias("a"), user.check.alias("b"), num.check.alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (True, True, True)
    assert float("\u30001.5\u00a0") == 1.5 and "u\u017fer5".upper() == "USER5"
