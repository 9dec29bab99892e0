"""Column rules of the two tables.

Each rule is a boolean Column: TRUE = the value passes.  A NULL value passes
(there is nothing to check); the rules check form, not presence.  The
messages are the ones the original validators print.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from hpcstats.functions.text import WS, strip_ws
from hpcstats.schema import EVENTS, EXITCODES, QUEUES, UNITS

# Python float() syntax, underscores between digits taken out before: digits, optional fraction and
# exponent, or inf/infinity/nan; optional sign; outer whitespace.  No group repeats, so the regular
# expression takes a text of any length without recursion.
FLOAT_PATTERN = (
    f"^{WS}*[+-]?(?:(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan)){WS}*$"
)
MISPLACED_UNDERSCORE = "(?<![0-9])_|_(?![0-9])"

# Rule messages, and that of the numeric columns.
NUMERIC_MESSAGE = "Error: For '{}', value must be a number (including decimals)."
MESSAGES = {
    "jid": "Error: For 'jid', value must be a comma-separated list of strings starting with 'JOB' "
           "followed by one or more digits.",
    "account": "Error: For 'account', value must be a comma-separated list of strings starting with "
               "'GROUP' followed by one or more digits.",
    "username": "Error: For 'username', value must be a comma-separated list of strings starting with "
                "'USER' followed by one or more digits.",
    "host_list": "Error: For 'host_list', value must be a comma-separated list of strings starting with "
                 "'NODE' followed by one or more digits.",
    "jobname": "Error: For job name, value must be a comma-separated list of strings starting with "
               "'JOBNAME' followed by one or more digits.",
    "host": "Error: For 'host', value must be a comma-separated list of strings starting with 'NODE' "
            "followed by one or more digits.",
    "event": "Error: For 'event', value must be one of: cpuuser, block, memused, memused_minus_diskcache, "
             "gpu_usage, nfs.",
    "unit": "Error: For 'unit', value must be one of: 'CPU %', 'GPU %', 'GB:memused', "
            "'GB:memused_minus_diskcache', 'GB/s', 'MB/s'.",
    "value": "Error: For 'value', the value must be a number.",
}


def numeric_message(column: str) -> str:
    return NUMERIC_MESSAGE.format(column)


@dataclass(frozen=True)
class Rule:
    name: str
    column: str
    message: str
    check: Column


def prefixed_list(col: str, prefix: str) -> Column:
    """V1-V6: every comma-separated item, trimmed and upper-cased, is PREFIX<digits>.

    A list of one item, as nearly all are, is one regular expression; longer ones are checked item by item, as an
    expression over the whole list would recurse once per item.
    """
    text = F.col(col).cast("string")
    items = F.transform(F.split(text, ","), lambda x: F.upper(strip_ws(x)))
    several = F.forall(items, lambda x: x.rlike(f"^{prefix}[0-9]+$"))
    return F.when(F.contains(text, F.lit(",")), several).otherwise(F.upper(text).rlike(f"^{WS}*{prefix}[0-9]+{WS}*$"))


def numeric_text(col: str) -> Column:
    """V7/V8: the text form parses as a Python float (numbers pass as they are)."""
    text = F.col(col).cast("string")
    return F.replace(text, F.lit("_"), F.lit("")).rlike(FLOAT_PATTERN) & ~text.rlike(MISPLACED_UNDERSCORE)


def one_of(col: str, values: list[str]) -> Column:
    """Exact (case-sensitive, untrimmed) membership."""
    return F.col(col).isin(values)


def _rule(name, column, message, check) -> Rule:
    return Rule(name, column, message, F.coalesce(check, F.lit(True)))


def job_rules(columns=None, with_choices: bool = False) -> list[Rule]:
    """V11 (+V13 when ``with_choices``): rules of the job table."""
    rules = [
        _rule("jid_format", "jid", MESSAGES["jid"], prefixed_list("jid", "JOB")),
        *[_rule(f"{c}_numeric", c, numeric_message(c), numeric_text(c))
          for c in ("ncores", "ngpus", "nhosts", "timelimit")],
        _rule("account_format", "account", MESSAGES["account"], prefixed_list("account", "GROUP")),
        _rule("username_format", "username", MESSAGES["username"], prefixed_list("username", "USER")),
        _rule("host_list_format", "host_list", MESSAGES["host_list"], prefixed_list("host_list", "NODE")),
        _rule("jobname_format", "jobname", MESSAGES["jobname"], prefixed_list("jobname", "JOBNAME")),
    ]
    if with_choices:
        rules += [_rule("queue_choice", "queue", "queue must be one of: " + ", ".join(QUEUES), one_of("queue", QUEUES)),
                  _rule("exitcode_choice", "exitcode", "exitcode must be one of: " + ", ".join(EXITCODES),
                        one_of("exitcode", EXITCODES))]
    return [r for r in rules if columns is None or r.column in columns]


def host_rules(columns=None) -> list[Rule]:
    """Rules of the host table."""
    rules = [
        _rule("event_choice", "event", MESSAGES["event"], one_of("event", EVENTS)),
        _rule("host_format", "host", MESSAGES["host"], prefixed_list("host", "NODE")),
        _rule("jid_format", "jid", MESSAGES["jid"], prefixed_list("jid", "JOB")),
        _rule("unit_choice", "unit", MESSAGES["unit"], one_of("unit", UNITS)),
        _rule("value_numeric", "value", MESSAGES["value"], numeric_text("value")),
    ]
    return [r for r in rules if columns is None or r.column in columns]
