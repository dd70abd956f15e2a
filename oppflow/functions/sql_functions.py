"""The scalar functions under SQL names: temporary functions whose bodies are built-in expressions.

``register_functions(spark)`` makes them known to a session; ``spark.sql`` can then call
``opp_normalize_role(title)`` and the others.  A body is the SQL text of the column that the function of
the same name builds, so the optimizer sees the same expressions as from the DataFrame side: nothing
runs in Python, and filters over a call are pushed and folded as usual.

Text is needed because a temporary function is declared in SQL.  Spark writes operators in front of
their arguments there (``=(a, b)``); such a name is put in backquotes, which SQL takes as a call of the
function of that name.  This reads the column through the classic session, not through Connect.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from oppflow.functions import classify as C
from oppflow.functions import text as T

PREFIX = "opp_"

#: Name: (function from columns to a column, types of its arguments, type of its result).
FUNCTIONS: dict[str, tuple[Callable[..., Column], list[str], str]] = {
    "parse_score": (T.parse_score, ["string"], "double"),
    "parse_int": (T.parse_int, ["string"], "bigint"),
    "truncate_60": (lambda a: T.truncate(a, 60), ["string"], "string"),
    "split_row": (T.split_row, ["string"], "array<string>"),
    "effective_applied_date": (T.effective_applied_date, ["string", "date"], "date"),
    "posted_date": (T.posted_date, ["string"], "date"),
    "to_posted_date": (T.to_posted_date, ["string"], "date"),
    "iso_week": (T.iso_week, ["date"], "string"),
    "report_num": (T.report_num, ["string"], "bigint"),
    "report_target": (T.report_target, ["string"], "string"),
    "linkedin_job_id": (T.linkedin_job_id, ["string"], "string"),
    "dedup_keys": (T.dedup_keys, ["string"], "array<string>"),
    "url_key": (T.url_key, ["string"], "string"),
    "role_key": (T.role_key, ["string", "string"], "string"),
    "company_key": (T.company_key, ["string"], "string"),
    "company_base": (T.company_base, ["string"], "string"),
    "normalize_role": (T.normalize_role, ["string"], "string"),
    "group_title": (T.group_title, ["string"], "string"),
    "opening_key": (T.opening_key, ["string", "string"], "string"),
    "role_tokens": (T.role_tokens, ["string"], "array<string>"),
    "role_fuzzy_match": (T.role_fuzzy_match, ["string", "string"], "boolean"),
    "role_overlap_match": (T.role_overlap_match, ["string", "string"], "boolean"),
    "normalize_location": (T.normalize_location, ["string"], "string"),
    "extract_contacts": (T.extract_contacts, ["string"], "array<struct<email:string,name:string>>"),
    "decode_entities": (T.decode_entities, ["string"], "string"),
    "ats_normalize": (T.ats_normalize, ["string"], "string"),
    "normalize_status": (C.normalize_status, ["string"], "string"),
    "classify_outcome": (C.classify_outcome, ["string"], "string"),
    "classify_remote": (C.classify_remote, ["string"], "string"),
    "classify_company_size": (C.classify_company_size, ["string"], "string"),
    "detect_lanes": (C.detect_lanes, ["string"], "array<string>"),
    "is_agency": (C.is_agency, ["string"], "boolean"),
    "resolve_tier": (
        C.resolve_tier, ["string"],
        "struct<tier:string,score:double,country:string,reason:string,keep:boolean>",
    ),
}

_QUOTED = re.compile(r"('(?:[^'\\]|\\.)*')", re.S)
_OPERATOR = re.compile(r"(?<![\w`])(<=>|<=|>=|!=|==|=|<|>|\+|-|\*|/|%|!|&|\||and|or|not|in)\(")


def sql_text(column: Column) -> str:
    """The column as text that ``spark.sql`` reads back."""
    parts = _QUOTED.split(column._jc.node().sql())
    return "".join(
        part if at % 2 else _OPERATOR.sub(r"`\1`(", part) for at, part in enumerate(parts)
    )


def register_functions(spark: SparkSession, prefix: str = PREFIX, functions: dict | None = None) -> list[str]:
    """Declare the functions in the session and return their names; a second call replaces them.

    ``functions`` has the form of ``FUNCTIONS``, so that a caller's lists (tiers, lanes, cities)
    can be bound to names of their own.
    """
    names = []
    for name, (build, types, result) in (FUNCTIONS if functions is None else functions).items():
        arguments = [f"arg{i}" for i in range(len(types))]
        body = sql_text(build(*[F.col(a) for a in arguments]))
        declared = ", ".join(f"{a} {t}" for a, t in zip(arguments, types))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({declared}) RETURNS {result} RETURN {body}")
        names.append(prefix + name)
    return names
