"""Columns of the functions of rowwise.py, by Arrow batches. Use them on rows that are filtered already.

Each is made when it is asked for, as its result type needs a session.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rowwise


def _mapped(f: Callable, returns: str, *columns: Column | str) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return values.map(f)

    return F.pandas_udf(run, returns)(*columns)


def decode_lossy(content: Column | str) -> Column:
    return _mapped(rowwise.decode_lossy, "string", content)


def python_imports(text: Column | str) -> Column:
    return _mapped(rowwise.python_imports, "array<string>", text)


def package_keys(text: Column | str) -> Column:
    return _mapped(rowwise.package_keys, "array<string>", text)


def pyproject(text: Column | str) -> Column:
    """struct(dependencies, backend)."""

    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rowwise.pyproject_facts(t) for t in values], columns=["dependencies", "backend"])

    return F.pandas_udf(run, "dependencies string, backend string")(text)


def json_entry(path: Column | str, kind: Column | str) -> Column:
    """struct(place, head)."""

    def run(paths: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rowwise.json_entry(p, k) for p, k in zip(paths, kinds, strict=True)], columns=["place", "head"])

    return F.pandas_udf(run, "place string, head string")(path, kind)


def parse_answer(reply: Column | str) -> Column:
    """struct(result, error)."""

    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rowwise.parse_answer(r) for r in values], columns=["result", "error"])

    return F.pandas_udf(run, f"result {rowwise.ANSWER}, error string")(reply)


def ask_prompt(question: Column | str, context: Column | str) -> Column:
    from ..operators.prompts import user_prompt

    def run(questions: pd.Series, contexts: pd.Series) -> pd.Series:
        return pd.Series([user_prompt(q, c) for q, c in zip(questions, contexts, strict=True)])

    return F.pandas_udf(run, "string")(question, context)
