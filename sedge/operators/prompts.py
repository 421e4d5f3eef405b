"""Prompt assembly (PRM-1, PRM-2, AGG-10, STR-7, JSN-1, DOM-10)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

CONTEXT_CHARS = 12_000
CUT = "\n[...retrieved context truncated...]"
#: The keys are fixed: rowwise.parse_answer and parse_summary read them.
SHAPE = {"answer": "text", "confidence": "high | medium | low", "sources": ["path"], "graph_context_used": True}
ASK_SYSTEM = "Below are a question and pieces of a repository's files. Answer from these pieces; if they don't tell, say so. Your whole reply is one JSON object like required_json_shape, with its four keys."
SUMMARY_SHAPE = {"executive_summary": "text", "main_technologies": ["text"], "architecture_observations": ["text"], "notable_directories": ["text"], "next_steps": ["text"]}
SUMMARY_SYSTEM = "Below is what a scan of a repository found. Summarise it for a new reader; claim nothing that it doesn't show. Your whole reply is one JSON object like required_json_shape, with its five keys."


def context(chunks: DataFrame, by: list[str], rank: str = "rank", path: str = "file_path", content: str = "content", most: int = CONTEXT_CHARS) -> DataFrame:
    """by and context: `File: path`, a line break and the content of each chunk in rank order, a blank line between; cut at
    `most` characters. Groups are answers' few chunks, so a group fits a row."""
    part = F.concat(F.lit("File: "), F.col(path), F.lit("\n"), F.col(content))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), part.alias("t")))), lambda x: x["t"]), "\n\n")
    return chunks.groupBy(*by).agg(whole.alias("_w")).select(*by, cut(F.col("_w"), most).alias("context"))


def cut(whole: Column, most: int = CONTEXT_CHARS) -> Column:
    return text.truncated(whole, most, CUT)


def user_prompt(question: str, retrieved: str) -> str:
    return json.dumps({"question": question, "retrieved_code": retrieved, "required_json_shape": SHAPE}, indent=2)


def combined(system: str, user: str) -> str:
    return f"SYSTEM PROMPT:\n{system}\n\nUSER PROMPT:\n{user}"


def summary_prompt(url: str, report: dict, tree: list[dict]) -> str:
    """report: a row of metadata.reports as a dict; tree: what metadata.directory_json tells."""
    from .metadata import shortened

    return json.dumps({"repo_url": url, "file_count": report["file_count"], "directory_count": report["directory_count"], "technologies": report["technologies"], "top_level_structure": [shortened(e) for e in tree[:30]], "required_json_shape": SUMMARY_SHAPE}, indent=2)
