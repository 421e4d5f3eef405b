"""What built-in functions can't express, in plain Python; udfs.py makes columns of it.

SRC-4 lossy decoding, STR-10 Python imports, SRC-6 and SRC-7 JSON and TOML manifests, JSN-1..4 and PRS-1 JSON.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
import warnings

ANSWER = "struct<answer:string,confidence:string,sources:array<string>,graph_context_used:boolean>"
_NEWLINE = re.compile("\r\n?")
_YES = {"true", "1", "yes", "y", "on", "t"}
_NO = {"false", "0", "no", "n", "off", "f"}


def decode_lossy(content: bytes | None) -> str | None:
    return None if content is None else bytes(content).decode("utf-8", "ignore")


def python_imports(text: str | None) -> list[str]:
    """Targets in the order of a breadth-first walk; relative ones with their dots; none if it doesn't parse."""
    if text is None:
        return []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(_NEWLINE.sub("\n", text))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    found: list[str] = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found.extend(a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            found.append("." * node.level + (node.module or ""))
    return found


def pyproject_facts(text: str | None) -> tuple[str, str]:
    """Lower-cased project dependencies and the build backend; empty for what is missing or malformed."""
    try:
        data = tomllib.loads(text or "")
        deps = data.get("project", {}).get("dependencies", [])
        return "\n".join(str(d) for d in deps).lower(), str(data.get("build-system", {}).get("build-backend", ""))
    except (tomllib.TOMLDecodeError, AttributeError, TypeError):
        return "", ""


def package_keys(text: str | None) -> list[str] | None:
    """Names of dependencies and devDependencies, merged (AGG-12, MAP-1); null if the manifest is malformed."""
    try:
        data = json.loads(text) if text is not None else None
        merged = {**(data.get("dependencies") or {}), **(data.get("devDependencies") or {})}
    except (ValueError, AttributeError, TypeError, RecursionError):
        return None
    return sorted(merged)


def json_entry(path: str, kind: str) -> tuple[str, str]:
    """An entry's place, which sorts as the entries of a tree do that is walked from above, and how its JSON object begins."""
    *above, name = path.split("/")
    place = "".join(f"0{d.lower()}\0{d}\0" for d in above) + f"{int(kind == 'file')}{name.lower()}\0{name}\0"
    return place, f'{{"name": {json.dumps(name)}, "path": {json.dumps(path)}, "kind": {json.dumps(kind)}, "children": ['


def parse_answer(reply: str | None) -> tuple[dict | None, str | None]:
    """(answer, None) or (None, what is wrong). A fence may surround the object and text may follow it."""
    text = (reply or "").strip()
    for fence in ("```json", "```"):
        if text.startswith(fence):
            text = text[len(fence) :].strip()
    if text.endswith("```"):
        text = text[:-3].strip()
    try:
        data, _ = json.JSONDecoder().raw_decode(text)
    except (ValueError, RecursionError):
        return None, "The generator's reply is not valid JSON."
    wrong = "The generator's reply does not have the expected shape."
    if not isinstance(data, dict):
        return None, wrong
    flag = data.get("graph_context_used")
    if isinstance(flag, str):
        flag = True if flag.lower() in _YES else False if flag.lower() in _NO else None
    elif flag in (0, 1) and not isinstance(flag, bool):
        flag = bool(flag)
    good = isinstance(data.get("answer"), str) and isinstance(data.get("confidence"), str) and isinstance(flag, bool)
    sources = data.get("sources")
    if not good or not isinstance(sources, list) or not all(isinstance(s, str) for s in sources):
        return None, wrong
    return {"answer": data["answer"], "confidence": data["confidence"], "sources": sources, "graph_context_used": flag}, None


SUMMARY_FIELDS = {"executive_summary": str, "main_technologies": list, "architecture_observations": list, "notable_directories": list, "next_steps": list}


def parse_summary(reply: str | None) -> tuple[dict | None, str | None]:
    """Strict JSON with the five fields of a summary (JSN-2)."""
    try:
        data = json.loads(reply or "")
    except (ValueError, RecursionError):
        return None, "The generator's reply is not valid JSON."
    ok = isinstance(data, dict) and all(isinstance(data.get(k), t) for k, t in SUMMARY_FIELDS.items())
    if not ok or not all(isinstance(x, str) for k, t in SUMMARY_FIELDS.items() if t is list for x in data[k]):
        return None, "The generator's summary does not have the expected shape."
    return {k: data[k] for k in SUMMARY_FIELDS}, None
