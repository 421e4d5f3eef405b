"""Schemas of all stored relations; nothing is inferred (SNK-8)."""

from pyspark.sql import types as T

S, I, L, B, NTZ = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampNTZType()
STRINGS = T.ArrayType(S)


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TREE = _of(repository_id=S, path=S, name=S, dir_parts=STRINGS, kind=S, size=L, content=T.BinaryType())
CHUNKS = _of(repository_id=S, file_path=S, chunk_index=I, start_line=I, end_line=I, content=S, embedding=T.ArrayType(T.DoubleType()))
FILES = _of(repository_id=S, path=S, name=S, module=S, is_service=B)
EDGES = _of(repository_id=S, source=S, target=S)
REPOSITORIES = _of(id=S, repo_url=S, created_at=NTZ, updated_at=NTZ)
COMMITS = _of(repository_id=S, run=S, at=NTZ)
QUESTIONS = _of(question_id=L, repository_id=S, question=S)
TECHNOLOGIES = T.ArrayType(_of(name=S, category=S, source=S))
SUMMARY = _of(executive_summary=S, main_technologies=STRINGS, architecture_observations=STRINGS, notable_directories=STRINGS, next_steps=STRINGS)
TOKENS = _of(prompt_tokens=I, completion_tokens=I, total_tokens=I)
REPORTS = _of(id=S, repository_id=S, status=S, file_count=I, directory_count=I, ignored_directories=STRINGS, technologies=TECHNOLOGIES, directory_structure=S, summary=SUMMARY, token_usage=TOKENS, created_at=NTZ)
#: Tables that a repository's index is written to; each is partitioned by repository_id.
TABLES = {"chunks": CHUNKS, "graph_files": FILES, "graph_imports": EDGES, "graph_uses": EDGES}
