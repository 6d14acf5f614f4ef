"""Explicit schemas of the tables that cross a job boundary."""

from pyspark.sql import types as T

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


FUNCTION = _struct(name=_S, parameters=T.ArrayType(_S))
CLASS = _struct(name=_S, methods=T.ArrayType(FUNCTION))

FILES = _struct(repo_id=_S, path=_S, content=_S, length=_L, ord=_L)

DOCUMENTS = _struct(
    repo_id=_S, file_path=_S, content=_S,
    metadata=_struct(file_path=_S, language=_S, extension=_S, is_entry_point=_B), ord=_L,
)

COMPONENTS = _struct(
    repo_id=_S, path=_S, name=_S, type=_S, classes=T.ArrayType(CLASS), functions=T.ArrayType(FUNCTION),
    imports=T.ArrayType(_S), dependencies=T.ArrayType(_S), is_entry_point=_B, is_critical=_B, ord=_L,
)

THREATS = _struct(
    repo_id=_S, owner_kind=_S, owner=_S, ordinal=_L, type=_S, description=_S, severity=_S, impact=_S,
    mitigation=_S, code_snippet=_S, crosses_boundary=_B,
)

VULNERABILITY = _struct(
    type=_S, description=_S, severity=_S, components=T.ArrayType(_S), attack_vector=_S, mitigation=_S
)

THREAT = _struct(
    ordinal=_L, type=_S, description=_S, severity=_S, impact=_S, mitigation=_S, code_snippet=_S, crosses_boundary=_B
)

# One line of the persisted threat model: an owner with up to a fixed number of its threats.
THREAT_MODEL = _struct(
    repo_id=_S, overall_risk=_S, owner_kind=_S, owner=_S, part=_L, threats=T.ArrayType(THREAT)
)
