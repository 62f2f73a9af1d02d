"""Schemas of the external records."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _struct(**fields: object) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


S, I, L, B = StringType(), IntegerType(), LongType(), BooleanType()

BLOCK = _struct(type=S, text=S, id=S, name=S, input=S, tool_use_id=S, content=S, is_error=B)
TRANSCRIPT = _struct(type=S, sessionId=S, timestamp=S, uuid=S, isCompactSummary=B, message=_struct(role=S, content=S), toolUseResult=S)
V1_CHUNK = _struct(v=I, type=S, id=S, sessionId=S, projectPath=S, chunkIndex=I, content=S, role=S, metadata=S, tokenCount=I, createdAt=S, embedding=S, embeddingDim=I, embeddingModel=S)
METADATA = _struct(filePaths=ArrayType(S), toolNames=ArrayType(S), errorMessages=ArrayType(S), sourceRuntime=S, captureMethod=S, turnId=S, model=S)
BOUNDARY = _struct(kind=S, generation=L, offset=L, sequence=L)
PART = _struct(partIndex=I, externalId=S, content=S, role=S, metadata=METADATA, tokenCount=I)
EXECUTION = _struct(executionIndex=I, toolName=S, command=S, status=S, exitCode=I, outputExcerpt=S)
V2 = _struct(
    v=I, type=S, txId=S, createdAt=S, recordCount=I, payloadDigest=S, sessionId=S, historyEpoch=I, reason=S, runtime=S, turnKey=S, sourceOrder=S,
    revision=I, contentHash=S, completedAt=S, projectPath=S, observedThrough=BOUNDARY, parts=ArrayType(PART), executions=ArrayType(EXECUTION))
#: What frames are told by; payloads are parsed later.
FRAME = _struct(v=I, type=S, txId=S, createdAt=S, recordCount=I, payloadDigest=S)
WIRE = _struct(type=S, event=_struct(type=S, id=S, prompt=S, part=_struct(type=S, text=S, content=S)))
HOOK = _struct(hook_event_name=S, session_id=S, cwd=S, prompt=S, transcript_path=S, turn_id=S, model=S, prompt_uuid=S, last_assistant_message=S, stop_hook_active=B, reason=S)
VECTOR = ArrayType(DoubleType())
