"""Record types of the store (section 1)."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _F, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.FloatType(), T.BooleanType(), T.TimestampType()
_VECTOR, _STRINGS = T.ArrayType(_F), T.ArrayType(_S)
_CHANGE = T.StructType().add("timestamp", _S).add("operation", _S)

#: Common to all records.
COMMON = {"id": _S, "created_at": _TS, "updated_at": _TS, "is_deleted": _B, "created_by": _S, "updated_by": _S}


def _type(**fields: T.DataType) -> T.StructType:
    out = T.StructType()
    for name, kind in fields.items():
        out.add(name, kind)
    return out


FRAMES = _type(
    id=_S, captured_at=_TS, window_title=_S, app_name=_S, image_ref=_S, phash=_L, phash_prefix=T.ShortType(), ocr_text=_S, ocr_status=T.ShortType(),
    embedding=_VECTOR, embedding_status=T.ShortType(), vision_summary=_S, vision_status=T.ShortType(), created_at=_TS, deployment_id=_S,
    image_size_bytes=_I, has_text=_B, has_activity=_B, activity_id=_S,
)
OCR_TEXT = _type(id=_L, frame_id=_S, text=_S, confidence=_F, language=_S, bbox=_S, created_at=_TS)
WINDOW_CONTEXT = _type(id=_L, frame_id=_S, app_name=_S, window_title=_S, process_name=_S, is_focused=_B, url=_S, created_at=_TS)
ACTIVITY_METRICS = _type(id=_L, timestamp=_TS, activity_type=_S, keystroke_count=_I, mouse_events=_I, idle_seconds=_I)
SESSIONS = _type(id=_S, start_time=_TS, end_time=_TS, primary_app=_S, frame_count=_I, total_ocr_words=_I, summary=_S, created_at=_TS)
ACTIVITIES = _type(id=_S, deployment_id=_S, start_at=_TS, end_at=_TS, summary=_S, project_id=_S)
PROJECTS = _type(id=_S, name=_S, summary=_S)
DAYS = _type(id=_S, deployment_id=_S, date=T.DateType(), summary=_S)
_MEMORY = {"tree_path": _STRINGS, "metadata": T.MapType(_S, _S), "last_modify": _CHANGE}
EPISODIC = _type(**COMMON, occurred_at=_TS, actor=_S, event_type=_S, summary=_S, details=_S, **_MEMORY, details_embedding=_VECTOR, summary_embedding=_VECTOR)
SEMANTIC = _type(**COMMON, name=_S, summary=_S, details=_S, source=_S, **_MEMORY, name_embedding=_VECTOR, summary_embedding=_VECTOR, details_embedding=_VECTOR)
PROCEDURAL = _type(**COMMON, entry_type=_S, summary=_S, steps=_STRINGS, **_MEMORY, summary_embedding=_VECTOR, steps_embedding=_VECTOR)
RESOURCE = _type(**COMMON, title=_S, summary=_S, resource_type=_S, content=_S, **_MEMORY, summary_embedding=_VECTOR)
VAULT = _type(**COMMON, entry_type=_S, source=_S, sensitivity=_S, secret_value=_S, caption=_S, metadata=T.MapType(_S, _S), last_modify=_CHANGE, caption_embedding=_VECTOR)
MESSAGES = _type(**COMMON, agent_id=_S, role=_S, text=_S, model=_S, name=_S, tool_call_id=_S, step_id=_S, group_id=_S, sender_id=_S)
BLOCKS = _type(**COMMON, label=_S, value=_S, limit=_I, is_template=_B)
FILES = _type(**COMMON, source_id=_S, file_name=_S, file_path=_S, source_url=_S, file_type=_S, file_size=_I)
CLOUD_FILES = _type(**COMMON, cloud_file_id=_S, local_file_id=_S, status=_S, timestamp=_S)
AGENT_TAGS = _type(agent_id=_S, tag=_S)
