"""Declared schemas of messages, files, topic records and profiles, and the options."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_S, _L, _I, _B, _D, _TS = (
    T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType(), T.TimestampType(),
)


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


ORIGIN = _struct(
    ("chat_id", _L), ("chat_title", _S), ("from_user", _S), ("via_input_bot", _S), ("via_bot", _S),
    ("via_bot_id", _L), ("fwd_from", _S), ("forward", T.MapType(_S, _S)),
)

FILE = _struct(
    ("bytes", T.BinaryType()), ("file_name", _S), ("file_size", _L), ("caption", _S), ("mime_type", _S),
    ("voice_note", _B), ("video_note", _B), ("as_image", _B), ("file_type", _S), ("sticker_set", _S),
    ("emoji", _S), ("duration", _D), ("height", _I), ("width", _I), ("performer", _S), ("media_kind", _S),
    ("media_date", _TS), ("media_sizes", T.ArrayType(_S)), ("media_video_sizes", T.ArrayType(_S)),
    ("has_stickers", _B), ("thumbs", T.ArrayType(_S)), ("video_thumbs", T.ArrayType(_S)),
)

# Attributes copied from the raw message without a change (fixed names).
PASS_THROUGH = [
    ("game", _S), ("geo", _S), ("gif", _S), ("forwards", _I), ("legacy", _B), ("media_unread", _B),
    ("noforwards", _B), ("reply_to_msg_id", _L), ("restriction_reason", T.ArrayType(_S)), ("dice", _S),
    ("edit_date", _TS), ("edit_hide", _B), ("button_count", _I), ("action", _S),
]

RAW_FILE = T.StructType([f for f in FILE.fields if f.name not in ("voice_note", "video_note", "as_image")])

# A raw message as the gatherer receives it.
RAW_MESSAGE = T.StructType(
    _struct(
        ("chat", _struct(("id", _L), ("title", _S))), ("chat_id", _L), ("id", _L), ("grouped_id", _L),
        ("date", _TS), ("message", _S), ("silent", _B), ("buttons", _S), ("via_input_bot", _S),
        ("via_bot", _S), ("via_bot_id", _L), ("fwd_from", _S), ("forward", T.MapType(_S, _S)),
        ("views", _I), ("web_preview", _S), ("venue", _S), ("pinned", _B), ("poll", _S), ("post", _B),
        ("post_author", _S), ("mentioned", _B), ("is_group", _B), ("is_channel", _B), ("is_private", _B),
        ("is_reply", _B), ("file", RAW_FILE), ("has_photo", _B),
    ).fields
    + _struct(*PASS_THROUGH).fields
)

# Publisher options and their fixed default values.
PUBLISH_CONSTANTS = {
    "reply_to": None, "attributes": None, "formatting_entities": None, "thumb": None, "background": None,
    "schedule": None, "comment_to": None, "parse_mode": "", "link_preview": True, "force_document": False,
    "clear_draft": False, "silent": None, "buttons": None, "file": None, "supports_streaming": None, "nosound_video": None,
}
# Options that are switches though their default is null.
PUBLISH_SWITCHES = ("background", "silent", "supports_streaming", "nosound_video")

MESSAGE = T.StructType(
    _struct(
        ("chat_id", _L), ("id", _L), ("date", _TS), ("grouped_id", _L), ("message", _S), ("origin", ORIGIN),
        ("files", T.ArrayType(FILE)), ("silent", _B), ("buttons", _S), ("views", _I), ("web_preview", _S),
        ("venue", _S), ("pinned", _B), ("poll", _S), ("post", _B), ("post_author", _S), ("mentioned", _B),
        ("is_group", _B), ("is_channel", _B), ("is_private", _B), ("is_reply", _B),
    ).fields
    + _struct(*PASS_THROUGH).fields
)

TOPIC_RECORD = _struct(
    ("topic", _S), ("partition", _I), ("offset", _L), ("timestamp", _TS), ("timestamp_type", _I),
    ("key", T.BinaryType()), ("value", _S),
    ("headers", T.ArrayType(_struct(("key", _S), ("value", T.BinaryType())))), ("checksum", _L),
    ("serialized_key_size", _I), ("serialized_value_size", _I), ("serialized_header_size", _I),
)

# Transport columns removed before a record is written again.
TRANSPORT_COLUMNS = [
    "topic", "offset", "timestamp", "timestamp_type", "checksum", "serialized_key_size",
    "serialized_value_size", "serialized_header_size",
]

PROFILE = _struct(
    ("chat_id", _S), ("signatures", T.ArrayType(_S)), ("alias", _S), ("admin_username", _S), ("title", _S),
    ("last_5_msgs", T.ArrayType(_S)), ("last_seen", _TS),
)


@dataclass(frozen=True)
class Options:
    """Switches and thresholds of the curation; the defaults are fixed values."""

    pass_new_forwards_to_control_channel: bool = True
    ignore_forwards: bool = True
    remove_regexs_from_file: bool = True
    remove_ads: bool = True
    remove_signatures: bool = True
    remove_links: bool = True
    translate_to_english: bool = True
    remove_duplicates: bool = True
    add_channel_alias: bool = True
    # A message is compared with the kept ones among so many messages that arrived before it, in batch and stream; 0 means all.
    max_latest_messages: int = 1000
    partitions: int = 10
    control_channel: str = "control"
    default_channel: str = "main"
    # similarity
    stem_guard: int = 10
    embedding_guard: int = 10
    embedding_threshold: float = 0.7
    ssim_threshold: float = 0.9
    overlap_threshold: float = 0.7
    overlap_floor: int = 8
    # Reports of the best matches show none below these scores; at 0 every pair with anything in common is scored.
    overlap_report_floor: float = 0.5
    embedding_report_floor: float = 0.2
    # publishing
    message_cap: int = 1000
    stale_hours: int = 1
    send_gap_seconds: int = 4
