"""Shaping messages: flattening, albums, files, assembly, the outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FILE, MESSAGE, PASS_THROUGH, PUBLISH_CONSTANTS, PUBLISH_SWITCHES, RAW_MESSAGE, TRANSPORT_COLUMNS, Options
from .order import row_numbers
from .skew import join_skewed

def visible(attributes: Column) -> Column:
    """Entries of a map whose key does not start with an underscore."""
    return F.map_filter(attributes, lambda k, _: ~k.startswith("_"))


def file_struct(raw: Column, has_photo: Column) -> Column:
    """The attachment of a raw message; the columns of the other media kind are null."""
    photo, document = raw["media_kind"] == "photo", raw["media_kind"] == "document"
    only = {
        "media_date": photo, "media_sizes": photo, "media_video_sizes": photo, "has_stickers": photo,
        "thumbs": document, "video_thumbs": document,
    }

    def field(f):
        if f.name in ("voice_note", "video_note"):
            value = F.lit(None)
        elif f.name == "as_image":
            value = has_photo
        elif f.name in only:
            value = F.when(only[f.name], raw[f.name])
        else:
            value = raw[f.name]
        return value.cast(f.dataType).alias(f.name)

    return F.struct(*[field(f) for f in FILE.fields])


def parse_raw(records: DataFrame, value: str = "value") -> DataFrame:
    """Raw JSON messages flattened to the message schema; unreadable ones keep their text in ``_corrupt``."""
    parsed = F.from_json(F.col(value), RAW_MESSAGE, {"mode": "PERMISSIVE"})
    df = records.withColumn("_raw", parsed)
    readable = F.col("_raw").isNotNull() & F.col("_raw.id").isNotNull()
    df = df.withColumn("_corrupt", F.when(~readable, F.col(value)))
    raw = F.col("_raw")
    origin = F.struct(
        raw["chat"]["id"].alias("chat_id"), raw["chat"]["title"].alias("chat_title"),
        F.lit(None).cast("string").alias("from_user"), raw["via_input_bot"].alias("via_input_bot"),
        raw["via_bot"].alias("via_bot"), raw["via_bot_id"].alias("via_bot_id"),
        raw["fwd_from"].alias("fwd_from"), visible(raw["forward"]).alias("forward"),
    )
    no_files = F.array().cast(MESSAGE["files"].dataType)
    files = F.when(raw["file"].isNotNull(), F.array(file_struct(raw["file"], raw["has_photo"]))).otherwise(no_files)
    made = {"origin": origin, "files": files}
    columns = [made.get(f.name, raw[f.name]).alias(f.name) for f in MESSAGE.fields if f.name not in dict(PASS_THROUGH)]
    columns += [raw[name].alias(name) for name, _ in PASS_THROUGH]
    return df.select(*[c for c in records.columns if c != value], *columns, "_corrupt")


def fold_albums(members: DataFrame) -> DataFrame:
    """One message per album: scalars of the first member, the last forward header, the number of files.

    ``members``: ``chat_id, grouped_id, pos, message, forward, caption``. Everything is
    combined on the map side; the files of an album are rows of their own, see ``album_files``.
    """
    return members.groupBy("chat_id", "grouped_id").agg(
        F.min_by(F.struct("pos", "message"), "pos").alias("first"),
        F.max_by("forward", F.when(F.col("forward").isNotNull(), F.col("pos"))).alias("forward"),
        F.count(F.lit(1)).alias("n_files"),
    ).select("chat_id", "grouped_id", F.col("first.pos").alias("id"), F.col("first.message").alias("message"), "forward", "n_files")


def album_files(members: DataFrame) -> DataFrame:
    """The files of all albums in order: ``file_pos`` from 0 within the album, and the caption as text."""
    numbered = row_numbers(members.select("chat_id", "grouped_id", "pos", "caption"), ["chat_id", "grouped_id"], "pos", "_n")
    return numbered.select("chat_id", "grouped_id", (F.col("_n") - 1).cast("long").alias("file_pos"), "pos",
                           F.coalesce(F.col("caption").cast("string"), F.lit("None")).alias("caption"))


def album_captions(members: DataFrame, cap: int = 1000) -> DataFrame:
    """The captions that are sent in place of an empty text: the filled ones, each cut, of albums with several files."""
    several = fold_albums(members).where("n_files > 1").select("chat_id", "grouped_id")
    filled = members.where("caption <> ''")
    met = join_skewed(filled.withColumn("_k", F.struct("chat_id", "grouped_id")), several.select(F.struct("chat_id", "grouped_id").alias("_k")), "_k", F.col("pos"))
    return met.select("chat_id", "grouped_id", "pos", F.left("caption", F.lit(cap)).alias("caption"))


def redact(files: Column) -> Column:
    """Files without their bytes, for logs."""
    return F.transform(files, lambda f: f.withField("bytes", F.lit(None).cast("binary")))


def file_label(name: Column, extension: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), extension)


def alias_prefix(title: Column) -> Column:
    return F.concat(title, F.lit(":\n"))


def assemble(pre: Column, text: Column, post: Column, cap: int = 1000) -> Column:
    empty = F.lit("")
    return F.left(F.concat(F.coalesce(pre, empty), F.coalesce(text, empty), F.coalesce(post, empty)), F.lit(cap))


def caption_fallback(captions: Column, cap: int = 1000) -> Column:
    """Non-empty captions, each cut; used when the assembled text is empty and there are several files."""
    filled = F.filter(captions, lambda c: c.isNotNull() & (c != ""))
    return F.transform(filled, lambda c: F.left(c, F.lit(cap)))


def outbox_key(key: Column, *identity: Column) -> Column:
    """Key of the published record: a digest of the whole identity, so that a replay writes the same key and no two
    messages share one."""
    named = F.concat_ws("/", *[F.coalesce(c.cast("string"), F.lit("")) for c in identity])
    return F.concat_ws("_", key, F.md5(named))


def drop_transport(records: DataFrame) -> DataFrame:
    return records.drop(*TRANSPORT_COLUMNS)


def with_publish_options(messages: DataFrame, options: Options = Options()) -> DataFrame:
    """Fill every option of the publisher that the message does not carry itself."""
    out = messages
    for name, value in PUBLISH_CONSTANTS.items():
        if name not in out.columns:
            kind = "boolean" if isinstance(value, bool) or name in PUBLISH_SWITCHES else "string"
            out = out.withColumn(name, F.lit(value).cast(kind))
    target = F.col("target_channel") if "target_channel" in out.columns else F.lit(None).cast("string")
    return out.withColumn("target_channel", F.coalesce(target, F.lit(options.default_channel)))


def split_long(text: Column, size: int = 1000) -> Column:
    """Consecutive pieces of at most ``size`` characters."""
    last = F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size + 1, F.lit(size)))
