"""Readers: every supported format becomes a ``turns`` table (:data:`timbre.operators.corpus.TURNS`).

A file whose order matters (prose, chats) is one row until it is cut, so its lines keep their order
on any number of machines; tables of turns are read in splits.
"""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from timbre.functions import text as T
from timbre.session import checkpointed

# Formats of time stamps, as Spark patterns.
TIME_FORMATS = ["yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "MMM dd HH:mm:ss Z yyyy", "d/M/yyyy, H:mm", "d/M/yyyy, H:mm:ss", "M/d/yy, H:mm", "d/M/yyyy, h:mm a", "d/M/yyyy, h:mm:ss a", "M/d/yy, h:mm a", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd"]
# Marks of a Gutenberg book, headings, quoted speech, a line of a WhatsApp export.
BOOK_START = r"(?is)^.*?\*\*\*\s*START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*?\*\*\*"
BOOK_END = r"(?is)\*\*\*\s*END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*$"
HEADING = r"(?i)^(?:chapter|book|part)\s+[\w.]+\.?$"
QUOTE = r"[\"“]([^\"”]{2,})[\"”]"
CHAT_LINE = r"(?i)^\[?([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}),? ([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)\s?([ap]m)?\]? (?:- )?([^:]+?): (.*)$"
NOT_MESSAGES = ("<Media omitted>", "This message was deleted")
KNOWN = ("text", "speaker", "doc_id", "conversation_id", "turn_id", "timestamp", "reply_to")


def parse_time(value: Column) -> Column:
    """A time stamp from seconds or milliseconds since 1970, or from any of the formats; else null."""
    text = F.regexp_replace(value.cast("string"), r"^[A-Z][a-z]{2} (?=[A-Z][a-z]{2} )", "")
    number = F.when(text.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$"), text.try_cast("double"))
    epoch = F.timestamp_micros((F.when(number > 1e12, number / 1000).otherwise(number) * 1e6).cast("long"))
    return F.coalesce(epoch, *(F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS))


def _turns(df: DataFrame, **columns: Column) -> DataFrame:
    none = {"ts": F.lit(None).cast("timestamp"), "reply_to": F.lit(None).cast("int"), "meta": F.lit(None).cast("map<string,string>")}
    types = {"doc_id": "string", "turn_id": "int", "speaker": "string", "text": "string", "ts": "timestamp", "reply_to": "int", "meta": "map<string,string>"}
    made = none | columns
    return df.select(*(made[c].cast(t).alias(c) for c, t in types.items()))


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """A row a file: stem, folder, value."""
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_path"))
    return rows.select(F.regexp_replace("value", "\r\n?", "\n").alias("value"), _stem(F.col("_path")).alias("stem"), F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1).alias("folder"))


def _numbered(df: DataFrame, explicit: Column) -> Column:
    """Turn ids: the explicit one, else one more than the turn before in the conversation, from 0."""
    w = Window.partitionBy("_doc").orderBy("_pos")
    place = F.row_number().over(w) - 1
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(explicit.isNotNull(), F.struct(explicit.alias("id"), F.col("_place").alias("at"))), ignorenulls=True).over(upto)
    return df.withColumn("_place", place).withColumn("_last", last).withColumn("turn_id", F.coalesce(explicit, F.col("_last.id") + F.col("_place") - F.col("_last.at"), F.col("_place")))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, or a JSON array, of turns. Fields beyond the known ones go to meta."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    is_array = bool(head) and head[0].value.lstrip().startswith("[")
    rows = spark.read.json(path, multiLine=is_array)
    have = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    as_text = lambda f: F.to_json(f.name) if isinstance(f.dataType, ST.StructType | ST.ArrayType | ST.MapType) else F.col(f.name).cast("string")
    other = [f for f in rows.schema if f.name not in KNOWN and f.name != "_corrupt_record"]
    meta = F.map_filter(F.create_map(*(x for f in other for x in (F.lit(f.name), as_text(f)))), lambda k, v: v.isNotNull()) if other else F.lit(None)
    rows = rows.withColumns({"_pos": F.monotonically_increasing_id(), "_doc": F.coalesce(have("doc_id"), have("conversation_id"), F.lit("doc"))})
    rows = _numbered(rows, have("turn_id").try_cast("int"))
    return _turns(
        rows, doc_id=F.col("_doc"), turn_id=F.col("turn_id"), speaker=F.coalesce(have("speaker"), F.lit("unknown")), text=F.coalesce(have("text"), F.lit("")),
        ts=parse_time(have("timestamp")), reply_to=have("reply_to").try_cast("int"), meta=meta,
    )


def read_csv(spark: SparkSession, path: str, text_col: str = "text", speaker_col: str = "speaker", doc_col: str = "doc_id") -> DataFrame:
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    have = lambda c: F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumns({"_pos": F.monotonically_increasing_id(), "_doc": F.coalesce(F.nullif(have(doc_col), F.lit("")), F.lit("doc"))})
    rows = rows.withColumn("_turn", F.row_number().over(Window.partitionBy("_doc").orderBy("_pos")) - 1)
    return _turns(rows, doc_id=F.col("_doc"), turn_id=F.col("_turn"), speaker=F.coalesce(F.nullif(have(speaker_col), F.lit("")), F.lit("unknown")), text=F.coalesce(have(text_col), F.lit("")), ts=parse_time(have("timestamp")))


def read_prose(spark: SparkSession, path: str, speaker: str | None = None, split_dialogue: bool = True) -> DataFrame:
    """A book or article: paragraphs are turns, quoted speech apart from narration unless asked otherwise."""
    return prose_turns(_whole(spark, path), speaker, split_dialogue)


def prose_turns(files: DataFrame, speaker: str | None = None, split_dialogue: bool = True) -> DataFrame:
    """Turns of whole files: stem, value."""
    rows = files
    body = F.when(F.col("value").rlike(BOOK_START), F.regexp_replace(F.regexp_replace("value", BOOK_START, ""), BOOK_END, "")).otherwise(F.col("value"))
    paragraphs = F.transform(F.split(body, r"\n\s*\n"), lambda p: T.strip(F.regexp_replace(p, r"(?U)\s+", " ")))
    kept = F.filter(paragraphs, lambda p: (F.char_length(p) > 1) & ~p.rlike(HEADING))
    rows = rows.select("stem", (F.lit(speaker) if speaker else F.split("stem", "__")[0]).alias("who"), F.posexplode(kept).alias("para", "p"))
    if not split_dialogue:
        return _turns(rows, doc_id=F.col("stem"), turn_id=F.col("para"), speaker=F.col("who"), text=F.col("p"), meta=F.create_map(F.lit("para"), F.col("para").cast("string")))
    speech = F.trim(F.array_join(T.find_all(F.col("p"), QUOTE, 1), " "))
    told = F.regexp_replace(F.regexp_replace(F.regexp_replace("p", QUOTE, " "), r"(?U)\s+", " "), r"^[ ,.;]+|[ ,.;]+$", "")
    parts = F.array(
        F.struct(F.lit("narration").alias("part"), F.when(F.size(F.split(told, " ")) >= 3, told).otherwise("").alias("t")),
        F.struct(F.lit("dialogue").alias("part"), speech.alias("t")),
    )
    rows = rows.select("stem", "who", "para", F.posexplode(F.filter(parts, lambda x: x["t"] != "")).alias("k", "x"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("stem").orderBy("para", "k")) - 1)
    return _turns(rows, doc_id=F.col("stem"), turn_id=F.col("n"), speaker=F.concat_ws(":", "who", "x.part"), text=F.col("x.t"), meta=F.create_map(F.lit("para"), F.col("para").cast("string")))


def read_prose_dir(spark: SparkSession, path: str, block: int = 25, narration_only: bool = True) -> DataFrame:
    """Books ``<author>__<id>.txt``: the author speaks; each ``block`` paragraphs are a conversation, so that
    held-out parts are whole passages and no book is one task's window later on."""
    turns = read_prose(spark, f"{path.rstrip('/')}/*.txt")
    if narration_only:
        turns = turns.where(F.col("speaker").endswith(":narration"))
    rows = turns.withColumn("_i", F.row_number().over(Window.partitionBy("doc_id").orderBy("turn_id")) - 1)
    number = F.floor(F.col("_i") / block).cast("int")
    return _turns(rows, doc_id=F.concat_ws("#", "doc_id", number), turn_id=F.col("_i") % block, speaker=F.split("doc_id", "__")[0], text=F.col("text"), meta=F.create_map(F.lit("book"), F.col("doc_id")))


def read_whatsapp(spark: SparkSession, path: str) -> DataFrame:
    """A chat export; lines that start no message continue the one before. Times with am and pm are read so."""
    return whatsapp_turns(_whole(spark, path))


def whatsapp_turns(files: DataFrame) -> DataFrame:
    """Turns of whole exports: stem, value."""
    rows = files.select("stem", F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    line = F.regexp_replace("line", "^‎+|‎+$", "")
    rows = rows.withColumn("head", F.when(line.rlike(CHAT_LINE), line))
    part = lambda i: F.regexp_extract("head", CHAT_LINE, i)
    w = Window.partitionBy("stem").orderBy("pos")
    dropped = F.trim(part(5)).isin(*NOT_MESSAGES)
    rows = rows.withColumn("starts", F.col("head").isNotNull() & ~F.coalesce(dropped, F.lit(False))).where(F.col("starts") | F.col("head").isNull())
    rows = rows.withColumn("msg", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.where((F.col("msg") > 0) & (F.col("starts") | (F.trim("line") != "")))
    rows = rows.withColumn("content", F.when(F.col("starts"), part(5)).otherwise(F.col("line")))
    whole = rows.groupBy("stem", "msg").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda s: s["content"]), "\n").alias("text"), F.max("head").alias("head")
    )
    time = parse_time(F.trim(F.concat(part(1), F.lit(", "), part(2), F.lit(" "), F.upper(part(3)))))
    return _turns(whole, doc_id=F.col("stem"), turn_id=F.col("msg") - 1, speaker=F.trim(part(4)), text=F.col("text"), ts=time)


def _repaired(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; any other text as it is."""
    raw = F.encode(F.when(text.rlike(r"^[\x{00}-\x{FF}]*$"), text), "ISO-8859-1")
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(text)


def read_meta_export(spark: SparkSession, path: str) -> DataFrame:
    """Instagram or Messenger export: a file, or a folder of conversation folders."""
    is_folder = not path.rstrip("/").endswith(".json")
    files = spark.read.option("recursiveFileLookup", is_folder)
    rows = (files.option("pathGlobFilter", "message_*.json") if is_folder else files).json(path, multiLine=True).select("messages", F.col("_metadata.file_path").alias("_path"))
    doc = F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1) if is_folder else _stem(F.col("_path"))
    rows = rows.select(doc.alias("doc"), "_path", F.posexplode("messages").alias("i", "m")).where("m.content is not null and m.content <> ''")
    w = Window.partitionBy("doc").orderBy("_path", F.coalesce("m.timestamp_ms", F.lit(0)), "i")
    rows = rows.withColumn("n", F.row_number().over(w) - 1)
    return _turns(rows, doc_id=F.col("doc"), turn_id=F.col("n"), speaker=_repaired(F.coalesce("m.sender_name", F.lit("unknown"))), text=_repaired(F.col("m.content")), ts=parse_time(F.col("m.timestamp_ms")))


def thread_roots(tweets: DataFrame) -> DataFrame:
    """id, root: the first tweet of each thread, by pointer jumping: each round doubles the way looked back.

    ``tweets``: id, parent. A parent that isn't there starts a thread; a circle's root is the least id
    met on the way.
    """
    there = tweets.select(F.col("id").alias("_p")).distinct()
    ways = tweets.select("id", "parent").join(there, F.col("parent") == F.col("_p"), "left")
    ways = checkpointed(ways.select("id", F.col("_p").alias("up"), F.coalesce("_p", "id").alias("root"), F.least("id", "_p").alias("low")))
    for _ in range(tweets.count().bit_length()):  # a way of n steps ends after so many doublings; only circles go on
        open_ways = ways.where("up is not null")
        if not open_ways.take(1):
            break
        next_ = ways.select(F.col("id").alias("_up"), F.col("up").alias("_up2"), F.col("root").alias("_root"), F.col("low").alias("_low"))
        moved = ways.join(next_, F.col("up") == F.col("_up"), "left")
        ways = checkpointed(moved.select("id", F.col("_up2").alias("up"), F.coalesce("_root", "root").alias("root"), F.least("low", "_low").alias("low")))
    return ways.select("id", F.when(F.col("up").isNull(), F.col("root")).otherwise(F.col("low")).alias("root"))


def tweet_text(text: Column) -> Column:
    """A tweet without the mentions in front, entities resolved, short links as one placeholder."""

    @F.pandas_udf("string")
    def unescaped(s: pd.Series) -> pd.Series:
        return s.map(lambda x: html.unescape(x) if isinstance(x, str) else x)

    return F.regexp_replace(T.strip(unescaped(F.regexp_replace(text, r"^(@\w+\s+)+", ""))), r"https?://t\.co/\w+", "<URL>")


def threads(tweets: DataFrame) -> DataFrame:
    """Turns of conversations rebuilt from tweets (tweet_id, author_id, inbound, created_at, text,
    in_response_to_tweet_id): a thread is a conversation, in order of ids; replies point to their parent."""
    rows = tweets.select(
        F.col("tweet_id").cast("long").alias("id"), F.nullif(F.trim(F.col("in_response_to_tweet_id").cast("string")), F.lit("")).try_cast("long").alias("parent"), "author_id",
        (F.lower(F.trim(F.col("inbound").cast("string"))) == "true").alias("inbound"), "created_at", "text",
    )
    placed = rows.join(thread_roots(rows), "id").withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("id")) - 1)
    parents = placed.select(F.col("id").alias("_pid"), F.col("root").alias("_proot"), F.col("n").alias("_pn"))
    whole = placed.join(parents, (F.col("parent") == F.col("_pid")) & (F.col("root") == F.col("_proot")), "left")
    meta = F.create_map(F.lit("inbound"), F.col("inbound").cast("string"), F.lit("brand"), F.when(~F.col("inbound"), F.col("author_id").cast("string")))
    return _turns(whole, doc_id=F.col("root"), turn_id=F.col("n"), speaker=F.when(F.col("inbound"), "customer").otherwise(F.col("author_id").cast("string")), text=tweet_text(F.col("text")), ts=parse_time(F.col("created_at")), reply_to=F.col("_pn"), meta=meta)


def read_twitter_support(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return threads(rows.limit(max_rows) if max_rows else rows)


READERS: dict[str, Callable[..., DataFrame]] = {
    "jsonl": read_jsonl, "json": read_jsonl, "csv": read_csv, "txt": read_prose, "md": read_prose, "gutenberg": read_prose, "prose": read_prose,
    "prose-dir": read_prose_dir, "whatsapp": read_whatsapp, "meta": read_meta_export, "twitter-support": read_twitter_support, "twitter": read_twitter_support,
}


def detect(spark: SparkSession, path: str) -> str:
    """The format of a file or folder, from its name and first characters."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isDirectory():
        return "prose-dir" if len(fs.globStatus(jvm.org.apache.hadoop.fs.Path(at, "*__*.txt"))) else "meta"
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    head = "\n".join(r.value for r in spark.read.text(path).limit(200).collect())[:6000]
    if suffix == "csv":
        return "twitter-support" if "in_response_to_tweet_id" in head.split("\n")[0] else "csv"
    if suffix == "json":
        return "meta" if '"sender_name"' in head[:4000] else "jsonl"
    if suffix == "txt":
        import re

        if "PROJECT GUTENBERG" in head.upper():
            return "gutenberg"
        if re.match(CHAT_LINE, head.split("\n")[0].strip("‎")):
            return "whatsapp"
    return suffix if suffix in READERS else "txt"


def read_turns(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    return READERS[fmt or detect(spark, path)](spark, path, **options)
