"""Provider payloads of compiled messages (see ``content``) as JSON text, a row for each context."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyloom.operators.content import complete, is_text, plain_text as flat

# The type of images without one, and names where a message has none.
MIME, TOOL, FUNCTION = "image/png", "tool", "function"


def _ordered(entry: Column, *keys: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(*keys, entry.alias("__m")))), lambda x: x["__m"])


def quoted(text: Column) -> Column:
    """A string as JSON; null stays null."""
    held = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNotNull(), F.substring(held, F.lit(6), F.length(held) - 6))


def _object(**fields: Column) -> Column:
    """A JSON object of JSON values; fields that are null are left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]), F.lit("}"))


def _list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))


def _mime(part: Column) -> Column:
    return F.when(F.length(part["mime"]) > 0, part["mime"]).otherwise(F.lit(MIME))


def _text() -> Column:
    """A message's text, its text parts a line each."""
    return flat(F.col("text"), F.col("parts"), "\n")


def _uses(entry: Callable[[Column], Column]) -> Column:
    return F.transform(F.coalesce("tool_uses", F.array().cast("array<struct<id:string,name:string,input:string>>")), entry)


def _pieces(part: Callable[[Column], Column]) -> Column:
    """A message's content as an array of ``part``: its parts, or its text unless that is empty."""
    whole = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("data"), F.lit(None).cast("string").alias("mime"))
    held = F.when(F.col("parts").isNotNull(), F.col("parts")).when(F.coalesce("text", F.lit("")) != "", F.array(whole))
    return F.transform(F.coalesce(held, F.array().cast("array<struct<type:string,text:string,url:string,data:string,mime:string>>")), part)


def plain_text(messages: DataFrame) -> DataFrame:
    """Texts of messages, images as [image], tool calls as JSON; empty messages drop out, two newlines between the others."""
    parts = F.filter(F.transform("parts", lambda p: F.when(is_text(p), F.coalesce(p["text"], F.lit(""))).otherwise("[image]")), lambda x: x != "")
    body = F.when(F.col("parts").isNotNull(), F.array_join(parts, "\n")).otherwise(F.coalesce("text", F.lit("")))
    calls = F.when(F.size("tool_uses") > 0, _list(_uses(lambda u: _object(id=quoted(u["id"]), name=quoted(u["name"]), input=u["input"]))))
    rows = complete(messages).withColumn("__text", F.concat_ws("\n", F.when(body != "", body), calls))
    return rows.filter("__text <> ''").groupBy("ctx_id").agg(F.array_join(_ordered(F.col("__text"), "pos"), "\n\n").alias("payload"))


def _system_first(messages: DataFrame, entry: Column) -> DataFrame:
    rows = messages.withColumns({"__first": F.when(F.col("role") == "system", 0).otherwise(1), "__json": entry})
    return rows.groupBy("ctx_id").agg(_list(_ordered(F.col("__json"), "__first", "pos")).alias("payload"))


def openai(messages: DataFrame) -> DataFrame:
    """System messages first; parts of text alone become one text, others a list; an assistant without parts has null content."""
    def part(p: Column) -> Column:
        url = F.when(p["type"] == "image_url", p["url"]).otherwise(F.concat(F.lit("data:"), _mime(p), F.lit(";base64,"), p["data"]))
        return F.when(is_text(p), _object(type=F.lit('"text"'), text=quoted(p["text"]))).otherwise(_object(type=F.lit('"image_url"'), image_url=_object(url=quoted(url))))

    parts, tool, function = F.col("parts"), F.col("role") == "tool", F.col("role") == "function"
    content = (
        F.when(tool | function, quoted(_text())).when(parts.isNull(), quoted(F.coalesce("text", F.lit("")))).when((F.size(parts) == 0) & (F.col("role") == "assistant"), F.lit("null"))
        .when(F.forall(parts, is_text), quoted(flat(F.col("text"), parts, ""))).otherwise(_list(F.transform(parts, part)))
    )
    name = F.when(function, F.coalesce("name", F.lit(FUNCTION))).otherwise(F.col("name"))
    early = F.when(tool, quoted(F.coalesce("tool_call_id", F.lit(""))))
    # a function's name stands before its content, any other one's behind it
    entry = F.when(function, _object(role=quoted(F.col("role")), name=quoted(name), content=content)).otherwise(_object(role=quoted(F.col("role")), tool_call_id=early, content=content, name=quoted(name)))
    return _system_first(complete(messages), entry)


def mistral(messages: DataFrame) -> DataFrame:
    return openai(messages)


def _islands(messages: DataFrame, role: Column) -> DataFrame:
    """Consecutive messages of one role share a number."""
    order = W.partitionBy("ctx_id").orderBy("pos")
    rows = messages.withColumn("__role", role)
    change = F.coalesce((F.col("__role") != F.lag("__role").over(order)).cast("int"), F.lit(0))
    return rows.withColumn("__change", change).withColumn("__g", F.sum("__change").over(order)).drop("__change")


def _system(messages: DataFrame) -> DataFrame:
    """The system messages' texts that aren't empty, two newlines between; contexts with some alone."""
    rows = messages.filter("role = 'system'").withColumn("__text", _text()).filter("__text <> ''")
    return rows.groupBy("ctx_id").agg(F.array_join(_ordered(F.col("__text"), "pos"), "\n\n").alias("system"))


def anthropic(messages: DataFrame) -> DataFrame:
    """ctx_id, system, payload: system texts apart, tool results as a user's blocks; equal roles in a row merge, and so do text blocks that then meet."""
    def part(p: Column) -> Column:
        source = F.when(p["type"] == "image_url", _object(type=F.lit('"url"'), url=quoted(p["url"]))).otherwise(_object(type=F.lit('"base64"'), media_type=quoted(_mime(p)), data=quoted(p["data"])))
        return F.struct(F.when(is_text(p), p["text"]).alias("text"), F.when(~is_text(p), _object(type=F.lit('"image"'), source=source)).alias("json"))

    block = lambda text, json: F.struct(text.cast("string").alias("text"), json.cast("string").alias("json"))
    none, whole = F.lit(None), _text()
    result = _object(type=F.lit('"tool_result"'), tool_use_id=quoted(F.coalesce("tool_call_id", F.lit(""))), content=quoted(whole))
    calls = _uses(lambda u: block(none, _object(type=F.lit('"tool_use"'), id=quoted(u["id"]), name=quoted(u["name"]), input=u["input"])))
    flat_blocks = F.when(whole != "", F.array(block(whole, none))).otherwise(F.array().cast("array<struct<text:string,json:string>>"))
    blocks = F.when(F.col("role") == "tool", F.array(block(none, result))).when(F.col("role") == "assistant", F.concat(_pieces(part), calls)).when(F.col("role") == "user", _pieces(part)).otherwise(flat_blocks)
    every = complete(messages)
    rows = _islands(every.filter("role <> 'system'").withColumn("__blocks", blocks), F.when(F.col("role") == "assistant", "assistant").otherwise("user"))
    merged = rows.groupBy("ctx_id", "__g").agg(F.any_value("__role").alias("role"), F.flatten(_ordered(F.col("__blocks"), "pos")).alias("b"), F.count(F.lit(1)).alias("n"))

    def join(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        meet = (F.size(out) > 0) & F.get(out, F.size(out) - 1)["text"].isNotNull() & x["text"].isNotNull()
        return F.when(meet, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(block(F.concat(last["text"], x["text"]), none)))).otherwise(F.concat(out, F.array(x)))

    start = F.array().cast("array<struct<text:string,json:string>>")
    b = F.when(F.col("n") > 1, F.aggregate("b", start, join)).otherwise(F.col("b"))
    many = _list(F.transform("b", lambda x: F.coalesce(x["json"], _object(type=F.lit('"text"'), text=quoted(x["text"])))))
    one = F.get("b", 0)["text"]
    content = F.when(F.size("b") == 0, F.lit('""')).when((F.size("b") == 1) & one.isNotNull(), quoted(one)).otherwise(many)
    merged = merged.withColumn("b", b).withColumn("__json", _object(role=quoted(F.col("role")), content=content))
    return merged.groupBy("ctx_id").agg(_list(_ordered(F.col("__json"), "__g")).alias("payload")).join(_system(every), "ctx_id", "full")


def gemini(messages: DataFrame) -> DataFrame:
    """ctx_id, system, payload: assistants are models, tool results and calls are function parts; parts of equal roles in a row are merged."""
    def part(p: Column) -> Column:
        file = _object(fileData=_object(fileUri=quoted(p["url"]), mimeType=F.lit(f'"{MIME}"')))
        return F.when(is_text(p), _object(text=quoted(p["text"]))).when(p["type"] == "image_url", file).otherwise(_object(inlineData=_object(mimeType=quoted(_mime(p)), data=quoted(p["data"]))))

    text = _text()
    parsed = F.when(F.startswith(F.btrim(text, F.lit(" \t\r\n")), F.lit("{")), F.get_json_object(text, "$"))
    response = _object(functionResponse=_object(name=quoted(F.coalesce("name", F.lit(TOOL))), response=F.coalesce(parsed, _object(output=quoted(text)))))
    calls = _uses(lambda u: _object(functionCall=_object(name=quoted(u["name"]), args=u["input"])))
    parts = F.when(F.col("role") == "tool", F.array(response)).when(F.col("role") == "assistant", F.concat(_pieces(part), calls)).otherwise(_pieces(part))
    every = complete(messages)
    rows = _islands(every.filter("role <> 'system'").withColumn("__parts", parts), F.when(F.col("role") == "assistant", "model").otherwise("user"))
    merged = rows.groupBy("ctx_id", "__g").agg(F.any_value("__role").alias("role"), F.flatten(_ordered(F.col("__parts"), "pos")).alias("p"))
    merged = merged.withColumn("__json", _object(role=quoted(F.col("role")), parts=_list(F.col("p"))))
    body = merged.groupBy("ctx_id").agg(_list(_ordered(F.col("__json"), "__g")).alias("payload"))
    return body.join(_system(every).withColumn("system", _list(F.array(_object(text=quoted(F.col("system")))))), "ctx_id", "full")


def ollama(messages: DataFrame) -> DataFrame:
    """System messages first; a user's images apart from the text, with a note for those that are links; tool calls and tool names."""
    role, parts = F.col("role"), F.col("parts")
    lines = F.transform(F.filter(parts, lambda p: p["type"] != "image_base64"), lambda p: F.when(is_text(p), p["text"]).otherwise(F.concat(F.lit("[Image URL not sent to Ollama as base64; url="), p["url"], F.lit("]"))))
    images = F.transform(F.filter(parts, lambda p: p["type"] == "image_base64"), lambda p: quoted(p["data"]))
    user = role == "user"
    content = F.when(user & parts.isNotNull(), F.array_join(lines, "\n")).otherwise(_text())
    calls = _uses(lambda u: _object(function=_object(name=quoted(u["name"]), arguments=u["input"])))
    shown = F.when(role.isin("system", "user", "assistant", "tool"), role).otherwise("user")
    entry = _object(role=quoted(shown), content=quoted(content), images=F.when(user & (F.size(images) > 0), _list(images)), tool_calls=F.when((role == "assistant") & (F.size(calls) > 0), _list(calls)), tool_name=F.when(role == "tool", quoted(F.coalesce("name", F.lit(TOOL)))))
    return _system_first(complete(messages), entry)


@dataclass(frozen=True)
class Adapter:
    """A provider of a user's own: how messages are formatted, and optionally how texts and conversations are counted."""

    name: str
    format: Callable[[DataFrame], DataFrame]
    count: Callable[[Column], Column] | None = None
    overhead: tuple[int, int, int] | None = None


FORMATS: dict[str, Callable[[DataFrame], DataFrame]] = {"text": plain_text, "openai": openai, "mistral": mistral, "anthropic": anthropic, "gemini": gemini, "ollama": ollama}
ADAPTERS: dict[str, Adapter] = {}


def register_adapter(adapter: Adapter) -> None:
    """The last one registered under a name counts, before the built-in formats."""
    ADAPTERS[adapter.name] = adapter


def format_messages(messages: DataFrame, target: str) -> DataFrame:
    if target in ADAPTERS:
        return ADAPTERS[target].format(messages)
    if target not in FORMATS:
        raise ValueError(f"unknown format {target!r}; there are {sorted({*FORMATS, *ADAPTERS})}")
    return FORMATS[target](messages)
