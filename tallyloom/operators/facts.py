"""Facts: parsing, consolidation, decay and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

HALF_LIFE = 30 * 60_000
# Fixed value: the form of a FACT line.
_LINE = r"(?i)^\s*FACT:\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|\s*(.+?)(?:\s*\|\s*([0-9]*\.?[0-9]+))?\s*$"


def clamp(confidence: Column) -> Column:
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), confidence))


def parse_lines(texts: DataFrame) -> DataFrame:
    """A row for each FACT line of ``texts`` (id, text): subject, predicate, value and confidence (0.9 by default)."""
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.col("line").rlike(_LINE))
    group = lambda n: F.regexp_extract("line", _LINE, n)
    return lines.select("id", "line_no", group(1).alias("subject"), group(2).alias("predicate"), group(3).alias("value"), clamp(F.coalesce(F.nullif(group(4), F.lit("")).try_cast("double"), F.lit(0.9))).alias("confidence"))


def narrative(text: Column) -> Column:
    return F.btrim(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(_LINE)), "\n"), F.lit(" \n\t"))


def parse_json(texts: DataFrame) -> DataFrame:
    """A row for each complete fact in JSON arrays of facts."""
    kind = "array<struct<subject:string,predicate:string,value:string,confidence:double>>"
    f = texts.select("id", F.explode(F.from_json("text", kind)).alias("f")).select("id", "f.*").filter("subject is not null and predicate is not null and value is not null")
    return f.withColumn("confidence", clamp(F.coalesce("confidence", F.lit(0.9))))


def consolidate(facts: DataFrame) -> DataFrame:
    """Of the facts on one subject and predicate the surest, then the newest, then the first."""
    best = F.max_by(F.struct("value", "confidence", "created_at", "seq"), F.struct("confidence", "created_at", -F.col("seq")))
    return facts.groupBy("subject", "predicate").agg(best.alias("x")).select("subject", "predicate", "x.*")


def decayed(confidence: Column, created_at: Column, now: Column, half_life: float = HALF_LIFE) -> Column:
    if half_life <= 0:
        return confidence
    return confidence * F.pow(F.lit(0.5), F.greatest(F.lit(0), now - created_at) / half_life)


def render(facts: DataFrame, group: list[str], limit: int, lines: bool = False, by: str = "confidence") -> DataFrame:
    """One text for each group: facts by confidence (or ``strength``, see ``ranked``), newest first, up to the first that goes over ``limit`` characters."""
    if lines:
        piece, extra = F.concat_ws(" | ", F.concat(F.lit("FACT: "), F.col("subject")), "predicate", "value", F.col("confidence").cast("string")), 1
    else:
        piece, extra = F.concat(F.col("subject"), F.lit(" "), F.col("predicate"), F.lit(' "'), F.col("value"), F.lit('"')), 2
    order = W.partitionBy(*group).orderBy(F.desc(by), F.desc("created_at"), "seq")
    rows = facts.withColumn("piece", piece).withColumn("rank", F.row_number().over(order)).withColumn("run", F.sum(F.length("piece") + extra).over(order) + (0 if lines else len("Known facts: ") - extra))
    kept = rows.filter(F.col("run") <= limit)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "piece"))), lambda x: x["piece"]), "\n" if lines else "; ")
    return kept.groupBy(*group).agg((joined if lines else F.concat(F.lit("Known facts: "), joined)).alias("text"))


def candidates(items: DataFrame, last: int = 4, least: int = 24) -> DataFrame:
    """Sentences of a context's last messages of users and assistants that may be worth remembering."""
    back = F.row_number().over(W.partitionBy("ctx_id").orderBy(F.desc("seq")))
    tail = items.withColumn("__b", back).filter(F.col("__b") <= last).filter(F.col("role").isin("user", "assistant") & (F.length(F.btrim("text")) >= least))
    parts = tail.select("ctx_id", "seq", F.posexplode(F.split(F.btrim("text"), r"\.\s+|\n+")).alias("part", "sentence")).withColumn("sentence", F.btrim("sentence"))
    return parts.filter(F.length("sentence") >= least).withColumn("sentence", F.when(F.endswith("sentence", F.lit(".")), F.col("sentence")).otherwise(F.concat("sentence", F.lit("."))))


def to_remember(found: DataFrame, memories: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Candidates (ctx_id, seq, part, sentence) that no memory (id, content) says already.

    Similarity is that of word sets. Each distinct set is one row of either side: equal sets meet as they are, different ones by the signatures of ``similarity.signatures``.
    """
    from tallyloom.functions.text import set_similarity
    from tallyloom.operators.similarity import bare, signatures, word_hashes

    keys = ["ctx_id", "seq", "part"]
    sets = lambda rows, text: rows.select(*rows.columns, word_hashes(F.col(text)).alias("words")).withColumn("h", bare(F.xxhash64("words")))
    a, b = sets(found.select(*keys, "sentence"), "sentence"), sets(memories.select("content"), "content")
    wa, wb = (x.groupBy("h").agg(F.first("words").alias("words")) for x in (a, b))
    new = wa.join(wb.select("h"), "h", "left_anti")
    left, right = (signatures(x.withColumn("salt", F.lit(0).cast("bigint")), threshold) for x in (new, wb))
    marked = (F.col("l.h").bitwiseOR(F.col("r.h")).bitwiseAND(F.lit(1))) == 1
    pairs = left.alias("l").join(right.alias("r"), (F.col("l.sig") == F.col("r.sig")) & marked).select(bare(F.col("l.h")).alias("ha"), bare(F.col("r.h")).alias("hb")).distinct()
    near = pairs.join(new.select(F.col("h").alias("ha"), F.col("words").alias("wa")), "ha").join(wb.select(F.col("h").alias("hb"), F.col("words").alias("wb")), "hb")
    near = near.filter(set_similarity(F.col("wa"), F.col("wb")) >= threshold).select(F.col("ha").alias("h"))
    said = wb.select("h").unionByName(near)
    return found.join(a.join(said, "h", "left_semi").select(*keys), keys, "left_anti")


def ranked(facts: DataFrame, now: Column | None = None, half_life: float = HALF_LIFE) -> DataFrame:
    """``facts`` with strength, the order in which they are told: confidence, decayed up to ``now`` (by default the newest fact's time) if there is a half-life, then newest first."""
    newest = F.lit(facts.agg(F.max("created_at")).first()[0] or 0) if now is None else now
    value = decayed(F.col("confidence"), F.col("created_at"), newest, half_life)
    return facts.withColumn("strength", value)


def extracted(texts: DataFrame) -> DataFrame:
    """The facts of each of ``texts`` (id, text), an extractor's answers: a JSON array or object of facts, else FACT lines, else none."""
    kind = "array<struct<subject:string,predicate:string,value:string,confidence:double>>"
    array = F.startswith(F.btrim("text"), F.lit("["))
    held = F.from_json(F.when(array, F.col("text")).otherwise(F.get_json_object("text", "$.facts")), kind)
    json = F.filter(held, lambda f: f["subject"].isNotNull() & f["predicate"].isNotNull() & f["value"].isNotNull())
    rows = texts.withColumn("found", F.when(F.size(json) > 0, json))
    a = rows.filter("found is not null").select("id", F.posexplode("found").alias("line_no", "f")).select("id", "line_no", "f.subject", "f.predicate", "f.value", clamp(F.coalesce("f.confidence", F.lit(0.9))).alias("confidence"))
    return a.unionByName(parse_lines(rows.filter("found is null").select("id", "text")))
