"""Queries over token accounting, budgets and overflow policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import tokens as tk
from tallyloom.operators import budget as bd, overflow as ov
from tallyloom.plans.base import ITEMS, RAG, budgeted, chat_items, load, rag_items, with_query
from tallyloom.registry import register

KEY = ["ctx_id", "slot", "seq", "tokens"]


@register("tok_char_estimate", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CAST(ceil(length(text) / 3.5) AS BIGINT) AS fast, greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS tool_tokens FROM documents")
def tok_char_estimate(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", tk.char_estimate(F.length("text")).alias("tokens"), tk.fast_estimate(F.col("text")).alias("fast"), tk.text_estimate(F.col("text")).alias("tool_tokens"))


@register("tok_parts_estimate", "SELECT conv_id, turn, CAST(ceil((coalesce(length(text), 0) + 64 * (turn % 3)) / 4.0) AS BIGINT) AS tokens FROM conversations")
def tok_parts_estimate(spark, sf_dir):
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    image = F.array_repeat(part("image_url", F.lit("")), (F.col("turn") % 3).cast("int"))
    c = load(spark, sf_dir, "conversations").withColumn("parts", F.concat(F.array(part("text", F.col("text"))), image))
    return c.select("conv_id", "turn", tk.parts_estimate(F.col("parts")).alias("tokens"))


def _messages(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ctx_id"), "turn", "role", F.when(F.col("turn") % 4 == 1, F.concat(F.lit("n"), F.col("turn"))).alias("name"), F.coalesce("text", F.lit("")).alias("text"))


_MSG = "m AS (SELECT conv_id AS ctx_id, turn, role, CASE WHEN turn % 4 = 1 THEN 'n' || turn END AS name, coalesce(text, '') AS text FROM conversations), u AS (SELECT *, CAST(ceil(length(concat_ws(chr(10), role, name, text)) / 4.0) AS BIGINT) + 4 + (name IS NOT NULL)::INT AS units FROM m)"


@register("tok_message_units", with_query(_MSG, "SELECT ctx_id, turn, CAST(units AS BIGINT) AS units FROM u"))
def tok_message_units(spark, sf_dir):
    return tk.message_units(_messages(spark, sf_dir), "openai").select("ctx_id", "turn", "units")


@register("tok_conversation_units", with_query(_MSG, "SELECT ctx_id, CAST(sum(units) + 2 AS BIGINT) AS units FROM u GROUP BY ctx_id"))
def tok_conversation_units(spark, sf_dir):
    return tk.conversation_units(_messages(spark, sf_dir), "openai")


@register("tok_structural_overhead", with_query(_MSG, "SELECT ctx_id, CAST(2 + 4 * count(*) + count(name) AS BIGINT) AS overhead FROM m GROUP BY ctx_id"))
def tok_structural_overhead(spark, sf_dir):
    return tk.structural_overhead(_messages(spark, sf_dir), "mistral")


@register("tok_overheads", "SELECT * FROM (VALUES ('anthropic', 3, 1, 0), ('google', 4, 2, 0), ('mistral', 4, 2, 1), ('ollama', 4, 2, 1), ('openai', 4, 2, 1)) t(provider, per_message, per_conversation, per_name)")
def tok_overheads(spark, sf_dir):
    return tk.overhead_table(spark)


@register("tok_truncate_to_fit", "SELECT doc_id, text[1:400] AS text, CAST(ceil(least(length(text), 400) / 4.0) AS BIGINT) AS tokens FROM documents")
def tok_truncate_to_fit(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", tk.truncate_to_tokens(F.col("text"), 100).alias("text"))
    return d.withColumn("tokens", tk.char_estimate(F.length("text")))


@register("tok_count_cache", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def tok_count_cache(spark, sf_dir):
    return tk.counted_once(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "tokens")


@register("tok_slot_sums", with_query(ITEMS, "SELECT ctx_id, slot, CAST(sum(CASE WHEN seq % 3 = 0 THEN 0 ELSE tokens END) AS BIGINT) AS cached, CAST(sum(tokens) AS BIGINT) AS cached_or_estimated FROM items GROUP BY ALL"))
def tok_slot_sums(spark, sf_dir):
    i = chat_items(spark, sf_dir).withColumn("known", F.when(F.col("seq") % 3 != 0, F.col("tokens")))
    return i.groupBy("ctx_id", "slot").agg(F.sum(F.coalesce("known", F.lit(0))).alias("cached"), F.sum(F.coalesce("known", tk.payload_estimate(F.col("text"), F.expr("cast(null as array<struct<type:string,text:string>>)")))).alias("cached_or_estimated"))


_SLOTS = """slots AS (SELECT ctx_id, 900 + ctx_id % 7 * 100 AS total, s.* FROM (SELECT DISTINCT conv_id AS ctx_id FROM conversations),
  (VALUES ('system', 100, 'fixed', 100, NULL, NULL, NULL), ('tools', 80, 'percent', NULL, 20.0, NULL, NULL), ('memory', 60, 'flex', NULL, NULL, 10, 55), ('scratch', 60, 'flex', NULL, NULL, 10, 15), ('history', 50, 'flex', NULL, NULL, NULL, NULL)) s(slot, priority, budget_kind, fixed, percent, min, max))"""
# plain arithmetic for this layout: both bounded slots reach their maximum
_BUD_SQL = with_query(_SLOTS, """SELECT ctx_id, slot, CAST(CASE slot WHEN 'system' THEN 100 WHEN 'tools' THEN floor((total - 100) * 0.2) WHEN 'memory' THEN 55 WHEN 'scratch' THEN 15
  ELSE total - 100 - floor((total - 100) * 0.2) - 70 END AS BIGINT) AS allocated FROM slots""")


@register("bud_allocate", _BUD_SQL)
def bud_allocate(spark, sf_dir):
    return bd.allocate(budgeted(spark, sf_dir)).select("ctx_id", "slot", "allocated")


@register("bud_percent_bonus", """WITH t AS (SELECT i AS ctx_id, 1000 + i AS pool, (1000 + i) * 5 // 100 AS base FROM range(500) a(i))
SELECT ctx_id, 's' || k AS slot, CAST(base + (pool - 20 * base) // 20 + CASE WHEN k <= (pool - 20 * base) % 20 THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM t, range(1, 21) b(k)""")
def bud_percent_bonus(spark, sf_dir):
    slots = spark.range(500).select(F.col("id").alias("ctx_id"), (F.lit(1000) + F.col("id")).alias("total"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("k"))
    none = F.lit(None).cast("bigint")
    slots = slots.select("ctx_id", "total", F.concat(F.lit("s"), "k").alias("slot"), (F.lit(100) - F.col("k")).cast("int").alias("priority"), F.lit("percent").alias("budget_kind"), none.alias("fixed"), F.lit(5.0).alias("percent"), none.alias("min"), none.alias("max"))
    return bd.allocate(slots).select("ctx_id", "slot", "allocated")


@register("bud_errors", """SELECT * FROM (VALUES (1, 'a', NULL::BIGINT, 'fixed_exceeds_total'), (1, 'b', NULL, 'fixed_exceeds_total'), (2, 'a', NULL, 'percent_exceeds_100'), (2, 'b', NULL, 'percent_exceeds_100'), (3, 'a', NULL, 'min_exceeds_pool'), (3, 'b', NULL, 'min_exceeds_pool')) t(ctx_id, slot, allocated, error)""")
def bud_errors(spark, sf_dir):
    rows = [(1, 100, "a", 9, "fixed", 80, None, None, None), (1, 100, "b", 8, "fixed", 30, None, None, None), (2, 100, "a", 9, "percent", None, 80.0, None, None), (2, 100, "b", 8, "percent", None, 30.0, None, None), (3, 100, "a", 9, "fixed", 80, None, None, None), (3, 100, "b", 8, "flex", None, None, 30, None)]
    return bd.allocate(spark.createDataFrame(rows, "ctx_id int, total bigint, slot string, priority int, budget_kind string, fixed bigint, percent double, min bigint, max bigint")).select("ctx_id", "slot", "allocated", "error")


@register("bud_presets", """SELECT * FROM (VALUES ('chat','system',100),('chat','history',50),('rag','system',100),('rag','rag',80),('rag','history',50),('rag','output',40),('agent','system',100),('agent','tools',85),('agent','scratchpad',65),('agent','history',50)) t(preset, slot, priority)""")
def bud_presets(spark, sf_dir):
    out = None
    for name in bd.PRESETS:
        one = bd.preset(spark, name).select(F.lit(name).alias("preset"), "slot", "priority")
        out = one if out is None else out.unionByName(one)
    return out


@register("bud_merge", "SELECT * FROM (VALUES ('system', 100), ('history', 70), ('notes', 20)) t(slot, priority)")
def bud_merge(spark, sf_dir):
    over = spark.createDataFrame([("history", 70, "flex"), ("notes", 20, "flex")], "slot string, priority int, budget_kind string")
    return bd.merged_slots(bd.preset(spark, "chat"), over).select("slot", "priority")


@register("bud_what_if", with_query(ITEMS, "SELECT ctx_id, factor, round(least(1.0, used / greatest(1.0, 400 * factor)) * 100, 1) AS pct FROM (SELECT ctx_id, sum(tokens) AS used FROM items GROUP BY ctx_id), (VALUES (0.5::DOUBLE), (1.0), (2.0)) f(factor)"))
def bud_what_if(spark, sf_dir):
    used = chat_items(spark, sf_dir).groupBy("ctx_id").agg(F.sum("tokens").alias("used"))
    used = used.withColumn("factor", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))))
    return used.select("ctx_id", "factor", bd.utilisation(F.col("used"), F.lit(400), F.col("factor")).alias("pct"))


_SUMS = "sum(CASE WHEN pinned THEN tokens ELSE 0 END) OVER (PARTITION BY ctx_id, slot)"
_FREE = "sum(CASE WHEN pinned THEN 0 ELSE tokens END) OVER (PARTITION BY ctx_id, slot ORDER BY seq {})"


def _policy(frame: str, src: str = "items", budget: str = "120") -> str:
    return f"SELECT ctx_id, slot, seq, tokens FROM (SELECT *, {_SUMS} AS p, {_FREE.format(frame)} AS f FROM {src}) WHERE pinned OR p + f <= {budget}"


@register("ovf_truncate", with_query(ITEMS, _policy("ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING")))
def ovf_truncate(spark, sf_dir):
    return ov.truncate(chat_items(spark, sf_dir), F.lit(120)).select(*KEY)


@register("ovf_truncate_latest", with_query(ITEMS, _policy("ROWS UNBOUNDED PRECEDING")))
def ovf_truncate_latest(spark, sf_dir):
    return ov.truncate_latest(chat_items(spark, sf_dir), F.lit(120)).select(*KEY)


@register("ovf_sliding_window", with_query(ITEMS + ", w AS (SELECT * FROM items QUALIFY pinned OR count(*) FILTER (NOT pinned) OVER (PARTITION BY ctx_id, slot ORDER BY seq DESC) <= 3)", _policy("ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING", "w")))
def ovf_sliding_window(spark, sf_dir):
    return ov.sliding_window(chat_items(spark, sf_dir), F.lit(120), 3).select(*KEY)


@register("ovf_error", with_query(ITEMS, "SELECT ctx_id, slot, CAST(sum(tokens) AS BIGINT) AS used, 120 AS budget FROM items GROUP BY ALL HAVING sum(tokens) > 120"))
def ovf_error(spark, sf_dir):
    return ov.violations(chat_items(spark, sf_dir), F.lit(120))


@register("ovf_evictions", with_query(ITEMS + f", kept AS ({_policy('ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING')})", "SELECT ctx_id, slot, seq, 'overflow:truncate' AS reason FROM items ANTI JOIN kept USING (ctx_id, slot, seq)"))
def ovf_evictions(spark, sf_dir):
    items = chat_items(spark, sf_dir)
    return ov.evicted(items, ov.truncate(items, F.lit(120)), "truncate").select("ctx_id", "slot", "seq", "reason")


@register("ovf_escalate", with_query(ITEMS + """, parts AS (SELECT ctx_id, CASE WHEN pinned THEN 'system' ELSE 'history' || (seq % 3) END AS slot, seq, tokens, pinned FROM items),
s AS (SELECT ctx_id, slot, sum(tokens) AS used, sum(CASE WHEN pinned THEN 0 ELSE tokens END) AS free FROM parts GROUP BY ALL),
e AS (SELECT ctx_id, slot, slot <> 'history1' AND sum(used) OVER (PARTITION BY ctx_id) - coalesce(sum(CASE WHEN slot = 'history1' THEN 0 ELSE free END) OVER (PARTITION BY ctx_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 250 AS emptied FROM s)""",
    "SELECT ctx_id, slot, seq, tokens FROM parts JOIN e USING (ctx_id, slot) WHERE pinned OR NOT emptied"))
def ovf_escalate(spark, sf_dir):
    items = chat_items(spark, sf_dir).withColumn("slot", F.when(F.col("pinned"), "system").otherwise(F.concat(F.lit("history"), F.col("seq") % 3)))
    slots = items.select("ctx_id", "slot").distinct().withColumns({"priority": F.lit(10), "protected": F.col("slot") == "history1"})
    return ov.escalate(items, slots, F.lit(250)).select(*KEY)


@register("ovf_triggers", with_query(ITEMS + ", u AS (SELECT ctx_id, slot, CAST(sum(tokens) AS BIGINT) AS used FROM items GROUP BY ALL)", """SELECT ctx_id, slot, used, action, CAST(CASE action WHEN 'proactive' THEN floor(used * (1 - 0.3)) ELSE 300 END AS BIGINT) AS effective
FROM (SELECT *, CASE WHEN slot = 'system' AND used > 300 THEN 'protected' WHEN slot = 'system' THEN 'none' WHEN used > 300 THEN 'overflow' WHEN used > 210 THEN 'proactive' ELSE 'none' END AS action FROM u)"""))
def ovf_triggers(spark, sf_dir):
    used = chat_items(spark, sf_dir).groupBy("ctx_id", "slot").agg(F.sum("tokens").alias("used")).withColumns({"budget": F.lit(300), "overflow": F.lit("compress"), "protected": F.col("slot") == "system"})
    return ov.triggers(used, threshold=0.7).select("ctx_id", "slot", "used", "action", "effective")


@register("ovf_fallback_chain", with_query(ITEMS + ", h AS (SELECT *, sum(tokens) OVER (PARTITION BY ctx_id, slot) <= 120 AS fits FROM items), w AS (SELECT * FROM (SELECT * FROM h WHERE NOT fits) QUALIFY pinned OR count(*) FILTER (NOT pinned) OVER (PARTITION BY ctx_id, slot ORDER BY seq DESC) <= 2)", "SELECT ctx_id, slot, seq, tokens FROM h WHERE fits UNION ALL " + _policy("ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING", "w")))
def ovf_fallback_chain(spark, sf_dir):
    budget = F.lit(120)
    return ov.fallback_chain(chat_items(spark, sf_dir), budget, [lambda i: ov.sliding_window(i, F.lit(1 << 40), 2)]).select(*KEY)


@register("ovf_custom", with_query(ITEMS, "SELECT ctx_id, slot, seq, tokens FROM items QUALIFY row_number() OVER (PARTITION BY ctx_id, slot ORDER BY tokens DESC, seq) <= 2"))
def ovf_custom(spark, sf_dir):
    items = chat_items(spark, sf_dir).select(*KEY)
    return ov.custom(items, _two_largest)


def _two_largest(pdf):
    return pdf.sort_values(["tokens", "seq"], ascending=[False, True]).head(2)


@register("ovf_greedy_fit", with_query(ITEMS + """, r AS (SELECT *, row_number() OVER (PARTITION BY ctx_id ORDER BY seq) AS k FROM items),
fold(ctx_id, k, used, taken) AS (SELECT DISTINCT ctx_id, 0::BIGINT, 0::BIGINT, false FROM items
  UNION ALL SELECT r.ctx_id, r.k, CASE WHEN f.used + r.tokens <= 150 THEN f.used + r.tokens ELSE f.used END, f.used + r.tokens <= 150 FROM fold f JOIN r ON r.ctx_id = f.ctx_id AND r.k = f.k + 1)""".replace("WITH", ""), "SELECT r.ctx_id, slot, seq, tokens FROM r JOIN fold f ON r.ctx_id = f.ctx_id AND r.k = f.k WHERE f.taken").replace("WITH ", "WITH RECURSIVE ", 1))
def ovf_greedy_fit(spark, sf_dir):
    return ov.greedy_fit(chat_items(spark, sf_dir), 150, ["seq"], ["ctx_id"]).select(*KEY)


@register("ovf_error_rag", with_query(RAG, "SELECT ctx_id, slot, CAST(sum(tokens) AS BIGINT) AS used FROM rag GROUP BY ALL HAVING sum(tokens) > 20000"))
def ovf_error_rag(spark, sf_dir):
    return ov.violations(rag_items(spark, sf_dir), F.lit(20000)).select("ctx_id", "slot", "used")
