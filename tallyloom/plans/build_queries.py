"""Queries over compiled contexts, snapshots, formats, events, evaluation, the store and summarising policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import evaluation as ev, events as et, formats as fm, overflow as ov, retrieval as rt, snapshot as sn, summaries as su
from tallyloom.plans.base import ITEMS, chat_items, load, with_query
from tallyloom.registry import register
from tallyloom.sources import store

# ---- compile and snapshot ------------------------------------------------------------------------------------


def _chat(spark, sf_dir, budget=None):
    items = chat_items(spark, sf_dir)
    return items if budget is None else ov.truncate(items, F.lit(budget))


def _slots(items, budget=400):
    position = F.when(F.col("slot") == "system", "before").otherwise("after")
    slots = items.select("ctx_id").distinct().withColumn("slot", F.explode(F.array(F.lit("system"), F.lit("history"))))
    return slots.withColumns({"priority": F.when(F.col("slot") == "system", 100).otherwise(50), "position": position, "ord": F.lit(None).cast("double"), "budget": F.when(F.col("slot") == "system", 100).otherwise(budget).cast("bigint")})


def _messages(spark, sf_dir, budget=None):
    items = _chat(spark, sf_dir, budget)
    return sn.compile_messages(items, _slots(_chat(spark, sf_dir))).select("ctx_id", "pos", "role", "text", "slot", "seq")


def _compiled(name: str, src: str) -> str:
    return f"{name} AS (SELECT ctx_id, row_number() OVER (PARTITION BY ctx_id ORDER BY slot = 'history', seq) - 1 AS pos, role, text, slot, seq, tokens, pinned FROM {src})"


_KEPT = "{n} AS (SELECT * FROM (SELECT *, sum(CASE WHEN pinned THEN tokens ELSE 0 END) OVER (PARTITION BY ctx_id, slot) + sum(CASE WHEN pinned THEN 0 ELSE tokens END) OVER (PARTITION BY ctx_id, slot ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM items) WHERE pinned OR f <= {b})"
_M = f"{ITEMS}, {_compiled('m', 'items')}"
_TWO = f"{ITEMS}, {_KEPT.format(n='k3', b=300)}, {_KEPT.format(n='k6', b=600)}, {_compiled('a', 'k3')}, {_compiled('b', 'k6')}"


@register("snp_slot_order", "SELECT * FROM (VALUES ('system', 1), ('tools', 2), ('scratchpad', 3), ('history', 4)) t(slot, slot_pos)")
def snp_slot_order(spark, sf_dir):
    from tallyloom.operators.budget import preset

    return sn.slot_order(preset(spark, "agent").withColumn("ctx_id", F.lit(1))).select("slot", "slot_pos")


@register("snp_compile", with_query(_M, "SELECT ctx_id, pos, role, text, slot, seq FROM m"))
def snp_compile(spark, sf_dir):
    return _messages(spark, sf_dir)


_META = f"{ITEMS}, {_KEPT.format(n='k', b=400)}, s AS (SELECT DISTINCT ctx_id, t.slot, t.budget FROM items, (VALUES ('system', 100::BIGINT), ('history', 400)) t(slot, budget)), e AS (SELECT ctx_id, slot, count(*) AS evicted FROM items ANTI JOIN k USING (ctx_id, slot, seq) GROUP BY ALL), u AS (SELECT ctx_id, slot, sum(tokens) AS used, count(*) AS item_count FROM k GROUP BY ALL), meta AS (SELECT ctx_id, slot, budget, CAST(coalesce(used, 0) AS BIGINT) AS used, coalesce(item_count, 0) AS item_count, coalesce(evicted, 0) AS evicted FROM s LEFT JOIN u USING (ctx_id, slot) LEFT JOIN e USING (ctx_id, slot))"


def _meta(spark, sf_dir):
    items = _chat(spark, sf_dir)
    kept = ov.truncate(items, F.lit(400))
    return sn.slot_meta(kept, _slots(items), ov.evicted(items, kept, "truncate"))


@register("snp_slot_meta", with_query(_META, "SELECT *, round(used / budget, 6) AS utilisation FROM meta"))
def snp_slot_meta(spark, sf_dir):
    return _meta(spark, sf_dir).withColumn("utilisation", F.round("utilisation", 6))


@register("snp_build_meta", with_query(_META, "SELECT ctx_id, CAST(sum(used) AS BIGINT) AS used, CAST(sum(budget) AS BIGINT) AS budget, CAST(sum(greatest(0, budget - used)) AS BIGINT) AS waste, CAST(sum(evicted) AS BIGINT) AS evicted, round(sum(used) / sum(budget), 6) AS utilisation FROM meta GROUP BY ctx_id"))
def snp_build_meta(spark, sf_dir):
    return sn.build_meta(_meta(spark, sf_dir)).withColumn("utilisation", F.round("utilisation", 6))


_BODY = "s AS (SELECT ctx_id, '{\"version\":\"1.0\",\"id\":\"' || ctx_id || '\",\"messages\":[' || string_agg('{\"role\":' || to_json(role) || ',\"content\":' || to_json(text) || '}', ',' ORDER BY pos) || ']}' AS body FROM m GROUP BY ctx_id)"


@register("snp_serialize", with_query(f"{_M}, {_BODY}", "SELECT ctx_id, body, sha256(body) AS checksum FROM s"))
def snp_serialize(spark, sf_dir):
    return sn.serialise(_messages(spark, sf_dir))


@register("snp_deserialize", with_query(_M, "SELECT ctx_id, pos, role, text FROM m"))
def snp_deserialize(spark, sf_dir):
    return sn.deserialise(sn.serialise(_messages(spark, sf_dir)))


@register("snp_verify", with_query(ITEMS, "SELECT DISTINCT ctx_id, ctx_id % 2 = 1 AS ok FROM items"))
def snp_verify(spark, sf_dir):
    s = sn.serialise(_messages(spark, sf_dir)).withColumn("body", F.when(F.col("ctx_id") % 2 == 0, F.concat("body", F.lit(" "))).otherwise(F.col("body")))
    return s.select("ctx_id", sn.valid(F.col("body"), F.col("checksum")).alias("ok"))


@register("snp_migrate", "SELECT * FROM (VALUES (1, 'a', 50, 100, 0.5), (1, 'b', 300, 100, 1.0), (1, 'c', 5, 0, 0.0)) t(ctx_id, slot, used, budget, utilisation)")
def snp_migrate(spark, sf_dir):
    body = '{"version":"0.9","meta":{"slotStats":{"a":{"used":50,"budget":100},"b":{"used":300,"budget":100},"c":{"used":5,"budget":0}}}}'
    return sn.migrate(spark.createDataFrame([(1, body), (2, '{"version":"1.0"}')], "ctx_id int, body string"))


@register("snp_diff", with_query(_TWO, "SELECT ctx_id, pos, CASE WHEN a.role IS NULL THEN 'added' WHEN b.role IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b USING (ctx_id, pos) WHERE a.role IS NULL OR b.role IS NULL OR a.role <> b.role OR a.text <> b.text"))
def snp_diff(spark, sf_dir):
    return sn.diff(_messages(spark, sf_dir, 300), _messages(spark, sf_dir, 600))


@register("snp_shared", with_query(_TWO, "SELECT b.ctx_id, b.pos, coalesce(a.role = b.role AND a.text = b.text, false) AS unchanged FROM b LEFT JOIN a USING (ctx_id, pos)"))
def snp_shared(spark, sf_dir):
    return sn.shared(_messages(spark, sf_dir, 300), _messages(spark, sf_dir, 600)).select("ctx_id", "pos", "unchanged")


@register("snp_slots_modified", with_query(f"{ITEMS}, {_KEPT.format(n='k3', b=300)}, {_KEPT.format(n='k6', b=600)}", "SELECT ctx_id, slot FROM (SELECT ctx_id, slot, sum(tokens) AS u, count(*) AS n FROM k3 GROUP BY ALL) a FULL JOIN (SELECT ctx_id, slot, sum(tokens) AS u, count(*) AS n FROM k6 GROUP BY ALL) b USING (ctx_id, slot) WHERE a.u IS DISTINCT FROM b.u OR a.n IS DISTINCT FROM b.n"))
def snp_slots_modified(spark, sf_dir):
    slots = _slots(_chat(spark, sf_dir))
    return sn.slots_modified(sn.slot_meta(_chat(spark, sf_dir, 300), slots), sn.slot_meta(_chat(spark, sf_dir, 600), slots))


@register("snp_reuse", with_query(ITEMS, "SELECT DISTINCT ctx_id FROM items WHERE ctx_id % 3 = 0"))
def snp_reuse(spark, sf_dir):
    """Contexts to build anew: those whose fingerprint changed."""
    items = _chat(spark, sf_dir)
    changed = items.withColumn("text", F.when(F.col("ctx_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).withColumn("tokens", F.col("tokens") + 1)
    return sn.fingerprint(changed).join(sn.fingerprint(items), ["ctx_id", "fingerprint"], "left_anti").select("ctx_id")


# ---- formats -------------------------------------------------------------------------------------------------


@register("fmt_text", with_query(_M, "SELECT ctx_id, string_agg(text, E'\\n\\n' ORDER BY pos) AS payload FROM m WHERE text <> '' GROUP BY ctx_id"))
def fmt_text(spark, sf_dir):
    return fm.format_messages(_messages(spark, sf_dir), "text")


def _json_list(entry: str, order: str) -> str:
    return f"'[' || string_agg({entry}, ',' ORDER BY {order}) || ']'"


_PAIR = "'{{\"role\":' || to_json({r}) || ',\"content\":' || {t} || '}}'"


@register("fmt_openai", with_query(_M, f"""SELECT ctx_id, {_json_list(_PAIR.format(r='role', t="to_json(text)"), "role <> 'system', pos")} AS payload FROM m GROUP BY ctx_id"""))
def fmt_openai(spark, sf_dir):
    return fm.format_messages(_messages(spark, sf_dir), "openai")


@register("fmt_mistral", with_query(_M, f"""SELECT ctx_id, {_json_list(_PAIR.format(r='role', t="to_json(text)"), "role <> 'system', pos")} AS payload FROM m GROUP BY ctx_id"""))
def fmt_mistral(spark, sf_dir):
    return fm.format_messages(_messages(spark, sf_dir), "mistral")


@register("fmt_ollama", with_query(_M, f"SELECT ctx_id, {_json_list(_PAIR.format(r='role', t='to_json(text)'), 'pos')} AS payload FROM m GROUP BY ctx_id"))
def fmt_ollama(spark, sf_dir):
    return fm.format_messages(_messages(spark, sf_dir), "ollama")


_ISLES = """, r AS (SELECT ctx_id, pos, text, CASE WHEN role = 'assistant' THEN '{a}' ELSE 'user' END AS role FROM m WHERE role <> 'system'), l AS (SELECT *, coalesce((role <> lag(role) OVER (PARTITION BY ctx_id ORDER BY pos))::INT, 0) AS c FROM r), g AS (SELECT *, sum(c) OVER (PARTITION BY ctx_id ORDER BY pos) AS g FROM l)"""


@register("fmt_anthropic", with_query(_M + _ISLES.format(a="assistant") + ", c AS (SELECT ctx_id, g, any_value(role) AS role, string_agg(text, '' ORDER BY pos) AS content FROM g GROUP BY ctx_id, g), b AS (SELECT ctx_id, " + _json_list(_PAIR.format(r="role", t="to_json(content)"), "g") + " AS payload FROM c GROUP BY ctx_id)", "SELECT ctx_id, payload, system FROM b FULL JOIN (SELECT ctx_id, string_agg(text, E'\\n\\n' ORDER BY pos) AS system FROM m WHERE role = 'system' AND text <> '' GROUP BY ctx_id) s USING (ctx_id)"))
def fmt_anthropic(spark, sf_dir):
    return fm.format_messages(_messages(spark, sf_dir), "anthropic")


@register("fmt_gemini", with_query(_M + _ISLES.format(a="model") + ", c AS (SELECT ctx_id, g, any_value(role) AS role, " + _json_list("'{\"text\":' || to_json(text) || '}'", "pos") + " AS parts FROM g GROUP BY ctx_id, g), b AS (SELECT ctx_id, " + _json_list("'{\"role\":' || to_json(role) || ',\"parts\":' || parts || '}'", "g") + " AS payload FROM c GROUP BY ctx_id)", "SELECT ctx_id, payload, system FROM b FULL JOIN (SELECT ctx_id, " + _json_list("'{\"text\":' || to_json(text) || '}'", "pos") + " AS system FROM m WHERE role = 'system' AND text <> '' GROUP BY ctx_id) s USING (ctx_id)"))
def fmt_gemini(spark, sf_dir):
    return fm.format_messages(_messages(spark, sf_dir), "gemini")


# ---- events --------------------------------------------------------------------------------------------------


def _events(spark, sf_dir):
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("event_seq"), F.col("event_type").alias("type"), F.col("user_id").alias("key"), "value", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint").alias("ts_ms"))


_EV = "e AS (SELECT event_id AS event_seq, event_type AS type, user_id AS key, value, epoch_us(ts) // 1000 AS ts_ms FROM events)"


@register("evt_ring", with_query(_EV, "SELECT event_seq, type FROM e ORDER BY event_seq DESC LIMIT 500"))
def evt_ring(spark, sf_dir):
    return et.last_n(_events(spark, sf_dir), 500).select("event_seq", "type")


@register("evt_roll_up", with_query(_EV, "SELECT type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS top FROM e GROUP BY type"))
def evt_roll_up(spark, sf_dir):
    return et.roll_up(_events(spark, sf_dir)).withColumn("total", F.round("total", 4))


@register("evt_compression_ratio", with_query(ITEMS, "SELECT ctx_id, seq, round(CASE WHEN tokens > 0 THEN 1 - least(tokens, 40) / tokens ELSE 0 END, 6) AS ratio FROM items"))
def evt_compression_ratio(spark, sf_dir):
    return _chat(spark, sf_dir).select("ctx_id", "seq", F.round(et.compression_ratio(F.col("tokens"), F.least("tokens", F.lit(40))), 6).alias("ratio"))


def _two_types(spark, sf_dir):
    kinds = load(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").limit(2).collect()  # two names
    return [r[0] for r in kinds]


@register("evt_spans", with_query(_EV + ", k AS (SELECT DISTINCT type FROM e ORDER BY type LIMIT 2), t AS (SELECT e.*, type = (SELECT min(type) FROM k) AS opens FROM e WHERE type IN (SELECT type FROM k)), o AS (SELECT *, last_value(CASE WHEN opens THEN event_seq END IGNORE NULLS) OVER w AS start_seq, last_value(CASE WHEN opens THEN ts_ms END IGNORE NULLS) OVER w AS t0 FROM t WINDOW w AS (PARTITION BY key ORDER BY event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))", "SELECT key, start_seq, event_seq AS end_seq, ts_ms - t0 AS duration FROM o WHERE NOT opens AND start_seq IS NOT NULL"))
def evt_spans(spark, sf_dir):
    start, end = _two_types(spark, sf_dir)
    return et.spans(_events(spark, sf_dir), start, end)


@register("evt_histogram", with_query(_EV, "SELECT type, CAST(floor(value / 25) AS BIGINT) AS bucket, count(*) AS n FROM e GROUP BY ALL"))
def evt_histogram(spark, sf_dir):
    return et.histogram(_events(spark, sf_dir), F.col("value"), 25)


@register("evt_latest", with_query(_EV, "SELECT key, max(event_seq) AS event_seq, arg_max(type, event_seq) AS type, arg_max(value, event_seq) AS value FROM e GROUP BY key"))
def evt_latest(spark, sf_dir):
    return et.latest_per_key(_events(spark, sf_dir))


@register("evt_near_limit", with_query(ITEMS, "SELECT ctx_id, slot, count(*) AS n FROM items GROUP BY ALL HAVING count(*) >= 6"))
def evt_near_limit(spark, sf_dir):
    return et.near_limit(_chat(spark, sf_dir), 8)


@register("evt_summary", with_query(_EV, "SELECT event_seq, printf('%s %d: %.2f', type, key, value) AS text FROM e"))
def evt_summary(spark, sf_dir):
    return _events(spark, sf_dir).select("event_seq", et.summary_text(F.col("type"), F.col("key"), F.col("value")).alias("text"))


# ---- evaluation ----------------------------------------------------------------------------------------------

STRATEGIES, BUDGETS = ["truncate", "sliding-window", "compress", "semantic", "summarize"], [100, 200, 400, 800]
_RUNS = """q AS (SELECT conv_id, sum(CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT)) AS tokens FROM conversations GROUP BY conv_id),
runs AS (SELECT 'q' || conv_id || CASE WHEN conv_id % 6 = 0 THEN '_abs' ELSE '' END AS question_id, CASE WHEN conv_id % 6 = 0 THEN 'Abstention' ELSE 'type' || (conv_id % 6) END AS category, strategy, budget, least(tokens, budget) AS actual_tokens, (conv_id * 7 + budget) % 50 AS build_ms,
 conv_id % 3 AS llm_requests, tokens <= budget * (1 + len(strategy) % 3) AS correct, CASE WHEN conv_id % 17 = 0 THEN 'ERROR x' ELSE 'a' END AS answer FROM q, (VALUES ('truncate'), ('sliding-window'), ('compress'), ('semantic'), ('summarize')) s(strategy), (VALUES (100), (200), (400), (800)) b(budget))"""


def _runs(spark, sf_dir):
    q = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4)).alias("tokens"))
    q = q.withColumn("question_id", F.concat(F.lit("q"), "conv_id", F.when(F.col("conv_id") % 6 == 0, "_abs").otherwise("")))
    m = ev.matrix(q, STRATEGIES, BUDGETS)
    return m.withColumns({"category": ev.category(F.col("question_id"), F.concat(F.lit("type"), F.col("conv_id") % 6)), "actual_tokens": F.least("tokens", "budget"), "build_ms": (F.col("conv_id") * 7 + F.col("budget")) % 50, "llm_requests": F.col("conv_id") % 3, "correct": F.col("tokens") <= F.col("budget") * (1 + F.length("strategy") % 3), "answer": F.when(F.col("conv_id") % 17 == 0, "ERROR x").otherwise("a")})


_CELLS = ", ".join(f'round(100 * avg(correct::INT) FILTER (budget = {b}), 1) AS "{b}"' for b in BUDGETS)


@register("evl_matrix", with_query(_RUNS, "SELECT question_id, strategy, budget FROM runs WHERE NOT (strategy = 'truncate' AND budget = 100)"))
def evl_matrix(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    done = runs.filter("strategy = 'truncate' AND budget = 100").select("question_id", "strategy", "budget")
    return ev.matrix(runs.select("question_id").distinct(), STRATEGIES, BUDGETS, done)


@register("evl_accuracy", with_query(_RUNS, f"SELECT strategy, {_CELLS} FROM runs GROUP BY strategy"))
def evl_accuracy(spark, sf_dir):
    return ev.accuracy_table(_runs(spark, sf_dir), BUDGETS)


@register("evl_accuracy_by_category", with_query(_RUNS, f"SELECT category, strategy, {_CELLS} FROM runs GROUP BY ALL"))
def evl_accuracy_by_category(spark, sf_dir):
    return ev.accuracy_table(_runs(spark, sf_dir), BUDGETS, ["category"])


@register("evl_efficiency", with_query(_RUNS, "SELECT strategy, budget, round(avg(actual_tokens), 6) AS avg_tokens, round(avg(build_ms), 6) AS avg_build_ms, CAST(sum(llm_requests) AS BIGINT) AS llm_requests FROM runs GROUP BY ALL"))
def evl_efficiency(spark, sf_dir):
    return ev.efficiency(_runs(spark, sf_dir))


@register("evl_summary", with_query(_RUNS, "SELECT count(DISTINCT question_id) AS questions, count(*) AS runs, count(*) FILTER (starts_with(answer, 'ERROR')) AS errors FROM runs"))
def evl_summary(spark, sf_dir):
    return ev.summary(_runs(spark, sf_dir))


@register("evl_judge", with_query(_RUNS, "SELECT question_id, strategy, budget, NOT starts_with(answer, 'ERROR') AND correct AS ok FROM runs"))
def evl_judge(spark, sf_dir):
    verdict = F.when(F.col("correct"), " yes, it is").otherwise("no")
    return _runs(spark, sf_dir).select("question_id", "strategy", "budget", ev.judged(verdict, F.col("answer")).alias("ok"))


@register("evl_retained", with_query(f"{ITEMS}, {_KEPT.format(n='k', b=200)}, a AS (SELECT ctx_id, arg_min(text, seq) AS answer FROM items WHERE role = 'user' GROUP BY ctx_id)", "SELECT ctx_id, coalesce(bool_or(k.text = answer), false) AS exact, coalesce(bool_or(contains(k.text, answer[1:100])), false) AS part, coalesce(bool_or(contains(lower(k.text), lower(answer))), false) AS present FROM a LEFT JOIN k USING (ctx_id) GROUP BY ctx_id"))
def evl_retained(spark, sf_dir):
    items = _chat(spark, sf_dir)
    answers = items.filter("role = 'user'").groupBy("ctx_id").agg(F.min_by("text", "seq").alias("answer"))
    return ev.retained(answers, _chat(spark, sf_dir, 200))


_TRACE = ITEMS + """, x AS (SELECT ctx_id, row_number() OVER (PARTITION BY ctx_id ORDER BY seq) AS step, CAST(sum(tokens) OVER (PARTITION BY ctx_id ORDER BY seq) AS BIGINT) AS total FROM items), z AS (SELECT ctx_id, total FROM x UNION ALL SELECT DISTINCT ctx_id, 0 FROM x),
s AS (SELECT x.ctx_id, x.step, x.total, x.total - min(z.total) FILTER (z.total <= x.total AND x.total - z.total <= 300) AS kept, x.total > 300 AS overflow FROM x JOIN z ON z.ctx_id = x.ctx_id GROUP BY x.ctx_id, x.step, x.total), t AS (SELECT *, kept / 300 AS utilisation FROM s)"""


@register("evl_trace", with_query(_TRACE, "SELECT * REPLACE (round(utilisation, 6) AS utilisation) FROM t"))
def evl_trace(spark, sf_dir):
    return ev.trace(_chat(spark, sf_dir), 300).withColumn("utilisation", F.round("utilisation", 6))


@register("evl_trace_report", with_query(_TRACE + ", r AS (SELECT *, coalesce(lag(kept) OVER (PARTITION BY ctx_id ORDER BY step) - kept, 0) AS d, min(step) FILTER (overflow) OVER (PARTITION BY ctx_id) AS f FROM t)", """SELECT *, CASE WHEN first_overflow IS NULL THEN 'never' WHEN first_overflow / steps < 0.25 THEN 'early' WHEN first_overflow / steps < 0.5 THEN 'first half' WHEN first_overflow / steps < 0.75 THEN 'second half' ELSE 'late' END AS position FROM (SELECT ctx_id, any_value(f) AS first_overflow, round(min(utilisation), 6) AS low, round(max(utilisation), 6) AS high, round(avg(utilisation), 6) AS mean, round(arg_max(utilisation, step), 6) AS final,
 CASE WHEN count(*) FILTER (f IS NULL OR step < f) >= 2 THEN round((arg_max(kept, step) FILTER (f IS NULL OR step < f) - arg_min(kept, step) FILTER (f IS NULL OR step < f)) / (count(*) FILTER (f IS NULL OR step < f) - 1), 6) ELSE 0.0 END AS growth, CASE WHEN count(*) FILTER (overflow) >= 2 THEN round(var_pop(utilisation) FILTER (overflow), 6) ELSE 0.0 END AS variance,
 greatest(0, max(d)) AS largest_drop, first(step ORDER BY d DESC, step) FILTER (d > 0) AS drop_step, count(*) AS steps FROM r GROUP BY ctx_id)"""))
def evl_trace_report(spark, sf_dir):
    return ev.trace_report(ev.trace(_chat(spark, sf_dir), 300))


@register("evl_latencies", with_query(_EV, "SELECT type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_disc(value, 0.95), 6) AS p95_rank FROM e GROUP BY type"))
def evl_latencies(spark, sf_dir):
    return ev.latencies(_events(spark, sf_dir), ["type"], "value")


@register("evl_regressions", with_query(_EV + ", b AS (SELECT key, avg(value) AS old FROM e WHERE event_seq % 2 = 0 AND key % 10 <> 1 GROUP BY key), c AS (SELECT key, avg(value) AS new FROM e WHERE event_seq % 2 = 1 AND key % 10 <> 2 GROUP BY key)", "SELECT key, round(new / nullif(old, 0), 6) AS ratio, CASE WHEN old IS NULL THEN 'new' WHEN new IS NULL THEN 'removed' WHEN new / nullif(old, 0) > 1.2 THEN 'alert' WHEN new / nullif(old, 0) < 1 / 1.2 THEN 'faster' ELSE 'ok' END AS status FROM b FULL JOIN c USING (key)"))
def evl_regressions(spark, sf_dir):
    e = _events(spark, sf_dir)
    mean = lambda part, gone: e.filter(f"event_seq % 2 = {part} AND key % 10 <> {gone}").groupBy("key").agg(F.avg("value").alias("mean"))
    return ev.regressions(mean(0, 1), mean(1, 2))


# ---- store ---------------------------------------------------------------------------------------------------


@register("src_append", with_query(ITEMS, "SELECT ctx_id, slot, seq FROM items UNION ALL SELECT ctx_id, slot, m + row_number() OVER (PARTITION BY ctx_id, slot ORDER BY seq) FROM (SELECT *, max(seq) OVER (PARTITION BY ctx_id, slot) AS m, count(*) OVER (PARTITION BY ctx_id, slot) AS n FROM items) QUALIFY n + row_number() OVER (PARTITION BY ctx_id, slot ORDER BY seq) <= 8"))
def src_append(spark, sf_dir):
    items = _chat(spark, sf_dir)
    return store.append(items, items, ["system", "history"], 8)[0].select("ctx_id", "slot", "seq")


@register("src_refused", with_query(ITEMS, "SELECT ctx_id, slot, seq, CASE WHEN slot = 'system' THEN 'unknown_slot' ELSE 'max_items' END AS reason FROM (SELECT *, count(*) OVER (PARTITION BY ctx_id, slot) AS n FROM items) QUALIFY slot = 'system' OR n + row_number() OVER (PARTITION BY ctx_id, slot ORDER BY seq) > 8"))
def src_refused(spark, sf_dir):
    items = _chat(spark, sf_dir)
    refused = store.append(items, items.withColumn("was", F.col("seq")), ["history"], 8)[1]
    return refused.select("ctx_id", "slot", F.col("was").alias("seq"), "reason")


@register("src_remove", with_query(ITEMS, "SELECT ctx_id, slot, seq FROM items WHERE seq % 3 <> 1"))
def src_remove(spark, sf_dir):
    items = _chat(spark, sf_dir)
    return store.remove(items, items.filter("seq % 3 = 1")).select("ctx_id", "slot", "seq")


@register("src_pin_ephemeral", with_query(ITEMS, "SELECT ctx_id, slot, seq, pinned OR seq % 4 = 1 AS pinned FROM items WHERE seq % 4 <> 2"))
def src_pin_ephemeral(spark, sf_dir):
    items = _chat(spark, sf_dir)
    marked = store.mark_ephemeral(store.pin(items, items.filter("seq % 4 = 1")), items.filter("seq % 4 = 2"))
    return store.clear_ephemeral(marked).select("ctx_id", "slot", "seq", "pinned")


@register("src_write_back", with_query(ITEMS, "SELECT ctx_id, slot, seq, CASE WHEN seq % 2 = 0 THEN tokens * 2 ELSE tokens END AS tokens FROM items"))
def src_write_back(spark, sf_dir):
    items = _chat(spark, sf_dir)
    return store.write_back_tokens(items, items.filter("seq % 2 = 0").withColumn("tokens", F.col("tokens") * 2)).select("ctx_id", "slot", "seq", "tokens")


@register("src_signatures", with_query(ITEMS, "SELECT DISTINCT ctx_id, slot FROM items WHERE slot = 'history' AND ctx_id % 5 = 0"))
def src_signatures(spark, sf_dir):
    """Slots that changed between two versions of the items."""
    items = _chat(spark, sf_dir)
    new = items.withColumn("text", F.when((F.col("slot") == "history") & (F.col("ctx_id") % 5 == 0), F.upper(F.concat("text", F.lit("x")))).otherwise(F.col("text")))
    both = sn.slot_signatures(new).join(sn.slot_signatures(items).withColumnRenamed("signature", "old"), ["ctx_id", "slot"], "full")
    return both.filter(~F.col("signature").eqNullSafe(F.col("old"))).select("ctx_id", "slot")


@register("src_pending", with_query(ITEMS, "SELECT ctx_id, slot, seq FROM items WHERE ctx_id % 2 = 1"))
def src_pending(spark, sf_dir):
    items = _chat(spark, sf_dir).select("ctx_id", "slot", "seq")
    return store.pending(items, items.filter("ctx_id % 2 = 0"), ["ctx_id", "slot", "seq"])


# ---- summarising policies ------------------------------------------------------------------------------------


@register("sum_preserved_tail", with_query(ITEMS + ", w AS (SELECT ctx_id, slot, row_number() OVER o AS i, sum(tokens) OVER o AS c FROM items WINDOW o AS (PARTITION BY ctx_id, slot ORDER BY seq DESC))", "SELECT ctx_id, slot, greatest(4, coalesce(min(i) FILTER (i >= 5 AND c > 300), count(*) + 1) - 1) AS keep_last FROM w GROUP BY ALL"))
def sum_preserved_tail(spark, sf_dir):
    return su.preserved_tail(_chat(spark, sf_dir), 600)


_ZONES = ITEMS + ", z AS (SELECT *, pinned OR count(*) FILTER (NOT pinned) OVER (PARTITION BY ctx_id, slot ORDER BY created_at DESC, seq DESC) <= 3 AS recent FROM items), y AS (SELECT *, row_number() OVER (PARTITION BY ctx_id, slot, recent ORDER BY created_at, seq) AS p, count(*) OVER (PARTITION BY ctx_id, slot, recent) AS n FROM z)"


@register("sum_zones", with_query(_ZONES, "SELECT ctx_id, slot, seq, CASE WHEN recent THEN 'recent' WHEN p <= n // 2 THEN 'old' ELSE 'middle' END AS zone FROM y"))
def sum_zones(spark, sf_dir):
    return su.zones(_chat(spark, sf_dir), 3).select("ctx_id", "slot", "seq", "zone")


_FOLD = """, r AS (SELECT *, row_number() OVER (PARTITION BY ctx_id, slot ORDER BY seq) AS k FROM items), fold(ctx_id, slot, k, chunk, used) AS (SELECT ctx_id, slot, k, 0, tokens FROM r WHERE k = 1 UNION ALL
SELECT r.ctx_id, r.slot, r.k, CASE WHEN f.used + r.tokens > 150 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.used + r.tokens > 150 THEN r.tokens ELSE f.used + r.tokens END FROM fold f JOIN r ON r.ctx_id = f.ctx_id AND r.slot = f.slot AND r.k = f.k + 1)"""


@register("sum_chunks", with_query(ITEMS + _FOLD, "SELECT r.ctx_id, r.slot, r.seq, f.chunk FROM fold f JOIN r USING (ctx_id, slot, k)").replace("WITH ", "WITH RECURSIVE ", 1))
def sum_chunks(spark, sf_dir):
    return su.next_fit(_chat(spark, sf_dir), 150, ["ctx_id", "slot"]).select("ctx_id", "slot", "seq", "chunk")


@register("sum_caps", "SELECT b AS budget, s AS summary, CAST(floor(s * 0.55) AS BIGINT) AS layer2, CAST(floor(s * 0.45) AS BIGINT) AS layer1, CAST(floor(s * 0.15) AS BIGINT) AS layer3, CAST(least(8192, greatest(2048, floor(b * 0.15))) AS BIGINT) AS segment FROM (SELECT b, CAST(greatest(64, floor(b * 0.15)) AS BIGINT) AS s FROM (SELECT i * 997 AS b FROM range(200) t(i)))")
def sum_caps(spark, sf_dir):
    return spark.range(200).select((F.col("id") * 997).alias("budget")).select("budget", *su.caps(F.col("budget")))


@register("sum_split", "SELECT doc_id, n, text[n * 400 + 1 : n * 400 + 400] AS part FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil(length(text) / 400.0) AS BIGINT)))) AS n FROM documents)")
def sum_split(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.posexplode(su.split_to_budget(F.col("text"), 100)).alias("n", "part"))


@register("sum_progressive")
def sum_progressive(spark, sf_dir):
    return su.progressive(_chat(spark, sf_dir), 300).drop("summarizes")


@register("sum_map_reduce")
def sum_map_reduce(spark, sf_dir):
    return su.map_reduce(_chat(spark, sf_dir), 150).drop("summarizes")


# ---- models and whole builds ---------------------------------------------------------------------------------

MODELS = ["gpt-4o-mini", " GPT-5.4-mini ", "gpt-5.4-x", "o1-preview", "o1-mini", "claude-sonnet-4-6", "claude-next", "gemini-2.0-pro", "my-mixtral", "mistral-medium-latest", "ollama/phi", "ollama/llama3.1", "gpt-4.1-nano", "gpt-4-0613", "unknown", "house-model"]
_KNOWN = [128000, 400000, 1050000, 200000, 128000, 1000000, 200000, 2000000, 256000, 32000, 8192, 131072, 1000000, 8192, None, 5000]
_WHO = ["openai"] * 5 + ["anthropic"] * 2 + ["google", "mistral", "mistral", "ollama", "ollama", "openai", "openai", None, "me"]
_OUT = [None if n is None else 65536 if n >= 512000 else 16384 if n >= 32000 else min(4096, max(1024, n - 1)) for n in _KNOWN]
_sql = lambda v: "NULL" if v is None else repr(v)


@register("bud_models", "SELECT * FROM (VALUES " + ", ".join(f"({m!r}, {_sql(w)}, CAST({_sql(n)} AS BIGINT), CAST({_sql(o)} AS BIGINT))" for m, w, n, o in zip(MODELS, _WHO, _KNOWN, _OUT)) + ") t(model, provider, max_tokens, max_output)")
def bud_models(spark, sf_dir):
    from tallyloom.operators import models

    df = spark.createDataFrame([(m, None) for m in MODELS], "model string, max_tokens bigint")
    out = models.inferred(df, [("house-model", "me", 5000)])
    return out.withColumn("max_output", F.when(F.col("max_tokens").isNotNull(), models.max_output(F.col("max_tokens")))).select("model", "provider", "max_tokens", "max_output")


@register("bud_overrides", "SELECT DISTINCT conv_id AS ctx_id, CASE WHEN conv_id % 3 = 0 THEN 500 ELSE 8192 END AS max_tokens, 100 AS reserve, greatest(0, CASE WHEN conv_id % 3 = 0 THEN 500 ELSE 8192 END - 100) AS total FROM conversations")
def bud_overrides(spark, sf_dir):
    from tallyloom.operators import budget, models

    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ctx_id")).distinct().withColumns({"max_tokens": F.lit(8192), "reserve": F.lit(100)})
    o = c.filter("ctx_id % 3 = 0").select("ctx_id", F.lit(500).alias("max_tokens"), F.lit(None).cast("int").alias("reserve"))
    out = models.overridden(c, o, ["ctx_id"], ["max_tokens", "reserve"])
    return out.withColumn("total", budget.total_budget(F.col("max_tokens"), F.col("reserve")))


@register("build_chat", with_query(f"{ITEMS}, {_KEPT.format(n='k', b=300)}, {_compiled('m', 'k')}", "SELECT ctx_id, pos, role, text, slot, seq FROM m"))
def build_chat(spark, sf_dir):
    """A whole build: allocation, overflow, escalation and compilation."""
    from tallyloom.plans.context import ContextPlan

    plan = ContextPlan().tokens(600).slot("system", 100, budget_kind="fixed", fixed=300, position="before").slot("history", 50)
    return plan.build(_chat(spark, sf_dir)).messages.select("ctx_id", "pos", "role", "text", "slot", "seq")


@register("build_chat_meta", with_query(f"{ITEMS}, {_KEPT.format(n='k', b=300)}", "SELECT c.ctx_id, c.slot, 300::BIGINT AS budget, CAST(coalesce(sum(k.tokens), 0) AS BIGINT) AS used, count(k.seq) AS item_count FROM (SELECT DISTINCT ctx_id, s.slot FROM items, (VALUES ('system'), ('history')) s(slot)) c LEFT JOIN k ON k.ctx_id = c.ctx_id AND k.slot = c.slot GROUP BY ALL"))
def build_chat_meta(spark, sf_dir):
    from tallyloom.plans.context import ContextPlan

    plan = ContextPlan().tokens(600).slot("system", 100, budget_kind="fixed", fixed=300, position="before").slot("history", 50)
    return plan.build(_chat(spark, sf_dir)).meta.select("ctx_id", "slot", "budget", "used", "item_count")
