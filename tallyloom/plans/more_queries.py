"""Queries over content and tools, memory injection, payloads of tool and image messages, counting, events of builds and the remaining policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as tx, tokens as tk
from tallyloom.operators import budget as bd, compression as cm, content as ct, evaluation as ev, events as et, facts as fc, formats as fm, models as md, overflow as ov, retrieval as rt, semantic as sm, similarity as sy, snapshot as sn
from tallyloom.plans.base import FACTS, ITEMS, RAG, chat_items, facts, load, rag_items, with_query
from tallyloom.plans.build_queries import _KEPT, _TWO, _compiled, _messages, _META, _meta
from tallyloom.plans.content_queries import _COMPRESSED, _JACC, _LINES, _SPACE, _VEC, _WORDS, _texts, _TEXTS, _vectors
from tallyloom.registry import register
from tallyloom.shipping import ship_package

RECURSIVE = ("WITH ", "WITH RECURSIVE ", 1)

# ---- similar texts -------------------------------------------------------------------------------------------

_LISTS = "list_distinct(string_split({x}, ' '))"
_SETS = "len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))".format(a=_LISTS.format(x="f.a"), b=_LISTS.format(x="r.a"))
_SIM = f"CASE WHEN f.a = r.a THEN 1.0 WHEN f.a = '' OR r.a = '' THEN 0.0 WHEN greatest(length(f.a), length(r.a)) <= 160 THEN greatest({_SETS}, 1 - levenshtein(f.a, r.a) / greatest(length(f.a), length(r.a))) ELSE {_SETS} END"
_CONSECUTIVE = ITEMS + rf""", r AS (SELECT ctx_id, slot, seq, role, trim(regexp_replace(lower(regexp_replace(text, '[^ -~]', ' ', 'g')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS a, row_number() OVER (PARTITION BY ctx_id, slot ORDER BY seq) AS k FROM items),
fold(ctx_id, slot, k, role, a, kept) AS (SELECT ctx_id, slot, k, role, a, true FROM r WHERE k = 1 UNION ALL
SELECT ctx_id, slot, k, CASE WHEN same THEN old_role ELSE role END, CASE WHEN same THEN old_a ELSE a END, NOT same FROM (SELECT r.ctx_id, r.slot, r.k, r.role, r.a, f.role AS old_role, f.a AS old_a, f.role = r.role AND {_SIM} >= {{t}} AS same FROM fold f JOIN r ON r.ctx_id = f.ctx_id AND r.slot = f.slot AND r.k = f.k + 1))"""


def _deduped(spark, sf_dir, threshold):
    items = chat_items(spark, sf_dir).withColumn("comparable", tx.comparable(F.regexp_replace("text", "[^ -~]", " ")))  # DuckDB's edit distance counts bytes
    return sy.drop_consecutive(items, threshold).select("ctx_id", "slot", "seq")


@register("los_dedupe_consecutive", with_query(_CONSECUTIVE.replace("{t}", "0.92"), "SELECT r.ctx_id, r.slot, r.seq FROM fold f JOIN r USING (ctx_id, slot, k) WHERE f.kept").replace(*RECURSIVE))
def los_dedupe_consecutive(spark, sf_dir):
    return _deduped(spark, sf_dir, 0.92)


@register("los_dedupe_loose", with_query(_CONSECUTIVE.replace("{t}", "0.3"), "SELECT r.ctx_id, r.slot, r.seq FROM fold f JOIN r USING (ctx_id, slot, k) WHERE f.kept").replace(*RECURSIVE))
def los_dedupe_loose(spark, sf_dir):
    """The same fold where many items fall."""
    return _deduped(spark, sf_dir, 0.3)


_CLASSES = f"w AS (SELECT ctx_id, seq, list_sort({_WORDS.format('text')}) AS ws FROM rag), cl AS (SELECT *, min(seq) OVER (PARTITION BY ctx_id, ws) AS c FROM w), p AS (SELECT a.ctx_id, a.seq AS a, b.seq AS b, a.ws AS wa, b.ws AS wb FROM cl a JOIN cl b ON a.ctx_id = b.ctx_id AND a.seq < b.seq AND a.seq = a.c AND b.seq = b.c), s AS (SELECT ctx_id, a, b, {_JACC} AS similarity FROM p)"


@register("rag_similar_pairs", with_query(f"{RAG}, {_CLASSES}", "SELECT ctx_id, a, b, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.88 UNION ALL SELECT ctx_id, c, seq, 1.0 FROM cl WHERE seq <> c"))
def rag_similar_pairs(spark, sf_dir):
    return sy.similar_pairs(rag_items(spark, sf_dir), 0.88).withColumn("similarity", F.round("similarity", 6))


_GREEDY = f"{RAG}, w AS (SELECT ctx_id, seq, {_WORDS.format('text')} AS ws, row_number() OVER (PARTITION BY ctx_id ORDER BY seq) AS k FROM rag), p AS (SELECT a.ctx_id, a.seq AS a, b.seq AS b, a.ws AS wa, b.ws AS wb FROM w a JOIN w b ON a.ctx_id = b.ctx_id AND a.seq < b.seq), s AS (SELECT ctx_id, b, list(a) AS partners FROM (SELECT *, {_JACC} AS similarity FROM p) WHERE similarity >= 0.88 GROUP BY ctx_id, b), n AS (SELECT w.ctx_id, w.seq, w.k, coalesce(s.partners, []) AS partners FROM w LEFT JOIN s ON s.ctx_id = w.ctx_id AND s.b = w.seq), fold(ctx_id, k, kept) AS (SELECT ctx_id, k, [seq] FROM n WHERE k = 1 UNION ALL SELECT n.ctx_id, n.k, CASE WHEN list_has_any(f.kept, n.partners) THEN f.kept ELSE list_append(f.kept, n.seq) END FROM fold f JOIN n ON n.ctx_id = f.ctx_id AND n.k = f.k + 1)"


@register("rag_dedupe", with_query(_GREEDY, "SELECT ctx_id, unnest(kept) AS seq FROM (SELECT ctx_id, arg_max(kept, k) AS kept FROM fold GROUP BY ctx_id)").replace(*RECURSIVE))
def rag_dedupe(spark, sf_dir):
    return sy.drop_near_duplicates(rag_items(spark, sf_dir), 0.88).select("ctx_id", "seq")


_SELECT = _VEC + """, x AS (SELECT v.*, list_cosine_similarity(vector, anchor) AS sim FROM v JOIN a USING (ctx_id)), r AS (SELECT *, row_number() OVER (PARTITION BY ctx_id ORDER BY sim DESC, created_at, seq) AS k FROM x WHERE NOT pinned AND sim >= {t}),
base AS (SELECT ctx_id, sum(CASE WHEN pinned THEN tokens ELSE 0 END) AS used FROM x GROUP BY ctx_id), fold(ctx_id, k, used, taken) AS (SELECT ctx_id, 0::BIGINT, CAST(used AS BIGINT), false FROM base UNION ALL
SELECT r.ctx_id, r.k, CASE WHEN f.used + r.tokens <= 150 THEN f.used + r.tokens ELSE f.used END, f.used + r.tokens <= 150 FROM fold f JOIN r ON r.ctx_id = f.ctx_id AND r.k = f.k + 1)"""
_TAKEN = "SELECT ctx_id, seq, tokens, round(sim, 6) AS sim FROM x WHERE pinned UNION ALL SELECT r.ctx_id, r.seq, r.tokens, round(r.sim, 6) FROM r JOIN fold f USING (ctx_id, k) WHERE f.taken"


@register("sem_select", with_query(_SELECT.format(t="0"), _TAKEN).replace(*RECURSIVE))
def sem_select(spark, sf_dir):
    v, a = _vectors(spark, sf_dir)
    return sm.select(v, a, 150).select("ctx_id", "seq", "tokens", F.round("sim", 6).alias("sim"))


@register("sem_select_adaptive", with_query(_SELECT.format(t="(SELECT avg(y.sim) + stddev_pop(y.sim) FROM x y WHERE y.ctx_id = x.ctx_id AND NOT y.pinned)"), _TAKEN).replace(*RECURSIVE))
def sem_select_adaptive(spark, sf_dir):
    v, a = _vectors(spark, sf_dir)
    return sm.select(v, a, 150, k=1.0).select("ctx_id", "seq", "tokens", F.round("sim", 6).alias("sim"))


# ---- content -------------------------------------------------------------------------------------------------

_IMAGE = "https://x.test/i.png"
_TOOLS = """t AS (SELECT conv_id AS ctx_id, turn AS pos, CASE WHEN role = 'system' THEN 0 ELSE turn % 4 END AS kind, CASE WHEN role = 'system' THEN role ELSE CASE turn % 4 WHEN 1 THEN 'user' WHEN 2 THEN 'assistant' WHEN 3 THEN 'tool' ELSE role END END AS role, CASE WHEN role <> 'system' AND turn % 4 = 3 AND conv_id % 2 = 0 THEN '{"ok":true}' ELSE coalesce(text, '') END AS text FROM conversations)"""


def _tool_messages(spark, sf_dir):
    """Conversations in which every fourth turn shows an image, calls a tool, or is a tool's result."""
    c = load(spark, sf_dir, "conversations").withColumn("kind", F.when(F.col("role") == "system", 0).otherwise(F.col("turn") % 4))
    role = F.when(F.col("kind") == 1, "user").when(F.col("kind") == 2, "assistant").when(F.col("kind") == 3, "tool").otherwise(F.col("role"))
    text = F.when((F.col("kind") == 3) & (F.col("conv_id") % 2 == 0), '{"ok":true}').otherwise(F.coalesce("text", F.lit("")))
    none = F.lit(None).cast("string")
    part = lambda kind, text, url: F.struct(F.lit(kind).alias("type"), text.alias("text"), url.alias("url"), none.alias("data"), none.alias("mime"))
    parts = F.when(F.col("kind") == 1, F.array(part("text", text, none), part("image_url", none, F.lit(_IMAGE))))
    uses = F.when(F.col("kind") == 2, F.array(F.struct(F.concat(F.lit("c"), "turn").alias("id"), F.lit("look").alias("name"), F.lit('{"q":1}').alias("input"))))
    items = c.select(F.col("conv_id").alias("ctx_id"), F.col("turn").alias("pos"), role.alias("role"), F.when(F.col("kind") != 1, text).alias("text"), parts.alias("parts"), uses.alias("tool_uses"), F.when(F.col("kind") == 3, F.concat(F.lit("c"), F.col("turn") - 1)).alias("tool_call_id"))
    return ct.compiled(items)


def _objects(entry: str, order: str = "role <> 'system', pos") -> str:
    return f"SELECT ctx_id, '[' || string_agg({entry}, ',' ORDER BY {order}) || ']' AS payload FROM t GROUP BY ctx_id"


_IMG = f'{{"type":"image_url","image_url":{{"url":"{_IMAGE}"}}}}'


@register("fmt_text_tools", with_query(_TOOLS, """SELECT ctx_id, string_agg(body, E'\\n\\n' ORDER BY pos) AS payload FROM (SELECT ctx_id, pos, CASE kind WHEN 1 THEN CASE WHEN text = '' THEN '[image]' ELSE text || E'\\n[image]' END WHEN 2 THEN CASE WHEN text = '' THEN '' ELSE text || E'\\n' END || '[{"id":"c' || pos || '","name":"look","input":{"q":1}}]' ELSE text END AS body FROM t) WHERE body <> '' GROUP BY ctx_id"""))
def fmt_text_tools(spark, sf_dir):
    return fm.format_messages(_tool_messages(spark, sf_dir), "text")


@register("fmt_openai_tools", with_query(_TOOLS, _objects(f"""CASE kind WHEN 3 THEN '{{"role":"tool","tool_call_id":"c' || (pos - 1) || '","content":' || to_json(text) || '}}' WHEN 1 THEN '{{"role":"user","content":[{{"type":"text","text":' || to_json(text) || '}},{_IMG}]}}' ELSE '{{"role":' || to_json(role) || ',"content":' || to_json(text) || '}}' END""")))
def fmt_openai_tools(spark, sf_dir):
    return fm.format_messages(_tool_messages(spark, sf_dir), "openai")


@register("fmt_ollama_tools", with_query(_TOOLS, _objects(f"""CASE kind WHEN 3 THEN '{{"role":"tool","content":' || to_json(text) || ',"tool_name":"tool"}}' WHEN 1 THEN '{{"role":"user","content":' || to_json(text || E'\\n[Image URL not sent to Ollama as base64; url={_IMAGE}]') || '}}' WHEN 2 THEN '{{"role":"assistant","content":' || to_json(text) || ',"tool_calls":[{{"function":{{"name":"look","arguments":{{"q":1}}}}}}]}}' ELSE '{{"role":' || to_json(role) || ',"content":' || to_json(text) || '}}' END""")))
def fmt_ollama_tools(spark, sf_dir):
    return fm.format_messages(_tool_messages(spark, sf_dir), "ollama")


_SYS = "s AS (SELECT ctx_id, string_agg(text, E'\\n\\n' ORDER BY pos) AS system FROM t WHERE role = 'system' AND text <> '' GROUP BY ctx_id)"
_BLOCKS = _TOOLS + f""", m AS (SELECT *, CASE WHEN role = 'assistant' THEN '{{a}}' ELSE 'user' END AS who FROM t WHERE role <> 'system'), l AS (SELECT *, coalesce((who <> lag(who) OVER (PARTITION BY ctx_id ORDER BY pos))::INT, 0) AS ch FROM m), g AS (SELECT *, sum(ch) OVER (PARTITION BY ctx_id ORDER BY pos) AS g FROM l)"""
_PIECES = """, b AS (SELECT ctx_id, g, who, pos, 0 AS i, text AS txt, NULL AS json FROM g WHERE kind <> 3 AND text <> '' UNION ALL SELECT ctx_id, g, who, pos, 0, '', NULL FROM g WHERE kind = 1 AND text = ''
UNION ALL SELECT ctx_id, g, who, pos, 1, NULL, '{"type":"image","source":{"type":"url","url":"%s"}}' FROM g WHERE kind = 1 UNION ALL SELECT ctx_id, g, who, pos, 1, NULL, '{"type":"tool_use","id":"c' || pos || '","name":"look","input":{"q":1}}' FROM g WHERE kind = 2
UNION ALL SELECT ctx_id, g, who, pos, 0, NULL, '{"type":"tool_result","tool_use_id":"c' || (pos - 1) || '","content":' || to_json(text) || '}' FROM g WHERE kind = 3),
z AS (SELECT ctx_id, g, count(*) AS n, any_value(who) AS who FROM g GROUP BY ALL), o AS (SELECT b.*, z.n, (b.txt IS NULL OR lag(b.txt) OVER w IS NULL OR z.n = 1)::INT AS fresh FROM b JOIN z USING (ctx_id, g) WINDOW w AS (PARTITION BY ctx_id, g ORDER BY pos, i)),
q AS (SELECT *, sum(fresh) OVER (PARTITION BY ctx_id, g ORDER BY pos, i) AS piece FROM o), u AS (SELECT ctx_id, g, piece, bool_or(txt IS NOT NULL) AS is_text, string_agg(txt, '' ORDER BY pos, i) AS txt, any_value(json) AS json FROM q GROUP BY ALL),
v AS (SELECT ctx_id, g, count(*) AS n, bool_and(is_text) AS plain, any_value(txt) AS txt, '[' || string_agg(CASE WHEN is_text THEN '{"type":"text","text":' || to_json(txt) || '}' ELSE json END, ',' ORDER BY piece) || ']' AS many FROM u GROUP BY ALL),
c AS (SELECT z.ctx_id, z.g, z.who, CASE WHEN v.n IS NULL THEN '""' WHEN v.n = 1 AND v.plain THEN to_json(v.txt)::VARCHAR ELSE v.many END AS content FROM z LEFT JOIN v USING (ctx_id, g)), y AS (SELECT ctx_id, '[' || string_agg('{"role":"' || who || '","content":' || content || '}', ',' ORDER BY g) || ']' AS payload FROM c GROUP BY ctx_id)""" % _IMAGE


@register("fmt_anthropic_tools", with_query(_BLOCKS.replace("{a}", "assistant") + _PIECES + ", " + _SYS, "SELECT ctx_id, payload, system FROM y FULL JOIN s USING (ctx_id)"))
def fmt_anthropic_tools(spark, sf_dir):
    return fm.format_messages(_tool_messages(spark, sf_dir), "anthropic")


_GEM = """, b AS (SELECT ctx_id, g, who, pos, 0 AS i, '{"text":' || to_json(text) || '}' AS json FROM g WHERE kind = 1 OR kind <> 3 AND text <> '' UNION ALL SELECT ctx_id, g, who, pos, 1, '{"fileData":{"fileUri":"%s","mimeType":"image/png"}}' FROM g WHERE kind = 1
UNION ALL SELECT ctx_id, g, who, pos, 1, '{"functionCall":{"name":"look","args":{"q":1}}}' FROM g WHERE kind = 2 UNION ALL SELECT ctx_id, g, who, pos, 0, '{"functionResponse":{"name":"tool","response":' || CASE WHEN starts_with(text, '{"ok"') THEN text ELSE '{"output":' || to_json(text) || '}' END || '}}' FROM g WHERE kind = 3),
z AS (SELECT ctx_id, g, any_value(who) AS who FROM g GROUP BY ALL), v AS (SELECT ctx_id, g, string_agg(json, ',' ORDER BY pos, i) AS parts FROM b GROUP BY ALL), y AS (SELECT z.ctx_id, '[' || string_agg('{"role":"' || z.who || '","parts":[' || coalesce(v.parts, '') || ']}', ',' ORDER BY z.g) || ']' AS payload FROM z LEFT JOIN v USING (ctx_id, g) GROUP BY z.ctx_id)""" % _IMAGE


@register("fmt_gemini_tools", with_query(_BLOCKS.replace("{a}", "model") + _GEM + ", " + _SYS, "SELECT ctx_id, payload, CASE WHEN system IS NOT NULL THEN '[{\"text\":' || to_json(system) || '}]' END AS system FROM y FULL JOIN s USING (ctx_id)"))
def fmt_gemini_tools(spark, sf_dir):
    return fm.format_messages(_tool_messages(spark, sf_dir), "gemini")


@register("los_parts", with_query(_TOOLS, r"SELECT ctx_id, pos, text AS spaced, lower(text) AS lower_text FROM t"))
def los_parts(spark, sf_dir):
    m = _tool_messages(spark, sf_dir)
    lower = ct.map_texts(m, F.lower)
    both = lower.select("ctx_id", "pos", ct.plain_text(F.col("text"), F.col("parts"), "\n").alias("lower_text"))
    return m.select("ctx_id", "pos", ct.plain_text(F.col("text"), F.col("parts")).alias("spaced")).join(both, ["ctx_id", "pos"])


_EN = "regexp_replace({}, '\\s+', ' ', 'g')"


@register("los_compress_items", with_query(f"{_TEXTS}, {_COMPRESSED}, n AS (SELECT id, {_LINES.format('text')} AS ls FROM texts)", f"SELECT c.id, CASE WHEN c.id % 2 = 0 THEN {_SPACE.format(l='n.ls')} ELSE c.text END AS text FROM c JOIN n USING (id)"))
def los_compress_items(spark, sf_dir):
    """Every other text in a language without rules of its own, where white space alone goes; neighbours aren't compared here."""
    t = _texts(spark, sf_dir).select(F.col("id").alias("ctx_id"), F.lit("h").alias("slot"), F.lit(0).alias("seq"), F.lit("user").alias("role"), "text", F.when(F.col("id") % 2 == 0, "minimal").alias("locale"))
    return cm.compress_items(t, default="en-GB", adjacent=False, dedupe=None).select(F.col("ctx_id").alias("id"), "text")


@register("src_push", "SELECT conv_id AS ctx_id, CASE WHEN turn = 0 THEN 'system' ELSE 'history' END AS slot, row_number() OVER (PARTITION BY conv_id, turn = 0 ORDER BY turn) - 1 AS seq, CASE WHEN turn = 0 THEN 'system' WHEN turn % 2 = 0 THEN 'assistant' ELSE 'user' END AS role, coalesce(text, '') AS text, 77::BIGINT AS created_at FROM conversations")
def src_push(spark, sf_dir):
    """Texts pushed without roles in most rows: the slot's default role, or user, fills in."""
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ctx_id"), F.col("turn").alias("at"), F.coalesce("text", F.lit("")).alias("text"))
    system = ct.said("system", c.filter("at = 0"))
    rest = c.filter("at > 0").withColumns({"role": F.when(F.col("at") % 2 == 0, "assistant"), "slot": F.lit("history")})
    slots = spark.createDataFrame([("system", "system"), ("history", None)], "slot string, default_role string")
    return ct.created(system.unionByName(rest), slots, 77).select("ctx_id", "slot", "seq", "role", "text", "created_at")


@register("src_read_slot", with_query(ITEMS, "SELECT ctx_id, seq, text FROM items WHERE slot = 'history'"))
def src_read_slot(spark, sf_dir):
    from tallyloom.sources import store

    return store.read_slot(chat_items(spark, sf_dir), "history").select("ctx_id", "seq", "text")


# ---- counting ------------------------------------------------------------------------------------------------

_GAPS = "g AS (SELECT *, CASE WHEN seq % 3 <> 0 THEN tokens + 1 END AS known FROM items)"


@register("tok_counting", with_query(f"{ITEMS}, {_GAPS}", "SELECT ctx_id, seq, coalesce(known, 0) AS cached, coalesce(known, tokens) AS lazy, length(text) AS accounted FROM g"))
def tok_counting(spark, sf_dir):
    items = chat_items(spark, sf_dir).withColumn("tokens", F.when(F.col("seq") % 3 != 0, F.col("tokens") + 1))
    by = lambda name, **how: ct.counted(items, **how).select("ctx_id", "seq", F.col("tokens").cast("bigint").alias(name))
    accounted = by("accounted", authoritative=True, accountant=lambda i: i.withColumn("tokens", F.length("text")))
    return by("cached").join(by("lazy", lazy=True), ["ctx_id", "seq"]).join(accounted, ["ctx_id", "seq"])


_FNV = "list_reduce(list_transform(range(1, length({t}) + 1), lambda i: unicode({t}[i])::BIGINT), lambda h, c: (xor(h, c) * 16777619) % 4294967296, 2166136261::BIGINT)"


@register("tok_fnv", f"WITH t AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^\\x01-\\x{{D7FF}}]', '', 'g') AS s FROM conversations) SELECT conv_id, turn, {_FNV.format(t='s')} AS h, CASE WHEN s = '' THEN 0 ELSE ceil(length(s) / 4.0)::BIGINT END AS n, CASE WHEN s <> '' THEN {_FNV.format(t='s[1:4]')} END AS first_id FROM t")
def tok_fnv(spark, sf_dir):
    ship_package(spark)
    c = load(spark, sf_dir, "conversations").withColumn("s", F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x01-\\uD7FF]", ""))  # one code unit a character
    c = c.select("conv_id", "turn", tk.fnv1a32(F.col("s")).alias("h"), tk.char_encode(F.col("s")).alias("ids"))
    return c.select("conv_id", "turn", "h", F.size("ids").cast("bigint").alias("n"), F.get("ids", F.lit(0)).alias("first_id"))


@register("tok_bpe_round_trip", "SELECT conv_id, turn, coalesce(text, '') AS text, true AS counted FROM conversations")
def tok_bpe_round_trip(spark, sf_dir):
    import public_tokenizers as P

    from tallyloom.functions import tokenizers as tz

    path, c = P.path("byte_bpe_50k.tiktoken"), load(spark, sf_dir, "conversations")
    ids = c.select("conv_id", "turn", tz.encode_tokens(F.col("text"), path, P.PATTERN).alias("ids"), tz.count_tokens(F.col("text"), path, P.PATTERN).alias("n"))
    return ids.select("conv_id", "turn", tz.decode_tokens(F.col("ids"), path, P.PATTERN).alias("text"), (F.size("ids") == F.col("n")).alias("counted"))


@register("bud_tokenizers", "SELECT * FROM (VALUES ('claude-next', 'anthropic-claude'), ('gpt-4o', 'cl100k_base'), ('gemini-2.0-pro', 'cl100k_base'), ('unknown', 'cl100k_base')) t(model, tokenizer)")
def bud_tokenizers(spark, sf_dir):
    m = spark.createDataFrame([("claude-next",), ("gpt-4o",), ("gemini-2.0-pro",), ("unknown",)], "model string")
    return m.select("model", md.tokenizer(F.col("model")).alias("tokenizer"))


@register("bud_share", with_query(_META, "SELECT ctx_id, slot, round(budget / 500.0 * 100, 6) AS pct FROM meta"))
def bud_share(spark, sf_dir):
    return _meta(spark, sf_dir).select("ctx_id", "slot", F.round(bd.share(F.col("budget"), F.lit(500)), 6).alias("pct"))


# ---- random layouts ------------------------------------------------------------------------------------------

# every conversation's slots by its number: one fixed, one or two percent, none to three flex with bounds
_LAYOUT = """lay AS (SELECT ctx_id, 400 + ctx_id % 13 * 37 AS total, ctx_id % 4 AS flexes, 1 + ctx_id % 2 AS percents FROM (SELECT DISTINCT conv_id AS ctx_id FROM conversations)),
raw AS (SELECT ctx_id, total, 'fixed' AS slot, 90 AS priority, 'fixed' AS kind, 50 + ctx_id % 7 AS amount, 0::BIGINT AS low, 0::BIGINT AS high FROM lay UNION ALL SELECT ctx_id, total, 'p' || i, 50 - i, 'percent', 10 + 7 * i, 0, 0 FROM lay, range(2) r(i) WHERE i < percents
UNION ALL SELECT ctx_id, total, 'f' || i, 30 + (ctx_id + i * 7) % 5, 'flex', 0, ctx_id % 3 * i * 5, CASE WHEN (ctx_id + i) % 3 = 0 THEN 20 + ctx_id % 11 ELSE 9007199254740991::BIGINT END FROM lay, range(3) r(i) WHERE i < flexes),
b AS (SELECT *, total - sum(CASE WHEN kind = 'fixed' THEN amount ELSE 0 END) OVER (PARTITION BY ctx_id) AS after_fixed, count(*) FILTER (kind = 'flex') OVER (PARTITION BY ctx_id) AS n_flex, count(*) FILTER (kind = 'percent') OVER (PARTITION BY ctx_id) AS n_percent FROM raw),
c AS (SELECT *, CASE WHEN kind = 'percent' THEN after_fixed * amount // 100 ELSE 0 END AS base FROM b), d AS (SELECT *, after_fixed - sum(base) OVER (PARTITION BY ctx_id) AS pool, sum(CASE WHEN kind = 'flex' THEN low ELSE 0 END) OVER (PARTITION BY ctx_id) AS lows, row_number() OVER (PARTITION BY ctx_id, kind ORDER BY priority DESC, slot) AS rn FROM c),
e AS (SELECT *, CASE WHEN kind = 'flex' THEN least(high, low + (pool - lows) // n_flex) ELSE 0 END AS part FROM d), f AS (SELECT *, pool - sum(part) OVER (PARTITION BY ctx_id) AS rest FROM e),
fold(ctx_id, rn, left_over, got) AS (SELECT DISTINCT ctx_id, 0::BIGINT, CAST(rest AS BIGINT), 0::BIGINT FROM f WHERE n_flex > 0 UNION ALL SELECT f.ctx_id, f.rn, CAST(o.left_over - least(f.high - f.part, o.left_over) AS BIGINT), CAST(f.part + least(f.high - f.part, o.left_over) AS BIGINT) FROM fold o JOIN f ON f.ctx_id = o.ctx_id AND f.kind = 'flex' AND f.rn = o.rn + 1)"""


@register("bud_layouts", with_query(_LAYOUT, """SELECT f.ctx_id, f.slot, CAST(CASE f.kind WHEN 'fixed' THEN f.amount WHEN 'percent' THEN f.base + CASE WHEN f.n_flex = 0 THEN f.pool // f.n_percent + (f.rn <= f.pool % f.n_percent)::INT ELSE 0 END ELSE o.got END AS BIGINT) AS allocated
FROM f LEFT JOIN fold o ON o.ctx_id = f.ctx_id AND f.kind = 'flex' AND o.rn = f.rn""").replace(*RECURSIVE))
def bud_layouts(spark, sf_dir):
    """Layouts that differ from conversation to conversation; the SQL hands the leftover on from slot to slot."""
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ctx_id")).distinct().withColumn("total", 400 + F.col("ctx_id") % 13 * 37)
    none, i = F.lit(None).cast("bigint"), F.col("i")
    row = lambda slot, priority, kind, fixed=none, percent=F.lit(None).cast("double"), low=none, high=none: F.struct(slot.cast("string").alias("slot"), priority.cast("int").alias("priority"), F.lit(kind).alias("budget_kind"), fixed.cast("bigint").alias("fixed"), percent.cast("double").alias("percent"), low.cast("bigint").alias("min"), high.cast("bigint").alias("max"))
    fixed = c.select("ctx_id", "total", row(F.lit("fixed"), F.lit(90), "fixed", fixed=50 + F.col("ctx_id") % 7).alias("s"))
    many = c.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    percent = many.filter("i < 1 + ctx_id % 2").select("ctx_id", "total", row(F.concat(F.lit("p"), i), 50 - i, "percent", percent=10 + 7 * i).alias("s"))
    high = F.when((F.col("ctx_id") + i) % 3 == 0, 20 + F.col("ctx_id") % 11)
    flex = many.filter("i < ctx_id % 4").select("ctx_id", "total", row(F.concat(F.lit("f"), i), 30 + (F.col("ctx_id") + i * 7) % 5, "flex", low=F.col("ctx_id") % 3 * i * 5, high=high).alias("s"))
    return bd.allocate(fixed.unionByName(percent).unionByName(flex).select("ctx_id", "total", "s.*")).select("ctx_id", "slot", "allocated")


# ---- memory, retrieval, facts --------------------------------------------------------------------------------

_NOW, _LIFE = 100_000_000_000, 7 * 86_400_000
_MEMORY = ITEMS + f""", own AS (SELECT *, CASE WHEN pinned OR seq % 5 = 1 THEN 'memory' ELSE 'history' END AS place FROM items), q AS (SELECT ctx_id, arg_max(text, seq) AS query FROM own WHERE place = 'history' AND role = 'user' AND trim(text) <> '' GROUP BY ctx_id),
qw AS (SELECT ctx_id, query, list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: length(w) > 1) AS ws FROM q), mem AS (SELECT doc_id % 40 AS ctx_id, CAST(doc_id AS VARCHAR) AS id, text AS content, doc_id * 3600000 AS updated_at FROM documents),
hit AS (SELECT m.*, query FROM mem m JOIN qw USING (ctx_id) WHERE len(list_filter(ws, lambda w: contains(lower(content), w))) > 0 QUALIFY row_number() OVER (PARTITION BY m.ctx_id ORDER BY updated_at DESC, id) <= 48),
sc AS (SELECT *, {_WORDS.format('content')} AS wa, {_WORDS.format('query')} AS wb FROM hit), rk AS (SELECT *, 0.55 * {_JACC} + (1 - 0.55) * exp(-greatest(0, {_NOW} - updated_at) / {float(_LIFE)}) AS score FROM sc),
made AS (SELECT ctx_id, '[memory] ' || content AS text, CAST(ceil(length('[memory] ' || content) / 4.0) AS BIGINT) AS tokens, 1000000 + row_number() OVER (PARTITION BY ctx_id ORDER BY score DESC, updated_at DESC, id) AS spot FROM rk),
every AS (SELECT ctx_id, text, tokens, seq AS spot FROM own WHERE place = 'memory' AND NOT pinned UNION ALL SELECT * FROM made), r AS (SELECT *, row_number() OVER (PARTITION BY ctx_id ORDER BY spot) AS k FROM every),
held AS (SELECT ctx_id, CAST(sum(CASE WHEN place = 'memory' AND pinned THEN tokens ELSE 0 END) AS BIGINT) AS used FROM own GROUP BY ctx_id),
fold(ctx_id, k, used, taken) AS (SELECT ctx_id, 0::BIGINT, used, false FROM held UNION ALL SELECT r.ctx_id, r.k, CASE WHEN f.used + r.tokens <= 900 THEN f.used + r.tokens ELSE f.used END, f.used + r.tokens <= 900 FROM fold f JOIN r ON r.ctx_id = f.ctx_id AND r.k = f.k + 1)"""


@register("mem_inject", with_query(_MEMORY, "SELECT ctx_id, 'history' AS slot, text, tokens FROM own WHERE place = 'history' UNION ALL SELECT ctx_id, 'memory', text, tokens FROM own WHERE place = 'memory' AND pinned UNION ALL SELECT r.ctx_id, 'memory', text, tokens FROM r JOIN fold f USING (ctx_id, k) WHERE f.taken").replace(*RECURSIVE))
def mem_inject(spark, sf_dir):
    """Memory slots that hold pinned items and the user's own, filled up from each context's store."""
    items = chat_items(spark, sf_dir).withColumn("slot", F.when(F.col("pinned") | (F.col("seq") % 5 == 1), "memory").otherwise("history"))
    memories = load(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("ctx_id"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), (F.col("doc_id") * 3_600_000).alias("updated_at"))
    budgets = items.select("ctx_id").distinct().withColumn("budget", F.lit(900))
    return rt.inject(items, memories, budgets, _NOW).select("ctx_id", "slot", "text", "tokens")


@register("mem_delete", "SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 0")
def mem_delete(spark, sf_dir):
    m = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return rt.delete(m, m.filter("id % 3 = 0"))


@register("rag_scores", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id / 8.0 ELSE 0.0 END AS score, CASE WHEN doc_id % 5 = 0 THEN 'c' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS chunk_id, doc_id % 4 = 3 AS definition FROM documents")
def rag_scores(spark, sf_dir):
    """Scores, ids and definitions as metadata has them: numbers, text, not a number, nothing."""
    i = F.col("doc_id")
    value = F.when(i % 4 == 0, (i / 8).cast("string")).when(i % 4 == 1, "NaN").when(i % 4 == 2, "high")
    kind = F.when(i % 4 == 3, F.when(i % 8 == 3, "definition"))
    meta = F.map_filter(F.create_map(F.lit("rag.score"), value, F.lit("rag.chunkId"), F.when(i % 5 == 0, F.concat(F.lit("c"), i)).when(i % 5 == 1, ""), F.lit("tools.kind"), kind, F.lit("tools.definition"), F.when(i % 8 == 7, "true")), lambda k, v: v.isNotNull())
    d = load(spark, sf_dir, "documents").withColumn("m", meta)
    return d.select("doc_id", rt.score_of(F.col("m")).alias("score"), rt.chunk_id_of(F.col("m"), F.col("doc_id")).alias("chunk_id"), ct.is_definition(F.col("m")).alias("definition"))


@register("tls_roles", with_query(ITEMS, "SELECT ctx_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY ctx_id, slot, seq % 2 = 1 ORDER BY created_at DESC, seq DESC) AS r FROM items) WHERE seq % 2 = 0 OR pinned OR r <= 2"))
def tls_roles(spark, sf_dir):
    """Rows of other roles never count as tool results."""
    items = chat_items(spark, sf_dir).withColumns({"role": F.when((F.col("seq") % 2 == 1), "tool").otherwise(F.col("role")), "definition": F.lit(False)})
    return rt.max_results(items, 2).select("ctx_id", "seq")


@register("fct_extract", "SELECT conv_id * 100 + turn AS id, CASE WHEN turn % 3 = 0 THEN 's' || conv_id ELSE 'l' || conv_id END AS subject, 'at' AS predicate, CAST(turn AS VARCHAR) AS value, CASE WHEN turn % 3 = 0 THEN 0.5 ELSE 0.9 END AS confidence FROM conversations WHERE turn % 3 < 2")
def fct_extract(spark, sf_dir):
    """Answers as JSON, as FACT lines, and as neither."""
    c = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "conv_id", "turn")
    json = F.format_string('{"facts":[{"subject":"s%d","predicate":"at","value":"%d","confidence":0.5}]}', "conv_id", "turn")
    text = F.when(F.col("turn") % 3 == 0, json).when(F.col("turn") % 3 == 1, F.format_string("Some words.\nFACT: l%d | at | %d", "conv_id", "turn")).otherwise("none")
    return fc.extracted(c.select("id", text.alias("text"))).select("id", "subject", "predicate", "value", "confidence")


@register("fct_ranked", with_query(FACTS, "SELECT subject, seq, round(confidence * pow(0.5, greatest(0, (SELECT max(created_at) FROM facts) - created_at) / 1000.0), 9) AS strength FROM facts"))
def fct_ranked(spark, sf_dir):
    return fc.ranked(facts(spark, sf_dir), half_life=1000).select("subject", "seq", F.round("strength", 9).alias("strength"))


# ---- events and reports --------------------------------------------------------------------------------------


@register("red_events", "SELECT conv_id AS ctx_id, turn AS seq, 'content:evicted' AS type, 'mail [REDACTED] now' AS detail FROM conversations")
def red_events(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ctx_id"), F.col("turn").alias("seq"), F.lit("content:evicted").alias("type"), F.struct(F.concat(F.lit("mail a"), "turn", F.lit("@x.org now")).alias("detail")).alias("item"))
    return et.redacted(c).select("ctx_id", "seq", "type", "item.detail")


_READY = f"{ITEMS}, {_KEPT.format(n='k', b=300)}, sl AS (SELECT DISTINCT ctx_id, s.slot, s.p AS slot_pos FROM items, (VALUES ('system', 1), ('history', 2)) s(slot, p))"


def _built(spark, sf_dir):
    from tallyloom.plans.context import ContextPlan

    return ContextPlan().tokens(600).slot("system", 100, budget_kind="fixed", fixed=300, position="before").slot("history", 50).build(chat_items(spark, sf_dir))


@register("evt_ready", with_query(_READY, """SELECT sl.ctx_id, sl.slot_pos, sl.slot, count(k.seq) AS n, coalesce('[' || string_agg('{"role":' || to_json(role) || ',"text":' || to_json(text) || '}', ',' ORDER BY seq) FILTER (k.seq IS NOT NULL) || ']', '[]') AS payload FROM sl LEFT JOIN k USING (ctx_id, slot) GROUP BY ALL"""))
def evt_ready(spark, sf_dir):
    """Slots of a build in the order in which a reader gets them."""
    return _built(spark, sf_dir).ready()


_EVENTS = _READY + """, ev AS (SELECT ctx_id, 'slot:budget-resolved' AS type, slot, NULL::BIGINT AS seq, '300' AS detail FROM sl UNION ALL SELECT ctx_id, 'content:evicted', slot, seq, 'overflow:build' FROM items ANTI JOIN k USING (ctx_id, slot, seq) UNION ALL SELECT ctx_id, 'build:complete', NULL, NULL, CAST(count(*) AS VARCHAR) FROM k GROUP BY ctx_id)"""


@register("evt_build", with_query(_EVENTS, "SELECT * FROM ev"))
def evt_build(spark, sf_dir):
    return _built(spark, sf_dir).events()


@register("evt_timeline", with_query(_EVENTS, "SELECT ctx_id, type, seq, CASE type WHEN 'slot:budget-resolved' THEN 'Budget resolved ' || slot || ' → 300 tok' WHEN 'content:evicted' THEN 'Evicted from ' || slot || ' · overflow:build' ELSE 'Build complete' END AS line, CASE type WHEN 'build:complete' THEN '{\"ctx_id\":' || ctx_id || ',\"type\":\"build:complete\",\"detail\":\"' || detail || '\"}' END AS body FROM ev"))
def evt_timeline(spark, sf_dir):
    e = _built(spark, sf_dir).events()
    done = et.as_json(e.filter("type = 'build:complete'")).withColumn("type", F.lit("build:complete"))
    lines = e.select("ctx_id", "type", "seq", et.timeline(F.col("type"), F.col("slot"), F.col("detail")).alias("line"))
    return lines.join(done, ["ctx_id", "type"], "left")


@register("snp_slot_lines", with_query(_META, "SELECT ctx_id, string_agg(slot || ': used ' || used || ' / budget ' || budget || ' · items ' || item_count || ' · evicted ' || evicted || ' · overflow ' || (evicted > 0), E'\\n' ORDER BY slot) AS text FROM meta GROUP BY ctx_id"))
def snp_slot_lines(spark, sf_dir):
    return sn.slot_lines(_meta(spark, sf_dir))


@register("snp_slot_union", with_query(ITEMS, "SELECT DISTINCT ctx_id, slot FROM items"))
def snp_slot_union(spark, sf_dir):
    i = chat_items(spark, sf_dir)
    return sn.slot_union(i.filter("slot = 'system' OR ctx_id % 2 = 0"), i.filter("slot <> 'system'"))


@register("snp_migrate_messages", with_query(f"{ITEMS}, {_compiled('m', 'items')}", "SELECT ctx_id, pos, role, text, 0.5 AS utilisation FROM m"))
def snp_migrate_messages(spark, sf_dir):
    """Every conversation as a snapshot of version 0.9, migrated, verified and read."""
    m = _messages(spark, sf_dir)
    body = F.to_json(F.struct(F.lit("0.9").alias("version"), F.col("ctx_id").cast("string").alias("id"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"), F.expr("named_struct('slotStats', map('a', named_struct('used', 50, 'budget', 100)))").alias("meta")))
    done, _ = sn.migrated(m.groupBy("ctx_id").agg(body.alias("body")))
    share = done.select("ctx_id", F.get_json_object("body", "$.meta.slots.a.utilisation").cast("double").alias("utilisation"))
    return sn.deserialise(done).join(share, "ctx_id")


@register("snp_warnings", with_query(_META, "SELECT ctx_id, CAST(sum(used) AS BIGINT) AS used, CASE WHEN ctx_id % 2 = 0 THEN 'LATE' ELSE '' END AS warnings FROM meta GROUP BY ctx_id"))
def snp_warnings(spark, sf_dir):
    meta = _meta(spark, sf_dir)
    told = meta.filter("ctx_id % 2 = 0").select("ctx_id", F.lit("LATE").alias("warning"))
    return sn.build_meta(meta, told).select("ctx_id", "used", F.array_join("warnings", ",").alias("warnings"))


_RUNS = "u AS (SELECT conv_id % 3 AS s, conv_id % 2 * 100 + 100 AS budget, conv_id % 5 AS llm_requests, conv_id * 3 AS llm_tokens FROM (SELECT DISTINCT conv_id FROM conversations))"


@register("evl_usage", with_query(_RUNS, "SELECT 's' || s AS strategy, budget, CAST(sum(llm_requests) AS BIGINT) AS total_llm_requests, round(avg(llm_requests), 6) AS avg_llm_requests, CAST(sum(llm_tokens) AS BIGINT) AS total_llm_tokens, round(avg(llm_tokens), 6) AS avg_llm_tokens FROM u GROUP BY ALL"))
def evl_usage(spark, sf_dir):
    i = F.col("conv_id")
    c = load(spark, sf_dir, "conversations").select("conv_id").distinct()
    return ev.usage(c.select(F.concat(F.lit("s"), i % 3).alias("strategy"), (i % 2 * 100 + 100).alias("budget"), (i % 5).alias("llm_requests"), (i * 3).alias("llm_tokens")))


@register("evl_lost", with_query(ITEMS, "SELECT ctx_id, min(step) FILTER (was AND NOT here) AS lost FROM (SELECT *, coalesce(bool_or(here) OVER (PARTITION BY ctx_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS was FROM (SELECT ctx_id, seq AS step, tokens % 3 = 0 AS here FROM items)) GROUP BY ctx_id"))
def evl_lost(spark, sf_dir):
    return ev.lost_step(chat_items(spark, sf_dir).select("ctx_id", F.col("seq").alias("step"), (F.col("tokens") % 3 == 0).alias("here")), "here")


@register("evl_build_times", with_query(ITEMS, "SELECT ctx_id, min(tokens) AS least, max(tokens) AS most, CAST(round(avg(tokens)) AS BIGINT) AS mean, CAST(sum(tokens) AS BIGINT) AS total FROM items GROUP BY ctx_id"))
def evl_build_times(spark, sf_dir):
    return ev.build_times(chat_items(spark, sf_dir), "tokens")


# ---- policies in a build -------------------------------------------------------------------------------------


def _plan(spark, sf_dir, overflow, force=False, items=None, tokens=500, **how):
    from tallyloom.plans.context import ContextPlan

    plan = ContextPlan(proactive=how.pop("proactive", None)).tokens(tokens).slot("system", 100, budget_kind="fixed", fixed=300, position="before", protected=True).slot("history", 50, overflow=overflow, **how)
    return plan.build(chat_items(spark, sf_dir) if items is None else items, force)


def _windowed(frame: str, src: str = "items", budget: str = "200") -> str:
    free = f"sum(CASE WHEN pinned THEN 0 ELSE tokens END) OVER (PARTITION BY ctx_id, slot ORDER BY seq {frame})"
    return f"SELECT ctx_id, slot, seq FROM (SELECT *, {free} AS f FROM {src}) WHERE slot = 'system' OR f <= {budget}"


_BACK, _FORTH = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING", "ROWS UNBOUNDED PRECEDING"


@register("build_truncate_latest", with_query(ITEMS, _windowed(_FORTH)))
def build_truncate_latest(spark, sf_dir):
    return _plan(spark, sf_dir, "truncate-latest").items.select("ctx_id", "slot", "seq")


@register("build_sliding_window", with_query(ITEMS + ", s AS (SELECT *, sum(tokens) OVER (PARTITION BY ctx_id, slot) > 200 AS over FROM items), w AS (SELECT * FROM s QUALIFY slot = 'system' OR NOT over OR row_number() OVER (PARTITION BY ctx_id, slot ORDER BY seq DESC) <= 2)", _windowed(_BACK, "w")))
def build_sliding_window(spark, sf_dir):
    return _plan(spark, sf_dir, "sliding-window", window=2).items.select("ctx_id", "slot", "seq")


@register("build_forced", with_query(ITEMS + ", s AS (SELECT *, sum(tokens) OVER (PARTITION BY ctx_id, slot) AS used FROM items), b AS (SELECT *, CASE WHEN used > 200 THEN 200 ELSE floor(used * 0.5) END AS room FROM s)", _windowed(_BACK, "b", "room")))
def build_forced(spark, sf_dir):
    """With force, slots that fit work to half of what they use."""
    return _plan(spark, sf_dir, "truncate", True).items.select("ctx_id", "slot", "seq")


@register("build_custom_proactive", with_query(ITEMS + ", s AS (SELECT *, sum(tokens) OVER (PARTITION BY ctx_id, slot) AS used FROM items)", "SELECT ctx_id, slot, seq, CASE WHEN slot = 'history' AND used > 100 THEN 'x' ELSE 'o' END AS touched FROM s"))
def build_custom_proactive(spark, sf_dir):
    """The compress policy is called for slots beyond half of their budget already."""
    items = chat_items(spark, sf_dir).withColumn("text", F.lit("actually  x"))
    kept = _plan(spark, sf_dir, "compress", items=items, tokens=100_300, proactive=0.001).items
    return kept.select("ctx_id", "slot", "seq", F.when(F.col("text") == "actually  x", "o").otherwise("x").alias("touched"))


@register("build_fallback", with_query(ITEMS + ", s AS (SELECT *, sum(tokens) OVER (PARTITION BY ctx_id, slot) AS used FROM items)", _windowed(_BACK)))
def build_fallback(spark, sf_dir):
    """Summaries that do nothing, texts that keep their counts: truncation decides, and all slots end within their budget."""
    from tallyloom.plans.context import ContextPlan

    plan = ContextPlan(summarise=lambda items: items).tokens(500).slot("system", 100, budget_kind="fixed", fixed=300, position="before", protected=True).slot("history", 50, overflow="fallback-chain")
    return plan.build(chat_items(spark, sf_dir)).items.select("ctx_id", "slot", "seq")


@register("build_exhausted", with_query(ITEMS, "SELECT ctx_id, NULL::VARCHAR AS slot, 'ESCALATION_EXHAUSTED' AS warning FROM items GROUP BY ctx_id HAVING sum(tokens) > 40 UNION ALL SELECT ctx_id, slot, 'PROTECTED_OVER_BUDGET' FROM items GROUP BY ctx_id, slot HAVING sum(tokens) > 20"))
def build_exhausted(spark, sf_dir):
    """Protected slots stay as they are; what doesn't fit is told."""
    from tallyloom.plans.context import ContextPlan

    plan = ContextPlan().tokens(40).slot("system", 100, budget_kind="fixed", fixed=20, protected=True).slot("history", 50, protected=True)
    return plan.build(chat_items(spark, sf_dir)).warnings


@register("build_semantic", with_query(_SELECT.format(t="0").replace("<= 150", "<= 100"), _TAKEN.replace("round(sim, 6) AS sim", "'v' AS slot").replace("round(r.sim, 6)", "'v'")).replace(*RECURSIVE))
def build_semantic(spark, sf_dir):
    from tallyloom.plans.context import ContextPlan

    v, a = _vectors(spark, sf_dir)
    items = v.withColumns({"slot": F.lit("v"), "role": F.lit("user"), "text": F.lit("")})
    plan = ContextPlan(anchors=a).tokens(100).slot("v", 50, overflow="semantic", max_items=2**31 - 1)  # a label holds any number of vectors
    return plan.build(items).items.select("ctx_id", "seq", "tokens", "slot")


@register("build_ephemeral", with_query(ITEMS, "SELECT ctx_id, slot, seq FROM items WHERE seq % 2 = 0"))
def build_ephemeral(spark, sf_dir):
    """Ephemeral items are in one build and gone from what the next starts from."""
    items = chat_items(spark, sf_dir).withColumn("ephemeral", F.col("seq") % 2 == 1)
    return _plan(spark, sf_dir, "truncate", items=items, tokens=100_000).next_items.select("ctx_id", "slot", "seq")
