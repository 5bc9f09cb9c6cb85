"""Model registry: context sizes, provider inference and capabilities, as tables and column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Families of models by prefix, most specific first, with provider and context size.
FAMILIES = [
    ("gpt-5.4", "openai", 1_050_000), ("gpt-5", "openai", 400_000), ("gpt-4.1", "openai", 1_000_000), ("gpt-4o", "openai", 128_000), ("gpt-4-turbo", "openai", 128_000), ("gpt-4", "openai", 8_192),
    ("o1", "openai", 200_000), ("o3", "openai", 200_000), ("o4", "openai", 200_000), ("claude", "anthropic", 200_000), ("gemini", "google", 1_048_576), ("ollama/", "ollama", 8_192),
]
# Exact ids whose context size isn't their family's.
EXACT = [
    ("gpt-5.4-mini", "openai", 400_000), ("gpt-5.4-nano", "openai", 400_000), ("o1-mini", "openai", 128_000), ("claude-sonnet-4-5-20250929", "anthropic", 1_000_000), ("claude-sonnet-4-6-20260217", "anthropic", 1_000_000), ("claude-sonnet-4-6", "anthropic", 1_000_000),
    ("claude-opus-4-6", "anthropic", 1_000_000), ("claude-opus-4-6-20260217", "anthropic", 1_000_000), ("gemini-2.0-flash", "google", 1_000_000), ("gemini-2.0-pro", "google", 2_000_000), ("mistral-medium-latest", "mistral", 32_000), ("devstral-small-latest", "mistral", 128_000),
    ("ollama/llama3.1", "ollama", 131_072), ("ollama/llama3.2", "ollama", 131_072), ("ollama/llama3.3", "ollama", 131_072), ("ollama/llama4-scout", "ollama", 131_072), ("ollama/llama4-maverick", "ollama", 131_072), ("ollama/qwen2.5", "ollama", 32_768), ("ollama/mistral", "ollama", 32_768),
]
MISTRAL = ("mistral", "mixtral", "codestral", "devstral")


def registry(spark: SparkSession, extra: list[tuple[str, str, int]] = ()) -> DataFrame:
    """prefix, provider, max_tokens; rows of ``extra`` (registered models) come before the built-in ones."""
    return spark.createDataFrame([*extra, *EXACT, *FAMILIES], "prefix string, provider string, max_tokens bigint")


def normalised(model: Column) -> Column:
    return F.lower(F.btrim(model))


def _first(model: Column, pick: int, extra: list[tuple[str, str, int]]) -> Column:
    name, out = normalised(model), None
    for row in [*extra, *EXACT]:  # registered models and exact ids come first
        out = F.when(name == row[0].lower(), row[pick]) if out is None else out.when(name == row[0].lower(), row[pick])
    for row in FAMILIES:
        hit = F.startswith(name, F.lit(row[0]))
        out = F.when(hit, row[pick]) if out is None else out.when(hit, row[pick])
    mistral = F.lit(False)
    for part in MISTRAL:
        mistral = mistral | F.contains(name, F.lit(part))
    return out.when(mistral, "mistral" if pick == 1 else 256_000)


def provider(model: Column, extra=()) -> Column:
    return _first(model, 1, list(extra))


def max_tokens(model: Column, extra=()) -> Column:
    return _first(model, 2, list(extra)).cast("bigint")


def max_output(context: Column) -> Column:
    """Default output size by context size."""
    small = F.least(F.lit(4096), F.greatest(F.lit(1024), context - 1))
    return F.when(context >= 512_000, 65_536).when(context >= 32_000, 16_384).otherwise(small).cast("bigint")


def inferred(contexts: DataFrame, extra=()) -> DataFrame:
    """``contexts`` (model, max_tokens) with what isn't set taken from the registry."""
    return contexts.withColumns({"max_tokens": F.coalesce("max_tokens", max_tokens(F.col("model"), extra)), "provider": provider(F.col("model"), extra)})


def overridden(contexts: DataFrame, overrides: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Fields that an override sets replace those of the context; the others stay."""
    new = overrides.select(*keys, *[F.col(f).alias(f"__{f}") for f in fields])
    out = contexts.join(new, keys, "left")
    return out.withColumns({f: F.coalesce(f"__{f}", f) for f in fields}).drop(*[f"__{f}" for f in fields])


def tokenizer(model: Column, extra=()) -> Column:
    """The name of the tokenizer that counts for a model, by its provider."""
    return F.when(provider(model, extra) == "anthropic", "anthropic-claude").otherwise("cl100k_base")
