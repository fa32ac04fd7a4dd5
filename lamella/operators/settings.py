"""Request settings: strict parsing, precedence of request, pins and defaults, guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _or_error(value: Column, ok: Column, given: Column, message: str) -> Column:
    return F.when(given.isNull() | (given == ""), F.lit(None)).when(ok, value).otherwise(F.raise_error(F.lit(message)))


def parse_seed(text: Column) -> Column:
    """An unsigned 32-bit number; null if absent, an error if it is anything else."""
    n = text.try_cast("bigint")
    return _or_error(n, text.rlike(r"^\d+$") & n.between(0, 2**32 - 1), text, "seed must be an unsigned 32-bit integer")


def parse_flag(text: Column) -> Column:
    low = F.lower(text)
    return _or_error(low.isin("1", "true", "yes", "on"), low.isin("1", "true", "yes", "on", "0", "false", "no", "off"), text, "flag must be true or false")


def parse_choice(text: Column, choices: Sequence[str]) -> Column:
    low = F.lower(text)
    return _or_error(low, low.isin(*choices), text, "unknown choice")


def parse_language(tags: DataFrame, languages: DataFrame) -> DataFrame:
    """tags (tag) with the language (tag, language) of the same tag, whatever its case."""
    l = languages.select(F.lower("tag").alias("__t"), "language")  # noqa: E741
    return tags.join(F.broadcast(l), F.lower("tag") == F.col("__t"), "left").drop("__t")


def choose_plan(skip_inpainting: Column, clean_only: Column, detect_only: Column) -> Column:
    """One plan from flags that exclude each other; an error for several."""
    n = skip_inpainting.cast("int") + clean_only.cast("int") + detect_only.cast("int")
    return (
        F.when(n > 1, F.raise_error(F.lit("flags exclude each other"))).when(detect_only, "detect").when(clean_only, "clean")
        .when(skip_inpainting, "translate_in_place").otherwise("full")
    )


def substitute_engine(name: Column, special: str, substitute: Column) -> Column:
    """One engine name is served by the configured substitute."""
    return F.when(name == special, F.coalesce(substitute, name)).otherwise(name)


def resolve_pinned(requested: Column, pinned: Column) -> Column:
    """The pin; a request for anything else is an error."""
    clash = pinned.isNotNull() & requested.isNotNull() & (requested != pinned)
    return F.when(clash, F.raise_error(F.lit("the model is pinned"))).otherwise(F.coalesce(pinned, requested))


def desired(requested: Column, default: Column, pinned: Column) -> Column:
    return F.coalesce(pinned, requested, default)


def needs_reload(loaded: Column, wanted: Column) -> Column:
    return ~loaded.eqNullSafe(wanted)


def unapplied(wanted: DataFrame, observed: DataFrame) -> DataFrame:
    """Stages (stage, model) whose observed model is another one."""
    return wanted.join(observed, ["stage", "model"], "left_anti")


def models_loaded(stages: DataFrame) -> DataFrame:
    return stages.agg(F.coalesce(F.bool_or("resident"), F.lit(False)).alias("loaded"))


def wants_json(form: Column, accept: Column) -> Column:
    return F.coalesce(F.lower(form) == "json", F.lit(False)) | (form.isNull() & F.coalesce(F.lower(accept).contains("application/json"), F.lit(False)))


def allowed_hosts(bind: DataFrame) -> DataFrame:
    """Hosts that may be named for a bound address (host, port)."""
    loop = F.when(F.col("host").isin("127.0.0.1", "::1", "localhost", "0.0.0.0"), F.array(F.lit("127.0.0.1"), F.lit("localhost"), F.lit("[::1]"))).otherwise(F.array("host"))
    return bind.select(F.explode(loop).alias("name"), "port").select(F.explode(F.array("name", F.concat_ws(":", "name", F.col("port").cast("string")))).alias("host")).distinct()


def guard(requests: DataFrame, hosts: DataFrame, origins: DataFrame, token_sha256: str | None, extension_scheme: str = "moz-extension") -> DataFrame:
    """requests (host, origin, token) with the verdict on each: host, origin, token or ok."""
    h, o = hosts.select(F.col("host").alias("__h")).distinct(), origins.select(F.col("origin").alias("__o")).distinct()
    out = requests.join(F.broadcast(h), F.lower("host") == F.col("__h"), "left").join(F.broadcast(o), F.col("origin") == F.col("__o"), "left")
    scheme = F.coalesce(F.startswith("origin", F.lit(f"{extension_scheme}://")), F.lit(False))
    token = F.lit(True) if token_sha256 is None else F.coalesce(F.sha2(F.col("token").cast("binary"), 256) == token_sha256, F.lit(False))
    verdict = F.when(F.col("__h").isNull(), "host").when(F.col("origin").isNotNull() & F.col("__o").isNull() & ~scheme, "origin").when(~token, "token").otherwise("ok")
    return out.withColumn("verdict", verdict).drop("__h", "__o")


def migrated_format(form: Column, engine: Column, manga_engine: str) -> Column:
    """A missing format follows from the engine."""
    return F.coalesce(form, F.when(engine == manga_engine, "paged").otherwise("strip"))


def writing_mode(script: Column, typography: Column, recognised: Column, width: Column, height: Column) -> Column:
    """Vertical only for CJK text: as set, else as recognised, else by aspect."""
    return F.when(~script.isin("han", "kana", "hangul"), "horizontal").otherwise(F.coalesce(typography, recognised, F.when(height > width, "vertical").otherwise("horizontal")))


def resolve_text(translated: Column, source: Column) -> Column:
    """Translation, else the source with a note."""
    missing = F.coalesce(F.trim(translated) == "", F.lit(True))
    return F.struct(F.when(missing, source).otherwise(translated).alias("text"), F.when(missing, "untranslated").alias("note"))
