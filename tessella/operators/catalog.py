"""Catalogues of files and samples: pairing, probing caches, keys, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.fixed import MODEL_INPUTS, NOISE_PATTERNS, RUN_NAMES


def require(condition: Column, value: Column, message: str) -> Column:
    """The value, or an error where the condition doesn't hold."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))


def pair_files(files: DataFrame, suffixes: list[str], stem: str = "stem", suffix: str = "suffix", path: str = "path") -> DataFrame:
    """(stem, images): one path per suffix; a stem that lacks one is an error."""
    wide = files.groupBy(stem).pivot(suffix, suffixes).agg(F.min(path))
    whole = F.array(*[require(F.col(f"`{s}`").isNotNull(), F.col(f"`{s}`"), f"no file with suffix {s}") for s in suffixes])
    return wide.select(stem, whole.alias("images"))


def pick_mask(masks: DataFrame, extensions: list[str], stem: str = "stem", extension: str = "ext", path: str = "path") -> DataFrame:
    """(stem, mask): the path with the first of the extensions that exists."""
    order = F.array_position(F.array(*map(F.lit, extensions)), F.col(extension))
    return masks.where(order > 0).groupBy(stem).agg(F.min_by(path, order).alias("mask"))


def having_labels(images: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Images that have a label file; the others are left out."""
    return images.join(labels.select(key), key, "left_semi")


def cache_misses(samples: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Samples without a cached prediction."""
    return samples.join(cached.select(key), key, "left_anti")


def cache_key(*parts: Column, length: int = 16) -> Column:
    """The first hex digits of the SHA-256 of the parts, joined by a separator that texts don't hold."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, length)


def lookup(rows: DataFrame, registry: DataFrame, key: str, value: str) -> DataFrame:
    """Add the registry's value; a key that isn't registered is an error. The registry is a small table of settings."""
    joined = rows.join(registry.select(key, value), key, "left")
    return joined.withColumn(value, require(F.col(value).isNotNull(), F.col(value), "not registered"))


def newest(files: DataFrame, keys: list[str], path: str, time: str) -> DataFrame:
    """The path with the latest time by keys; of equal ones the largest."""
    return files.groupBy(*keys).agg(F.max_by(path, F.struct(time, path)).alias(path))


def sources_summary(samples: DataFrame, keys: list[str], position: str) -> DataFrame:
    """(keys, n, first_pos): regions of each source, and where it was first seen."""
    return samples.groupBy(*keys).agg(F.count("*").alias("n"), F.min(position).alias("first_pos"))


def sample_per_group(rows: DataFrame, group: str, order: Column, tie: str, k: int) -> DataFrame:
    """k rows of each group in a fixed shuffled order."""
    from pyspark.sql import Window

    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order, tie))).where(F.col("_r") <= k).drop("_r")


def run_name(path: Column, renames: dict[str, str] = RUN_NAMES) -> Column:
    """The first part of a path, with ordered replacements."""
    out = F.split_part(path, F.lit("/"), F.lit(1))
    for old, new in renames.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def infer_inputs(name: Column, rules: list[tuple[str, int, str]] = MODEL_INPUTS) -> Column:
    """(num_inputs, suffixes) of a model by its file name: of the first rule whose text it holds; null if none fits."""
    out = F.lit(None).cast("struct<num_inputs:int,suffixes:string>")
    for text, n, suffixes in reversed(rules):
        out = F.when(F.contains(name, F.lit(text)), F.struct(F.lit(n).alias("num_inputs"), F.lit(suffixes).alias("suffixes"))).otherwise(out)
    return out


def drop_noise(lines: DataFrame, patterns: list[str] = NOISE_PATTERNS, line: str = "value") -> DataFrame:
    """Lines that match none of the patterns."""
    return lines.where(~F.coalesce(F.col(line).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)))


def settings_tokens(parameters: DataFrame, flags: list[str]) -> DataFrame:
    """Command-line tokens, one per row in order: a name and its value for what isn't null, a bare name for what is true."""
    parts = []
    for name in flags:
        kind = dict(parameters.dtypes)[name]
        flag = F.lit("--" + name.replace("_", "-"))
        none = F.array().cast("array<string>")
        parts.append(F.when(F.col(name), F.array(flag)).otherwise(none) if kind == "boolean" else F.when(F.col(name).isNotNull(), F.array(flag, F.col(name).cast("string"))).otherwise(none))
    return parameters.select("*", F.posexplode(F.concat(*parts)).alias("pos", "token"))
