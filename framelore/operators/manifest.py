"""Clip manifests: checks as one table of violations, leakage between roles, role-based access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelore.functions import fixed
from framelore.functions.scalars import normalised


class FrozenAccessError(RuntimeError):
    """Frozen rows were asked for in a context that may not see them."""


def missing_fields(clips: DataFrame, required: tuple[str, ...] = ("clip_id", "dataset", "role", "label", "source_path")) -> DataFrame:
    blank = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) for c in required]
    return clips.withColumn("missing", F.array_compact(F.array(*blank))).where(F.size("missing") > 0)


def outside_domain(clips: DataFrame, column: str, domain: tuple[str, ...], nulls_pass: bool = False) -> DataFrame:
    c = F.col(column)
    return clips.where((c.isNotNull() & ~c.isin(*domain)) if nulls_pass else ~F.coalesce(c.isin(*domain), F.lit(False)))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def role_conflicts(clips: DataFrame, key: str, one: str = "train", other: str = "validate") -> DataFrame:
    """Keys under both roles, by one aggregation: no self-join, and a hot key is reduced before it moves.  Nulls are no key."""
    both = clips.where(F.col(key).isNotNull() & F.col("role").isin(one, other)).groupBy(key).agg(F.bool_or(F.col("role") == one).alias("a"), F.bool_or(F.col("role") == other).alias("b"))
    return both.where("a and b").select(key)


def unknown_datasets(clips: DataFrame, known: DataFrame) -> DataFrame:
    """Datasets that aren't in known(dataset), each with its first clip by pos."""
    return clips.join(known, "dataset", "left_anti").groupBy("dataset").agg(F.min_by("clip_id", "pos").alias("clip_id"))


def vault_breaches(clips: DataFrame, vault: tuple[str, ...] = fixed.VAULT_DATASETS, frozen: str = fixed.FROZEN_ROLE) -> DataFrame:
    """A clip of a vault dataset outside the frozen role, or another one inside."""
    return clips.where(F.coalesce(F.col("dataset").isin(*vault), F.lit(False)) != F.coalesce(F.col("role") == frozen, F.lit(False)))


def visible(clips: DataFrame, context: str | None, frozen: tuple[str, ...] = (fixed.FROZEN_ROLE,)) -> DataFrame:
    """Rows that a context may see: frozen ones only in the final judgement; unknown contexts have no privileges."""
    return clips if (context or "").strip().lower() in fixed.FROZEN_CONTEXTS else clips.where(~F.coalesce(F.col("role").isin(*frozen), F.lit(False)))


def frozen_only(clips: DataFrame, context: str | None) -> DataFrame:
    if (context or "").strip().lower() not in fixed.FROZEN_CONTEXTS:
        raise FrozenAccessError(f"context {context!r} may not read {fixed.FROZEN_ROLE} rows")
    return clips.where(F.col("role") == fixed.FROZEN_ROLE)


def assert_no_frozen(clips: DataFrame, context: str | None) -> DataFrame:
    """The rows; reading a frozen one outside the final judgement raises, naming it."""
    if (context or "").strip().lower() in fixed.FROZEN_CONTEXTS:
        return clips
    leak = F.raise_error(F.concat(F.lit("frozen clip in an unprivileged context: "), F.col("clip_id").cast("string")))
    return clips.where(F.when(F.col("role") == fixed.FROZEN_ROLE, leak.cast("boolean")).otherwise(True))


def camera_filter(clips: DataFrame, camera: str) -> DataFrame:
    """Clips whose notes hold camera=<camera> (as a substring); an empty filter passes all, null notes fail."""
    return clips.where(F.coalesce(F.col("notes").contains(f"camera={camera}"), F.lit(False))) if camera else clips


FINDING = "array<struct<severity:string,rule:string,key:string,detail:string>>"


def _finding(condition: Column, severity: str, rule: str, key: Column, detail: Column) -> Column:
    """A struct of a finding where the condition holds, else null."""
    return F.when(condition, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail")))


def _row_rules() -> list[Column]:
    key, none = F.col("clip_id"), F.lit(None)
    inside = lambda c, domain: F.coalesce(F.col(c).isin(*domain), F.lit(False))
    missing = F.array_compact(F.array(*(F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) for c in ("clip_id", "dataset", "role", "label", "source_path"))))
    tags = (("lighting", fixed.LIGHTING), ("occlusion", fixed.OCCLUSION), ("action_confuser", fixed.CONFUSERS))
    return [
        _finding(F.size(missing) > 0, "error", "required_fields", key, F.array_join(missing, ",")),
        _finding(~inside("role", fixed.ROLES), "error", "role", key, F.col("role")),
        _finding(~inside("label", fixed.LABELS), "error", "label", key, F.col("label")),
        _finding(F.coalesce("dataset", F.lit("")) == "", "error", "dataset", key, none),
        _finding(inside("dataset", fixed.VAULT_DATASETS) != F.coalesce(F.col("role") == fixed.FROZEN_ROLE, F.lit(False)), "error", "vault", key, F.col("dataset")),
        *(_finding(F.col(c).isNotNull() & ~inside(c, d), "warning", f"slice_{c}", key, F.col(c)) for c, d in tags),
    ]


def validate(clips: DataFrame, version: str = "1.1") -> DataFrame:
    """All checks over a manifest as rows (severity, rule, key, detail); a manifest without error rows is valid.

    Two passes.  Rules of a row are an array of findings, exploded.  Rules of keys (repeated ids, keys under two roles,
    unknown and absent datasets) are one unpivot to (rule, key, role) and one aggregation, which reduces hot keys before
    they move.
    """
    spark, none = clips.sparkSession, F.lit(None)
    rows = clips.select(F.inline(F.array_compact(F.array(*_row_rules())).cast(FINDING)))
    known = F.coalesce(F.col("dataset").isin(*fixed.IN_SCOPE_DATASETS, *fixed.VAULT_DATASETS), F.lit(False))
    listed = F.coalesce((F.col("role") == "debug") & F.col("dataset").isin(*fixed.CROSS_LISTED_DATASETS), F.lit(False))
    unit = lambda rule, key: F.struct(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))
    units = F.array(
        unit("clip_id", "clip_id"), F.when(F.col("source_path").isNotNull(), unit("source_path", "source_path")), F.when(F.col("subject_id").isNotNull(), unit("subject_id", "subject_id")),
        F.when(~known, unit("unknown", "dataset")), F.when(listed, unit("listed", "dataset")),
    )
    keyed = clips.select(F.explode(F.array_compact(units)).alias("u"), "role", F.struct("pos", F.col("clip_id").cast("string").alias("clip_id")).alias("c"), F.lit(1).alias("n"))
    keyed = keyed.select("u.rule", "u.key", "role", "c", "n")
    expected = spark.createDataFrame([("listed", d) for d in fixed.CROSS_LISTED_DATASETS], "rule string, key string")
    keyed = keyed.unionAll(expected.select("rule", "key", none.cast("string"), none.cast(keyed.schema["c"].dataType), F.lit(0)))
    role = lambda r: F.coalesce(F.bool_or(F.col("role") == r), F.lit(False))
    keys = keyed.groupBy("rule", "key").agg(F.sum("n").alias("n"), (role("train") & role("validate")).alias("both"), F.min("c").alias("first"))
    is_ = lambda rule: F.col("rule") == rule
    findings = [
        _finding(is_("clip_id") & (F.col("n") > 1), "error", "duplicate_clip_id", F.col("key"), F.col("n")),
        _finding(is_("clip_id") & F.col("both") & F.col("key").isNotNull(), "error", "train_validate", F.col("key"), none),
        _finding(is_("source_path") & F.col("both"), "error", "source_path_leak", F.col("key"), none),
        _finding(is_("subject_id") & F.col("both"), "error", "subject_leak", F.col("key"), none),
        _finding(is_("unknown"), "warning", "unknown_dataset", F.col("first.clip_id"), F.col("key")),
        _finding(is_("listed") & (F.col("n") == 0), "warning", "cross_listed", F.col("key"), none),
    ]
    found = rows.unionAll(keys.select(F.inline(F.array_compact(F.array(*findings)).cast(FINDING))))
    if version not in fixed.SCHEMA_VERSIONS:
        errors = [("error", "schema_version", None, version)] + [("error", "schema_version", None, "empty")] * (not version)
        found = found.unionAll(spark.createDataFrame(errors, "severity string, rule string, key string, detail string"))
    return found


def by_role(clips: DataFrame, role: str) -> DataFrame:
    return clips.where(F.col("role") == role)


def frozen_present(clips: DataFrame) -> bool:
    return not clips.where(F.col("role") == fixed.FROZEN_ROLE).isEmpty()


def label_counts(clips: DataFrame) -> DataFrame:
    return clips.groupBy("label").agg(F.count("*").alias("n"))


def parse_clips(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed clips, rejects (pos, field, error)) of raw clips: pos and text columns.  A clip's first error counts.

    Required fields come in the order of the manifest; role and label have to be known; numbers and booleans have to read.
    """
    checks = []
    for c in ("clip_id", "dataset", "role", "label", "source_path"):
        checks.append(F.when(F.coalesce(F.col(c), F.lit("")) == "", F.struct(F.lit(c).alias("field"), F.lit("missing").alias("error"))))
        domain = {"role": fixed.ROLES, "label": fixed.LABELS}.get(c)
        if domain:
            checks.append(F.when(~normalised(F.col(c)).isin(*domain), F.struct(F.lit(c).alias("field"), F.lit("unknown").alias("error"))))
    typed = normalise(raw).withColumn("dataset", normalised(F.col("dataset")))
    checks.append(F.when(F.size("errors") > 0, F.struct(F.get("errors", F.lit(0)).alias("field"), F.lit("type").alias("error"))))
    rows = typed.withColumn("__why", F.coalesce(*checks))
    return rows.where("__why is null").drop("__why", "errors"), rows.where("__why is not null").select("pos", "__why.field", "__why.error")


def normalise(raw: DataFrame) -> DataFrame:
    """Raw text columns of a manifest as typed ones, with the errors of each row (array of column names)."""
    numbers = {"duration_sec": "double", "frame_count": "int"}
    from framelore.functions.scalars import bad_bool, to_bool

    typed = {c: F.col(c).try_cast(t) for c, t in numbers.items()} | {"multi_person": to_bool(F.col("multi_person"))}
    typed |= {c: normalised(F.col(c)) for c in ("role", "label", "lighting", "occlusion", "action_confuser")}
    bad = [F.when(F.col(c).isNotNull() & (F.trim(c) != "") & F.col(c).try_cast(t).isNull(), F.lit(c)) for c, t in numbers.items()]
    errors = F.array_compact(F.array(*bad, F.when(bad_bool(F.col("multi_person")), F.lit("multi_person"))))
    return raw.select(*(typed.get(c, F.col(c)).alias(c) for c in raw.columns), errors.alias("errors"))
