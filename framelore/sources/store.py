"""A store of metric rows by run: versions in Parquet, each published by one manifest, never overwritten by accident."""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelore.functions.fixed import FORMAT_VERSION
from framelore.functions.na import decode, encode, is_marker
from framelore.functions.scalars import context as coerced

METRIC = "name string, value double, na_reason string, higher_is_better boolean, tag string, tag_value string, level string"


class RunConflict(RuntimeError):
    """A run exists already, or another writer has published its next version first."""


def run_path(root: str, run_id: str) -> str:
    if not run_id or run_id in (".", "..") or re.search(r"[/\\]", run_id):
        raise ValueError(f"not a run id: {run_id!r}")
    return f"{root.rstrip('/')}/run_id={run_id}"


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, root: str, run_id: str) -> list[int]:
    """Versions of a run that have been published, ascending."""
    store, folder = _files(spark, f"{run_path(root, run_id)}/_versions")
    names = [s.getPath().getName() for s in store.listStatus(folder)] if store.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d{8}\.json", n))


def _publish(spark: SparkSession, root: str, run_id: str, version: int, text: str) -> None:
    """Put a version's manifest in place if there is none yet: one of several writers wins, and it appears whole.

    On a local file system by a hard link, elsewhere by an exclusive create, which the store has to offer (HDFS does).
    """
    store, target = _files(spark, f"{run_path(root, run_id)}/_versions/{version:08d}.json")
    store.mkdirs(target.getParent())
    if store.getScheme() == "file":
        name = target.toUri().getPath()
        part = f"{name}.{uuid.uuid4().hex}.part"
        with open(part, "x") as out:
            out.write(text)
        try:
            os.link(part, name)
        except FileExistsError:
            raise RunConflict(f"version {version} of run {run_id!r} has been published by another writer") from None
        finally:
            os.unlink(part)
        return
    try:
        out = store.create(target, False)
    except Exception as error:
        raise RunConflict(f"version {version} of run {run_id!r} could not be published: {error}") from error
    out.write(bytearray(text.encode()))
    out.close()


def save_run(metrics: DataFrame, root: str, run_id: str, model_id: str, context: str = "unknown", overwrite: bool = False) -> str:
    """Write metric rows as a run's next version, and return where they lie; a run that exists is an error unless overwrite.

    Rows are written under a fresh name and become the run when a small manifest is put in place, so a run can be
    read at every moment, and earlier versions stay readable.  If writing fails, or another writer publishes this version
    first (RunConflict), the rows go and the run is as before.  A row needs exactly one of value and na_reason.
    """
    spark, path = metrics.sparkSession, run_path(root, run_id)
    known = versions(spark, root, run_id)
    if known and not overwrite:
        raise RunConflict(f"run {run_id!r} exists")
    ok = F.col("name").isNotNull() & (F.col("name") != "") & (F.col("value").isNull() != F.col("na_reason").isNull())
    checked = metrics.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("malformed metric: "), F.coalesce("name", F.lit("null")))).cast("boolean")))
    rows = checked.select(F.lit(FORMAT_VERSION).alias("format_version"), F.lit(model_id).alias("model_id"), F.lit(context).alias("context"), F.current_timestamp().alias("created_at"), "*")
    version, name = (known[-1] if known else 0) + 1, f"data-{uuid.uuid4().hex}"
    try:
        rows.write.parquet(f"{path}/{name}")
        _publish(spark, root, run_id, version, json.dumps({"format_version": FORMAT_VERSION, "version": version, "data": name, "model_id": model_id}))
    except BaseException:
        store, where = _files(spark, f"{path}/{name}")
        store.delete(where, True)
        raise
    return f"{path}/{name}"


def load_run(spark: SparkSession, root: str, run_id: str, version: int | None = None) -> DataFrame:
    """Metric rows of a run's latest version, or of an earlier one; another format version is an error."""
    known = versions(spark, root, run_id)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no run {run_id!r}" + (f" of version {version}" if version else ""))
    manifest = spark.read.text(f"{run_path(root, run_id)}/_versions/{version or known[-1]:08d}.json", wholetext=True).first()["value"]
    rows = spark.read.parquet(f"{run_path(root, run_id)}/{json.loads(manifest)['data']}")
    bad = F.raise_error(F.concat(F.lit("format version "), F.coalesce("format_version", F.lit("null")))).cast("boolean")
    return rows.where(F.when(F.col("format_version") == FORMAT_VERSION, True).otherwise(bad))


PAYLOAD = (
    "format_version string, metadata struct<run_id:string,model_id:string,created_at:string,context:string,notes:string>, "
    "metrics array<struct<name:string,value:string,higher_is_better:boolean>>"
)


def run_metadata(run_id: Column, model_id: Column, context: Column, notes: Column) -> Column:
    """struct of a run's metadata: the time in UTC, an unknown context as "unknown"."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return F.struct(run_id.alias("run_id"), model_id.alias("model_id"), now.alias("created_at"), coerced(context).alias("context"), notes.alias("notes"))


def parse_payload(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Payloads with p, what they hold, and error: why one can't be read, else null.  Nothing is guessed."""
    text, p = F.col(column), F.from_json(column, PAYLOAD)
    part = lambda name: F.get_json_object(text, f"$.{name}")
    good = lambda m: (F.coalesce(m["name"], F.lit("")) != "") & (decode(m["value"])["value"].isNotNull() | is_marker(m["value"]))
    metrics = F.coalesce(p["metrics"], F.array().cast("array<struct<name:string,value:string,higher_is_better:boolean>>"))
    error = (
        F.when(~F.coalesce(F.trim(text).startswith("{"), F.lit(False)), "not an object").when(F.coalesce(part("format_version"), F.lit("")) == "", "no format version")
        .when(part("format_version") != FORMAT_VERSION, "unsupported format version")
        .when(~F.coalesce(part("metadata").startswith("{"), F.lit(False)), "metadata")
        .when(part("metrics").isNotNull() & ~part("metrics").startswith("["), "metrics").when(~F.forall(metrics, lambda m: F.coalesce(good(m), F.lit(False))), "metric")
    )
    return payloads.select("*", p.alias("p"), error.alias("error"))


def readable_metrics(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """payload_metrics() of the payloads that can be read, with the payloads' other columns; parse_payload() says why the rest can't.

    A payload without metrics, or that can't be read, is one row with nulls.
    """
    rows = parse_payload(payloads, column)
    others = [c for c in payloads.columns if c != column]
    rows = rows.select(*others, F.when(F.col("error").isNull(), F.col("p")).alias("p"))
    rows = rows.select(*others, "p.metadata.run_id", "p.metadata.model_id", F.explode_outer("p.metrics").alias("m"))
    return rows.select(*others, "run_id", "model_id", "m.name", decode(F.col("m.value")).alias("v"), "m.higher_is_better").select(*others, "run_id", "model_id", "name", "v.*", "higher_is_better")


def payload_metrics(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Metric rows (run_id, model_id, name, value, na_reason, higher_is_better) of payloads; one that can't be read is an error."""
    rows = parse_payload(payloads, column)
    rows = rows.where(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("metric payload: "), "error")).cast("boolean")))
    rows = rows.select("p.metadata.run_id", "p.metadata.model_id", F.explode("p.metrics").alias("m"))
    return rows.select("run_id", "model_id", "m.name", decode(F.col("m.value")).alias("v"), "m.higher_is_better").select("run_id", "model_id", "name", "v.*", "higher_is_better")


def payload(rows: DataFrame) -> DataFrame:
    """One row: the metrics as JSON, values or markers, and a summary line."""
    item = F.struct("name", encode(F.col("value"), F.col("na_reason"), F.col("name")).alias("value"), "higher_is_better")
    return rows.agg(
        F.to_json(F.sort_array(F.collect_list(item))).alias("metrics"),
        F.concat_ws("/", F.concat(F.lit("metrics="), F.count("value").cast("string")), F.count("*").cast("string")).alias("summary"),
    )
