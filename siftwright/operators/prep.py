"""Cleaning: fit rules on the training part, apply them to any table with one select."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwright import schemas
from siftwright.functions.numbers import tolerant_as
from siftwright.operators.profile import (
    ProfileConfig, ingest, original_types, profile_frame, profile_rows,
)
from siftwright.plans.materialize import small_frame


@dataclass(frozen=True)
class Prep:
    """Estimator: `fit` profiles a table and decides one rule per column."""

    profile_config: ProfileConfig = field(default_factory=ProfileConfig)
    add_outlier_flags: bool = True
    add_missing_indicators: bool = True
    skew_mean_threshold: float = 0.5
    outlier_rate_mean_threshold: float = 0.05
    categorical_missing_token: str = "missing"

    def policy(self) -> dict:
        c = self.profile_config
        return {
            "missing_threshold": c.missing_threshold,
            "drop_constant": c.drop_constant,
            "drop_id_like": c.drop_id_like,
            "drop_high_missing": c.drop_high_missing,
            "add_outlier_flags": self.add_outlier_flags,
            "add_missing_indicators": self.add_missing_indicators,
            "skew_mean_threshold": self.skew_mean_threshold,
            "outlier_rate_mean_threshold": self.outlier_rate_mean_threshold,
            "min_stats_n": c.min_stats_n,
            "categorical_missing_token": self.categorical_missing_token,
        }

    def fit(self, df: DataFrame, dataset: str = "dataset") -> "PrepModel":
        cfg = self.profile_config
        rows = profile_rows(ingest(df, cfg.on_complex), cfg, original_types(df, cfg))
        spark = df.sparkSession
        rules = self.rules(small_frame(spark, [r.asDict() for r in rows],
            "column string, position int, feature_type string, dtype string, missing_rate double, "
            "skewness double, outlier_rate double, lower_bound double, upper_bound double, "
            "numeric boolean, mean double, median double",
        ), dataset)
        return PrepModel(rules.collect(), profile_frame(spark, dataset, rows), self.policy())

    def rules(self, facts: DataFrame, dataset: str) -> DataFrame:
        cfg = self.profile_config
        ft, rate = F.col("feature_type"), F.col("missing_rate")
        actions = F.filter(
            F.array(
                F.when((ft == "constant") & F.lit(cfg.drop_constant), F.lit("dropped_constant")),
                F.when((ft == "id_like") & F.lit(cfg.drop_id_like), F.lit("dropped_id_like")),
                F.when((rate > cfg.missing_threshold) & F.lit(cfg.drop_high_missing), F.lit("dropped_high_missing")),
            ),
            lambda x: x.isNotNull(),
        )
        kept = F.size("drop_actions") == 0
        number = F.col("numeric") & ~ft.isin("id_like", "constant")
        use_mean = F.coalesce(
            (F.abs("skewness") < self.skew_mean_threshold)
            & (F.col("outlier_rate") < self.outlier_rate_mean_threshold),
            F.lit(False),
        )
        imputation = F.when(
            number,
            F.struct(
                F.when(use_mean, "mean").otherwise("median").alias("method"),
                F.coalesce(F.when(use_mean, F.col("mean")).otherwise(F.col("median")), F.lit(0.0)).alias("num_value"),
                F.lit(None).cast("string").alias("str_value"),
            ),
        ).otherwise(
            F.struct(
                F.lit("constant_missing").alias("method"),
                F.lit(None).cast("double").alias("num_value"),
                F.lit(self.categorical_missing_token).alias("str_value"),
            )
        )
        fence = F.struct(
            F.lit(True).alias("enabled"), F.lit("iqr").alias("method"), "lower_bound", "upper_bound"
        )
        return facts.withColumn("drop_actions", actions).select(
            F.lit(dataset).alias("dataset"), "column", "position", "feature_type", "dtype",
            "missing_rate",
            (~kept).alias("drop"), "drop_actions",
            (F.lit(self.add_missing_indicators) & (rate > 0)).alias("add_missing_indicator"),
            F.when(kept, imputation).alias("imputation"),
            F.when(kept & number & F.lit(self.add_outlier_flags), fence).alias("outlier_flag"),
        ).orderBy("position")


def _flagged(rule: Row) -> bool:
    return rule["outlier_flag"] is not None and bool(rule["outlier_flag"]["enabled"])


class PrepModel:
    """Fitted rules. They are as many as there are columns, so they live on the driver."""

    def __init__(self, rules: list[Row], profile: DataFrame | None = None, policy: dict | None = None):
        self.rules = sorted(rules, key=lambda r: r["position"])
        self.profile = profile
        self.policy = policy or {}

    @property
    def dataset(self) -> str:
        return self.rules[0]["dataset"] if self.rules else "dataset"

    def state(self, spark: SparkSession) -> DataFrame:
        return small_frame(spark, self.rules, schemas.PREP_STATE)

    def save(self, spark: SparkSession, path: str) -> None:
        self.state(spark).coalesce(1).write.mode("overwrite").json(path)

    @staticmethod
    def load(spark: SparkSession, path: str | None) -> "PrepModel":
        if not path:
            raise ValueError("a saved preprocessing state is required to transform new data")
        return PrepModel(spark.read.schema(schemas.PREP_STATE).json(path).collect())

    def output_columns(self) -> list[str]:
        out: list[str] = []
        for r in self.rules:
            if r["drop"]:
                continue
            out.append(r["column"])
            if r["add_missing_indicator"]:
                out.append(f"{r['column']}__is_missing")
            if _flagged(r):
                out.append(f"{r['column']}__is_outlier")
        return out

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """Clean `df` with the fitted rules; `keep` passes key columns through unchanged."""
        keys = [F.col(f"`{k}`").alias(f"__keep_{k}") for k in keep]
        table = ingest(df, "skip")
        if keep:
            names = table.columns
            table = ingest(df.select("*", *keys), "skip").toDF(*names, *[f"__keep_{k}" for k in keep])
        present = set(table.columns)
        out: list[Column] = [F.col(f"`__keep_{k}`").alias(k) for k in keep]
        for r in self.rules:
            if r["drop"]:
                continue
            name, imp = r["column"], r["imputation"]
            raw = F.col(f"`{name}`") if name in present else F.lit(None).cast("string")
            method = imp["method"] if imp else None
            if method in ("mean", "median"):
                kind = table.schema[name].dataType if name in present else T.StringType()
                clean = F.coalesce(tolerant_as(raw, kind), F.lit(imp["num_value"]))
            elif method == "constant_missing":
                clean = F.coalesce(raw.cast("string"), F.lit(imp["str_value"]))
            else:
                clean = raw
            out.append(clean.alias(name))
            if r["add_missing_indicator"]:
                out.append(raw.isNull().cast("int").alias(f"{name}__is_missing"))
            if _flagged(r):
                low, high = r["outlier_flag"]["lower_bound"], r["outlier_flag"]["upper_bound"]
                flag = F.lit(0) if low is None or high is None else ((clean < low) | (clean > high)).cast("int")
                out.append(flag.alias(f"{name}__is_outlier"))
        return table.select(*out)

    def transform_log(self, cleaned: DataFrame) -> DataFrame:
        """What was dropped, imputed and added; outlier rates are measured on `cleaned`."""
        spark = cleaned.sparkSession
        flags = [r["column"] for r in self.rules if not r["drop"] and _flagged(r)]
        aggs = [F.avg(f"`{c}__is_outlier`").alias(c) for c in flags]
        rates = cleaned.agg(*aggs).first().asDict() if aggs else {}
        blank = dict.fromkeys(
            ["source", "method", "num_value", "str_value", "status", "actions", "feature_type",
             "missing_rate_train", "lower_bound", "upper_bound", "outlier_rate_on_transformed"]
        )
        log = []
        for r in self.rules:
            head = {**blank, "dataset": r["dataset"], "position": r["position"]}
            name = r["column"]
            if r["drop"]:
                log.append({**head, "kind": "dropped", "name": name, "actions": r["drop_actions"],
                            "feature_type": r["feature_type"], "missing_rate_train": r["missing_rate"]})
                continue
            if r["add_missing_indicator"]:
                log.append({**head, "kind": "engineered", "name": f"{name}__is_missing",
                            "source": name, "status": "missing_indicator"})
            imp = r["imputation"]
            if imp and imp["method"]:
                log.append({**head, "kind": "imputed", "name": name, "method": imp["method"],
                            "num_value": imp["num_value"], "str_value": imp["str_value"]})
            else:
                log.append({**head, "kind": "note", "name": f"no_imputation_rule:{name}"})
            if _flagged(r):
                o = r["outlier_flag"]
                bounded = o["lower_bound"] is not None and o["upper_bound"] is not None
                log.append({
                    **head, "kind": "engineered", "name": f"{name}__is_outlier", "source": name,
                    "method": "iqr" if bounded else None,
                    "status": "outlier_flag" if bounded else "skipped_no_bounds",
                    "lower_bound": o["lower_bound"], "upper_bound": o["upper_bound"],
                    "outlier_rate_on_transformed": rates.get(name) if bounded else None,
                })
        return small_frame(spark, log, schemas.TRANSFORM_LOG)

    def summary(self, raw: DataFrame, cleaned: DataFrame, mode: str) -> DataFrame:
        out = self.output_columns()
        engineered = [c for c in out if c.endswith(("__is_missing", "__is_outlier"))]
        dropped = [r["column"] for r in self.rules if r["drop"]]
        one, none = F.lit(1).alias("i"), F.lit(0).alias("i")
        counted = raw.select(one, F.lit(0).alias("o")).unionAll(cleaned.select(none, F.lit(1).alias("o")))
        return counted.agg(F.coalesce(F.sum("i"), F.lit(0)).alias("input_rows"), F.coalesce(F.sum("o"), F.lit(0)).alias("output_rows")).select(
            F.lit(self.dataset).alias("dataset"), F.lit(mode).alias("mode"),
            "input_rows",
            F.lit(len(raw.columns)).alias("input_cols"),
            "output_rows",
            F.lit(len(out)).alias("output_cols"),
            F.array(*[F.lit(c) for c in dropped]).cast("array<string>").alias("dropped_columns"),
            F.array(*[F.lit(c) for c in engineered]).cast("array<string>").alias("engineered_columns"),
        )


def with_policy(prep: Prep, **changes) -> Prep:
    """A copy of `prep` with profile or cleaning settings changed by name."""
    inner = {k: v for k, v in changes.items() if hasattr(prep.profile_config, k)}
    outer = {k: v for k, v in changes.items() if k not in inner}
    return replace(prep, profile_config=replace(prep.profile_config, **inner), **outer)
