"""The whole run: split, fit, clean, screen, pack, take in hypotheses, validate, report."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.operators import evidence, intake, report
from siftwright.operators.prep import Prep, PrepModel
from siftwright.operators.screen import ScreenConfig, screen_and_correct
from siftwright.operators.split import split_summary, train_test_split
from siftwright.operators.validate import ValidationConfig, validate
from siftwright.plans.materialize import pin
from siftwright.plans.together import together
from siftwright.sources.writers import StageStore


@dataclass(frozen=True)
class RunConfig:
    test_size: float = 0.3
    seed: int = 42
    prep: Prep = field(default_factory=Prep)
    screen: ScreenConfig = field(default_factory=ScreenConfig)
    pack: evidence.PackConfig = field(default_factory=evidence.PackConfig)
    validation: ValidationConfig = field(default_factory=ValidationConfig)
    requested_hypotheses: int | None = None


@dataclass
class Source:
    """One input table: its rows, a unique key column, and optionally a column to stratify on."""

    df: DataFrame
    key: str
    stratify: str | None = None


@dataclass
class Run:
    """Result tables of a run, each with a `dataset` column; later ones stay empty if it stopped early."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    models: dict[str, PrepModel] = field(default_factory=dict)
    test_sets: dict[str, DataFrame] = field(default_factory=dict)
    row_keys: dict[str, str] = field(default_factory=dict)
    stopped_after: str | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def discover(sources: dict[str, Source], responses: DataFrame | None = None, config: RunConfig | None = None) -> Run:
    """Run all stages for any number of datasets; an error in a stage stops the run.

    Without `responses` (dataset, response) the run ends after the prompts; call `finish` with the
    responses later to go on.
    """
    cfg = config or RunConfig()
    run = Run()
    spark = next(iter(sources.values())).df.sparkSession
    names = list(sources)
    done = together(spark, [lambda n=n: _one(n, sources[n], cfg) for n in names])
    for name, (model, test_set, row_key, _) in zip(names, done):
        run.models[name], run.test_sets[name], run.row_keys[name] = model, test_set, row_key
    run.tables |= {t: _stack([tables[t] for *_, tables in done]) for t in done[0][-1]}
    packs = pin(evidence.evidence_packs(run["filtered"], run["profile"], cfg.pack))
    asked = evidence.prompts(packs, cfg.requested_hypotheses)
    run.tables |= {
        "packs": packs, "prompts": asked,
        "prompt_metadata": evidence.prompt_metadata(asked, cfg.pack, cfg.requested_hypotheses),
    }
    if responses is None:
        run.stopped_after = "prompt"
        return run
    return finish(run, responses, cfg)


def _one(name: str, src: Source, cfg: RunConfig) -> tuple[PrepModel, DataFrame, str, dict[str, DataFrame]]:
    """Split, clean and screen one dataset: (model, cleaned test rows, name of the row key in them, tables)."""
    split = pin(train_test_split(src.df, src.key, cfg.test_size, cfg.seed, src.stratify))
    train = split.filter(F.col("split") == "train").drop("split")
    test = split.filter(F.col("split") == "test").drop("split")
    model = cfg.prep.fit(train, name)
    clean = model.transform(train)
    full, kept = screen_and_correct(clean, model.profile, name, cfg.screen)
    summary = split_summary(split, cfg.test_size, cfg.seed, src.stratify).withColumn("dataset", F.lit(name))
    taken = {c.lower() for c in [*src.df.columns, *model.output_columns()]}
    row_key = "row_key"
    while row_key in taken:
        row_key += "_"
    test_set = model.transform(test.withColumn(row_key, F.col(f"`{src.key}`")), keep=(row_key,))
    cleaning = model.summary(train, clean, "train").unionByName(model.summary(test, test_set, "test"))
    return model, test_set, row_key, {
        "split_summary": summary, "profile": model.profile, "state": model.state(src.df.sparkSession),
        "transform_log": model.transform_log(clean), "test_transform_log": model.transform_log(test_set),
        "cleaning_summary": cleaning, "associations": full, "filtered": kept,
    }


def finish(run: Run, responses: DataFrame, config: RunConfig | None = None) -> Run:
    """Take in responses and validate; stops when no dataset has a usable response."""
    cfg = config or RunConfig()
    hypotheses, errors = intake.parse(responses)
    hypotheses = pin(hypotheses)
    run.tables |= {"hypotheses": hypotheses, "response_errors": errors, "response_metadata": intake.response_metadata(responses)}
    present = {r["dataset"] for r in hypotheses.select("dataset").distinct().collect()}
    known = [name for name in run.test_sets if name in present]
    # responses for datasets that this run does not have
    run.tables["unknown_datasets"] = hypotheses.filter(~F.col("dataset").isin(list(run.test_sets)) | F.col("dataset").isNull())
    if not known:
        run.stopped_after = "hypotheses"
        return run
    done = together(responses.sparkSession, [
        lambda n=n: validate(run.test_sets[n], hypotheses, n, cfg.validation, key=run.row_keys[n]) for n in known
    ])
    results = _stack([v.results for v in done])
    run.tables |= {
        "results": results, "rejections": _stack([v.rejected for v in done]),
        "validation_summary": _stack([v.summary for v in done]),
        **{f"hypotheses_{s}": _stack([v.hypotheses(s) for v in done]) for s in ("kept", "validated", "final")},
        "summary": report.plain_summary(results), "summary_prompts": report.summary_prompts(results),
    }
    resampled = [v.replicates.withColumn("dataset", F.lit(n)) for n, v in zip(known, done) if v.replicates is not None]
    if resampled:
        run.tables["replicates"] = _stack(resampled)
    run.stopped_after = None
    return run


#: The stage folder of each table of a run.
STAGE_TABLES = {
    "data": ["split_summary"],
    "preprocess": ["profile", "state", "transform_log", "test_transform_log", "cleaning_summary"],
    "associations": ["associations", "filtered"],
    "prompt": ["packs", "prompts", "prompt_metadata"],
    "hypotheses": ["hypotheses", "response_errors", "response_metadata", "unknown_datasets"],
    "validation": ["results", "rejections", "validation_summary", "hypotheses_kept", "hypotheses_validated", "hypotheses_final", "replicates"],
    "summary": ["summary", "summary_prompts"],
}


def save(run: Run, store: StageStore) -> list[str]:
    """Write every table that the run has into its stage folder; returns the paths."""
    return [store.save(stage, t, run[t]) for stage, tables in STAGE_TABLES.items() for t in tables if t in run.tables]
