"""Clean, build features, choose a model, train and predict, each step materialized."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.models import training
from gristmill.models.frame import resolve_target
from gristmill.operators.prep import check_target, require_rows
from gristmill.plans.federation import federate
from gristmill.sources.catalog import Catalog

# The stages of an experiment, in order.
STAGES = ("plan", "explore", "clean", "features", "model", "viz", "report")


@dataclass
class Experiment:
    target: str
    model: training.Model
    chosen: str
    features: list[str]
    results: DataFrame
    datasets: dict[str, str] = field(default_factory=dict)

    def table(self) -> DataFrame:
        """One row per candidate with its scores and whether it was chosen."""
        return self.results.selectExpr(
            "candidate AS model_type", "mean AS cv_mean", "std AS cv_std", "overfit_warning"
        ).withColumn("chosen", F.col("model_type") == self.chosen)


def run_experiment(
    catalog: Catalog,
    source: str,
    target: str,
    clean_sql: str,
    feature_sql: str,
    candidates: list[str],
    key: list[str] | None = None,
    name: str | None = None,
) -> Experiment:
    """``clean_sql`` reads ``data``, ``feature_sql`` reads the cleaned ``data``."""
    name = name or uuid.uuid4().hex[:8]
    names = {step: f"exp_{name}_{step}" for step in ("clean", "features", "predictions")}
    store = catalog.store
    candidates = training.valid_candidates(candidates)

    store.replace(names["clean"], require_rows(federate(catalog, clean_sql, {"data": source})))
    cleaned = catalog.load(f"dataset:{names['clean']}")
    built = federate(catalog, feature_sql, {"data": f"dataset:{names['clean']}"})
    found = resolve_target(built.columns, target)
    if found is None:
        raise ValueError(f"target '{target}' is missing from the feature table")
    store.replace(names["features"], built)
    table = catalog.load(f"dataset:{names['features']}")
    table = table.select(*[c for c in table.columns if not c.startswith("_")])
    if found == target:
        check_target(cleaned, table, target)

    features, by_fold = training.select_features(table, found, candidates[0], key=key)
    for other in candidates[1:]:
        by_fold = by_fold.unionAll(training.fold_scores(table, found, other, features, key=key))
    results = training.summary(by_fold)
    chosen = training.select_model(results)
    model = training.train(table, f"exp_{name}_model", found, chosen, features, key)
    training.predict_into(model, table, store, names["predictions"])
    return Experiment(found, model, chosen, features, results, names)
