"""``python -m rallygrid.train --tables DIR --models DIR --tour atp --surface hard``: fit and store a model."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from rallygrid.ml import boosted_trees, logistic, score
from rallygrid.operators.evaluate import auc, probability_scores
from rallygrid.plans.base import bets
from rallygrid.plans.learning import FEATURES
from rallygrid.session import cut_lineage, get_session, table
from rallygrid.sources.sinks import model_folder, save_model

ENGINES = {"boosted": boosted_trees, "logistic": logistic}


def train_model(spark, tables: str, models: str, tour: str, surface: str, engine: str = "boosted", version: str = "v1", cut: str = "2023-01-01") -> dict:
    """Fit on the matches of a tour and surface before the cut, measure on the rest, store both; returns the metrics."""
    levels = table(spark, tables, "training_matches").groupBy(
        F.least("player_a_id", "player_b_id").alias("lo"), F.greatest("player_a_id", "player_b_id").alias("hi"), F.to_date("match_date").alias("match_date")
    ).agg(F.max("tourney_level").alias("level"))
    rows = bets(spark, tables).filter(F.lower("surface") == surface.lower()).withColumns({"lo": F.least("player", "opponent"), "hi": F.greatest("player", "opponent")})
    challenger = F.col("level") == "C"
    rows = rows.join(levels, ["lo", "hi", "match_date"]).filter(challenger if tour.lower() == "challenger" else ~challenger)
    rows = cut_lineage(rows.select("match_date", F.col("target").cast("double").alias("target"), *[F.col(c).cast("double").alias(c) for c in FEATURES]))
    model = ENGINES[engine](FEATURES).fit(rows.filter(F.col("match_date") < cut))
    judged = score(model, rows.filter(F.col("match_date") >= cut))
    metrics = probability_scores(judged, "target", "p").join(auc(judged, "target", "p")).first().asDict()
    save_model(model, model_folder(models, tour, surface, engine, version), list(FEATURES), metrics, {"tour": tour, "surface": surface, "engine": engine, "version": version, "cut": cut})
    return metrics


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    for name in ("tables", "models", "tour", "surface"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--engine", default="boosted", choices=sorted(ENGINES))
    p.add_argument("--version", default="v1")
    a = p.parse_args()
    print(train_model(get_session("train"), a.tables, a.models, a.tour, a.surface, a.engine, a.version))


if __name__ == "__main__":
    main()
