"""Scorers that are fitted with an early stop, stored with a manifest, and used in other sessions.

A stored scorer is a folder: `model` (a pipeline of indexers, an assembler and boosted trees) and `manifest`, one JSON
row that binds it: version, feature names, rows and groups it was fitted on, and a digest of the model's files. Loading
refuses a model whose features or files aren't what the manifest says.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritill.functions.hashing import hex_number, sha
from veritill.operators.metrics import sensitivity
from veritill.operators.ml import _applied
from veritill.sources import files

MANIFEST = "version string, numeric array<string>, categorical array<string>, rows bigint, validation_rows bigint, trees int, model_sha256 string"


class Scorer(NamedTuple):
    model: PipelineModel
    numeric: list[str]
    categorical: list[str]
    version: str

    def score(self, rows: DataFrame, name: str = "score") -> DataFrame:
        """Rows with the probability of label 1; columns of theirs stay as they are."""
        own = ["features", *(f"{c}_index" for c in self.categorical)]
        kept = {c: f"_kept_{c}" for c in own if c in rows.columns}
        return _applied(self.model, rows.withColumnsRenamed(kept), name).drop(*own).withColumnsRenamed({v: k for k, v in kept.items()})

    def rescored(self, rows: DataFrame, changes: dict[str, Column], before: str = "before", after: str = "after") -> DataFrame:
        """Rows with two scores, of what they are and of what they would be with some columns changed; both in one pass, without a shuffle."""
        d = self.score(rows, before)
        own = {c: f"_before_{c}" for c in changes}
        d = self.score(d.withColumns({v: F.col(k) for k, v in own.items()}).withColumns(changes), after)
        return d.withColumns({k: F.col(v) for k, v in own.items()}).drop(*own.values())


def with_validation(df: DataFrame, group: str, percent: int = 20, name: str = "is_validation") -> DataFrame:
    """Rows with a flag on those of the groups that a fit is stopped by: by a hash of the group, so that none is on both sides."""
    return df.withColumn(name, hex_number(sha("early-stop", F.col(group)), 8) % 100 < percent)


def fit(rows: DataFrame, numeric: list[str], categorical: list[str], group: str, label: str = "label", weight: str | None = None, trees: int = 40, depth: int = 4, tolerance: float = 0.01, version: str = "trees-1") -> tuple[Scorer, dict]:
    """Boosted trees, fitted until the groups held out no longer gain, and what their manifest says."""
    d = with_validation(rows, group, name="_validation").select(*numeric, *categorical, label, *([weight] if weight else []), "_validation")
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep").fit(d) for c in categorical]
    stages.append(VectorAssembler(inputCols=[*numeric, *(f"{c}_index" for c in categorical)], outputCol="features", handleInvalid="keep"))
    ready = PipelineModel(stages).transform(d)
    extra = {"weightCol": weight} if weight else {}
    model = GBTClassifier(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, seed=2026, validationIndicatorCol="_validation", validationTol=tolerance, **extra).fit(ready)
    n = d.agg(F.count(F.when(~F.col("_validation"), 1)).alias("rows"), F.count(F.when(F.col("_validation"), 1)).alias("validation_rows")).first()
    facts = {"rows": n["rows"], "validation_rows": n["validation_rows"], "trees": model.getNumTrees}
    return Scorer(PipelineModel([*stages, model]), numeric, categorical, version), facts


def _digest(spark: SparkSession, path: str) -> str:
    return files.tree_checksums(spark, path, [path]).filter("name = '.'").first()["sha256"]


def save(spark: SparkSession, scorer: Scorer, path: str, facts: dict) -> None:
    """Writes the model and then its manifest; refuses to overwrite."""
    scorer.model.write().save(f"{path}/model")
    row = (scorer.version, scorer.numeric, scorer.categorical, facts["rows"], facts["validation_rows"], facts["trees"], _digest(spark, f"{path}/model"))
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


def load(spark: SparkSession, path: str, numeric: list[str], categorical: list[str], version: str = "trees-1") -> Scorer:
    """The stored scorer, if its manifest names these features and this version, and its files are the ones it was written with."""
    m = files.read_lines(spark, f"{path}/manifest", MANIFEST).first()
    if (m["numeric"], m["categorical"]) != (numeric, categorical):
        raise ValueError(f"the model was fitted on {m['numeric']} and {m['categorical']}")
    if m["version"] != version:
        raise ValueError(f"the model is version {m['version']}, not {version}")
    if m["model_sha256"] != _digest(spark, f"{path}/model"):
        raise ValueError("the model's files aren't the ones that its manifest was written for")
    return Scorer(PipelineModel.load(f"{path}/model"), numeric, categorical, version)


def perturbed(scorer: Scorer, rows: DataFrame, changes: dict[str, Column], threshold: float) -> DataFrame:
    """How much scores and decisions move when some columns are changed (see metrics.sensitivity)."""
    return sensitivity(scorer.rescored(rows, changes), "before", "after", threshold)
