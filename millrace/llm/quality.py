"""Quality classifier by co-training on two views of a document.

The text view sees what is written: hashed words, symbol runs and immediate repetitions. The metadata
view sees the page around it: source, language, size and layout statistics. Each view's logistic
regression is fitted on labelled rows; in every round each labels the pool rows it is sure about for the
other one. Held-out labelled rows then calibrate each view (Platt scaling) and weigh the two calibrated
log-odds into one score, which all documents get.

Fitting uses a bounded sample: at most ``MAX_LABELLED`` labelled and ``MAX_POOL`` unlabelled rows, those
with the least hashed ids. Everything else covers all rows, and scoring needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import FeatureHasher, HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import free_name, materialize

MAX_LABELLED, MAX_POOL = 8000, 8000
ROUNDS, SURE = 3, 0.97
TEXT_DIMS, META_DIMS = 1 << 12, 1 << 8
#: Every CALIBRATE-th labelled row, by hashed id, is held out.
CALIBRATE = 4
TOKENS = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"

NUMBERS = ("chars", "lines", "line_chars", "upper", "symbols", "digits", "spaces", "distinct")


def _text_tokens(text: Column) -> Column:
    """Lower-case words, numbers and symbol runs, and a mark for each that repeats the one before."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKENS), F.lit(0))
    return tokens


def _marks(tokens: Column) -> Column:
    again = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.when(a == b, "<again>"))
    return F.concat(tokens, F.filter(again, lambda x: x.isNotNull()))


def _layout(text: Column, tokens: Column) -> dict[str, Column]:
    n = F.greatest(F.length(text), F.lit(1))

    def share(drop: str) -> Column:
        return F.length(F.regexp_replace(text, drop, "")) / n

    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return {
        "chars": F.log1p(F.length(text)),
        "lines": F.log1p(lines),
        "line_chars": F.log1p(F.length(text) / lines),
        "upper": share(r"[^\p{Lu}]+"),
        "symbols": share(r"[\p{L}\p{N}\s]+"),
        "digits": share(r"[^\p{N}]+"),
        "spaces": share(r"\S+"),
        "distinct": F.size(F.array_distinct(tokens)) / F.greatest(F.size(tokens), F.lit(1)),
    }


def features(docs: DataFrame, text_col: str, kept: list[Column]) -> DataFrame:
    """``kept`` and the two views of each row as vectors (text_view, meta_view). Null texts count as
    empty, null or absent source and language as a value of their own."""
    have = {c.lower(): c for c in docs.columns}

    def category(name: str) -> Column:
        return F.coalesce(F.col(have[name]).cast("string"), F.lit("<null>")) if name in have else F.lit("<null>")

    row = docs.select(
        *kept,
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"),
        category("source").alias("_source"),
        category("lang").alias("_lang"),
    )
    row = row.withColumn("_k", _text_tokens(F.col("_t")))
    row = row.withColumns({f"_{k}": v for k, v in _layout(F.col("_t"), F.col("_k")).items()}).withColumn("_k", _marks(F.col("_k")))
    row = HashingTF(inputCol="_k", outputCol="_tf", numFeatures=TEXT_DIMS).transform(row)
    row = Normalizer(inputCol="_tf", outputCol="text_view", p=1.0).transform(row)
    row = FeatureHasher(inputCols=["_source", "_lang"], outputCol="_cat", numFeatures=META_DIMS).transform(row)
    row = VectorAssembler(inputCols=[*(f"_{k}" for k in NUMBERS), "_cat"], outputCol="meta_view").transform(row)
    return row.drop("_t", "_k", "_tf", "_cat", "_source", "_lang", *(f"_{k}" for k in NUMBERS))


def _needed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id as _id, the text as _text, and source and lang where there are any: under names of our own,
    so that no other column can clash."""
    have = {c.lower(): c for c in docs.columns}
    more = [F.col(have[c]).alias(c) for c in ("source", "lang") if c in have]
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *more)


def _sample(ids: DataFrame, most: int) -> DataFrame:
    return ids.orderBy(F.xxhash64("_id"), "_id").limit(most)


@dataclass
class CoTrained:
    """Two view models and how they are put together; ``None`` models: nothing could be learned."""

    text: LogisticRegressionModel | None = None
    meta: LogisticRegressionModel | None = None
    platt: tuple = ()
    weights: tuple = ()

    def odds(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the views' raw log-odds."""
        for name, model in (("text", self.text), ("meta", self.meta)):
            model = model.setRawPredictionCol("_raw").setProbabilityCol("").setPredictionCol("")
            rows = model.transform(rows).withColumn(f"_{name}_odds", vector_to_array("_raw")[1]).drop("_raw")
        return rows

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """All columns of ``docs`` and p_text, p_meta, score: the probabilities that quality is good.
        All three are null where no model could be fitted."""
        if self.text is None:
            return docs.withColumns({c: F.lit(None).cast("double") for c in ("p_text", "p_meta", "score")})
        rows = self.odds(features(docs, text_col, [F.col(c) for c in docs.columns]))
        (ta, tb), (ma, mb), (wt, wm, w0) = *self.platt, self.weights
        t, m = F.col("_text_odds") * ta + tb, F.col("_meta_odds") * ma + mb
        out = rows.withColumns({"p_text": sigmoid(t), "p_meta": sigmoid(m), "score": sigmoid(t * wt + m * wm + w0)})
        return out.drop("text_view", "meta_view", "_text_odds", "_meta_odds")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _regression(label: str, view: str, **how) -> LogisticRegression:
    return LogisticRegression(labelCol=label, featuresCol=view, maxIter=25, regParam=1e-3, **how)


def _fit_linear(rows: DataFrame, columns: list[str]) -> list[float]:
    """Slopes and intercept of a small regression; slopes are never negative."""
    rows = VectorAssembler(inputCols=columns, outputCol="_x").transform(rows)
    bounds = {"lowerBoundsOnCoefficients": _zeros(len(columns))}
    model = _regression("y", "_x", standardization=False, **bounds).fit(rows)
    return [*map(float, model.coefficients), float(model.intercept)]


def _zeros(n: int):
    from pyspark.ml.linalg import Matrices

    return Matrices.dense(1, n, [0.0] * n)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_labelled: int = MAX_LABELLED,
    max_pool: int = MAX_POOL,
    rounds: int = ROUNDS,
) -> CoTrained:
    """Co-trains on a bounded sample. Rows without an id or label are not used; a document labelled
    twice counts as its lower label. With fewer than two classes among the labels (or none) no model is
    fitted. Ids repeated among the documents are drawn together."""
    label = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("y")).dropna()
    label = label.groupBy("_id").agg(F.min("y").alias("y"))
    docs = _needed(docs, id_col, text_col)
    ids = docs.select("_id").dropna().distinct()
    chosen = _sample(label.join(ids, "_id", "left_semi"), max_labelled)
    pool = _sample(ids.join(label, "_id", "left_anti"), max_pool).withColumn("y", F.lit(None).cast("double"))
    chosen = materialize(chosen.unionByName(pool))
    views = docs.join(F.broadcast(chosen), "_id")  # bounded by the two parameters
    held = (F.pmod(F.xxhash64(F.lit("held out"), "_id"), F.lit(CALIBRATE)) == 0) & F.col("y").isNotNull()
    views = features(views, "_text", [F.col("_id"), F.col("y"), held.alias("_held")])
    views = materialize(views.withColumns({"_text_y": F.when(~F.col("_held"), F.col("y")), "_meta_y": F.when(~F.col("_held"), F.col("y"))}))
    seen = views.groupBy("_held").agg(F.count_distinct("y").alias("classes")).where("classes > 1").count()
    if seen < 2:
        return CoTrained()
    for k in range(rounds):
        found = CoTrained(
            _regression("_text_y", "text_view").fit(views.where("_text_y is not null")),
            _regression("_meta_y", "meta_view").fit(views.where("_meta_y is not null")),
        )
        if k + 1 < rounds:
            views = materialize(_exchanged(found.odds(views)))
    odds = materialize(found.odds(views.where("_held")).select("y", "_text_odds", "_meta_odds"))
    platt = [_fit_linear(odds, [c]) for c in ("_text_odds", "_meta_odds")]
    calibrated = odds.select("y", *((F.col(c) * a + b).alias(c) for c, (a, b) in zip(("_text_odds", "_meta_odds"), platt)))
    found.platt, found.weights = tuple(map(tuple, platt)), tuple(_fit_linear(calibrated, ["_text_odds", "_meta_odds"]))
    return found


def _exchanged(rows: DataFrame) -> DataFrame:
    """Each view labels for the other the pool rows it is sure about."""

    def sure(odds: str) -> Column:
        p = sigmoid(F.col(odds))
        return F.when(p >= SURE, 1.0).when(p <= 1 - SURE, 0.0)

    pool = F.col("y").isNull()
    return rows.withColumns(
        {
            "_text_y": F.coalesce("_text_y", F.when(pool, sure("_meta_odds"))),
            "_meta_y": F.coalesce("_meta_y", F.when(pool, sure("_text_odds"))),
        }
    ).drop("_text_odds", "_meta_odds")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **how) -> DataFrame:
    """One row per row of ``docs``: (id, p_text, p_meta, score, keep). keep is true at a score of
    ``threshold`` or more, and where nothing could be learned. Null and empty texts are scored as empty;
    repeated rows score alike; empty documents give an empty result."""
    found = train(docs, labels, id_col, text_col, **how).score(_needed(docs, id_col, text_col), "_text")
    return found.select(F.col("_id").alias(id_col), "p_text", "p_meta", "score", F.coalesce(F.col("score") >= threshold, F.lit(True)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **how) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with their own columns only."""
    plain = docs.select(*(F.col(c).alias(f"_c{k}") for k, c in enumerate(docs.columns)))
    at = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    have = {c.lower(): c for c in docs.columns}
    named = plain.withColumns({n: F.col(at[have[n]]) for n in ("source", "lang") if n in have})
    model = train(docs, labels, id_col, text_col, **how)
    found = model.score(named, at[text_col]).where(F.coalesce(F.col("score") >= threshold, F.lit(True)))
    return found.select(*(F.col(v).alias(c) for c, v in at.items()))
