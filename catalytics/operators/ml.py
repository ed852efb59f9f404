"""Demand classifier, its metrics and batch scoring; per-category KMeans
segments (M9-M12, J9, A17).

* The classifier is Spark ML's ``MultilayerPerceptronClassifier`` with the
  reference's hidden layers (128-64-32) and iteration limit; the last layer has
  one unit per class seen in training.  Category codes, standardization and the
  class names are stages of one pipeline, so a saved model scores a later
  catalog exactly as the one it was trained on.  Spark's MLP uses sigmoid hidden
  units and L-BFGS, so results are compared by metrics, not weights.  Its weights are
  fitted by ``operators/perceptron.py``, which follows Spark's fit on every row.
* KMeans for every category at once is in ``operators/clusters.py``; the segment
  labels are here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalytics.functions.scalars import with_row
from catalytics.functions import scores as S
from catalytics.operators.catalog import catalog_stats, with_stats
from catalytics.operators.clusters import category_clusters
from catalytics.operators import mlp as T
from catalytics.operators.perceptron import fit_weights
from catalytics.operators.sampling import FEATURES, model_frame, standardize, stratified_split

CAT = "categoryName"
HIDDEN_LAYERS = [128, 64, 32]
MAX_ITER = 300                 # fixed value: the reference's limit of training passes
UNKNOWN_CATEGORY = "Unknown"


# ---------------------------------------------------------------- M9
def _sql_name(c: str) -> str:
    return f"z_{c}"


def train_demand_model(scored: DataFrame, max_iter: int = MAX_ITER, seed: int = 42, block_size: int = 64):
    """M9: fit codes, population z-scores and MLP on the stratified train split.

    Returns (pipeline_model, frame); frame holds the raw features, the category,
    demand_level and split.  Null or empty categories count as unknown, and a
    category unseen in training gets code 0, as in the reference.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer, VectorAssembler
    from pyspark.ml.linalg import Vectors

    frame = stratified_split(scored.select("asin", CAT, "demand_level", *FEATURES[:-1]))
    train = frame.where(F.col("split") == "train")
    named = SQLTransformer(statement=f"SELECT *, coalesce(nullif(trim({CAT}), ''), '{UNKNOWN_CATEGORY}') AS _category FROM __THIS__")
    # the vocabulary is taken over the whole catalog, as the reference encodes before it splits
    category = StringIndexer(inputCol="_category", outputCol="_code", stringOrderType="alphabetAsc",
                             handleInvalid="keep").fit(named.transform(frame))
    n = len(category.labels)
    coded = SQLTransformer(statement=f"SELECT *, CASE WHEN _code >= {n} THEN 0.0D ELSE _code END AS cat_enc FROM __THIS__")
    label = StringIndexer(inputCol="demand_level", outputCol="label", stringOrderType="alphabetAsc",
                          handleInvalid="skip").fit(frame)
    prepared = coded.transform(category.transform(named.transform(train)))
    m = prepared.agg(*[F.avg(c).alias(f"m_{c}") for c in FEATURES], *[F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES]).first()
    z = ", ".join(f"({c} - {m[f'm_{c}']!r}D) / {(m[f's_{c}'] or 1.0)!r}D AS {_sql_name(c)}" for c in FEATURES)
    scaled = SQLTransformer(statement=f"SELECT *, {z} FROM __THIS__")
    layers = [len(FEATURES), *HIDDEN_LAYERS, max(2, len(label.labels))]
    names = [_sql_name(c) for c in FEATURES]

    def holding(weights=None):                            # no iteration: Spark's model of given weights, or of those it draws for the seed
        mlp = MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", maxIter=0, blockSize=block_size, seed=seed, layers=layers)
        one = scored.sparkSession.createDataFrame([(Vectors.dense([0.0] * len(FEATURES)), 0.0)], ["features", "label"])
        return (mlp if weights is None else mlp.setInitialWeights(Vectors.dense(weights))).fit(one)

    weights, losses = fit_weights(scaled.transform(label.transform(prepared)), names, "label", layers, holding().weights.toArray(), max_iter, block_size)
    back = IndexToString(inputCol="prediction", outputCol="predicted_level", labels=_class_names(label.labels))
    model = PipelineModel([named, category, coded, scaled, VectorAssembler(inputCols=names, outputCol="features"), holding(weights), back])
    model.losses = losses                                 # of this training; a loaded model has none
    return model, frame


def _class_names(labels: list[str]) -> list[str]:
    """One name per output unit (a one-class catalog still needs two units)."""
    return list(labels) if len(labels) > 1 else [*labels, "none"]


def model_classes(model) -> list[str]:
    """The class names of a fitted (or loaded) pipeline, in the order of its outputs."""
    return list(model.stages[-1].getLabels())


def training_summary(scored: DataFrame, max_iter: int = MAX_ITER) -> DataFrame:
    """M9 report: sample counts per split, layer sizes and iterations run."""
    model, frame = train_demand_model(scored, max_iter=max_iter)
    return _training_row(model, frame)


def _training_row(model, frame: DataFrame) -> DataFrame:
    mlp = model.stages[-2]
    counts = frame.agg(F.count("*").alias("total_samples"),
                       F.count_if(F.col("split") == "train").alias("train_samples"),
                       F.count_if(F.col("split") == "test").alias("test_samples"))
    return counts.select("*", F.lit("-".join(map(str, mlp.getLayers()))).alias("layers"),
                         F.lit(len(model.losses)).cast("int").alias("iterations_run"))


# ---------------------------------------------------------------- M10
def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                           class_names: DataFrame | None = None) -> DataFrame:
    """Per-class precision/recall/f1 (%) and support, plus accuracy, from
    confusion counts (one groupBy over (label, prediction))."""
    conf = pred.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    tp = conf.where(F.col("y") == F.col("p")).select(F.col("y").alias("cls"), F.col("n").alias("tp"))
    sup = conf.groupBy(F.col("y").alias("cls")).agg(F.sum("n").alias("support"))
    npred = conf.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("predicted"))
    tot = conf.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n"))).alias("correct"))
    m = with_row(sup.join(tp, "cls", "left").join(npred, "cls", "left"), tot).fillna(0, subset=["tp", "predicted"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return m.select(F.col("cls").alias("class"),
                    S.round_half(prec * 100, 1).alias("precision"), S.round_half(rec * 100, 1).alias("recall"),
                    S.round_half(f1 * 100, 1).alias("f1_score"), F.col("support").cast("bigint").alias("support"),
                    S.round_half(F.col("correct") / F.col("total") * 100, 2).alias("accuracy"))


def model_stats(scored: DataFrame, max_iter: int = MAX_ITER) -> DataFrame:
    """M10 for the trained MLP on the test split, with the sample counts, classes and iterations of the training."""
    model, frame = train_demand_model(scored, max_iter=max_iter)
    pred = model.transform(frame.where(F.col("split") == "test")).select("demand_level", "predicted_level")
    metrics = classification_metrics(pred, "demand_level", "predicted_level")
    return with_row(metrics, _training_row(model, frame)).withColumn("classes", F.lit(", ".join(model_classes(model))))


def quick_score_metrics(scored: DataFrame) -> DataFrame:
    """M10 over a given prediction table: how well the listing quick score's
    level recovers the demand level (SQL-checkable metrics job)."""
    pred = scored.select("demand_level", S.demand_level(S.quick_score()).alias("predicted_level"))
    return classification_metrics(pred, "demand_level", "predicted_level")


# ---------------------------------------------------------------- M11
def listing_features(listings_view: DataFrame, catalog: DataFrame) -> DataFrame:
    """P4 features of listings against catalog stats, each clipped to [0, 100]."""
    j = with_stats(listings_view, catalog_stats(catalog))
    return j.select("asin", CAT, *[c.alias(name) for name, c in S.clipped_features().items()])


def request_features(listings_view: DataFrame, catalog: DataFrame) -> DataFrame:
    """P4 features, category code of the catalog (0 if unseen or empty) and display score of each listing."""
    feats = listing_features(listings_view, catalog)
    codes = category_codes(catalog)
    name = F.coalesce(F.nullif(F.trim(F.col(CAT)), F.lit("")), F.lit(UNKNOWN_CATEGORY))
    j = feats.withColumn("_category", name).join(codes, "_category", "left")
    return j.select("asin", CAT, *FEATURES[:-1], F.coalesce("cat_enc", F.lit(0)).alias("cat_enc"), _display_score().alias("demand_score"))


def category_codes(catalog: DataFrame) -> DataFrame:
    """Alphabetical code of each category (one row per category)."""
    name = F.coalesce(F.nullif(F.trim(F.col(CAT)), F.lit("")), F.lit(UNKNOWN_CATEGORY))
    cats = catalog.select(name.alias("_category")).distinct()
    return cats.withColumn("cat_enc", (F.row_number().over(Window.orderBy("_category")) - 1).cast("int"))


def _display_score():
    return S.round_half(F.col("stars_norm") * 0.25 + F.col("bought_norm") * 0.25 + F.col("bs_norm") * 0.25
                        + F.col("price_norm") * 0.25, 2)


def predict_demand(model, catalog: DataFrame, listings_view: DataFrame) -> DataFrame:
    """Class, confidence (max probability %), per-class probabilities and
    the display score for a batch of listings.  Codes, scaling and classes all
    come from the model."""
    from pyspark.ml.functions import vector_to_array
    feats = listing_features(listings_view, catalog)
    classes = F.array(*[F.lit(c) for c in model_classes(model)])
    p = model.transform(feats).withColumn("prob", vector_to_array("probability"))
    return p.select(
        "asin", F.col("predicted_level").alias("demand_level"),
        S.round_half(F.array_max("prob") * 100, 1).alias("confidence"),
        F.map_from_arrays(classes, F.transform("prob", lambda x: S.round_half(x * 100, 1))).alias("probabilities"),
        _display_score().alias("demand_score"))


# ---------------------------------------------------------------- M12, J9, A17
def category_segments(scored: DataFrame, k: int = 3) -> DataFrame:
    """M12 + J9: cluster and Hot/Warm/Cold segment of every product."""
    return label_segments(category_clusters(scored, k)).select("asin", CAT, F.col("cid").alias("cluster"), "segment")


def label_segments(assigned: DataFrame) -> DataFrame:
    """Per category, clusters by descending mean score -> Hot, Warm, Cold; adds segment to all columns."""
    means = assigned.groupBy(CAT, "cid").agg(F.avg(F.col("demand_score").cast("decimal(20,4)")).alias("m"))
    w = Window.partitionBy(CAT).orderBy(F.col("m").desc(), F.col("cid"))
    names = F.array(*[F.lit(s) for s in S.SEGMENTS])
    lab = means.select(CAT, "cid", F.element_at(names, F.row_number().over(w).cast("int")).alias("segment"))
    return assigned.join(lab, [CAT, "cid"])


# ---------------------------------------------------------------- M9, M10 by mini-batch Adam
def train_adam_model(scored: DataFrame, training: T.Training = T.Training()):
    """M9 as the reference trains it: (network, class names, frame); frame holds the standardized features, the level, its label and the split."""
    frame = standardize(model_frame(scored))
    names = [r[0] for r in frame.select("demand_level").distinct().orderBy("demand_level").collect()]       # at most the three levels
    z = [f"z_{f}" for f in FEATURES]
    net = T.train_network(frame.where(F.col("split") == "train"), z, "label", "asin", max(2, len(names)), training)
    return net, _class_names(names), frame


def adam_model_stats(scored: DataFrame, training: T.Training = T.Training()) -> DataFrame:
    """M10 of the Adam network on the test split, with sample counts, layers, passes run and first and last loss."""
    net, names, frame = train_adam_model(scored, training)
    z = [f"z_{f}" for f in FEATURES]
    pred = T.predict_network(frame.where(F.col("split") == "test"), net, z)
    pred = pred.withColumn("predicted_level", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("predicted") + 1))
    counts = frame.agg(F.count("*").alias("total_samples"), F.count_if(F.col("split") == "train").alias("train_samples"),
                       F.count_if(F.col("split") == "test").alias("test_samples"))
    widths = [len(FEATURES), *training.hidden, len(names)]
    return with_row(classification_metrics(pred, "demand_level", "predicted_level"), counts).withColumns({
        "layers": F.lit("-".join(map(str, widths))), "passes_run": F.lit(net.passes_run),
        "first_loss": F.lit(float(net.losses[0]) if net.losses else None).cast("double"),
        "last_loss": F.lit(float(net.losses[-1]) if net.losses else None).cast("double")})
