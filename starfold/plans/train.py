"""Training of the hybrid factorisation on explicit ratings.

The model scores ``p_u . (q_i + W f_i) + b_u + b_i + c . f_i`` against the rating minus
the mean. It is fitted by block descent: all users given the items, all items given the
users, the content weights given the items. The first two are ridge regressions by key,
the third goes by conjugate gradients through the tiles of the feature matrix, so an epoch is some joins and
aggregations. An item is pulled towards its content part, not towards zero, which is the
same objective as a penalty on its identity part ``q_i``.

Every step's result is a written table: the plan never grows with the epochs, a lost
executor repeats one step at most, and a run continues after its last complete epoch.
"""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from starfold.functions.scalars import seeded_unit
from starfold.operators import evaluate
from starfold.operators.features import project
from starfold.operators.filters import MIN_RATINGS, first_users, min_support, warm_only
from starfold.operators.ridge import RidgeSpec, key_sizes, ridge_by_key, written_routes
from starfold.operators.stats import damped_bias, prediction_metrics
from starfold.operators.tiles import Tiles, there_and_back, tiled, transposed_times
from starfold.session import new_folder
from starfold.sources import store


@dataclass(frozen=True)
class TrainParams:
    components: int = 64
    epochs: int = 30
    reg_user: float = 5.0
    reg_item: float = 5.0
    reg_per_row: bool = False
    weight_decay: float = 1e-5
    content_steps: int = 1
    content_solver: str = "gradients"  # conjugate gradients, or one damped "step"
    content_rounds: int = 3
    content_tolerance: float = 0.05
    eval_every: int = 5
    min_ratings: int = MIN_RATINGS
    dry_run: bool = False
    seed: int = 0


# The first-generation model: no content, ten factors, the penalty applied per rating.
PLAIN = TrainParams(components=10, epochs=10, reg_user=0.1, reg_item=0.1, reg_per_row=True)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _initial_items(ratings: DataFrame, mean: float, params: TrainParams) -> DataFrame:
    """Small vectors from a seeded hash of the item id, and damped mean biases."""
    width = 1.0 / params.components ** 0.5
    vec = F.transform(F.sequence(F.lit(0), F.lit(params.components - 1)),
                      lambda d: (seeded_unit(params.seed, F.col("movieId"), d) - 0.5) * width)
    biases = damped_bias(ratings, F.lit(mean))
    return biases.select("movieId", vec.alias("vec"), "bias")


def _replaced(start: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Starting values, with those of an earlier epoch where there are any."""
    old = known.select(key, F.col("vec").alias("_v"), F.col("bias").alias("_b"))
    return start.join(old, key, "left").select(
        key, F.coalesce(F.col("_v").cast("array<double>"), F.col("vec").cast("array<double>")).alias("vec"),
        F.coalesce("_b", "bias").alias("bias"))


def _total(items: DataFrame, content: DataFrame | None) -> DataFrame:
    """Identity plus content part of every item."""
    if content is None:
        return items.select("movieId", "vec", "bias")
    c = content.select("movieId", F.col("vec").alias("_c"), F.col("bias").alias("_cb"))
    summed = F.zip_with("vec", "_c", lambda a, b: a.cast("double") + b)
    return items.join(c, "movieId", "left").select(
        "movieId", F.when(F.col("_c").isNull(), F.col("vec").cast("array<double>")).otherwise(
            summed).alias("vec"),
        (F.col("bias") + F.coalesce("_cb", F.lit(0.0))).alias("bias"))


def _identity(total: DataFrame, content: DataFrame | None) -> DataFrame:
    """What remains of every item after its content part."""
    if content is None:
        return total
    negative = content.select(
        "movieId", F.transform("vec", lambda x: -x).alias("vec"), (-F.col("bias")).alias("bias"))
    rest = _total(total, negative)
    return rest.join(total.select("movieId", "n", "sse"), "movieId")


def _pulls(tiles: Tiles, rest: DataFrame, strength, size: int) -> DataFrame:
    """``feature_id, pull``: the transposed feature matrix times the items' weighted vectors and biases."""
    rows = rest.select("movieId", F.transform(F.concat(F.col("vec").cast("array<double>"), F.array(F.col("bias").cast("double"))),
                                              lambda x: x * strength).alias("vec"))
    return transposed_times(tiles, rows, size + 1).select("feature_id", F.col("vec").alias("pull"))


def _content_step(weights: DataFrame, identity: DataFrame, tiles: Tiles, strength,
                  params: TrainParams) -> DataFrame:
    """Move the content weights towards what the identity parts still carry.

    The step per feature is divided by a bound on the curvature that accounts for all
    features of its items, so the penalised objective cannot rise.
    """
    features = tiles.rows
    breadth = features.groupBy("movieId").agg(F.sum(F.abs("value")).alias("_l1"))
    scalars = identity.select("movieId", strength.alias("_s")).join(breadth, "movieId")
    curves = features.join(scalars, "movieId").groupBy("feature_id").agg(
        F.sum(F.col("_s") * F.abs("value") * F.col("_l1")).alias("_curve"))
    pulls = _pulls(tiles, identity, strength, params.components)
    decay = F.lit(params.weight_decay)
    joined = weights.join(pulls, "feature_id").join(curves, "feature_id")
    step = lambda w, pull: w + (pull - decay * w) / (F.col("_curve") + decay)
    vector = F.slice("pull", 1, params.components)
    return joined.select(
        "feature_id", F.zip_with(F.col("vec").cast("array<double>"), vector, lambda w, p: step(w, p)).alias("vec"),
        step(F.col("bias"), F.element_at("pull", -1)).alias("bias"))


def conjugate_weights(weights: DataFrame, identity: DataFrame, tiles: Tiles, strength, params: TrainParams, work: str) -> DataFrame:
    """Content weights that the items' totals ask for, by preconditioned conjugate gradients from the present ones.

    Solves ``(F'SF + decay) W = F'S total`` for every dimension and the bias at once: each has its own step
    lengths, and the products go through the tiles. A feature is one row, and a round is one written table. Stops when every residual is below ``content_tolerance`` of its first, or after ``content_rounds``.
    """
    size, decay = params.components + 1, params.weight_decay
    items = identity.select("movieId", strength.alias("_s"))
    one_each = items.select("movieId", F.array(F.col("_s").cast("double")).alias("vec"))
    squares = tiles._replace(rows=tiles.rows.withColumn("value", F.col("value") * F.col("value")))
    diagonal = transposed_times(squares, one_each, 1).select("feature_id", (F.col("vec")[0] + F.lit(decay)).alias("diag"))
    w = F.concat(F.col("vec").cast("array<double>"), F.array(F.col("bias").cast("double")))
    residual = F.zip_with("pull", "w", lambda p, x: p - F.lit(decay) * x)
    start = (weights.select("feature_id", w.alias("w")).join(_pulls(tiles, identity, strength, params.components), "feature_id").join(diagonal, "feature_id")
             .select("feature_id", "w", "diag", residual.alias("r")))

    def product(left: str, right: str, name: str, by: Column = F.lit(1.0)) -> list[Column]:
        """Inner products, one for each column of the vectors."""
        return [F.sum(F.col(left)[d] * F.col(right)[d] / by).alias(f"{name}{d}") for d in range(size)]

    def observed(df: DataFrame, path: str, *sums: list[Column]) -> tuple[DataFrame, list[list[float]]]:
        """A written table, and sums that are taken while it is written."""
        seen = Observation()
        table = _written(df.observe(seen, *[column for columns in sums for column in columns]), path)
        values = [x or 0.0 for x in seen.get.values()]
        return table, [values[i: i + size] for i in range(0, len(values), size)]

    def along(vector: str, by: list[float], other: str) -> Column:
        scaled = F.zip_with(F.col(other), F.array(*map(F.lit, by)), lambda x, a: x * a)
        return F.zip_with(F.col(vector), scaled, lambda x, y: x + y)

    def ratio(above: list[float], below: list[float]) -> list[float]:
        return [x / y if y > 0 else 0.0 for x, y in zip(above, below)]

    state, (now,) = observed(start.withColumn("p", F.transform("r", lambda x: x / F.col("diag"))), f"{work}-0", product("r", "r", "rr", F.col("diag")))
    first = now
    for turn in range(1, params.content_rounds + 1):
        if all(x <= params.content_tolerance ** 2 * y for x, y in zip(now, first)):
            break
        image = there_and_back(tiles, state.select("feature_id", F.col("p").alias("vec")), one_each, size).select("feature_id", F.col("vec").alias("_a"))
        mapped = state.join(image, "feature_id").withColumn("a", F.zip_with("_a", "p", lambda a, x: a + F.lit(decay) * x)).drop("_a")
        # with these three the next residual's length is known before the residual is
        mapped, (pa, ra, aa) = observed(mapped, f"{work}-{turn % 2 + 1}", product("p", "a", "pa"), product("r", "a", "ra", F.col("diag")),
                                        product("a", "a", "aa", F.col("diag")))
        length = ratio(now, pa)
        last, now = now, [max(rr - 2 * t * x + t * t * y, 0.0) for rr, t, x, y in zip(now, length, ra, aa)]
        moved = mapped.select("feature_id", "diag", along("w", length, "p").alias("w"), along("r", [-x for x in length], "a").alias("r"), "p")
        back = F.array(*map(F.lit, ratio(now, last)))
        ahead = F.zip_with(F.transform("r", lambda x: x / F.col("diag")), F.zip_with("p", back, lambda x, b: x * b), lambda z, x: z + x)
        state = moved.withColumn("p", ahead)
    return state.select("feature_id", F.slice("w", 1, params.components).alias("vec"), F.element_at("w", -1).alias("bias"))


def _fingerprint(df: DataFrame | None, columns: list[str]) -> str:
    """Row count and sum of row hashes; the same for the same rows in any order."""
    if df is None:
        return "none"
    hashed = F.xxhash64(*[F.col(c).cast("double") for c in columns]).cast("decimal(38,0)")
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(hashed), F.lit(0))).first()
    return f"{n}-{total}"


# Parameters that decide what is learned. How many epochs to run and when to report are free.
FIXED = ("components", "dry_run")
LEARNED = ("reg_user", "reg_item", "reg_per_row", "weight_decay", "content_steps", "content_solver", "content_rounds", "content_tolerance", "min_ratings", "seed")


def _checked(last, params: TrainParams, inputs: dict[str, str], epochs: int, tag: str) -> None:
    """An error where an earlier run of the variant cannot be continued."""
    own = asdict(params)
    other = [f"{name}={last[name]}" for name in FIXED if last[name] != own[name]]
    if other:
        raise ValueError(f"tag {tag!r} was trained with {' '.join(other)}; match them or pass fresh=True")
    if last["features"] != "none" and inputs["features"] == "none":
        raise ValueError(f"tag {tag!r} was trained with features; pass them or fresh=True")
    same = all(last[k] == v for k, v in inputs.items()) and last["learned"] == str([own[k] for k in LEARNED])
    if last["epoch"] >= epochs and not same:
        raise ValueError(f"tag {tag!r} has finished {last['epoch']} epochs on other ratings, features or parameters; "
                         "raise epochs to go on with the new ones, or pass fresh=True")


def train(spark: SparkSession, ratings: DataFrame, path: str, features: DataFrame | None = None,
          params: TrainParams = TrainParams(), tag: str | None = None,
          fresh: bool = False) -> store.Model:
    """Train a variant below ``path`` and return it; continues an interrupted run.

    A continued run takes the given ratings, features and parameters, and the mean of these
    ratings: what is known from the last complete epoch is its start. New items and features
    start as in a fresh run, items without ratings drop out. Other components, another dry-run
    setting, missing features, or new inputs with no epoch left to learn them are errors unless
    ``fresh``. Item factors, content weights and user factors are written per epoch.
    """
    tag = tag or store.DEFAULT_TAG
    epochs = 5 if params.dry_run else params.epochs
    eval_every = 1 if params.dry_run else params.eval_every
    last = None if fresh else store.last_config(spark, path, tag)
    if fresh:
        store.forget(spark, path, tag)
    work = f"{path}/work/tag={tag}"
    kept = _written(min_support(
        ratings.select("userId", "movieId", "rating"), params.min_ratings),
        f"{work}/kept" if params.dry_run else f"{work}/ratings")
    mean = kept.agg({"rating": "avg"}).first()[0]
    if mean is None:
        raise ValueError("no item has enough ratings to train on")
    # The mean is that of all users, also when a dry run keeps the first ones only.
    rows = _written(first_users(kept), f"{work}/ratings") if params.dry_run else kept
    inputs = {"ratings": _fingerprint(rows, ["userId", "movieId", "rating"])}
    if features is not None:
        tiles = tiled(features.join(rows.select("movieId").distinct(), "movieId", "left_semi"), written=True)
        features = tiles.rows
    inputs["features"] = _fingerprint(features, ["movieId", "feature_id", "value"])
    if last is not None:
        _checked(last, params, inputs, epochs, tag)
    start = 1 if last is None else last["epoch"] + 1
    user_sizes, item_sizes = key_sizes(rows, "userId"), key_sizes(rows, "movieId")
    user_routes, item_routes = written_routes(rows, "userId", "movieId", user_sizes), written_routes(rows, "movieId", "userId", item_sizes)
    targets = rows.select("userId", "movieId", (F.col("rating") - mean).alias("y"))
    as_floats = F.col("vec").cast("array<float>").alias("vec")
    user_spec = RidgeSpec((params.reg_user,), "penalised", params.reg_per_row, 1)
    item_spec = RidgeSpec((params.reg_item,), "penalised", params.reg_per_row, 1)
    items, weights = _initial_items(rows, mean, params), None
    if features is not None:
        weights = features.select("feature_id").distinct().select(
            "feature_id", F.array_repeat(F.lit(0.0).cast("float"), params.components).alias("vec"),
            F.lit(0.0).alias("bias"))
    if start > 1:
        items = _replaced(items, store.read_epoch(spark, path, "items", tag, start - 1), "movieId")
        if features is not None and last["features"] != "none":
            weights = _replaced(weights, store.read_epoch(spark, path, "weights", tag, start - 1), "feature_id")
    items = _written(items, f"{work}/start")
    if features is not None:
        weights = _written(weights, f"{work}/start-weights")
    n_rows = rows.count()
    content = None if features is None else _written(
        project(tiles, weights, params.components), f"{work}/start-content")
    for epoch in range(start, epochs + 1):
        total = _total(items, content)
        users = _written(ridge_by_key(targets, total.select("movieId", as_floats, "bias"), "userId", "movieId", user_spec,
                                      sizes=user_sizes, routes=user_routes), store.epoch_path(path, "users", tag, epoch))
        solved = ridge_by_key(targets, users.select("userId", as_floats, "bias"), "movieId", "userId", item_spec, content,
                              item_sizes, routes=item_routes)
        item_path = store.epoch_path(path, "items", tag, epoch)
        strength = F.lit(params.reg_item) * (
            F.col("n").cast("double") if params.reg_per_row else F.lit(1.0))
        if features is None:
            items = _written(solved, item_path)
        else:
            total = _written(solved, f"{work}/total-{epoch % 2}")
            for step in range(params.content_steps):
                rest = _identity(total, content)
                moved = (_content_step(weights, rest, tiles, strength, params) if params.content_solver == "step"
                         else conjugate_weights(weights, rest, tiles, strength, params, f"{work}/gradients"))
                last_step = step == params.content_steps - 1
                weights = _written(
                    moved.withColumn("vec", F.col("vec").cast("array<float>")),
                    store.epoch_path(path, "weights", tag, epoch) if last_step
                    else f"{work}/weights-{epoch % 2}-{step}")
                content = _written(project(tiles, weights, params.components),
                                   f"{work}/content-{epoch % 2}-{step}")
            items = _written(_identity(total, content).withColumn(
                "vec", F.col("vec").cast("array<float>")), item_path)
        config = spark.createDataFrame(
            [(params.components, params.dry_run, float(mean), features is not None, inputs["ratings"], inputs["features"],
              str([asdict(params)[name] for name in LEARNED]))],
            "components int, dry_run boolean, global_mean double, has_content boolean, ratings string, features string, "
            "learned string")
        store.complete_epoch(path, tag, epoch, config)
        _log_progress(spark, path, tag, epoch, epochs, eval_every, n_rows, users, items, weights,
                      strength, params)
    return store.load_model(spark, path, tag)


def _log_progress(spark, path, tag, epoch, epochs, eval_every, n_rows, users, items, weights,
                  strength, params) -> None:
    """Progress row; the loss falls out of the item regressions without another pass."""
    size = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x) + F.col("bias") * F.col("bias")
    squares, penalty = items.agg(F.sum("sse"), F.sum(strength * size)).first()
    mse = squares / max(n_rows, 1)
    penalty += users.agg(F.sum("spread")).first()[0]
    if weights is not None:
        penalty += params.weight_decay * (weights.agg(F.sum(size)).first()[0] or 0.0)
    evaluated = epoch % eval_every == 0 or epoch == epochs
    store.append_progress(spark, path, tag, {
        "epoch": epoch, "of": epochs, "mse_loss": mse, "rmse": mse ** 0.5 if evaluated else None,
        "objective": mse * n_rows + penalty,
        "updated_at": time.strftime("%Y-%m-%d %H:%M:%S"), "done": epoch == epochs})


def training_fit(predictions: DataFrame, n: int | None = None, seed: int = 42) -> DataFrame:
    """RMSE of the training predictions, or of a seeded sample of ``n`` of them (a fit signal only)."""
    from starfold.operators.filters import sample_ratings

    return prediction_metrics(predictions if n is None else sample_ratings(predictions, n, seed), [])


# ------------------------------------------------------------------ evaluations


def model_predictions(rows: DataFrame, users: DataFrame, total: DataFrame, mean: float,
                      size: int) -> DataFrame:
    """Predictions of trained users on ``rows``; rows of unknown users or items drop out."""
    from starfold.operators.scoring import predict_pairs

    return predict_pairs(rows, users, total, F.lit(mean), size).withColumn(
        "predicted", F.col("raw"))


def holdout_eval(spark: SparkSession, ratings: DataFrame, features: DataFrame, path: str,
                 params: TrainParams = TrainParams(epochs=12), n_users: int | None = None,
                 test_fraction: float = 0.1, seed: int = 0) -> DataFrame:
    """Held-out RMSE and MAE of one model with either part left out; of all users, or of a sample of ``n_users``."""
    split = _written(evaluate.holdout_split(ratings, test_fraction, seed, n_users,
                                            params.min_ratings), f"{path}/split")
    train_rows = split.where("part = 'train'")
    began = time.time()
    # The split has dropped rare items already; every remaining item is trained.
    unfiltered = TrainParams(**{**params.__dict__, "min_ratings": 1})
    model = train(spark, train_rows, path, features, unfiltered, fresh=True)
    elapsed = (time.time() - began) / 60
    epoch = store.last_config(spark, path)["epoch"]
    users = store.read_epoch(spark, path, "users", store.DEFAULT_TAG, epoch)
    content = project(features, model.weights, params.components)
    predictions = evaluate.ablation_predictions(
        split.where("part = 'test'").drop("part"), users, model.items, content,
        model.global_mean, params.components)
    counts = train_rows.agg(
        F.countDistinct("userId").alias("n_users"), F.countDistinct("movieId").alias("n_items"),
        F.count(F.lit(1)).alias("train_interactions")).first()
    return evaluate.holdout_metrics(predictions).select(
        "*", F.lit(counts["n_users"]).alias("n_users"), F.lit(counts["n_items"]).alias("n_items"),
        F.lit(epoch).alias("epochs"), F.lit(params.components).alias("k"),
        F.lit(counts["train_interactions"]).alias("train_interactions"),
        F.lit(round(elapsed, 2)).alias("elapsed_min"))


def cross_validate(spark: SparkSession, ratings: DataFrame, path: str, folds: int = 3,
                   params: TrainParams = PLAIN, sample: int | None = None,
                   seed: int = 42) -> DataFrame:
    """Train and test error per fold and epoch of the plain model (a learning curve)."""
    from starfold.operators.filters import sample_ratings

    rows = ratings if sample is None else sample_ratings(ratings, sample, seed)
    marked = _written(evaluate.fold_ids(rows, folds, seed), f"{path}/folds")
    plain = TrainParams(**{**params.__dict__, "min_ratings": 1})
    for fold in range(folds):
        tag = f"fold{fold}"
        model = train(spark, marked.where(F.col("fold") != fold), path, None, plain, tag, True)
        part = F.when(F.col("fold") == fold, "test").otherwise("train")
        for epoch in range(1, plain.epochs + 1):
            users = store.read_epoch(spark, path, "users", tag, epoch)
            items = store.read_epoch(spark, path, "items", tag, epoch)
            predicted = model_predictions(marked, users, items, model.global_mean,
                                          plain.components)
            prediction_metrics(predicted.withColumn("part", part), ["part"]).select(
                F.lit(fold).alias("fold"), F.lit(epoch).alias("n_epochs"), "part", "rmse", "mae").write.mode(
                "overwrite").parquet(f"{path}/curve/{tag}-{epoch}")
    return spark.read.parquet(f"{path}/curve/*")


def regularisation_grid(spark: SparkSession, ratings: DataFrame, path: str, regs: list[float],
                        folds: int = 2, params: TrainParams = PLAIN,
                        sample: int | None = None) -> DataFrame:
    """Learning curves of the plain model for several penalties."""
    for reg in regs:
        each = TrainParams(**{**params.__dict__, "reg_user": reg, "reg_item": reg})
        curve = cross_validate(spark, ratings, f"{path}/reg={reg}", folds, each, sample)
        curve.withColumn("reg", F.lit(float(reg))).write.mode("overwrite").parquet(f"{path}/grid/{reg}")
    return spark.read.parquet(f"{path}/grid/*")


def cascade(spark: SparkSession, path: str, tags: dict[int, str], ratings: DataFrame, alphas: list[float],
            n_values: list[int], n_draws: int = 8, seed: int = 0) -> DataFrame:
    """Leave-one-out error by number of factors, penalty and profile size, over stored variants.

    tags: number of factors -> tag; variants that are not trained are left out.
    """
    found = set(store.available_tags(spark, path, list(tags.values())))
    models = {k: store.load_model(spark, path, tag) for k, tag in tags.items() if tag in found}
    if not models:
        raise ValueError(f"none of {sorted(tags.values())} is trained in {path}")
    pool = warm_only(ratings, next(iter(models.values())).items)
    samples = _written(evaluate.draws(pool, n_values, n_draws, seed), new_folder(spark, "draws"))
    mean = next(iter(models.values())).global_mean
    errors = evaluate.cascade_errors(pool, {k: m.items for k, m in models.items()}, mean, samples, alphas, n_values, n_draws)
    return evaluate.cascade_results(errors)


def joint_user(spark: SparkSession, ratings: DataFrame, personal: DataFrame, path: str,
               params: TrainParams = PLAIN, user_id: int = 0) -> DataFrame:
    """Vector and bias of a person whose ratings take part in the training."""
    from starfold.operators.filters import inject_user, supported_items

    valid = supported_items(ratings, params.min_ratings)
    train(spark, inject_user(ratings, personal, valid, user_id), path, None, params, "joint", True)
    epoch = store.last_config(spark, path, "joint")["epoch"]
    users = store.read_epoch(spark, path, "users", "joint", epoch)
    return users.where(F.col("userId") == user_id).select("userId", "vec", "bias", "n")
