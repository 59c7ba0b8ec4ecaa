"""Evaluation and tuning (EVA1-EVA12, SPL9, SPL10, MOD9).

Every fit is a distributed MLlib job; the driver only loops over folds and
candidates (like ``CrossValidator``) and may run independent fits in a
small thread pool.  Scores come back as a few numbers per fit.
"""

from __future__ import annotations

import itertools
import math
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import ranking as RK
from ..operators import splits as S


class CumRecallEvaluator(Evaluator):
    """EVA12: the cumulative-recall metric as an MLlib ``Evaluator``."""

    labelCol = Param(Params._dummy(), "labelCol", "", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "", TypeConverters.toString)

    def __init__(self, labelCol="relevancia", predictionCol="prediction", idCol="doc_id"):
        super().__init__()
        self._set(labelCol=labelCol, predictionCol=predictionCol, idCol=idCol)

    def _evaluate(self, df: DataFrame) -> float:
        g = self.getOrDefault
        r = RK.cum_recall_metric(df, g("labelCol"), g("predictionCol"), g("idCol")).first()
        return float("nan") if r is None or r["cum_recall"] is None else float(r["cum_recall"])

    def isLargerBetter(self) -> bool:
        return True


def rmse(df: DataFrame, label: str = "relevancia", pred: str = "prediction") -> float:
    """AGG4 as a number."""
    return float(df.agg(F.sqrt(F.avg(F.pow(F.col(label) - F.col(pred), 2)))).first()[0])


def mean_std(scores: list[float]) -> tuple[float, float]:
    """AGG3 on a few numbers: mean and population std."""
    m = sum(scores) / len(scores)
    return m, math.sqrt(sum((s - m) ** 2 for s in scores) / len(scores))


def _score(df, metric):
    return rmse(df) if metric == "rmse" else CumRecallEvaluator().evaluate(df)


def grouped_scores(parts: list[DataFrame], metric: str, label: str = "relevancia", id_col: str = "doc_id") -> list[float]:
    """The metric of each scored part, from one table of all of them (one ranking for all, not one each)."""
    rows = None
    for i, p in enumerate(parts):
        part = p.select(F.lit(i).alias("_part"), id_col, label, "prediction")
        rows = part if rows is None else rows.unionByName(part)
    if metric == "rmse":
        got = rows.groupBy("_part").agg(F.sqrt(F.avg(F.pow(F.col(label) - F.col("prediction"), 2))).alias("v"))
    else:
        got = RK.cum_recall_metric(rows, label, "prediction", id_col, group=["_part"]).withColumnRenamed("cum_recall", "v")
    by = {r["_part"]: r["v"] for r in got.collect()}
    return [float("nan") if by.get(i) is None else float(by[i]) for i in range(len(parts))]


def cv_scores(pipeline: Pipeline, df: DataFrame, k: int = 5, seed: int | None = None,
              metric: str = "rmse", on_train: bool = False, permute_seed: int | None = None,
              id_col: str = "doc_id", parallelism: int = 5) -> list[float]:
    """EVA1 (held-out folds), EVA2 (``on_train``: the training folds), EVA3
    (``permute_seed``: labels permuted first, the noise floor)."""
    from .models import light, split_stateless
    if _text_ridge(pipeline):
        kind = "permuted" if permute_seed is not None else "held_out"
        return text_cv_scores(pipeline, df, k, seed, metric, permute_seed, id_col)[kind][int(on_train)]
    data = permute_labels(df, permute_seed, id_col) if permute_seed is not None else df
    pre, rest = split_stateless(pipeline)
    # text preprocessing once for all folds (it needs no fit)
    data = light(Pipeline(stages=pre).fit(data).transform(data))
    folds = S.with_kfold(data, k, id_col, seed).persist()
    rest_pipe = Pipeline(stages=rest)

    def one(i):
        tr = folds.filter(F.col("fold") != i)
        te = tr if on_train else folds.filter(F.col("fold") == i)
        model = rest_pipe.fit(tr)
        return _score(model.transform(te), metric)

    try:
        with ThreadPoolExecutor(parallelism) as ex:
            return list(ex.map(one, range(k)))
    finally:
        folds.unpersist()


def _text_ridge(pipeline: Pipeline):
    """The pipeline's ridge on texts, if that is all there is to fit: its fits then share passes (:mod:`dual_ridge`)."""
    from .models import split_stateless
    from .stages import TextRidge
    rest = split_stateless(pipeline)[1]
    return rest[0] if len(rest) == 1 and isinstance(rest[0], TextRidge) else None


def _text_rows(pipeline: Pipeline, df: DataFrame, keep=(), numbers=()):
    from . import dual_ridge as DR
    from .models import split_stateless
    ridge = _text_ridge(pipeline)
    g = ridge.getOrDefault
    terms = Pipeline(stages=split_stateless(pipeline)[0]).fit(df).transform(df)
    return ridge, DR.counted(terms, [g("termsCol")], g("labelCol"), g("extraCol"), keep, numbers)


def _text_scores(ridge, data, parts, keep, labels=None) -> DataFrame:
    """Scores of one fit for each vector of parts (1: fitted on, 2: scored only)."""
    from . import dual_ridge as DR
    labels = labels or [data.y] * len(parts)
    jobs = [DR.Job(ridge.weighting(), p.astype("int8"), y) for p, y in zip(parts, labels, strict=True)]
    return DR.scores(DR.solve(data, jobs, [ridge.getOrDefault("alpha")], tol=ridge.getOrDefault("tol")), keep)


def _part_metrics(scored: DataFrame, metric: str, n: int, id_col: str) -> list[tuple[float, float]]:
    """The metric of each candidate on its parts 2 and 1."""
    if metric == "rmse":
        got = scored.groupBy("candidate", "part").agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("score"), 2))).alias("v"))
    else:
        got = RK.cum_recall_metric(scored, "y", "score", id_col, group=["candidate", "part"]).withColumnRenamed("cum_recall", "v")
    by = {(r["candidate"], r["part"]): r["v"] for r in got.collect()}
    return [tuple(float("nan") if by.get((i, p)) is None else float(by[i, p]) for p in (2, 1)) for i in range(n)]


def text_cv_scores(pipeline: Pipeline, df: DataFrame, k: int = 5, seed: int | None = None, metric: str = "rmse",
                   permute_seed: int | None = None, id_col: str = "doc_id") -> dict[str, tuple[list[float], list[float]]]:
    """EVA1-EVA3 of a ridge on texts: scores on the held-out and on the training folds, with the labels and (if seeded) with
    permuted ones; all fits in the same passes."""
    import numpy as np
    from . import dual_ridge as DR
    ridge, data = _text_rows(pipeline, df, [id_col])
    label = ridge.getOrDefault("labelCol")
    try:
        ids = data.rows.select(id_col, F.col("y").alias(label))
        fold, = DR.by_row(data, S.with_kfold(ids.select(id_col), k, id_col, seed), id_col, ["fold"])
        kinds = {"held_out": data.y}
        if permute_seed is not None:
            kinds["permuted"], = DR.by_row(data, permute_labels(ids, permute_seed, id_col, label), id_col, [label])
        parts = [np.where(fold == i, 2, 1) for i in range(k)]
        scored = _text_scores(ridge, data, parts * len(kinds), [id_col], [y for y in kinds.values() for _ in range(k)])
        got = _part_metrics(scored, metric, k * len(kinds), id_col)
    finally:
        data.close()
    return {kind: tuple(map(list, zip(*got[j * k:(j + 1) * k]))) for j, kind in enumerate(kinds)}


def permute_labels(df: DataFrame, seed: int, id_col: str = "doc_id",
                   label: str = "relevancia") -> DataFrame:
    """EVA3: labels moved by a seeded permutation (a bijection on rows):
    the i-th row in id order gets the label of the i-th row in shuffle order."""
    from ..operators.ordering import with_position
    ids = with_position(df.select(id_col), [id_col], name="_p")
    shuf = with_position(df.select(id_col, label).withColumn("_k", S.shuffle_key(id_col, seed)),
                         ["_k", id_col], name="_p").select("_p", F.col(label).alias("_y"))
    perm = ids.join(shuf, "_p").select(id_col, "_y")
    return df.join(perm, id_col).drop(label).withColumnRenamed("_y", label)


def cross_val_decisions(pipeline: Pipeline, df: DataFrame, k: int = 3, raw_col: str = "rawPrediction", id_col: str = "doc_id",
                        label: str = "relevancia", seed: int = K.SHUFFLE_SEED) -> DataFrame:
    """WIN9 / WIN10: the decision value of each row by a binary classifier fitted on the other folds; every id once.

    The decision value is the class-1 entry of the raw prediction (0 is the default threshold).
    Output ``id, fold, label, decision``.
    """
    from pyspark.ml.functions import vector_to_array
    out = cross_val_predict(pipeline, df, k, seed, id_col, label, [raw_col])
    return out.select(id_col, "fold", label, F.element_at(vector_to_array(raw_col), 2).alias("decision"))


def cross_val_predict(pipeline: Pipeline, df: DataFrame, k: int = 5, seed: int = K.SHUFFLE_SEED,
                      id_col: str = "doc_id", label: str = "relevancia", outputs=("prediction",)) -> DataFrame:
    """EVA4: out-of-fold predictions after a seeded shuffle; every id once."""
    from ..session import materialize
    from .models import light, split_stateless
    pre, rest = split_stateless(pipeline)
    data = light(Pipeline(stages=pre).fit(df).transform(df))
    folds = S.with_kfold(data, k, id_col, seed).persist()
    pipeline = Pipeline(stages=rest)

    def one(i):
        m = pipeline.fit(folds.filter(F.col("fold") != i))
        return m.transform(folds.filter(F.col("fold") == i)).select(id_col, "fold", label, *outputs)

    try:
        with ThreadPoolExecutor(k) as ex:
            parts = list(ex.map(one, range(k)))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return materialize(out)
    finally:
        folds.unpersist()


def learning_curve(pipeline: Pipeline, train: DataFrame, val: DataFrame, steps: int = 10,
                   seed: int = 42, metric: str = "cum_recall", id_col: str = "doc_id", parallelism: int = 4) -> DataFrame:
    """EVA5: fit on nested shuffled prefixes, score on the prefix and on the
    fixed validation set.  Result ``(size, train_score, val_score)``.

    The fits run side by side; all scores come from one table.
    """
    spark = train.sparkSession
    if _text_ridge(pipeline):
        return _text_learning_curve(pipeline, train, val, steps, seed, metric, id_col)
    n = train.count()
    sizes = S.learning_curve_sizes(n, steps)
    from .models import light, split_stateless
    pre, rest = split_stateless(pipeline)
    pm = Pipeline(stages=pre).fit(train)
    pos = S.shuffled_positions(light(pm.transform(train)), id_col, seed, name="_lc").persist()
    pval = light(pm.transform(val)).persist()
    pipeline = Pipeline(stages=rest)

    def one(size):
        part = pos.filter(F.col("_lc") <= size)
        m = pipeline.fit(part)
        return [m.transform(part), m.transform(pval)]

    try:
        with ThreadPoolExecutor(parallelism) as ex:
            scored = list(ex.map(one, sizes))
        got = grouped_scores([p for pair in scored for p in pair], metric, id_col=id_col)
    finally:
        pos.unpersist()
        pval.unpersist()
    rows = [(size, got[2 * i], got[2 * i + 1]) for i, size in enumerate(sizes)]
    return spark.createDataFrame(rows, "size long, train_score double, val_score double")


def _text_learning_curve(pipeline: Pipeline, train: DataFrame, val: DataFrame, steps: int, seed: int, metric: str, id_col: str) -> DataFrame:
    import numpy as np
    from . import dual_ridge as DR
    rows = train.withColumn("_val", F.lit(0)).unionByName(val.withColumn("_val", F.lit(1)))
    ridge, data = _text_rows(pipeline, rows, [id_col, "_val"], ["_val"])
    try:
        ids = data.rows.select(id_col, "_val")
        order = S.shuffled_positions(ids.filter("_val = 0").select(id_col), id_col, seed, name="_lc")
        place, = DR.by_row(data, ids.join(order, id_col, "left").na.fill(0, ["_lc"]), id_col, ["_lc"])
        is_val = data.kept["_val"] == 1
        sizes = S.learning_curve_sizes(int((~is_val).sum()), steps)
        parts = [np.where(is_val, 2, np.where(place <= size, 1, 0)) for size in sizes]
        got = _part_metrics(_text_scores(ridge, data, parts, [id_col]), metric, len(sizes), id_col)
    finally:
        data.close()
    return train.sparkSession.createDataFrame([(size, tr, te) for size, (te, tr) in zip(sizes, got, strict=True)],
                                              "size long, train_score double, val_score double")


def _text_cv_curve(pipeline: Pipeline, df: DataFrame, fractions, k: int, metric: str, id_col: str, label: str) -> DataFrame:
    import numpy as np
    from . import dual_ridge as DR
    spark = df.sparkSession
    ridge, data = _text_rows(pipeline, df, [id_col])
    try:
        ids = data.rows.select(id_col)
        fold, = DR.by_row(data, S.with_kfold(ids, k, id_col, K.SHUFFLE_SEED), id_col, ["fold"])
        place, = DR.by_row(data, S.shuffled_positions(ids, id_col, 7, name="_q"), id_col, ["_q"])
        parts, draws = [], []
        for i in range(k):
            rest = np.flatnonzero(fold != i)
            rest = rest[np.argsort(place[rest])]
            for j, frac in enumerate(fractions):
                part = np.where(fold == i, 2, 0)
                part[rest[:max(1, int(frac * len(rest)))]] = 1
                classes, counts = np.unique(data.y[part == 1], return_counts=True)
                draws.append((len(parts), 1000 * i + j, [float(c) for c in classes], [float(c) for c in np.cumsum(counts / counts.sum())[:-1]]))
                parts.append(part)
        scored = _text_scores(ridge, data, parts, [id_col])
        got = _part_metrics(scored, metric, len(parts), id_col)
        # MOD8 for each fit: its own seed and the class frequencies of its part
        table = spark.createDataFrame(draws, "candidate int, seed int, classes array<double>, below array<double>")
        u = F.pmod(F.xxhash64(F.col("seed"), F.col(id_col)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        band = scored.filter("part = 2").join(F.broadcast(table), "candidate").withColumn("u", u).withColumn(
            "score", F.element_at("classes", F.size(F.filter("below", lambda b: b <= F.col("u"))) + 1))
        random_scores = _part_metrics(band, metric, len(parts), id_col)
    finally:
        data.close()
    curves = [(held, seen, drawn) for (held, seen), (drawn, _) in zip(got, random_scores, strict=True)]
    n = len(fractions)
    rows = [(float(frac), *[x for kind in range(3) for x in mean_std([curves[i * n + j][kind] for i in range(k)])])
            for j, frac in enumerate(fractions)]
    return spark.createDataFrame(rows, CURVE)


CURVE = ("fraction double, mean_score double, std_score double, mean_train_score double, "
         "std_train_score double, mean_random double, std_random double")


def cv_learning_curve(pipeline: Pipeline, df: DataFrame, fractions=tuple(i / 10 for i in range(1, 11)),
                      k: int = 5, metric: str = "rmse", id_col: str = "doc_id", label: str = "relevancia") -> DataFrame:
    """EVA6: per training fraction, mean/std of the k-fold score on the
    held-out fold, on the part trained on, and of random predictions on the held-out fold (the band).

    The random predictions follow the class frequencies of the part (MOD8); each is
    drawn by fold, fraction and id.
    """
    from .models import light, random_predictor, split_stateless
    if _text_ridge(pipeline):
        return _text_cv_curve(pipeline, df, fractions, k, metric, id_col, label)
    spark = df.sparkSession
    pre, rest = split_stateless(pipeline)
    data = light(Pipeline(stages=pre).fit(df).transform(df))
    pipeline = Pipeline(stages=rest)
    folds = S.with_kfold(data, k, id_col, K.SHUFFLE_SEED).persist()
    try:
        def fold_curve(i):
            tr = S.shuffled_positions(folds.filter(F.col("fold") != i), id_col, 7, name="_q")
            n_tr, held, parts = tr.count(), folds.filter(F.col("fold") == i), []
            for j, frac in enumerate(fractions):
                part = tr.filter(F.col("_q") <= max(1, int(frac * n_tr)))
                m = pipeline.fit(part)
                parts += [m.transform(held), m.transform(part),
                          random_predictor(part, held, label, True, seed=1000 * i + j, id_col=id_col)]
            return grouped_scores(parts, metric, label, id_col)

        with ThreadPoolExecutor(k) as ex:
            curves = list(ex.map(fold_curve, range(k)))
    finally:
        folds.unpersist()
    rows = [(float(frac), *[x for kind in range(3) for x in mean_std([c[3 * j + kind] for c in curves])])
            for j, frac in enumerate(fractions)]
    return spark.createDataFrame(rows, CURVE)


# ---------------------------------------------------------------- search


def grid(params: dict) -> list[dict]:
    keys = list(params)
    return [dict(zip(keys, v)) for v in itertools.product(*[params[k] for k in keys])]


SECTION1_GRID = {"alpha": K.SECTION1_ALPHA_GRID, "binary": [True, False], "use_idf": [True, False],
                 "norm": ["l2", "l1", None]}


def search_fixed_split(spark: SparkSession, train: DataFrame, val: DataFrame, candidates: list[dict],
                       section: int = 1, id_col: str = "doc_id", label: str = "relevancia") -> DataFrame:
    """EVA7/EVA8: every candidate fitted on ``train`` and scored (cumulative
    recall) on the fixed ``val`` split and on ``train``.

    A candidate has ``alpha`` and any of ``binary``, ``use_idf``, ``norm``, ``weights`` (one for each of
    ``columns``, all candidates alike; without it the section's own text). The counts are made once; all
    penalties and weightings are fitted in the passes of :mod:`dual_ridge`, and all
    candidates' scores are ranked by one grouped metric. ``mean_fit_time`` is a candidate's share of the passes.
    """
    import numpy as np
    from . import dual_ridge as DR
    from .models import edition_indicator, feature_stages
    rows = train.withColumn("_val", F.lit(0)).unionByName(val.withColumn("_val", F.lit(1)))
    columns = candidates[0].get("columns")
    bounds = (1, None) if section == 1 else (K.SECTION2_MIN_DF, K.SECTION2_MAX_DF)
    if columns:
        terms = _column_terms(rows, columns, section)
        names = [f"_terms_{i}" for i in range(len(columns))]
    else:
        terms = Pipeline(stages=feature_stages(section)[:3]).fit(rows).transform(rows)
        names = ["terms"]
    data = DR.counted(edition_indicator().transform(terms), names, label, "tipo_vec", [id_col, "_val"], ["_val"])
    fields = ("binary", "use_idf", "norm", "weights", "agg")
    made = [DR.Weighting(**{f: c[f] for f in fields if f in c}) for c in candidates]
    weightings, alphas = list(dict.fromkeys(made)), sorted({float(c["alpha"]) for c in candidates})
    part = np.where(data.kept["_val"] == 1, 2, 1)
    try:
        solved = DR.solve(data, [DR.Job(w, part, data.y) for w in weightings], alphas, bounds)
        got = _part_metrics(DR.scores(solved, [id_col]), "cum_recall", len(weightings) * len(alphas), id_col)
    finally:
        data.close()
    rows_out = []
    for c, w in zip(candidates, made, strict=True):
        i = weightings.index(w)
        number = i * len(alphas) + alphas.index(float(c["alpha"]))
        rows_out.append((float(c["alpha"]), w.binary, w.use_idf, str(w.norm), ",".join(f"{x:g}" for x in w.weights),
                         *got[number], solved.seconds[i] / len(alphas)))
    schema = ("param_alpha double, param_binary boolean, param_use_idf boolean, param_norm string, param_weights string, "
              "mean_test_score double, mean_train_score double, mean_fit_time double")
    return spark.createDataFrame(rows_out, schema)


def _column_terms(df: DataFrame, columns: list[str], section: int) -> DataFrame:
    """Terms of each normalised text column (``_terms_i``)."""
    from ..functions import text as T
    from ..operators import preprocess as P
    options = P.SECTION1_TEXT if section == 1 else P.SECTION2_TEXT
    n_max = 2 if section == 1 else 1
    keep = [c for c in df.columns if c not in ("titulo", "tipo_edicao")]
    pre = P.preprocess_articles(df, ["tipo_edicao", "titulo"], keep=keep)
    clean = lambda c: T.normalize_text(F.coalesce(F.col(c), F.lit("")), stopwords=K.portuguese_stopwords(), **options)
    texts = pre.select(*[c for c in pre.columns if c not in columns], *[clean(c).alias(f"_text_{i}") for i, c in enumerate(columns)])
    terms = [T.ngrams(T.tokens(f"_text_{i}"), 1, n_max).alias(f"_terms_{i}") for i in range(len(columns))]
    return texts.select("*", *terms)


def weight_vectors(n_columns: int, n_sets: int = 20, max_weight: int = 9, seed: int = 42) -> list[tuple]:
    """EVA8: random integer weights (1 to ``max_weight``) for the text columns, the same for the same seed."""
    rnd = random.Random(seed)
    return [tuple(float(rnd.randint(1, max_weight)) for _ in range(n_columns)) for _ in range(n_sets)]


def random_candidates(params: dict, n_iter: int, seed: int = 42) -> list[dict]:
    """EVA8: draws without replacement from the grid."""
    g = grid(params)
    rnd = random.Random(seed)
    return rnd.sample(g, min(n_iter, len(g)))


def search_table(results: DataFrame, sort_score: str = "mean_test_score") -> DataFrame:
    """EVA9 + PRJ6 + TOP5: result columns, best first (score desc, fit time
    asc, train score desc)."""
    import re
    keep = [c for c in results.columns
            if re.search(r"_fit_time|mean_train_|std_train_|mean_test_|std_test_|param_", c)]
    return results.select(*keep).orderBy(F.col(sort_score).desc(), F.col("mean_fit_time").asc(),
                                         F.col("mean_train_score").desc())


def best_param_slices(results: DataFrame, params: list[str],
                      score: str = "mean_test_score") -> DataFrame:
    """EVA10: for each parameter, the candidates whose other parameters equal
    the best candidate's (null-safe equality)."""
    best = results.orderBy(F.col(score).desc()).first()
    out = None
    for p in params:
        cond = F.lit(True)
        for q in params:
            if q != p:
                cond = cond & F.col(q).eqNullSafe(F.lit(best[q]))
        s = results.filter(cond).withColumn("varied_param", F.lit(p))
        out = s if out is None else out.unionByName(s)
    return out


# ---------------------------------------------------------------- baselines / bootstrap


def baseline_random(train: DataFrame, k: int = 5, metric: str = "rmse",
                    label: str = "relevancia", id_col: str = "doc_id") -> DataFrame:
    """MOD9: constant (mode, smallest on ties), uniform and frequency random
    predictors scored by k-fold CV; the best one first."""
    from .models import constant_predictor, mode_of, random_predictor
    spark = train.sparkSession
    folds = S.with_kfold(train, k, id_col, K.SHUFFLE_SEED).persist()
    rows = []
    try:
        for name in ("constant", "uniform", "frequency"):
            scores = []
            for i in range(k):
                tr = folds.filter(F.col("fold") != i)
                te = folds.filter(F.col("fold") == i)
                if name == "constant":
                    p = constant_predictor(te, mode_of(tr, label))
                else:
                    p = random_predictor(tr, te, label, follow_frequency=name == "frequency", seed=i)
                scores.append(_score(p, metric))
            mu, sd = mean_std(scores)
            rows.append((name, mu, sd))
    finally:
        folds.unpersist()
    larger_better = metric != "rmse"
    rows.sort(key=lambda r: -r[1] if larger_better else r[1])
    return spark.createDataFrame(rows, "baseline string, mean_score double, std_score double")


def bootstrap_metrics(pred: DataFrame, weights: DataFrame, trials: int = K.BOOTSTRAP_TRIALS,
                      seed: int = 42, sqrt_recall: bool = False, label: str = "relevancia",
                      id_col: str = "doc_id") -> DataFrame:
    """SPL9: class-rebalanced weighted bootstrap of the validation rows.

    Weights are constant per class, so a draw picks a class by its share of
    the total weight and then a uniform row inside the class.  ``trials * n``
    draws are generated with ``spark.range`` (distributed), the class by a
    comparison with the few cumulative shares, the row by an equi-join on
    (class, position in class).  Per trial: RMSE and cumulative recall
    (square-rooted as in the reference when ``sqrt_recall``).
    """
    from ..operators.ordering import with_position
    from .models import keyed_uniform
    spark = pred.sparkSession
    n = pred.count()
    cls = pred.groupBy(label).agg(F.count(F.lit(1)).alias("c")).join(weights, label)
    rows = sorted((r[label], r["c"], float(r["weight"])) for r in cls.collect())
    tot = sum(c * w for _, c, w in rows)
    narrow = pred.select(id_col, label, "prediction").withColumn("_k", S.shuffle_key(id_col, seed))
    pos = with_position(narrow, ["_k", id_col], group=[label], name="_cp").drop("_k")
    draws = spark.range(trials * n).select(
        (F.col("id") / n).cast("long").alias("trial"), F.col("id").alias("draw"),
        keyed_uniform(seed, F.col("id")).alias("_u1"), keyed_uniform(seed + 1, F.col("id")).alias("_u2"))
    expr, acc = None, 0.0
    for lab, c, w in rows:
        acc += c * w / tot
        cond = F.col("_u1") < F.lit(acc)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    expr = expr.otherwise(F.lit(rows[-1][0]))
    size = F.lit(None)
    for lab, c, _ in rows:
        size = F.when(F.col(label) == lab, F.lit(c)).otherwise(size)
    draws = draws.withColumn(label, expr).withColumn("_cp", (F.floor(F.col("_u2") * size) + 1).cast("long"))
    sample = draws.join(pos.select(label, "_cp", "prediction"), [label, "_cp"])
    # the draw id keeps repeated rows apart in the ranking
    sample = sample.withColumn(id_col, F.col("draw"))
    r = F.sqrt(F.avg(F.pow(F.col(label) - F.col("prediction"), 2)))
    per = sample.groupBy("trial").agg(r.alias("rmse"))
    cr = RK.cum_recall_metric(sample, label, "prediction", id_col, group=["trial"])
    per = per.join(cr.select("trial", "cum_recall"), "trial")
    if sqrt_recall:
        per = per.withColumn("cum_recall", F.sqrt("cum_recall"))
    return per


def bootstrap_summary(trials: DataFrame) -> DataFrame:
    """SPL9 report: mean and population std of both metrics over the trials."""
    return trials.agg(*[f(c).alias(f"{n}_{c}") for c in ("rmse", "cum_recall")
                        for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def bag_samples(df: DataFrame, n_estimators: int, max_samples: float | int, seed: int,
                id_col: str = "doc_id") -> list[DataFrame]:
    """SPL10: one bootstrap sample with replacement per member, seed = base + i.

    An int is a number of rows, ``min(n, max_samples)``; a float a share of
    them. Each draw is keyed by its number and the seed: exact size, and the
    same rows on every run.
    """
    from ..operators.ordering import with_position
    spark = df.sparkSession
    pos = with_position(df.select(id_col), [id_col], name="_p")
    n = pos.count()
    take = min(n, max_samples) if isinstance(max_samples, int) else int(max_samples * n)
    out = []
    for i in range(n_estimators):
        draws = spark.range(take).select(
            (F.pmod(F.xxhash64(F.lit(seed + i), "id"), F.lit(max(n, 1))) + 1).alias("_p"))
        out.append(draws.join(pos, "_p").select(id_col).join(df, id_col))
    return out
