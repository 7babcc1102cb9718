"""Boosted shared regression stumps over a table of examples.

``examples(id, y, x, weight)``: class ``y`` in 1..C, feature array ``x``, initial weight.  A round is one
sorted pass: weights are summed per (feature, value) and class, cumulated (hot features are split by
:mod:`ordered`), every class subset is scored per threshold by column arithmetic, and only the best
stump returns to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.operators.ordered import cumulate
from facetry.session import cut

# Round limit, patience on the validation set, exhaustive subset search up to this many classes.
MAX_ROUNDS = 300
PATIENCE = 50
EXHAUSTIVE_CLASSES = 8
TINY = 1.17549435e-38
# errors are compared after rounding, so that mirror-image stumps tie regardless of summation order
ERROR_DIGITS = 12


@dataclass
class Stump:
    """``a`` above the threshold, ``b`` up to it for classes in ``s``; constant ``k`` for the others."""

    f: int
    th: float
    a: float
    b: float
    k: list[float]
    s: list[bool]
    err: float = 0.0


def target(y: Column, c: int) -> Column:
    return F.when(y == c + 1, 1.0).otherwise(-1.0)


def start(examples: DataFrame, classes: int) -> DataFrame:
    """Boosting state: one weight and one score per class."""
    w = F.array_repeat(F.col("weight").cast("double"), classes)
    return cut(examples.withColumn("w", w).withColumn("h", F.array_repeat(F.lit(0.0), classes)))


def threshold_sums(state: DataFrame, classes: int, **kw) -> DataFrame:
    """Per (feature, value) and class: cumulative and total weight, plain and signed by the target."""
    long = state.select("y", "w", F.posexplode("x").alias("fid", "v"))
    measures = {}
    for c in range(classes):
        measures[f"w{c}"] = F.col("w")[c]
        measures[f"y{c}"] = F.col("w")[c] * target(F.col("y"), c)
    return cumulate(long, ["fid"], "v", measures, **kw)


def _scored(sums: DataFrame, classes: int, subsets: list[int]) -> DataFrame:
    """Every candidate ``(fid, v, n)`` with its stump values and error.  Bit ``C-1-c`` of ``n`` is class ``c``."""
    rows = sums.withColumn("n", F.explode(F.array(*[F.lit(n) for n in subsets])))

    def member(c):
        return F.shiftright("n", classes - 1 - c).bitwiseAND(F.lit(1)) == 1

    def over(pick):
        return sum((F.when(member(c), pick(c)).otherwise(0.0) for c in range(classes)), F.lit(0.0))

    rows = rows.withColumns(
        {
            "wb": over(lambda c: F.col(f"cum_w{c}")),
            "yb": over(lambda c: F.col(f"cum_y{c}")),
            "wt": over(lambda c: F.col(f"total_w{c}")),
            "yt": over(lambda c: F.col(f"total_y{c}")),
        }
    )
    rest = sum(
        (
            F.when(member(c), 0.0).otherwise(
                F.col(f"total_w{c}") - F.col(f"total_y{c}") * F.col(f"total_y{c}") / (F.col(f"total_w{c}") + TINY)
            )
            for c in range(classes)
        ),
        F.lit(0.0),
    )
    wa = F.greatest(F.col("wt") - F.col("wb"), F.lit(0.0))
    rows = rows.withColumns({"b": F.coalesce(F.try_divide(F.col("yb"), F.col("wb")), F.lit(0.0)), "wa": wa})
    top = F.when(F.col("wa") > 1e-14 * F.col("wt"), (F.col("yt") - F.col("yb")) / F.col("wa")).otherwise(0.0)
    rows = rows.withColumn("a", top)
    a, b = F.col("a"), F.col("b")
    err = F.col("wa") * (1 - a * a) + F.col("wb") * (1 - b * b) + rest
    return rows.withColumn("err", F.round(err, ERROR_DIGITS))


def best_stump(sums: DataFrame, classes: int, subsets: list[int]) -> Stump:
    """Lowest error; among equals the last subset, then the last feature, then the first threshold."""
    # a class whose weights have all underflown answers 0
    ks = [F.coalesce(F.try_divide(F.col(f"total_y{c}"), F.col(f"total_w{c}")), F.lit(0.0)) for c in range(classes)]
    pick = F.struct("fid", "v", "a", "b", "n", "err", F.array(*ks).alias("k"))
    order = F.struct("err", -F.col("n"), -F.col("fid"), F.col("v"))
    r = _scored(sums, classes, subsets).agg(F.min_by(pick, order).alias("s")).first().s
    s = [bool(r.n >> (classes - 1 - c) & 1) for c in range(classes)]
    return Stump(r.fid, r.v, r.a, r.b, list(r.k), s, r.err)


def search(state: DataFrame, classes: int, **kw) -> Stump:
    """All class subsets for few classes; otherwise grow one subset class by class."""
    sums = cut(threshold_sums(state, classes, **kw))
    if classes <= EXHAUSTIVE_CLASSES:
        return best_stump(sums, classes, list(range(1, 1 << classes)))
    best, grown = None, 0
    for _ in range(classes):
        options = [grown | 1 << (classes - 1 - c) for c in range(classes) if not grown >> (classes - 1 - c) & 1]
        stump = best_stump(sums, classes, options)
        if best is None or stump.err <= best.err:
            best = stump
            grown = sum(1 << (classes - 1 - c) for c, s in enumerate(stump.s) if s)
        else:
            break
    return best


def response(x: Column, stump: Stump) -> list[Column]:
    split = F.when(x[stump.f] > stump.th, stump.a).otherwise(stump.b)
    return [split if s else F.lit(stump.k[c]) for c, s in enumerate(stump.s)]


def update(state: DataFrame, stump: Stump) -> DataFrame:
    """Add the responses to the scores; reweight by ``exp(-target * response)`` and normalise over all entries."""
    h = response(F.col("x"), stump)
    scores = F.array(*[F.col("h")[c] + v for c, v in enumerate(h)])
    weights = F.array(*[F.col("w")[c] * F.exp(-target(F.col("y"), c) * v) for c, v in enumerate(h)])
    new = state.withColumn("h", scores).withColumn("w", weights)
    new = cut(new)
    total = new.agg(F.sum(F.aggregate("w", F.lit(0.0), lambda s, v: s + v))).first()[0]
    return new.withColumn("w", F.transform("w", lambda v: F.coalesce(F.try_divide(v, F.lit(total)), F.lit(0.0))))


def predicted(h: Column) -> Column:
    """Class of the highest score; the last class wins a tie."""
    return (F.size(h) - F.array_position(F.reverse(h), F.array_max(h)) + 1).cast("int")


def error(state: DataFrame) -> float:
    miss = F.when(predicted(F.col("h")) != F.col("y"), F.col("weight")).otherwise(0.0)
    return state.agg(F.sum(miss)).first()[0] or 0.0


def train(examples: DataFrame, classes: int, rounds: int = MAX_ROUNDS, validation: DataFrame | None = None, patience: int = PATIENCE, **kw) -> list[Stump]:
    """Boost for ``rounds`` rounds; with a validation set keep the best round and stop early."""
    state = start(examples, classes)
    held = start(validation, classes) if validation is not None else None
    model: list[Stump] = []
    best_error, best_round, worse = float("inf"), 0, 0
    for _ in range(rounds):
        stump = search(state, classes, **kw)
        model.append(stump)
        state = update(state, stump)
        if held is None:
            best_round = len(model)
            continue
        h = response(F.col("x"), stump)
        held = cut(held.withColumn("h", F.array(*[F.col("h")[c] + v for c, v in enumerate(h)])))
        now = error(held)
        if now < best_error:
            best_error, best_round, worse = now, len(model), 0
        else:
            worse += 1
            if worse > patience:
                break
    return model[:best_round]


def model_frame(spark: SparkSession, model: list[Stump]) -> DataFrame:
    """The model as a table: one row per round."""
    rows = [(i, m.f, m.a, m.b, m.th, m.k, m.s) for i, m in enumerate(model, 1)]
    return spark.createDataFrame(rows, "round int, f int, a double, b double, th double, k array<double>, s array<boolean>")


def model_from_frame(df: DataFrame) -> list[Stump]:
    return [Stump(r.f, r.th, r.a, r.b, list(r.k), list(r.s)) for r in df.orderBy("round").collect()]


def predict(examples: DataFrame, model: DataFrame) -> DataFrame:
    """Adds ``h``, the row-normalised probabilities ``p`` and the predicted class ``yp``.

    The model (one short row per round) enters as a single array value.
    """
    whole = model.agg(F.array_sort(F.collect_list(F.struct("round", "f", "a", "b", "th", "k", "s")))).scalar()
    rows = examples.withColumn("_m", whole)
    zero = F.transform(F.element_at("_m", 1)["k"], lambda k: F.lit(0.0))

    def add(acc, m):
        split = F.when(F.element_at(F.col("x"), m["f"] + 1) > m["th"], m["a"]).otherwise(m["b"])
        step = F.zip_with(m["k"], m["s"], lambda k, s: F.when(s, split).otherwise(k))
        return F.zip_with(acc, step, lambda u, v: u + v)

    rows = rows.withColumn("h", F.aggregate("_m", zero, add)).drop("_m")
    p = F.transform("h", lambda v: F.lit(1.0) / (F.lit(1.0) + F.exp(-v)))
    rows = rows.withColumn("p", p).withColumn("yp", predicted(F.col("p")))
    total = F.aggregate("p", F.lit(0.0), lambda s, v: s + v)
    return rows.withColumn("_t", total).withColumn("p", F.transform("p", lambda v: v / F.col("_t"))).drop("_t")


def neg_log_probabilities(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Export rows ``keys, -ln p_1 .. -ln p_C``."""
    return predictions.select(*keys, F.transform("p", lambda v: -F.ln(v)).alias("nlog"))


def cascade(examples: DataFrame, classes: int, context, stages: int = 3, rounds: int = MAX_ROUNDS, **kw) -> list[list[Stump]]:
    """Stages of boosting; ``context(predictions)`` turns class probabilities into ``(id, extra array)``.

    Each stage sees the original features followed by the context of the previous stage.
    """
    models, current = [], examples
    for stage in range(stages):
        model = train(current, classes, rounds, **kw)
        models.append(model)
        if stage + 1 < stages:
            scored = predict(current, model_frame(examples.sparkSession, model))
            extra = cut(context(scored).select("id", "extra"))
            current = cut(examples.join(extra, "id").withColumn("x", F.concat("x", "extra")).drop("extra"))
    return models
