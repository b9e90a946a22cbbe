"""Classification metrics. Rows are counted by (label, prediction) once; everything else is
computed from that table of at most C x C counts per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.sources.schemas import NUM_CLASSES

AVERAGED = ("precision", "recall", "f1")


def row_loss(label: str, probability: str, floor: float = 1e-15) -> Column:
    """Negative log of the probability given to the true class; null for a label outside the classes."""
    given = F.get(F.col(probability), F.col(label).cast("int"))
    return F.when(given.isNotNull(), -F.log(F.greatest(given, F.lit(floor))))


def confusion(
    df: DataFrame, label: str = "label", prediction: str = "prediction",
    classes: int = NUM_CLASSES, by: tuple[str, ...] = (), probability: str | None = None,
) -> DataFrame:
    """Dense matrix ``(*by, label, prediction, n)``; pairs outside ``[0, classes)`` are left out.

    With ``probability`` each cell also has the sum of its rows' log losses in ``loss``.
    """
    pair = F.col(label).cast("long") * classes + F.col(prediction).cast("long")
    inside = F.col(label).between(0, classes - 1) & F.col(prediction).between(0, classes - 1)
    # Rows outside get a null cell, dropped after counting: a filter before it would be pushed
    # below the prediction and compute it again. The grid is filled inside the group, without a
    # join, so partial counts are the only rows that move.
    sums = [F.count(F.lit(1)).alias("n")]
    if probability is not None:
        sums.append(F.sum(F.when(inside, row_loss(label, probability))).alias("loss"))
    measures = ["n", "loss"][: len(sums)]
    counts = df.groupBy(*by, F.when(inside, pair).alias("_cell")).agg(*sums)
    entry = F.struct("_cell", F.struct(*measures))
    cells = counts.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("_cell").isNotNull(), entry))).alias("_cells")
    )
    numbers = F.sequence(F.lit(0), F.lit(classes * classes - 1)).cast("array<bigint>")
    grid = cells.select(*by, "_cells", F.explode(numbers).alias("_cell"))
    found = F.col("_cells")[F.col("_cell")]
    zero = {"n": F.lit(0).cast("long"), "loss": F.lit(0.0)}
    return grid.select(
        *by,
        F.floor(F.col("_cell") / classes).cast("long").alias("label"),
        F.pmod(F.col("_cell"), F.lit(classes)).cast("long").alias("prediction"),
        *[F.coalesce(found[m], zero[m]).alias(m) for m in measures],
    )


def normalised(matrix: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Add each cell's ``share`` of its label's row and ``percent``; an empty row has share 0."""
    row = F.sum("n").over(Window.partitionBy(*by, "label"))
    share = F.col("n") / F.greatest(row, F.lit(1))
    return matrix.withColumn("share", share).withColumn("percent", share * 100.0)


def class_metrics(matrix: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, f1 and support per class; an absent class has zeros."""
    zero = F.lit(0).cast("long")
    as_label = F.struct(
        F.col("label").alias("class_id"), F.col("n").alias("support"), zero.alias("predicted"),
        F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero).alias("hits"),
    )
    as_prediction = F.struct(
        F.col("prediction").alias("class_id"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("hits")
    )
    sums = (
        matrix.select(*by, F.inline(F.array(as_label, as_prediction)))
        .groupBy(*by, "class_id")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    )
    precision = F.col("hits") / F.greatest("predicted", F.lit(1))
    recall = F.col("hits") / F.greatest("support", F.lit(1))
    return sums.select(*by, "class_id", "support", "hits", precision.alias("precision"), recall.alias("recall")).select(
        "*",
        (2.0 * F.col("precision") * F.col("recall")
         / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12))).alias("f1"),
    )


def _weighted(column: str) -> Column:
    return F.sum(F.col(column) * F.col("support")) / F.greatest(F.sum("support"), F.lit(1))


def summary(per_class: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, macro and support-weighted averages; ``*_avg`` repeat the macro values."""
    total = F.greatest(F.sum("support"), F.lit(1))
    out = per_class.groupBy(*by).agg(
        (F.sum("hits") / total).alias("accuracy"),
        *[F.avg(c).alias(f"{c}_macro") for c in AVERAGED],
        *[_weighted(c).alias(f"{c}_weighted") for c in AVERAGED],
        F.sum("support").alias("support"),
    )
    return out.withColumns({f"{c}_avg": F.col(f"{c}_macro") for c in AVERAGED})


def report(per_class: DataFrame, by: tuple[str, ...] = (), digits: int = 4) -> DataFrame:
    """Classification report as rows: every class, accuracy, macro and weighted averages."""
    values = [F.round(c, digits).alias(c) for c in AVERAGED]
    classes = per_class.select(*by, F.col("class_id").cast("string").alias("name"), *values, "support")
    s = summary(per_class, by)

    def line(name: str, precision: str | None, recall: str | None, f1: str) -> Column:
        def rounded(c: str | None) -> Column:
            return F.lit(None).cast("double") if c is None else F.round(c, digits)
        return F.struct(
            F.lit(name).alias("name"), rounded(precision).alias("precision"),
            rounded(recall).alias("recall"), rounded(f1).alias("f1"), F.col("support"),
        )

    lines = F.array(
        line("accuracy", None, None, "accuracy"),
        line("macro avg", "precision_macro", "recall_macro", "f1_macro"),
        line("weighted avg", "precision_weighted", "recall_weighted", "f1_weighted"),
    )
    return classes.unionByName(s.select(*by, F.inline(lines)))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction", by: tuple[str, ...] = ()) -> DataFrame:
    hit = F.avg((F.col(label) == F.col(prediction)).cast("double"))
    return df.groupBy(*by).agg(hit.alias("accuracy")).withColumn("merror", 1.0 - F.col("accuracy"))


def log_loss(df: DataFrame, label: str = "label", probability: str = "probability", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean negative log of the probability given to the true class, and the error rate, over the
    ``n_rows`` rows whose label is a class; ``n_excluded`` counts the others."""
    best = F.array_position(F.col(probability), F.array_max(probability)) - 1
    inside = F.coalesce((F.col(label) >= 0) & (F.col(label) < F.size(probability)), F.lit(False))
    return df.groupBy(*by).agg(
        F.avg(F.when(inside, row_loss(label, probability))).alias("mlogloss"),
        F.avg(F.when(inside, (best != F.col(label)).cast("double"))).alias("merror"),
        F.count(F.when(inside, 1)).alias("n_rows"), F.count(F.when(~inside, 1)).alias("n_excluded"),
    )


def matrix_loss(matrix: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """:func:`log_loss` from a matrix that has the ``loss`` sums."""
    wrong = F.when(F.col("label") != F.col("prediction"), F.col("n")).otherwise(0)
    total = F.greatest(F.sum("n"), F.lit(1))
    return matrix.groupBy(*by).agg(
        (F.sum("loss") / total).alias("mlogloss"), (F.sum(wrong) / total).alias("merror"), F.sum("n").alias("n_rows")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def class_count(frames: list[DataFrame], column: str) -> DataFrame:
    """Number of distinct values over several tables."""
    union = frames[0].select(column)
    for df in frames[1:]:
        union = union.unionByName(df.select(column))
    return union.agg(F.count_distinct(column).alias("num_classes"))
