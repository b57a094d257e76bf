"""Random forest of the air-quality class: fit, predict, evaluate."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..schema import LABEL
from ..session import drop_shuffles
from .features import VECTOR

# Size of the forest and its seed.
NUM_TREES = 15
MAX_DEPTH = 5
SEED = 42
# What Spark takes for classes at most where a label does not say how many there are.
MOST_CLASSES = 100


# Copies of one row that may share a partition.
COPIES_PER_CHUNK = 10_000

# Rows are counted by so many buckets of their content to find those that may have more copies.
BUCKETS = 65_536

# Rows of a partition on the average: about 50 MB of what a fit keeps of them.
ROWS_PER_PARTITION = 200_000


# How many rows of the input a counted row stands for, and as how many rows it is fitted at most.
WEIGHT = "__copies"
PIECES = 8


def counted_rows(features: DataFrame) -> DataFrame:
    """Each different vector and label once, with the number of its rows as `WEIGHT`; equal rows are
    counted in the tasks that read them, before the shuffle."""
    return features.groupBy(VECTOR, LABEL).agg(F.count("*").alias(WEIGHT))


def in_pieces(counted: DataFrame, most: int) -> DataFrame:
    """Counted rows as the rows that they stand for, or as ``most`` rows of equal weight where those
    are more, in the order of the counted ones."""
    pieces = F.least(F.col(WEIGHT), F.lit(most).cast("long"))
    weight = (F.col(WEIGHT) / pieces).cast("double").alias(WEIGHT)
    piece = F.explode(F.array_repeat(F.lit(1), pieces.cast("int"))).alias("__piece")
    return counted.select(VECTOR, LABEL, weight, piece).drop("__piece")


def partitions_for(n_rows: int, least: int) -> int:
    """Partitions for so many rows: they grow with the table, so that no task does."""
    return max(least, -(-n_rows // ROWS_PER_PARTITION))


def _crowded(features: DataFrame, content: Column) -> list[int]:
    """The buckets of content with more rows than a chunk may have copies; no other holds a row with
    more copies. They are counted in the tasks that read them, so little is shuffled."""
    sizes = features.groupBy(content.alias("bucket")).agg(F.count("*").alias("n_rows"))
    return sorted(row.bucket for row in sizes.where(F.col("n_rows") > COPIES_PER_CHUNK).collect())


def _in_chunks(features: DataFrame) -> DataFrame:
    """Rows with how many copies each stands for, in which chunk of its copies.

    Where most rows are copies, all are counted, which leaves little to spread. Elsewhere a shuffle to count
    them would be as large as the one that spreads them, so only rows of crowded buckets are counted: all
    copies of another row are in its first chunk, and each goes as it is. Rows fall the same either way.
    """
    first, one = F.lit(0).cast("long").alias("__chunk"), F.lit(1).alias("__copies_here")
    if WEIGHT in features.columns:
        return features.select("*", first, one)
    digest = F.xxhash64(vector_to_array(F.col(VECTOR)), F.col(LABEL))
    seen = features.agg(F.count("*").alias("n_rows"), F.approx_count_distinct(digest).alias("n_different")).first()
    counted, single = F.lit(True), F.lit(False)
    if 2 * seen.n_different > seen.n_rows:
        content = F.pmod(digest, F.lit(BUCKETS))
        crowded = _crowded(features, content)
        counted = content.isin(crowded) if crowded else F.lit(False)
        single = ~counted
    last_chunk = F.floor((F.col(WEIGHT) - 1) / COPIES_PER_CHUNK)
    chunks = counted_rows(features.where(counted)).select("*", F.explode(F.sequence(F.lit(0).cast("long"), last_chunk)).alias("__chunk"))
    here = F.least(F.lit(COPIES_PER_CHUNK).cast("long"), F.col(WEIGHT) - F.col("__chunk") * COPIES_PER_CHUNK)
    chunks = chunks.select(VECTOR, LABEL, "__chunk", here.cast("int").alias("__copies_here"))
    return features.where(single).select(VECTOR, LABEL, first, one).unionByName(chunks)


def in_repeatable_order(features: DataFrame, partitions: int) -> DataFrame:
    """Spread rows by their content and order them inside each partition.

    The forest draws its samples per partition, so a seed repeats a model only where rows fall
    into the same partitions in the same order. Rows with many copies are counted before the shuffle and
    spread in chunks after it, so that many copies of one vector do not fill one partition. Counted
    rows fall where the rows that they stand for would; as they are few, one chunk holds them. The order
    is that of a hash of the content, which sorts as plain numbers; values decide where hashes are equal.
    """
    values = vector_to_array(F.col(VECTOR))
    chunks = _in_chunks(features).withColumn("__place", F.xxhash64(values, F.col(LABEL), F.col("__chunk")))
    placed = chunks.repartition(partitions, "__place").sortWithinPartitions("__place", values, LABEL, "__chunk")
    if WEIGHT in features.columns:
        return placed.drop("__chunk", "__place", "__copies_here")
    copies = F.explode(F.array_repeat(F.lit(1), F.col("__copies_here"))).alias("__copy")
    return placed.select(VECTOR, LABEL, copies).drop("__copy")


def fit_forest(
    features: DataFrame,
    num_trees: int = NUM_TREES,
    max_depth: int = MAX_DEPTH,
    seed: int = SEED,
    repeatable_partitions: int | None = None,
    max_memory_mb: int = 256,
    pieces: int = PIECES,
) -> RandomForestClassificationModel:
    """Train on vectors and labels; labels 1 to 5 give six classes, as class 0 counts too.

    ``repeatable_partitions`` is the least number of partitions; a large table is spread over more
    (`partitions_for`), which its number of rows alone decides.

    Fitting reads its input a few times (classes, split points, sampled rows) and then works on
    its own compact copy of the rows. Give it a written feature table: reading that again is
    cheaper than a second cached copy, and survives the loss of an executor. With
    ``repeatable_partitions`` the rows as placed are kept on disk until the fit is done, and the shuffles
    that placed them are gone before it starts.

    A table from `counted_rows` holds each different row once, and every pass reads it so. A row that
    stands for no more than ``pieces`` rows is fitted as those, so with ``repeatable_partitions`` the
    trees are the same as on all rows; one that stands for more is fitted as ``pieces`` rows of equal
    weight. Weights count in split points, impurities and votes. There the trees differ from those on
    all rows, as they do between seeds: a bootstrap draws ``pieces`` times, not once per copy.
    """
    weighted = WEIGHT in features.columns
    rows = F.sum(WEIGHT) if weighted else F.count("*")
    known = features.agg(F.max(F.col(LABEL).cast("double")).alias("top"), rows.alias("n_rows")).first()
    placed = None
    if repeatable_partitions:
        # The classifier starts from its input several times; each would spread and sort it again.
        placed = in_repeatable_order(features, partitions_for(known.n_rows or 0, repeatable_partitions))
        features = placed = placed.persist(StorageLevel.DISK_ONLY)
        placed.count()
        drop_shuffles(placed)
    training = in_pieces(features, pieces) if weighted else features
    # With the number of classes at the label, the classifier does not look for it through all that
    # was spread and sorted. A label that is no class is left for it to refuse.
    plain = known.top is not None and 0 <= known.top < MOST_CLASSES and known.top == int(known.top)
    classes = {"ml_attr": {"type": "nominal", "num_vals": int(known.top) + 1}} if plain else {}
    training = training.withColumn(LABEL, F.col(LABEL).cast("double").alias(LABEL, metadata=classes))
    training = training.select(VECTOR, LABEL, *([WEIGHT] if weighted else []))
    classifier = RandomForestClassifier(
        labelCol=LABEL,
        featuresCol=VECTOR,
        numTrees=num_trees,
        maxDepth=max_depth,
        seed=seed,
        maxMemoryInMB=max_memory_mb,
    )
    try:
        return (classifier.setWeightCol(WEIGHT) if weighted else classifier).fit(training)
    finally:
        if placed is not None:
            placed.unpersist()


def confidence(probability: str = "probability") -> Column:
    """The probability of the class that won."""
    return F.array_max(vector_to_array(F.col(probability)))


def predict(model: RandomForestClassificationModel, features: DataFrame) -> DataFrame:
    """Add class and confidence to rows of vectors, in one pass."""
    kept = [name for name in features.columns if name != VECTOR]
    return model.transform(features).select(
        *kept,
        F.col("prediction").cast("int").alias("prediction"),
        confidence().alias("confidence"),
    )


def confusion_matrix(predictions: DataFrame, label: str = LABEL, predicted: str = "prediction") -> DataFrame:
    """Rows per pair of true and predicted class."""
    return predictions.groupBy(
        F.col(label).cast("int").alias("label"), F.col(predicted).cast("int").alias("predicted")
    ).agg(F.count("*").alias("n_rows"))


def evaluate(predictions: DataFrame, label: str = LABEL, predicted: str = "prediction") -> DataFrame:
    """Accuracy and weighted F1 as one row, both from one confusion matrix."""
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n_rows")).otherwise(0)
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("label").alias("code"), F.col("n_rows").alias("support"),
                 none.alias("claimed"), hit.alias("hits")),
        F.struct(F.col("predicted").alias("code"), none.alias("support"),
                 F.col("n_rows").alias("claimed"), none.alias("hits")),
    )
    per_class = (
        confusion_matrix(predictions, label, predicted)
        .select(F.inline(sides))
        .groupBy("code")
        .agg(*[F.sum(name).alias(name) for name in ("support", "claimed", "hits")])
    )
    f1 = 2 * F.col("hits") / (F.col("support") + F.col("claimed"))
    return per_class.agg(
        F.sum("support").alias("n_rows"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("support") * f1) / F.sum("support")).alias("weighted_f1"),
    )
