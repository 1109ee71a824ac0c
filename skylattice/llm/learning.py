"""What the trained operators share: bounded samples of training rows, and hashing of doc_id into folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes at most.
CLASSES = 64


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(folds)


def held_out(id_col: str, folds: int, rest: int) -> Column:
    """True for ids of the fold that is never learned from; false for null ids, which aren't learned from either."""
    return F.coalesce(fold(id_col, folds) == F.lit(rest), F.lit(False))


def class_counts(rows: DataFrame, class_col: str) -> dict:
    """Rows of each class; more than CLASSES classes are refused."""
    found = {r[class_col]: r["count"] for r in rows.groupBy(class_col).count().limit(CLASSES + 1).collect()}
    if len(found) > CLASSES:
        raise ValueError(f"more than {CLASSES} classes")
    return found


def sampled_ids(rows: DataFrame, id_col: str, class_col: str, counts: dict, most: int) -> DataFrame:
    """The rows of each class whose id hashes under most / (rows of the class): about `most` of each (a binomial number), alike on every run, without a shuffle."""
    unit = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.coalesce(*[F.when(F.col(class_col) == F.lit(c), F.lit(most / n)) for c, n in counts.items()], F.lit(0.0))
    return rows.select(id_col, class_col).where(unit < share)


def sampled_texts(docs: DataFrame, usable: DataFrame, most: int) -> DataFrame:
    """doc_id, label, text of about `most` labelled documents of each label; docs: doc_id, text; usable: doc_id, label.

    A label that a document has several times counts once, and of rows that repeat an id the least text, so repeats can't add rows.
    """
    usable = usable.distinct()
    chosen = sampled_ids(usable, "doc_id", "label", class_counts(usable, "label"), most)
    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).join(F.broadcast(chosen), "doc_id")  # some 2 x most ids
    return taken.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
