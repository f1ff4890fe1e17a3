"""Frames that every operator has to take: nulls, empties, repeats, clashing names, and none at all."""

from __future__ import annotations

import pyarrow as pa


def docs(spark, rows, extra=True):
    """(doc_id, text) rows, with other columns under names that operators use themselves."""
    schema = "doc_id bigint, text string" + (", id string, n bigint, th string, words string, bucket int, g string, h string, sig string" if extra else "")
    return spark.createDataFrame([(*r, "x", 1, "x", "x", 1, "x", "x", "x") if extra else r for r in rows], schema)


def words(rng, n, vocabulary=5000, tag="w"):
    return " ".join(f"{tag}{k}" for k in rng.integers(0, vocabulary, n))


def column(values):
    return pa.array(values, pa.string())
