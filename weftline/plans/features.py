"""Queries on features and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import names
from weftline.operators import extract, features
from weftline.session import Scratch, table


def _features(s, d):
    raw = table(s, d, "raw")
    profiles = features.document_profile(extract.extract_documents(raw))
    records = extract.associations(raw).select("raw_id", "snapshot_id").join(raw.select("raw_id", "prompt"), "raw_id")
    return Scratch(s, "features").put(features.feature_table(records, profiles))


def feature_table(s, d):
    """F1 to F8."""
    return _features(s, d)


def context_features(s, d):
    """F10, P13."""
    return features.context_features(_features(s, d))


def feature_registry(s, d):
    """F11."""
    f = _features(s, d)
    return s.createDataFrame([(c, features.dependency(c)) for c in f.columns if c != "raw_id"], "feature STRING, dependency STRING")


QUERIES = {f.__name__: f for f in (feature_table, context_features, feature_registry)}
ORACLE: dict[str, str] = {}
