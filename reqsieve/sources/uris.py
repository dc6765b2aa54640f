"""Where traffic lives."""

from __future__ import annotations

from pyspark.sql import SparkSession

from reqsieve.session import exists

_OBJECT_STORE = "ref+s3://"


def resolve_uri(uri: str) -> str:
    """A path Spark can read: ``ref+s3://bucket/key`` becomes ``s3a://bucket/key``.

    Other schemes pass through; a path without one must exist in the file system that Spark
    reads such paths from.
    """
    if uri.startswith(_OBJECT_STORE):
        bucket, _, key = uri[len(_OBJECT_STORE):].partition("/")
        if not bucket or not key:
            raise ValueError(f"invalid object URI {uri!r}: expected {_OBJECT_STORE}bucket/key")
        return f"s3a://{bucket}/{key}"
    if "://" in uri:
        return uri
    if not exists(SparkSession.active(), uri):
        raise FileNotFoundError(f"file does not exist: {uri}")
    return uri
