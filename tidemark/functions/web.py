"""Addresses, error texts and their codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hosts whose addresses carry a video id.
VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be")
#: Parts of an error's text, its code, and whether to try again; the first that fits counts.
ERRORS = [
    (("private video",), "ACCESS_DENIED", False), (("sign in", "login"), "AUTH_REQUIRED", False), (("not available", "video unavailable"), "VIDEO_NOT_FOUND", False),
    (("429", "too many requests"), "RATE_LIMITED", True), (("timeout", "timed out"), "NETWORK_TIMEOUT", True),
]
#: Code of any other error, which may be tried again.
OTHER_ERROR = "METADATA_FAILED"
#: Codes of a rejected transcript and whether to try again.
RETRYABLE = [("INVALID_URL", False), ("UNSUPPORTED_SOURCE", False), ("TRANSCRIPT_INVALID", False), ("EXPORT_FAILED", True)]


def retry_table(spark: SparkSession) -> DataFrame:
    """(error, retryable) of every code; a dozen rows."""
    known = [*RETRYABLE, *((code, again) for _, code, again in ERRORS), (OTHER_ERROR, True)]
    return spark.createDataFrame(known, "error string, retryable boolean")


def video_id(url: Column) -> Column:
    """(id, error) of an address: the one path part after the short host, /shorts/, /embed/ or /live/, or the one v of /watch."""
    url = F.trim(url)
    part = lambda name: F.try_parse_url(url, F.lit(name))
    scheme, path = F.lower(part("PROTOCOL")), F.coalesce(part("PATH"), F.lit(""))
    host = F.regexp_replace(F.lower(F.coalesce(part("HOST"), F.lit(""))), r"\.+$", "")
    one_part = lambda prefix: F.nullif(F.regexp_extract(path, f"^{prefix}/+([^/]+)/*$", 1), F.lit(""))
    queries = F.regexp_extract_all(F.concat(F.lit("&"), F.coalesce(part("QUERY"), F.lit(""))), F.lit(r"&v=([^&]*)"), 1)
    found = F.when(host == "youtu.be", one_part("")).when(path == "/watch", F.when(F.size(queries) == 1, queries[0])).otherwise(one_part("/(?:shorts|embed|live)"))
    good = F.coalesce(scheme.isin("http", "https") & host.isin(*VIDEO_HOSTS) & found.rlike(r"^[A-Za-z0-9_-]{11}$"), F.lit(False))
    error = F.when(~F.coalesce(scheme.isin("http", "https"), F.lit(False)), "INVALID_URL").when(~host.isin(*VIDEO_HOSTS), "UNSUPPORTED_SOURCE").when(~good, "INVALID_URL")
    return F.struct(F.when(good, found).alias("id"), error.alias("error"))


def plain_address(url: Column) -> Column:
    """host and path of any address: lower-cased host without 'www.', path without the closing slash."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.|\.$", "")
    return F.concat(host, F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"/+$", ""))


def error_code(message: Column) -> Column:
    """(code, retryable) of an error's text."""
    text = F.lower(F.coalesce(message, F.lit("")))
    code, again = F.lit(OTHER_ERROR), F.lit(True)
    for parts, name, retry in reversed(ERRORS):
        said = F.lit(False)
        for p in parts:
            said = said | text.contains(p)
        code, again = F.when(said, name).otherwise(code), F.when(said, F.lit(retry)).otherwise(again)
    return F.struct(code.alias("code"), again.alias("retryable"))
