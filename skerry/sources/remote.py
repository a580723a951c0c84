"""REST listings as a Spark data source: ``spark.dataSource.register(RestListing)``, then ``format("rest_listing")``.

One partition per url, so listings of many feeds are fetched by the executors; a lost executor fetches its urls
again.  The key that signs requests is read from the environment of the task and is never in the plan.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import time
import urllib.request

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _compact(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def bearer(key: str, key_id: str, issuer: str, now: int, seconds: int = 60) -> str:
    """A JSON web token signed with HMAC-SHA256."""
    head = {"alg": "HS256", "typ": "JWT", "kid": key_id}
    claims = {"iss": issuer, "iat": now, "exp": now + seconds}
    signed = ".".join(_compact(json.dumps(part).encode()) for part in (head, claims))
    return signed + "." + _compact(hmac.new(key.encode(), signed.encode(), hashlib.sha256).digest())


class Url(InputPartition):
    def __init__(self, url: str):
        self.url = url


class Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split(",") if u]
        if not self.urls:
            raise ValueError("name the listings in the option urls")
        self.field, self.timeout = options.get("field"), float(options.get("timeout", "10"))
        self.key_variable = options.get("keyVariable")
        self.key_id, self.issuer = options.get("keyId", ""), options.get("issuer", "")

    def partitions(self):
        return [Url(u) for u in self.urls]

    def read(self, partition):
        headers = {}
        if self.key_variable:
            if not os.environ.get(self.key_variable):
                raise ValueError(f"{self.key_variable} must be set")
            token = bearer(os.environ[self.key_variable], self.key_id, self.issuer, int(time.time()))
            headers["Authorization"] = f"Bearer {token}"
        request = urllib.request.Request(partition.url, headers=headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # other failures raise
            if answer.status == 204:
                return
            body = json.loads(answer.read())
        for entry in body[self.field] if self.field else body:
            yield partition.url, json.dumps(entry)


class RestListing(DataSource):
    """(url, entry): the entries of each listing as JSON; a listing without content has none.

    Options: ``urls`` (joined by commas), ``field`` (where the array is, if not the whole body), ``timeout`` in
    seconds, ``keyVariable``, ``keyId`` and ``issuer`` for signed requests.
    """

    @classmethod
    def name(cls):
        return "rest_listing"

    def schema(self):
        return "url string, entry string"

    def reader(self, schema):
        return Reader(self.options)


def url_quoted(path: Column) -> Column:
    """A path as part of a url: all but letters, digits, ``_.-~`` and ``/`` as bytes in hexadecimal."""
    out = F.url_encode(path)
    for written, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(written), F.lit(wanted))
    return out
