"""Small metadata files on any Hadoop file system (file, hdfs, s3a), written whole or not at all. Data files are read
and written by Spark itself."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


#: What the S3 file system says of stores with conditional puts.
_CONDITIONAL = "fs.option.create.conditional.overwrite"


class AlreadyExists(FileExistsError):
    pass


class Storage:
    """Files by path. ``single_writer``: the caller vouches that nobody else writes, so that stores without exclusive
    creation may be used."""

    def __init__(self, spark: SparkSession, single_writer: bool = False):
        self.spark, self.single_writer = spark, single_writer

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    @staticmethod
    def local(path: str) -> str | None:
        u = urlparse(path)
        return unquote(u.path) if u.scheme == "file" else path if not u.scheme else None

    def exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def read(self, path: str) -> bytes:
        if (own := self.local(path)) is not None:
            with open(own, "rb") as f:
                return f.read()
        p, fs = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, path: str, data: bytes) -> None:
        """Write a new file; AlreadyExists if there is one. Of writers at the same time exactly one succeeds: locally by
        a hard link, elsewhere by the file system's create without overwriting. Where an S3 store doesn't offer
        conditional puts this is refused, unless ``single_writer``."""
        if (own := self.local(path)) is not None:
            os.makedirs(os.path.dirname(own), exist_ok=True)
            tmp = f"{os.path.dirname(own)}/.{uuid.uuid4().hex}"
            with open(tmp, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(tmp, own)
            except FileExistsError:
                raise AlreadyExists(path) from None
            finally:
                os.unlink(tmp)
            return
        p, fs = self._fs(path)
        conditional = urlparse(path).scheme in ("s3", "s3a", "s3n") and fs.hasPathCapability(p, _CONDITIONAL)
        if not conditional and not self.exclusive(path):
            raise NotImplementedError(
                f"{path}: this store can't create files exclusively, so two commits could both succeed; turn on conditional puts or name a single writer"
            )
        try:
            out = fs.createFile(p).overwrite(False).must(
                _CONDITIONAL, "true"
            ).build() if conditional else fs.create(p, False)
            out.write(bytearray(data))
            out.close()  # a conditional put is decided here
        except Exception as e:
            if fs.exists(p):
                raise AlreadyExists(path) from e
            raise

    def exclusive(self, path: str) -> bool:
        """Whether ``create`` lets exactly one of several writers succeed there."""
        scheme = urlparse(path).scheme
        if self.single_writer or scheme not in ("s3", "s3a", "s3n"):
            return True
        p, fs = self._fs(path)
        return fs.hasPathCapability(p, _CONDITIONAL)

    def replace(self, path: str, data: bytes) -> None:
        if (own := self.local(path)) is not None:
            os.makedirs(os.path.dirname(own), exist_ok=True)
            tmp = f"{os.path.dirname(own)}/.{uuid.uuid4().hex}"
            with open(tmp, "wb") as f:
                f.write(data)
            os.replace(tmp, own)
            return
        p, fs = self._fs(path)
        out = fs.create(p, True)
        out.write(bytearray(data))
        out.close()

    def list(self, path: str) -> list[tuple[str, int, bool]]:
        """(path, length, is folder) of what lies directly in ``path``, sorted; nothing if it isn't there."""
        p, fs = self._fs(path)
        if not fs.exists(p):
            return []
        return sorted((s.getPath().toString(), s.getLen(), s.isDirectory()) for s in fs.listStatus(p))

    def delete(self, path: str) -> None:
        p, fs = self._fs(path)
        fs.delete(p, True)
