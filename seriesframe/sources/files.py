"""Small files and locks beside the data, through Hadoop's file systems: local paths, HDFS and object stores alike."""

from __future__ import annotations

import fcntl
import os
import uuid

from pyspark.sql import SparkSession

from seriesframe.errors import StoreError, WriterBusy


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def local_root(self) -> str | None:
        uri = self._fs.makeQualified(self._path("")).toUri()
        return uri.getPath() if uri.getScheme() == "file" else None

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def sizes(self, folder: str) -> dict[str, int]:
        """Bytes of each data file under a folder."""
        out: dict[str, int] = {}
        if not self.exists(folder):
            return out
        for s in self._fs.listStatus(self._path(folder)):
            name = s.getPath().getName()
            if s.isDirectory():
                out |= {f"{name}/{k}": v for k, v in self.sizes(f"{folder}/{name}" if folder else name).items()}
            elif not name.startswith((".", "_")):
                out[name] = s.getLen()
        return out

    def read(self, name: str) -> bytes:
        stream = None
        try:
            stream = self._fs.open(self._path(name))
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        except Exception as e:
            raise StoreError(f"{name} can't be read: {type(e).__name__}") from e
        finally:
            if stream is not None:
                stream.close()

    def write(self, name: str, data: bytes, *, sync: bool = False, new: bool = False) -> None:
        """Write under another name, then rename: readers see all of it or nothing.  With new, an existing file is an error."""
        beside = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self._fs.create(self._path(beside), True)
        out.write(bytearray(data))
        if sync:
            out.hsync()
        out.close()
        if not new:
            local = self.local_root()
            if local is not None:
                os.replace(f"{local}/{beside}", f"{local}/{name}")
                self._drop_crc(local, beside, name)
                if sync:
                    self._sync_folder(f"{local}/{name}")
                return
            self._fs.delete(self._path(name), False)
        elif self.exists(name):
            self._fs.delete(self._path(beside), False)
            raise WriterBusy(f"{name} is there already")
        if not self._fs.rename(self._path(beside), self._path(name)):
            raise WriterBusy(f"{name} is there already")
        if sync and self.local_root() is not None:
            self._sync_folder(f"{self.local_root()}/{name}")

    @staticmethod
    def _drop_crc(local: str, beside: str, name: str) -> None:
        for n in (beside, name):
            folder, base = os.path.split(f"{local}/{n}")
            if os.path.exists(crc := f"{folder}/.{base}.crc"):
                os.remove(crc)

    @staticmethod
    def _sync_folder(path: str) -> None:
        fd = os.open(os.path.dirname(path), os.O_RDONLY)
        try:
            os.fsync(fd)
        finally:
            os.close(fd)

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


class Lock:
    """One writer at a time: an advisory lock on local paths, elsewhere a lease file that only its owner removes."""

    def __init__(self, files: Files):
        self.files, self._fd = files, None
        local = files.local_root()
        if local is not None:
            self._fd = os.open(f"{local}/_lock", os.O_RDWR | os.O_CREAT)
            try:
                fcntl.flock(self._fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as e:
                os.close(self._fd)
                self._fd = None
                raise WriterBusy("another writer holds the store") from e
        else:
            files.write("_lock", uuid.uuid4().hex.encode(), new=True)

    def release(self) -> None:
        if self._fd is not None:
            os.close(self._fd)
            self._fd = None
        elif self.files.local_root() is None:
            self.files.delete("_lock")
