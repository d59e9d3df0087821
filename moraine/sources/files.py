"""Small files through Hadoop's file system interface: any path that Spark can read works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which ``spark.checkpoint.dir`` names.  Only where
    that is unset (tests, notebooks) a temporary folder of this machine is taken."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="moraine-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf, self._gateway = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)
        self._local = self._fs.getScheme() == "file"
        if self._local:  # without checksum files, whose buffers a flush would not reach
            self._fs = self._fs.getRawFileSystem()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def make(self) -> None:
        self._fs.mkdirs(self._path(""))

    def names(self, folder: str = "") -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read_bytes(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def read(self, name: str) -> str:
        return self.read_bytes(name).decode()

    def create(self, name: str):
        """A stream to a new file; its ``hflush`` makes what was written visible to readers."""
        return self._fs.create(self._path(name), False)

    def publish(self, name: str, text: str) -> bool:
        """A new file with this content, which shows as a whole or not at all; false if another writer
        has the name.  Of racing writers one wins: a hard link (local files) and a rename that does
        not overwrite (HDFS) are atomic.  Object stores need a file system that renames so."""
        hidden = f".{name}.{self._jvm.java.util.UUID.randomUUID().toString()}"
        out = self.create(hidden)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if self._local:
                nio = lambda n: self._fs.pathToFile(self._path(n)).toPath()
                self._jvm.java.nio.file.Files.createLink(nio(name), nio(hidden))
            else:
                rename = self._jvm.org.apache.hadoop.fs.Options.Rename
                options = self._gateway.new_array(rename, 1)
                options[0] = rename.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf).rename(self._path(hidden), self._path(name), options)
            return True
        except Exception as error:
            if "AlreadyExists" in str(error):
                return False
            raise
        finally:
            if self._fs.exists(self._path(hidden)):
                self._fs.delete(self._path(hidden), False)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
