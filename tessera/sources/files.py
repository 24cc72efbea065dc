"""JSON-lines journals, memo tables, projections and manifests on any Hadoop file system."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def age(spark: SparkSession, path: str) -> float:
    """Seconds since a path was changed."""
    fs, p = _fs(spark, path)
    return time.time() - fs.getFileStatus(p).getModificationTime() / 1000


def recover(spark: SparkSession, path: str) -> None:
    """Bring back a folder whose replacement ended between its two renames."""
    old = f"{path.rstrip('/')}.old"
    if not exists(spark, path) and exists(spark, old):
        _rename(spark, old, path)


def _rename(spark: SparkSession, a: str, b: str) -> None:
    fs, p = _fs(spark, a)
    if not fs.rename(p, _fs(spark, b)[1]):
        raise OSError(f"{a} could not be renamed to {b}")


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Put what ``write(folder)`` writes in the place of ``path``.

    The new rows are whole before the old ones are touched; the old ones are renamed, never deleted first, and a run that ends
    between the two renames is set right by the next reader or writer (``recover``).
    """
    at = path.rstrip("/")
    recover(spark, at)
    new, old = f"{at}.new-{uuid.uuid4().hex}", f"{at}.old"
    try:
        write(new)
    except BaseException:
        remove(spark, new)
        raise
    if exists(spark, at):
        remove(spark, old)
        _rename(spark, at, old)
    _rename(spark, new, at)
    remove(spark, old)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A journal with its declared schema: a missing path is empty, blank lines are skipped, a bad line raises.

    Of a journal with commits (``sources.commits``), the files of the newest one.
    """
    from tessera.sources import commits

    recover(spark, path)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    listed = commits.committed(spark, path)
    if listed is not None:
        return commits.read_listed(spark, path.rstrip("/"), listed, schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Append a batch of rows, nulls kept; nothing is written for no rows."""
    if not rows.isEmpty():
        rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_jsonl(rows: DataFrame, path: str, *, sorted_keys: bool = False) -> None:
    """Replace a JSON-lines dataset whole or not at all: a write that fails leaves the old rows."""
    if sorted_keys:
        rows = rows.select(*sorted(rows.columns))
    replace_folder(rows.sparkSession, path, lambda at: rows.write.option("ignoreNullFields", "false").json(at))


def read_memo(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of a memo, of a store (``sources.memo``) or of plain JSON lines."""
    from tessera.sources import memo

    return memo.MemoStore(spark, path).read() if memo.is_store(spark, path) else read_jsonl(spark, path, schema)


def append_memo(memo: DataFrame, rows: DataFrame, path: str) -> None:
    """Append judgments to plain JSON lines, with a write sequence that goes on from the memo's last."""
    last = memo.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("m")).first().m
    append_jsonl(rows.withColumn("seq", F.lit(int(last) + 1).cast("long")), path)


def guard_path(path: str) -> str:
    """Refuse to replace the root, the home folder or the working folder."""
    plain = path.removeprefix("file:")
    if "://" not in plain:
        at = Path("/" + plain.lstrip("/") if path.startswith("file:") else plain).expanduser().resolve()
        if at in {Path(at.anchor), Path.home().resolve(), Path.cwd().resolve()}:
            raise ValueError(f"refusing to replace {at}")
    return path


def save_projection(table: DataFrame, path: str, expected: Mapping[str, int]) -> DataFrame:
    """Check sizes, replace ``path`` with Parquet partitioned by split, read it back and check again."""
    from tessera.operators.project import wrong_sizes

    if wrong := wrong_sizes(table, expected):
        raise RuntimeError(f"split sizes differ from what is expected: {wrong}")
    replace_folder(table.sparkSession, guard_path(path), lambda at: table.write.partitionBy("split").parquet(at))
    back = table.sparkSession.read.schema(table.schema).parquet(path)
    if wrong := wrong_sizes(back, expected):
        raise RuntimeError(f"the written projection has other sizes: {wrong}")
    return back


def save_split_files(table: DataFrame, folder: str, prefix: str) -> list[str]:
    """One Parquet dataset ``{prefix}_{split}.parquet`` per split, for readers that want them apart."""
    paths = []
    for split in sorted(r[0] for r in table.select("split").distinct().collect()):
        paths.append(f"{folder}/{prefix}_{split}.parquet")
        part = table.where(F.col("split") == split).drop("split")
        replace_folder(table.sparkSession, guard_path(paths[-1]), part.write.parquet)
    return paths


def load_training(spark: SparkSession, path: str) -> DataFrame:
    """A training dataset with a ``split`` column; anything else is an error."""
    recover(spark, path)
    table = spark.read.parquet(path)
    if "split" not in table.columns:
        raise TypeError(f"{path} has no splits")
    return table


def jsonable(value: Any) -> Any:
    if isinstance(value, Mapping):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [jsonable(v) for v in value]
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    return jsonable(value.item()) if hasattr(value, "item") else str(value)


def write_json(spark: SparkSession, path: str, payload: Mapping[str, Any]) -> None:
    """Pretty JSON with sorted keys, put in place by a rename."""
    _put(spark, path, json.dumps(jsonable(payload), indent=2, sort_keys=True) + "\n")


def _write_beside(spark: SparkSession, path: str, text: str) -> str:
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, p = _fs(spark, tmp)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()
    return tmp


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Put a file in place of what is there, by one rename: a reader sees the old text or the new one."""
    tmp = _write_beside(spark, path, text)
    jvm, (fs, src), dst = spark.sparkContext._jvm, _fs(spark, tmp), _fs(spark, path)[1]
    if fs.getScheme() == "file":
        over = spark.sparkContext._gateway.new_array(jvm.java.nio.file.CopyOption, 1)
        over[0] = jvm.java.nio.file.StandardCopyOption.ATOMIC_MOVE
        jvm.java.nio.file.Files.move(_local(jvm, fs, src), _local(jvm, fs, dst), over)
        _drop_checksums(jvm, fs, src, dst)
        return
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(src.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    context.rename(fs.makeQualified(src), fs.makeQualified(dst), over)


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Put a file in place, whole, only where none is; False where there is one."""
    tmp = _write_beside(spark, path, text)
    jvm, (fs, src), dst = spark.sparkContext._jvm, _fs(spark, tmp), _fs(spark, path)[1]
    try:
        if fs.getScheme() == "file":
            # a rename would replace a file here; a link does not
            jvm.java.nio.file.Files.createLink(_local(jvm, fs, dst), _local(jvm, fs, src))
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(src.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(fs.makeQualified(src), fs.makeQualified(dst), none)
    except Py4JJavaError as error:
        if not fs.exists(dst):
            raise OSError(f"{path} could not be written") from error
        return False
    finally:
        fs.delete(src, False)
    return True


def _local(jvm, fs, p):
    return jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath()


def _drop_checksums(jvm, fs, *paths) -> None:
    """Checksum files that a local file system keeps beside files, of files that were moved past it."""
    for p in paths:
        at = _local(jvm, fs, p)
        jvm.java.nio.file.Files.deleteIfExists(at.resolveSibling(f".{p.getName()}.crc"))


def read_json(spark: SparkSession, path: str) -> dict[str, Any]:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def write_json_lines(spark: SparkSession, path: str, rows: Iterable[Mapping[str, Any]]) -> None:
    """One file of JSON lines for logs of the driver: sorted keys, ASCII escapes, values coerced as in ``jsonable``, put in place by a rename."""
    _put(spark, path, "".join(json.dumps(jsonable(row), sort_keys=True) + "\n" for row in rows))


def children(spark: SparkSession, folder: str) -> list[str]:
    """Paths in a folder, by name; none where it does not exist."""
    fs, p = _fs(spark, folder)
    return sorted(s.getPath().toString() for s in fs.listStatus(p)) if fs.exists(p) else []


def compact_jsonl(spark: SparkSession, path: str, schema: T.StructType, most: int = 200, rows_a_file: int = 50_000) -> None:
    """Rewrite a plain journal of more than ``most`` files as few; the old one stays until the new one is whole."""
    recover(spark, path)
    if len(children(spark, path)) <= most:
        return
    rows = read_jsonl(spark, path, schema)
    few = rows.repartition(max(1, -(-rows.count() // rows_a_file)))
    replace_folder(spark, path, lambda at: few.write.option("ignoreNullFields", "false").json(at))


@contextmanager
def single_writer(spark: SparkSession, path: str):
    """Hold ``path`` for one process; a second one fails until the first has ended (or its lock file is removed by hand)."""
    fs, p = _fs(spark, f"{path.rstrip('/')}.lock")
    try:
        fs.create(p, False).close()
    except Py4JJavaError as error:
        raise RuntimeError(f"{path} has a writer already; remove {p.toString()} if it is gone") from error
    try:
        yield
    finally:
        fs.delete(p, False)


def latest_checkpoint(spark: SparkSession, folder: str, *, strict: bool = False) -> str | None:
    """The folder ``checkpoint-N`` with the largest number; other names and plain files do not count, or are an error if ``strict``."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return None
    found = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if strict and name.startswith("checkpoint-") and not name[11:].isdigit():
            raise ValueError(f"{name} has no number")
        if s.isDirectory() and name.startswith("checkpoint-") and name[11:].isdigit():
            found.append((int(name[11:]), s.getPath().toString()))
    return max(found)[1] if found else None


def resolve_resume(spark: SparkSession, folder: str, resume: str) -> str | None:
    word = resume.strip().lower()
    if word in ("none", "false", "no"):
        return None
    if word == "auto":
        return latest_checkpoint(spark, folder)
    if not exists(spark, resume):
        raise FileNotFoundError(f"no checkpoint at {resume}")
    return resume


_LOCAL: dict[str, str] = {}  # application -> its folder, where the session names none
_LEAVING: set[str] = set()  # folders that go when the driver ends


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a local one, the same for all calls of an
    application, only on a single machine that names none."""
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if not named and app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tessera-")
    return (named or _LOCAL[app]).rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path for a table between two steps, in the shared folder, below this application's own, which goes when its driver ends."""
    folder = f"{shared_folder(spark)}/tessera-steps/{spark.sparkContext.applicationId}"
    if folder not in _LEAVING:
        fs, p = _fs(spark, folder)
        fs.deleteOnExit(p)
        _LEAVING.add(folder)
    return f"{folder}/{kind}-{uuid.uuid4().hex}"


def written(table: DataFrame, kind: str = "step") -> DataFrame:
    """``table`` as it lies in storage: written once, read back, its lineage cut; it survives the loss of executors."""
    path = scratch(table.sparkSession, kind)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)
