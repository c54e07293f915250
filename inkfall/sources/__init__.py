"""Where templates come from: a cached catalogue of files, or a table of sources."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession

from ..errors import IncludeNotFound
from ..plans.analysis import Unit
from ..template import Template, load_unit, source_hash


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Where it is unset a folder of this machine serves, but
    only if the executors are on it too."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "inkfall")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class TemplateCatalog:
    """``<name>.tmpl.md`` files of a directory, compiled once for as long as they don't change.

    An entry is looked up by path and environment; the file's time tells whether to look at its
    content, and the content's hash whether to compile again.  The least recently used entry goes first."""

    def __init__(self, directory: str, max_entries: int = 256, env: dict | None = None):
        self.directory, self.max_entries, self.env = directory, max_entries, env
        self._templates: OrderedDict = OrderedDict()
        self._units: OrderedDict = OrderedDict()

    @staticmethod
    def _env_key(env: dict | None) -> str:
        return hashlib.sha256(repr(sorted((env or {}).items())).encode()).hexdigest()

    def _cached(self, store: OrderedDict, path: str, env: dict | None, make):
        key = (os.path.realpath(path), self._env_key(env))
        if not os.path.exists(path):
            raise IncludeNotFound(path)
        changed = os.stat(path).st_mtime_ns
        held = store.get(key)
        if held:
            if held[0] == changed:
                store.move_to_end(key)
                return held[2]
            with open(path, encoding="utf-8") as f:
                content = source_hash(f.read())
            if held[1] == content:
                store[key] = (changed, content, held[2])
                store.move_to_end(key)
                return held[2]
        with open(path, encoding="utf-8") as f:
            content = source_hash(f.read())
        store[key] = (changed, content, make())
        store.move_to_end(key)
        while len(store) > self.max_entries:
            store.popitem(last=False)
        return store[key][2]

    def unit(self, path: str, env: dict | None) -> Unit:
        return self._cached(self._units, path, env, lambda: load_unit(path, env))

    def load(self, name: str, **how) -> Template:
        path = os.path.join(self.directory, f"{name}.tmpl.md")
        if how:
            return Template.from_file(path, **({"env": self.env, "load": self.unit} | how))
        return self._cached(self._templates, path, self.env, lambda: Template.from_file(path, env=self.env, load=self.unit))

    def clear(self) -> None:
        self._templates.clear()
        self._units.clear()

    @property
    def template_count(self) -> int:
        return len(self._templates)

    @property
    def include_count(self) -> int:
        return len(self._units)

    def names(self) -> list[str]:
        return sorted(f.removesuffix(".tmpl.md") for f in os.listdir(self.directory) if f.endswith(".tmpl.md"))


def template_folder(files: dict[str, str]) -> str:
    """A folder of the driver's own with these template files (name, text), which goes when the process ends."""
    folder = tempfile.mkdtemp(prefix="inkfall-templates-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    for name, text in files.items():
        with open(os.path.join(folder, f"{name}.tmpl.md"), "w", encoding="utf-8") as f:
            f.write(text)
    return folder


CATALOG = "name string, description string, source_hash string, params string, defaults string, consts string"


def catalog_df(spark: SparkSession, templates: dict[str, Template]) -> DataFrame:
    """A row of metadata for each template."""
    rows = [(n, t.description, t.source_hash, ", ".join(f"{p} = {k}" for p, k in t.declarations()), ", ".join(t.defaults()), ", ".join(t.consts())) for n, t in templates.items()]
    return spark.createDataFrame(rows, CATALOG)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """path, source of a folder of template files, for a corpus of templates."""
    from pyspark.sql import functions as F

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("source"))
