"""Named graphs in a folder, with one of them current."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import SparkSession

from .graph import Graph, empty_graph
from .schema import EdgeSpec, GraphSchema, NodeSpec


class CatalogError(ValueError):
    pass


class Catalog:
    """Graphs by name.  With a folder they are kept as Parquet beside catalog.json; all access is by Spark's file systems."""

    def __init__(self, spark: SparkSession, folder: str | None = None, graphs: dict[str, Graph] | None = None):
        self.spark, self.folder = spark, folder
        self.graphs: dict[str, Graph] = dict(graphs or {})
        self.current: str | None = next(iter(self.graphs), None)
        if folder:
            self._load()

    @property
    def graph(self) -> Graph:
        if self.current is None:
            raise CatalogError("no current graph")
        return self.graphs[self.current]

    def put(self, graph: Graph, name: str | None = None) -> None:
        """Replace a graph by its next version."""
        self.graphs[name or self.current] = graph

    def create(self, name: str, schema: GraphSchema, if_not_exists: bool = False) -> bool:
        if name in self.graphs:
            if if_not_exists:
                return False
            raise CatalogError(f"graph {name} exists")
        self.graphs[name] = empty_graph(self.spark, schema)
        self.current = self.current or name
        self.save()
        return True

    def drop(self, name: str, if_exists: bool = False) -> bool:
        if name not in self.graphs:
            if if_exists:
                return False
            raise CatalogError(f"no graph {name}")
        del self.graphs[name]
        if self.current == name:
            self.current = next(iter(self.graphs), None)
        self.save()
        return True

    def use(self, name: str) -> None:
        if name not in self.graphs:
            raise CatalogError(f"no graph {name}")
        self.current = name
        self.save()

    # -- storage --------------------------------------------------------------
    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def flush(self) -> None:
        """Write all graphs to new version folders, then the catalog that names them."""
        if not self.folder:
            return
        self._version = getattr(self, "_version", 0) + 1
        for name, g in self.graphs.items():
            g.write(f"{self.folder}/{name}/v{self._version}")
        self.save()

    def save(self) -> None:
        if not self.folder:
            return
        schemas = {k: asdict(g.schema) if g.schema else None for k, g in self.graphs.items()}
        text = json.dumps({"current": self.current, "version": getattr(self, "_version", 0), "graphs": schemas})
        path = self._path("catalog.json")
        out = self._fs(path).create(path, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _load(self) -> None:
        path = self._path("catalog.json")
        if not self._fs(path).exists(path):
            return
        held = json.loads(self.spark.read.text(f"{self.folder}/catalog.json", wholetext=True).first()[0])
        self._version = held["version"]
        for name, s in held["graphs"].items():
            schema = GraphSchema({k: NodeSpec(**v) for k, v in s["nodes"].items()}, {k: EdgeSpec(**v) for k, v in s["edges"].items()}) if s else None
            where = f"{name}/v{self._version}"
            self.graphs[name] = Graph.read(self.spark, f"{self.folder}/{where}", schema) if self._version and self._fs(self._path(where)).exists(self._path(where)) else empty_graph(self.spark, schema)
        self.current = held["current"]
