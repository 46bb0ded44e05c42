"""A geocoding server behind JSON-RPC 2.0 as a connector: rows stream by, and each task asks the server for its own."""

from __future__ import annotations

import json
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..errors import RemoteError
from ..functions.matching import Settings

# Methods of the server; {} is its namespace.
METHODS = {
    "search": "{}.searchNode",
    "reverse": "{}.reverse",
    "signature": "{}.server_signature",
    "version": "{}.installed_dictionary_version",
    "readme": "{}.installed_dictionary_readme",
    "node": "node.get_record",
    "count": "node.count_records",
    "nodes_on": "node.search_records_on",
    "registry": "aza_master.search_by_codes",
    "dataset": "dataset.get",
    "datasets": "dataset.get_all",
}
_NODE = "node_id bigint, name string, x double, y double, level int, priority int, note string, parent_id bigint, sibling_id bigint"


def call(url: str, method: str, params, timeout: float = 30.0):
    """The result of one call."""
    body = json.dumps({"jsonrpc": "2.0", "method": method, "params": params, "id": str(uuid.uuid4())}).encode()
    with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as r:
        answer = json.load(r)
    if "error" in answer:
        raise RemoteError(answer["error"])
    return answer["result"]


class Session:
    """A server with the answers to the last texts, nodes and codes; they are dropped when its signature changes."""

    def __init__(self, url: str, namespace: str, cached: int = 512):
        self.url, self.namespace, self.cached = url, namespace, cached
        self.seen: str | None = None
        self.known: dict[str, object] = {}

    def call(self, name: str, params):
        return call(self.url, METHODS[name].format(self.namespace), params)

    def signature(self) -> str:
        """The server's signature; a new one means another dictionary or a restart, and empties the cache."""
        now = self.call("signature", [])
        if not isinstance(now, str):
            raise RemoteError("the server's signature is no text")
        if now != self.seen:
            self.known.clear()
            self.seen = now
        return now

    def ask(self, name: str, params):
        """A call whose answer is kept."""
        key = json.dumps([name, params], sort_keys=True)
        if key not in self.known:
            if len(self.known) >= self.cached:
                self.known.pop(next(iter(self.known)))
            self.known[key] = self.call(name, params)
        return self.known[key]

    def node(self, node_id: int) -> dict:
        if node_id < 0:
            raise RemoteError("the server does not go through its tree")
        return self.ask("node", {"pos": node_id, "server": self.seen})

    def nodes_on(self, attribute: str, value: str, how: str = "get") -> list[dict]:
        """Nodes by an indexed attribute: get, those with the value; prefixes, those that begin it; keys, those it begins."""
        if how not in ("get", "prefixes", "keys"):
            raise RemoteError(f"no such search: {how}")
        return self.ask("nodes_on", {"attr": attribute, "value": value, "funcname": how, "server": self.seen})

    def count(self) -> int:
        return self.call("count", [])

    def datasets(self) -> dict[int, dict]:
        """The data sets by number; the server's keys are text."""
        return {d["id"]: d for d in self.ask("datasets", []).values()}

    def registry(self, code: str) -> dict:
        return self.ask("registry", {"code": code})

    def version(self) -> str:
        return self.call("version", [])

    def readme(self) -> str:
        return self.call("readme", [])


def _asked(rows: DataFrame, url: str, namespace: str, cached: int, answer: Callable, schema: str) -> DataFrame:
    """What answer makes of each row, with a session for each task, whose signature is asked for at every batch."""
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session = Session(url, namespace, cached)
        for b in batches:
            session.signature()
            yield pd.DataFrame([made for row in b.itertuples(index=False) for made in answer(session, row)], columns=names)

    return rows.mapInPandas(run, schema)


def geocode_remote(queries: DataFrame, url: str, namespace: str, settings: Settings | None = None, cached: int = 512) -> DataFrame:
    """queries (qid, query) with the server's answers: qid, rank, node_id, matched, name, x, y, level."""
    config = asdict(settings or Settings()) | {"target_area": list((settings or Settings()).target_area)}

    def answer(session: Session, row):
        for rank, r in enumerate(session.ask("search", {"query": row.query or "", "config": config}), 1):
            n = r["node"]
            yield row.qid, rank, n["id"], r["matched"], n["name"], float(n["x"]), float(n["y"]), n["level"]

    return _asked(queries.select("qid", "query"), url, namespace, cached, answer, "qid bigint, rank int, node_id bigint, matched string, name string, x double, y double, level int")


def reverse_remote(points: DataFrame, url: str, namespace: str, level: int = 6, cached: int = 512) -> DataFrame:
    """points (qid, x, y) with the server's up to three answers: qid, rank, node_id, fullname, dist."""

    def answer(session: Session, row):
        if row.x == row.x and row.y == row.y and row.x is not None and row.y is not None:
            for rank, r in enumerate(session.ask("reverse", {"x": row.x, "y": row.y, "level": level}), 1):
                c = r["candidate"]
                yield row.qid, rank, c["id"], "/".join(c.get("fullname") or [c["name"]]), float(r["dist"])

    return _asked(points.select("qid", "x", "y"), url, namespace, cached, answer, "qid bigint, rank int, node_id bigint, fullname string, dist double")


def nodes_by_code_remote(codes: DataFrame, url: str, namespace: str, category: str, cached: int = 512) -> DataFrame:
    """codes (code) with the nodes whose note has category:code: code, and the node's fields."""

    def answer(session: Session, row):
        for n in session.nodes_on("note", f"{category}:{row.code}"):
            yield row.code, n["id"], n["name"], float(n["x"]), float(n["y"]), n["level"], n["priority"], n["note"], n["parentId"], n["siblingId"]

    return _asked(codes.select("code"), url, namespace, cached, answer, f"code string, {_NODE}")


def datasets_remote(spark: SparkSession, url: str, namespace: str) -> DataFrame:
    """id, title, url of the data sets: some dozens."""
    rows = [(d["id"], d.get("title"), d.get("url")) for d in Session(url, namespace).datasets().values()]
    return spark.createDataFrame(rows, "id int, title string, url string")


def signature(url: str, namespace: str) -> str:
    return Session(url, namespace).signature()
