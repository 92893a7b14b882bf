"""Graphs of named nodes and edges: a script of commands becomes node specs, which bind to DataFrames in topological order.

Nothing runs until an edge's DataFrame is used: the whole graph is one plan for Catalyst.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.operators.statistics import history

#: Frames of a node's edges in order; None for one that has no stream.
Operator = Callable[[list[DataFrame], dict[str, Any]], list[DataFrame | None]]
REGISTRY: dict[str, Operator] = {}
ALIASES = {"fake_video_format": "assume_video_format", "fake_audio_metadata": "assume_audio_format"}


def register_node(*names: str) -> Callable[[Operator], Operator]:
    """Registers an operator under type names."""

    def add(f: Operator) -> Operator:
        for n in names:
            REGISTRY[n] = f
        return f

    return add


@dataclass
class NodeSpec:
    name: str
    type: str
    src: list[str]
    dst: list[str]
    group: str = "default"
    params: dict[str, Any] = field(default_factory=dict)
    optional: bool = False


def parse_node(text: str, number: int) -> NodeSpec:
    """A node from its JSON object; `type<kind>` names the kind of items, which Spark's schemas already tell.

    The edges of a demux are the values of its routing; a sink, which writes to no edge, gives its rows under its own name.
    """
    spec = json.loads(text)
    if "type" not in spec:
        raise ValueError("a node needs a type")
    many = lambda v: [] if v is None else list(v.values()) if isinstance(v, dict) else [v] if isinstance(v, str) else list(v)
    kind = spec.pop("type").split("<")[0]
    kind = ALIASES.get(kind, kind)
    name, src, dst = spec.pop("name", f"node{number}"), many(spec.pop("src", None)), spec.pop("dst", None)
    if kind == "demux":
        if dst is not None and set(many(dst)) - set(spec["routing"].values()):
            raise ValueError(f"{name}: dst names queues that the routing doesn't")
        dst = spec["routing"]
    elif dst is None:
        dst = name
    return NodeSpec(name=name, type=kind, src=src, dst=many(dst), group=spec.pop("group", "default"), optional=bool(spec.pop("optional", False)), params=spec)


#: Commands that steer a running process. Nothing runs here before an edge's DataFrame is used, so that they have nothing to act on.
LIVE_ONLY = frozenset(
    "group.start group.restart group.retry_start group.stop node.start node.stop node.stop_wait node.auto_restart node.interrupt node.object.get queue.plan_capacity queue.drain queues.stats output.start output.stop hwaccel.init event.wait event.on.node.finished realtime.team.reset bye".split()
)


@dataclass
class Graph:
    nodes: dict[str, NodeSpec] = field(default_factory=dict)
    subscriptions: list[dict] = field(default_factory=list)

    def add(self, spec: NodeSpec) -> None:
        if spec.name in self.nodes:
            raise ValueError(f"node {spec.name!r} is there already")
        writers = {e for n in self.nodes.values() for e in n.dst}
        readers = {e for n in self.nodes.values() for e in n.src}
        if taken := writers.intersection(spec.dst) | readers.intersection(spec.src):
            raise ValueError(f"edges with two ends of a kind: {sorted(taken)}")
        self.nodes[spec.name] = spec

    def order(self) -> list[NodeSpec]:
        """Nodes after those that they read from; a cycle is an error."""
        writer = {e: n.name for n in self.nodes.values() for e in n.dst}
        try:
            names = list(TopologicalSorter({n.name: [writer[e] for e in n.src if e in writer] for n in self.nodes.values()}).static_order())
        except CycleError as e:
            raise ValueError(f"the graph has a cycle: {e.args[1]}") from None
        return [self.nodes[n] for n in names]

    def command(self, line: str) -> str | None:
        """Runs one command; what it says, if it says anything. An unknown one, or one that fails, raises a ValueError."""
        line = line.strip()
        if not line or line.startswith("#"):
            return None
        name, _, rest = line.partition(" ")
        while name in ("retry", "detach"):
            name, _, rest = rest.strip().partition(" ")
        try:
            if name in ("hello", "version"):
                return "rillframe"
            if name in ("node.add", "node.add_create", "node.add_start"):
                self.add(parse_node(rest, len(self.nodes)))
            elif name == "node.delete":
                del self.nodes[rest.strip()]
            elif name == "node.param.set":
                node, key, value = rest.split(" ", 2)
                self.nodes[node].params[key] = json.loads(value)
            elif name == "node.param.get":
                node, _, key = rest.strip().partition(" ")
                return json.dumps(self.nodes[node].params[key] if key else self.nodes[node].params)
            elif name == "stats.subscribe":
                self.subscriptions.append(json.loads(rest))
            elif name not in LIVE_ONLY:
                raise ValueError(f"unknown command {name}")
        except KeyError as e:
            raise ValueError(f"{name}: no {e}") from None
        return None

    def bind(self, sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """DataFrames of all edges, and of sinks by their names. sources: by the URL or name of input nodes. An optional node that can't bind is left out, and
        what reads from it alone with it."""
        edges: dict[str, DataFrame] = {}
        out_of: set[str] = set()
        for node in self.order():
            if node.type == "input":
                url = node.params.get("url", node.name)
                frames = [sources[url] if url in sources else sources[node.name]]
            else:
                lost = [e for e in node.src if e in out_of]
                if missing := [e for e in node.src if e not in edges and e not in out_of]:
                    raise ValueError(f"{node.name}: nothing writes {missing}")
                if lost and len(lost) == len(node.src) or node.optional and node.type not in REGISTRY:
                    out_of.update(node.dst)
                    continue
                if node.type not in REGISTRY:
                    raise ValueError(f"no node type {node.type!r}")
                frames = REGISTRY[node.type]([edges[e] for e in node.src if e in edges], node.params)
            if len(frames) == 1 and len(node.dst) != 1:
                frames = frames * len(node.dst)
            if len(frames) != len(node.dst):
                raise ValueError(f"{node.name}: {len(node.dst)} edges for {len(frames)} outputs")
            edges |= {e: f for e, f in zip(node.dst, frames, strict=True) if f is not None}
            out_of |= {e for e, f in zip(node.dst, frames, strict=True) if f is None}
        return edges

    def statistics(self, edges: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """For each stats.subscribe by name: rows (media, edge, stream_id, seq, frame_num, kbitrate, fps, duration_us) of the packets that its streams name.

        An interval of history is `max_age` seconds, 30 unless given.
        """
        out: dict[str, DataFrame] = {}
        for number, spec in enumerate(self.subscriptions):
            parts = [
                history(edges[one["q_pre_dec"]], round(float(spec.get("max_age", 30)) * 1_000_000), 1_000_000).select(F.lit(media).alias("media"), F.lit(one["q_pre_dec"]).alias("edge"), "stream_id", "seq", "frame_num", "kbitrate", "fps", "duration_us")
                for media, streams in spec.get("streams", {}).items()
                for one in streams
                if one.get("q_pre_dec") in edges
            ]
            if parts:
                out[spec.get("name") or f"stats{number}"] = reduce(DataFrame.unionByName, parts)
        return out


def script(text: str) -> Graph:
    """A graph from a script, one command a line; the first that fails ends it."""
    graph = Graph()
    for number, line in enumerate(text.splitlines(), 1):
        try:
            graph.command(line)
        except ValueError as e:
            raise ValueError(f"line {number}: {e}") from None
    return graph
