"""Run configuration: INI files and command lines, typed; values are parsed, never evaluated."""

from __future__ import annotations

import configparser
import warnings
from dataclasses import dataclass, fields

PARTITIONS = ("robin", "random", "greedy", "label_propagation", "cyclic")
APPROACHES = ("random_walk", "naive", "partition")


@dataclass
class Config:
    """What a run needs. A graph file goes before nodes and edges; without edges a tree is generated."""

    algo: str = "bfs"
    graphfile: str | None = None
    nodes: int | None = None
    edges: int | None = None
    approach: str = "random_walk"
    digraph: bool = False
    connect: str = "none"
    partition: str = "robin"
    num_pe: int = 8
    num_fpga: int = 1
    architecture: str = "push"
    root: int | None = None
    rounds: int = 30
    init_sum: str = "spec"
    seed: int = 42
    save_graph: str | None = None
    console_log_level: str = "INFO"
    file_log_level: str = "DEBUG"
    log_file_name: str = "tidegraph"
    disable_logfile: bool = False

    def __post_init__(self) -> None:
        self.architecture = {"S": "push", "M": "pull"}.get(self.architecture, self.architecture)
        if self.partition == "metis":
            warnings.warn("there is no external partitioner here; label_propagation stands in", stacklevel=2)
            self.partition = "label_propagation"
        for name, known in (("architecture", ("push", "pull")), ("partition", PARTITIONS), ("approach", APPROACHES), ("connect", ("none", "star", "clique")), ("init_sum", ("spec", "py", "cpp"))):
            if getattr(self, name) not in known:
                raise ValueError(f"unknown {name}: {getattr(self, name)!r}")
        if self.num_pe < 1 or self.num_fpga < 1 or self.num_pe % self.num_fpga:
            raise ValueError("num_pe has to be a multiple of num_fpga")
        if self.graphfile is None and self.nodes and self.edges is None:
            self.edges = self.nodes - 1

    @property
    def parts_per_node(self) -> int:
        return self.num_pe // self.num_fpga


def _value(text: str, kind: str):
    if "bool" in kind:
        if text.strip().lower() in ("1", "yes", "true", "on"):
            return True
        if text.strip().lower() in ("0", "no", "false", "off", ""):
            return False
        raise ValueError(f"not a boolean: {text!r}")
    return int(text) if "int" in kind else text.strip()


def from_ini(text: str, **overrides) -> Config:
    """A configuration from INI text (sections arch, graph, app, logging); overrides that aren't None go before it.

    Several pull-mode machines are the default architecture where num_fpga is over 1. Keys of other tools are ignored.
    """
    parser = configparser.ConfigParser()
    parser.read_string(text)
    found = {key: value for section in parser.sections() for key, value in parser[section].items()}
    if "inverted" in found:
        found["architecture"] = "pull" if _value(found["inverted"], "bool") else "push"
    kinds = {f.name: str(f.type) for f in fields(Config)}
    values = {k: _value(v, kinds[k]) for k, v in found.items() if k in kinds}
    if "architecture" not in values and values.get("num_fpga", 1) > 1:
        values["architecture"] = "pull"
    return Config(**{**values, **{k: v for k, v in overrides.items() if v is not None}})


def read_config(path: str, **overrides) -> Config:
    with open(path, encoding="utf-8") as f:
        return from_ini(f.read(), **overrides)
