"""A running engine: plugins of a run folder as streaming queries, loaded at the start and on demand, ended with a record, stopped in order.

``<run>/<kind>/*.cfg`` (JSON) are the plugins that run; what appears in ``<load>/<kind>`` is taken at the next poll: ``x.cfg`` loads or reloads a plugin, ``x.off`` stops it, and a code
file (``x.lua``) restarts all that use it. Beside a plugin's file stand its effective configuration (``.rtc``) and, if it ended, its record (``.err``: time TAB error). All of this is
on the driver's machine; only the queries run on the cluster.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..streaming.delivery import stop
from .config import KINDS, ConfigError, EngineConfig, OperatorSpec, effective, operator
from .lifecycle import exit_code, load_request, shutdown_order

#: Code of a plugin: starts its query, with the folder for its checkpoints.
Code = Callable[[SparkSession, OperatorSpec, str], StreamingQuery]
LOG = logging.getLogger("sparkbrook.engine")


@dataclass
class Supervisor:
    spark: SparkSession
    config: EngineConfig
    run: Path
    load: Path
    checkpoints: Path
    #: Code by file name: what the run folder has goes before what is installed.
    own_code: dict[str, Code] = field(default_factory=dict)
    installed: Mapping[str, Code] = field(default_factory=dict)
    mode: str = "service"
    running: dict[str, tuple[OperatorSpec, StreamingQuery]] = field(default_factory=dict)
    failed: list[str] = field(default_factory=list)
    ending: bool = False

    def beside(self, name: str, extension: str) -> Path:
        kind, _, stem = name.partition(".")
        return self.run / kind / f"{stem}.{extension}"

    def checkpoint(self, name: str) -> Path:
        return self.checkpoints / name

    def start(self) -> None:
        """Old records go, and every plugin of the run folder starts."""
        for kind in KINDS:
            for folder in (self.run / kind, self.load / kind):
                folder.mkdir(parents=True, exist_ok=True)
            for old in (self.run / kind).glob("*.err"):
                old.unlink()
            for file in sorted((self.run / kind).glob("*.cfg")):
                self.begin(kind, file.name)

    def begin(self, kind: str, file: str) -> bool:
        """Start or replace the plugin of a configuration in the run folder; whether it runs. A plugin whose state can't be read loses it and is started once more."""
        name = f"{kind}.{file.removesuffix('.cfg')}"
        self.end(name)
        self.beside(name, "err").unlink(missing_ok=True)
        spec = None
        try:
            spec = operator(self.config, kind, file, json.loads((self.run / kind / file).read_text()))
            code = self.own_code.get(spec.filename) or self.installed.get(spec.filename)
            if code is None:
                raise ConfigError(f"no code file {spec.filename}")
            self.beside(name, "rtc").write_text(json.dumps(effective(spec), indent=1, sort_keys=True, default=str))
            try:
                query = code(self.spark, spec, str(self.checkpoint(name)))
            except Exception as e:  # noqa: BLE001 - whatever a damaged state raises
                if not self.checkpoint(name).exists():
                    raise
                LOG.warning("%s: %s; state removed", name, e)
                self.forget(name)
                query = code(self.spark, spec, str(self.checkpoint(name)))
        except Exception as e:  # noqa: BLE001 - a plugin's own fault ends the plugin, not the engine
            self.terminated(name, str(e), spec)
            return False
        self.running[name] = (spec, query)
        return True

    def forget(self, name: str) -> None:
        """Remove a plugin's checkpoints."""
        folder = self.checkpoint(name)
        if folder.exists():
            for x in sorted(folder.rglob("*"), reverse=True):
                x.unlink() if x.is_file() else x.rmdir()
            folder.rmdir()

    def end(self, name: str) -> None:
        """Stop a plugin's query, if it runs."""
        found = self.running.pop(name, None)
        if found is not None:
            stop(found[1])

    def terminated(self, name: str, error: str, spec: OperatorSpec | None) -> None:
        """A plugin ended for good: its record, its checkpoints if it says so, and the engine with it if it says so."""
        self.running.pop(name, None)
        self.failed.append(name)
        self.beside(name, "err").write_text(f"{time.strftime('%Y-%m-%dT%H:%M:%S', time.gmtime())}\t{error}\n")
        LOG.error("%s: terminated: %s", name, error)
        if spec is not None and spec.remove_checkpoints_on_terminate:
            self.forget(name)
        if spec is not None and spec.shutdown_on_terminate:
            self.ending = True

    def poll(self) -> bool:
        """Take what lies in the load folder and look after the queries; whether the engine goes on."""
        for kind in KINDS:
            for file in sorted((self.load / kind).iterdir()):
                change = load_request(file.name)
                if change.action == "load":
                    file.replace(self.run / kind / file.name)
                    if not self.begin(kind, file.name) and kind == "output":
                        self.forget(f"{kind}.{change.name}")
                elif change.action == "stop":
                    name = f"{kind}.{change.name}"
                    self.end(name)
                    if kind == "output":
                        self.forget(name)
                    for old in ("cfg", "rtc", "err"):
                        self.beside(name, old).unlink(missing_ok=True)
                    file.replace(self.beside(name, "off"))
                elif change.action == "restart":
                    file.replace(self.run / kind / file.name)
                    for name, (spec, _) in list(self.running.items()):
                        if spec.filename == change.name and spec.kind == kind:
                            self.begin(kind, f"{name.partition('.')[2]}.cfg")
        for name, (spec, query) in list(self.running.items()):
            if not query.isActive:
                problem = query.exception()
                if problem is not None:
                    self.terminated(name, str(problem).splitlines()[0], spec)
                elif self.mode != "service" or spec.ticker_interval == 0:
                    self.running.pop(name)  # it ran once
        return not self.ending

    def shutdown(self) -> int:
        """Stop all: a service at once, a batch run stage after stage, each having taken what the one before wrote. The exit code: a bit for each stage with a failed plugin."""
        for stage in shutdown_order(self.mode):
            names = [n for n, (spec, _) in self.running.items() if spec.kind in stage]
            for name in names:
                spec, query = self.running[name]
                try:
                    if self.mode != "service" and query.isActive:
                        query.processAllAvailable()
                    problem = query.exception()
                except Exception as e:  # noqa: BLE001
                    problem = e
                if problem is not None:
                    self.terminated(name, str(problem).splitlines()[0], spec)
                else:
                    self.end(name)
        return exit_code([n.partition(".")[0] for n in self.failed])

    def save(self) -> Path:
        """The checkpoint file: where each query's sources are, strings escaped, numbers with all their digits. It is written aside and renamed, so a reader never sees a part of it."""
        lines = []
        for name, (_, query) in sorted(self.running.items()):
            progress = query.lastProgress
            for k, source in enumerate((progress or {}).get("sources", [])):
                value = source.get("endOffset")
                text = "%.17g" % value if isinstance(value, (int, float)) else json.dumps(value if isinstance(value, str) else json.dumps(value))
                lines.append(f"_G[{json.dumps(name if not k else f'{name}#{k}')}] = {text}\n")
        self.checkpoints.mkdir(parents=True, exist_ok=True)
        file = self.checkpoints / "engine.cpt"
        aside = file.with_suffix(".tmp")
        aside.write_text("".join(lines))
        aside.replace(file)
        return file

    def serve(self, seconds: float | None = None, every: float = 1.0) -> int:
        """Poll and save once a second until a plugin or the time ends it; the exit code."""
        until = None if seconds is None else time.monotonic() + seconds
        while self.poll() and (until is None or time.monotonic() < until):
            self.save()
            time.sleep(every)
        return self.shutdown()
