"""Running plugins: hot loading, shutdown order, exit codes and termination records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXIT_BITS = {"input": 2, "analysis": 4, "output": 8}


def exit_codes(failures: DataFrame, run: str, stage: str) -> DataFrame:
    """(run, exit_code): a bit for each stage in which a plugin was terminated; ``stage`` is null where none was."""
    bit = F.lit(0)
    for name, value in EXIT_BITS.items():
        bit = F.when(F.col(stage) == name, value).otherwise(bit)
    return failures.groupBy(run).agg(F.sum_distinct(bit.cast("long")).alias("exit_code"))


def exit_code(stages: Sequence[str]) -> int:
    return sum(EXIT_BITS[s] for s in set(stages))


def shutdown_order(mode: str) -> list[list[str]]:
    """What stops together, in order: a service stops at once, a batch run lets each stage drain the one before."""
    return [["input", "analysis", "output"]] if mode == "service" else [["input"], ["analysis"], ["output"]]


def stop_timeouts() -> list[int]:
    """Seconds to wait for a thread after each request to stop."""
    return [10, 2, 2]


@dataclass
class Change:
    """What a file that appears in the load folder asks for."""

    action: str  # load, stop, restart or ignore
    name: str


def load_request(file: str) -> Change:
    """``.cfg`` loads a plugin, ``.off`` stops it, ``.lua`` restarts all that use it; other names, and bare extensions, are ignored."""
    stem, dot, extension = file.rpartition(".")
    if not stem or not dot:
        return Change("ignore", file)
    action = {"cfg": "load", "off": "stop", "lua": "restart"}.get(extension, "ignore")
    return Change(action, file if action == "restart" else stem)


@dataclass
class Registry:
    """Plugins by name; code is looked up in the run folder, then in the install folder."""

    run: dict[str, object] = field(default_factory=dict)
    installed: dict[str, object] = field(default_factory=dict)
    running: dict[str, object] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    checkpoints: dict[str, str] = field(default_factory=dict)

    def code(self, filename: str) -> object:
        if filename in self.run:
            return self.run[filename]
        if filename in self.installed:
            return self.installed[filename]
        raise KeyError(f"no code file {filename}")

    def load(self, name: str, spec: object) -> None:
        """Start or replace a plugin; an old termination record goes."""
        self.errors.pop(name, None)
        self.running[name] = spec

    def stop(self, name: str, keep_checkpoint: bool = False) -> None:
        """Stop a plugin; an output's checkpoints go, unless it is about to be reloaded."""
        self.running.pop(name, None)
        if name.startswith("output.") and not keep_checkpoint:
            for key in [k for k in self.checkpoints if k.endswith(f"->{name}")]:
                del self.checkpoints[key]

    def terminate(self, name: str, error: str, at: str, remove_checkpoints: bool = False) -> str:
        """End a plugin for good: its termination record, ``time TAB error``."""
        self.stop(name, keep_checkpoint=not remove_checkpoints)
        self.errors[name] = f"{at}\t{error}"
        return self.errors[name]

    def restart_users(self, filename: str, uses: Mapping[str, str]) -> list[str]:
        return [name for name in self.running if uses.get(name) == filename]
