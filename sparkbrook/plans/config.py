"""Configuration: the engine's, and that of an operator (a plugin instance), with strict keys, defaults and limits."""

from __future__ import annotations

import socket
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

KINDS = ("input", "analysis", "output")
MIB = 1 << 20
READ_QUEUES = ("both", "input", "analysis")


class ConfigError(ValueError):
    """A configuration that is refused, with the key at fault."""


@dataclass(frozen=True)
class OperatorDefaults:
    output_limit: int = 64 << 10
    memory_limit: int = 8 * MIB
    instruction_limit: int = 1_000_000
    ticker_interval: int = 0
    preserve_data: bool = False
    restricted_headers: bool = False
    shutdown_on_terminate: bool = False
    process_message_inject_limit: int = 0
    timer_event_inject_limit: int = 10
    remove_checkpoints_on_terminate: bool = False
    read_queue: str = "both"


@dataclass(frozen=True)
class OperatorSpec(OperatorDefaults):
    """An operator: its parameters, its matcher, and whatever else its code reads (``user``: strings, numbers, booleans, nested tables)."""

    kind: str = "analysis"
    name: str = ""
    filename: str = ""
    message_matcher: str | None = None
    thread: int | None = None
    async_buffer_size: int = 0
    user: Mapping[str, object] = field(default_factory=dict)

    def read_config(self, key: str) -> object:
        own = {f.name for f in fields(self)} - {"user"}
        return getattr(self, key) if key in own else self.user.get(key)


#: Keys that only one or two kinds of operators have.
ONLY = {
    "message_matcher": ("analysis", "output"), "thread": ("analysis",), "process_message_inject_limit": ("analysis",), "timer_event_inject_limit": ("analysis",),
    "async_buffer_size": ("output",), "remove_checkpoints_on_terminate": ("output",), "read_queue": ("output",),
}


@dataclass(frozen=True)
class EngineConfig:
    output_path: str
    sandbox_run_path: str
    io_lua_path: str
    io_lua_cpath: str
    analysis_lua_path: str
    analysis_lua_cpath: str
    output_size: int = 64 * MIB
    sandbox_load_path: str = ""
    sandbox_install_path: str = "/usr/share/sparkbrook/sandboxes"
    analysis_threads: int = 1
    analysis_utilization_limit: int = 95
    max_message_size: int = 64 << 10
    backpressure: int = 0
    backpressure_disk_free: int = 4
    hostname: str = ""
    input_defaults: OperatorDefaults = OperatorDefaults()
    analysis_defaults: OperatorDefaults = OperatorDefaults(restricted_headers=True)
    output_defaults: OperatorDefaults = OperatorDefaults()

    @staticmethod
    def from_dict(given: Mapping[str, object]) -> EngineConfig:
        known = {f.name for f in fields(EngineConfig)}
        if extra := set(given) - known:
            raise ConfigError(f"unknown keys: {', '.join(sorted(extra))}")
        for key in ("output_path", "sandbox_run_path", "io_lua_path", "io_lua_cpath", "analysis_lua_path", "analysis_lua_cpath"):
            if not isinstance(given.get(key), str):
                raise ConfigError(f"{key} must be a string")
        values = dict(given)
        for kind in KINDS:
            key = f"{kind}_defaults"
            base = OperatorDefaults(restricted_headers=kind == "analysis")
            values[key] = _defaults(base, given.get(key, {}), key)
        for f in fields(EngineConfig):
            if f.name in values and f.type in ("int", int):
                _whole(values[f.name], f.name)
        config = EngineConfig(**values)
        if config.max_message_size < 1024:
            raise ConfigError("max_message_size must be at least 1024")
        if not 1 <= config.analysis_threads <= 64:
            raise ConfigError("analysis_threads must be from 1 to 64")
        if not 0 <= config.analysis_utilization_limit <= 100:
            raise ConfigError("analysis_utilization_limit must be from 0 to 100")
        for kind in KINDS:
            if getattr(config, f"{kind}_defaults").output_limit > config.max_message_size:
                raise ConfigError(f"{kind}_defaults.output_limit is over max_message_size")
        return replace(config, hostname=(config.hostname or socket.gethostname())[:64])

    def defaults(self, kind: str) -> OperatorDefaults:
        return getattr(self, f"{kind}_defaults")


def _whole(value: object, key: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ConfigError(f"{key} must be a whole number of at least 0")
    return value


def _defaults(base: OperatorDefaults, given: object, key: str) -> OperatorDefaults:
    if not isinstance(given, Mapping):
        raise ConfigError(f"{key} must be a table")
    known = {f.name: f for f in fields(OperatorDefaults)}
    if extra := set(given) - set(known):
        raise ConfigError(f"unknown keys in {key}: {', '.join(sorted(extra))}")
    for name, value in given.items():
        if isinstance(getattr(base, name), bool):
            if not isinstance(value, bool):
                raise ConfigError(f"{key}.{name} must be a boolean")
        elif name == "read_queue":
            if value not in READ_QUEUES:
                raise ConfigError(f"{key}.read_queue must be both, input or analysis")
        else:
            _whole(value, f"{key}.{name}")
    return replace(base, **given)


def operator(config: EngineConfig, kind: str, cfg_file: str, given: Mapping[str, object]) -> OperatorSpec:
    """The operator of a configuration file, with the engine's defaults for its kind."""
    from ..functions.matcher import MatcherError, compile_matcher

    if kind not in KINDS:
        raise ConfigError(f"unknown kind {kind}")
    stem, dot, extension = cfg_file.rpartition(".")
    if not stem or extension != "cfg":
        raise ConfigError(f"{cfg_file} is not a .cfg file")
    own = {f.name for f in fields(OperatorSpec)} - {"kind", "name", "user"}
    known = {k: v for k, v in given.items() if k in own and kind in ONLY.get(k, KINDS)}
    user = {k: v for k, v in given.items() if k not in known}
    filename = known.get("filename")
    if not isinstance(filename, str) or "/" in filename or "\\" in filename or not filename.endswith(".lua") or len(filename) <= 4:
        raise ConfigError("filename must be a .lua file without a path")
    base = {f.name: getattr(config.defaults(kind), f.name) for f in fields(OperatorDefaults)}
    for key, value in known.items():
        if key in base and isinstance(base[key], bool):
            if not isinstance(value, bool):
                raise ConfigError(f"{key} must be a boolean")
        elif key in base and key != "read_queue" or key in ("async_buffer_size", "thread"):
            _whole(value, key)
    if kind != "input":
        if not isinstance(known.get("message_matcher"), str):
            raise ConfigError("message_matcher must be a string")
        try:
            compile_matcher(known["message_matcher"])
        except MatcherError as e:
            raise ConfigError(f"message_matcher: {e}") from e
    if known.get("read_queue", "both") not in READ_QUEUES:
        raise ConfigError("read_queue must be both, input or analysis")
    spec = OperatorSpec(**base | known, kind=kind, name=f"{kind}.{stem}", user=user)
    if spec.output_limit > config.max_message_size:
        raise ConfigError("output_limit is over max_message_size")
    return spec


def effective(spec: OperatorSpec) -> dict[str, object]:
    """What an operator runs with, for its run-time configuration file."""
    return {f.name: getattr(spec, f.name) for f in fields(spec) if f.name != "user"} | dict(spec.user)
