"""Scripts and functions: Python code over the rows of declared keys, registered by name or by digest."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Body = Callable[[pd.DataFrame, list[str]], pd.DataFrame]
FLAGS = {"no-writes", "allow-oom", "allow-stale", "no-cluster", "allow-cross-slot-keys"}


@dataclass
class Function:
    name: str
    source: str
    schema: str
    flags: list[str] = field(default_factory=list)


def _compile(source: str, name: str) -> Body:
    scope: dict = {"pd": pd}
    exec(source, scope)  # noqa: S102  scripts are the caller's own code
    return scope[name]


class Registry:
    """SCRIPT and FUNCTION: sources, kept by digest and by library; a load replaces a library whole or not at all."""

    def __init__(self) -> None:
        self.scripts: dict[str, Function] = {}
        self.libraries: dict[str, list[Function]] = {}

    def script_load(self, source: str | Body, schema: str, name: str = "script") -> str:
        text = source if isinstance(source, str) else inspect.getsource(source)
        name = name if isinstance(source, str) else source.__name__
        digest = hashlib.sha1(text.encode()).hexdigest()
        self.scripts[digest] = Function(name, text, schema)
        return digest

    def script_exists(self, *digests: str) -> list[int]:
        return [int(d.lower() in self.scripts) for d in digests]

    def script_flush(self) -> None:
        self.scripts = {}

    def function_load(self, library: str, functions: list[Function], replace: bool = False) -> str:
        if library in self.libraries and not replace:
            raise ValueError(f"Library '{library}' already exists")
        taken = {f.name for lib, fs in self.libraries.items() if lib != library for f in fs}
        for f in functions:
            if f.name in taken:
                raise ValueError(f"Function {f.name} already exists")
            if bad := set(f.flags) - FLAGS:
                raise ValueError(f"unknown flag given: {sorted(bad)[0]}")
            _compile(f.source, f.name)
        self.libraries = {**self.libraries, library: functions}
        return library

    def function_delete(self, library: str) -> None:
        if library not in self.libraries:
            raise ValueError("Library not found")
        self.libraries = {k: v for k, v in self.libraries.items() if k != library}

    def function_flush(self) -> None:
        self.libraries = {}

    def function_list(self, pattern: str = "*") -> list[tuple[str, list[str]]]:
        return [(k, [f.name for f in v]) for k, v in sorted(self.libraries.items()) if fnmatchcase(k, pattern)]

    def function_stats(self) -> dict[str, int]:
        """FUNCTION STATS: how many libraries and functions there are.  None runs outside of a query, so there is none to name."""
        return {"libraries": len(self.libraries), "functions": sum(map(len, self.libraries.values()))}

    def kill(self) -> None:
        """SCRIPT KILL, FUNCTION KILL: a script runs within a query, and ends with the query's own cancellation."""
        raise ValueError("NOTBUSY No scripts in execution right now.")

    def function_dump(self) -> str:
        return json.dumps({k: [vars(f) for f in v] for k, v in self.libraries.items()})

    def function_restore(self, payload: str, policy: str = "APPEND") -> None:
        new = {k: [Function(**f) for f in v] for k, v in json.loads(payload).items()}
        if policy == "FLUSH":
            self.libraries = new
            return
        if policy == "APPEND" and (both := set(new) & set(self.libraries)):
            raise ValueError(f"Library {sorted(both)[0]} already exists")
        self.libraries = {**self.libraries, **new}

    def _find(self, name: str) -> Function:
        for functions in self.libraries.values():
            for f in functions:
                if f.name == name:
                    return f
        raise ValueError("Function not found")

    def evalsha(self, digest: str, frame: DataFrame, keys: list | None = None, args: list[str] | None = None) -> DataFrame:
        """EVAL, EVALSHA and their read-only forms: the script on each declared key's rows, key by key on the executors."""
        if digest.lower() not in self.scripts:
            raise ValueError("NOSCRIPT No matching script.")
        return _apply(self.scripts[digest.lower()], frame, keys, args or [])

    def fcall(self, name: str, frame: DataFrame, keys: list | None = None, args: list[str] | None = None, read_only: bool = False) -> DataFrame:
        f = self._find(name)
        if read_only and "no-writes" not in f.flags:
            raise ValueError("Can not execute a script with write flag using *_ro command.")
        return _apply(f, frame, keys, args or [])


def _apply(f: Function, frame: DataFrame, keys: list | None, args: list[str]) -> DataFrame:
    rows = frame if keys is None else frame.where(F.col("key").isin(keys))
    source, name = f.source, f.name
    return rows.groupBy("key").applyInPandas(lambda pdf: _compile(source, name)(pdf, args), f.schema)
