"""Registered projects, settings and schedule states: small JSON files, replaced whole."""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lodestone.functions.text import parse_duration


class RegistryError(ValueError):
    """A project or setting that isn't there, or a file that can't be read."""


def write_json(path: str | Path, data: object, mode: int = 0o644) -> None:
    """Write beside path and rename over it: readers see all of the old file or all of the new."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(data, f, indent=2, sort_keys=True)
            f.write("\n")
        os.chmod(name, mode)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def read_json(path: str | Path, default: object) -> object:
    """The file's data; default only if there is no file."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        return default
    except ValueError as e:
        raise RegistryError(f"{path}: {e}") from e


class Projects:
    """name, root, updated_at and every of each project."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def all(self) -> list[dict]:
        return list(read_json(self.path, []))

    def add(self, root: str, name: str | None = None) -> dict:
        root = str(Path(root).resolve())
        rows = [p for p in self.all() if p["root"] != root]
        base = re.sub(r"[^a-z0-9_.-]+", "-", (name or Path(root).name).lower()).strip("-") or "project"
        taken, unique, n = {p["name"] for p in rows}, base, 2
        while unique in taken:
            unique, n = f"{base}-{n}", n + 1
        row = {"name": unique, "root": root, "updated_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "every": None}
        write_json(self.path, sorted([*rows, row], key=lambda p: p["name"]))
        return row

    def find(self, name_or_root: str) -> dict:
        for p in self.all():
            if name_or_root in (p["name"], p["root"]):
                return p
        raise RegistryError(f"unknown project: {name_or_root}; known: {', '.join(p['name'] for p in self.all()) or 'none'}")

    def set_every(self, name: str, every: str | None) -> None:
        if every and every != "off":
            parse_duration(every)
        self.find(name)
        write_json(self.path, [p | {"every": every} if p["name"] == name else p for p in self.all()])

    def remove(self, name_or_root: str) -> dict:
        gone = self.find(name_or_root)
        write_json(self.path, [p for p in self.all() if p["name"] != gone["name"]])
        return gone

    def living(self) -> list[dict]:
        return [p for p in self.all() if Path(p["root"]).is_dir()]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(p["name"], p["root"], p["updated_at"], p["every"]) for p in self.all()]
        return spark.createDataFrame(rows, "name string, root string, updated_at string, every string")


class Settings:
    """Keyed values: an environment variable wins over the file, the file over the default. The file is the owner's only."""

    def __init__(self, path: str | Path, known: dict[str, tuple[str | None, str | None, Callable[[str], object] | None]]):
        self.path, self.known = Path(path), known

    def _spec(self, key: str):
        if key not in self.known:
            raise RegistryError(f"unknown setting: {key}; known: {', '.join(sorted(self.known))}")
        return self.known[key]

    def get(self, key: str, environ: dict | None = None) -> tuple[str | None, str]:
        """(value, where it is from)."""
        variable, default, _ = self._spec(key)
        environ = os.environ if environ is None else environ
        if variable and environ.get(variable):
            return environ[variable], "environment"
        stored = read_json(self.path, {}).get(key)
        return (stored, "file") if stored is not None else (default, "default")

    def put(self, key: str, value: str) -> None:
        check = self._spec(key)[2]
        if check:
            check(value)
        write_json(self.path, read_json(self.path, {}) | {key: value}, 0o600)

    def drop(self, key: str) -> None:
        self._spec(key)
        write_json(self.path, {k: v for k, v in read_json(self.path, {}).items() if k != key}, 0o600)


def resolve_every(override: str | None, project: str | None, default: str | None) -> tuple[float | None, str]:
    """(seconds, where from) of the first setting that is there; off is none."""
    for value, source in ((override, "override"), (project, "project"), (default, "global")):
        if value and value.strip():
            return (None if value.strip().lower() == "off" else parse_duration(value)), source
    return None, "none"
