"""Settings: a TOML file, overridden by the environment."""

from __future__ import annotations

import copy
import json
import os
import tomllib
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path

from gleanery.functions.metadata import LINK_SCHEME

PREFIX = "GLEANERY_"
TRUE = ("1", "true", "yes", "on")


@dataclass
class Embedder:
    model: str = ""
    base_url: str = ""
    api_key: str = ""
    dims: int = 0
    batch_size: int = 64
    threads: int = 2
    provider: str = ""

    @property
    def complete(self) -> bool:
        return bool(self.model and self.base_url)


@dataclass
class Search:
    backend: str = "fts"
    limit: int = 10
    max_chunks_per_page: int = 2


@dataclass
class Build:
    cleanup: bool = False
    chunk_size: int = 1500
    chunk_overlap: int = 200


@dataclass
class Embedders:
    index: Embedder = field(default_factory=Embedder)
    query: Embedder = field(default_factory=Embedder)


@dataclass
class Source:
    id: str = ""
    container: str = ""
    prefix: str = ""
    lang: str = "ru"


@dataclass
class Config:
    corpus: str = "data/corpus"
    index: str = "data/index"
    lang: str = "ru"
    link_scheme: str = LINK_SCHEME
    containers: str = ""
    tool: str = ""
    tool_prefix: str = "edtcli__"
    utilities: str = ""
    utility_prefix: str = "v8cli__"
    sources: list[Source] = field(default_factory=list)
    search: Search = field(default_factory=Search)
    build: Build = field(default_factory=Build)
    embedder: Embedders = field(default_factory=Embedders)

    @classmethod
    def load(cls, path: str | Path | None = None, env: Mapping[str, str] | None = None) -> Config:
        data = tomllib.loads(Path(path).read_text(encoding="utf-8")) if path else {}
        out = cls()
        out.update(data)
        out._environment(os.environ if env is None else env)
        return out

    @classmethod
    def found(cls, explicit: str | None = None, env: Mapping[str, str] | None = None) -> Config:
        """From the named file, else ``GLEANERY_CONFIG``, else ``./gleanery.toml``, else the defaults; the environment
        overrides each."""
        env = os.environ if env is None else env
        path = explicit or env.get(PREFIX + "CONFIG") or ("gleanery.toml" if Path("gleanery.toml").is_file() else None)
        return cls.load(path, env)

    def update(self, values: Mapping) -> None:
        """Set nested values; an unknown key or a value of the wrong kind raises before anything is set."""
        fresh = copy.deepcopy(self)
        _fill(fresh, values, "")
        for f in fields(self):
            setattr(self, f.name, getattr(fresh, f.name))

    def _environment(self, env: Mapping[str, str]) -> None:
        for path, holder, f in _leaves(self, ()):
            raw = env.get(PREFIX + "_".join(path).upper())
            if raw:
                try:
                    setattr(holder, f, _cast(getattr(holder, f), raw))
                except ValueError:
                    pass  # a number that cannot be read is passed over

    def sources_for(self, lang: str | None = None, ids: list[str] | None = None) -> list[Source]:
        lang = lang or self.lang
        return [s for s in self.sources if s.lang == lang and (ids is None or s.id in ids)]

    def query_embedder(self) -> Embedder:
        return self.embedder.query if self.embedder.query.complete else self.embedder.index

    def to_dict(self) -> dict:
        return asdict(self)

    def to_toml(self) -> str:
        return "\n".join(_toml(self.to_dict(), "")) + "\n"

    def save(self, path: str | Path) -> None:
        """Written beside and renamed, so that a reader sees the old file or the new one."""
        at = Path(path)
        tmp = at.with_name(at.name + ".tmp")
        tmp.write_text(self.to_toml(), encoding="utf-8")
        tmp.replace(at)


def _cast(old, raw: str):
    if isinstance(old, bool):
        return raw.strip().lower() in TRUE
    return int(raw) if isinstance(old, int) else raw


def _leaves(obj, path):
    for f in fields(obj):
        value = getattr(obj, f.name)
        if is_dataclass(value):
            yield from _leaves(value, (*path, f.name))
        elif not isinstance(value, list):
            yield (*path, f.name), obj, f.name


def _fill(obj, values: Mapping, where: str) -> None:
    names = {f.name for f in fields(obj)}
    for key, value in values.items():
        if key not in names:
            raise KeyError(f"unknown setting {where}{key}")
        old = getattr(obj, key)
        if is_dataclass(old):
            if not isinstance(value, Mapping):
                raise TypeError(f"{where}{key} is a table")
            _fill(old, value, f"{where}{key}.")
        elif key == "sources":
            made = []
            for row in value:
                s = Source()
                _fill(s, row, "sources.")
                made.append(s)
            obj.sources = made
        elif type(value) is not type(old):
            raise TypeError(f"{where}{key} is a {type(old).__name__}")
        else:
            setattr(obj, key, value)


def _toml(data: dict, at: str) -> list[str]:
    out = [f"{k} = {json.dumps(v, ensure_ascii=False)}" for k, v in data.items() if not isinstance(v, (dict, list))]
    for k, v in data.items():
        if isinstance(v, dict):
            out += ["", f"[{at}{k}]", *_toml(v, f"{at}{k}.")]
        elif isinstance(v, list):
            for row in v:
                out += ["", f"[[{at}{k}]]", *_toml(row, f"{at}{k}.")]
    return out
