"""Configuration: defaults under user values, checks, dotted paths, provider presets, and its file."""

from __future__ import annotations

import copy
import json
import os
from pathlib import Path

from lodestone.functions.fixed import DEFAULTS, PROVIDERS

_FIELDS = ("api_base", "model", "api_key_env", "dimensions", "batch_size", "query_prefix", "document_prefix")


def merged(base: dict, over: dict) -> dict:
    """``over`` upon ``base``: objects key by key, lists as the union in order, others replaced."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        old = out.get(key)
        if isinstance(value, dict) and isinstance(old, dict):
            out[key] = merged(old, value)
        elif isinstance(value, list) and isinstance(old, list):
            out[key] = list(dict.fromkeys([*old, *value]))
        else:
            out[key] = copy.deepcopy(value)
    return out


def validate(config: dict) -> dict:
    for path in ("embedding.dimensions", "chunking.max_tokens"):
        value = get(config, path)
        if not isinstance(value, (int, float)) or value <= 0:
            raise ValueError(f"{path} must be a positive number")
    if not get(config, "embedding.api_base"):
        raise ValueError("embedding.api_base is required")
    return config


def load(user: dict | None = None) -> dict:
    return validate(merged(DEFAULTS, user or {}))


def get(config: dict, path: str, default=None):
    for key in path.split("."):
        if not isinstance(config, dict) or key not in config:
            return default
        config = config[key]
    return config


def put(config: dict, path: str, value) -> None:
    *parents, leaf = path.split(".")
    for key in parents:
        if not isinstance(config.get(key), dict):
            config[key] = {}
        config = config[key]
    config[leaf] = value


def remove(config: dict, path: str) -> None:
    *parents, leaf = path.split(".")
    config = get(config, ".".join(parents)) if parents else config
    if isinstance(config, dict):
        config.pop(leaf, None)


def flatten(config: dict, prefix: str = "") -> list[tuple[str, object]]:
    out: list[tuple[str, object]] = []
    for key, value in config.items():
        path = f"{prefix}{key}"
        out += flatten(value, f"{path}.") if isinstance(value, dict) else [(path, value)]
    return out


def parse(text: str, like):
    """``text`` as the type of ``like``."""
    if isinstance(like, bool):
        if text not in ("true", "false"):
            raise ValueError(f"expected true or false, got {text!r}")
        return text == "true"
    if isinstance(like, (int, float)):
        number = float(text)
        return int(number) if number.is_integer() else number
    if isinstance(like, list):
        if text.startswith("["):
            try:
                return json.loads(text)
            except ValueError:
                pass
        return [x.strip() for x in text.split(",") if x.strip()]
    return text


def provider(name: str) -> dict:
    return dict(zip(_FIELDS, PROVIDERS[name], strict=True))


def detect_provider(config: dict) -> str | None:
    """The preset with the same endpoint, model and dimensions."""
    own = config["embedding"]
    return next((n for n in PROVIDERS if all(provider(n)[k] == own.get(k) for k in ("api_base", "model", "dimensions"))), None)


class ConfigFile:
    """User values in a JSON file, replaced whole by an atomic rename."""

    def __init__(self, path: str):
        self.path = Path(path)

    def user(self) -> dict:
        return json.loads(self.path.read_text()) if self.path.exists() else {}

    def effective(self) -> dict:
        return load(self.user())

    def _save(self, values: dict) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        draft = self.path.with_suffix(f".{os.getpid()}.tmp")
        draft.write_text(json.dumps(values, indent=2))
        draft.replace(self.path)

    def show(self) -> dict:
        config = self.effective()
        return {"provider": detect_provider(config), "values": dict(flatten(config)), "overrides": dict(flatten(self.user()))}

    def set(self, path: str, text: str) -> dict:
        like = get(DEFAULTS, path)
        if like is None or isinstance(like, dict):
            raise KeyError(path)
        before, values = self.effective(), self.user()
        put(values, path, parse(text, like))
        load(values)
        self._save(values)
        return {"key": path, "value": get(values, path), "dimensions_changed": before["embedding"]["dimensions"] != self.effective()["embedding"]["dimensions"]}

    def use_provider(self, name: str) -> dict:
        before, values = self.effective(), self.user()
        values["embedding"] = merged(values.get("embedding", {}), provider(name))
        self._save(values)
        return {"provider": name, "dimensions_changed": before["embedding"]["dimensions"] != values["embedding"]["dimensions"]}

    def reset(self, path: str | None = None) -> dict:
        before, values = self.effective(), self.user()
        if path is None:
            values = {}
        else:
            remove(values, path)
        self._save(values)
        return {"dimensions_changed": before["embedding"]["dimensions"] != self.effective()["embedding"]["dimensions"]}


class AccessList(ConfigFile):
    """Denied and allowed directories of a user."""

    def entries(self, kind: str) -> list[str]:
        return list(self.user().get(kind, []))

    def add(self, kind: str, path: str) -> bool:
        values = self.user()
        found = values.setdefault(kind, [])
        path = os.path.realpath(path)
        if path in found:
            return False
        found.append(path)
        self._save(values)
        return True

    def discard(self, kind: str, path: str) -> bool:
        values = self.user()
        path = os.path.realpath(path)
        if path not in values.get(kind, []):
            return False
        values[kind].remove(path)
        self._save(values)
        return True
